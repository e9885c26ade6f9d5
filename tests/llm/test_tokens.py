"""BPE against the tokenizers library, the token store as an exact round trip."""

from __future__ import annotations

import hashlib
import random
import zlib
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pplscope import scratch
from pplscope.llm import bpe, dac, queries

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
EDGES = [
    "", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "  \n\t x   ", "日本語😀 café   x", "aaaa" * 500, "'s 'll don't",
    "\x00\x01�", "0" * 1000, " " * 999 + "x", "é ́a", "Straße, ΑΣ ΣΑΣ.", "<|startoftext|>x<|endoftext|>, ",
]


def texts(n: int = 800) -> list[str]:
    r = random.Random(3)
    letters = list("ab thein \n's.,'éñ😀0123\x1c\x1f\x85\xa0\t²½ ") + ["  ", "the ", "ing", "<|endoftext|>"]
    return EDGES + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_encoder_equals_the_library():
    library, own = Tokenizer.from_file(BYTES), bpe.ByteBpe(BYTES)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want, text
        assert own.decode(np.array(want, np.int64)).decode() == library.decode(want, skip_special_tokens=False)


def test_caches_of_any_size_give_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 2)
    small, text = bpe.ByteBpe(BYTES), "some words, some more words and some thereafter. " * 5
    assert small.encode(text).tolist() == bpe.vocabulary(BYTES).encode(text).tolist()


def test_encode_decode_frames(spark):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (None, "x<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "ids")
    coded = bpe.encode_documents(docs, BYTES)
    back = bpe.decode_documents(coded, BYTES)
    assert sorted((r.doc_id or 0, r.decoded) for r in back.collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert bpe.round_trip(docs.limit(0), BYTES).count() == 0


def test_op3(spark, small):
    library = Tokenizer.from_file(BYTES)
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_bpe_round_trip"](spark, small).collect()
    assert len(rows) == len(source)
    for r in rows:
        ids = library.encode(source[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(source[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 3000])
def test_codes(n, top):
    values = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32, endpoint=True)
    codes = dac.Codes(dac.encode(values))
    assert codes.all().tolist() == values.tolist()
    at = np.random.default_rng(1).permutation(n)
    assert codes.take(at).tolist() == values[at].tolist()


def test_word_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(dac, "CACHED_CHUNKS", 50)
    monkeypatch.setattr(dac, "CACHED_WORDS", 40)
    library, own, all_texts = Tokenizer.from_file(WORDS), dac.WordEncoder(WORDS), texts()
    for i in range(0, len(all_texts), 20):
        part = all_texts[i : i + 20]
        want = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert [x.tolist() for x in own.encode(part)] == want


def test_words_of_letters_go_to_the_model_alone(monkeypatch):
    library, own = Tokenizer.from_file(WORDS), dac.WordEncoder(WORDS)
    sent, whole = [], own._whole
    monkeypatch.setattr(own, "_whole", lambda text: sent.append(text) or whole(text))
    r = random.Random(8)
    letters = [*"abcdefgzABZéÉñßüÄŉǰİıſſΣσςжЖ한漢字ªºʰ\u0301\u0345\u200d²"]
    words = ["".join(r.choice(letters) for _ in range(r.choice([1, 2, 5, 12, 300]))) + r.choice(["", ",", "."]) for _ in range(3000)]
    texts = [" ".join(words[i : i + 10]) for i in range(0, len(words), 10)]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not any(w.isascii() and w.isalpha() for w in sent)
    sent.clear()
    own.encode(["Straße, café École. señor plain", "x1 $$$ it's"])
    assert sorted(sent) == ["$$$", "it's", "x1"]


def expected(source):
    library, start, out = Tokenizer.from_file(WORDS), 0, []
    for doc_id, text in source:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_every_code_point_before_a_mark():
    library, own = Tokenizer.from_file(WORDS), dac.WordEncoder(WORDS)
    # Every assigned one, and some of the others.
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) not in ("Cn", "Co") or c % 97 == 0)]
    for mark in (",", "."):
        for at in range(0, len(points), 1 << 15):
            texts = [f"a{c}{mark}" for c in points[at : at + (1 << 15)]]
            want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            assert [x.tolist() for x in own.encode(texts)] == want
    odd = [f"{w}{m} {w.upper()}{m}" for w in ("aİ", "ÉCOLE", "e\u0301a", "क़ख", "ŉx", "ǰa", "ΑΣ", "ß", "ﬁn", "Ǆa") for m in ",."]
    assert [x.tolist() for x in own.encode(odd)] == [e.ids for e in library.encode_batch_fast(odd, add_special_tokens=False)]


def test_op10(spark, small):
    source = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = sorted(tuple(r) for r in queries.QUERIES["op10_token_store"](spark, small).collect())
    assert got == expected(source)


def test_store_with_small_blocks_nulls_and_look_ups(spark, monkeypatch):
    monkeypatch.setattr(dac, "BLOCK_TOKENS", 16)
    rows = [(i * 7 % 101, f"text number {i} " * (i % 5), "extra") for i in range(101)] + [(None, "none", "x"), (500, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload string").repartition(5)
    path = scratch.new_path(spark, "test-store")
    dac.write_store(docs, path, WORDS, 1)
    got = sorted((tuple(r) for r in dac.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert got == expected(sorted(((i, t) for i, t, _ in rows), key=lambda r: -1 if r[0] is None else r[0]))
    ids = [i for r in sorted(dac.read_documents(spark, path, with_ids=True).collect(), key=lambda r: r.start) for i in r.ids]
    places = [0, 5, 17, len(ids) - 1, len(ids)]
    assert sorted(tuple(r) for r in dac.tokens_at(spark, path, places).collect()) == [(p, ids[p]) for p in places[:-1]]


def test_empty_store(spark):
    path = scratch.new_path(spark, "empty-store")
    dac.write_store(spark.createDataFrame([], "doc_id long, text string"), path, WORDS, 1)
    assert dac.read_documents(spark, path).count() == 0
