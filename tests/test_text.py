"""Column functions against plain Python on the same strings."""

from __future__ import annotations

import random
import re
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from pplscope.functions import text as T


def apply(spark, values, make, type_="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i long, v {type_}").select("i", make(F.col("v")).alias("r"))
    return [r.r for r in sorted(rows.collect(), key=lambda r: r.i)]


def noisy_texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = ["a", "Bc", "é", "日本", "😀", "_", "7", ".", "!", "?", '"', " ", "  ", "\n", "\r", "\t", " ", "\x1c", "Mr", "-", ")"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_strip_is_python_strip(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    values = ["".join(every) + "a" + "".join(every), "", " \x1c ", "a b"] + noisy_texts(200)
    assert apply(spark, values, T.strip) == [v.strip() for v in values]


def test_clean_text(spark):
    values = ["\u001c a\r\nb  ", "", "\n", "x\n\ny"] + noisy_texts(200)
    want = [v.replace("\n", " ").replace("\r", " ").strip() for v in values]
    assert want[0] == "a  b"
    assert apply(spark, values, T.clean_text) == want


@pytest.mark.parametrize(
    "text, n",
    [
        ("Mr. A. B. Lee came. He left!", 2), ("U.S. fort fell. Gen. Lee ran.", 2),
        ('Prof (J. R. R. Tolkien) wrote. "Yes."', 2), ("x", 1), ("", 0), ("One. two. Three", 2), ("Ja? Œuvre! (End).", 3),
    ],
)
def test_sentence_count(spark, text, n):
    assert len(apply(spark, [text], T.split_sentences)[0]) == n


def test_sentences_lose_only_the_blanks_between_them(spark):
    values = [v.strip() for v in noisy_texts(300, seed=5)]
    values = [v.replace("\n", " ").replace("\r", " ").strip() for v in values]
    for v, parts in zip(values, apply(spark, values, T.split_sentences)):
        assert "".join("".join(parts).split(" ")) == "".join(v.split(" "))


def fold(sentences, size):
    """Chunks by trying, for each start, the longest run of sentences that fits."""
    out, i = [], 0
    while i < len(sentences):
        j = i + 1
        while j < len(sentences) and len(" ".join(sentences[i:j + 1])) <= size:
            j += 1
        out.append(" ".join(sentences[i:j]))
        i = j
    return out


def test_packing_fixtures(spark):
    cases = [["aa", "bbb", "c"], ["123456789"], [], ["123456789", "a", "b"]]
    assert apply(spark, cases, lambda c: T.pack_sentences(c, 6), "array<string>") == [
        ["aa bbb", "c"], ["123456789"], [], ["123456789", "a b"],
    ]


def test_packing_matches_brute_force(spark):
    rng = random.Random(3)
    cases = [["é" * rng.randrange(1, 30) for _ in range(rng.randrange(0, 40))] for _ in range(200)]
    cases.append(["😀" * 9] * 1500)
    assert apply(spark, cases, lambda c: T.pack_sentences(c, 20), "array<string>") == [fold(c, 20) for c in cases]


def test_each_chunk_knows_the_one_before(spark):
    got = apply(spark, [["a", "b", "c"], ["x"], []], T.with_previous, "array<string>")
    assert [[tuple(p) for p in row] for row in got] == [[(None, "a"), ("a", "b"), ("b", "c")], [(None, "x")], []]


def test_long_documents_take_linear_time(spark):
    """A document of several megabytes in one row."""
    text = "The quick fox jumps over it. Another sentence follows here!\n" * 60_000
    df = spark.createDataFrame([(text,)], "text string")
    packed = T.pack_sentences(T.split_sentences(T.clean_text(F.col("text"))))
    pieces = T.recursive_pieces(F.col("text"))
    started = time.time()
    row = df.select(F.size(packed).alias("a"), F.size(pieces).alias("b")).first()
    assert row.a >= len(text) / 500 and row.b >= len(text) / 500
    assert time.time() - started < 60


def tail_by_words(text, n):
    """The shortest suffix of at least n characters that does not start inside a word."""
    for length in range(n, len(text)):
        s = len(text) - length
        if not (re.fullmatch(r"\w", text[s]) and re.fullmatch(r"\w", text[s - 1])):
            return text[s:]
    return text


def test_overlap_tail(spark):
    cases = ["economy today", "ab cd", "ab", "naïveté", "x" * 50, "a.b", "日本語 テスト"] + noisy_texts(300, seed=9)
    for n in (1, 3, 5):
        assert apply(spark, cases, lambda c: T.overlap_tail(c, n)) == [tail_by_words(v, n) for v in cases]
    assert apply(spark, ["ab cd"], lambda c: T.overlap_tail(c, 3)) == [" cd"]


def split_before(text, separator):
    """Pieces of text, cut in front of each separator."""
    cuts, at = [0], text.find(separator)
    while at >= 0:
        cuts.append(at)
        at = text.find(separator, at + len(separator))
    return [p for p in (text[a:b] for a, b in zip(cuts, cuts[1:] + [len(text)])) if p]


def by_levels(text, size, separators):
    here = next((s for s in separators if s in text), separators[-1])
    deeper = separators[separators.index(here) + 1:]
    out, run = [], []

    def close():
        joined = []
        for p in run:
            if joined and len(joined[-1]) + len(p) <= size:
                joined[-1] += p
            else:
                joined.append(p)
        out.extend(j.strip() for j in joined if j.strip())
        run.clear()

    for piece in split_before(text, here):
        if len(piece) < size:
            run.append(piece)
            continue
        close()
        out.extend(by_levels(piece, size, deeper) if deeper else [piece])
    close()
    return out


def test_recursive_pieces(spark):
    rng = random.Random(4)
    parts = ["word ", "longerword", ".", "\n", "\n\n", "\n\n\n", "  ", "é" * 30, "x" * 45, ". "]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    cases += ["y" * 40, "y" * 39 + ".", "a" * 20 + "." + "b" * 19, "", " \n ", "q" * 100]
    want = [by_levels(c, 40, ["\n\n", "\n", "."]) for c in cases]
    assert apply(spark, cases, lambda c: T.recursive_pieces(c, 40)) == want


def test_url_file_name(spark):
    urls = [
        "https://h.org/a/b/0000.parquet?x=1", "https://h.org", "https://h.org/", "http://h/a;p", "http://h/a;p/b.c#f",
        "/local/x.json", "http://h/with space.txt", "http://u:p@h:80/d/é.csv?q=/no/this",
    ]
    assert apply(spark, urls, T.url_file_name) == [urlparse(u).path.rsplit("/", 1)[-1] for u in urls]


def test_file_name_loses_every_suffix(spark):
    assert apply(spark, ["a.csv", "a.csv.csv", "b"], lambda c: T.strip_suffix_everywhere(c, ".csv")) == ["a", "a", "b"]
