"""Token ids in directly addressable codes.

An id is cut into chunks of `CHUNK_BITS`, lowest first. Level 0 holds the lowest chunk of every id
and a bitmap that says which ids go on; level 1 holds the second chunk of those, and so on. A rank
directory over each bitmap (ones before every word of 64) turns a position on one level into the
position on the next, so any id is read by a few look-ups, without decoding what surrounds it.

A store is a Parquet table of blocks: `part` and `block` number them in ascending document order,
`start` counts the ids before the block within its part, `payload` is the block in the layout of
`pack`. Documents are never cut: a block holds whole documents, at least one. Rows are ordered by
id (null ids first, equal ids by text); empty and null texts hold the end id alone; an empty table
gives an empty store.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pplscope.llm.frames import partitions, slices
from pplscope.llm.order import ordered

CHUNK_BITS = 8
BLOCK_TOKENS = 1 << 18
MAGIC = b"DAC1"
STORE = "part int, block int, start long, n_docs int, n_tokens long, payload binary"
SLICE_BYTES = 2 << 20
# Memory of a worker, whatever the input: what falls out goes to the library again.
CACHED_CHUNKS, CACHED_WORDS, LONG_CHUNK = 450_000, 600_000, 64
LONE_MARKS = frozenset(",.")


def encode(ids: np.ndarray) -> bytes:
    """Levels of chunks with continuation bitmaps and rank directories."""
    values, levels = np.asarray(ids, np.uint32), []
    while True:
        rest = values >> np.uint32(CHUNK_BITS)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
        ones = np.bitwise_count(bits.view("<u8")).astype(np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append((values.astype(np.uint8), bits, ranks))
        if not more.any():
            break
        values = rest[more]
    head = struct.pack("<BQ", len(levels), len(ids))
    return head + b"".join(struct.pack("<Q", len(c)) + c.tobytes() + b.tobytes() + r.tobytes() for c, b, r in levels)


class Codes:
    """A coded sequence, read in place."""

    def __init__(self, data):
        count, self.size = struct.unpack_from("<BQ", data)
        self.levels, at = [], struct.calcsize("<BQ")
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            words = -(-n // 64)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, "<u8", words, at + 8 + n)
            ranks = np.frombuffer(data, "<u4", words + 1, at + 8 + n + 8 * words)
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + 8 * words + 4 * (words + 1)

    def take(self, positions) -> np.ndarray:
        """Ids at any positions."""
        at = np.asarray(positions, np.int64)
        out, left = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[left] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = bits[word]
            more = (here >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(here & ((np.uint64(1) << bit) - np.uint64(1)))
            at, left = (ranks[word] + below)[more].astype(np.int64), left[more]
            if not len(left):
                break
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out, left = np.zeros(self.size, np.uint32), None
        for level, (chunks, bits, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            if left is None:
                out, left = part.copy(), np.arange(self.size)
            else:
                out[left] |= part
            more = np.unpackbits(bits.view(np.uint8), count=len(chunks), bitorder="little").astype(bool)
            left = left[more]
        return out


def pack(doc_ids: list, lists: list[np.ndarray]) -> bytes:
    """A block: magic, number of documents, ids (with a bitmap of null ones), token counts, coded tokens."""
    known = np.array([d is not None for d in doc_ids], bool)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    sizes = np.array([len(x) for x in lists], "<i8")
    return (
        MAGIC + struct.pack("<I", len(doc_ids)) + np.packbits(known, bitorder="little").tobytes() + ids.tobytes()
        + sizes.tobytes() + encode(np.concatenate([*lists, np.zeros(0, np.uint32)]))
    )


def unpack(payload: bytes) -> tuple[list, np.ndarray, Codes]:
    """(document ids, token counts, codes) of a block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of coded tokens")
    (n,) = struct.unpack_from("<I", payload, 4)
    at = 8 + -(-n // 8)
    known = np.unpackbits(np.frombuffer(payload, np.uint8, -(-n // 8), 8), count=n, bitorder="little")
    ids, sizes = np.frombuffer(payload, "<i8", n, at), np.frombuffer(payload, "<i8", n, at + 8 * n)
    doc_ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)]
    return doc_ids, sizes, Codes(memoryview(payload)[at + 16 * n :])


class WordEncoder:
    """The tokenizers library behind two memories.

    For a vocabulary whose split drops white space, nothing crosses a blank, so a text's ids are
    those of its chunks; a chunk that is letters, as the vocabulary normalises them, and one mark is the
    letters' ids and the mark's. Letters that become something else (a letter and an accent) stay with the mark.
    Letters not yet known are normalised and one piece, so they go to the library's model alone; any other
    chunk goes through the whole library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.normal, self.letters = self.library.normalizer.normalize_str, Letters(self.library)
        special = any(token.content.isalpha() for token in self.library.get_added_tokens_decoder().values())
        plain = not special and all(map(self.letters.__getitem__, ascii_lowercase))
        self.model = self.library.model if plain else None
        self.chunks, self.words = Recent(CACHED_CHUNKS, self._chunk), Recent(CACHED_WORDS, self._word)

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of normalised letters."""
        if self.model is None:
            return self._whole(word)
        seen = "".join(map(self.letters.__getitem__, word))
        return array("I", [token.id for token in self.model.tokenize(seen)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        mark = chunk[-1:] if chunk[-1:] in LONE_MARKS else ""
        word = chunk[:-1] if mark else chunk
        if word.isascii():
            known = word.isalpha()
            word = word.lower()  # the vocabulary's own first step
        else:
            word = self.normal(word)
            known = all(map(self.letters.__getitem__, word))
        if not known:
            return self._whole(chunk)
        return self.words[word] + self.chunks[mark] if mark else self.words[word]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32."""
        known = self.chunks.__getitem__
        out = [np.frombuffer(b"".join(map(known, text.replace("\n", " ").split(" "))), np.uint32) for text in texts]
        self.words, self.chunks = self.words.rotated(), self.chunks.rotated()
        return out


class Letters(dict):
    """What the model sees for a character that the library keeps with the letters around it, and apart from
    a mark behind it; empty for any other."""

    def __init__(self, library):
        self.cut = library.pre_tokenizer.pre_tokenize_str

    def __missing__(self, character: str) -> str:
        inside = self.cut(f"a{character}a")
        self[character] = inside[0][0][1:-1] if len(self.cut(f"a{character},")) == 2 and len(inside) == 1 else ""
        return self[character]


class Recent(dict):
    """What was met lately, in two generations, made where it is not known; long keys are kept for one call only."""

    def __init__(self, size: int, make: Callable[[str], bytes], old: dict[str, bytes] | None = None):
        self.size, self.make, self.old, self.long = size, make, old or {}, []

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONG_CHUNK:
                self.long.append(key)
        self[key] = value
        return value

    def rotated(self) -> Recent:
        for key in self.long:
            self.pop(key, None)
        self.long = []
        if len(self) < self.size:
            return self
        self.old = {}
        return Recent(self.size, self.make, self)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_store(docs: DataFrame, path: str, vocabulary_path: str, end_id: int, id_column: str = "doc_id",
                text_column: str = "text") -> None:
    """Encode every text, append `end_id`, and write the ids in ascending order of document id.

    Texts move once, to ranges of ids; each task streams its sorted range into blocks.
    """
    rows = ordered(docs, id_column, text_column)
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "_order", "_tie").sortWithinPartitions("_order", "_tie")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def blocks(batches):
        library, end = encoder(vocabulary_path), np.array([end_id], np.uint32)
        ids, lists, held, block, start, part = [], [], 0, 0, 0, 0

        def closed():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "start": pa.array([start], pa.int64()),
                "n_docs": pa.array([len(ids)], pa.int32()), "n_tokens": pa.array([held], pa.int64()),
                "payload": pa.array([pack(ids, lists)], pa.binary()),
            })

        for piece in slices(batches, "text", SLICE_BYTES):
            part = piece.column("part")[0].as_py()
            for doc_id, tokens in zip(piece.column("doc_id").to_pylist(), library.encode(piece.column("text").to_pylist()), strict=True):
                ids.append(doc_id)
                lists.append(np.concatenate([tokens, end]))
                held += len(tokens) + 1
                if held >= BLOCK_TOKENS:
                    yield closed()
                    ids, lists, held, block, start = [], [], 0, block + 1, start + held
        if ids:
            yield closed()

    rows.mapInArrow(blocks, STORE).write.parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The store's blocks, each with the number of ids before its part. One row per part is added up
    and broadcast: as many as the store has files."""
    store = spark.read.schema(STORE).parquet(path)
    totals = {r.part: r.n for r in store.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, rows = 0, []
    for part in sorted(totals):
        rows.append((part, before))
        before += totals[part]
    return store.join(F.broadcast(spark.createDataFrame(rows, "part int, part_start long")), "part")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the store's blocks."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches):
        for batch in batches:
            for payload, start, part_start in zip(*(batch.column(c) for c in ("payload", "start", "part_start")), strict=True):
                doc_ids, sizes, codes = unpack(payload.as_py())
                tokens, ends = codes.all().astype("<u4"), np.cumsum(sizes)
                starts = ends - sizes
                columns = {
                    "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts + start.as_py() + part_start.as_py(), pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(tokens[a:b].data) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([starts, ends[-1:]]), pa.int32()), pa.array(tokens.astype(np.int32))
                    )
                yield pa.RecordBatch.from_pydict(columns)

    return _placed(spark, path).select("payload", "start", "part_start").mapInArrow(read, kind)


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """(position, token) at the wanted places of the whole sequence; a block is opened only when one
    of them falls in it, and only those ids are read. Places outside the store are left out."""
    wanted = np.unique(np.asarray(positions, np.int64))

    def read(batches):
        for batch in batches:
            for payload, first in zip(batch.column("payload"), batch.column("first").to_pylist(), strict=True):
                _, _, codes = unpack(payload.as_py())
                inside = wanted[(wanted >= first) & (wanted < first + codes.size)]
                yield pa.RecordBatch.from_pydict({
                    "position": pa.array(inside), "token": pa.array(codes.take(inside - first).astype(np.int32))
                })

    first = F.col("start") + F.col("part_start")
    hit = F.exists(F.array(*[F.lit(int(p)) for p in wanted]), lambda p: (p >= first) & (p < first + F.col("n_tokens")))
    return _placed(spark, path).where(hit).select("payload", first.alias("first")).mapInArrow(read, "position long, token int")
