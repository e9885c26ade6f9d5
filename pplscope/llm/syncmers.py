"""Document fingerprints from closed syncmers.

Of a text's k-mers (k code points) those are anchors whose smallest s-mer stands at one of the two
edges. That depends on the k-mer alone, not on its neighbours, so an edit only changes the anchors
that overlap it, and at least every k-s characters there is one. A fingerprint is the sequence of
anchors, each with its distance to the next one, written as base64 of four bytes per anchor.

`likeness` compares two fingerprints by position: what counts is an anchor together with its
distance to the next anchor and that anchor, so shared stretches of text match and scattered
anchors do not. It is the Dice measure of these triples, 1 for equal fingerprints.

Texts shorter than k have one anchor, the hash of the whole; empty and null texts have none, and
are alike only each other. Equal texts have equal fingerprints. Rows with equal ids are ordered by
text. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pplscope.llm.frames import slices, whole_text
from pplscope.llm.order import with_next

K, S = 24, 8
FACTOR, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MAX_GAP = 255


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def _doubled(values: np.ndarray, width: int, join) -> np.ndarray:
    """`join` over every window of `width` values, in log(width) steps."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = join(out[: len(out) - step], out[step:])
        have += step
    return out


def _hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` codes."""
    out = np.zeros(max(0, len(codes) - width + 1), np.uint64)
    for i in range(width):
        out = out * np.uint64(FACTOR) + codes[i : i + len(out)]
    return mix(out)


def anchors(texts: list[str], k: int = K, s: int = S) -> list[np.ndarray]:
    """Each text's anchors as uint32: 24 bits of hash, 8 bits of distance to the next (0 after the last)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    positions = np.zeros(0, np.int64)
    if len(codes) >= k:
        small = _hashes(codes + np.uint64(1), s)
        lowest = _doubled(small, k - s + 1, np.minimum)
        edge = (lowest == small[: len(lowest)]) | (lowest == small[k - s :])
        positions = np.flatnonzero(edge)
        # Only k-mers within one text.
        inside = starts[np.searchsorted(starts, positions, "right")] - positions >= k
        positions = positions[inside]
        # An anchor's own hash: of the s-mers that tile it.
        value = np.zeros(len(positions), np.uint64)
        for at in [*range(0, k - s, s), k - s]:
            value = mix(value * np.uint64(FACTOR) + small[positions + at])
    bounds = np.searchsorted(positions, starts)
    out = []
    for i, text in enumerate(texts):
        lo, hi = bounds[i], bounds[i + 1]
        if hi > lo:
            gaps = np.zeros(hi - lo, np.uint64)
            gaps[:-1] = np.minimum(np.diff(positions[lo:hi]), MAX_GAP)
            out.append((((value[lo:hi] >> np.uint64(40)) << np.uint64(8)) | gaps).astype(np.uint32))
        elif text:
            whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=3).digest()
            out.append(np.array([int.from_bytes(whole, "big") << 8], np.uint32))
        else:
            out.append(np.zeros(0, np.uint32))
    return out


def written(sequence: np.ndarray) -> str:
    return base64.b64encode(sequence.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice measure of the multisets of (anchor, distance, next anchor)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))

    def triples(x: np.ndarray) -> np.ndarray:
        wide = x.astype(np.uint64)
        wide[:-1] |= (wide[1:] >> np.uint64(8)) << np.uint64(32)
        return wide

    both = np.sort(np.concatenate([_numbered(triples(a)), _numbered(triples(b))]))
    return 2.0 * int((both[1:] == both[:-1]).sum()) / (len(a) + len(b))


def _numbered(values: np.ndarray) -> np.ndarray:
    """Values made distinct: the n-th of equal ones is hashed with n."""
    ordered = np.sort(values)
    first = np.searchsorted(ordered, ordered, "left")
    nth = (np.arange(len(ordered)) - first).astype(np.uint64)
    return mix(ordered + nth * np.uint64(FACTOR))


def edited(text: str, following: str) -> str:
    """The text, its last quarter replaced by as much of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(doc_id, fingerprint) of every row; no shuffle."""
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            found = anchors(part.column("text").to_pylist(), k, s)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fingerprint": pa.array(map(written, found))})

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


def compare_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(doc_id, text, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row:
    against its text with the last quarter taken from the next document, and against the next document.

    Rows are streamed in ascending order of id; a row waits for the one behind it.
    """
    schema = "doc_id long, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = with_next(docs, id_column, text_column)
    if rows is None:
        return docs.sparkSession.createDataFrame([], schema)

    def compared(ids, texts):
        """All but the last of the texts, each with the one behind it."""
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        found, other = anchors(texts, k, s), anchors(changed, k, s)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids[:-1], pa.int64()), "text": pa.array(texts[:-1], pa.string()), "edited": pa.array(changed, pa.string()),
            "fingerprint": pa.array(map(written, found[:-1]), pa.string()),
            "edited_fingerprint": pa.array(map(written, other), pa.string()),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(found[:-1], other, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(a, b) for a, b in zip(found[:-1], found[1:], strict=True)], pa.float64()),
        })

    def run(batches):
        ids, texts, closed = [], [], None
        for part in slices(batches, "text"):
            here = part.column("_range").to_pylist()
            for doc_id, text, place, guest in zip(
                part.column("doc_id").to_pylist(), part.column("text").to_pylist(), here, part.column("_guest").to_pylist(), strict=True
            ):
                if place == closed:
                    continue  # a further copy of the guest
                ids.append(doc_id)
                texts.append(text)
                if guest:
                    closed = place
                    yield compared(ids, texts)
                    ids, texts = [], []
            if len(texts) > 1:
                yield compared(ids, texts)
                ids, texts = ids[-1:], texts[-1:]

    return rows.select("doc_id", "text", "_range", "_guest").mapInArrow(run, schema)
