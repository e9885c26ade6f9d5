"""Byte-level BPE: exact encoding by backtracking over longest token matches, decoding by an offset table.

`encode_documents` gives each text's ids as the vocabulary's own merges would, special tokens in
the text included; `decode_documents` turns ids back into text; `round_trip` does both in one pass
over the rows. Texts are cut by the vocabulary's pre-split pattern and each piece is encoded by:

* an Aho-Corasick automaton over all tokens, which gives the longest token starting at each byte;
* a table of compatible pairs: `a b` may stand next to each other when none of the merges that
  build them would first join across their border. It is filled as pairs are met;
* backtracking: take the longest token, fall back to its longest proper token prefix when the pair
  is not compatible, give up the last token when nothing is left. A byte position that failed once
  is never tried again, so the work is linear.

Empty and null texts have no ids and decode to the empty text. Repeated rows give repeated rows.
Nothing is shuffled; columns of the input are kept only by name of the id, so clashing names are
no matter.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from pplscope.llm.frames import slices, whole_text

# Fixed value: the pre-split pattern of byte-level BPE vocabularies.
PRE_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
BLANK_AFTER_SPACE = regex.compile(r"\p{White_Space} ")
CHUNK_BORDER = regex.compile(r"(?<!\p{White_Space}) ")
# Memory of a worker, whatever the input: what falls out is worked out again.
CACHED_CHUNKS = 400_000
CACHED_PAIRS = 1_000_000
LONG_CHUNK = 64
LONE_MARKS = frozenset(".,")


def byte_letters() -> dict[str, int]:
    """Vocabulary files write bytes as letters: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """One vocabulary, ready to encode and decode; built once per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        model = spec["model"]
        text_of = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {}
        for token in spec["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
                raise ValueError(f"unsupported flags on token {token['content']!r}")
            self.special[token["content"]] = token["id"]
            text_of[token["id"]] = token["content"].encode()
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PRE_SPLIT)

        # Merge ranks, and for each merged token its halves.
        vocab, self.rank, self.formed, left, right = model["vocab"], {}, {}, {}, {}
        for rank, (a, b) in enumerate(model["merges"]):
            whole = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = rank
            if whole not in self.formed:
                self.formed[whole], left[whole], right[whole] = rank, vocab[a], vocab[b]
        self.left, self.right = left, right

        # Longest matches, and each token's longest proper prefix that is a token.
        plain = {vocab[t]: text_of[vocab[t]].decode("latin-1") for t in vocab}
        self.automaton = ahocorasick.Automaton()
        self.size, by_text = {}, {s: i for i, s in plain.items()}
        self.by_text = by_text
        for token, string in plain.items():
            self.automaton.add_word(string, (len(string), token))
            self.size[token] = len(string)
        self.automaton.make_automaton()
        self.shorter = {
            t: next((by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_text), None) for t, s in plain.items()
        }
        self.compatible: dict[tuple[int, int], bool] = {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

        # Decoding: all token bytes in one buffer, and where each token starts.
        count = max(text_of) + 1
        sizes = np.array([len(text_of.get(i, b"")) for i in range(count)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.frombuffer(b"".join(text_of.get(i, b"") for i in range(count)), np.uint8)

    def may_follow(self, a: int, b: int) -> bool:
        """Would the merges leave a border between token `a` and token `b`?

        Follow the two tokens next to the border as they grow, by rank. Joining them wins when its
        rank is lower than that of the next growth on either side; on equal rank the left pair wins.
        """
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        rising, falling = [a], [b]
        while rising[-1] in self.right:
            rising.append(self.right[rising[-1]])
        while falling[-1] in self.left:
            falling.append(self.left[falling[-1]])
        never, kept = 1 << 60, True
        while kept:
            grow_a = self.formed[rising[-2]] if len(rising) > 1 else never
            grow_b = self.formed[falling[-2]] if len(falling) > 1 else never
            across = self.rank.get((rising[-1], falling[-1]), never)
            if across < grow_a and across <= grow_b and across < never:
                kept = False
            elif grow_a == never and grow_b == never:
                break
            elif grow_a <= grow_b:
                rising.pop()
            else:
                falling.pop()
        if len(self.compatible) >= CACHED_PAIRS:
            self.compatible.clear()
        self.compatible[a, b] = kept
        return kept

    def encode_piece(self, piece: str) -> list[int]:
        string = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.by_text.get(string)
        if whole is not None:
            return [whole]
        longest: list[int | None] = [None] * len(string)
        for end, (size, token) in self.automaton.iter(string):
            longest[end - size + 1] = token  # ends only grow, so the last one kept is the longest
        tokens: list[int] = []
        dead: set[int] = set()
        sizes, shorter, pairs = self.size, self.shorter, self.compatible
        at, end, stop, last, token = 0, 0, len(string), None, longest[0]
        while at < stop:
            while token is not None:
                end = at + sizes[token]
                if end not in dead:
                    if last is None:
                        break
                    fits = pairs.get((last, token))
                    if self.may_follow(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token is not None:
                tokens.append(token)
                at, last = end, token
                token = longest[at] if at < stop else None
            elif last is None:
                raise ValueError(f"a byte of {piece!r} is not in the vocabulary")
            else:
                dead.add(at)
                token = tokens.pop()
                at -= sizes[token]
                last = tokens[-1] if tokens else None
                token = shorter[token]
        return tokens

    def _packed(self, text: str) -> bytes:
        """Ids of a text as int32 bytes, piece by piece."""
        return array("i", chain.from_iterable(map(self.encode_piece, self.pieces.findall(text)))).tobytes()

    def _after_blank(self, chunk: str) -> bytes:
        """The same for a blank and a chunk behind it; remembered by chunk, the last generations of them."""
        found = self.recent.get(chunk)
        if found is None:
            found = self.older.get(chunk)
            if found is None:
                word, end = (chunk[:-1], chunk[-1:]) if chunk[-1:] in LONE_MARKS else (chunk, "")
                if word.isalpha():  # one piece, and the mark behind it another: the pattern need not run
                    ids = self.encode_piece(" " + word) + (self.encode_piece(end) if end else [])
                    found = array("i", ids).tobytes()
                else:
                    found = self._packed(" " + chunk)
            if len(chunk) <= LONG_CHUNK:
                if len(self.recent) >= CACHED_CHUNKS:
                    self.older, self.recent = self.recent, {}
                self.recent[chunk] = found
        return found

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        No piece of the pattern goes on over a blank that follows a non-blank character, so the text
        may be cut in front of each; blanks behind white space stay in their chunk.
        """
        if BLANK_AFTER_SPACE.search(text):
            chunks = CHUNK_BORDER.split(text)
        else:
            chunks = text.split(" ")
        return b"".join([self._packed(chunks[0]), *map(self._after_blank, chunks[1:])])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as int32."""
        parts, at = [], 0
        if self.special and any(token in text for token in self.special):
            for match in self.split_special.finditer(text):
                parts += [self._plain(text[at : match.start()]), np.int32(self.special[match[0]]).tobytes()]
                at = match.end()
        parts.append(self._plain(text[at:] if at else text))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: one gather from the token buffer by the offset table."""
        first, last = self.starts[ids], self.starts[np.asarray(ids) + 1]
        sizes = last - first
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)].tobytes()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def _ids(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)]), pa.int32()))


def _texts(bpe: ByteBpe, lists) -> pa.Array:
    return pa.array([bpe.decode(x).decode("utf-8", "replace") for x in lists], pa.string())


def _run(docs: DataFrame, vocabulary_path: str, id_column: str, text_column: str, decoded: bool) -> DataFrame:
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))

    def encode(batches):
        bpe = vocabulary(vocabulary_path)
        for part in slices(batches, "text"):
            lists = [bpe.encode(text) for text in part.column("text").to_pylist()]
            columns = {"doc_id": part.column("doc_id"), "ids": _ids(lists)}
            if decoded:
                columns["decoded"] = _texts(bpe, lists)
            yield pa.RecordBatch.from_pydict(columns)

    kind = f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>" + ", decoded string" * decoded
    return rows.mapInArrow(encode, kind)


def encode_documents(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): one row per input row."""
    return _run(docs, vocabulary_path, id_column, text_column, decoded=False)


def round_trip(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): encoded, and the ids decoded again, in one pass."""
    return _run(docs, vocabulary_path, id_column, text_column, decoded=True)


def decode_documents(tokens: DataFrame, vocabulary_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(doc_id, decoded) from ids. Null lists decode to the empty text; bytes that are not UTF-8 to U+FFFD."""
    rows = tokens.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(ids_column), F.array().cast("array<int>")).alias("ids")
    )

    def decode(batches):
        bpe = vocabulary(vocabulary_path)
        for batch in batches:
            ids = batch.column("ids")
            flat, offsets = pc.list_flatten(ids).to_numpy(zero_copy_only=False), np.asarray(ids.offsets)
            offsets = offsets - offsets[0]
            lists = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": _texts(bpe, lists)})

    return rows.mapInArrow(decode, f"doc_id {dict(rows.dtypes)['doc_id']}, decoded string")
