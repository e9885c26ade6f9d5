"""How document filters interact: what each removes at each place of each order, and its fair share.

A filter is a condition under which a document fails. All that any order of filters does follows from
one table: for every set of filters (a coalition), how many documents fail at least one of them. What a
filter removes after others is the difference of two coalitions; its fair share over all orders, the
Shapley value, solves a weighted least squares problem over all coalitions, in whole fractions.

Defined results: null texts and parts are empty ones. A document with a null id is neither a copy of
another nor has copies. Rows equal in id and text are documents of their own, none the copy of the other.
Several labels of an id add up to "any of them". An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pplscope import scratch
from pplscope.llm.frames import whole_text

COPY = "E"
BLANKS = "\t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def conditions(text: Column, words: Column) -> dict[str, Column]:
    """When a document fails, by filter: too short, repetitive, loud, with special characters."""
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 3,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """(doc_id, part, failed, n): how many rows of an id fail which filters, as bits in letter order.

    Only hashes of texts move. Rows are summed by (text, id) before copies are looked for, and the
    first id of a text meets its rows by text and id, so neither a text nor an id that very many rows
    share gathers in one task.
    """
    texts = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        whole_text(text_column).alias("text"),
    )
    cut = texts.withColumn("words", F.array_remove(F.split(F.translate("text", BLANKS, " " * len(BLANKS)), " "), ""))
    found = conditions(F.col("text"), F.col("words"))
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(found.values())), F.lit(0))
    rows = cut.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), bits.alias("failed"))
    rows = scratch.materialize(rows.groupBy("hash", "doc_id", "part", "failed").agg(F.count("*").alias("n")), "failures")
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("hash").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = rows.join(first, ["hash", "doc_id"], "left").withColumn(
        "failed", F.col("failed") + F.when(copy, F.lit(1 << len(found))).otherwise(F.lit(0))
    )
    return marked.groupBy("doc_id", "part", "failed").agg(F.sum("n").alias("n"))


def tabulate(failed: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(part, failed, n, good, toxic): documents by the set of filters they fail. A row per part and set."""
    label = labels.select(
        F.col(id_column).cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"),
    ).groupBy("doc_id").agg(*[F.coalesce(F.max(c).cast("int"), F.lit(0)).alias(c) for c in ("good", "toxic")])
    weigh = [F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]
    return failed.join(label, "doc_id", "left").groupBy("part", "failed").agg(F.sum("n").alias("n"), *weigh)


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system, exactly."""
    rows = [[*row, value] for row, value in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        pivot = next(r for r in range(i, len(rows)) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(len(rows)):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [row[-1] for row in rows]


def shapley(value: list[int], n: int) -> list[Fraction]:
    """Shapley values of a game of `n` players; `value[s]` is what the coalition with bits `s` gets.

    They are the additive game nearest to `value` under the weights (n-1) / (C(n,k) k (n-k)) of coalitions
    of k players, among those that give the whole to all. The normal equations get one multiplier for that.
    """
    if n == 1:
        return [Fraction(value[1] - value[0])]
    weight = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in range(1, (1 << n) - 1) if (k := s.bit_count())}
    has = [[s >> i & 1 for i in range(n)] for s in range(1 << n)]
    normal = [[sum((w for s, w in weight.items() if has[s][i] and has[s][j]), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    right = [sum((w * (value[s] - value[0]) for s, w in weight.items() if has[s][i]), Fraction(0)) for i in range(n)]
    return solve([*normal, [Fraction(1)] * n + [Fraction(0)]], [*right, Fraction(value[-1] - value[0])])[:n]


def removed_by(counts: dict[int, int], n: int) -> list[int]:
    """For every coalition, the documents that fail at least one of its filters."""
    return [sum(c for failed, c in counts.items() if failed & s) for s in range(1 << n)]


def steps(letters: str, documents: dict[int, int], good: dict[int, int], toxic: dict[int, int]) -> Iterator[tuple]:
    """One row per order and step, from counts by set of failed filters."""
    n, everything = len(letters), (1 << len(letters)) - 1
    gone, good_gone, toxic_gone = (removed_by(c, n) for c in (documents, good, toxic))
    total = sum(documents.values())
    share = [int(x * factorial(n)) for x in shapley(gone, n)]
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield (
                "".join(letters[j] for j in order), step, total - gone[after], removed, gone[1 << i] - removed,
                gone[everything] - gone[everything ^ 1 << i], good_gone[after] - good_gone[before],
                toxic_gone[after] - toxic_gone[before], share[i],
            )
            before = after


def audit(table: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters, step by step, per part, from (part, failed, n, good, toxic). A part is
    one row of at most 2**len(letters) sets."""
    sets = table.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))

    def each(batches):
        for batch in batches:
            for part, found in zip(batch.column("part").to_pylist(), batch.column("sets").to_pylist(), strict=True):
                games = ({s["failed"]: s[kind] for s in found} for kind in ("n", "good", "toxic"))
                rows = list(steps(letters, *games))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                columns[1] = columns[1].cast(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows)), *columns], ["part", "filter_order", "step", *COUNTS])

    return sets.mapInArrow(each, RESULT)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents, by language."""
    letters = "".join(conditions(F.lit(""), F.array())) + COPY
    return audit(tabulate(failures(docs), labels), letters)
