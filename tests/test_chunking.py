from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pplscope.checks import corpus  # noqa: F401
from pplscope.checks.registry import QUERIES
from pplscope.operators import chunking as C
from pplscope.operators.selection import chunk_sample_text


def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def test_chunks_cover_their_document(spark, small):
    source = docs(spark, small)
    rows = C.chunk_documents(source, 500, 100).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.text_id, r.chunk_id)):
        assert 0 <= r.new_start <= r.new_end == len(r.chunk_text)
        by_doc.setdefault(r.text_id, []).append(r)
    for r in source.collect():
        parts = [c.chunk_text[c.new_start:] for c in by_doc[r.id]]
        assert [c.chunk_id for c in by_doc[r.id]] == list(range(len(parts)))
        cleaned = r.text.replace("\n", " ").replace("\r", " ").strip()
        assert "".join(" ".join(parts).split(" ")) == "".join(cleaned.split(" "))
        for before, c in zip(by_doc[r.id], by_doc[r.id][1:]):
            overlap = c.chunk_text[:c.new_start]
            base = before.chunk_text[before.new_start:]
            assert base.endswith(overlap) and (len(overlap) >= 100 or overlap == base)


def test_chunking_needs_no_shuffle(spark, small):
    plan = C.chunk_documents(docs(spark, small))._jdf.queryExecution().executedPlan().toString()
    # Packed once per document: one branch for texts that hold the marks, one for all others.
    assert "Exchange" not in plan and plan.count("regexp_extract_all(") == 2


def test_no_rows_for_empty_documents(spark):
    df = spark.createDataFrame([(1, ""), (2, " \n "), (3, None)], "id long, text string")
    assert C.chunk_documents(df).count() == 0
    assert C.recursive_chunks(df).count() == 0
    assert C.chunk_documents(df).columns == ["text_id", "chunk_id", "chunk_text", "new_start", "new_end"]


def test_overlap_has_no_separator(spark):
    df = spark.createDataFrame([(1, "Aaaa bbbb cccc. Dddd eeee ffff.")], "id long, text string")
    rows = C.chunk_documents(df, 16, 5).orderBy("chunk_id").collect()
    assert [r.chunk_text for r in rows] == ["Aaaa bbbb cccc.", "cccc.Dddd eeee ffff."]
    assert (rows[1].new_start, rows[1].new_end) == (5, 20)
    assert [r.new_text for r in C.new_span(C.chunk_documents(df, 16, 5)).orderBy("chunk_id").collect()] == [
        "Aaaa bbbb cccc.", "Dddd eeee ffff.",
    ]


def test_stored_chunks_get_the_same_overlap(spark, small):
    source = docs(spark, small)
    direct = C.chunk_documents(source, 300, 40)
    stored = C.overlap_chunks(C.base_chunks(source, 300), 40)
    assert direct.exceptAll(stored).count() == 0 == stored.exceptAll(direct).count()


@pytest.mark.skipif("CHUNK_GOLDEN_FILE" not in os.environ, reason="set CHUNK_GOLDEN_FILE to a chunk sample")
def test_golden_sample(spark):
    """Four lines per record (key, full text, new text, blank): re-chunking the joined new parts
    gives the same file."""
    with open(os.environ["CHUNK_GOLDEN_FILE"], encoding="utf-8") as f:
        lines = f.read().split("\n")
    new = [lines[i + 2].removeprefix("⋯new⋯  ") for i in range(0, 80, 4)]
    text_id = int(lines[0].split("=")[1].split()[0])
    df = spark.createDataFrame([(text_id, " ".join(new))], "id long, text string")
    sample = chunk_sample_text(C.chunk_documents(df, 500, 100)).orderBy("chunk_id").collect()
    assert "\n".join(r.value for r in sample).split("\n") == lines[:len("\n".join(r.value for r in sample).split("\n"))]
    assert len(sample) == 20


def test_invented_sample(spark):
    df = spark.createDataFrame([(1, "Ann has a cat.\nBob has two dogs. Cid ran.")], "id long, text string")
    sample = chunk_sample_text(C.chunk_documents(df, 30, 8)).orderBy("chunk_id").collect()
    assert [r.value for r in sample] == [
        "[id=1 | chunk=0]\n⋯full⋯ Ann has a cat.\n⋯new⋯  Ann has a cat.\n",
        "[id=1 | chunk=1]\n⋯full⋯ has a cat.Bob has two dogs. Cid ran.\n⋯new⋯  Bob has two dogs. Cid ran.\n",
    ]


@pytest.mark.parametrize(
    "n, ctx, stride, spans",
    [(10, 6, 3, [(0, 3), (0, 6), (3, 9), (6, 10)]), (10, 3, 3, [(0, 3), (3, 6), (6, 9), (9, 10)]), (0, 4, 2, [])],
)
def test_windows(spark, n, ctx, stride, spans):
    df = spark.createDataFrame([(1, [str(i) for i in range(n)])], "doc_id long, tokens array<string>")
    rows = C.document_windows(df, ctx, stride).orderBy("window_id").collect()
    assert [(r.beg, r.end) for r in rows] == spans
    assert all(r.window_tokens == [str(i) for i in range(r.beg, r.end)] for r in rows)


def test_exploded_windows_do_not_carry_the_document(spark, small):
    tokens = docs(spark, small).select(F.col("id").alias("doc_id"), F.split("text", " ").alias("tokens"))
    plan = C.document_windows(tokens, 6, 3)._jdf.queryExecution().executedPlan().toString()
    explode = next(line for line in plan.split("\n") if "Generate posexplode" in line)
    kept = explode.rsplit("), [", 1)[1].split("]")[0]
    assert kept.startswith("doc_id#") and "," not in kept


def test_windows_need_room_for_the_stride(spark):
    df = spark.createDataFrame([(1, ["a"])], "doc_id long, tokens array<string>")
    for ctx, stride in ((-1, 2), (2, 4), (4, 0)):
        with pytest.raises(ValueError):
            C.document_windows(df, ctx, stride)


def test_stitching(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(10)])], "doc_id long, tokens array<string>")
    scored = C.document_windows(df, 6, 3).withColumn(
        "scores", F.transform("window_tokens", lambda t, i: F.when(i > 0, t))
    )
    assert C.stitch_windows(scored).first().scores == [str(i) for i in range(1, 10)]
    joined = ["1", "2", "1", "2", "3", "4", "5", "4", "5", "6", "7", "8", "7", "8", "9"]
    assert C.stitch_windows(scored, "concat").first().scores == joined[:10]
    with pytest.raises(ValueError):
        C.stitch_windows(scored, "other")


def test_stitched_windows_are_stitched_where_they_are_cut(spark, tmp_path):
    rows = [(i, " ".join(f"t{j}" for j in range(n))) for i, n in enumerate([0, 1, 2, 17, 70, 200])] + [(None, "a b c"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["stitched_windows"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.split("\n") if "Exchange" in line]
    assert moves and all("REPARTITION_BY_NUM" in line for line in moves)
    n = {(r.doc_id, r.mode): r.n for r in got.collect()}
    assert n == {
        (1, "fresh"): 0, (1, "concat"): 0, (2, "fresh"): 1, (2, "concat"): 1, (3, "fresh"): 16, (3, "concat"): 17,
        (4, "fresh"): 69, (4, "concat"): 70, (5, "fresh"): 199, (5, "concat"): 200, (None, "fresh"): 2, (None, "concat"): 2,
    }


def test_chunk_before_where_keys_repeat_or_are_missing(spark):
    rows = [(1, i, f"c{i}") for i in range(130)] + [(1, 63, "again"), (2, 5, "x"), (2, 7, "y"), (None, 1, "n"), (None, 2, "m"), (3, None, "k")]
    df = spark.createDataFrame(rows, "text_id long, chunk_id int, chunk_text string").repartition(3)
    before = df.selectExpr("text_id", "chunk_id + 1 AS chunk_id", "chunk_text AS previous")
    got, want = C.previous_chunk(df), df.join(before, ["text_id", "chunk_id"], "left")
    assert got.columns == want.columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
