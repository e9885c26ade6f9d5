"""Scans: numbering without moving texts, limits from footers, dedup by bitmaps, a stated division."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pplscope.operators import identity as I
from pplscope.operators.identity import SCAN_ORDER
from pplscope.sources import parquet as src


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve files of a few row groups each, with ids that repeat and texts that are blank, empty or null."""
    top = tmp_path_factory.mktemp("scan")
    rng = random.Random(3)
    for f in range(12):
        rows = [(rng.choice([7, None, *range(40)]), rng.choice(["", None, "  ", f"text {f} {r} " + "x" * 200])) for r in range(rng.choice([1, 150, 400]))]
        rows = spark.createDataFrame(rows, "id long, text string").coalesce(1)
        rows.write.option("parquet.block.size", 8192).option("parquet.page.size", 1024).option("parquet.page.size.row.check.min", 10).parquet(f"{top}/part{f:02d}")
    return str(top)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def moved(df) -> list[str]:
    """Steps of the plan that shuffle, sort or gather texts."""
    steps = plan(df).split("\n")
    return [s for s in steps if re.search(r"Exchange (hash|range|Round|Single|shuffle)|Sort |Window ", s) and "text" in s]


def in_order(spark, folder):
    return sorted(map(tuple, src.scan_glob(spark, folder, "part*").select(*SCAN_ORDER, "id", "text").collect()))


@pytest.mark.parametrize("split", ["4k", "128m"])
def test_prompts_are_numbered_where_they_are_read(spark, folder, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = src.stream_prompts(src.scan_glob(spark, folder, "part*"))
        want = [t for *_, t in in_order(spark, folder) if t not in (None, "")]
        assert [(r.doc_id, r.text) for r in sorted(got.collect())] == list(enumerate(want))
        assert not moved(got) and "BroadcastHashJoin" in plan(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_numbering_more_splits_than_the_bound(spark, folder, monkeypatch):
    monkeypatch.setattr(I, "MAX_SPLITS", 2)
    got = src.stream_prompts(src.scan_glob(spark, folder, "part*"))
    want = [t for *_, t in in_order(spark, folder) if t not in (None, "")]
    assert [(r.doc_id, r.text) for r in sorted(got.collect())] == list(enumerate(want))


def test_a_column_of_the_number_s_name_is_replaced(spark, folder):
    df = src.scan_glob(spark, folder, "part*").withColumnRenamed("id", "doc_id")
    assert I.scan_index(df, F.lit(True)).columns == ["doc_id", "text", *SCAN_ORDER]


@pytest.mark.parametrize("limit, exact", [(1, True), (5, False), (100, True), (10**6, True)])
def test_limits_read_only_the_files_they_need(spark, folder, limit, exact):
    got = src.limited_prompts(spark, folder, "part*", limit, 4, exact)
    bound = limit if exact else -(-limit // 4) * 4
    want = [t for *_, t in in_order(spark, folder) if t not in (None, "")][:bound]
    assert [(r.doc_id, r.text) for r in sorted(got.collect())] == list(enumerate(want))
    if limit < 10:
        assert len(got.inputFiles()) <= 4
    with pytest.raises(FileNotFoundError):
        src.limited_prompts(spark, folder, "none*", 5, 4)


def test_first_rows_of_a_table(spark, folder):
    got = src.first_in_scan(spark, f"{folder}/part03", 3).collect()
    want = sorted(map(tuple, src.scan_parquet(spark, f"{folder}/part03", with_order=True).select(*SCAN_ORDER, "id", "text").collect()))[:3]
    assert sorted((r._file, r._row, r.id, r.text) for r in got) == want
    assert src.first_in_scan(spark, f"{folder}/part03", 0).count() == src.scan_parquet(spark, f"{folder}/part03").count()


@pytest.mark.parametrize("max_blocks", [1 << 14, 1])
def test_many_repeats_are_dropped_where_they_are_read(spark, folder, max_blocks, monkeypatch):
    monkeypatch.setattr(I, "ROWS_PER_BITMAP", 64)
    df = src.scan_glob(spark, folder, "part*").select("id", "text", *SCAN_ORDER)
    got = I.dedup_keep_first(df, "id", SCAN_ORDER, max_repeated=3, max_blocks=max_blocks)
    seen, want = set(), []
    for file, row, key, text in in_order(spark, folder):
        if key not in seen:
            seen.add(key)
            want.append((file, row, key, text))
    assert sorted((r._file, r._row, r.id, r.text) for r in got.collect()) == want
    assert got.columns == df.columns
    assert not moved(got) and "BroadcastHashJoin" in plan(got)


def test_a_stated_division(spark, folder):
    one = src.scan_parquet(spark, f"{folder}/part01", partitions=5)
    assert one.columns == ["id", "text"] and one.rdd.getNumPartitions() == 5
    assert one.count() == src.scan_parquet(spark, f"{folder}/part01").count()
    assert src.scan_parquet(spark, f"{folder}/part01", with_order=True, partitions=2).columns == ["id", "text", *SCAN_ORDER]
