from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException

from pplscope import scratch
from pplscope.operators.scoring import WordLengthScorer
from pplscope.plans import jobs
from pplscope.sinks import writers
from pplscope.sources import manifest as M, parquet as src, responses as R
from pplscope.streaming.incremental import incremental_scoring, read_results


def test_scan_order_and_glob(spark, tmp_path):
    for name, lo in (("b", 10), ("a", 0)):
        spark.range(lo, lo + 5).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    df = src.scan_glob(spark, str(tmp_path), "*.parquet")
    assert [r.id for r in df.orderBy("_file", "_row").collect()] == [*range(5), *range(10, 15)]
    with pytest.raises(FileNotFoundError):
        src.scan_glob(spark, str(tmp_path), "none*.parquet")


def test_prompts_are_numbered_in_scan_order(spark, tmp_path):
    rows = [("a",), ("",), (None,), ("  ",), ("b",)]
    spark.createDataFrame(rows, "text string").coalesce(1).write.parquet(f"{tmp_path}/x.parquet")
    df = src.stream_prompts(src.scan_glob(spark, str(tmp_path), "x.parquet"))
    assert sorted(map(tuple, df.collect())) == [(0, "a"), (1, "  "), (2, "b")]


def test_responses_csv(spark, tmp_path):
    text = 'is_correct,model_response\nTrue,"a, ""quoted""\nsecond line"\nFalse,None\nTrue,NULL\nTrue,\nTrue,"  "\n,plain\n'
    for name in ("phi-9.csv", "x.csv.csv"):
        (tmp_path / name).write_text(text)
    df = R.scan_responses_csv(spark, str(tmp_path / "*.csv"))
    rows = [tuple(r) for r in df.where("model = 'phi-9'").collect()]
    assert rows[0] == ("phi-9", 'a, "quoted"\nsecond line', True)
    assert [r[1] for r in rows[1:]] == [None, None, None, "  ", "plain"]
    assert [r[2] for r in rows[1:]] == [False, True, True, True, None]
    assert {r.model for r in df.select("model").distinct().collect()} == {"phi-9", "x"}
    mapped = R.scan_responses_csv(spark, str(tmp_path / "*.csv"), {"phi-9.csv": "renamed"})
    assert {r.model for r in mapped.collect()} == {"renamed"}


def test_responses_without_correctness(spark, tmp_path):
    (tmp_path / "m.csv").write_text("model_response\nyes\n")
    assert R.scan_responses_csv(spark, str(tmp_path / "m.csv")).columns == ["model", "model_response"]


def test_manifest(spark):
    listing = '["http://h/a/0.parquet?x=1", "http://h", "http://h/b/0.parquet", "http://h/c;p", "http://h/have"]'
    rows = spark.createDataFrame([(listing,), ('{"not": "a list"}',), (None,), ("junk",)], "value string")
    files = M.manifest_from_json(rows)
    assert [r.filename for r in files.orderBy("position").collect()] == ["0.parquet", "", "0.parquet", "c", "have"]
    existing = spark.createDataFrame([("have",), ("have",)], "filename string")
    status = {r.position: r.status for r in M.download_status(files, existing).collect()}
    assert status == {0: "pending", 1: "pending", 2: "repeated", 3: "pending", 4: "present"}
    assert sorted(r.position for r in M.pending_downloads(files, existing).collect()) == [0, 1, 3]
    assert tuple(M.download_counts(files, existing).first()) == (2, 3, 5)


def test_result_files(spark, tmp_path):
    df = spark.createDataFrame([(i, 0, [-0.5, -1.0]) for i in range(10)], "text_id long, chunk_id long, logprobs array<double>")
    writers.write_results(df.coalesce(1), f"{tmp_path}/r.parquet", max_records=4)
    files = [f for f in os.listdir(tmp_path / "r.parquet") if f.startswith("part-")]
    assert len(files) == 3
    back = R.scan_results(spark, f"{tmp_path}/r.parquet")
    assert dict(back.dtypes) == {"text_id": "int", "chunk_id": "int", "logprobs": "array<float>", "model": "string"}
    assert {r.model for r in back.collect()} == {"r"}
    too_big = spark.createDataFrame([(2**31, 0, [-0.5])], df.schema)
    with pytest.raises(PySparkException):
        writers.write_results(too_big, f"{tmp_path}/bad")


def test_empty_corpus_keeps_its_columns(spark, tmp_path):
    spark.createDataFrame([], "id long, text string").write.parquet(f"{tmp_path}/in")
    out = jobs.chunk_corpus(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert out.columns == list(writers.CHUNKS) and out.count() == 0


def test_chunk_score_and_inspect_jobs(spark, tmp_path):
    rows = [(1, "One two. Three four. Five."), (2, "Alpha beta."), (1, "Repeated id.")]
    spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    chunks = jobs.chunk_corpus(spark, f"{tmp_path}/docs", f"{tmp_path}/chunks", 10, 4)
    assert [r.chunk_text for r in chunks.orderBy("text_id", "chunk_id").collect()] == [
        "One two.", "two.Three four.", "four.Five.", "Alpha beta.",
    ]
    sample = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/chunks/sample_chunks").collect())
    assert sample.startswith("[id=1 | chunk=0]\n⋯full⋯ One two.\n⋯new⋯  One two.\n\n[id=1 | chunk=1]")
    summary = jobs.score_corpus(spark, f"{tmp_path}/chunks/chunked_texts", f"{tmp_path}/scores", WordLengthScorer)
    assert (summary["n_rows"], summary["n_tokens"]) == (4, 3)
    seen = jobs.inspect_results(spark.read.parquet(f"{tmp_path}/scores"))
    assert seen["texts"].first().n_texts == 2 and seen["mean_chunks"].first().mean_chunks == 2.0
    recursive = jobs.chunk_corpus(spark, f"{tmp_path}/docs", f"{tmp_path}/plain", 10, recursive=True)
    assert recursive.columns == list(writers.PLAIN_CHUNKS)
    whole = jobs.score_folder(spark, f"{tmp_path}/docs", "*.parquet", f"{tmp_path}/whole", WordLengthScorer, 4, 2, limit=1, batch=2)
    assert whole["n_rows"] == 2
    assert spark.read.parquet(f"{tmp_path}/whole").columns == list(writers.DOC_RESULTS)


def test_analysis_job(spark, tmp_path):
    models = [f"m{i}" for i in range(5)]
    for i, m in enumerate(models):
        rows = [(t, c, [-(1 + (t * 7 + c * 3 + i * (t % 3)) % 5) / 4.0]) for t in range(8) for c in range(6)]
        writers.write_results(
            spark.createDataFrame(rows, "text_id int, chunk_id int, logprobs array<double>"), f"{tmp_path}/{m}.parquet"
        )
        (tmp_path / f"{m}.csv").write_text("model_response,is_correct\n" + "".join(f"x,{k <= i}\n" for k in range(7)))
    keys = [(t, c) for t in range(8) for c in range(6)]
    chunks = spark.createDataFrame([(t, c, f"{t}-{c}") for t, c in keys], "text_id int, chunk_id int, chunk_text string")
    vectors = spark.createDataFrame([(t, c, [float(t), float(c), 1.0]) for t, c in keys], "text_id int, chunk_id int, embedding array<double>")
    out = jobs.analyse_models(
        spark, [f"{tmp_path}/{m}.parquet" for m in models], [f"{tmp_path}/{m}.csv" for m in models], chunks
    )
    assert out["gamma"].count() == 48 and out["top"].count() == 20 and out["curve"].count() == 48
    assert out["regression"].predictions.count() == 5
    from pplscope.operators.similarity import compare_sets

    assert compare_sets(out["gamma"], vectors, n=10).groupBy("set").count().count() == 2


def test_stream_equals_batch(spark, tmp_path, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id as id", "text")
    inbox, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    docs.repartition(3).write.parquet(inbox)
    incremental_scoring(spark, inbox, out, state, WordLengthScorer, max_files=2)
    first = read_results(spark, out).count()
    docs.selectExpr("id", "concat('Later. ', text) as text").coalesce(1).write.mode("append").parquet(inbox)
    spark.createDataFrame([(10**9, "New one here.")], "id long, text string").write.mode("append").parquet(inbox)
    incremental_scoring(spark, inbox, out, state, WordLengthScorer)
    from pplscope.operators.chunking import chunk_documents
    from pplscope.operators.scoring import score_chunks

    batch = score_chunks(chunk_documents(docs), WordLengthScorer)
    stream = read_results(spark, out)
    assert first == batch.count()
    assert stream.where("text_id < 1000000000").exceptAll(batch).count() == 0
    assert stream.count() == first + 1


def test_scratch_tables_live_in_the_shared_folder(spark):
    table = scratch.materialize(spark.range(3), "t")
    assert table.count() == 3
    assert scratch.app_dir(spark).startswith(scratch.shared_dir(spark))


def test_command_line(spark, tmp_path, capsys):
    from pplscope.__main__ import main

    spark.createDataFrame([(1, "One two. Three four. Five."), (2, "Alpha beta.")], "id long, text string").write.parquet(f"{tmp_path}/d")
    main(["chunk", "--input", f"{tmp_path}/d", "--output", f"{tmp_path}/c", "--chunk-size", "10", "--chunk-overlap", "0"])
    scorer = "pplscope.operators.scoring:WordLengthScorer"
    main(["score", "--dataset", f"{tmp_path}/c/chunked_texts", "--output", f"{tmp_path}/s", "--scorer", scorer])
    main(["inspect", "--parquet", f"{tmp_path}/s"])
    main(["score-folder", "--data-dir", f"{tmp_path}/d", "--output", f"{tmp_path}/w", "--scorer", scorer, "--max-context", "4", "--stride", "2"])
    main(["stream", "--input", f"{tmp_path}/d", "--output", f"{tmp_path}/st", "--checkpoint", f"{tmp_path}/cp", "--scorer", scorer])
    (tmp_path / "list.json").write_text('["http://h/a.bin", "http://h/b.bin"]')
    (tmp_path / "have.txt").write_text("a.bin\n")
    main(["pending", "--manifest", f"{tmp_path}/list.json", "--existing", f"{tmp_path}/have.txt", "--output", f"{tmp_path}/p"])
    assert [r.filename for r in spark.read.json(f"{tmp_path}/p").collect()] == ["b.bin"]
    assert spark.read.parquet(f"{tmp_path}/w").count() == 2
    assert "4 chunks" in capsys.readouterr().out
