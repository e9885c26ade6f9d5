"""Command line: python -m pplscope <chunk|score|score-folder|inspect|analyse|pending|stream> …

Run it with spark-submit on a cluster; every command is one job of `pplscope.plans`.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import functions as F

from pplscope import scratch
from pplscope.plans import jobs
from pplscope.session import build_session
from pplscope.sinks import writers
from pplscope.sources.manifest import download_counts, manifest_from_json, pending_downloads
from pplscope.streaming.incremental import incremental_scoring


def factory(name: str):
    """`package.module:callable`, the factory that builds a scorer on an executor."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def mapping(text: str) -> dict[str, str]:
    """A JSON object of strings."""
    found = json.loads(text)
    if not isinstance(found, dict) or not all(isinstance(v, str) for v in found.values()):
        raise argparse.ArgumentTypeError("a JSON object of strings is needed")
    return found


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pplscope")
    top.add_argument("--master", default=None)
    top.add_argument("--overwrite", action="store_true", help="replace existing output")
    commands = top.add_subparsers(dest="command", required=True)

    p = commands.add_parser("chunk", help="documents to overlapping chunks")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--chunk-size", type=int, default=500)
    p.add_argument("--chunk-overlap", type=int, default=100)
    p.add_argument("--recursive", action="store_true", help="split by separators instead of sentences")
    p.add_argument("--partitions", type=int, default=None, help="deal the documents out that many ways, whatever row groups they have")
    p.add_argument("--learned-sentences", action="store_true", help="learn abbreviations from the documents")

    p = commands.add_parser("score", help="chunks to log-probs")
    p.add_argument("--dataset", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--scorer", type=factory, required=True)
    p.add_argument("--prompt-column", default="chunk_text")
    p.add_argument("--debug-limit", type=int, default=0)
    p.add_argument("--partitions", type=int, default=None)
    p.add_argument("--max-records-per-file", type=int, default=None)

    p = commands.add_parser("score-folder", help="whole documents to log-probs, in token windows")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--file-pattern", default="*.parquet")
    p.add_argument("--output", required=True)
    p.add_argument("--scorer", type=factory, required=True)
    p.add_argument("--max-context", type=int, required=True)
    p.add_argument("--stride", type=int, default=2048)
    p.add_argument("--batch-size", type=int, default=4)
    p.add_argument("--limit-docs", type=int, default=None)
    p.add_argument("--exact-limit", action="store_true")
    p.add_argument("--stitch", choices=["fresh", "concat"], default="fresh")
    p.add_argument("--partitions", type=int, default=None)

    p = commands.add_parser("inspect", help="statistics of a result table")
    p.add_argument("--parquet", required=True)

    p = commands.add_parser("analyse", help="results and responses to scores, selections and regression")
    p.add_argument("--results", nargs="+", required=True)
    p.add_argument("--responses", nargs="+", required=True)
    p.add_argument("--chunks", required=True)
    p.add_argument("--embeddings", default=None)
    p.add_argument("--encoder", type=factory, default=None, help="embeds the selected texts where no embeddings are given")
    p.add_argument("--model-map", type=mapping, default=None, help="JSON object: result file name to model")
    p.add_argument("--response-map", type=mapping, default=None, help="JSON object: response file name to model")
    p.add_argument("--output", required=True)
    p.add_argument("--seed", default="0")

    p = commands.add_parser("pending", help="listed URLs without a file yet")
    p.add_argument("--manifest", required=True, help="JSON list of URLs")
    p.add_argument("--existing", required=True, help="text file or folder with one present file name per line")
    p.add_argument("--output", required=True)

    p = commands.add_parser("stream", help="score the document files that arrived since the last call")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--scorer", type=factory, required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(master=args.master)
    mode = "overwrite" if args.overwrite else "errorifexists"
    if args.command == "chunk":
        chunks = jobs.chunk_corpus(
            spark, args.input, args.output, args.chunk_size, args.chunk_overlap, args.recursive, mode, args.partitions,
            args.learned_sentences,
        )
        print(f"{chunks.count()} chunks in {args.output}")
    elif args.command == "score":
        print(jobs.score_corpus(
            spark, args.dataset, args.output, args.scorer, args.prompt_column, args.debug_limit, args.partitions,
            args.max_records_per_file, mode,
        ))
    elif args.command == "score-folder":
        print(jobs.score_folder(
            spark, args.data_dir, args.file_pattern, args.output, args.scorer, args.max_context, args.stride,
            args.limit_docs, args.batch_size, args.exact_limit, args.stitch, mode, args.partitions,
        ))
    elif args.command == "inspect":
        for title, table in jobs.inspect_results(spark.read.parquet(args.parquet)).items():
            print(title)
            table.show(truncate=False)
    elif args.command == "analyse":
        embeddings = spark.read.parquet(args.embeddings) if args.embeddings else None
        out = jobs.analyse_models(
            spark, args.results, args.responses, spark.read.parquet(args.chunks), embeddings, args.model_map, args.seed,
            args.response_map, args.encoder,
        )
        fit = out.pop("regression")
        out["predictions"], out["coefficients"] = fit.predictions, fit.coefficients.withColumn("alpha", F.lit(fit.alpha))
        for name, table in out.items():
            table.write.mode(mode).parquet(f"{args.output}/{name}")
        writers.write_top_report(spark.read.parquet(f"{args.output}/top"), f"{args.output}/top_report", "chunk_id", mode)
    elif args.command == "pending":
        files = manifest_from_json(spark.read.text(args.manifest, wholetext=True))
        existing = spark.read.text(args.existing).select(F.col("value").alias("filename"))
        pending_downloads(files, existing).write.mode(mode).json(args.output)
        download_counts(files, existing).show()
    elif args.command == "stream":
        incremental_scoring(spark, args.input, args.output, args.checkpoint, args.scorer)
    scratch.release(spark)  # all results are written


if __name__ == "__main__":
    main()
