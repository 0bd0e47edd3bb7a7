"""Jobs for the command line: ``spark-submit ... -m vectorloom`` or ``python -m vectorloom``.

``requests`` answers JSON request lines, once or as a stream; ``texts`` brings a vector table
up to date with a text table. ``--encoder package.module:factory`` names the encoder factory;
without it the hashing stand-in runs.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from vectorloom.encoders import EncoderFactory
from vectorloom.operators.provenance import canonical_builds
from vectorloom.operators.embedding import ROW_BYTES
from vectorloom.operators.requests import split_by_size
from vectorloom.plans.bulk import embed_request_texts, embed_requests
from vectorloom.plans.refresh import refresh
from vectorloom.registry import DEFAULT_DIMENSIONS, REGISTRY, TASKS, parse_active
from vectorloom.sources.requests import parse_requests
from vectorloom.session import drop_scratch
from vectorloom.sources.sinks import write_errors, write_outcomes, write_response_parts
from vectorloom.sources.texts import read_texts
from vectorloom.streaming.jobs import embed_stream_with_dead_letters


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="vectorloom")
    jobs = parser.add_subparsers(dest="job", required=True)

    requests = jobs.add_parser("requests", help="answer JSON request lines")
    requests.add_argument("--input", required=True)
    requests.add_argument("--output", required=True, help="gets responses/ and errors/, or the stream's tables")
    requests.add_argument("--model", help="model of all lines, if they do not name their own")
    requests.add_argument("--task", choices=TASKS, help="task of all lines")
    requests.add_argument("--checkpoint", help="run as a stream with this checkpoint folder")
    requests.add_argument("--max-files", type=int, default=64, help="files that a stream's batch takes in at most")
    requests.add_argument("--max-bytes", type=int, help="bytes instead of files")
    requests.add_argument("--join-output", action="store_true", help="add to the output of other streams")
    requests.add_argument("--every", help="stream interval; without it the stream ends when caught up")

    texts = jobs.add_parser("texts", help="embed the texts that have no current vector")
    texts.add_argument("--input", required=True)
    texts.add_argument("--id", required=True)
    texts.add_argument("--text", required=True)
    texts.add_argument("--output", required=True)
    texts.add_argument("--errors", required=True)
    texts.add_argument("--model", required=True)
    texts.add_argument("--task", choices=TASKS, default="document")
    texts.add_argument("--dimensions", type=int, default=DEFAULT_DIMENSIONS)

    for job in (requests, texts):
        job.add_argument("--models", default=",".join(m.key for m in REGISTRY), help="active models")
        job.add_argument("--build", action="append", default=[], metavar="MODEL=FILE")
        job.add_argument("--qwen-quant", default="", help="quantisation; wins over --build qwen=...")
        job.add_argument("--encoder", metavar="MODULE:FACTORY")
        job.add_argument("--own-tokens", action="store_true", help="the encoder truncates by itself")
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("vectorloom").getOrCreate()
    active = parse_active(args.models)
    builds = _builds(spark, args.build, args.qwen_quant)
    options = {"factory": _factory(args.encoder), "truncate": not args.own_tokens}
    if args.job == "texts":
        if args.model not in active:
            raise SystemExit(f"model {args.model!r} is not among the active models {active}")
        failed = refresh(
            read_texts(spark, args.input, args.id, args.text), args.output, args.model, args.task,
            args.dimensions, build=builds.get(args.model), **options,
        )
        failed.write.mode("append").parquet(args.errors)
        drop_scratch(spark)
        return
    options |= {"active": active, "overrides": builds}
    route = {"model": args.model, "task": args.task}

    def parsed(lines: DataFrame) -> DataFrame:
        return parse_requests(lines, **route)

    if args.checkpoint:
        limit = ("maxBytesPerTrigger", args.max_bytes) if args.max_bytes else ("maxFilesPerTrigger", args.max_files)
        embed_stream_with_dead_letters(
            parsed(spark.readStream.option(*limit).text(args.input)), args.output, args.checkpoint,
            every=args.every, join_output=args.join_output, **options,
        ).awaitTermination()
    else:
        usual, large = split_by_size(parsed(spark.read.text(args.input)), ROW_BYTES)
        write_outcomes(embed_requests(usual, **options), f"{args.output}/responses", f"{args.output}/errors")
        if not large.isEmpty():
            failures, vectors = embed_request_texts(large, **options)
            write_response_parts(vectors, f"{args.output}/responses")
            write_errors(failures, f"{args.output}/errors")
    drop_scratch(spark)


def _factory(name: str | None) -> EncoderFactory | None:
    if name is None:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _builds(spark: SparkSession, given: list[str], quant: str) -> dict[str, str]:
    """Build overrides per model from ``MODEL=FILE`` entries and a quantisation name."""
    builds = dict(entry.split("=", 1) for entry in given)
    if quant:
        chosen = canonical_builds(spark.range(1), F.lit(quant), F.lit(builds.get("qwen", ""))).first()
        if chosen.build_error:
            raise SystemExit(chosen.build_error)
        builds["qwen"] = chosen.build
    return builds


if __name__ == "__main__":
    main()
