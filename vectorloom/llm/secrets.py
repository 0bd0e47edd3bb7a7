"""Secret scans over versioned texts, with a ledger of blobs and rules already scanned."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectorloom.llm.common import arrow_schema, arrow_stage, table
from vectorloom.session import materialize, scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern of secrets. ``version`` changes whenever the pattern or its check does."""

    kind: str
    version: int
    pattern: str
    least: int  # characters that ``group`` has at least; shorter matches are dropped
    group: int = 0
    any_case: bool = False


# The three kinds, their patterns and their least lengths.
RULES: tuple[Rule, ...] = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, r"[0-9a-f]+", 24),
)

BLOB = "blob binary, text string"
FINDINGS = "blob binary, kind string, version int, spans array<struct<start:int,end:int>>"
LEDGER = "blob binary, kind string, version int, spans array<struct<start:int,end:int>>"


def matcher(rule: Rule) -> re.Pattern[str]:
    """The compiled pattern. Runs of one class that are too short are skipped by the engine."""
    pattern = rule.pattern
    if rule.group == 0 and pattern.endswith("]+") and pattern.startswith("["):
        pattern = f"{pattern[:-1]}{{{rule.least},}}"
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


def spans(text: str, rule: Rule, pattern: re.Pattern[str]) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap, those of enough characters; in code points."""
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan(rules: Sequence[Rule]):
    target = arrow_schema(FINDINGS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {(r.kind, r.version): (r, matcher(r)) for r in rules}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                blobs, kinds, versions, found = [], [], [], []
                for blob, text, wanted in zip(*(part.column(k).to_pylist() for k in range(3))):
                    for pair in wanted:
                        rule, pattern = patterns[(pair["kind"], pair["version"])]
                        blobs.append(blob)
                        kinds.append(rule.kind)
                        versions.append(rule.version)
                        found.append([{"start": a, "end": b} for a, b in spans(text, rule, pattern)])
                columns = [pa.array(v, f.type) for v, f in zip((blobs, kinds, versions, found), target)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return run


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")


def read_ledger(spark: SparkSession, ledger: str | None) -> DataFrame:
    """All scanned pairs of blob and rule version with their spans; none if there is no ledger."""
    return spark.createDataFrame([], LEDGER) if ledger is None else spark.read.schema(LEDGER).parquet(ledger)


def scan_unseen(
    versions: DataFrame, text_col: str, ledger: str | None, into: str, rules: Sequence[Rule] = RULES
) -> None:
    """Scan each distinct text for the rule versions that the ledger lacks, and write the
    findings, empty ones included, to ``into`` in the ledger's form.

    A text is addressed by the SHA-256 of its UTF-8 bytes; null counts as empty. Only addresses
    meet the ledger; texts are looked up for those that it lacks, which Spark broadcasts while
    they are few, so that seen texts are hashed and never moved. Equal texts meet before they
    move, so a group of copies is one blob in every task and one scan in all.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))
    every = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        wanted = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("wanted", every)
    else:
        seen = read_ledger(spark, ledger).groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        left = F.filter(every, lambda p: ~F.array_contains(F.coalesce("seen", F.array().cast(seen.schema["seen"].dataType)), p))
        missing = blobs.select("blob").distinct().join(seen, "blob", "left").withColumn("wanted", left)
        missing = materialize(missing.filter(F.size("wanted") > 0).select("blob", "wanted"), "unseen")
        wanted = blobs.join(missing, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    arrow_stage(wanted.select("blob", "text", "wanted"), _scan(rules), FINDINGS).write.mode("append").parquet(into)


def findings_by_path(
    versions: DataFrame, keys: Sequence[str], text_col: str, ledger: str, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """``keys`` of every version with ``found``: kind, start and end of each secret, ordered
    by start and then as the rules are listed. One row per row of ``versions``."""
    order = {r.kind: k for k, r in enumerate(rules)}
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    place = F.create_map(*[x for k, n in order.items() for x in (F.lit(k), F.lit(n))])
    rows = read_ledger(versions.sparkSession, ledger).filter(F.col("version") == current[F.col("kind")])
    rows = rows.filter(F.size("spans") > 0).groupBy("blob", "kind").agg(F.max("spans").alias("spans"))
    each = F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), place[F.col("kind")].alias("place"), F.col("kind").alias("kind"), s["end"].alias("end"))
    )
    by_blob = rows.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(each))).alias("found"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = versions.select(*keys, F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
    joined = paths.join(by_blob, "blob", "left")
    none = F.array().cast(by_blob.schema["found"].dataType)
    return joined.select(*keys, F.coalesce("found", none).alias("found"))


def scan(versions: DataFrame, keys: Sequence[str], text_col: str, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``versions`` and give the findings of every path.

    ``ledger`` is a folder of Parquet files that every run appends to: a second run over the
    same texts scans nothing, a rule of a new version is the only one scanned again. A run
    that fails leaves the ledger as it was. Every version of a path is a row of ``versions``;
    null and repeated keys keep their rows. Two runs at the same time may scan a blob twice,
    which changes no result.
    """
    known = _exists(versions.sparkSession, ledger)
    scan_unseen(versions, text_col, ledger if known else None, ledger, rules)
    return findings_by_path(versions, keys, text_col, ledger, rules)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, in two deliveries to a ledger that starts empty: first the
    documents of the most frequent source, then all, of which only unseen ones are scanned."""
    docs, ledger = table(spark, sf_dir, "documents"), scratch_path(spark, "ledger")
    largest = docs.groupBy("source").count().orderBy(F.desc("count"), "source").first()
    if largest is not None:
        scan_unseen(docs.filter(F.col("source").eqNullSafe(F.lit(largest["source"]))), "text", None, ledger)
    found = scan(docs, ["doc_id"], "text", ledger)
    listed = F.array_join(
        F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(r.kind) for r in RULES]
    return found.select(
        "doc_id", *counts, F.sha2(listed.cast("binary"), 256).alias("base_sha256"), listed.alias("spans")
    )
