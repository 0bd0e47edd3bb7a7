"""Removal of passages that stand in the corpus before: repeated windows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectorloom.functions.binding import let
from vectorloom.llm.common import fresh_name, table, text_key
from vectorloom.session import materialize

WINDOW = 3  # lines of a window
LONG = 50  # words above which one or two lines are a window too
BLANKS = " \t\r\x0b\x0c"
# The white space of Unicode that may part the words of a line.
SPACES = " \t\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in SPACES) + "]+"
WORD = "[^" + SPACE[1:]


def _may_be_odd(text: Column) -> Column:
    """Whether a text can hold words that are not parted by single blanks: false only if it holds
    none of ``SPACES`` but single blanks. Looks for the bytes with which the rare ones begin."""
    raw = text.cast("binary")
    found = F.contains(text, F.lit("  "))
    for space in SPACES[1:]:
        if ord(space) < 128:
            found = found | F.contains(text, F.lit(space))
    heads = sorted({c.encode()[:2] for c in SPACES if ord(c) >= 128})
    rare = F.lit(False)
    for head in heads:
        rare = rare | F.contains(raw, F.lit(head))
    return found | ((F.length(text) != F.octet_length(text)) & rare)


def _words(line: Column, may_be_odd: Column) -> Column:
    """Words of a trimmed line. Where single blanks alone part them they are counted as that."""
    odd = F.contains(line, F.lit("  "))
    for space in SPACES[1:]:
        odd = odd | F.contains(line, F.lit(space))
    parts = F.size(F.filter(F.split(line, SPACE, -1), lambda word: word != ""))
    blanks = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(may_be_odd & odd, parts).otherwise(blanks + 1)


def _windows(text: Column) -> Column:
    """Windows of a text: first and last line (from 0) and two hashes of what they hold."""

    def one(line: Column, number: Column) -> Column:
        trimmed = F.trim(line, F.lit(BLANKS))
        return F.struct(number.alias("at"), trimmed.alias("line"))

    def hashed(x: Column, may_be_odd: Column) -> Column:
        return F.struct(
            x["at"].alias("at"),
            F.xxhash64(x["line"]).alias("a"),
            F.xxhash64(F.lit(1), x["line"]).alias("b"),
            _words(x["line"], may_be_odd).alias("words"),
        )

    def of(lines: Column) -> Column:
        def window(start: Column, size: int) -> Column:
            held = [F.get(lines, start + k) for k in range(size)]
            words = sum((h["words"] for h in held[1:]), held[0]["words"])
            fits = start + size <= F.size(lines)
            return F.when(
                fits if size == WINDOW else fits & (words > LONG),
                F.struct(
                    held[0]["at"].alias("first"),
                    held[-1]["at"].alias("last"),
                    F.xxhash64(F.lit(size), *[h["a"] for h in held]).alias("a"),
                    F.xxhash64(F.lit(size), *[h["b"] for h in held]).alias("b"),
                ),
            )

        starts = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1))
        each = F.transform(starts, lambda s: F.array(*[window(s, k) for k in range(1, WINDOW + 1)]))
        return F.filter(F.flatten(each), lambda w: w.isNotNull())

    lines = F.filter(F.transform(F.split(text, "\n", -1), one), lambda x: x["line"] != "")
    return let(_may_be_odd(text), lambda odd: let(F.transform(lines, lambda x: hashed(x, odd)), of))


def repeated_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, key, lines)``: the lines of each document that a later occurrence covers.

    Windows are three consecutive lines that are not blank, and one or two such lines of more
    than 50 words, whatever white space parts them. Occurrences are ordered by id (null last), text key and line; all but the
    first are later ones. Rows of equal id and text are one document here.
    """
    found = docs.select(
        F.col(id_col).cast("long").alias("id"),
        text_key(F.col(text_col)).alias("key"),
        F.inline(_windows(F.col(text_col))),
    )
    found = materialize(found, "windows")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "first")
    again = found.groupBy("a", "b").agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1")
    later = found.join(again.select("a", "b", "origin"), ["a", "b"]).filter(place > F.col("origin"))
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last"))))
    return later.groupBy("id", "key").agg(covered.alias("lines"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None
) -> DataFrame:
    """``docs`` with the lines of repeated windows taken out of ``text_col``; the first
    occurrence in the corpus stays.

    Every row and column is kept, texts without repeats unchanged. Covered lines are merged
    per document, so overlapping windows take a line out once. A passage that overlaps
    itself (the same line over and over) keeps the lines before its second occurrence. Lines
    are compared without blanks at their ends; blank lines are no part of a window, and go
    only where they stand inside one. A null text stays null, a text of repeated windows
    alone becomes empty. ``removed_col``, if given, holds the number of lines taken out.

    No text is shuffled to find repeats: hashes and line numbers are; a window that a third
    of the documents share is combined before its shuffle and its join is split where it is
    hot. Texts move once, by id, to meet their line numbers.
    """
    marks = repeated_windows(docs, id_col, text_col).select(
        F.col("id").isNull().alias("_none"), F.coalesce("id", F.lit(0)).alias("_id"), F.col("key").alias("_key"), "lines"
    )
    lines = fresh_name(docs, "_lines")
    left, right = docs.alias("d"), marks.withColumnRenamed("lines", lines).hint("shuffle_hash").alias("m")
    id_ = F.col(f"d.`{id_col}`").cast("long")
    on = (
        (id_.isNull() == F.col("m._none"))
        & (F.coalesce(id_, F.lit(0)) == F.col("m._id"))
        & (text_key(F.col(f"d.`{text_col}`")) == F.col("m._key"))
    )
    text = F.col(f"d.`{text_col}`")
    rest = let(
        F.split(text, "\n", -1),
        lambda all_: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(lines)), lambda at: F.get(all_, at)
            ),
            "\n",
        ),
    )
    kept = F.when(F.col(lines).isNull(), text).otherwise(rest)
    columns = [kept.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    if removed_col:
        columns.append(F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(removed_col))
    return left.join(right, on, "left").select(*columns)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, removed_col="n_removed").select("doc_id", "n_removed", "text")


OP5_SQL = rf"""
WITH lines AS (
  SELECT doc_id, pos, trim(line, E' \t\r\x0b\x0c') AS line FROM (
    SELECT doc_id, unnest(string_split(text, E'\n')) AS line,
           generate_subscripts(string_split(text, E'\n'), 1) - 1 AS pos FROM documents)
), solid AS (
  SELECT *, len(regexp_extract_all(line, '{WORD}')) AS words,
         len(regexp_extract_all(lead(line, 1) OVER w, '{WORD}')) AS words2,
         lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3,
         lead(pos, 1) OVER w AS at2, lead(pos, 2) OVER w AS at3
  FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), windows AS (
  SELECT doc_id, pos AS first, at3 AS last, ['3', line, line2, line3] AS held FROM solid WHERE line3 IS NOT NULL
  UNION ALL
  SELECT doc_id, pos, at2, ['2', line, line2] FROM solid
  WHERE line2 IS NOT NULL AND words + words2 > 50
  UNION ALL
  SELECT doc_id, pos, pos, ['1', line] FROM solid WHERE words > 50
), later AS (
  SELECT doc_id, first, last FROM (
    SELECT *, row_number() OVER (PARTITION BY held ORDER BY doc_id, first) AS k FROM windows) WHERE k > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM later
), kept AS (
  SELECT l.doc_id, string_agg(raw, E'\n' ORDER BY l.pos) AS text, count(*) AS n FROM (
    SELECT doc_id, unnest(string_split(text, E'\n')) AS raw,
           generate_subscripts(string_split(text, E'\n'), 1) - 1 AS pos FROM documents) l
  ANTI JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
)
SELECT d.doc_id, (SELECT count(*) FROM covered c WHERE c.doc_id = d.doc_id) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
