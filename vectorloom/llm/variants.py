"""Spelling variants grouped under their most frequent form: a bit-sliced position index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectorloom.llm.common import arrow_stage, table
from vectorloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "([a-zÀ-ÿ]+)"  # maximal runs of letters, once A-Z are lower-cased
DAMAGE = 97  # a run whose checksum this divides loses a code point
LEAST_LETTERS = 5
LEAST_COUNT = 3
FORM_FACTOR = 2  # a form is at least so many times as frequent as its variant
BLOCK = 4096  # words of one index; larger groups have several


# --- words and their counts -----------------------------------------------------------


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, damage: int = DAMAGE,
    least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``(word, n)``: the runs of letters of all texts, a few of them damaged by rule.

    Let h be the CRC-32 of ``<id>:<run>``. If ``damage`` divides h, the run loses its code point
    h modulo its length. Null texts have no runs; a null id counts as an empty string. Counts
    are combined within tasks before their shuffle, so a frequent word costs what any other does.
    """
    text = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(1))).alias("run"),
    )
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    left = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % damage == 0, left).otherwise(F.col("run")).alias("word"))
    words = words.where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# --- the index ------------------------------------------------------------------------


class PositionIndex:
    """Per position and letter the set of words that have it there, one bit a word.

    All words have ``length`` or ``length + 1`` code points. A query of ``length`` code points is
    compared with all of them at once.
    """

    def __init__(self, words: list[str], length: int):
        self.words, self.length = words, length
        self.places: list[dict[str, int]] = [{} for _ in range(length + 1)]
        self.same = self.longer = 0
        for k, word in enumerate(words):
            bit = 1 << k
            if len(word) == length:
                self.same |= bit
            else:
                self.longer |= bit
            for letters, letter in zip(self.places, word):
                letters[letter] = letters.get(letter, 0) | bit

    def near(self, query: str, cut: int) -> tuple[int, int, int]:
        """The words that replace one code point of ``query``, those that insert one, and those
        that share its first ``cut`` code points.

        After i code points, ``zero`` holds the words that agree so far, ``replaced`` those with
        one other code point, ``inserted`` those with one more, whose positions are shifted.
        """
        zero = shared = self.same | self.longer
        replaced = inserted = 0
        for k, letter in enumerate(query):
            here = self.places[k].get(letter, 0)
            inserted = (inserted | zero) & self.places[k + 1].get(letter, 0)
            replaced = (replaced & here) | (zero & ~here)
            zero &= here
            if k + 1 == cut:
                shared = zero
            if not (zero or replaced or inserted):
                break
        return replaced & self.same, (inserted | zero) & self.longer, shared

    def members(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low


def _halves(word: Column) -> Column:
    """The groups in which a word meets its near words.

    Of two words one edit apart, the shorter (either, if they are of one length) has m code
    points, and they share their first m // 2 code points or the last m - m // 2. So a
    word of m or m + 1 code points is in the groups of both halves for that m.
    """
    def of(length: Column) -> list[Column]:
        head = F.floor(length / 2).cast("int")
        tail = length - head
        return [
            F.struct(
                length.alias("m"), F.lit(side).alias("side"),
                F.xxhash64(length, F.lit(side), F.substring(word, start, size)).alias("key"),
            )
            for side, start, size in ((0, F.lit(1), head), (1, F.length(word) - tail + 1, tail))
        ]

    return F.array(*of(F.length(word)), *of(F.length(word) - 1))


def _near_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[str, str, int]] = []

    def flush() -> pa.RecordBatch:
        word, near, n = zip(*out) if out else ((), (), ())
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"]
        )

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    for (_, _, length, side), group in groupby(rows(), key=lambda r: r[:4]):
        words, counts = [], []
        index = None
        cut = length // 2

        def ask(word: str, n: int) -> None:
            replaced, inserted, shared = index.near(word, cut)
            # pairs that share both halves' hashes are those of the first group alone
            wanted = ~shared if side else shared
            for k in index.members(replaced & wanted):
                out.append((word, words[k], counts[k]))
            for k in index.members(inserted & wanted):
                out.append((word, words[k], counts[k]))
                out.append((words[k], word, n))

        for _, _, _, _, asks, word, n in group:
            if not asks:  # a member, they come first
                words.append(word)
                counts.append(n)
                continue
            if index is None:
                index = PositionIndex(words, length)
                for w, c in zip(words, counts):
                    if len(w) == length:
                        ask(w, c)
            ask(word, n)
            if len(out) >= 20_000:
                yield flush()
        if index is None and len(words) > 1:
            index = PositionIndex(words, length)
            for w, c in zip(words, counts):
                if len(w) == length:
                    ask(w, c)
                    if len(out) >= 20_000:
                        yield flush()
    yield flush()


def near_words(words: DataFrame, block: int = BLOCK, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """``(word, near, near_n)``: every word with every word that one inserted, deleted or replaced
    code point makes of it, once. ``words(word, n)`` are distinct.

    The vocabulary is divided into groups of words that share half of their code points; a group
    of more than ``block`` words is divided by a hash, and its words are asked of each part. So
    an index has about ``block`` words at any size of the vocabulary, and no pair is lost.
    """
    keyed = words.select("word", "n", F.inline(_halves(F.col("word")))).where(F.col("m") >= least_letters)
    keyed = materialize(keyed, "halves")
    sizes = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.length("word") - F.col("m")).alias("least")
    ).where("size > 1 and least = 0")  # without a word of m code points there is no query
    grouped = keyed.join(sizes, "key")
    parts = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    # a member of its own part; asked of the others too if it has m code points
    asked = F.when(F.length("word") == F.col("m"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    dealt = grouped.withColumn("own", own).select(
        "key", F.explode(asked).alias("part"), "m", "side", "own", "word", "n"
    ).select("key", "part", "m", "side", (F.col("part") != F.col("own")).cast("int").alias("asks"), "word", "n")
    ordered = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "m", "side", "asks")
    return arrow_stage(ordered, _near_pairs, "word string, near string, near_n long")


# --- forms ----------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` to ``(word, root)``: the end of each chain of forms.

    Pointers double their reach in each round. A form is at least twice as frequent as its
    variant, so a chain has at most 63 links and six rounds reach its end.
    """
    current = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = current.join(ahead, "root", "left")
        current = materialize(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not current.where("moved").isEmpty()
        current = current.select("word", "root")
        if not moved:
            return current


def group_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block: int = BLOCK,
    damage: int = DAMAGE, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of :func:`word_counts`.

    A word's form is its near word of largest count (ties: the smallest in code-point order) if
    that is at least twice the word's own; its root is the last of the chain of forms, itself if
    it has none. Only ids and texts are read: other columns of any name make no difference.
    Repeated rows count each time, null and empty texts have no words, an empty table gives none.
    """
    words = materialize(
        word_counts(docs, id_col, text_col, damage=damage, least_letters=least_letters, least_count=least_count), "words"
    )
    best = near_words(words, block, least_letters).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    most = -F.col("best.minus")
    fits = most >= FORM_FACTOR * F.col("n")
    found = materialize(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(fits, F.col("best.near")).alias("form"), F.when(fits, most).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root."""
    return group_variants(table(spark, sf_dir, "documents"))


# CRC-32 is linear: each byte adds a value of its own by its distance from the end, which
# ``spread`` holds; ``start`` holds what the initial value adds for each length.
OP11_SQL = r"""
WITH RECURSIVE step AS (
  SELECT b, 0 AS k, b::BIGINT AS v FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
), base AS MATERIALIZED (
  SELECT b, v FROM step WHERE k = 8
), found AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), runs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, run, concat(coalesce(doc_id::VARCHAR, ''), ':', run) AS full_text, count(*) AS n
  FROM found GROUP BY doc_id, run
), letters AS MATERIALIZED (
  SELECT r, generate_subscripts(string_split(full_text, ''), 1) AS i, unicode(unnest(string_split(full_text, ''))) AS c FROM runs
), bytes AS MATERIALIZED (
  SELECT r, b, row_number() OVER (PARTITION BY r ORDER BY i DESC, part DESC) - 1 AS from_end FROM (
    SELECT r, i, 0 AS part, CASE WHEN c < 128 THEN c ELSE 192 + (c >> 6) END AS b FROM letters
    UNION ALL
    SELECT r, i, 1, 128 + (c & 63) FROM letters WHERE c >= 128)
), longest AS (
  SELECT max(from_end) + 1 AS n FROM bytes
), spread AS (
  SELECT b, 0 AS d, v FROM base
  UNION ALL
  SELECT s.b, s.d + 1, xor(s.v >> 8, t.v) FROM spread s JOIN base t ON t.b = s.v & 255 WHERE s.d < (SELECT n FROM longest)
), start AS (
  SELECT 0 AS d, 4294967295::BIGINT AS v
  UNION ALL
  SELECT s.d + 1, xor(s.v >> 8, t.v) FROM start s JOIN base t ON t.b = s.v & 255 WHERE s.d < (SELECT n FROM longest)
), sums AS (
  SELECT y.r, bit_xor(s.v) AS v, count(*) AS size FROM bytes y JOIN spread s ON s.b = y.b AND s.d = y.from_end GROUP BY y.r
), hashed AS MATERIALIZED (
  SELECT u.r, xor(xor(u.v, z.v), 4294967295) AS h FROM sums u JOIN start z ON z.d = u.size
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n
    FROM runs JOIN hashed USING (r))
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS MATERIALIZED (
  SELECT word, n, p, concat(left(word, p - 1), substr(word, p + 1)) AS rest FROM (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), near AS (
  SELECT DISTINCT word, near, near_n FROM (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
    UNION ALL
    SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION ALL
    SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word)
), best AS (
  SELECT word, n_near, near, near_n FROM (
    SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k FROM near) WHERE k = 1
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS at, form AS ahead FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.ahead
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word AND c.ahead IS NULL
"""
