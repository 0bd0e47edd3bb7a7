import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from vectorloom.functions import fit_text, kept_tokens, tokenize, truncate_tokens

CASES = {
    "fits": ([8, 31, 32, 9], 4, [8], [9], [8, 31, 32, 9]),
    "both specials": ([8, *range(40, 60), 9], 7, [8], [9], [8, 40, 41, 42, 43, 44, 9]),
    "suffix only": ([*range(70, 95), 9], 3, [], [9], [70, 71, 9]),
    "much too long": ([8, *range(1000, 9000), 9], 300, [8], [9], [8, *range(1000, 1298), 9]),
    "limit below specials": ([2, 5, 6, 1], 1, [2], [1], [2, 1]),
    "prefix absent": ([7, 8, 9, 1], 3, [2], [1], [7, 8, 1]),
    "no specials": ([7, 8, 9], 2, [], [], [7, 8]),
    "overlapping specials": ([1], 0, [1], [1], [1, 1]),
    "shorter than suffix": ([5], 0, [], [5, 6], []),
    "empty": ([], 3, [2], [1], []),
    "longer specials": ([1, 2, 7, 8, 9, 3, 4], 5, [1, 2], [3, 4], [1, 2, 7, 3, 4]),
}
SCHEMA = "name string, t array<int>, l int, p array<int>, s array<int>, expected array<int>"


def _cut(df):
    return df.withColumn("cut", truncate_tokens(F.col("t"), F.col("l"), F.col("p"), F.col("s")))


def test_truncate_cases(spark):
    df = spark.createDataFrame([(k, *v) for k, v in CASES.items()], SCHEMA)
    for row in _cut(df).collect():
        assert row.cut == row.expected, row.name


small_ints = st.lists(st.integers(1, 3), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            small_ints, st.integers(0, 9), st.lists(st.integers(1, 3), max_size=2), st.lists(st.integers(1, 3), max_size=2)
        ),
        min_size=20,
        max_size=60,
    )
)
def test_truncate_random(spark, rows):
    df = spark.createDataFrame([("", *r, None) for r in rows], SCHEMA)
    for r in _cut(df).collect():
        case = (r.t, r.l, r.p, r.s, r.cut)
        if len(r.t) <= r.l:
            assert r.cut == r.t, case
            continue
        text = "".join(map(str, r.t))
        prefix, suffix = "".join(map(str, r.p)), "".join(map(str, r.s))
        kept = "".join(map(str, r.cut))
        opens, closes = text.startswith(prefix), text.endswith(suffix)
        specials = len(prefix) * opens + len(suffix) * closes
        assert len(kept) == max(r.l, specials), case
        assert kept.startswith(prefix) or not opens, case
        assert kept.endswith(suffix) or not closes, case
        front = kept[: len(kept) - len(suffix) * closes]
        assert text.startswith(front), case


def test_tokenize_and_kept(spark):
    df = spark.createDataFrame([("  a\tb \n c  ",), ("",), (" ",)], "text string")
    got = [r[0] for r in df.select(tokenize(F.col("text"))).collect()]
    assert got == [["a", "b", "c"], [], []]
    one = spark.range(1)
    n = lambda *a: one.select(kept_tokens(*[F.lit(x) for x in a])).first()[0]
    assert (n(5, 7, 2), n(7, 7, 2), n(8, 7, 2), n(8, 1, 2)) == (5, 7, 7, 2)


@pytest.mark.parametrize("limit,special", [(5, 2), (3, 0), (1, 2)])
def test_fit_text(spark, limit, special):
    texts = ["a b c", "a  b", "one two three four five", "x" * 50, "a b c d e f g h", " lead and trail  ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    room = max(0, limit - special)
    for text, fitted in df.select("text", fit_text(F.col("text"), F.lit(limit), F.lit(special))).collect():
        if len(text.split()) <= room:
            assert fitted == text
        else:
            assert fitted == " ".join(text.split()[:room])
