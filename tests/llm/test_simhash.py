import numpy as np
import xxhash
from pyspark.sql import functions as F

from vectorloom.llm.components import connected_components
from vectorloom.llm.simhash import drop_near_duplicates, fingerprint, links, near_duplicates, op6_simhash, plan_parts

SCHEMA = "doc_id long, text string, key string, mark int"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [words[i : i + 4] for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(marks):
    parent = {m: m for m in marks}

    def find(m):
        while parent[m] != m:
            m = parent[m]
        return m

    values = list(marks)
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= 4:
                parent[find(a)] = find(b)
    return {m: find(m) for m in marks}


def expected(rows):
    marks = [slow_fingerprint(t) for _, t in rows]
    group = slow_groups(set(marks))
    least = {}
    for (i, _), m in zip(rows, marks):
        if i is not None:
            least[group[m]] = min(least.get(group[m], i), i)
    return sorted((repr(i), m, least.get(group[m])) for (i, _), m in zip(rows, marks))


def got(frame):
    return sorted((repr(r.id), r.mark % (1 << 64), r.component) for r in frame.collect())


def test_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    frame = op6_simhash(spark, small)
    mine = sorted((repr(r.doc_id), int(r.fingerprint, 16), r.component_id) for r in frame.collect())
    assert mine == expected(rows)


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    rows = [
        (5, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (None, None), (7, ""), (6, " \t\n"),
        (8, "ONE"), (9, "one"), (10, "É x"), (11, long), (12, long + " end"), (None, "only null ids here at all"),
    ]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA)
    assert got(near_duplicates(docs)) == expected(rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([4, 6, 8, 10, 11, None], key=repr)
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0


def test_fingerprint_is_the_hash_spark_knows(spark):
    text = "alpha beta gamma delta"
    row = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()
    assert fingerprint(text.encode()) == row.h % (1 << 64)


def test_links_cross_blocks_and_every_threshold(spark):
    random = np.random.default_rng(1)
    base = random.integers(0, 1 << 63, 30, dtype=np.uint64)
    values = set(base.tolist())
    for b in base.tolist():
        for flips in (1, 2, 3, 4, 5):
            values.add(b ^ sum(1 << int(k) for k in random.choice(64, flips, replace=False)))
    marks = np.array(sorted(values), np.uint64)
    frame = spark.createDataFrame([(int(m),) for m in marks.view(np.int64)], "mark long")
    want = slow_groups(set(marks.tolist()))
    for block in (4096, 3):
        roots = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(links(frame, block=block)).collect()}
        mine = {}
        for m in marks.tolist():
            mine.setdefault(roots.get(m, m), set()).add(m)
        theirs = {}
        for m in marks.tolist():
            theirs.setdefault(want[m], set()).add(m)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_thresholds_add_up_at_every_size():
    joint = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    for n in (0, 10, 10**6, 10**9, 10**11):
        parts = plan_parts(n, joint * max(n, 2))
        assert sum(p.limit + 1 for p in parts) == 5
        assert sorted(b for p in parts for b in p.bits) == list(range(64))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (3, 3)], "u long, v long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {501: 500}
