import random
import re
from collections import Counter
from zlib import crc32

from vectorloom.llm.variants import PositionIndex, group_variants, near_words


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = crc32(f"{'' if id_ is None else id_}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    found = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] < 2 * n:
            best = None
        found[w] = [best, w, n, len(close), words.get(best)]
    for w in found:
        while found[found[w][1]][0]:
            found[w][1] = found[found[w][1]][0]
    return sorted((w, *r) for w, r in found.items())


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_bits_agree_with_comparisons():
    chosen = random.Random(2)
    for _ in range(200):
        m = chosen.randint(3, 7)
        words = list({"".join(chosen.choices("ab", k=m + chosen.randint(0, 1))) for _ in range(chosen.randint(1, 90))})
        index = PositionIndex(words, m)
        for query in [w for w in words if len(w) == m]:
            replaced, inserted, shared = index.near(query, m // 2)
            assert {words[k] for k in index.members(replaced | inserted)} == {w for w in words if near(query, w)}
            if replaced | inserted:
                assert {words[k] for k in index.members(shared)} >= {w for w in words if near(query, w) and w[: m // 2] == query[: m // 2]}


def test_every_word_of_a_made_up_corpus(spark):
    chosen = random.Random(3)
    words = ["".join(chosen.choices("abcé", k=chosen.randint(4, 9))) for _ in range(250)]
    rows = [(k % 150, " ".join(chosen.choices(words, weights=range(1, 251), k=60)) + " Ünder\nÀÉ,x1y") for k in range(200)]
    rows += [(None, "abcde " * 400), (7, None), (8, ""), (9, "1 2 ×"), (9, "1 2 ×")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    expected = brute(rows)
    assert any(r[1] for r in expected) and any(r[4] > 1 for r in expected)
    assert rows_of(group_variants(docs)) == expected
    assert rows_of(group_variants(docs, block=7)) == expected  # hot groups in parts
    ids = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    assert rows_of(group_variants(ids)) == expected
    assert group_variants(docs.limit(0)).count() == 0


def test_chains_and_ties(spark):
    rows = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("zzzzz", 4), ("zzzzy", 9), ("zzzzx", 9), ("mmmmm", 5), ("mmmmn", 9)]
    text = " ".join(w for w, n in rows for _ in range(n))
    docs = spark.createDataFrame([(None, text)], "doc_id long, text string")
    found = {r.word: r for r in group_variants(docs, damage=10**12).collect()}
    assert (found["aaaaa"].form, found["aaaaa"].root, found["aaabb"].root) == ("aaaab", "aaabb", "aaabb")
    assert found["zzzzz"].form == "zzzzx" and found["mmmmm"].form is None and found["mmmmm"].n_near == 1


def test_one_group_with_most_words(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"pref{a}{b}" for a in letters for b in letters]
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    pairs = [(r.word, r.near) for r in near_words(frame, block=100).collect()]
    assert len(pairs) == len(set(pairs)) == sum(near(a, b) for a in words for b in words)
