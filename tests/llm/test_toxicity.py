from zlib import crc32

import numpy as np

from vectorloom.llm.toxicity import PRODUCTION, Fit, fit_machine, hashed_terms, learn, op8_toxicity, reject_toxic, score


def test_scores_are_those_of_all_pairs():
    random = np.random.default_rng(0)
    terms = [np.unique(random.integers(0, 40, 12)) for _ in range(300)]
    labels = np.array([float(3 in t and 7 in t) for t in terms])
    machine = fit_machine(terms, labels, Fit(least_rows=2))
    place = {s: k for k, s in enumerate(machine.slots.tolist())}
    for t, got in zip(terms[:40], machine.scores(terms[:40])):
        known = [place[x] for x in t.tolist() if x in place]
        margin = machine.bias + sum(machine.weights[k] for k in known)
        margin += sum(machine.factors[a] @ machine.factors[b] for i, a in enumerate(known) for b in known[:i])
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-9


def test_pairs_are_learned():
    random = np.random.default_rng(1)
    rows = []
    for k in range(4000):
        words = set(random.choice(50, 6).tolist())
        words |= {100} if k % 2 else set()
        words |= {200} if k % 4 >= 2 else set()
        rows.append(np.array(sorted(words)))
    labels = np.array([float((100 in r) != (200 in r)) for r in rows])  # no linear weights can tell
    machine = fit_machine(rows[:3000], labels[:3000], Fit(l1=0, l1_factors=0, epochs=20, batch=64))
    assert ((machine.scores(rows[3000:]) >= 0.5) == (labels[3000:] == 1)).mean() > 0.9


def test_pairs_are_learned_as_in_production():
    random = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(13_000):
        words = set((np.minimum(random.zipf(1.3, 320), 3000) + 1000).tolist())
        kind = random.random()  # a tenth is toxic: with both words or with neither, which no linear weights can tell
        one, other = kind < 0.45 or kind >= 0.95, 0.45 <= kind < 0.9 or kind >= 0.95
        words |= ({100} if one else set()) | ({200} if other else set())
        rows.append(np.array(sorted(words)))
        labels.append(float(one == other))
    labels = np.array(labels)
    machine = fit_machine(rows[:12_000], labels[:12_000], Fit())
    found, toxic = machine.scores(rows[12_000:]) >= 0.5, labels[12_000:] == 1
    assert (found & toxic).sum() >= 0.4 * toxic.sum() and (found == toxic).mean() > 0.92
    place = np.searchsorted(machine.slots, [100, 200])
    assert machine.slots[place].tolist() == [100, 200] and machine.factors[place[0]] @ machine.factors[place[1]] > 0.5


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = op8_toxicity(spark, folder).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == t for p, t in known) / len(known) > 0.95
    assert sum(p for p, t in known if t == 0) <= 2


def test_edges(spark):
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame([(k, f"bad word {k}" if k % 2 else f"fine {k}", "s") for k in range(200)], schema)
    labels = spark.createDataFrame(
        [(k, k % 2, 5) for k in range(200)] + [(None, 1, 5), (3, None, 5), (3, 0, 5), (9999, 1, 5)],
        "doc_id long, toxic int, text int",
    )
    machine = learn(docs, labels)
    odd = spark.createDataFrame(
        [(1, "bad word", "s"), (1, "bad word", "s"), (None, None, "s"), (2, "", "s"), (3, "fine " * 50_000, "s")], schema
    )
    found = score(odd, machine)
    assert found.columns == ["doc_id", "text", "score"] and found.count() == 5
    scores = {r.text: r.score for r in found.collect()}
    assert scores["bad word"] > 0.5 > scores["fine " * 50_000] and scores[None] == scores[""]
    empty = learn(docs, labels.limit(0))
    assert {r.score for r in score(odd, empty).collect()} == {0.5}
    assert score(docs.limit(0), machine).count() == 0 and learn(docs.limit(0), labels).bias == 0
    assert hashed_terms(b"").size == 0


def test_rejected_documents_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = reject_toxic(spark, docs, small)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()


def _planted(n, random, same_group):
    """Texts of 5 to 4,000 words; toxic ones hold a word of each of two groups, a third of the
    others one word, or two of one group. No two of these words share their first letters."""
    groups = [["zabork", "quimel", "veltan", "nurpis", "gloxum"], ["tragol", "hendix", "mulkar", "sirbet", "covtun"]]
    texts, labels = [], []
    for _ in range(n):
        words = [f"w{k}" for k in random.zipf(1.3, int(np.exp(random.uniform(np.log(5), np.log(4000))))) % 5000]
        kind = random.random()
        own = [random.choice(g) for g in groups] if kind < 0.1 else []
        if 0.1 <= kind < 0.4:
            own = list(random.choice(groups[kind < 0.25], 2 if same_group else 1, replace=False))
        for word in own:
            words.insert(random.integers(0, len(words) + 1), word)
        texts.append(hashed_terms(" ".join(words).encode()))
        labels.append(float(kind < 0.1))
    return texts, np.array(labels)


def test_pairs_tell_in_texts_of_every_length():
    for same_group in (False, True):
        texts, labels = _planted(4000, np.random.default_rng(5), same_group)
        machine = fit_machine(texts[:3200], labels[:3200], PRODUCTION)
        short = np.array([len(t) < 60 for t in texts[3200:]])
        toxic, found = labels[3200:] == 1, machine.scores(texts[3200:]) >= 0.5
        for part in (short, ~short):
            assert found[toxic & part].mean() > 0.9 and found[~toxic & part].mean() < 0.02
        empty = machine.scores([np.empty(0, np.int64), np.array([-5])])
        assert np.allclose(empty, (labels[:3200].sum() + 0.5) / 3201)


def test_opposed_factors_are_taken_off():
    texts, labels = _planted(1200, np.random.default_rng(6), True)
    machine = fit_machine(texts, labels, PRODUCTION)
    place, signs = {s: k for k, s in enumerate(machine.slots.tolist())}, np.array([1, 1, 1, 1, -1, -1, -1, -1])
    assert machine.factors.any()
    for t, got in zip(texts[:30], machine.scores(texts[:30])):
        known = [place[x] for x in t.tolist() if x in place]
        margin = machine.bias + sum(machine.weights[k] for k in known)
        v = machine.factors[known]
        margin += sum(signs * v[a] @ v[b] for a in range(len(known)) for b in range(a))
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-9
