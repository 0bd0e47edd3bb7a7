import math
from zlib import crc32

import numpy as np

from vectorloom.llm.language import codewords, hashed_ngrams, held_out, learn, op12_language, predict_language


def test_codewords_lie_apart():
    for n in range(2, 40):
        code = codewords(n)
        distance = [(a != b).sum() for k, a in enumerate(code) for b in code[:k]]
        assert len(code) == n and min(distance) >= 0.25 * code.shape[1]
        assert all(-n < s < n for s in code.sum(axis=0))
    assert codewords(4).shape == (4, 7) and codewords(1).shape == (1, 0) == (1, codewords(0).shape[1])


def test_ngrams_stay_in_their_text():
    texts = [b"Abc", b"", b"x" * 300_000, "é1".encode()]
    apart = [np.sort(np.concatenate([b for b, _ in hashed_ngrams([t])])) for t in texts]
    together = [[], [], [], []]
    for buckets, rows in hashed_ngrams(texts):
        for k in range(4):
            together[k].append(buckets[rows == k])
    assert all(np.array_equal(np.sort(np.concatenate(together[k])), apart[k]) for k in range(4))
    assert [len(a) for a in apart] == [3 * (len(t) + 4) for t in texts]


def test_held_out_accuracy_and_scores(spark):
    folder = "/root/testdata/sf0.01"
    rows = op12_language(spark, folder).collect()
    given = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(given) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 100 and sum(r.lang_pred == given[r.doc_id].lang for r in unseen) > 0.98 * len(unseen)
    # decoding, written out for some documents
    model = learn(spark.read.parquet(f"{folder}/documents.parquet"))
    for r in rows[:25]:
        margins = (model.outputs([given[r.doc_id].text.encode()])[0] - model.middle) / model.spread
        loss = [
            sum(t * math.log1p(math.exp(-4 * c * m)) for t, c, m in zip(model.trust[k], model.code[k], margins))
            for k in range(len(model.languages))
        ]
        best = loss.index(min(loss))
        assert model.languages[best] == r.lang_pred
        assert abs(r.score - 1 / sum(math.exp(loss[best] - x) for x in loss)) < 1e-6


def test_mixed_texts_are_flagged(spark):
    docs = spark.createDataFrame([(k, ("aba bab " if k % 2 else "xyx yxy ") * 9, "AB" if k % 2 else "XY") for k in range(400)], "doc_id long, text string, lang string")
    model = learn(docs)
    odd = [("aba bab", 1), ("yxy xyx", 2), ("ab yx " * 20, 3), (None, 4), ("", 5), ("12 ! 3", 6), ("中文", 7), ("ba " * 200_000, 8), ("ba ", 8)]
    frame = spark.createDataFrame([(n, t, "s", True) for t, n in odd], "id long, text string, Score string, other boolean")
    found = predict_language(frame, model)
    assert found.columns == ["id", "text", "other", "lang_pred", "score", "ambiguous"]
    by_id = {(r.id, r.text): r for r in found.collect()}
    get = lambda k: by_id[odd[k - 1][1], odd[k - 1][0]]
    assert len(by_id) == len(odd)
    assert (get(1).lang_pred, get(2).lang_pred, get(8).lang_pred) == ("AB", "XY", "AB")
    assert get(1).score > 0.9 and not get(1).ambiguous and get(3).score < get(1).score
    assert all((get(k).lang_pred, get(k).score, get(k).ambiguous) == ("und", 0.0, False) for k in (4, 5, 6))
    assert get(7).lang_pred in ("AB", "XY")


def test_little_to_learn_from(spark):
    schema = "doc_id string, text string, lang string, score int"
    odd = spark.createDataFrame([("1", "some text", None, 1), (None, "more", "en", 1), (None, None, "en", 1)], schema)
    assert {(r.lang_pred, r.score) for r in predict_language(odd, learn(odd)).collect()} == {("und", 0.0)}
    assert learn(odd.limit(0)).languages == () and predict_language(odd.limit(0), learn(odd)).count() == 0
    one = spark.createDataFrame([(str(k), "abc", "en", 1) for k in range(9)] * 2, schema)
    assert {(r.lang_pred, r.score) for r in predict_language(one, learn(one)).collect()} == {("en", 1.0)}
    kept = one.select(held_out(one.doc_id).alias("h"), "doc_id").collect()
    assert all(r.h == (crc32(r.doc_id.encode()) % 4 == 2) for r in kept)
