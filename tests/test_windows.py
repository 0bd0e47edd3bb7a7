import random
import re

import pytest

from vectorloom.functions.tokens import plugin_token_counts
from vectorloom.operators.tokens import document_windows, token_usage, truncation_report, truncations
from vectorloom.plans.bulk import embed
from vectorloom.plans.faults import PairFactory
from vectorloom.session import attach


def by_hand(text, parts, overlap):
    spans = [m.span() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text or "")]
    size = -(-len(spans) // parts)
    step, at, found = max(1, size - overlap), 0, []
    while spans:
        held = spans[at : at + size]
        found.append((len(found), held[0][0], len(held), text[held[0][0] : held[-1][1]]))
        if at + size >= len(spans):
            break
        at += step
    return found


@pytest.mark.parametrize("parts, overlap", [(4, 0), (4, 2), (1, 0), (1, 5), (3, 100), (7, 1)])
def test_windows_are_pieces_of_the_text(spark, parts, overlap):
    chosen = random.Random(1)
    texts = ["", "   \n", "one", " one ", "a b", "a  b\tc\n\nd ", None, "é 漢字 😀 x", "  a b"]
    texts += ["".join(chosen.choices(["w", "word", " ", "\n", "  "], k=chosen.randint(1, 60))) for _ in range(80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {}
    for r in document_windows(frame, parts=parts, overlap=overlap).orderBy("id", "window").collect():
        found.setdefault(r.id, []).append((r.window, r.start, r.n_tokens, r.text))
    assert found == {k: w for k, t in enumerate(texts) if (w := by_hand(t, parts, overlap))}


def test_windows_of_a_very_long_text(spark):
    text = " ".join(f"w{k}" for k in range(300_000))
    rows = document_windows(spark.createDataFrame([(1, text)], "id long, text string"), overlap=10).orderBy("window").collect()
    assert [r.n_tokens for r in rows] == [75_000, 75_000, 75_000, 75_000, 40]
    assert all(text[r.start :].startswith(r.text) for r in rows) and rows[-1].text.endswith("w299999")


def test_windows_need_no_shuffle_and_no_row_per_word(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    shown = document_windows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown and "Python" not in shown and shown.count("Generate ") == 1
    with pytest.raises(ValueError):
        document_windows(docs, parts=0)


def test_reported_tokens_are_those_that_the_encoder_cuts(spark):
    texts = [("gemma", "ab" * 3000), ("gemma", "abc"), ("gemma", ""), ("qwen", "x" * 20_000), ("qwen", "é" * 9), ("none", "x"), ("gemma", None)]
    rows = spark.createDataFrame([(k, m, "document", t) for k, (m, t) in enumerate(texts)], "id long, model string, task string, payload string")
    used = {r.id: r for r in token_usage(rows, factory=PairFactory()).collect()}
    for model in ("gemma", "qwen"):
        own = rows.where(rows.model == model).where("payload is not null").select("id", "payload")
        vectors = embed(own, "payload", model, "document", 2, factory=PairFactory(), truncate=False, normalize=False)
        for r in vectors.collect():
            assert r.embedding[0] == used[r.id].kept_tokens and r.embedding[1] == -2
    assert [used[k].truncated for k in range(5)] == [True, False, False, True, False]
    assert used[0].n_tokens == (len("title: none | text: ") + 6000) // 2 + 2 and used[5].n_tokens is None is used[6].n_tokens
    cut = truncations(rows, factory=PairFactory())
    assert sorted(r.id for r in cut.collect()) == [0, 3]
    report = {r.model: r for r in truncation_report(token_usage(rows, factory=PairFactory()).where("n_tokens is not null"), "model").collect()}
    assert report["gemma"].n_truncated == 1 and report["gemma"].tokens_lost == used[0].n_tokens - 2047


def test_plugin_counts_as_a_column(spark):
    attach(spark)
    rows = spark.createDataFrame([("gemma", "abcd"), ("qwen", "abcd"), (None, "abcd"), ("qwen", None)], "m string, t string")
    counts = rows.select(plugin_token_counts(PairFactory(), rows.m, rows.t).alias("n")).collect()
    assert [r.n for r in counts] == [4, 3, None, None]
