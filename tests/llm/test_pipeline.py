import corpus_pipeline
from vectorloom.llm.simhash import fingerprint
from vectorloom.session import materialize


def test_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "tokenization"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], small), name))
    assert all(f.columns == docs.columns for f in seen[:-1])
    rows = [{r.doc_id: r for r in f.collect()} for f in seen]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))
    assert all(r.text == rows[0][i].text for i, r in rows[1].items()) and set(rows[2]) == set(rows[1])
    assert all(r.n_chars == len(r.text) for r in rows[2].values())
    marks = sorted(fingerprint(r.text.encode()) for r in rows[3].values())
    assert all(bin(a ^ b).count("1") > 4 for k, a in enumerate(marks) for b in marks[:k])
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert final == rows[5] and set(final) == set(rows[4])
