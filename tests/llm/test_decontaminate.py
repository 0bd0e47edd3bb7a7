from vectorloom.llm.decontaminate import contamination, drop_contaminated

DOCS = "doc_id long, text string, item_id string, n_hit int"
ITEMS = "item_id long, text string, doc_id int"


def slow(docs, items, window=13):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))

    result = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for item, other in items:
            w = words(other)
            size = min(window, len(w))
            for s in range(len(w) - size + 1 if w else 0):
                for p in range(len(own) - size + 1):
                    if own[p : p + size] == w[s : s + size]:
                        hit |= set(range(p, p + size))
                        found |= {str(item)} if item is not None else set()
        result.append((repr(doc), len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(result)


def run(spark, docs, items):
    frame = contamination(
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS),
        spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS),
    )
    return sorted((repr(r.id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in frame.collect())


def test_against_brute_force(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    items = [
        (1, passage), (2, "A short, one."), (3, "one"), (4, None), (5, ""), (None, "Nobody's words"), (2, "A short, one."),
        (6, "go " * 20), (7, " ".join(f"p{k}" for k in range(10, 60))), (8, "Ünï cödé zwölf"),
    ]
    docs = [
        (1, "lead in " + passage.upper() + " tail"), (2, " ".join(passage.split()[5:18])), (3, " ".join(passage.split()[5:17])),
        (4, "a-short;ONE"), (5, None), (6, ""), (6, "one"), (6, "one"), (None, "nobody s words"), (7, "go " * 30),
        (8, passage + " x " + passage), (9, "ünï cödé zwölf"), (10, "fill " * 400 + " ".join(passage.split()[:13])),
        (11, "fill " * 20_000 + passage), (12, "p0 p1 p2 p3"),
    ]
    assert run(spark, docs, items) == slow(docs, items)


def test_empty_sides(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [("1", 2, 0, [], False)]


def test_contaminated_rows_go(spark):
    docs = spark.createDataFrame(
        [(1, "one two three", "a", 1), (1, "clean", "b", 2), (None, "clean too", "c", 3), (None, "one two three", "d", 4), (2, None, "e", 5)],
        DOCS,
    )
    items = spark.createDataFrame([(1, "one two three", 1)], ITEMS)
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == ["b", "c", "e"]
