from vectorloom.llm.lines import drop_repeated_lines, op5_lines

SCHEMA = "doc_id long, text string, _id string, lines int"


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    frame = drop_repeated_lines(docs, removed_col="n")
    assert frame.columns == [*docs.columns, "n"]
    return sorted(((r.doc_id, r.text, r.n) for r in frame.collect()), key=repr)


def test_later_occurrences_go(spark):
    long = " ".join(f"w{k}" for k in range(51))
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\na\n b\t\nc\nd\ny"), (3, "a\nb\nq"), (4, f"k\n{long}\nm"), (5, f"{long}\nz"),
        (6, "r\nr\nr\nr\nr"), (7, None), (8, ""), (9, "p\n\nq\ns\n"), (10, "0\np\nq\n\ns\n1"),
    ]
    assert run(spark, rows) == sorted(
        [
            (1, "a\nb\nc\nd", 0), (2, "x\ny", 4), (3, "a\nb\nq", 0), (4, f"k\n{long}\nm", 0), (5, "z", 1), (6, "r", 4),
            (7, None, 0), (8, "", 0), (9, "p\n\nq\ns\n", 0), (10, "0\n1", 4),
        ],
        key=repr,
    )


def test_words_are_parted_by_any_white_space(spark):
    for blank in "\t", "\u00a0", "\u2003", "\u3000", " \t ":
        long = blank.join(f"w{k}" for k in range(51))
        assert run(spark, [(1, long), (2, f"a\n{long}")]) == [(1, long, 0), (2, "a", 1)]
    padded = "a" + " " * 60 + "b"
    assert run(spark, [(1, padded), (2, padded)]) == [(1, padded, 0), (2, padded, 0)]
    fifty = " ".join(f"w{k}" for k in range(50))
    assert run(spark, [(1, fifty), (2, fifty)]) == [(1, fifty, 0), (2, fifty, 0)]


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "one\ntwo\nthree"
    assert run(spark, [(1, text), (1, text), (None, text), (None, text)]) == sorted(
        [(1, text, 0), (1, text, 0), (None, "", 3), (None, "", 3)], key=repr
    )
    assert run(spark, [(1, text), (1, text + "\nfour")]) in (
        sorted([(1, text, 0), (1, "four", 3)], key=repr), sorted([(1, "", 3), (1, text + "\nfour", 0)], key=repr)
    )
    assert run(spark, []) == []


def test_a_very_long_text(spark):
    text = "\n".join(f"line {k}" for k in range(30_000))
    assert [r[2] for r in run(spark, [(1, text), (2, text)])] == [0, 30_000]


def test_no_python_in_the_plan(spark, small):
    plan = op5_lines(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
