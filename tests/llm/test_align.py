import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vectorloom.llm.align import Tokenizers, align, align_documents, op13_align, overlaps, piece_path, terminals, tokenizer_path, tokenizers

LETTERS = ["a", "b", " ", "  ", "\n", "'re", "1", "é", "\u0085", " ", "<|endoftext|>", "<s>", "中", "▁", "!", "\t", "😀", "the ", "\r\n", "ﬁ", "é", "\x00", "word"]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """Whole texts through both libraries, spans compared one by one."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    both = tokenizers(tokenizer_path(), piece_path())
    found, counts = [], Counter()
    for text in texts:
        found.append(None)
        if not text:
            continue
        ids = library.encode(" " + text, add_special_tokens=False).ids, both.pieces.encode(text)
        pieces = [[table[i] for i in x] for table, x in zip((both.codec.pieces, both.b_pieces), ids)]
        if any(b"".join(p) != (" " + text).encode() for p in pieces):
            continue
        spans = []
        for own in pieces:
            ends = np.cumsum([len(p) for p in own]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        links, first = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][first][1] <= s:
                first += 1
            near = first
            while near < len(spans[1]) and spans[1][near][0] < e:
                links.append((ids[0][i], ids[1][near]))
                near += 1
        groups, at = [], [0, 0]
        for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            sides = []
            for k in (0, 1):
                begin = at[k]
                while at[k] < len(spans[k]) and spans[k][at[k]][1] <= cut:
                    at[k] += 1
                sides.append(",".join(map(str, ids[k][begin : at[k]])))
            groups.append("|".join(sides))
        found[-1] = (len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups))
        counts.update(set(links))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [
        (f[0], f[1], f[2], len(f[3]), sum(counts[x] == most[x[0]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(f[4].encode()).hexdigest())
        if f else none for f in found
    ]


def test_pointers_reach_the_end_of_their_group():
    chosen = random.Random(4)
    for _ in range(300):
        size = chosen.randint(1, 60)
        ends = [np.array(sorted({*chosen.sample(range(1, size + 1), chosen.randint(0, size)), size})) for _ in (0, 1)]
        last = terminals(*overlaps(*ends))
        common = sorted(set(ends[0]) & set(ends[1]))
        expected = [ends[0].tolist().index(min(c for c in common if c >= e)) for side in ends for e in side]
        assert last.tolist() == expected


def test_awkward_texts(spark):
    chosen = random.Random(5)
    texts = ["".join(chosen.choices(LETTERS, k=chosen.randint(0, 40))) for _ in range(400)] + [None, "", " ", "\n", " a", "▁", "b" * 3000, "x y " * 9000]
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, pairs string, row int")
    expected = brute(texts)
    for hot in (3, 1 << 18):  # nearly all pairs joined, and none
        rows = {r.doc_id: r for r in align_documents(docs, hot=hot, with_groups=True).collect()}
        assert [tuple(rows[k][c] for c in COLUMNS) for k in range(len(texts))] == expected
        assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in rows.values())


def test_units_are_those_of_whole_texts():
    plain = Tokenizers(tokenizer_path(), piece_path(), remembered=5)  # forgets all the time
    whole = Tokenizers(tokenizer_path(), piece_path())
    whole.cuts = None
    chosen = random.Random(6)
    for _ in range(60):
        texts = ["".join(chosen.choices(LETTERS + ["some ", "words\nhere "], k=chosen.randint(0, 60))) for _ in range(5)] + [None]
        one, other = plain.encode(texts), whole.encode(texts)
        for name in ("a", "b", "doc_a", "doc_b"):
            assert np.array_equal(getattr(one, name), getattr(other, name))
        assert align(one, plain).groups == align(other, whole).groups


def test_every_document_of_the_table(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((r.doc_id, *e) for r, e in zip(rows, brute([r.text for r in rows])))
    assert sorted(tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in op13_align(spark, small).collect()) == expected


def test_repeated_and_absent_rows(spark):
    docs = spark.createDataFrame([("k", "same text"), ("k", "same text"), (None, "same text"), (None, None)], "doc_id string, text string")
    rows = align_documents(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["None", "None", "k", "k"]
    full = [r for r in rows if r.n_a]
    assert len(full) == 3 and all(r.n_best == r.n_links and r.count_sum == 3 * r.n_links for r in full)
    assert align_documents(docs.limit(0)).count() == 0
