import hashlib
import random

from tokenizers import Tokenizer

from vectorloom.llm.bpe import PLAIN_LIMIT, ChunkEncoder, chunks, codec, encode_documents, op3_bpe, tokenizer_path

LETTERS = ["a", "b", " ", "  ", "\n", "'", "'re", "1", "é", "\u0085", " ", "<|endoftext|>", "<|endof", "中", "ſ", "!", "\t", "😀", "the "]


def library():
    return Tokenizer.from_file(tokenizer_path())


def test_ids_of_awkward_texts():
    own, other = ChunkEncoder(codec(tokenizer_path())), library()
    chosen = random.Random(1)
    for _ in range(1500):
        text = "".join(chosen.choices(LETTERS, k=chosen.randint(0, 60))) * chosen.choice([1, 1, 30])
        ids = own.encode(text.encode())
        assert ids == other.encode(text, add_special_tokens=False).ids
        assert own.codec.decode(ids).decode() == other.decode(ids, skip_special_tokens=False)


def test_plain_text_is_split_alike():
    coder, other = codec(tokenizer_path()), library()
    assert coder.merged is not None
    for c in map(chr, range(ord(PLAIN_LIMIT) + 1)):
        text = f"a{c}b {c} {c}{c}1{c} '{c}"
        assert coder.merged.encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids
    for i, piece in enumerate(coder.pieces):
        if piece.decode(errors="ignore").encode() == piece and i not in coder.special.values():
            text = piece.decode()
            assert coder.merged.encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids


def test_chunks_follow_content():
    chosen = random.Random(2)
    passage = " ".join("".join(chosen.choices("abcdefg", k=5)) for _ in range(4000)).encode()
    one, two = chunks(b"x " + passage), chunks(b"another beginning, " + passage)
    assert b"".join(two) == b"another beginning, " + passage and len(set(one) & set(two)) >= len(one) - 2
    assert b"".join(chunks(("é" * 50_000).encode())).decode() == "é" * 50_000
    assert all(c.decode() is not None for c in chunks(("é" * 50_000).encode())) and chunks(b"") == []


def test_a_small_cache_changes_nothing():
    chosen = random.Random(3)
    texts = [" ".join(chosen.choices(["lorem", "ipsum", "dolor", "sit"], k=2000)).encode() for _ in range(3)] * 2
    large, small = ChunkEncoder(codec(tokenizer_path())), ChunkEncoder(codec(tokenizer_path()), cache_bytes=2000)
    assert [large.encode(t) for t in texts] == [small.encode(t) for t in texts]
    assert small.held <= 2000


def test_documents(spark):
    text = "Shared passage of words, again and again. " * 300
    rows = [(1, text, "a"), (2, "x" + text, "b"), (2, "x" + text, "b"), (None, None, "c"), (3, "", "d"), (4, "<|endoftext|> é " * 9, "e")]
    docs = spark.createDataFrame([(i, t, n, 5) for i, t, n in rows], "doc_id long, text string, ids string, n_tokens int")
    frame = encode_documents(docs, what=("ids", "decoded", "digests"))
    other = library()
    want = []
    for i, t, _ in rows:
        ids = other.encode(t or "", add_special_tokens=False).ids
        decoded = other.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), ids, decoded, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(want, key=repr)
    assert encode_documents(docs.limit(0)).count() == 0


def test_the_whole_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    other = library()
    for row in op3_bpe(spark, small).collect():
        ids = other.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
