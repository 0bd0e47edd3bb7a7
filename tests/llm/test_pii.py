import hashlib
import re

import pytest
from pyspark.sql import functions as F

from vectorloom.llm.pii import KINDS, ROUNDS, op1_pii, permute_digits, pseudonymize

KEY = "k"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def slow_feistel(kind, a, b, m, n):
    def noise(r, x, below):
        return int(hashlib.sha256(f"{KEY}|{kind}|{r}|{x}".encode()).hexdigest()[:15], 16) % below

    for r in range(1, ROUNDS + 1):
        if r % 2:
            a = (a + noise(r, b, m)) % m
        else:
            b = (b + noise(r, a, n)) % n
    return a, b


def slow_digits(kind, digits):
    half = len(digits) // 2
    if len(digits) < 2:
        return digits
    a, b = slow_feistel(kind, int(digits[:half]), int(digits[half:]), 10**half, 10 ** (len(digits) - half))
    return f"{a:0{half}d}{b:0{len(digits) - half}d}"


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _found string")
    frame = pseudonymize(docs, KEY, counts_prefix="n_")
    assert frame.columns == [*docs.columns, *(f"n_{k}" for k in KINDS)]
    return [(r.text, {k: r[f"n_{k}"] for k in KINDS if r[f"n_{k}"]}) for r in frame.orderBy("doc_id").collect()]


def test_against_plain_python(spark):
    (card, _), (ip, _), (phone, _), (date, _), (ssn, _) = run(
        spark, ["4111-1111-1111-1111", "10.0.200.7", "+1 (640) 555-0953", "2024-02-29", "123-45-6789"]
    )
    body = "4" + slow_digits("card", "11111111111111")
    want = body + next(str(c) for c in range(10) if luhn(body + str(c)) == 0)
    assert card == "-".join(want[k : k + 4] for k in range(0, 16, 4))
    a, b = slow_feistel("ip", 10 * 256, 200 * 256 + 7, 65536, 65536)
    assert ip == f"{a >> 8}.{a % 256}.{b >> 8}.{b % 256}"
    digits = slow_digits("phone", "6405550953")
    assert phone == f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}"
    import datetime

    first = datetime.date(1900, 1, 1)
    days = (datetime.date(2024, 2, 29) - first).days
    a, b = slow_feistel("date", days // 4297, days % 4297, 17, 4297)
    assert date == str(first + datetime.timedelta(a * 4297 + b))
    a, b = slow_feistel("ssn", 122 * 99 + 44, 6788, 898 * 99, 9999)
    area = a // 99 + (2 if a // 99 >= 665 else 1)
    assert ssn == f"{area:03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def test_dates_keep_their_zeros(spark):
    (bare, _), (padded, _), (dots, _), (equal, _) = run(spark, ["3/4/2024", "03/04/2024", "3.4.2024", "4.3.2024"])
    assert [int(x) for x in bare.split("/")] == [int(x) for x in padded.split("/")]
    assert re.fullmatch(r"\d\d/\d\d/\d{4}", padded) and not re.search(r"(^|/)0", bare)
    # the same day, written day first
    month, day, year = bare.split("/")
    assert equal == f"{day}.{month}.{year}" and dots != equal


def test_checks_decide_and_formats_stay(spark):
    texts = [
        "4111111111111112 300.1.1.1 2023-02-29 666-12-1234 DE89370400440532013001 0641917ea4e9feb9cda83477b57ac265",
        "x 4111111111111111!! 1.2.3.4. (+1 640 555 0953) 29.02.2024 12/25/1999 DE89370400440532013000",
        "a.b@mail7.example.com### and a.b@mail7.example.com", None, "", "none",
    ]
    found = run(spark, texts)
    assert found[0] == (texts[0], {})
    assert found[1][1] == {"card": 1, "ip": 1, "phone": 1, "date": 2, "iban": 1}
    assert re.fullmatch(
        r"x 4\d{15}!! \d+\.\d+\.\d+\.\d+\. \(\+1 \d{3} \d{3} \d{4}\) \d\d\.\d\d\.\d{4} \d\d/\d\d/\d{4} DE\d{20}", found[1][0]
    )
    iban = found[1][0].split()[-1]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert luhn(found[1][0].split()[1].rstrip("!")) == 0
    one, other = re.findall(r"\S+@mail7\.example\.com", found[2][0])
    assert one == other and "a.b@" not in found[2][0]
    assert [f[0] for f in found[3:]] == [None, "", "none"]
    assert run(spark, []) == []


def test_permutation_is_one_to_one(spark):
    frame = spark.range(1000).select(permute_digits(KEY, "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("d"))
    values = {r.d for r in frame.collect()}
    assert len(values) == 1000 and all(len(v) == 3 for v in values)


def test_a_very_long_text(spark):
    text = "word " * 100_000 + "4111111111111111 " + "z" * 100_000
    (found, counts), = run(spark, [text])
    assert counts == {"card": 1} and len(found) == len(text)


def test_documents_keep_nothing_that_was_found(spark, small):
    frame = op1_pii(spark, small)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for row in frame.collect():
        old = before[row.doc_id]
        cards = [m for m in re.findall(r"(?<![\w.-])\d{13,19}(?![\w-]|\.\d)", old) if luhn(m) == 0]
        hidden = cards + re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|[\w.]+@[\w.]+\.com", old)
        assert not [m for m in hidden if m in row.text]
        assert row.n_card == len(cards) and (hidden or row.n_ip or row.text == old)


@pytest.mark.parametrize("value", ["1850-01-01", "2024-13-01", "256.1.1.1", "01.2.3.4", "000-12-3456", "0000000000000000"])
def test_invalid_values_stay(spark, value):
    assert run(spark, [value])[0] == (value, {})


def iban_rest(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def iban(country, account):
    return f"{country}{98 - iban_rest(country + '00' + account):02d}{account}"


def shape(text):
    return re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text))


def test_ibans_move_whatever_they_end_in(spark):
    accounts = [
        "MT MALT011000012345MTLCAST001S", "BR 00360305000010009795493C1", "MU BOMM0101101030300200000MUR", "GB NWBK60161331926819",
        "PL 109010140000071219812874", "LC HEMMABCDEFGHIJKLMNOPQRSTUVWX", "SC SSCB11010000000000001497USD", "NO 86011117947",
    ]
    old = [iban(*a.split()) for a in accounts]
    spaced = [" ".join(o[k : k + 4] for k in range(0, len(o), 4)) for o in old]
    found = run(spark, [*old, *spaced])
    for o, (new, counts), s, (other, _) in zip(old, found, spaced, found[len(old) :]):
        assert counts == {"iban": 1} and new == other.replace(" ", "") and shape(other) == shape(s)
        assert new[:2] == o[:2] and iban_rest(new) == 1 and shape(new) == shape(o)
        assert sum(a != b for a, b in zip(o[4:], new[4:])) > len(o[4:]) // 2


def test_words_behind_an_iban_are_not_its_end(spark):
    words = ["BIC X", "EUR", "USD 12", "CODE", "BIC ABCD", "4711"]
    ibans = ["ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "BE68539007547034"]
    cases = [(o, w) for o in ibans for w in words]
    for (old, word), (new, counts) in zip(cases, run(spark, [f"{o} {w}" for o, w in cases])):
        assert counts == {"iban": 1} and new.endswith(f" {word}") and old not in new
        assert iban_rest(new.removesuffix(f" {word}").replace(" ", "")) == 1
