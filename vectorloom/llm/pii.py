"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation in SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectorloom.functions.binding import let
from vectorloom.llm.common import fresh_name, table

ROUNDS = 10
# Lengths of IBANs by country. Others are taken by their shape alone.
IBAN_LENGTHS: dict[int, str] = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """A country's own length first, so that a word behind the number is not taken for its end."""
    own = [
        f"(?:{'|'.join(names.split())})" + r"\d{2}" + f"(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
        for n, names in IBAN_LENGTHS.items()
    ]
    own.append(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
    return r"(?<![A-Za-z0-9])(?=[A-Z]{2}\d{2})(?:" + "|".join(own) + ")(?![A-Za-z0-9])"


# What each kind looks like. Lookarounds keep numbers inside longer words or numbers out.
KINDS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": _iban_pattern(),
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])|(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?![\w/])|(?<![\w.])\d{1,2}\.\d{1,2}\.\d{4}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)",
}
ANY = "|".join(KINDS.values())
# 1900-01-01 to 2099-12-31 are 73,049 days, the product of two primes.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _noise(key: str, kind: str, round_: Column, value: Column, below: Column) -> Column:
    """A keyed number from 0 to ``below - 1``, from 60 bits of a SHA-256."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % below


def feistel(key: str, kind: str, left: Column, right: Column, lefts: Column, rights: Column) -> Column:
    """A keyed permutation of the pairs ``(left, right)`` with ``left < lefts``, ``right < rights``.

    Each round adds to one half, modulo its own size, noise that depends on the other half;
    that can be undone, so different pairs never meet.
    """
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def turn(state: Column, number: Column) -> Column:
        a = (state["a"] + _noise(key, kind, number, state["b"], lefts)) % lefts
        b = (state["b"] + _noise(key, kind, number, state["a"], rights)) % rights
        return F.when(
            number % 2 == 1, F.struct(a.alias("a"), state["b"].alias("b"))
        ).otherwise(F.struct(state["a"].alias("a"), b.alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _power(exponent: Column) -> Column:
    return F.rpad(F.lit("1"), exponent + 1, "0").cast("long")


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A string of 2 to 36 digits to one of the same length; one digit and none stay."""

    def of(text: Column) -> Column:
        size = F.length(text)
        half = F.floor(size / 2).cast("int")
        rest = size - half
        state = feistel(
            key, kind, F.substring(text, F.lit(1), half).cast("long"), F.substring(text, half + 1, rest).cast("long"),
            _power(half), _power(rest),
        )
        moved = let(
            state, lambda s: F.concat(F.lpad(s["a"].cast("string"), half, "0"), F.lpad(s["b"].cast("string"), rest, "0"))
        )
        return F.when(size < 2, text).otherwise(moved)

    return let(digits, of)


def permute_letters(key: str, kind: str, letters: Column) -> Column:
    """A string of up to 20 letters A-Z to one of the same length."""

    def number(text: Column) -> Column:
        each = F.filter(F.split(text, ""), lambda c: c != "")
        return F.aggregate(each, F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 65)

    def spelled(n: Column, size: Column) -> Column:
        start = F.struct(n.cast("long").alias("n"), F.lit("").alias("text"))
        step = lambda s, _: F.struct(
            F.floor(s["n"] / 26).cast("long").alias("n"), F.concat(F.char(s["n"] % 26 + 65), s["text"]).alias("text")
        )
        return F.when(size < 1, "").otherwise(F.aggregate(F.sequence(F.lit(1), size), start, step, lambda s: s["text"]))

    powers = F.array(*[F.lit(26**k).cast("long") for k in range(11)])

    def of(text: Column) -> Column:
        half = F.floor(F.length(text) / 2).cast("int")
        rest = F.length(text) - half
        left, right = F.substring(text, F.lit(1), half), F.substring(text, half + 1, rest)
        state = feistel(key, kind, number(left), number(right), F.get(powers, half), F.get(powers, rest))
        return F.when(F.length(text) < 1, text).otherwise(let(state, lambda s: F.concat(spelled(s["a"], half), spelled(s["b"], rest))))

    return let(letters, of)


def _refill(shape: Column, digits: Column, letters: Column | None = None) -> Column:
    """``shape`` with its digits, in order, replaced by ``digits``, and its letters A-Z by ``letters`` if given."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(0).alias("spelled"))

    def step(state: Column, c: Column) -> Column:
        is_digit = c.between("0", "9") & (F.length(c) == 1)
        put = F.when(is_digit, F.substring(digits, state["used"] + 1, F.lit(1)))
        is_letter = c.between("A", "Z") & (F.length(c) == 1)
        if letters is not None:
            put = put.when(is_letter, F.substring(letters, state["spelled"] + 1, F.lit(1)))
        return F.struct(
            F.concat(state["text"], put.otherwise(c)).alias("text"),
            (state["used"] + F.when(is_digit, 1).otherwise(0)).alias("used"),
            (state["spelled"] + F.when(is_letter, 1).otherwise(0)).alias("spelled"),
        )

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["text"])


def _luhn_sum(digits: Column) -> Column:
    """The weighted digit sum of a number that ends in its check digit."""

    def weighted(c: Column, at: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(at % 2 == 1, twice).otherwise(d)

    values = F.transform(F.reverse(F.split(digits, "")), weighted)
    return F.aggregate(values, F.lit(0), lambda total, v: total + v)


def _card(key: str, found: Column) -> Column:
    """Luhn-valid numbers to Luhn-valid ones: the first digit stays, the last follows."""

    def moved(digits: Column) -> Column:
        body = F.concat(
            F.substring(digits, 1, 1), permute_digits(key, "card", F.substring(digits, F.lit(2), F.length(digits) - 2))
        )
        whole = let(body, lambda b: F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when((_luhn_sum(digits) % 10 == 0) & (digits.rlike("[1-9]")), _refill(found, whole))

    return let(_digits(found), moved)


def _iban_rest(text: Column) -> Column:
    """Remainder by 97 of an IBAN without blanks, its first four characters moved to the end."""
    turned = F.concat(F.substring(text, F.lit(5), F.length(text) - 4), F.substring(text, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        letter = c >= "A"
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (rest * F.when(letter, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _iban(key: str, found: Column) -> Column:
    """Country and format stay; all digits and all letters behind the check digits are permuted
    among themselves and the check digits follow."""

    def moved(text: Column) -> Column:
        country, body = F.substring(text, 1, 2), F.substring(text, F.lit(5), F.length(text) - 4)
        letters = F.regexp_replace(body, "[^A-Z]", "")
        # a lone digit is shifted by keyed noise; 30 letters are the most, in two pieces
        lone = lambda d: ((d.cast("long") + _noise(key, "iban digit", F.lit(1), F.lit(0), F.lit(10))) % 10).cast("string")
        digits = let(_digits(body), lambda d: F.when(F.length(d) == 1, lone(d)).otherwise(permute_digits(key, "iban", d)))
        pieces = F.array(F.substring(letters, 1, 20), F.substring(letters, 21, 20))
        spelled = F.array_join(F.transform(pieces, lambda x: permute_letters(key, "iban letters", x)), "")

        def whole(new: Column) -> Column:
            account = _refill(body, new["digits"], new["letters"])
            check = F.lpad((98 - _iban_rest(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
            return _refill(found, F.concat(check, new["digits"]), F.concat(country, new["letters"]))

        new = let(F.struct(digits.alias("digits"), spelled.alias("letters")), whole)
        return F.when(_iban_rest(text) == 1, new)

    return let(F.replace(found, F.lit(" "), F.lit("")), moved)


def _phone(key: str, found: Column) -> Column:
    """The country code after a plus stays; 7 to 15 digits in all are needed."""
    country = F.regexp_extract(found, r"^\+(\d{1,3}?)(?=[ .(-])", 1)

    def moved(pair: Column) -> Column:
        rest = F.substring(pair["all"], F.length(pair["country"]) + 1, F.lit(20))
        return F.when(
            F.length(pair["all"]).between(7, 15),
            _refill(found, F.concat(pair["country"], permute_digits(key, "phone", rest))),
        )

    return let(F.struct(_digits(found).alias("all"), country.alias("country")), moved)


def _ip(key: str, found: Column) -> Column:
    """Addresses of four octets below 256 without leading zeros."""

    def moved(octets: Column) -> Column:
        valid = F.forall(octets, lambda o: (o.cast("int") < 256) & (o.cast("int").cast("string") == o))
        pair = [F.get(octets, F.lit(k)).cast("long") * 256 + F.get(octets, F.lit(k + 1)).cast("long") for k in (0, 2)]
        state = feistel(key, "ip", *pair, F.lit(65536), F.lit(65536))
        text = let(
            state,
            lambda s: F.concat_ws(".", F.shiftright(s["a"], 8), s["a"] % 256, F.shiftright(s["b"], 8), s["b"] % 256),
        )
        return F.when(valid, text)

    return let(F.split(found, r"\."), moved)


def _ssn(key: str, found: Column) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001, to such numbers."""

    def moved(parts: Column) -> Column:
        area, group, serial = (F.get(parts, F.lit(k)).cast("long") for k in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        place = area - F.when(area > 666, 2).otherwise(1)
        state = feistel(key, "ssn", place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

        def shown(s: Column) -> Column:
            at = F.floor(s["a"] / 99)
            own = at + F.when(at >= 665, 2).otherwise(1)
            return F.format_string("%03d-%02d-%04d", own, s["a"] % 99 + 1, s["b"] + 1)

        return F.when(valid, let(state, shown))

    return let(F.split(found, "-"), moved)


def _date(key: str, found: Column) -> Column:
    """Days of 1900 to 2099 to such days, written alike. With slashes the month comes first
    unless it can only be the day; with dots the day comes first. A day or month of one
    digit says that no zeros are written in front; then the new date has none either."""
    iso = found.contains("-")
    dotted = found.contains(".")

    def moved(p: Column) -> Column:
        a, b, c = (F.get(p, F.lit(k)).cast("int") for k in range(3))
        day_first = dotted | (a > 12)
        year = F.when(iso, a).otherwise(c)
        month = F.when(iso, b).when(day_first, b).otherwise(a)
        day = F.when(iso, c).when(day_first, a).otherwise(b)
        real = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
        number = F.datediff(F.when(year.between(1900, 2099), real), F.lit(FIRST_DAY).cast("date"))

        def shown(s: Column) -> Column:
            other = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS[1] + s["b"]).cast("int"))
            y, m, d = F.year(other), F.month(other), F.dayofmonth(other)
            bare = (F.length(F.get(p, F.lit(0))) == 1) | (F.length(F.get(p, F.lit(1))) == 1)
            swap = dotted | (day_first & (d > 12))
            parts = [F.when(swap, d).otherwise(m), F.when(swap, m).otherwise(d)]
            parts = [F.when(bare, x.cast("string")).otherwise(F.format_string("%02d", x)) for x in parts]
            mark = F.when(dotted, ".").otherwise("/")
            return F.when(iso, F.format_string("%04d-%02d-%02d", y, m, d)).otherwise(
                F.concat(parts[0], mark, parts[1], mark, F.format_string("%04d", y))
            )

        def of(n: Column) -> Column:
            state = feistel(key, "date", F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]))
            return F.when(n.isNotNull(), let(state, shown))

        return let(number, of)

    return let(F.split(found, "[-/.]"), moved)


def _email(key: str, found: Column) -> Column:
    """Addresses have no numeric format; the name becomes a keyed token, the domain stays."""
    token = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(found)), 256), 1, 16)
    return F.concat(F.lit("u"), token, F.lit("@"), F.substring_index(found, "@", -1))


_MOVES: dict[str, Callable[[str, Column], Column]] = {
    "email": _email, "iban": _iban, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card,
}


def _replacement(key: str, found: Column) -> Column:
    """``(kind, text)`` of a match; the kind is null where its check fails."""
    cases = [(found.rlike(f"^(?:{KINDS[k]})$"), k) for k in KINDS]
    texts = None
    for is_kind, kind in cases:
        moved = _checked(_MOVES[kind](key, found), kind, found)
        texts = F.when(is_kind, moved) if texts is None else texts.when(is_kind, moved)
    return texts.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), found.alias("text")))


def _checked(moved: Column, kind: str, found: Column) -> Column:
    return let(moved, lambda t: F.struct(F.when(t.isNotNull(), kind).alias("kind"), F.coalesce(t, found).alias("text")))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", counts_prefix: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; all rows and columns stay.

    Payment cards (Luhn), IBANs (mod 97), phone numbers, IPv4 addresses, US social security
    numbers and dates are checked and moved by a keyed permutation within their format: equal
    values get equal pseudonyms in every document, different ones different ones, and each
    passes the check that its original passed. E-mail names become keyed tokens. Numbers that
    fail their check stay. ``counts_prefix`` adds a column with the number of replacements of
    each kind. Null and empty texts stay as they are.

    One projection: no shuffle, no Python. The key stands in the query plan, so take it from
    a secret store and keep plans and event logs where the key may be.
    """
    text = F.col(f"`{text_col}`")
    found, parts = fresh_name(docs, "_found"), fresh_name(docs, "_parts")
    has_any = text.rlike("[0-9@]")
    matches = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _replacement(key, m))
    staged = docs.withColumns(
        {
            found: F.when(has_any & text.rlike(ANY), matches),
            parts: F.when(has_any & text.rlike(ANY), F.split(text, ANY, -1)),
        }
    )
    between = F.concat(F.col(parts), F.array().cast("array<string>"))
    joined = F.array_join(F.zip_with(between, F.col(found), lambda p, m: F.concat(p, F.coalesce(m["text"], F.lit("")))), "")
    columns = [F.when(F.col(found).isNull(), text).otherwise(joined).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts_prefix is not None:
        columns += [_number(F.col(found), kind).alias(f"{counts_prefix}{kind}") for kind in KINDS]
    return staged.select(*columns)


def _number(found: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(found, lambda m: m["kind"] == kind)), F.lit(0)).cast("long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms, and how many of each kind it got."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("spark.vectorloom.pii.key", "a key for tests alone")
    return pseudonymize(docs, key, counts_prefix="n_")
