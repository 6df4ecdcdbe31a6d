import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def card(rng):
    run = "".join(rng.choice("0123456789") for _ in range(15))
    return next(run + c for c in "0123456789" if luhn(run + c))


def iban(rng):
    account = "".join(rng.choice("0123456789") for _ in range(18))
    return f"DE{98 - mod97(account + 'DE00'):02d}{account}"


MAKE = {
    "card": card,
    "iban": iban,
    "ipv4": lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)),
    "date_ymd": lambda r: str(date(1900, 1, 1) + timedelta(r.randrange(pii.DAYS))),
    "date_dmy": lambda r: (date(1900, 1, 1) + timedelta(r.randrange(pii.DAYS))).strftime("%d/%m/%Y"),
    "phone": lambda r: f"+1 ({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(0, 9999):04d}",
    "phone_intl": lambda r: f"+49 {r.randint(100, 999)} {r.randint(1000, 9999)} {r.randint(10, 99)}",
    "ssn": lambda r: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
    "email": lambda r: "".join(r.choice("abcxyz") for _ in range(r.randint(1, 9))) + f".{r.randint(0, 99):02d}@mail{r.randint(0, 9)}.example.com",
    "aws_key": lambda r: "AKIA" + "".join(r.choice(pii.UPPER36) for _ in range(16)),
    "secret": lambda r: "password=" + "".join(r.choice(pii.HEX) for _ in range(18)),
    "hex_token": lambda r: "".join(r.choice(pii.HEX) for _ in range(40)),
}


@pytest.fixture(scope="module")
def replaced(spark):
    rng = random.Random(1)
    values = {(k, make(rng)) for k, make in MAKE.items() for _ in range(60)}
    docs = spark.createDataFrame([(i, f"Élan {v}, and {v}\nx 𝒳 ", k) for i, (k, v) in enumerate(sorted(values))], "doc_id bigint, text string, __found string")
    return pii.pseudonymized(docs, "k1").collect()


def shape(text):
    return re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", text)))


def sha(*parts):
    import hashlib

    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def feistel(a, b, even, odd, key, tweak):
    for r in range(pii.ROUNDS):
        size = even if r % 2 == 0 else odd
        a, b = b, (a + sha(key, tweak, r, b) % size) % size
    return a, b


def run_of(run, alphabet, key, tweak):
    """Piece by piece, each cut in two halves that are numbers in the base of the alphabet."""
    size, radix, out = 24 if len(alphabet) <= 26 else 22, len(alphabet), ""

    def number(s):
        return sum(alphabet.index(c) * radix**k for k, c in enumerate(reversed(s)))

    def spelled(v, n):
        return "".join(alphabet[v // radix**k % radix] for k in reversed(range(n)))

    for k in range(0, len(run), size):
        piece = run[k : k + size]
        half = len(piece) // 2
        a, b = feistel(number(piece[:half]), number(piece[half:]), radix**half, radix ** (len(piece) - half), key, f"{tweak}|{k // size}|{radix}|{len(piece)}")
        out += spelled(a, half) + spelled(b, len(piece) - half)
    return out


def within(text, alphabet, key, tweak):
    moved = iter(run_of("".join(c for c in text if c in alphabet), alphabet, key, tweak))
    return "".join(next(moved) if c in alphabet else c for c in text)


def refill(value, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in value)


def square(n, size, key, tweak):
    a, b = feistel(n // size, n % size, size, size, key, tweak)
    return a * size + b


def brute_phone(value, key):
    digits = re.sub(r"\D", "", value)
    n = ((int(digits[-10:-7]) - 200) * 800 + int(digits[-7:-4]) - 200) * 10_000 + int(digits[-4:])
    n = square(n, 80_000, key, "phone")
    return refill(value, digits[:-10] + f"{n // 8_000_000 + 200}{n // 10_000 % 800 + 200}{n % 10_000:04d}")


def brute_date(value, form, key):
    from datetime import datetime

    first = date(1900, 1, 1)
    n = (datetime.strptime(value, form).date() - first).days
    while True:
        n = square(n, pii.DAY_SIDE, key, "date")
        if n < pii.DAYS:
            return (first + timedelta(n)).strftime(form)


def brute(kind, value, key):
    """An independent pseudonym of a valid value."""
    if kind == "card":
        run = run_of(value[:-1], "0123456789", key, "card")
        return next(run + c for c in "0123456789" if luhn(run + c))
    if kind == "iban":
        rest = within(within(value[4:], "0123456789", key, "iban"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", key, "iban")
        return f"{value[:2]}{98 - mod97(rest + value[:2] + '00'):02d}{rest}"
    if kind == "ipv4":
        n = 0
        for x in value.split("."):
            n = n * 256 + int(x)
        n = square(n, 1 << 16, key, "ipv4")
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind in ("date_ymd", "date_dmy"):
        return brute_date(value, "%Y-%m-%d" if kind == "date_ymd" else "%d/%m/%Y", key)
    if kind == "phone":
        return brute_phone(value, key)
    if kind == "phone_intl":
        return refill(value, "49" + run_of(re.sub(r"\D", "", value)[2:], "0123456789", key, "phone_intl|49"))
    if kind == "ssn":
        area, rest = int(value[:3]), (int(value[4:6]) - 1) * 9999 + int(value[7:]) - 1
        a, b = feistel(area - (2 if area > 666 else 1), rest, 898, 99 * 9999, key, "ssn")
        return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind == "email":
        local, domain = value.split("@")
        moved = within(within(local.lower(), pii.LETTERS, key, "email"), "0123456789", key, "email")
        return "".join(n.upper() if o.isupper() else n for n, o in zip(moved, local, strict=True)) + "@" + domain
    if kind == "aws_key":
        return value[:4] + within(value[4:], pii.UPPER36, key, "aws_key")
    name, own = value.split("=") if kind == "secret" else ("", value)
    moved = within(own.lower(), pii.HEX, key, "secret")
    return (f"{name}=" if name else "") + (moved.upper() if own.upper() == own and own.lower() != own else moved)


def test_matches_brute_force(replaced):
    seen = set()
    for row in replaced:
        for x in row["__replaced"]:
            assert x.new == brute(x.kind, x.old, "k1"), x
            seen.add(x.kind)
    assert seen == MAKE.keys()


def test_one_value_in_many_spellings(spark):
    """One number, date or mailbox has one pseudonym, whatever it looks like."""
    groups = {
        "phone": ["+1 212-555-0123", "+12125550123", "+1 2125550123", "(212) 555-0123", "212.555.0123", "1-212-555-0123", "+1 (212) 555 0123"],
        "intl": ["+351 912 345 678", "+351912345678", "+351-912-345-678"],
        "date": ["1990-12-25", "1990/12/25", "25/12/1990", "25.12.1990", "12/25/1990"],
        "email": ["jane.doe1@example.org", "Jane.Doe1@example.org", "JANE.DOE1@example.org"],
        "secret": ["token=deadbeef01234567", "token=DEADBEEF01234567"],
    }
    values = [(g, v) for g, vs in groups.items() for v in vs]
    docs = spark.createDataFrame([(i, f"see {v} now", g) for i, (g, v) in enumerate(values)], "doc_id bigint, text string, g string")
    rows = {r.doc_id: r for r in pii.pseudonymized(docs, "k").collect()}
    canonical = {}
    for i, (g, old) in enumerate(values):
        new = rows[i].text[4:-4]
        assert new != old and shape(new).lower() == shape(old).lower() or g == "secret"
        digits = re.sub(r"\D", "", new)
        if g == "phone":
            assert 2 <= int(digits[-10]) and 2 <= int(digits[-7])
            digits = digits[-10:]
        if g == "date":
            parts = re.split(r"\D", new)
            digits = "".join(parts if len(parts[0]) == 4 else (parts[2], parts[0], parts[1]) if old == "12/25/1990" else parts[::-1])
        canonical.setdefault(g, set()).add(digits if g in ("phone", "intl", "date") else new.lower())
        if g == "email":
            assert [c.isupper() for c in new] == [c.isupper() for c in old]
    assert all(len(x) == 1 for x in canonical.values()), canonical


def test_social_security_numbers_stay_valid(spark):
    rng = random.Random(2)
    olds = {f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(500)} | {"001-01-0001", "899-99-9999", "665-01-0001", "667-01-0001"}
    docs = spark.createDataFrame(list(enumerate(sorted(olds))), "doc_id bigint, text string")
    news = [r.text for r in pii.pseudonymized(docs, "k").collect()]
    assert len(set(news)) == len(olds) and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", n) for n in news)


def test_long_secrets_and_letters_of_ibans(spark):
    secret_, gb = "ab12" * 100, f"GB{98 - mod97('NWBK60161331926819GB00'):02d}NWBK60161331926819"
    docs = spark.createDataFrame([(0, f"api_key: {secret_}"), (1, gb), (2, f"AKIA{'Z' * 16}")], "doc_id bigint, text string")
    rows = [r.text for r in pii.pseudonymized(docs, "k").orderBy("doc_id").collect()]
    assert rows[0] != f"api_key: {secret_}" and len(rows[0]) == 409
    assert mod97(rows[1][4:] + rows[1][:4]) == 1 and rows[1][4:8] != "NWBK" and shape(rows[1]) == shape(gb)
    assert re.fullmatch("AKIA[A-Z0-9]{16}", rows[2])


def test_formats_and_links(replaced):
    pairs = {}
    for row in replaced:
        assert len(row["__replaced"]) in (0, 2), row
        for x in row["__replaced"]:
            assert x.kind == row["__found"]
            pairs.setdefault(x.kind, {}).setdefault(x.old, set()).add(x.new)
            assert row.text == f"Élan {x.new}, and {x.new}\nx 𝒳 "
    assert pairs.keys() == MAKE.keys()
    for kind, olds in pairs.items():
        assert len(olds) >= 55 and all(len(n) == 1 for n in olds.values())
        news = [next(iter(n)) for n in olds.values()]
        assert len(set(news)) == len(news)
        for old, new in zip(olds, news, strict=True):
            assert re.fullmatch(pii.KINDS[kind].replace(r"\x22", '"'), new), (kind, new)
            if kind in ("card", "phone", "ssn", "iban", "date_ymd", "date_dmy", "phone_intl"):
                assert shape(old) == shape(new)
            if kind == "card":
                assert luhn(new)
            if kind == "iban":
                assert mod97(new[4:] + new[:4]) == 1
            if kind == "ipv4":
                assert all(int(x) < 256 for x in new.split("."))
            if kind == "date_ymd":
                assert 1900 <= date.fromisoformat(new).year < 2100


@pytest.mark.parametrize(("size", "n"), [(3, 9), (271, 271**2)])
def test_numbers_are_permuted(spark, size, n):
    rows = spark.range(n).select(pii.number_in(F.col("id"), size, "k", "t").alias("x")).distinct()
    assert rows.count() == n and rows.agg(F.min("x"), F.max("x")).first() == (0, n - 1)


def test_runs_are_permuted(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v")).select(pii.permuted(F.col("v"), pii.DIGITS, "k", F.lit("t")).alias("x"))
    assert sorted(r.x for r in rows.collect()) == [f"{i:03d}" for i in range(1000)]


def test_left_alone(spark):
    texts = [None, "", "plain words", "4041894974608796", "999.1.1.1", "2023-02-30", "000-12-3456", "1.2.3.4.5", "DE00 1234 5678 9012 3456 78", "v" * 200_000, "12 34"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "a@b.co", 1)], "doc_id bigint, text string, kind int")
    rows = {r.doc_id: r for r in pii.pseudonymized(docs, "k").collect()}
    assert [rows[i].text for i in range(len(texts))] == texts and all(not rows[i]["__replaced"] for i in range(len(texts)))
    assert rows[None].text.endswith("@b.co") and rows[None].kind == 1
    assert pii.pseudonymized(docs.limit(0), "k").count() == 0


def test_values_among_digits_and_capitals(spark):
    card_, spaced, be, at = "4111111111111111", "4111 1111 1111 1111", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201"
    texts = [f"{card_}.", f"{spaced} 12/27", f"{card_} 123", f"{card_} 12", f"12 {spaced}", f"{be} EUR 500", f"{at} BIC", f"{be}.", f"{at}."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r.text for r in pii.pseudonymized(docs, "k").collect()}
    new, new_be, new_at = rows[0][:-1], rows[7][:-1], rows[8][:-1]
    new_spaced = " ".join(new[i : i + 4] for i in range(0, 16, 4))
    assert luhn(new) and new != card_ and new_be != be and new_at != at
    assert [rows[i] for i in range(1, 7)] == [f"{new_spaced} 12/27", f"{new} 123", f"{new} 12", f"12 {new_spaced}", f"{new_be} EUR 500", f"{new_at} BIC"]


def test_keys_differ(spark):
    docs = spark.createDataFrame([(1, "4041894974608795 42.144.35.254")], "doc_id bigint, text string")
    assert len({pii.pseudonymized(docs, k).first().text for k in ("a", "b")}) == 2


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    plan = pii.pseudonymized(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
