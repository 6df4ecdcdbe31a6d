"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

Validated values are permuted within their format, so equal values stay equal in all documents and different ones
stay different: card numbers (Luhn) and IBANs (mod 97) keep their check digits valid, dates stay dates of 1900-2099,
North American telephone numbers keep valid area codes and exchanges, social security numbers stay valid, IPv4 addresses
stay addresses, and letters, digits and punctuation of all others keep their kinds and places. What is permuted is one
canonical value however it is spelled: the ten digits of a North American number with or without its 1 and whatever stands
between them, the digits behind the country code of other numbers, the day of a date, the lower-case form of a mailbox or
secret (whose new letters take the case of the old ones). A date with slashes is day, month, year, or if that is no date
month, day, year. Values that fail their check are left alone. Where
other digits or capitals follow or precede a card number or an IBAN, the match holds them too; so if it fails as a
whole, its groups are tried, and the first valid number in it is replaced (old and new of it are the whole match).

The matches of one pattern and the text between them are taken apart, each match is replaced and the parts joined.
A network is a fold over its rounds; the round function is a piece of SHA-256 of key, format, round and half.

Cases: a null text stays null; an empty one stays empty; other columns, whatever their names, are kept by
pseudonymized(); an empty table gives an empty one. All of it is DataFrame functions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free

ROUNDS = 10
DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
UPPER36 = DIGITS + LETTERS.upper()
#: Longer runs are permuted by pieces, so that the sum of two halves fits 63 bits: of alphabets up to 26, and of larger ones.
PIECE, SHORT_PIECE = 24, 22

#: Kinds in the order in which they are tried, each with its pattern; no capturing groups.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,7}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api_?key)\w{0,20} ?[=:] ?\x22?[0-9a-f]{12,}(?![0-9a-z]))",
    "hex_token": r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32})(?![0-9A-Za-z])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date_ymd": r"(?<![0-9/.-])[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{2}(?![0-9/-])",
    "date_dmy": r"(?<![0-9/.-])[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{4}(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
    "phone_intl": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
PATTERN = "|".join(KINDS.values())


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(items: Column, start: Column, step, end=None) -> Column:
    return F.aggregate(items, start, step, end) if end else F.aggregate(items, start, step)


def rounds(a: Column, b: Column, even: Column, odd: Column, key: str, tweak: Column, end) -> Column:
    """end of the two halves after ROUNDS rounds: each adds a keyed hash of one half to the other and swaps them.

    even and odd are the sizes of the first half's and the second half's ranges; the number of rounds is even, so
    both halves are back in their own ranges at the end.
    """

    def step(s: Column, r: Column) -> Column:
        size = F.when(r % 2 == 0, even).otherwise(odd)
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), s["b"].cast("string")), 256)
        mixed = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(mixed, size), size).alias("b"))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return fold(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, end)


def number_in(a: Column, size: int, key: str, tweak: str) -> Column:
    """A permutation of 0 .. size * size - 1 at the number a."""
    return rounds(F.floor(a / size).cast("bigint"), F.pmod(a, F.lit(size)), F.lit(size), F.lit(size), key, F.lit(tweak), lambda s: s["a"] * size + s["b"])


def characters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def permuted_run(run: Column, alphabet: str, key: str, tweak: Column) -> Column:
    """run, all of alphabet and PIECE characters at most, permuted among the runs of its length."""
    radix = len(alphabet)
    value = lambda s: F.when(F.length(s) > 0, fold(characters(s), F.lit(0).cast("bigint"), lambda v, c: v * radix + (F.instr(F.lit(alphabet), c) - 1))).otherwise(F.lit(0).cast("bigint"))
    power = lambda n: F.when(n > 0, fold(F.sequence(F.lit(1), n), F.lit(1).cast("bigint"), lambda v, _: v * radix)).otherwise(F.lit(1).cast("bigint"))

    def spelled(v: Column, n: Column) -> Column:
        last = lambda s: F.struct(F.floor(s["v"] / radix).cast("bigint").alias("v"), F.concat(F.substring(F.lit(alphabet), (s["v"] % radix).cast("int") + 1, F.lit(1)), s["out"]).alias("out"))
        start = F.struct(v.alias("v"), F.lit("").alias("out"))
        return F.when(n > 0, fold(F.sequence(F.lit(1), n), start, lambda s, _: last(s), lambda s: s["out"])).otherwise("")

    half = F.floor(F.length(run) / 2).cast("int")
    rest = F.length(run) - half
    a, b = value(F.substring(run, F.lit(1), half)), value(F.substring(run, half + 1, rest))
    label = F.concat_ws("|", tweak, F.lit(radix), F.length(run).cast("string"))
    return F.when(F.length(run) == 0, "").otherwise(rounds(a, b, power(half), power(rest), key, label, lambda s: F.concat(spelled(s["a"], half), spelled(s["b"], rest))))


def permuted(run: Column, alphabet: str, key: str, tweak: Column) -> Column:
    """run permuted piece by piece, each piece by its place."""
    size = PIECE if len(alphabet) <= len(LETTERS) else SHORT_PIECE
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(run), F.lit(1)) - 1) / size).cast("int")), lambda k: F.struct(k.alias("k"), F.substring(run, k * size + 1, F.lit(size)).alias("s")))
    return F.array_join(F.transform(pieces, lambda p: permuted_run(p["s"], alphabet, key, F.concat_ws("|", tweak, p["k"].cast("string")))), "")


def refilled(shape: Column, alphabet: str, run: Column) -> Column:
    """shape with its characters of alphabet replaced by those of run in turn."""

    def step(s: Column, c: Column) -> Column:
        own = F.instr(F.lit(alphabet), c) > 0
        return F.struct(F.when(own, s["at"] + 1).otherwise(s["at"]).alias("at"), F.concat(s["out"], F.when(own, F.substring(run, s["at"], F.lit(1))).otherwise(c)).alias("out"))

    return fold(characters(shape), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])


def kept(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"[^{pattern}]", "")


def permute_within(text: Column, alphabet: str, of: str, key: str, tweak: str) -> Column:
    """text with its characters of alphabet (a character class: of) permuted, the others in their places."""
    return let(permuted(kept(text, of), alphabet, key, F.lit(tweak)), lambda run: refilled(text, alphabet, run))


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum by Luhn of a run of digits, of which every other is doubled, the last one first if so asked."""
    odd = 0 if double_last else 1
    values = F.transform(F.reverse(characters(digits)), lambda c, i: F.when(i % 2 == odd, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return fold(values, F.lit(0), lambda s, x: s + x)


def replaced_at(value: Column, span: Column, renumbered) -> Column:
    """value with renumbered(its part of span(first, last)); value itself where span is null."""
    part = lambda at: F.concat(
        F.substring(value, F.lit(1), at["first"] - 1), renumbered(F.substring(value, at["first"], at["last"] - at["first"] + 1)), F.substring(value, at["last"] + 1, F.length(value))
    )
    return let(span, lambda at: F.when(at.isNull(), value).otherwise(part(at)))


def group_ends(value: Column, step: int) -> Column:
    """Places in value of the last (step 1) or first (step -1) character of each run of letters and digits."""
    own = lambda i: F.substring(value, i, F.lit(1)).rlike("[0-9A-Z]")
    outside = lambda i: (i < 1) | (i > F.length(value)) | ~own(i)
    return F.filter(F.sequence(F.lit(1), F.length(value)), lambda i: own(i) & outside(i + step))


def span_of(first: Column, last: Column) -> Column:
    return F.struct(first.alias("first"), last.alias("last"))


def card(value: Column, key: str) -> Column:
    """The match as a whole, or else its first part from group to group, longest first, that passes."""

    def renumbered(own: Column) -> Column:
        def with_check(run: Column) -> Column:
            return refilled(own, DIGITS, F.concat(run, F.pmod(-luhn_sum(run, True), F.lit(10)).cast("string")))

        digits = kept(own, "0-9")
        return let(permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), DIGITS, key, F.lit("card")), with_check)

    def passes(own: Column) -> Column:
        return let(kept(own, "0-9"), lambda digits: F.when(F.length(digits).between(13, 19), luhn_sum(digits, False) % 10 == 0).otherwise(False))

    spans = F.flatten(F.transform(group_ends(value, -1), lambda first: F.transform(F.reverse(group_ends(value, 1)), lambda last: span_of(first, last))))
    within = F.filter(spans, lambda x: (x["last"] - x["first"] >= 12) & passes(F.substring(value, x["first"], x["last"] - x["first"] + 1)))
    return replaced_at(value, F.when(passes(value), span_of(F.lit(1), F.length(value))).otherwise(F.get(within, F.lit(0))), renumbered)


def mod97(text: Column) -> Column:
    """The remainder by 97 of text with letters as 10 to 35."""
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return fold(characters(text), F.lit(0), lambda r, c: step(r, c).cast("int"))


#: Characters of an IBAN by country.
IBAN_LENGTHS = "NO15 BE16 DK18 FI18 FO18 GL18 NL18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 AE23 GI23 IL23 IQ23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 PT25 IS26 TR26 FR27 GR27 IT27 MC27 MR27 SM27 AL28 AZ28 BY28 CY28 DO28 GT28 HU28 LB28 PL28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 MT31 SC31"


def iban(value: Column, key: str) -> Column:
    """The match up to the end of a group where the country's length is reached, or else the longest that passes."""
    bare_of = lambda own: F.replace(own, F.lit(" "), F.lit(""))

    def renumbered(own: Column) -> Column:
        bare = bare_of(own)
        country = F.substring(bare, 1, 2)

        def with_check(new: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            return refilled(own, UPPER36, F.concat(country, check, new))

        digits = permute_within(F.substring(bare, F.lit(5), F.length(bare) - 4), DIGITS, "0-9", key, "iban")
        return let(let(digits, lambda x: permute_within(x, LETTERS.upper(), "A-Z", key, "iban")), with_check)

    def passes(own: Column) -> Column:
        valid = lambda bare: mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare) - 4), F.substring(bare, 1, 4))) == 1
        return let(bare_of(own), lambda bare: F.when(F.length(bare).between(15, 34), valid(bare)).otherwise(False))

    at = F.instr(F.lit(IBAN_LENGTHS), F.substring(value, 1, 2))
    usual = F.when(at > 0, F.substring(F.lit(IBAN_LENGTHS), at + 2, F.lit(2)).cast("int")).otherwise(0)
    ends = F.reverse(group_ends(value, 1))
    ordered = F.concat(F.filter(ends, lambda e: F.length(bare_of(F.substring(value, F.lit(1), e))) == usual), ends)
    last = F.get(F.filter(ordered, lambda e: passes(F.substring(value, F.lit(1), e))), F.lit(0))
    return replaced_at(value, let(last, lambda e: F.when(e.isNotNull(), span_of(F.lit(1), e))), renumbered)


def ipv4(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("bigint"))
    whole = fold(octets, F.lit(0).cast("bigint"), lambda v, x: v * 256 + x)
    spelled = lambda n: F.concat_ws(".", *(F.pmod(F.floor(n / (1 << s)).cast("bigint"), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))
    return F.when(F.array_max(octets) <= 255, let(number_in(whole, 1 << 16, key, "ipv4"), spelled)).otherwise(value)


#: Days from 1900-01-01 to 2099-12-31, and a square that holds them.
DAYS, DAY_SIDE = 73_049, 271


def date(value: Column, form: str, key: str) -> Column:
    day = F.try_to_timestamp(value, F.lit(form)).cast("date")
    number = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("bigint")
    again = lambda n, step: F.when((step == 0) | (n >= DAYS), number_in(n, DAY_SIDE, key, "date")).otherwise(n)
    moved = fold(F.sequence(F.lit(0), F.lit(DAY_SIDE**2 - DAYS)), number, again)  # walks at most once over what is no day
    return F.when(number.between(0, DAYS - 1), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), moved.cast("int")), form)).otherwise(value)


def phone(value: Column, key: str) -> Column:
    """Area code and exchange stay from 200 to 999, so both halves of the network have 80,000 values."""

    def renumbered(ten: Column) -> Column:
        part = lambda at, n: F.substring(ten, at, n).cast("bigint")
        value_of = ((part(1, 3) - 200) * 800 + part(4, 3) - 200) * 10_000 + part(7, 4)
        spelled = lambda n: F.concat((F.floor(n / 8_000_000) + 200).cast("string"), (F.floor(n / 10_000).cast("bigint") % 800 + 200).cast("string"), F.lpad((n % 10_000).cast("string"), 4, "0"))
        return let(number_in(value_of, 80_000, key, "phone"), spelled)

    all_digits = kept(value, "0-9")
    prefix = F.when(F.length(all_digits) > 10, F.substring(all_digits, F.lit(1), F.length(all_digits) - 10)).otherwise("")
    return let(F.concat(prefix, renumbered(F.right(all_digits, F.lit(10)))), lambda run: refilled(value, DIGITS, run))


#: The country codes of one and two digits; all others have three.
COUNTRY_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def phone_intl(value: Column, key: str) -> Column:
    """A North American number as phone() has it; of others the digits behind the country code are permuted."""

    def renumbered(digits: Column) -> Column:
        code = F.regexp_extract(digits, COUNTRY_CODE, 0)
        rest = F.substring(digits, F.length(code) + 1, F.length(digits))
        return F.concat(code, permuted(rest, DIGITS, key, F.concat_ws("|", F.lit("phone_intl"), code)))

    digits = kept(value, "0-9")
    abroad = let(let(digits, renumbered), lambda run: refilled(value, DIGITS, run))
    return F.when(digits.rlike("^1[2-9][0-9]{2}[2-9][0-9]{6}$"), phone(value, key)).otherwise(abroad)


#: Valid first parts of a social security number (001 to 899 without 666), and values of the other two parts.
SSN_AREAS, SSN_REST = 898, 99 * 9999


def ssn(value: Column, key: str) -> Column:
    """The number's place among all valid ones is permuted, so that it stays valid."""
    part = lambda at, n: F.substring(value, at, n).try_cast("bigint")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)

    def spelled(s: Column) -> Column:
        first = s["a"] + F.when(s["a"] >= 665, 2).otherwise(1)
        number = lambda x, n: F.lpad(x.cast("bigint").cast("string"), n, "0")
        return F.concat_ws("-", number(first, 3), number(F.floor(s["b"] / 9999) + 1, 2), number(s["b"] % 9999 + 1, 4))

    moved = rounds(area, (part(5, 2) - 1) * 9999 + part(8, 4) - 1, F.lit(SSN_AREAS), F.lit(SSN_REST), key, F.lit("ssn"), spelled)
    return F.when(value.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}$"), moved).otherwise(value)


def cased(new: Column, old: Column) -> Column:
    """new with capitals where old has them."""
    return F.array_join(F.zip_with(characters(new), characters(old), lambda a, b: F.when(b.rlike("[A-Z]"), F.upper(a)).otherwise(a)), "")


def email(value: Column, key: str) -> Column:
    """The letters and digits before the @ are permuted in their lower-case form and take their case again; the domain stays."""
    own = F.substring_index(value, "@", 1)
    letters = permute_within(F.lower(own), LETTERS, "a-z", key, "email")
    both = let(letters, lambda x: permute_within(x, DIGITS, "0-9", key, "email"))
    return F.concat(let(both, lambda x: F.when(own.rlike("[A-Z]"), cased(x, own)).otherwise(x)), F.lit("@"), F.substring_index(value, "@", -1))


def secret(value: Column, key: str) -> Column:
    """The hexadecimal digits are permuted in their lower-case form; capitals stay capitals if all letters are."""
    name = F.regexp_extract(value, r"^[^=:]{1,40}[=: \x22]+", 0)
    own = F.substring(value, F.length(name) + 1, F.length(value))
    moved = permute_within(F.lower(own), HEX, "0-9a-f", key, "secret")
    return F.concat(name, let(moved, lambda x: F.when(own.rlike("[A-F]") & ~own.rlike("[a-f]"), F.upper(x)).otherwise(x)))


def dated(value: Column, forms: tuple[str, ...], key: str) -> Column:
    """The date in the first of forms in which it is one."""
    out = value
    for form in reversed(forms):
        out = F.when(F.try_to_timestamp(value, F.lit(form)).isNotNull(), date(value, form, key)).otherwise(out)
    return out


PSEUDONYMS = {
    "email": email, "iban": iban, "secret": secret, "ipv4": ipv4, "ssn": ssn, "phone": phone, "phone_intl": phone_intl, "card": card,
    "aws_key": lambda v, key: F.concat(F.substring(v, 1, 4), permute_within(F.substring(v, 5, 16), UPPER36, "0-9A-Z", key, "aws_key")),
    "hex_token": lambda v, key: permute_within(v, HEX, "0-9a-f", key, "secret"),
    "date_ymd": lambda v, key: dated(v, ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd"), key),
    "date_dmy": lambda v, key: dated(v, ("dd/MM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy"), key),
}


def kind_of(value: Column) -> Column:
    """The name of the first pattern that value matches whole."""
    found = F.lit(None).cast("string")
    for name in reversed(KINDS):
        found = F.when(value.rlike(f"^(?:{KINDS[name]})$"), name).otherwise(found)
    return found


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    out = value
    for name in reversed(KINDS):
        out = F.when(kind == name, PSEUDONYMS[name](value, key)).otherwise(out)
    return out


def pseudonymized(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in their texts, and __replaced beside their columns: kind, old and new of each value replaced.

    Where docs has a column of that name, the new one takes more underscores; it holds what must not leave the job; drop it, or count it, before texts are released.
    """
    text = F.col(text_col)
    at, replaced = free(docs, "__found", "__replaced")
    matches = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda v: F.struct(v.alias("old"), kind_of(v).alias("kind")))
    marked = docs.withColumn(at, matches)
    new = F.transform(at, lambda x: F.struct(x["kind"].alias("kind"), x["old"].alias("old"), pseudonym(x["old"], x["kind"], key).alias("new")))
    marked = marked.withColumn(at, F.when(F.size(at) > 0, new).otherwise(F.expr("CAST(array() AS array<struct<kind:string,old:string,new:string>>)")))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, PATTERN), F.col(at)["new"], lambda gap, x: F.array(gap, F.coalesce(x, F.lit(""))))), "")
    own = [F.col(c) if c != text_col else F.when(F.size(at) > 0, joined).otherwise(text).alias(text_col) for c in docs.columns]
    return marked.select(*own, F.filter(at, lambda x: x["old"] != x["new"]).alias(replaced))
