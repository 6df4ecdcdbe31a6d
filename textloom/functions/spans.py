"""Places of matches as expressions, without Python.

Spark has no function for the places of all matches. The pieces between matches and the matches themselves have lengths
whose running sums are the places; those are taken by doubling: each round adds to every sum the one that ends where it begins.
Places count characters from 0, ends are exclusive.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import annotations as A
from .text import LEXICAL, PARAGRAPH_BREAK, ensured, let

NO_SUMS = "CAST(array() AS array<int>)"


def running(values: Column) -> Column:
    """The sum of the values before each one, as an array of int."""

    def added(sums: Column, k: Column) -> Column:
        """To each sum of 2 ** k values that of the 2 ** k values before them."""
        before = lambda d: F.concat(F.array_repeat(F.lit(0), d), F.slice(sums, F.lit(1), F.size(sums) - d))
        return let(F.call_function("shiftleft", F.lit(1), k), lambda d: F.when(d < F.size(sums), F.zip_with(sums, before(d), lambda x, y: x + y)).otherwise(sums))

    def summed(v: Column) -> Column:
        shifted = F.concat(F.array(F.lit(0)), F.slice(v, F.lit(1), F.size(v) - 1))
        rounds = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(v).cast("double"))).cast("int") - 1))
        return F.when(F.size(v) > 0, F.aggregate(rounds, shifted, added)).otherwise(F.expr(NO_SUMS))

    return let(values, summed)


def spans(text: Column, pattern: str | Column) -> Column:
    """start, end and text of all matches of a pattern, each of which has one character at least."""
    of = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(x: Column) -> Column:
        between = F.transform(F.slice(x["pieces"], F.lit(1), F.size(x["matches"])), F.length)
        steps = F.zip_with(between, x["matches"], lambda g, m: g + F.length(m))
        starts = F.zip_with(running(steps), between, lambda s, g: s + g)
        return F.zip_with(starts, x["matches"], lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("text")))

    return let(text, lambda t: let(F.struct(F.split(t, of, -1).alias("pieces"), F.regexp_extract_all(t, of, F.lit(0)).alias("matches")), placed))


def exploded(docs: DataFrame, key: Column, found: Column) -> DataFrame:
    """key and x, a row for each element of an array that is costly to make.

    The plain explode lets the optimizer filter by the array's size, which makes it once more; the outer one does not.
    """
    return docs.select(key, F.explode_outer(found).alias("x")).where("x IS NOT NULL")


def token_spans(text: Column) -> Column:
    """start, end and text (in lower case) of the lexical tokens."""
    return F.transform(spans(text, LEXICAL), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(x["text"]).alias("text")))


def stripped(piece: Column, start: Column) -> Column:
    """start, end and text of a piece without white space at its ends."""
    left = lambda p: F.when(F.substring(p, 1, 1).rlike(r"(?U)\s"), F.regexp_replace(p, r"(?U)^\s+", "")).otherwise(p)
    right = lambda t: F.when(F.substring(t, -1, 1).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)(?<!\s)\s+$", "")).otherwise(t)
    of_text = lambda lead, inner: F.struct(lead.alias("start"), (lead + F.length(inner)).alias("end"), inner.alias("text"))
    return let(left(piece), lambda t: let(right(t), lambda inner: of_text(start + F.length(piece) - F.length(t), inner)))


def pieces_of(text: Column, separator: str) -> Column:
    """start and text of the pieces between the matches of a separator, ends included."""

    def placed(x: Column) -> Column:
        ends = F.concat(F.transform(x["separators"], F.length), F.array(F.lit(0)))
        steps = F.zip_with(x["pieces"], ends, lambda p, n: F.length(p) + n)
        return F.zip_with(running(steps), x["pieces"], lambda s, p: F.struct(s.alias("start"), p.alias("text")))

    return let(text, lambda t: let(F.struct(F.split(t, separator, -1).alias("pieces"), F.regexp_extract_all(t, F.lit(separator), F.lit(0)).alias("separators")), placed))


def paragraph_spans(text: Column) -> Column:
    """start, end and text of the paragraphs, without white space at their ends; empty ones are left out."""
    return F.filter(F.transform(pieces_of(text, PARAGRAPH_BREAK), lambda p: stripped(p["text"], p["start"])), lambda p: p["text"] != "")


def sentence_spans(text: Column) -> Column:
    """start, end and text of the sentences, without white space at their ends; empty ones are left out."""
    from .text import SENTENCE

    return F.filter(F.transform(spans(text, SENTENCE), lambda s: stripped(s["text"], s["start"])), lambda s: s["text"] != "")


#: Between items of a sentence, and between sentences with the white space at their ends; a comma before such an end separates nothing.
ITEM_BREAK = r"(?U),(?! \|\| ) (?!\s*(?:\z| \|\| ))|(?<!\s)(?:\s* \|\| )+\s*|\A\s+|(?<!\s)\s+\z"


def tag_spans(column: Column) -> Column:
    """word, tag, feats, and start and end of the word in the serialized column, of every well-formed item."""

    placed = F.transform(pieces_of(ensured(column), ITEM_BREAK), lambda x: F.struct(x["start"].alias("start"), F.length(x["text"]).alias("n"), x["text"].alias("item"), A.rest_of(x["text"]).alias("rest")))
    good = F.filter(placed, lambda x: A.fits(x["n"], x["rest"], A.POS_REST))
    size = lambda x: x["n"] - F.length(x["rest"]) - 3
    feats = lambda x: F.array_remove(F.split(A.feats_of(x["rest"]), r"\|"), "")
    return F.transform(good, lambda x: F.struct(F.substring(x["item"], F.lit(1), size(x)).alias("word"), A.tag_of(x["rest"]).alias("tag"), feats(x).alias("feats"), x["start"].alias("start"), (x["start"] + size(x)).alias("end")))


def entity_spans(column: Column) -> Column:
    """kind, and start, end and text of the words, of every entity of the serialized column."""
    inner = lambda x, k: F.substring(x["text"], F.length(k) + 2, F.length(x["text"]) - F.length(k) - 2)
    kind = lambda x: F.substring_index(x["text"], "(", 1)
    return F.transform(spans(ensured(column), A.NER_ITEM), lambda x: F.struct(kind(x).alias("kind"), (x["start"] + F.length(kind(x)) + 1).alias("start"), (x["end"] - 1).alias("end"), inner(x, kind(x)).alias("text")))
