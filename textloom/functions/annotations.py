"""Serialized annotations as arrays of structs.

tagged_pos: word__(TAG) or word__(TAG)(A=x|B=y), items by ", ", sentences by " || "; tagged_dep: word__(relation)(head),
heads from 1, 0 the root; tagged_ner: TYPE(text). Malformed items are left out.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ensured, let, trimmed

POS_ITEM = r"(?s)^(.+)__\(([^()]*)\)(?:\(([^()]*)\))?$"
DEP_ITEM = r"(?s)^(.+)__\(([^()]*)\)\((\d+)\)$"
NER_ITEM = r"([A-Z]+)\((.*?)\)"


#: What stands behind the last "__(" of a well-formed item.
POS_REST = r"^[^()]*\)(?:\([^()]*\))?$"
DEP_REST = r"^[^()]*\)\(\d+\)$"


def edge_trimmed(text: Column) -> Column:
    """trimmed(), which reads all of the text, only where white space stands at an end; text is evaluated more than once."""
    return F.when(F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1)).rlike(r"(?U)\s"), trimmed(text)).otherwise(text)


def tagged_sentences(column: Column) -> Column:
    return F.filter(F.transform(F.split(ensured(column), r" \|\| "), edge_trimmed), lambda s: s != "")


def items_of(sentence: Column) -> Column:
    return F.split(sentence, ", ")


def rest_of(item: Column) -> Column:
    return F.substring_index(item, "__(", -1)


def fits(n: Column, rest: Column, pattern: str) -> Column:
    """Whether an item of n characters has a word, and rest (behind its last "__(") is as the pattern says."""
    return (n > F.length(rest) + 3) & rest.rlike(pattern)


def tag_of(rest: Column) -> Column:
    return F.substring_index(rest, ")", 1)


def feats_of(rest: Column) -> Column:
    """The feats as they stand, empty if there are none."""
    return F.when(rest.contains("("), F.substring_index(F.substring_index(rest, "(", -1), ")", 1)).otherwise("")


def well_formed(items: Column) -> Column:
    """item and rest of the items that are well-formed tags."""
    return F.filter(F.transform(items, lambda x: F.struct(x.alias("item"), rest_of(x).alias("rest"))), lambda x: fits(F.length(x["item"]), x["rest"], POS_REST))


#: The end of an item that is surely well-formed: tag and feats behind a word, and behind them a separator or the end.
POS_END = r"__\((?<=[^\s,|]__\()[^()]*\)(?:\([^()]*\))?(?=, | \|\| |\z)"


def well_formed_items(column: Column) -> Column:
    """The well-formed tag items as they stand, sentence by sentence in one array.

    An item ends once, so where there are as many sure ends as items all are well-formed; else each is looked at.
    """
    every = F.flatten(F.transform(tagged_sentences(column), items_of))
    good = lambda items: F.filter(items, lambda x: x.rlike(POS_ITEM))
    return let(every, lambda items: F.when(F.regexp_count(ensured(column), F.lit(POS_END)) == F.size(items), items).otherwise(good(items)))


def pos_items(column: Column, begin: str = "") -> Column:
    """word, tag and feats (as they stand: A=x|B=y) of every well-formed item, sentence by sentence in one array.

    Items that a pattern begin does not find are left out before they are taken apart.
    """
    word = lambda x: F.substring(x["item"], F.lit(1), F.length(x["item"]) - F.length(x["rest"]) - 3)
    every = F.flatten(F.transform(tagged_sentences(column), items_of))
    good = well_formed(F.filter(every, lambda x: x.rlike(begin)) if begin else every)
    return F.transform(good, lambda x: F.struct(word(x).alias("word"), tag_of(x["rest"]).alias("tag"), feats_of(x["rest"]).alias("feats")))


def pos_matches(item: Column, tags: list[str], feats: list[str]) -> Column:
    """One of the tags (any, if none is named) and all feats; nothing matches where neither is named. Of an item of pos_items()."""
    if not tags and not feats:
        return F.lit(False)
    found = item["tag"].isin(tags) if tags else F.lit(True)
    for feat in feats:
        found = found & F.concat(F.lit("|"), item["feats"], F.lit("|")).contains(f"|{feat}|")
    return found


def dep_sentences(column: Column) -> Column:
    """For each sentence the items with place (from 1, malformed items count), relation and head."""

    def parsed(sentence: Column) -> Column:
        placed = F.transform(items_of(sentence), lambda x, i: F.struct((i + 1).alias("place"), F.length(x).alias("n"), rest_of(x).alias("rest")))
        head = lambda x: F.substring_index(F.substring_index(x["rest"], "(", -1), ")", 1).cast("int")
        good = F.filter(placed, lambda x: fits(x["n"], x["rest"], DEP_REST))
        return F.transform(good, lambda x: F.struct(x["place"].alias("place"), tag_of(x["rest"]).alias("relation"), head(x).alias("head")))

    return F.transform(tagged_sentences(column), parsed)


def dep_items(column: Column) -> Column:
    return F.flatten(dep_sentences(column))


def climbed(sentence: Column, heads: Column) -> Column:
    """Depths by single steps; a cycle ends at the step that closes it."""
    none = F.lit(None).cast("int")

    def onward(x: Column) -> Column:
        above = F.element_at(heads, x["at"])
        there = F.struct(F.when(F.array_contains(x["seen"], x["at"]), none).otherwise(above).alias("at"), (x["depth"] + 1).alias("depth"), F.concat(x["seen"], F.array(x["at"])).alias("seen"))
        return F.when(x["at"].isNull() | above.isNull(), F.struct(none.alias("at"), x["depth"].alias("depth"), x["seen"].alias("seen"))).otherwise(there)

    start = F.transform(sentence, lambda x: F.struct(x["head"].alias("at"), F.lit(0).alias("depth"), F.array(x["place"]).alias("seen")))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(sentence)))
    return F.transform(F.aggregate(rounds, start, lambda s, _: F.transform(s, onward)), lambda x: x["depth"])


#: A place and the steps up to it are one number: place * STEPS + steps.
STEPS = 1 << 32


def depths(sentence: Column) -> Column:
    """Steps from each item up to the root; a head that is not there ends the walk.

    Each round doubles the steps of all items at once, so there are few; sentences with a cycle are climbed step by step.
    """
    by_place = lambda: F.map_from_entries(F.transform(sentence, lambda x: F.struct(x["place"], x["head"])))
    last = F.coalesce(F.get(sentence, F.size(sentence) - 1)["place"], F.lit(1))
    spread = let(by_place(), lambda m: F.transform(F.sequence(F.lit(1), last), lambda k: F.element_at(m, k)))
    heads = F.when(F.size(sentence) == last, F.transform(sentence, lambda x: x["head"])).otherwise(spread)

    def doubled(s: Column) -> Column:
        at = lambda v: F.shiftright(v, 32).cast("int")
        return F.transform(s, lambda v: F.when(v < STEPS, v).otherwise(F.get(s, at(v) - 1) + v.bitwiseAND(STEPS - 1)))

    def of_heads(h: Column) -> Column:
        up = F.transform(h, lambda k: F.when((k > 0) & F.get(h, k - 1).isNotNull(), k.cast("bigint") * STEPS + 1).otherwise(F.lit(0).cast("bigint")))
        rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(h) + 1)).cast("int") + 1)
        done = F.aggregate(rounds, up, lambda s, _: doubled(s))
        each = lambda d: F.transform(sentence, lambda x: F.get(d, x["place"] - 1).cast("int"))
        return let(done, lambda d: F.when(F.exists(d, lambda v: v >= STEPS), climbed(sentence, by_place())).otherwise(each(d)))

    return let(heads, of_heads)


def entities(column: Column) -> Column:
    return F.regexp_extract_all(ensured(column), F.lit(NER_ITEM), F.lit(1))
