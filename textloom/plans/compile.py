"""Compile a feature tree into a plan over a document table.

Row-wise features are one projection over another of what they share; features over
lexicons are joins by document, made together for all of them; derived features are projections on top. Catalyst
prunes whatever the chosen features do not need.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import derived, lexicon, places, sequences
from ..operators.features import PARTS, REGISTRY, Frame, Parts, Spec
from .spec import JOINED, post_order, problems

#: Tags among which grammatical gender is sought.
GENDERED = ["DET", "ADJ", "NOUN", "PROPN", "PRON", "VERB", "AUX"]


@dataclass
class Resources:
    """Tables that some features need: lexicons (dictionary, entry, is_exception), accents (plain, accented), known (word)."""

    lexicons: DataFrame | None = None
    accents: DataFrame | None = None
    known: DataFrame | None = None


def prepared(docs: DataFrame, id_col: str = "id", text_col: str = "text", common: bool = True, **normalization) -> DataFrame:
    """docs with text_raw, text_norm and the common features of it."""
    raw = docs.withColumns({"text_raw": T.ensured(F.col(text_col))})
    ready = raw.withColumns({"text_norm": T.normalized(F.col("text_raw"), **normalization)})
    return ready.withColumns(T.common_features()) if common else ready


def kind(node: Spec) -> str:
    if node.operator == "RatioDimension":
        return "ratio"
    if node.operator in REGISTRY or node.operator in JOINED:
        return "atom"
    return "composite"


def parts(docs: DataFrame, trees: list[Spec]) -> tuple[dict[str, Parts], dict[str, Column]]:
    """The expressions of all row-wise features, and of the columns that they share."""
    frame = Frame(docs.columns)
    return {n.key: REGISTRY[n.operator](n, frame) for n in post_order(trees) if n.operator in REGISTRY}, frame.hidden


def lexicon_feature(node: Spec) -> lexicon.LexiconFeature:
    gender = node.operator == "GrammaticalGenderDimension"
    tags = GENDERED if gender else node.listed("pos_tag")
    feats = [] if gender else [x for x in str(node.get("universal", "") or "").split("|") if x]
    tagged = node.get("tagged_pos_column") or node.get("pos_input_column") or node.pos_input_column or "tagged_pos"
    plain = str(node.get("disabledregexp", node.disabled_regexp)).strip().lower() in ("true", "1", "yes", "y")
    return lexicon.LexiconFeature(node.key, node.listed("dictionary") or node.listed("dictionaries"), tags, feats, plain, node.flag("percentage"), tagged, gender)


def evidence(docs: DataFrame, trees: list[Spec], resources: Resources | None = None, id_col: str = "id") -> DataFrame | None:
    """id, dimension, start, end and text of what the features of trees count, where they have places; None if none has."""
    return places.evidence_of(docs, list(post_order(trees)), resources or Resources(), lexicon_feature, id_col)


def joined_features(docs: DataFrame, trees: list[Spec], resources: Resources, id_col: str) -> list[DataFrame]:
    """A table of id and features for each kind of join; features whose tables are missing are null."""
    nodes = [n for n in post_order(trees) if n.operator in JOINED]
    dictionaries = lambda n: n.listed("dictionary") or n.listed("dictionaries")
    found, done = [], set()
    if resources.lexicons is not None:
        groups: dict[str, list[lexicon.LexiconFeature]] = {}
        for n in nodes:
            if n.operator in ("WordPerDictionary", "GrammaticalGenderDimension"):
                groups.setdefault(n.get("input_column") or "text_norm", []).append(lexicon_feature(n))
        found += [lexicon.lexicon_features(docs, resources.lexicons, features, id_col, column) for column, features in groups.items()]
        done |= {f.key for features in groups.values() for f in features}
        rates: dict[tuple, dict[str, list[str]]] = {}
        for n in nodes:
            rate = {"VerbPerDictionary": lexicon.verb_rates, "EncliticsPersonalPronounsDictionary": lexicon.enclitic_rates}.get(n.operator)
            if rate:
                rates.setdefault((rate, n.get("input_column") or "text_norm"), {})[n.key] = dictionaries(n)
                done.add(n.key)
        found += [rate(docs, resources.lexicons, own, id_col, column) for (rate, column), own in rates.items()]
    by_column: dict[str, dict[str, str]] = {}
    for n in nodes:
        if n.operator == "PeriphrasisDimension":
            by_column.setdefault(n.get("tagged_pos_column") or "tagged_pos", {})[n.key] = str(n.get("auxiliar_verbs", ""))
    for column, rules in by_column.items():
        found.append(sequences.periphrases(docs, rules, id_col, pos_col=column))
        done |= rules.keys()
    for n in nodes:
        if n.operator == "ErrorMispellingAccentsDimension" and resources.accents is not None:
            found.append(sequences.missing_accents(docs, resources.accents, n.key, id_col, n.get("input_column") or "text_raw"))
            done.add(n.key)
        if n.operator == "ErrorMispellingDimension" and resources.known is not None:
            found.append(sequences.unknown_words(docs, resources.known, n.key, id_col, n.get("input_column") or "text_raw"))
            done.add(n.key)
    rest = [n.key for n in nodes if n.key not in done]
    if rest:
        found.append(docs.select(id_col, *(F.lit(None).cast("double").alias(k) for k in rest)))
    return found


def features(docs: DataFrame, trees: list[Spec], resources: Resources | None = None, id_col: str = "id", keep: tuple[str, ...] = (), with_parts: bool = False) -> DataFrame:
    """id, the kept columns, and a column for each node, children before parents. Ids must be distinct.

    with_parts adds the numerators and denominators of the features that have them; parts_in() finds them.
    """
    if wrong := problems(trees):
        raise ValueError("; ".join(wrong))
    rows, shared = parts(docs, trees)
    both = {k: p for k, p in rows.items() if with_parts and p.numerator is not None and p.denominator is not None}
    more = [c.alias(f"{mark}{k}") for k, p in both.items() for mark, c in zip(PARTS, (p.numerator, p.denominator), strict=True)]
    table = (docs.withColumns(shared) if shared else docs).select(id_col, *keep, *(p.value.alias(k) for k, p in rows.items()), *more)
    for number, other in enumerate(joined_features(docs, trees, resources or Resources(), id_col)):
        table = table.join(other.withColumnRenamed(id_col, f"__id{number}"), F.col(id_col).eqNullSafe(F.col(f"__id{number}")), "left").drop(f"__id{number}")
    order = [n.key for n in post_order(trees)]
    left = [n for n in post_order(trees) if kind(n) != "atom"]
    while left:  # a ratio waits for its operands, wherever they stand
        ready = [n for n in left if all(o in table.columns for o in needs(n))]
        if not ready:
            raise ValueError("features of each other in a circle: " + ", ".join(n.key for n in left))
        level = {n.key: derived_column(n) for n in ready}
        table = table.withColumns(level)
        left = [n for n in left if n.key not in level]
    parted = [k for k in order if with_parts and f"{PARTS[0]}{k}" in table.columns]
    return table.select(id_col, *keep, *(F.col(f"`{k}`") for k in order), *(F.col(f"`{mark}{k}`") for k in parted for mark in PARTS))


def parts_in(table: DataFrame) -> dict[str, tuple[Column, Column]]:
    """The numerator and denominator of each feature of a table made with_parts."""
    keys = [c.removeprefix(PARTS[0]) for c in table.columns if c.startswith(PARTS[0])]
    return {k: (F.col(f"`{PARTS[0]}{k}`"), F.col(f"`{PARTS[1]}{k}`")) for k in keys}


def needs(node: Spec) -> list[str]:
    return node.listed("numerator") + node.listed("denominator") if kind(node) == "ratio" else [c.key for c in node.children]


def derived_column(node: Spec):
    if kind(node) == "ratio":
        return derived.ratio(node.listed("numerator"), node.listed("denominator"), float(node.get("scale", 1.0)), float(node.get("zero_division", 0.0)))
    return derived.composite(node.strategy, [c.key for c in node.children])
