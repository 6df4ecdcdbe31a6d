"""Where the features of a tree find what they count: id, dimension, start, end and text of every occurrence.

Row-wise features build arrays of spans as expressions; lexicons, spelling and enclitics join letter runs that keep their
places. All of it stays in the JVM. Places are those of the column that a feature reads (source_of).
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import annotations as A
from ..functions import spans as S
from ..functions import text as T
from ..functions.regex import java_pattern
from . import lexicon as L
from . import sequences
from .features import PASSIVE, Frame, Spec, java_literal_class, lower_start, number_start, source

#: Builders of the spans of a feature from its column.
PLACES: dict[str, Callable[[Spec, Column], Column]] = {}
#: Features whose occurrences are joins, with the column that they read.
JOINED_PLACES = {
    "WordPerDictionary": "text_norm", "GrammaticalGenderDimension": "text_norm", "EncliticsPersonalPronounsDictionary": "text_norm",
    "ErrorMispellingDimension": "text_raw", "ErrorMispellingAccentsDimension": "text_raw",
}


def places(*names: str):
    def add(build):
        PLACES.update(dict.fromkeys(names, build))
        return build

    return add


def source_of(node: Spec) -> str:
    if node.operator in JOINED_PLACES:
        return node.get("input_column") or JOINED_PLACES[node.operator]
    return "tagged_pos" if node.operator == "POSTaggingExpression" else source(node)


@places("PatternDimension", "POSTaggingExpression")
def of_pattern(node: Spec, text: Column) -> Column:
    return S.spans(text, java_pattern(str(node.get("pattern", ""))))


@places("CharacterFrequencyDimension")
def of_characters(node: Spec, text: Column) -> Column:
    characters = str(node.get("character", node.get("pattern", ""))).replace("SPACE", " ")
    rest = java_literal_class(characters.replace(r"\s", ""))
    return S.spans(text, "(?U)[" + r"\s" * (r"\s" in characters) + rest + "]" if characters else "(?!)")


@places("ErrorMiscTwoOrMoreEqualWordsDimension")
def of_repeated_words(node: Spec, text: Column) -> Column:
    """Within sentences, as they are counted."""

    def inside(s: Column) -> Column:
        return F.transform(S.spans(s["text"], T.REPEATED_WORD), lambda x: F.struct((s["start"] + x["start"]).alias("start"), (s["start"] + x["end"]).alias("end"), x["text"].alias("text")))

    return F.flatten(F.transform(S.sentence_spans(text), inside))


@places("ErrorCapitalizationStartingWithLowerCaseDimension")
def of_lower_starts(node: Spec, text: Column) -> Column:
    return F.filter(S.sentence_spans(text), lambda s: lower_start(s["text"]))


@places("ErrorStyleSentencesStartingWithNumbers")
def of_number_starts(node: Spec, text: Column) -> Column:
    return F.filter(S.sentence_spans(text), lambda s: number_start(s["text"]))


@places("ErrorStyleSentencesStartingWithTheSameWord")
def of_same_starts(node: Spec, text: Column) -> Column:
    """Sentences whose first word is that of another sentence too."""
    first = lambda s: F.lower(F.regexp_extract(s["text"], r"\p{L}+", 0))
    kept = F.transform(F.filter(S.sentence_spans(text), lambda s: s["text"].rlike(r"\p{L}")), lambda s: F.struct(first(s).alias("first"), s.alias("span")))

    def repeated(rows: Column) -> Column:
        firsts = F.array_sort(F.transform(rows, lambda r: r["first"]))
        twice = F.filter(F.transform(firsts, lambda w, i: F.when(w.eqNullSafe(F.get(firsts, i - 1)), w)), lambda w: w.isNotNull())
        return T.let(F.array_distinct(twice), lambda t: F.transform(F.filter(rows, lambda r: F.array_contains(t, r["first"])), lambda r: r["span"]))

    return T.let(kept, repeated)


@places("ParagraphCountDimension", "AverageParagraphLengthDimension", "ParagraphLengthDeviationDimension")
def of_paragraphs(node: Spec, text: Column) -> Column:
    return S.paragraph_spans(text)


@places("DialogueParagraphPercentageDimension")
def of_dialogues(node: Spec, text: Column) -> Column:
    return F.filter(S.paragraph_spans(text), lambda p: p["text"].rlike(T.DIALOGUE))


@places("POSTaggingTag")
def of_tags(node: Spec, text: Column) -> Column:
    tags = node.listed("tag") or node.listed("pos_tag")
    feats = [x for x in str(node.get("universal", "") or "").split("|") if x]
    joined = lambda x: {"tag": x["tag"], "feats": F.array_join(x["feats"], "|")}
    hits = F.filter(S.tag_spans(text), lambda x: A.pos_matches(joined(x), tags, feats))
    return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("text")))


@places("NERTaggingTag")
def of_entities(node: Spec, text: Column) -> Column:
    hits = F.filter(S.entity_spans(text), lambda x: x["kind"] == str(node.get("tag", "")))
    return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))


@places("PassiveVoiceDependencyDimension")
def of_passives(node: Spec, text: Column) -> Column:
    """Annotated sentences that hold a passive relation."""
    sentences = F.transform(S.pieces_of(text, r" \|\| "), lambda s: S.stripped(s["text"], s["start"]))
    passive = lambda s: F.exists(F.split(s["text"], ", "), lambda x: x.rlike(A.DEP_ITEM) & F.regexp_extract(x, A.DEP_ITEM, 2).isin(PASSIVE))
    return F.filter(sentences, passive)


def has_places(node: Spec, resources) -> bool:
    needs = {"ErrorMispellingDimension": resources.known, "ErrorMispellingAccentsDimension": resources.accents}
    return node.operator in PLACES or (node.operator in JOINED_PLACES and needs.get(node.operator, resources.lexicons) is not None)


def row_wise(docs: DataFrame, nodes: list[Spec], id_col: str) -> DataFrame:
    """The occurrences of row-wise features, one scan for all of them."""
    frame = Frame(docs.columns)
    named = lambda n: F.transform(PLACES[n.operator](n, frame.text(source_of(n))), lambda s: F.struct(F.lit(n.key).alias("dimension"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return S.exploded(docs, F.col(id_col).alias("id"), F.flatten(F.array(*map(named, nodes)))).select("id", "x.*")


def placed_runs(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    return S.exploded(docs, F.col(id_col).alias("id"), S.spans(text, T.LETTER_RUN)).select("id", "x.start", "x.end", "x.text")


def evidence_of(docs: DataFrame, nodes: list[Spec], resources, lexicon_features: Callable[[Spec], L.LexiconFeature], id_col: str = "id") -> DataFrame | None:
    """id, dimension, start, end and text of all features of nodes that have places; None if none has."""
    found, rows = [], [n for n in nodes if n.operator in PLACES]
    if rows:
        found.append(row_wise(docs, rows, id_col))
    by_column: dict[str, list[Spec]] = {}
    for n in nodes:
        if n.operator in JOINED_PLACES and has_places(n, resources):
            by_column.setdefault(source_of(n), []).append(n)
    for column, own in by_column.items():
        text = T.ensured(F.col(column)) if column in docs.columns else F.lit("")
        lexical = [n for n in own if n.operator in ("WordPerDictionary", "GrammaticalGenderDimension")]
        if lexical:
            found.append(L.lexicon_evidence(docs, resources.lexicons, [lexicon_features(n) for n in lexical], id_col, column))
        for n in own:
            runs = placed_runs(docs, id_col, text)
            if n.operator == "ErrorMispellingDimension":
                hits = sequences.checked_runs(runs, "text").join(L.sized(sequences.known_words(resources.known)), F.lower("text") == F.col("word"), "left_anti")
            elif n.operator == "ErrorMispellingAccentsDimension":
                hits = sequences.unaccented_runs(runs, "text").join(L.sized(resources.accents), F.col("text") == F.col("plain"))
            elif n.operator == "EncliticsPersonalPronounsDictionary":
                # the text without accents has the same length, so places are those of the text itself
                stems = F.explode(L.enclitic_stems(F.col("text"))).alias("stem")
                words = L.plain_entries(resources.lexicons, n.listed("dictionary") or n.listed("dictionaries"))
                hits = runs.select("*", stems).join(L.sized(words), F.col("stem") == F.col("word"))
            else:
                continue
            found.append(hits.select("id", F.lit(n.key).alias("dimension"), "start", "end", "text"))
    return reduce(DataFrame.unionByName, found) if found else None
