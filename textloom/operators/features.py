"""Feature operators: each turns a specification into columns over one document.

A builder takes a Spec and gives Parts: the value, and the numerator and denominator where the feature has them.
All are expressions of built-in functions over the document's own columns, so a whole tree of features is a few
projections. Lexicons (lexicon.py) and features of other features (derived.py) are compiled apart.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import annotations as A
from ..functions import text as T
from ..functions.regex import java_pattern

FALSE_WORDS = {"0", "false", "no"}


@dataclass
class Spec:
    """A node of the feature tree. Unknown keys of a configuration are params, which win over attributes."""

    key: str
    operator: str = ""
    strategy: str = ""
    dictionary: str = ""
    pattern: str = ""
    universal: str = ""
    input_column: str = ""
    pos_tag: str = ""
    pos_input_column: str = "tagged_pos"
    percentage: bool = True
    disabled_regexp: bool = False
    children: list["Spec"] = field(default_factory=list)
    params: dict = field(default_factory=dict)

    def get(self, name: str, default=None):
        if name in self.params:
            return self.params[name]
        own = getattr(self, name, None)
        return default if own in (None, "") else own

    def flag(self, name: str, default: bool = True) -> bool:
        value = self.get(name, default)
        return str(value).strip().lower() not in FALSE_WORDS

    def listed(self, name: str) -> list[str]:
        value = self.get(name, "") or ""
        return [x.strip() for x in (value if isinstance(value, list) else str(value).replace("|", ",").split(",")) if x.strip()]


@dataclass
class Parts:
    value: Column
    numerator: Column | None = None
    denominator: Column | None = None


Builder = Callable[[Spec, "Frame"], Parts]
REGISTRY: dict[str, Builder] = {}
#: Default input column of each operator.
INPUT: dict[str, str] = {}


class Frame:
    """The columns of the documents at hand; a missing column reads as empty text.

    What several features share (tokens, parsed annotations, counts) becomes a column of its own, computed once.
    """

    def __init__(self, columns: list[str]):
        self.columns = set(columns)
        self.hidden: dict[str, Column] = {}

    def text(self, name: str) -> Column:
        return T.ensured(F.col(f"`{name}`")) if name in self.columns else F.lit("")

    def shared(self, what: str, name: str, build: Callable[[Column], Column]) -> Column:
        key = f"__{what}_{name}"
        if key not in self.hidden:
            self.hidden[key] = build(self.text(name))
        return F.col(f"`{key}`")

    def words(self, name: str) -> Column:
        """Lexical tokens, those of the common features where they are of the same column."""
        return F.col("words") if name == "text_norm" and "words" in self.columns else self.shared("words", name, T.lexical_tokens)

    def ends(self, name: str) -> Column:
        return F.col("sentence_count") if name == "text_norm" and "sentence_count" in self.columns else self.shared("ends", name, T.sentence_count)

    def syllables(self, name: str) -> Column:
        return F.col("syllable_count") if name == "text_norm" and "syllable_count" in self.columns else self.shared("syllables", name, T.syllable_count)

    def tags(self, name: str) -> Column:
        return self.shared("tags", name, A.pos_items)

    def dependencies(self, name: str) -> Column:
        return self.shared("dependencies", name, A.dep_sentences)

    def count(self, name: str, otherwise: Column) -> Column:
        return F.col(name) if name in self.columns else otherwise


def operator(name: str, input_column: str = "text_norm"):
    """Register a builder under the name by which configurations know it."""

    def add(build: Builder) -> Builder:
        REGISTRY[name], INPUT[name] = build, input_column
        return build

    return add


def source(spec: Spec) -> str:
    return spec.get("input_column") or INPUT.get(spec.operator, "text_norm")


def rate(numerator: Column, denominator: Column, percentage: bool = True) -> Parts:
    value = T.percent(numerator, denominator) if percentage else numerator.cast("double")
    return Parts(value, numerator.cast("double"), denominator.cast("double"))


#: Prefixes of the columns of numerators and denominators.
PARTS = ("__numerator_", "__denominator_")


def with_parts(key: str, numerator: Column, denominator: Column, percentage: bool = True) -> list[Column]:
    """A joined feature and its parts as columns; a plain count has no denominator."""
    whole = denominator.cast("double") if percentage else F.lit(None).cast("double")
    return [rate(numerator, denominator, percentage).value.alias(key), numerator.cast("double").alias(PARTS[0] + key), whole.alias(PARTS[1] + key)]


def compare(left: Column, symbol: str, right: int) -> Column:
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}.get(symbol, left == right)


@operator("LengthDimension")
def length(spec: Spec, frame: Frame) -> Parts:
    return Parts(frame.count("text_length", F.length(frame.text(source(spec)))).cast("double"))


@operator("AverageWordLengthDimension")
def average_word_length(spec: Spec, frame: Frame) -> Parts:
    words = frame.words(source(spec))
    letters = T.total(words, F.length)
    return Parts(T.ratio(letters, F.size(words)), letters.cast("double"), F.size(words).cast("double"))


@operator("WordLengthDimension")
def word_length(spec: Spec, frame: Frame) -> Parts:
    words, limit, symbol = frame.words(source(spec)), int(spec.get("length", 0)), str(spec.get("comparator", "="))
    return rate(F.size(F.filter(words, lambda w: compare(F.length(w), symbol, limit))), F.size(words), spec.flag("percentage"))


@operator("WordCountDimension")
def word_count(spec: Spec, frame: Frame) -> Parts:
    return Parts(frame.count("word_count", F.size(frame.words(source(spec)))).cast("double"))


@operator("CharacterFrequencyDimension")
def character_frequency(spec: Spec, frame: Frame) -> Parts:
    text, chars = frame.text(source(spec)), str(spec.get("character", spec.get("pattern", ""))).replace("SPACE", " ")
    if "\\s" in chars:
        rest = java_literal_class(chars.replace("\\s", ""))
        hits = F.regexp_count(text, F.lit(rf"(?U)[\s{rest}]"))
    else:
        hits = F.length(text) - F.length(F.translate(text, chars, "")) if chars else F.lit(0)
    return rate(hits, F.length(text))


def java_literal_class(chars: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in chars)


@operator("SyllableCountDimension")
def syllable_count(spec: Spec, frame: Frame) -> Parts:
    return Parts(frame.count("syllable_count", frame.syllables(source(spec))).cast("double"))


@operator("SentenceCountDimension")
def sentence_count(spec: Spec, frame: Frame) -> Parts:
    text = frame.text(source(spec))
    plain = F.when(T.trimmed(text) == "", 0).otherwise(F.greatest(F.lit(1), T.sentence_endings(text)))
    return Parts(frame.count("sentence_count", plain).cast("double"))


@operator("SyllablePerWordDimension")
def syllables_per_word(spec: Spec, frame: Frame) -> Parts:
    text = frame.text(source(spec))
    syllables, words = frame.syllables(source(spec)), F.size(T.found(F.lower(text), T.SYLLABIFIABLE))
    return Parts(T.ratio(syllables, words), syllables.cast("double"), words.cast("double"))


@operator("WordPerSentenceDimension")
def words_per_sentence(spec: Spec, frame: Frame) -> Parts:
    words, ends = F.size(frame.words(source(spec))), frame.ends(source(spec))
    return Parts(T.ratio(words, ends), words.cast("double"), ends.cast("double"))


@operator("WordUniqueDimension")
def unique_words(spec: Spec, frame: Frame) -> Parts:
    words = frame.words(source(spec))
    return rate(F.size(F.array_distinct(words)), F.size(words), spec.flag("percentage"))


@operator("WordCase", "text_raw")
def word_case(spec: Spec, frame: Frame) -> Parts:
    """Words in the asked case, of all that are no mention, link or number; one mention at the start is no word either."""
    text = F.regexp_replace(F.regexp_replace(frame.text(source(spec)), T.URL, ""), r"(?U)^\s*@\w+:?\s*", "")
    case = str(spec.get("word_comparator") or spec.get("comparator") or "upper").lower()
    words = T.found(text, T.MENTIONABLE)
    if case == "title":  # short words are counted at the start only
        words = F.filter(words, lambda w, i: (i == 0) | (F.length(w) > 3))
    words = F.filter(words, lambda w: ~w.startswith("@") & ~w.rlike(r"^\p{N}+$"))
    fits = {
        "lower": lambda w: w == F.lower(w),
        "title": lambda w: w.rlike(r"^[\p{N}]*[\p{Lu}\p{Lt}\p{Lo}](?:(?<=\p{L})\P{Lu}|(?<!\p{L})[\p{Lu}\p{N}])*$"),
    }.get(case, lambda w: w == F.upper(w))
    return rate(F.size(F.filter(words, fits)), F.size(words))


def _type_token(spec: Spec, frame: Frame) -> Column:
    strategy = str(spec.get("separator") or spec.get("strategy") or "by-chunks").lower()
    return T.type_token_ratios(frame.text(source(spec)), strategy, int(spec.get("chunk_size", 1000)))


@operator("RTIEDimension")
def type_token_ratio(spec: Spec, frame: Frame) -> Parts:
    return Parts(T.mean(_type_token(spec, frame)))


@operator("RTIEDeviationDimension")
def type_token_deviation(spec: Spec, frame: Frame) -> Parts:
    return Parts(T.deviation(_type_token(spec, frame)))


def _scores(spec: Spec, frame: Frame) -> tuple[Column, Column]:
    return frame.syllables(source(spec)), F.size(frame.words(source(spec)))


@operator("ReadabilityDimension")
def readability(spec: Spec, frame: Frame) -> Parts:
    """206.84 - 60 syllables per word - 102 sentences per word; sentences are all spans, one at least."""
    syllables, words = _scores(spec, frame)
    spans = F.greatest(F.lit(1), F.size(T.sentence_spans(frame.text(source(spec)))))
    return Parts(F.when(words == 0, 0.0).otherwise(206.84 - 60.0 * T.ratio(syllables, words) - 102.0 * T.ratio(spans, words)))


@operator("PerspicuityDimension")
def perspicuity(spec: Spec, frame: Frame) -> Parts:
    """206.835 - 62.3 syllables per word - words per sentence."""
    syllables, words = _scores(spec, frame)
    ends = frame.ends(source(spec))
    return Parts(F.when((words == 0) | (ends == 0), 0.0).otherwise(206.835 - 62.3 * T.ratio(syllables, words) - T.ratio(words, ends)))


def _pattern(spec: Spec, text: Column) -> Parts:
    return rate(F.regexp_count(text, F.lit(java_pattern(str(spec.get("pattern", ""))))), F.length(text), spec.flag("percentage"))


@operator("PatternDimension")
def pattern(spec: Spec, frame: Frame) -> Parts:
    """Matches in any case, as a percentage of the text's characters by default."""
    return _pattern(spec, frame.text(source(spec)))


@operator("POSTaggingExpression", "tagged_pos")
def tag_pattern(spec: Spec, frame: Frame) -> Parts:
    return _pattern(spec, frame.text("tagged_pos"))


@operator("POSTaggingTag", "tagged_pos")
def tag_rate(spec: Spec, frame: Frame) -> Parts:
    items = frame.tags(source(spec))
    tags = spec.listed("tag") or spec.listed("pos_tag")
    feats = [x for x in str(spec.get("universal", "") or "").split("|") if x]
    return rate(F.size(F.filter(items, lambda x: A.pos_matches(x, tags, feats))), F.size(items), spec.flag("percentage"))


@operator("NERTaggingTag", "tagged_ner")
def entity_rate(spec: Spec, frame: Frame) -> Parts:
    text, tag, by = frame.text(source(spec)), spec.get("tag", ""), str(spec.get("normalizer", "entities"))
    if by not in ("entities", "words"):
        raise ValueError(f"{spec.key}: unknown normalizer {by}")
    kinds = A.entities(text)
    words = F.size(F.array_remove(F.split(T.trimmed(text), r"(?U)\s+"), ""))
    hits = F.size(F.filter(kinds, lambda k: k == tag)) if tag else F.lit(0)
    return rate(hits, F.size(kinds) if by == "entities" else words)


@operator("DependencyTag", "tagged_dep")
def relation_rate(spec: Spec, frame: Frame) -> Parts:
    items, relation = F.flatten(frame.dependencies(source(spec))), str(spec.get("deprel", spec.get("tag", "")))
    return rate(F.size(F.filter(items, lambda x: x["relation"] == relation)), F.size(items))


def _summary(values: Column, how: str) -> Column:
    if how == "mean":
        return T.mean(values)
    return (T.total(values) if how == "sum" else F.coalesce(F.array_max(values), F.lit(0))).cast("double")


@operator("DependencyDepthDimension", "tagged_dep")
def dependency_depth(spec: Spec, frame: Frame) -> Parts:
    values = F.flatten(F.transform(frame.dependencies(source(spec)), A.depths))
    return Parts(T.let(values, lambda v: _summary(v, str(spec.get("mode", "max")).lower())))


@operator("DependencyDistanceDimension", "tagged_dep")
def dependency_distance(spec: Spec, frame: Frame) -> Parts:
    items = F.filter(F.flatten(frame.dependencies(source(spec))), lambda x: x["head"] > 0)
    values = F.transform(items, lambda x: F.abs(x["place"] - x["head"]))
    return Parts(T.let(values, lambda v: _summary(v, str(spec.get("mode", "mean")).lower())))


@operator("RootPOSTagDimension", "tagged_pos")
def root_tag_rate(spec: Spec, frame: Frame) -> Parts:
    """Tags of the roots; the two annotations are laid side by side, sentence by sentence and item by item."""
    tags = F.transform(A.tagged_sentences(frame.text(source(spec))), lambda s: F.transform(A.well_formed(A.items_of(s)), lambda x: A.tag_of(x["rest"])))
    deps = frame.dependencies(str(spec.get("tagged_dep_column") or spec.get("dep_input_column") or "tagged_dep"))
    both = F.zip_with(tags, deps, lambda t, d: F.filter(F.transform(d, lambda x, i: F.when(x["head"] == 0, F.get(t, i))), lambda x: x.isNotNull()))
    wanted = spec.listed("tag") or spec.listed("pos_tag")
    return _of_roots(F.flatten(F.filter(both, lambda x: x.isNotNull())), wanted)


def _of_roots(roots: Column, wanted: list[str]) -> Parts:
    return rate(F.size(F.filter(roots, lambda t: t.isin(wanted))) if wanted else F.lit(0), F.size(roots))


PASSIVE = ["aux:pass", "nsubj:pass", "expl:pass"]


@operator("PassiveVoiceDependencyDimension", "tagged_dep")
def passive_rate(spec: Spec, frame: Frame) -> Parts:
    groups = frame.dependencies(source(spec))
    return rate(F.size(F.filter(groups, lambda s: F.exists(s, lambda x: x["relation"].isin(PASSIVE)))), F.size(groups))


def lower_start(sentence: Column) -> Column:
    """Whether a sentence begins with a small letter, mentions and signs aside."""
    return F.regexp_replace(F.regexp_replace(sentence, T.MENTION, ""), r"(?U)^[\s\p{P}\p{S}]+", "").rlike(r"^\p{Ll}")


def number_start(sentence: Column) -> Column:
    return sentence.rlike(r"(?U)^.*?\b(?=[\p{L}\p{N}])\p{Nd}") & F.regexp_extract(sentence, r"(?U)\b[\p{L}\p{N}]+", 0).rlike(r"^\p{Nd}")


@operator("ErrorCapitalizationStartingWithLowerCaseDimension")
def starts_in_lower_case(spec: Spec, frame: Frame) -> Parts:
    kept = F.filter(T.sentences(frame.text(source(spec))), lambda s: s.rlike(r"\p{L}"))
    return rate(F.size(F.filter(kept, lower_start)), F.size(kept))


@operator("ErrorMiscTwoOrMoreEqualWordsDimension")
def repeated_words(spec: Spec, frame: Frame) -> Parts:
    return Parts(T.total(T.sentences(frame.text(source(spec))), lambda s: F.regexp_count(s, F.lit(T.REPEATED_WORD))).cast("double"))


@operator("ErrorStyleSentencesStartingWithNumbers")
def starts_with_number(spec: Spec, frame: Frame) -> Parts:
    kept = F.filter(T.sentences(frame.text(source(spec))), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    return rate(F.size(F.filter(kept, number_start)), F.size(kept))


@operator("ErrorStyleSentencesStartingWithTheSameWord")
def starts_with_same_word(spec: Spec, frame: Frame) -> Parts:
    kept = F.filter(T.sentences(frame.text(source(spec))), lambda s: s.rlike(r"\p{L}"))
    firsts = F.transform(kept, lambda s: F.lower(F.regexp_extract(s, r"\p{L}+", 0)))
    ordered = F.sort_array(firsts)
    repeated = T.let(ordered, lambda o: F.size(F.filter(F.transform(o, lambda w, i: w.eqNullSafe(F.get(o, i - 1)) | w.eqNullSafe(F.get(o, i + 1))), lambda x: x)))
    return rate(repeated, F.size(kept))


@operator("ParagraphCountDimension")
def paragraph_count(spec: Spec, frame: Frame) -> Parts:
    return Parts(F.size(T.paragraphs(frame.text(source(spec)))).cast("double"))


@operator("AverageParagraphLengthDimension")
def paragraph_length(spec: Spec, frame: Frame) -> Parts:
    return Parts(T.mean(T.paragraph_words(frame.text(source(spec)))))


@operator("ParagraphLengthDeviationDimension")
def paragraph_deviation(spec: Spec, frame: Frame) -> Parts:
    return Parts(T.deviation(T.paragraph_words(frame.text(source(spec)))))


@operator("DialogueParagraphPercentageDimension")
def dialogue_paragraphs(spec: Spec, frame: Frame) -> Parts:
    parts = T.paragraphs(frame.text(source(spec)))
    return rate(F.size(F.filter(parts, lambda p: p.rlike(T.DIALOGUE))), F.size(parts))
