"""Column builders for text: tokens, sentences, syllables, paragraphs and normalization. All stay in the JVM."""

import json
from functools import cache
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define tokens and sentences, in Java's dialect. (?U) makes \w, \s and \b Unicode.
LEXICAL = r"(?U)(?:\b\p{N}+(?:[.,]\p{N}+)+\b|\b[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*\b)"
SYLLABIFIABLE = r"(?U)\b\p{L}+(?:[-'’]\p{L}+)*\b"
MENTIONABLE = r"(?U)@?\b[\p{L}\p{N}]+\b"
LETTER_RUN = r"\p{L}+"
SPANISH_WORD = r"(?U)\b[a-záéíóúüñ]+\b"
VOWELS = r"[aeiouáéíóúü]+"
SENTENCE = r"[^.!?]+[.!?]*"
SENTENCE_END = r"[.!?]+"
#: A point within a number, and abbreviations whose own stops, or the stops behind these, end no sentence.
DECIMAL = r"(?U)(?<=\d)\.(?=\d)"
ABBREVIATION = r"(?iuU)(?<![\p{L}.])\.*+(?:dra?|etc|profa?|sra?|srta)"
ABBREVIATED, ABBREVIATED_TWICE = ABBREVIATION + r"(?=\s*+[.!?])", ABBREVIATION + r"\.++(?=\s++[.!?])"
PARAGRAPH_BREAK = r"(?U)\n\s*\n+"
DIALOGUE = r"(?U)^\s*[—–-]\s*"
REPEATED_WORD = r"(?iu)(?<!\p{L})(\p{L}+)(?U:\s)+\1(?!\p{L})"
URL = r"(?iU)https?://\S+|www\.\S+"
MENTION = r"(?U)@\w+:?"
#: The look behind keeps a long run within a text from being tried from each of its places.
EDGE_SPACE = r"(?U)^\s+|(?<!\s)\s+$"


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ensured(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends; trim() knows only the space."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def lexical_tokens(text: Column) -> Column:
    return found(F.lower(text), LEXICAL)


def total(items: Column, of=lambda x: x, zero: str = "0") -> Column:
    return F.aggregate(items, F.expr(zero), lambda s, x: s + of(x))


def sentence_spans(text: Column) -> Column:
    return found(text, SENTENCE)


def sentences(text: Column) -> Column:
    """Stripped spans that are not empty."""
    return F.filter(F.transform(sentence_spans(text), trimmed), lambda s: s != "")


def sentence_endings(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE_END))


def sentence_count(text: Column) -> Column:
    """Ends of sentences but those of decimals and abbreviations; one at least, none in a blank text.

    A stop belongs to an abbreviation if that is the last token before it, over any white space: so the stop next to it, and
    one that follows its own stops.
    """
    count = lambda t, p: F.regexp_count(t, F.lit(p))
    real = lambda t: count(t, SENTENCE_END) - count(t, DECIMAL) - count(t, ABBREVIATED) - count(t, ABBREVIATED_TWICE)
    return let(trimmed(text), lambda t: F.when(t == "", 0).otherwise(F.greatest(F.lit(1), real(t))))


def word_syllables(word: Column) -> Column:
    return F.when(trimmed(word) == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit(VOWELS))))


def syllable_count(text: Column) -> Column:
    return total(found(F.lower(text), SPANISH_WORD), word_syllables)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(trimmed(text), PARAGRAPH_BREAK), trimmed), lambda p: p != "")


def paragraph_words(text: Column) -> Column:
    return F.transform(paragraphs(text), lambda p: F.size(lexical_tokens(p)))


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """scale * numerator / denominator, 0.0 where the denominator is zero."""
    return F.coalesce(F.try_divide(F.lit(float(scale)) * numerator, denominator.cast("double")), F.lit(0.0))


def percent(numerator: Column, denominator: Column) -> Column:
    return ratio(numerator, denominator, 100.0)


def mean(values: Column) -> Column:
    return let(values, lambda v: ratio(total(v, lambda x: x.cast("double"), "0.0D"), F.size(v)))


def deviation(values: Column) -> Column:
    """Of the population; 0.0 for fewer than two values."""

    def spread(v: Column) -> Column:
        return let(mean(v), lambda m: F.sqrt(ratio(total(v, lambda x: (x - m) * (x - m), "0.0D"), F.size(v))))

    return let(F.transform(values, lambda x: x.cast("double")), lambda v: F.when(F.size(v) < 2, 0.0).otherwise(spread(v)))


def type_token_ratios(text: Column, strategy: str = "whole", chunk: int = 1000) -> Column:
    """Distinct tokens by tokens: of the whole text, of each sentence, or of each chunk of tokens."""
    share = lambda words: ratio(F.size(F.array_distinct(words)), F.size(words))
    if strategy == "by-sentence":
        return F.transform(sentences(text), lambda s: let(lexical_tokens(s), share))
    if strategy == "by-chunks":
        pieces = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / chunk).cast("int")), lambda k: share(F.slice(w, k * chunk + 1, F.lit(chunk)))))
        return let(lexical_tokens(text), lambda w: F.coalesce(pieces(w), F.expr("CAST(array() AS array<double>)")))
    return F.array(let(lexical_tokens(text), share))


#: References to characters: by number, or by name with or without its semicolon.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@cache
def _entity_tables() -> tuple[str, str]:
    """JSON of the characters of all names, and of the numbers that stand for another character than their own."""
    odd = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    return json.dumps(entities.html5), json.dumps(odd)


def character_of(number: Column) -> Column:
    """The character of a numeric reference; null numbers are beyond all characters."""
    odd = F.try_element_at(F.from_json(F.lit(_entity_tables()[1]), "map<string,string>"), number.cast("string"))
    none = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (number % 0x10000 >= 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    beyond = number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return F.when(beyond, "\ufffd").otherwise(F.coalesce(odd, F.when(none, "").otherwise(plain)))


def entity_text(reference: Column) -> Column:
    """What a reference stands for; of a name without a semicolon the longest known beginning, and itself if there is none."""
    names = F.from_json(F.lit(_entity_tables()[0]), "map<string,string>")
    body = F.substring(reference, F.lit(2), F.length(reference))
    digits = F.regexp_replace(F.rtrim(body, F.lit(";")), "^#[xX]?", "")
    number = F.when(body.rlike("^#[xX]"), F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= 8, F.conv(digits, 16, 10).try_cast("bigint"))).otherwise(digits.try_cast("bigint"))
    known = F.filter(F.transform(F.sequence(F.length(body), F.lit(2), F.lit(-1)), lambda n: F.struct(n.alias("n"), F.try_element_at(names, F.substring(body, F.lit(1), n)).alias("text"))), lambda x: x["text"].isNotNull())
    named = let(F.get(known, F.lit(0)), lambda x: F.when(x.isNull(), reference).otherwise(F.concat(x["text"], F.substring(body, x["n"] + 1, F.length(body)))))
    return F.when(body.startswith("#"), character_of(number)).otherwise(F.when(F.length(body) < 2, reference).otherwise(named))


def unescaped(text: Column) -> Column:
    """Character references of HTML as the characters that they stand for."""
    joined = lambda t: F.array_join(F.flatten(F.zip_with(F.split(t, ENTITY), F.transform(found(t, ENTITY), entity_text), lambda gap, x: F.array(gap, F.coalesce(x, F.lit(""))))), "")
    return F.when(text.contains("&"), joined(text)).otherwise(text)


def strip_html(text: Column) -> Column:
    return F.regexp_replace(unescaped(text), r"<[^>]+>", " ")


def line_breaks_replaced(text: Column) -> Column:
    """A run of line breaks becomes a space after the end of a sentence or at the start, else a full stop and a space.

    Other white space between may be of any length: each match goes on where the one before it ended.
    """
    ended = F.regexp_replace(text, r"(?U)((?:^|(?<=[.!?])|\G(?<!^))[^\S\r\n]*+)[\r\n]++", "$1 ")
    return F.regexp_replace(ended, r"[\r\n]+", ". ")


def emojis_named(text: Column, names: dict[str, str]) -> Column:
    """Each emoji as " /name/ ", the longest sequence that the table knows; what it does not know stays. No two slashes meet.

    names: sequence of code points (with joiners, skin tones and selectors as they stand) to its name. Sequences are grouped by
    their first code point, and looked for only where one of these stands.
    """
    code = lambda s: "".join(rf"\x{{{ord(c):X}}}" for c in s)
    ends: dict[str, list[str]] = {}
    for sequence in sorted(filter(None, names), key=len, reverse=True):
        ends.setdefault(sequence[0], []).append(sequence[1:])
    if ends:
        begins = f"[{''.join(map(code, ends))}]"
        pattern = f"(?={begins})(?:" + "|".join(f"{code(first)}(?:{'|'.join(map(code, rest))})" for first, rest in ends.items()) + ")"
        table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
        named = lambda t: F.transform(found(t, pattern), lambda m: F.concat(F.lit(" /"), F.element_at(table, m), F.lit("/ ")))
        joined = lambda t: F.array_join(F.flatten(F.zip_with(F.split(t, pattern, -1), named(t), lambda gap, x: F.array(gap, F.coalesce(x, F.lit(""))))), "")
        text = F.when(text.rlike(begins), joined(text)).otherwise(text)
    return F.replace(text, F.lit("//"), F.lit("/ /"))


def cleaned_spaces(text: Column) -> Column:
    text = F.replace(text, F.lit(" . "), F.lit(". "))
    for pattern, by in ((r"(?U)(?<!\s)\s+([.,;:!?])", "$1"), (r"\.+", "."), (r"(?U)\s+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return trimmed(text)


def expanded(text: Column, abbreviations: dict[str, str]) -> Column:
    """Each whole-word abbreviation in turn, whatever its case, by its expansion."""
    for short, long in abbreviations.items():
        text = F.regexp_replace(text, rf"(?iuU)(?<!\w)\Q{short}\E(?!\w)", long.replace("\\", "\\\\").replace("$", "\\$"))
    return text


#: The steps of the default normalization, in order.
STEPS = {
    "strip_html": strip_html,
    "trim": trimmed,
    "remove_urls": lambda t: F.regexp_replace(t, URL, ""),
    "remove_mentions": lambda t: F.regexp_replace(t, MENTION, ""),
    "replace_line_breaks": line_breaks_replaced,
    "remove_repeated_characters": lambda t: F.regexp_replace(t, r"(.)\1{2,}", "$1"),
    "remove_markers": lambda t: F.translate(t, "#@", ""),
    "remove_retweet_marker": lambda t: F.regexp_replace(t, r"(?iU)^\s*RT\s+", ""),
    "lowercase": lambda t: trimmed(F.lower(t)),
    "clean_spaces": cleaned_spaces,
}


def normalized(text: Column, preserve_case: bool = False, remove_repeated: bool = True, abbreviations: dict[str, str] | None = None, without: tuple[str, ...] = (), emojis: dict[str, str] | None = None) -> Column:
    """All steps as one expression, with names for emojis and expansions for abbreviations where they are given; a null text becomes empty."""
    text = ensured(text)
    off = {*without, *(["lowercase"] * preserve_case), *(["remove_repeated_characters"] * (not remove_repeated))}
    for name, step in STEPS.items():
        text = text if name in off else step(text)
        if name == "replace_line_breaks" and emojis is not None:
            text = emojis_named(text, emojis)
        if name == "remove_repeated_characters" and abbreviations:
            text = expanded(text, abbreviations)
    return text


def common_features(text: str = "text_norm") -> dict[str, Column]:
    c = ensured(F.col(text))
    return {
        "text_length": F.length(c), "words": lexical_tokens(c), "word_count": F.size(lexical_tokens(c)), "unique_word_count": F.size(F.array_distinct(lexical_tokens(c))),
        "sentence_count": sentence_count(c), "syllable_count": syllable_count(c),
    }
