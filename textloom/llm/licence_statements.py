"""Whether a sentence that names a licence grants it, or only mentions or denies it.

A name alone is no grant. The sentences of a paragraph are looked at one by one: a grant leads to the name with a word of
GRANT (or is little more than the name), no word of DENIAL stands before the name in its part of the sentence, and none
of TAKEN_BACK behind it. Of names that stand twice in a sentence the first decides.
All of it is DataFrame functions.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANT = r"\b(?:under|licen[sc]ed?|licen[sc]es|released?|distributed?|available|published|offered|subject to|governed by|covered by|terms of|dedicated|redistributed?|copyright|spdx)\b"
DENIAL = (
    r"\b(?:not|no|never|nobody|none|neither|nor|cannot|isn|wasn|aren|weren|don|doesn|didn|won|can t|hasn|haven|stopped|stops|ceased|ceases|dropped|drops|"
    r"abandoned|removed|withdrew|withdrawn|revoked|formerly|previously|refused?|instead of|rather than|incompatible|unless|used to)\b"
)
#: Words that deny from another part of the sentence.
FAR = r"\b(?:unlike|except for|apart from|other than|in contrast to)\b"
TAKEN_BACK = r"^(?: ,)? (?:any ?more|no longer|does not|do not|did not|is not|are not|was not|has not|never|until|was dropped|was withdrawn)\b| (?:any more|anymore|no longer)$"
#: Words that a sentence may have beside the name and still be a heading, and behind "all rights reserved".
HEADING, RESERVED = 4, 5


def spelled(text: Column) -> Column:
    """text as lower-case words with one space between, a comma as a word and | where a sentence ends.

    It ends at a stop before a capital letter, and at one that ends a line unless a digit follows.
    """
    ended = F.regexp_replace(text, r"""[.!?;]+["')\]]*(?:\s+(?=["'(\[]*[\p{Lu}©])|[ \t\r]*\n\s*(?!\d))|[.!?;\s]+$""", " \u0001 ")
    comma = F.regexp_replace(F.lower(ended), r"[ \t]*,", " \u0002 ")
    words = F.regexp_replace(comma, r"[^\p{L}\p{N}\x01\x02©]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(words, "\u0001", "|"), "\u0002", ","))


def pattern(names: list[str]) -> str:
    """Any of names, the longest first, each with or without its commas."""
    words = sorted({tuple(re.findall(r"[^\W_]+", n.lower())) for n in names}, key=lambda w: (-len(w), w))
    return "(?:" + "|".join("(?: ,)? ".join(w) for w in words) + ")"


def granted(paragraph: Column, names: list[str], reserved: bool = False) -> Column:
    """True if a sentence of paragraph grants what names name, false if some name it and none grants it, null if none does."""
    split = rf"^(.*?)(?<![\p{{L}}\p{{N}}]){pattern(names)}(?![\p{{L}}\p{{N}}])(.*)$"
    longest = max(len(n.split()) for n in names)

    def verdict(sentence: Column) -> Column:
        before, after = F.regexp_extract(sentence, split, 1), F.regexp_extract(sentence, split, 2)
        part = F.element_at(F.split(before, " , "), -1)
        denied = part.rlike(DENIAL) | before.rlike(FAR) | after.rlike(TAKEN_BACK)
        n_words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
        if reserved:
            grants = before.rlike(r"copyright|©|\b[12]\d{3}\b") | (n_words(after) <= RESERVED)
        else:
            grants = before.rlike(GRANT) | (n_words(sentence) <= longest + HEADING) & (n_words(before) <= 2)
        return F.when(sentence.rlike(split), grants & ~denied)

    verdicts = F.array_compact(F.transform(F.split(spelled(paragraph), r" ?\| ?"), verdict))
    return F.when(F.size(verdicts) > 0, F.exists(verdicts, lambda v: v))
