"""Lexicon entries by what they can match: whole runs of letters, their beginnings or ends, phrases, or only a pattern.

A pattern is indexed by letters that each of its matches must hold, and sought only where these stand.

An entry with a finite number of spellings (optional letters, classes, alternatives) is spelled out. A run of letters
matches an entry once, so of an entry's own spellings those that another covers are left out.
"""

import re
from collections import Counter
from functools import lru_cache

#: An entry with more spellings stays a pattern.
MOST = 200
#: Letters of the pieces by which patterns are indexed.
GRAM = 3
ANY, SOME = "\ue000", "\ue001"  # stand for \p{L}* and \p{L}+ while an entry is spelled out


class Opaque(Exception):
    """A part of an entry that is left to the pattern library."""


def read(entry: str) -> list:
    """An entry as alternatives; each is a list of (atom, least, most) where an atom is the characters that may stand there,
    a list of alternatives, or None for whatever is not read here. Most is None without a bound."""
    found, end = _alternatives(entry, 0)
    if end < len(entry):
        raise Opaque
    return found


def _alternatives(s: str, at: int) -> tuple[list, int]:
    found: list = [[]]
    while at < len(s) and s[at] != ")":
        if s[at] == "|":
            found.append([])
            at += 1
            continue
        atom, at = _atom(s, at)
        times = TIMES.match(s, at)
        least, most = _bounds(times[0]) if times else (1, 1)
        at = times.end() if times else at
        found[-1].append((atom, least, most))
    return found, at


#: Repetitions, with what makes them lazy or possessive behind.
TIMES = re.compile(r"(?:[?*+]|\{[0-9]+(?:,[0-9]*)?\})[?+]?")


def _bounds(times: str) -> tuple[int, int | None]:
    if len(times) > 1 and times[-1] in "?+":
        raise Opaque
    if times[0] == "{":
        least, _, most = times.strip("{}").partition(",")
        return int(least), int(most) if most else (None if "," in times else int(least))
    return {"?": (0, 1), "*": (0, None), "+": (1, None)}[times]


def _atom(s: str, at: int) -> tuple:
    c = s[at]
    if c == "\\":
        if at + 1 == len(s):
            raise Opaque
        if not s[at + 1].isalnum():
            return [s[at + 1]], at + 2
        if s[at + 1].isdigit():
            raise Opaque
        braced = re.compile(r"\\[pPxNUu]\{[^}]*\}|\\x..|\\u....|\\U........|\\[a-zA-Z]", re.DOTALL).match(s, at)
        return None, braced.end()
    if c == "[":
        body = re.compile(r"\[(\^?)((?:[^\\\]\[]|\\.)+)\]", re.DOTALL).match(s, at)
        if not body:
            raise Opaque
        plain = re.sub(r"\\([^a-zA-Z0-9])", r"\1", body[2])
        ranges = "\\" in plain or re.search(r".-.", body[2])
        return None if body[1] or ranges else list(plain), body.end()
    if c == "(":
        if s.startswith("(?", at) and not s.startswith("(?:", at):
            raise Opaque
        inner, end = _alternatives(s, at + (3 if s.startswith("(?:", at) else 1))
        if end == len(s):
            raise Opaque
        return ("group", inner), end + 1
    if c in "?*+{}])":
        raise Opaque
    return (None if c in ".^$" else [c]), at + 1


def spellings(entry: str) -> list[str] | None:
    try:
        found = _spelled(read(entry.replace(r"\p{L}*", ANY).replace(r"\w*", ANY).replace(r"\p{L}+", SOME)))
    except Opaque:
        return None
    return None if found is None else list(dict.fromkeys(found))


def _spelled(alternatives: list) -> list[str] | None:
    every = []
    for sequence in alternatives:
        out = [""]
        for atom, least, most in sequence:
            options = _spelled(atom[1]) if isinstance(atom, tuple) else atom
            if options is None or (least, most) not in ((0, 1), (1, 1)):
                return None
            options = ([""] if least == 0 else []) + options
            if len(out) * len(options) > MOST:
                return None
            out = [a + b for a in out for b in options]
        every += out
    return every if len(every) <= MOST else None


def literals(entry: str) -> list[str] | None:
    """Runs of letters (in lower case, GRAM or more) of which every match holds one; None if there are no such runs."""
    try:
        found = _needed(read(entry))
    except Opaque:
        return None
    return sorted(found) if found else None


def _needed(alternatives: list) -> set[str] | None:
    every: set[str] = set()
    for sequence in alternatives:
        runs, open_run, groups = [], "", []
        for atom, least, most in [*sequence, (None, 1, 1)]:
            one = isinstance(atom, list) and len(set("".join(atom).lower())) == 1 and atom[0].isalpha() and len(atom[0].lower()) == 1
            if one and least >= 1:
                open_run += atom[0].lower()
            if not one or (least, most) != (1, 1):
                runs.append(open_run)
                open_run = atom[0].lower() if one and least >= 1 else ""
            if isinstance(atom, tuple) and least >= 1:
                groups.append(_needed(atom[1]))
        longest = max(runs, key=len, default="")
        known = [{longest}] if len(longest) >= GRAM else [g for g in groups if g]
        if not known:
            return None
        every |= min(known, key=len)
    return every


@lru_cache(maxsize=100_000)
def kinds(entry: str) -> tuple[tuple[str, str], ...]:
    """(kind, stem) of an entry: word, prefix, longer (a prefix of more), suffix, phrase (its first words) or pattern."""
    found: dict[str, set[str]] = {}
    for s in map(str.lower, spellings(entry) or ["*"]):
        body = s.strip(ANY + SOME)
        if s.isalpha():
            found.setdefault("word", set()).add(s)
        elif body.isalpha() and s in (body + ANY, body + SOME):
            found.setdefault("prefix" if s[-1] == ANY else "longer", set()).add(body)
        elif body.isalpha() and s in (ANY + body, SOME + body):
            found.setdefault("suffix" if s[0] == ANY else "suffix_longer", set()).add(body)
        elif all(w.isalpha() for w in s.split(" ")):
            found.setdefault("phrase", set()).add(s.split(" ")[0])
        else:
            return (("pattern", entry),)
    if "phrase" in found:
        return tuple(("phrase", w) for w in sorted(found["phrase"])) if found.keys() == {"phrase"} else (("pattern", entry),)
    if len(found.keys() - {"word"}) > 1:
        return (("pattern", entry),)
    for kind in found.keys() - {"word"}:
        end = kind.startswith("suffix")
        covers = lambda stem, s, end=end: s.endswith(stem) if end else s.startswith(stem)
        found[kind] = {s for s in found[kind] if not any(t != s and covers(t, s) for t in found[kind])}
        if "word" in found:
            strict = kind in ("longer", "suffix_longer")
            found["word"] = {w for w in found["word"] if not any(covers(t, w) and (len(w) > len(t) or not strict) for t in found[kind])}
    return tuple((k, s) for k in sorted(found) for s in sorted(found[k]))


@lru_cache(maxsize=100_000)
def indexed(entry: str) -> tuple[tuple[str, str, str], ...]:
    """(kind, stem, pattern) of an entry; patterns that need some letters are of kind gram, by a piece of these."""
    found = kinds(entry)
    if found[0][0] != "pattern":
        return tuple((k, s, entry if k == "phrase" else "") for k, s in found)
    needed = literals(entry)
    return tuple(("gram", g, entry) for g in sorted({x[-GRAM:] for x in needed})) if needed else (("pattern", "", entry),)


def table(entries: list[tuple]) -> list[tuple]:
    """The columns of entries but the last, then kind, stem, times and pattern of the last, which is the entry."""
    counted = Counter((*of, *x) for *of, e in entries for x in indexed(e))
    return [(*of, k, s, n, p) for (*of, k, s, p), n in counted.items()]
