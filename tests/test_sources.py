"""Dictionaries with affixes, emoji names, strict lines, and audits of planted violations."""

import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.audit import LINE_RULES, METADATA_RULES, audit
from textloom.operators.features import Spec
from textloom.plans import compile as plans
from textloom.sources import hunspell, readers

AFF = """SET UTF-8
FLAG UTF-8
NEEDAFFIX X
FORBIDDENWORD !
PFX P Y 2
PFX P 0 re .
PFX P a ina [a]
PFX Q N 1
PFX Q 0 des [^aeiou]
SFX S Y 3
SFX S 0 s [aeiouñ]
SFX S 0 es/T [^aeiou-s]
SFX S z ces z
SFX T Y 1
SFX T 0 ito .
SFX N N 1
SFX N ar ó ar
"""
STEMS = {"casa": "SP", "cantar": "NPQ", "luz": "S", "bar": "SQ", "ñandú": "", "tor": "SX", "a/b": "S", "malo": "!", "males": "!", "mal": "S", "árbol": "STP", "no": "Z", "go-s": "S"}


def brute_forms():
    """All forms by rules as plain functions: (kind, flag, crosses, strip, add, condition, own flags)."""
    rules, cross = [], {}
    for line in AFF.splitlines():
        w = line.split()
        if w[0] in ("PFX", "SFX"):
            if (w[0], w[1]) in cross:
                add, _, own = w[3].partition("/")
                rules.append((w[0], w[1], cross[w[0], w[1]], w[2].replace("0", ""), add, w[4].replace("u-s", "u\\-s"), own))
            else:
                cross[w[0], w[1]] = w[2] == "Y"

    def apply(word, flags, kind):
        for k, flag, crosses, strip, add, condition, own in rules:
            if k == kind and flag in flags:
                if kind == "SFX" and re.search(f"(?:{condition})$", word) and word.endswith(strip) and len(word) > len(strip):
                    yield word[: len(word) - len(strip)] + add, own, crosses
                if kind == "PFX" and re.search(f"^(?:{condition})", word) and word.startswith(strip) and len(word) > len(strip):
                    yield add + word[len(strip) :], own, crosses

    out, bad = set(), {w for w, f in STEMS.items() if "!" in f}
    for word, flags in STEMS.items():
        if "!" in flags:
            continue
        out |= set() if "X" in flags else {word}
        once = list(apply(word, flags, "SFX"))
        twice = [x for w, own, _ in once for x in apply(w, own, "SFX")]
        out |= {w for w, _, _ in once + twice} | {w for w, _, _ in apply(word, flags, "PFX")}
        out |= {w for s, own, crosses in once + twice if crosses for w, _, c in apply(s, flags + own, "PFX") if c}
    return out - bad


def test_hunspell(spark, tmp_path):
    (tmp_path / "own.aff").write_text(AFF)
    lines = ["13", *(f"{w.replace('/', chr(92) + '/')}{'/' + f if f else ''}" + ("\tpo:noun" if w == "luz" else " po:noun" if w == "bar" else "") for w, f in STEMS.items()), ""]
    (tmp_path / "own.dic").write_text("\n".join(lines))
    found = sorted(r.word for r in hunspell.words(spark, str(tmp_path / "own")).collect())
    assert found == sorted(brute_forms())
    assert {"recasas", "luces", "cantó", "desbar", "toresito", "reárbolesito", "inárboles"} & set(found) == {"recasas", "luces", "cantó", "desbar", "toresito", "reárbolesito"}
    assert "tor" not in found and "males" not in found and "recantó" not in found
    docs = spark.createDataFrame([(1, "Casas recasas malo luces xyz"), (2, None)], "id int, text_raw string")
    rows = plans.features(docs, [Spec("bad", "ErrorMispellingDimension")], plans.Resources(known=hunspell.words(spark, str(tmp_path / "own")))).collect()
    assert {r.id: r.bad for r in rows} == {1: 40.0, 2: 0.0}


@pytest.mark.parametrize(("kind", "one", "two"), [("long", "Aa", "Bb"), ("num", "12", "7")])
def test_hunspell_flags_and_aliases(spark, tmp_path, kind, one, two):
    (tmp_path / "x.aff").write_bytes(f"SET ISO8859-1\nFLAG {kind}\nAF 1\nAF {one}{',' if kind == 'num' else ''}{two}\nSFX {one} Y 1\nSFX {one} 0 s .\nPFX {two} Y 1\nPFX {two} 0 é .\n".encode("latin-1"))
    (tmp_path / "x.dic").write_bytes("1\nniño/1\n".encode("latin-1"))
    assert sorted(r.word for r in hunspell.words(spark, str(tmp_path / "x")).collect()) == sorted(["niño", "niños", "éniño", "éniños"])


def test_emojis_by_the_longest_sequence(spark):
    man, tone, joiner, laptop, heart, vs = "\U0001f468", "\U0001f3fd", "\u200d", "\U0001f4bb", "\u2764", "\ufe0f"
    names = {man: "man", man + tone: "man_medium", man + joiner + laptop: "coder", man + tone + joiner + laptop: "coder_medium", heart: "heart", heart + vs: "red_heart", laptop: "laptop", "\U0001f1ea\U0001f1f8": "Spain"}

    def walked(text):
        out, at = "", 0
        while at < len(text):
            known = next((n for n in range(len(text) - at, 0, -1) if text[at : at + n] in names), 0)
            out += f" /{names[text[at : at + known]]}/ " if known else text[at]
            at += known or 1
        return out.replace("//", "/ /")

    kit = [man, tone, joiner, laptop, heart, vs, "a", "\U0001f1ea\U0001f1f8", "\U0001f1ea", "/"]
    texts = ["".join(x) for n in range(4) for x in itertools.product(kit, repeat=n)] + [man + tone + joiner + laptop + heart + vs, "http://x" + heart]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.emojis_named(F.col("t"), names).alias("x"), T.emojis_named(F.col("t"), {}).alias("none")).collect()
    assert {r.i: r.x for r in rows} == {i: walked(t) for i, t in enumerate(texts)} and all(r.none == texts[r.i].replace("//", "/ /") for r in rows)
    docs = plans.prepared(spark.createDataFrame([(1, f"Hola{heart}{vs}!"), (2, None)], "id int, text string"), emojis=names)
    assert [r.text_norm for r in docs.orderBy("id").collect()] == ["hola /red_heart/!", ""]


HEAD = {"_type": "metadata", "schema_version": "1.1", "dimensions": ["a", "b"], "dimension_metadata": {"a": {"evidence": {"kind": "text_span", "source": "t", "unit": "characters", "cardinality": "numerator"}}, "b": {}}}
SPAN = {"text": "x", "start": 0, "end": 1}


def document(number, **changes):
    own = {"_type": "document", "id": number, "reference_lengths": {"t": 9}, "dimensions": {"a": {"value": 1.0, "numerator": 1, "denominator": 2.5, "evidence": [SPAN]}, "b": {"value": None}}}
    for path, value in changes.items():
        at = own
        *way, last = path.split("__")
        for step in way:
            at = at[step]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return own


PLANTED = {
    "record is unknown": [{"_type": "thing"}, {"_type": ...}], "identifier is missing": [{"id": ...}, {"id": None}], "dimensions are no mapping": [{"dimensions": []}, {"dimensions": ...}],
    "dimension is missing": [{"dimensions__b": ...}], "dimension is unexpected": [{"dimensions__c": {"value": 1}}], "lengths are no mapping": [{"reference_lengths": [1], "dimensions__a": 1.0}],
    "length is no count": [{"reference_lengths__u": -1}, {"reference_lengths__u": "9"}, {"reference_lengths__u": True}, {"reference_lengths__u": 1.5}], "dimension is no mapping": [{"dimensions__b": "x"}, {"dimensions__b": [1]}, {"dimensions__b": True}],
    "value is missing": [{"dimensions__b": {}}], "numerator is no number": [{"dimensions__b__numerator": "1"}, {"dimensions__b__numerator": True}], "denominator is no number": [{"dimensions__b__denominator": [1]}],
    "evidence is no list": [{"dimensions__b__evidence": {}}], "evidence is missing": [{"dimensions__a__evidence": ...}], "numerator is not the number of spans": [{"dimensions__a__numerator": 2}, {"dimensions__a__numerator": None}],
    "length of the source is missing": [{"reference_lengths": {}}], "span is no mapping": [{"dimensions__a__evidence": [7]}], "start is no count": [{"dimensions__a__evidence": [SPAN | {"start": -1}]}, {"dimensions__a__evidence": [SPAN | {"start": False}]}],
    "end is no count": [{"dimensions__a__evidence": [SPAN | {"end": "1"}]}], "span ends before it starts": [{"dimensions__a__evidence": [SPAN | {"start": 5, "end": 4}]}], "span ends beyond its text": [{"dimensions__a__evidence": [SPAN | {"end": 10}]}],
}


def test_audit_finds_every_planted_violation(spark, tmp_path):
    lines, expected, offenders = [json.dumps(HEAD), *(json.dumps(document(k)) for k in range(20))], {}, {}
    for rule, every in PLANTED.items():
        for changes in every:
            lines.append(json.dumps(document(100 + len(lines), **changes)))
            expected[rule] = expected.get(rule, 0) + 1
            offenders.setdefault(rule, set()).add(len(lines))
    lines += ["{not json", '{"_type":"document","_type":"document","id":1}', "", json.dumps(document(3)), json.dumps(document(3))]
    expected |= {"line is no JSON": 2, "identifier is repeated": 2}
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = {r.rule: r for r in audit(readers.numbered_lines(spark, str(tmp_path / "x.jsonl"))).collect()}
    assert {k: r.violations for k, r in rows.items()} == {k: expected.get(k, 0) for k in (*METADATA_RULES, *LINE_RULES)}
    for rule, places in offenders.items():
        assert rows[rule].offenders and {int(re.search(r"jsonl:(\d+)", x)[1]) for x in rows[rule].offenders} <= places


def test_audit_takes_the_lines_once_for_all_rules(spark, tmp_path):
    escaped = json.dumps(HEAD).replace('"metadata"', '"meta\\u0064ata"', 1)
    values = [escaped, *(json.dumps(document(k % 3)) for k in range(7)), json.dumps(document(9, id=...)), "{"]
    (tmp_path / "x").write_text("\n".join(f"f:{k}\t{v}" for k, v in enumerate(values)))
    lines = spark.read.text(str(tmp_path / "x")).select(F.substring_index("value", "\t", 1).alias("place"), F.regexp_extract("value", "\t(.*)", 1).alias("value"))
    table = audit(lines)
    rows = {r.rule: r for r in table.where("violations > 0").collect()}
    assert {k: r.violations for k, r in rows.items()} == {"identifier is repeated": 4, "identifier is missing": 1, "line is no JSON": 1}
    assert set(rows["identifier is repeated"].offenders) <= {"f:1 0", "f:2 1", "f:3 2"} and rows["line is no JSON"].offenders == ["f:9 "]
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_audit_of_metadata(spark):
    def rules(*heads):
        lines = spark.createDataFrame([(str(k), json.dumps(h)) for k, h in enumerate(heads)], "place string, value string")
        return {r.rule: r.violations for r in audit(lines).where("violations > 0").collect()}

    bad = HEAD | {"schema_version": "7", "dimensions": ["a", "a", "c"], "dimension_metadata": {"a": {"evidence": 1}, "b": {"evidence": {"kind": "text_span"}}}}
    assert rules(bad) == {"version is unknown": 1, "dimension is declared twice": 1, "dimension has no metadata": 1, "metadata of no dimension": 1, "descriptor is no mapping": 1, "descriptor lacks a field": 2}
    assert rules(HEAD | {"dimensions": "a"}) == {"dimensions are no list": 1} and rules(HEAD, HEAD) == {"metadata is missing or repeated": 1} and rules() == {"metadata is missing or repeated": 1}


def test_strict_lines_name_file_and_line(spark, tmp_path):
    good = [json.dumps(HEAD), json.dumps(document(1)), "", json.dumps(document(2))]
    for number, (lines, match) in enumerate([([*good, "{"], r"jsonl:5: no JSON"), ([*good, '{"_type":"document","id":1,"id":2}'], "jsonl:5: no JSON, or a key"), ([good[1], good[0]], "jsonl:1: a document stands before"), ([*good, '{"_type":"x"}'], "jsonl:5: unknown record 'x'")]):
        path = tmp_path / f"{number}.jsonl"
        path.write_text("\n".join(lines))
        with pytest.raises(ValueError, match=match):
            readers.read_jsonl(spark, str(path))
    (tmp_path / "good.jsonl").write_text("\n".join(good))
    assert readers.read_jsonl(spark, str(tmp_path / "good.jsonl"))[1].count() == 2
    numbered = readers.numbered_lines(spark, str(tmp_path / "good.jsonl")).orderBy("line").collect()
    assert [(r.line, r.value) for r in numbered] == list(enumerate(good, 1))


def test_line_numbers_over_blocks(spark, tmp_path):
    lines = [f"line {k} {'x' * (k % 50)}" for k in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("\n".join(lines[:7]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3007 and all(lines[r.line - 1] == r.value for r in rows) and {r.place.rpartition("/")[2] for r in rows} >= {"a.txt:3000", "b.txt:7"}
