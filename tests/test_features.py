"""Golden rows and null rows of the feature operators, and the plans that they compile to."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import lexicon as L
from textloom.operators import sequences
from textloom.operators.features import REGISTRY, Spec
from textloom.plans import compile as plans
from textloom.plans.catalog import spec


def value(spark, node, resources=None, **columns):
    docs = spark.createDataFrame([(0, *columns.values()), (1, *(None for _ in columns))], "id bigint, " + ", ".join(f"{c} string" for c in columns))
    rows = {r.id: r[node.key] for r in plans.features(docs, [node], resources).collect()}
    assert rows[1] is None or rows[1] == 0 or node.operator in ("RatioDimension",)
    return rows[0]


POS = "El__(DET)(Gender=Masc|Number=Sing), perro__(NOUN)(Number=Sing), ,__(PUNCT), come__(VERB)() || bad item, Gatos__(NOUN)(Number=Plur)"
DEP = "El__(det)(2), perro__(nsubj)(3), come__(root)(0) || broken, fue__(aux:pass)(3), visto__(root)(0)"

CASES = [
    (spec("k", "LengthDimension"), {"text_norm": "hola 😀"}, 6),
    (spec("k", "AverageWordLengthDimension"), {"text_norm": "uno dos tres"}, 10 / 3),
    (spec("k", "WordLengthDimension", comparator=">", length=3), {"text_norm": "uno dos tres"}, 100 / 3),
    (spec("k", "WordLengthDimension", comparator="<=", length=3, percentage="false"), {"text_norm": "uno dos tres"}, 2),
    (spec("k", "WordCountDimension"), {"text_norm": "3,14 bien-estar don't a_b"}, 3),
    (spec("k", "CharacterFrequencyDimension", character="SPACE,"), {"text_norm": "a, b, c"}, 400 / 7),
    (spec("k", "CharacterFrequencyDimension", character="\\s"), {"text_norm": "a b\n"}, 50),
    (spec("k", "SyllableCountDimension"), {"text_norm": "casa árbol psst"}, 5),
    (spec("k", "SentenceCountDimension"), {"text_norm": "Sí. ¿No? Bueno..."}, 3),
    (spec("k", "WordPerSentenceDimension"), {"text_norm": "el dr. vino a las 3.5. bien!"}, 3.5),
    (spec("k", "WordUniqueDimension"), {"text_norm": "a b a A"}, 50),
    (spec("k", "WordCase", comparator="upper"), {"text_raw": "@yo HOLA mundo 12 https://x.es"}, 50),
    (spec("k", "WordCase", comparator="title"), {"text_raw": "hola Mundo de Ana"}, 50),
    (spec("k", "RTIEDimension", separator="by-sentence"), {"text_norm": "a a. b c."}, 0.75),
    (spec("k", "RTIEDimension", separator="by-chunks", chunk_size=2), {"text_norm": "a a b c d"}, (0.5 + 1 + 1) / 3),
    (spec("k", "RTIEDeviationDimension", separator="by-chunks", chunk_size=2), {"text_norm": "a a b c"}, 0.25),
    (spec("k", "ReadabilityDimension"), {"text_norm": "la casa. el sol"}, 206.84 - 60 * 5 / 4 - 102 * 2 / 4),
    (spec("k", "PerspicuityDimension"), {"text_norm": "la casa. el sol."}, 206.835 - 62.3 * 5 / 4 - 2),
    (spec("k", "PatternDimension", pattern="Ñ"), {"text_norm": "ñuÑ."}, 50),
    (spec("k", "PatternDimension", pattern=r"(\p{Extended_Pictographic})\1", percentage=False), {"text_norm": "😀😀 ok"}, 1),
    (spec("k", "POSTaggingExpression", pattern=r"__\(NOUN\)", percentage=False), {"tagged_pos": POS}, 2),
    (spec("k", "POSTaggingTag", tag="NOUN"), {"tagged_pos": POS}, 40),
    (spec("k", "POSTaggingTag", tag="NOUN", universal="Number=Sing"), {"tagged_pos": POS}, 20),
    (spec("k", "NERTaggingTag", tag="PER"), {"tagged_ner": "PER(Juan Gil), LOC(Murcia)"}, 50),
    (spec("k", "NERTaggingTag", tag="LOC", normalizer="words"), {"tagged_ner": "PER(Juan Gil), LOC(Murcia)"}, 100 / 3),
    (spec("k", "DependencyTag", deprel="nsubj"), {"tagged_dep": DEP}, 20),
    (spec("k", "DependencyDepthDimension", mode="max"), {"tagged_dep": DEP}, 2),
    (spec("k", "DependencyDepthDimension", mode="sum"), {"tagged_dep": "a__(x)(2), b__(y)(1), c__(z)(9)"}, 4),
    (spec("k", "DependencyDistanceDimension"), {"tagged_dep": DEP}, 1),
    (spec("k", "PassiveVoiceDependencyDimension"), {"tagged_dep": DEP}, 50),
    (spec("k", "RootPOSTagDimension", tag="VERB"), {"tagged_pos": "a__(NOUN), b__(VERB)", "tagged_dep": "a__(x)(2), b__(root)(0)"}, 100),
    (spec("k", "ErrorCapitalizationStartingWithLowerCaseDimension"), {"text_norm": "«hola. Adiós. 12."}, 50),
    (spec("k", "ErrorMiscTwoOrMoreEqualWordsDimension"), {"text_norm": "el el perro. No no no."}, 2),
    (spec("k", "ErrorStyleSentencesStartingWithNumbers"), {"text_norm": "3 casas. Tres. (4) más."}, 200 / 3),
    (spec("k", "ErrorStyleSentencesStartingWithTheSameWord"), {"text_norm": "Yo fui. Yo vine. Tú no."}, 200 / 3),
    (spec("k", "ParagraphCountDimension"), {"text_norm": "a b\n \n c\nd\n\n\n"}, 2),
    (spec("k", "AverageParagraphLengthDimension"), {"text_norm": "a b\n\nc d e f"}, 3),
    (spec("k", "ParagraphLengthDeviationDimension"), {"text_norm": "a b\n\nc d e f"}, 1),
    (spec("k", "DialogueParagraphPercentageDimension"), {"text_norm": "— hola\n\nc"}, 50),
]


@pytest.mark.parametrize(("node", "columns", "wanted"), CASES, ids=lambda x: x.operator if isinstance(x, Spec) else None)
def test_golden(spark, node, columns, wanted):
    assert math.isclose(value(spark, node, **columns), wanted, abs_tol=1e-9)


def test_all_row_wise_operators_are_tested():
    assert {c[0].operator for c in CASES} | {"SyllablePerWordDimension"} >= REGISTRY.keys()


def test_lexicon_semantics(spark):
    words = L.lexicon_of(spark, {"d": ["casa", "casa", r"cas\p{L}*", r"casa\p{L}+", "de la"], "e": [r"gat\p{L}*", "NEG:gatos negros"], "v": ["ido", "ha ido"], "i": ["dar", "comer"]})
    resources = plans.Resources(words)
    assert value(spark, spec("k", "WordPerDictionary", dictionary="d", percentage=False), resources, text_norm="Casa casas DE LA decasa") == 3 + 2 + 1
    assert value(spark, Spec("k", "WordPerDictionary", dictionary="d", disabled_regexp=True, percentage=False), resources, text_norm="Casa casa x") == 2
    assert value(spark, spec("k", "WordPerDictionary", dictionary="e", percentage=False), resources, text_norm="gatos negros y gato") == 1
    assert value(spark, spec("k", "WordPerDictionary", dictionary="d|e", pos_tag="NOUN", percentage=False), resources, text_norm="casa gato casa", tagged_pos="casa__(NOUN), gato__(ADJ), casa__(VERB)") == 1
    assert value(spark, spec("k", "VerbPerDictionary", dictionary="v"), resources, text_norm="él ha ido ido no") == 40
    assert value(spark, spec("k", "EncliticsPersonalPronounsDictionary", dictionaries="i"), resources, text_norm="dármelo comerlas dar") == pytest.approx(200 / 3)


def test_periphrases(spark):
    pos = ", ".join(f"{w}__({t})({f})" for w, t, f in (("voy", "AUX", ""), ("a", "ADP", ""), ("comer", "VERB", "VerbForm=Inf"), ("voy", "VERB", ""), ("mal", "ADV", "")))
    node = spec("k", "PeriphrasisDimension", auxiliar_verbs="voy(a)+infinitive,estar+gerund")
    assert value(spark, node, text_norm="voy a comer voy mal", tagged_pos=pos) == 1
    assert sequences.grammar("ir(a|hacia)+infinitive") == [("ir", ["a", "hacia"], "Inf")]


def test_words_lists(spark):
    docs = spark.createDataFrame([(0, "Tú estas qeu HTML iPhone camion"), (1, None)], "id bigint, text_raw string")
    known = spark.createDataFrame([("tú",), ("estás",), ("camión",)], "word string")
    rows = sequences.unknown_words(docs, known, "k").orderBy("id").collect()
    assert rows[0].k == pytest.approx(75) and rows[1].k == 0
    rows = sequences.missing_accents(docs, sequences.accent_map(known), "k").orderBy("id").collect()
    assert rows[0].k == pytest.approx(100 * 2 / 6)


def count_periphrases(tokens, tags, rules):
    """Walks along the tokens; of a document's tokens, (tag, feats) and the rules of grammar()."""
    found = at = 0
    while at < len(tokens):
        step = 1
        for verb, linkers, form in rules:
            if tokens[at] in (verb, *(verb + p for p in sequences.PRONOUNS)):
                for linker in [x.split() for x in linkers] or [[]]:
                    place = at + 1 + len(linker)
                    if tokens[at + 1 : place] == linker and place < min(len(tokens), len(tags)) and tags[place][0] in ("VERB", "AUX") and f"VerbForm={form}" in tags[place][1].split("|"):
                        step = max(step, place - at + 1)
        found += step > 1
        at += step
    return found


def test_periphrases_are_counted_in_the_jvm(spark):
    rng, rows, expected = random.Random(5), [], []
    specifications = {"a": "voy(a|a por)+infinitive,estar+gerund", "b": "a(voy)+infinitive,voy(a|a a)+gerund", "c": "", "d": "voy+"}
    for k in range(300):
        tokens = [rng.choice(["voy", "a", "por", "estar", "estarme", "x"]) for _ in range(rng.randint(0, 12))]
        items = [(w, rng.choice(["VERB", "AUX", "NOUN"]), rng.choice(["VerbForm=Inf", "A=b|VerbForm=Ger", "XVerbForm=Inf", ""])) for w in tokens]
        bad = lambda: rng.choice(["", "", "", "mal, ", "__(VERB)(VerbForm=Inf), ", "x__(VERB)(VerbForm=Inf)y, ", "x__(VERB, "]) if k % 3 == 0 else ""
        text = "".join(bad() + f"{w}__({t})" + (f"({f})" if f or rng.random() < 0.5 else "") + rng.choice([", ", ", ", " || ", " ||  || "] if k % 5 else [", "]) for w, t, f in items)
        rows.append((k, " ".join(tokens), text.rstrip(", |") if k % 7 else None))
        expected.append([count_periphrases(tokens, [(t, f) for _, t, f in items] if k % 7 else [], sequences.grammar(s)) for s in specifications.values()])
    docs = spark.createDataFrame(rows, "id bigint, text_norm string, tagged_pos string")
    table = plans.features(docs, [spec(k, "PeriphrasisDimension", auxiliar_verbs=s) for k, s in specifications.items()])
    assert [list(r[1:]) for r in table.orderBy("id").collect()] == expected and sum(e[0] + e[1] for e in expected) > 50
    assert "InArrow" not in table._jdf.queryExecution().executedPlan().toString()


def test_runs_meet_word_lists_before_the_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "uno dos dos tres camion camion"), (1, ""), (2, "Dos HTML x uno camión cuatro")], "id bigint, text_raw string")
    known = spark.createDataFrame([("uno",), ("Dos",), ("dos",), ("camión",)], "word string")
    rows = lambda df: [(r.id, r.k) for r in df.orderBy("id").collect()]
    make = [lambda: sequences.unknown_words(docs, known, "k"), lambda: sequences.missing_accents(docs, sequences.accent_map(known), "k")]
    few = [f() for f in make]
    assert not any("hashpartitioning(id#" in p and ", run#" in p for f in few for p in f._jdf.queryExecution().executedPlan().toString().split("\n"))
    found = [rows(f) for f in few]
    assert found == [[(0, 50.0), (1, 0.0), (2, 25.0)], [(0, pytest.approx(100 / 3)), (1, 0.0), (2, 0.0)]]
    monkeypatch.setattr(sequences, "MAX_BROADCAST", 0)
    assert found == [rows(f()) for f in make]


def test_derived_in_any_order(spark):
    tree = [spec("r", "RatioDimension", numerator="a|b", denominator="zero", zero_division=-1), spec("s", "CompositeDimension", strategy="CompositeStrategyMax", children=[spec("a", "LengthDimension"), spec("b", "WordCountDimension")]), spec("zero", "PatternDimension", pattern="#", percentage=False), spec("none", "CompositeDimension", children=[spec("c", "LengthDimension")])]
    docs = spark.createDataFrame([(0, "uno dos")], "id bigint, text_norm string")
    table = plans.features(docs, tree)
    assert table.columns == ["id", "r", "a", "b", "s", "zero", "c", "none"]
    assert table.first()[1:] == (-1.0, 7.0, 2.0, 7.0, 0.0, 7.0, None)


def test_normalization(spark):
    cases = {
        "Hola &amp; <b>adiós</b>": "hola & adiós", "@yo: mira https://x.es/a ya": "mira ya", "uno\ndos.\n\ntres": "uno. dos. tres", "siiii!!! 1111": "si! 1", "RT #tema hola": "tema hola",
        "a  ,b . c...": "a,b. c.", None: "", "\n x": "x",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.normalized(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases
    row = spark.createDataFrame([("xq NO $",)], "t string").select(T.normalized(F.col("t"), preserve_case=True, abbreviations={"XQ": "por $qué"}).alias("n")).first()
    assert row.n == "por $qué NO $"


def test_no_python_in_row_wise_plans(spark):
    docs = plans.prepared(spark.createDataFrame([(0, "x")], "id bigint, text string"))
    nodes = [Spec(f"k{i}", c[0].operator, pattern="x", params=dict(c[0].params)) for i, c in enumerate(CASES)]
    plan = plans.features(docs, nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan  # a name of an HTML reference may hold "Arrow"


def test_html_references(spark):
    """The characters of Python's own rules, with and without semicolons, and what is no reference."""
    import html

    texts = ["&lt;b&gt;", "&amp;lt;", "&notit;", "&#65;&#x41", "&#X1F600;", "&#0;&#128;&#129;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#x1;", "AT&T R&D & &&", "&eacute;&copy2", "&x &#", "&#xfdd0;a", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.unescaped(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [t and html.unescape(t) for t in texts]


def test_line_breaks_of_any_length(spark):
    import re

    def plainly(text):
        def by(m):
            before = text[: m.start()].rstrip()
            return " " if not before or before[-1] in ".!?" else ". "

        return re.sub(r"[\r\n]+", by, text)

    texts = ["a\nb", "a.\nb", " \n \nx", f"a.{' ' * 5000}\nb", f"a{' ' * 70}\n \n b", "a!\r\n\t\r\nb\n", f"a{chr(10)}{' ' + chr(10):s}" * 3, "\n" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.line_breaks_replaced(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [plainly(t) for t in texts]


def test_word_case_counts_uncased_words(spark):
    """Words without case fit both rules, the configuration's name of the parameter wins, and upper is the default."""
    docs = spark.createDataFrame([(1, "HOLA mundo 漢字 12 ABC @you x")], "id int, text_raw string")
    trees = [Spec(k, "WordCase", params=p) for k, p in (("default", {}), ("lower", {"word_comparator": "lower", "comparator": "upper"}), ("title", {"comparator": "title"}))]
    row = plans.features(docs, trees).first()
    assert (row.default, row.lower, row.title) == (60.0, 60.0, 0.0)


def test_gender_is_of_the_tagged_items(spark):

    tagged = "casa__(NOUN)(), roja__(ADJ)(), y__(CCONJ)(), muy__(ADV)(), bien__(ADV)(), hoy__(ADV)()"
    docs = spark.createDataFrame([(1, "casa roja y muy bien hoy", tagged, ""), (2, "y", "y__(CCONJ)()", "")], "id int, text_norm string, mine string, tagged_pos string")
    lexicon = L.lexicon_of(spark, {"feminine": ["casa", "roja"]})
    trees = [Spec("own", "GrammaticalGenderDimension", dictionary="feminine", params={"tagged_pos_column": "mine"}), Spec("none", "GrammaticalGenderDimension", dictionary="feminine")]
    rows = {r.id: r for r in plans.features(docs, trees, plans.Resources(lexicon)).collect()}
    assert (rows[1].own, rows[1].none, rows[2].own) == (100.0, 0.0, 0.0)


def test_defaults(spark):
    docs = spark.createDataFrame([(1, " ".join(["a", "b"] * 600))], "id int, text_norm string")
    row = plans.features(docs, [Spec("chunks", "RTIEDimension"), Spec("length", "WordLengthDimension")]).first()
    assert (row.chunks, row.length) == (pytest.approx((2 / 1000 + 2 / 200) / 2), 0.0)


def test_too_many_entries_are_an_error(spark, monkeypatch):

    docs = spark.createDataFrame([(1, "a b")], "id int, text_norm string")
    monkeypatch.setattr(L, "MAX_BROADCAST", 2)
    with pytest.raises(ValueError, match="entries at most"):
        L.occurrences(docs, L.lexicon_of(spark, {"d": ["a", "b", "NEG:c"]}), "id", "text_norm")


def test_sentences_end_beyond_any_white_space(spark):
    """Stops against a walk over each of them; abbreviations may be followed by any white space and any number of points."""
    import random
    import re

    import regex

    short = {"dr", "dra", "etc", "prof", "profa", "sr", "sra", "srta"}

    def walked(text):
        text = text.strip()
        ends = 0
        for m in re.finditer(r"[.!?]+", text):
            near = text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1]
            token = regex.search(r"[\p{L}.]+$", text[: m.start()].rstrip())
            ends += not (m.group() == "." and m.start() and len(near) == 2 and near.isdigit()) and not (token and token.group().lower().strip(".") in short)
        return max(1, ends) if text else 0

    rng = random.Random(11)
    kit = ["Sr", "etc", "dra", "x", "Vale", "3", ".", ".", "..", "!", "?", " ", "  ", "\n", ",", "é"]
    texts = ["".join(rng.choice(kit) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["Hola. Sr" + " " * n + ". Vale." for n in (8, 9, 500)] + ["Sr" + "." * n + " ! x" for n in (1, 17, 400)] + ["." * 50_000, "a" + " " * 50_000 + "."]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.sentence_count(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: walked(t) for i, t in enumerate(texts)}


def test_many_verb_nodes_take_one_scan(spark, tmp_path):
    """Twenty-six features of dictionaries that overlap: the values of each by itself, one scan of the texts, and parts beside the values."""
    spark.createDataFrame([(1, "él ha ido y va ido no"), (2, ""), (None, "va"), (4, None)], "id int, text_norm string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    lexicon = L.lexicon_of(spark, {f"d{k}": ["ido", "ha ido", "va", "no"][: k % 5] for k in range(26)})
    nodes = [Spec(f"k{k}", "VerbPerDictionary", dictionary=f"d{k}|d{(k + 1) % 26}") for k in range(26)]
    table = plans.features(docs, nodes, plans.Resources(lexicon), with_parts=True)
    rows = {r.id: r for r in table.collect()}
    for k, n in enumerate(nodes):
        words = {w for d in (k, (k + 1) % 26) for w in ["ido", "ha ido", "va", "no"][: d % 5]}
        hits = sum(c in words for c in ("él", "ha", "ha ido", "y", "va", "ido", "no"))
        assert rows[1][n.key] == pytest.approx(100 * hits / 7) and rows[2][n.key] == rows[4][n.key] == 0 and rows[None][n.key] == 100.0 * ("va" in words)
        assert (rows[1][f"__numerator_k{k}"], rows[1][f"__denominator_k{k}"]) == (hits, 7)
    rates = L.verb_rates(docs, lexicon, {n.key: n.listed("dictionary") for n in nodes})
    assert rates._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
