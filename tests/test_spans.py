"""Places of tokens, paragraphs, tags and lexicon entries against the pattern library and brute force."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from textloom.functions import annotations as A
from textloom.functions import spans as S
from textloom.functions import text as T
from textloom.operators import entries
from textloom.operators import lexicon as L
from textloom.operators import places
from textloom.operators.features import Spec
from textloom.plans import compile as plans

TOKEN = regex.compile(r"\b\p{N}+(?:[.,]\p{N}+)+\b|\b[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*\b")
BREAK = regex.compile(r"\n\s*\n+")


def random_texts(seed, n=80):
    rng = random.Random(seed)
    kit = ["a", "bc", "é", "1", "2.5", "-", "'", " ", "\n", "\n \n", "\t", "😀", ".", "!", "Ñu", "of the", " x "]
    return ["".join(rng.choice(kit) for _ in range(rng.choice([0, 1, 5, 60, 400, 5000]))) for _ in range(n)] + ["", " ", "a", "\n\na\n\n", "x y " * 20_000]


def paragraphs(text):
    out, begin = [], 0
    for m in [*BREAK.finditer(text), None]:
        piece = text[begin : m.start() if m else len(text)]
        if piece.strip():
            lead = begin + len(piece) - len(piece.lstrip())
            out.append((lead, lead + len(piece.strip()), piece.strip()))
        begin = m.end() if m else 0
    return out


def test_tokens_and_paragraphs(spark):
    texts = random_texts(1)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("id", S.token_spans(F.col("t")).alias("tokens"), S.paragraph_spans(F.col("t")).alias("paragraphs")).collect():
        assert [tuple(x) for x in r.tokens] == [(m.start(), m.end(), m.group().lower()) for m in TOKEN.finditer(texts[r.id])]
        assert [tuple(x) for x in r.paragraphs] == paragraphs(texts[r.id])
    row = spark.createDataFrame([(None,)], "t string").select(S.token_spans(F.col("t")).alias("x")).first()
    assert row.x is None


def test_running_sums(spark):
    for n in (0, 1, 15, 16, 17, 255, 257, 5000):
        row = spark.range(1).select(S.running(F.sequence(F.lit(1), F.lit(n)) if n else F.expr(S.NO_SUMS)).alias("x")).first()
        assert row.x == [k * (k + 1) // 2 for k in range(n)]


def test_tag_spans(spark):
    texts = ["casa__(NOUN)(Number=Sing), NOUN__(X), bad,  roja__(ADJ)(A=1|B=2) || y__(CCONJ)()", "", None, " || ,", "a, b__(NOUN)"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", S.tag_spans(F.col("t")).alias("x"), S.entity_spans(F.lit("PER(Juan), LOC(New York)")).alias("e")).collect()
    for r in rows:
        for x in r.x:
            assert texts[r.id][x.start : x.end] == x.word and texts[r.id][x.end : x.end + 3 + len(x.tag)] == f"__({x.tag}"
    assert [[(x.word, x.tag, x.feats) for x in r.x] for r in rows] == [[("casa", "NOUN", ["Number=Sing"]), ("NOUN", "X", []), (" roja", "ADJ", ["A=1", "B=2"]), ("y", "CCONJ", [])], [], [], [], [("b", "NOUN", [])]]
    assert [(x.kind, x.start, x.end, x.text) for x in rows[0].e] == [("PER", 4, 8, "Juan"), ("LOC", 15, 23, "New York")]


def test_uncovered(spark):
    rng, rows = random.Random(3), []
    for k in range(40):
        for _ in range(rng.randint(1, 60)):
            a = rng.randint(0, 40)
            rows.append((k % 7, f"f{k % 3}", a, a + rng.randint(1, 9), rng.random() < 0.3))
    df = spark.createDataFrame(rows, "id int, feature string, start int, end int, is_exception boolean")
    out = [r for r in rows if r[4]]
    expected = sorted(r[:4] for r in rows if not r[4] and not any(e[:2] == r[:2] and e[2] <= r[2] and r[3] <= e[3] for e in out))
    assert sorted((r.id, r.feature, r.start, r.end) for r in L.uncovered(df, "id", "feature").collect()) == expected


ENTRIES = {
    "a": ["casa", "ca\\p{L}*", "a de", "casa", "NEG:casa de", "NEG:ca[ns]a"],
    "b": ["\\p{L}+sa", "de\\s+ca", "co[lr]{2,3}e", "NEG:la casa", "el|la"],
    "c": [":\\)", "ca.a", "(?:el|la) casa", "\\d+ de", "(ca){2,}"],
}


def brute_spans(text, names):
    yes = [e for d in names for e in ENTRIES[d] if not e.startswith("NEG:")]
    no = [e[4:] for d in names for e in ENTRIES[d] if e.startswith("NEG:")]
    find = lambda every: [m.span() for e in every for m in regex.finditer(rf"(?<!\p{{L}})(?:{e})(?!\p{{L}})", text, regex.IGNORECASE)]
    covers = find(no)
    return [s for s in find(yes) if not any(a <= s[0] and s[1] <= b for a, b in covers)]


@pytest.mark.parametrize("names", ["a", "b", "c", "a|b", "a|b|c"])
def test_lexicon_evidence(spark, names):
    rng = random.Random(names)
    words = ["casa", "Casa", "cana", "de", "la", "el", "cosa", "corre", "colle", "caca", "12", ":)", "CASA", "mesa", "é"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text_norm string")
    node = Spec("k", "WordPerDictionary", dictionary=names, percentage=False)
    known = plans.Resources(L.lexicon_of(spark, ENTRIES))
    found: dict = {}
    table = plans.evidence(docs, [node], known)
    for r in table.collect():
        assert texts[r.id][r.start : r.end] == r.text
        found.setdefault(r.id, []).append((r.start, r.end))
    expected = {i: sorted(brute_spans(t, names.split("|"))) for i, t in enumerate(texts)}
    assert {i: sorted(found.get(i, [])) for i in expected} == expected
    values = {r.id: r.k for r in plans.features(docs, [node], known).collect()}
    assert values == {i: len(x) for i, x in expected.items()}
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_plain_mode_takes_entries_as_words(spark):
    """Entries that are no patterns do not fail, repeated ones count once, and exceptions of any dictionary of the feature are out."""
    docs = spark.createDataFrame([(1, "uno dos :) uno tres"), (2, None)], "id int, text_norm string")
    known = plans.Resources(L.lexicon_of(spark, {"a": [":)", "uno", "(dos", "tres"], "b": ["uno", "NEG:Tres"]}))
    node = Spec("k", "WordPerDictionary", dictionary="a|b", percentage=False, disabled_regexp=True)
    assert sorted((r.start, r.end, r.text) for r in plans.evidence(docs, [node], known).collect()) == [(0, 3, "uno"), (11, 14, "uno")]
    assert {r.id: r.k for r in plans.features(docs, [node], known).collect()} == {1: 2.0, 2: 0.0}


def test_tagged_evidence_takes_the_first_occurrences(spark):
    docs = spark.createDataFrame([(1, "vino el vino y vino", "vino__(NOUN)(), el__(DET)(), vino__(NOUN)(), y__(X)(), vino__(VERB)()"), (2, "vino", "")], "id int, text_norm string, tagged_pos string")
    known = plans.Resources(L.lexicon_of(spark, {"a": ["vino", "vi\\p{L}+"]}))
    node = Spec("k", "WordPerDictionary", dictionary="a", percentage=False, pos_tag="NOUN")
    assert [(r.id, r.start) for r in plans.evidence(docs, [node], known).orderBy("start").collect()] == [(1, 0), (1, 8)]
    assert {r.id: r.k for r in plans.features(docs, [node], known).collect()} == {1: 2.0, 2: 0.0}


def test_evidence_has_as_many_spans_as_the_value_counts(spark):
    tagged = "casa__(NOUN)(Number=Sing), roja__(ADJ)() || corre__(VERB)()"
    dep = "casa__(nsubj:pass)(2), vista__(root)(0) || corre__(root)(0)"
    text = "La casa casa roja. 3 veces. la mesa, vista.\n\n— Hola. La vida.\n\nfin"
    docs = spark.createDataFrame([(1, text, text, tagged, dep, "PER(Ana), LOC(Roma), PER(Eva)"), (2, None, None, None, None, None)], "id int, text_norm string, text_raw string, tagged_pos string, tagged_dep string, tagged_ner string")
    nodes = [
        Spec("pattern", "PatternDimension", pattern="[ae]", percentage=False), Spec("commas", "CharacterFrequencyDimension", params={"character": "\\s,"}), Spec("twice", "ErrorMiscTwoOrMoreEqualWordsDimension"),
        Spec("lower", "ErrorCapitalizationStartingWithLowerCaseDimension"), Spec("numbers", "ErrorStyleSentencesStartingWithNumbers"), Spec("same", "ErrorStyleSentencesStartingWithTheSameWord"),
        Spec("dialogue", "DialogueParagraphPercentageDimension"), Spec("paragraphs", "ParagraphCountDimension"), Spec("nouns", "POSTaggingTag", params={"tag": "NOUN"}), Spec("people", "NERTaggingTag", params={"tag": "PER"}), Spec("passive", "PassiveVoiceDependencyDimension"),
    ]
    table = plans.features(docs, nodes, with_parts=True)
    row, parts = table.where("id = 1").first(), plans.parts_in(table)
    found: dict = {}
    sources = {"tagged_pos": tagged, "tagged_dep": dep, "tagged_ner": "PER(Ana), LOC(Roma), PER(Eva)"}
    for r in plans.evidence(docs, nodes).collect():
        node = next(n for n in nodes if n.key == r.dimension)
        assert r.id == 1 and sources.get(places.source_of(node), text)[r.start : r.end] == r.text
        found[r.dimension] = found.get(r.dimension, 0) + 1
    for n in nodes:
        assert found[n.key] == (row[f"__numerator_{n.key}"] if n.key in parts else row[n.key]) > 0, n.key


def test_spelling_and_enclitics_have_places(spark):
    docs = spark.createDataFrame([(1, "Dámelo ya, malla arbol", "dámelo ya, malla arbol")], "id int, text_raw string, text_norm string")
    known = plans.Resources(L.lexicon_of(spark, {"inf": ["da", "dame"]}), spark.createDataFrame([("arbol", "árbol")], "plain string, accented string"), spark.createDataFrame([("Ya",), ("arbol",), ("dámelo",)], "word string"))
    nodes = [Spec("bad", "ErrorMispellingDimension"), Spec("accents", "ErrorMispellingAccentsDimension"), Spec("enclitics", "EncliticsPersonalPronounsDictionary", dictionary="inf")]
    found = sorted((r.dimension, r.start, r.text) for r in plans.evidence(docs, nodes, known).collect())
    assert found == [("accents", 17, "arbol"), ("bad", 11, "malla"), ("enclitics", 0, "dámelo"), ("enclitics", 0, "dámelo")]


def test_entries_read():
    assert entries.literals(r"(?:hola|adiós) \p{L}+") == ["adiós", "hola"] and entries.literals("ab?cd*") is None and entries.literals(r"co[lr]{2,3}eso") == ["eso"]
    assert entries.literals("hol+a") == ["hol"] and entries.literals("(?=x)abcd") is None and entries.literals("a(bcd|x)") is None
    assert entries.indexed("a|b") == (("word", "a", ""), ("word", "b", "")) and entries.indexed(r"\d{2}")[0][0] == "pattern"


def test_one_scan_for_many_patterns(spark):
    """Five thousand patterns are sought by letters that they need: counts are those of the pattern library, in one scan of the texts."""
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(2500)]
    lexicon = [f"{s}.?x" for s in stems] + [f"{s}[0-9]+" for s in stems]
    texts = [" ".join(rng.choice(stems) + rng.choice(["-x", "12", "", "x"]) for _ in range(30)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text_norm string")
    table = L.matches(docs, L.lexicon_of(spark, {"d": lexicon}))
    found = {r.id: r.n for r in table.groupBy("id").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    ready = [regex.compile(rf"(?<!\p{{L}})(?:{e})(?!\p{{L}})", regex.IGNORECASE) for e in set(lexicon)]
    times = {e: lexicon.count(e) for e in set(lexicon)}
    assert found == {i: n for i, t in enumerate(texts) if (n := sum(times[e] * len(p.findall(t)) for e, p in zip(set(lexicon), ready, strict=True)))}


def test_tags_at_the_ends_of_sentences(spark):
    """White space at the ends of sentences, a comma there, and a line break behind an item, whose feats end before it."""
    text = "\n a__(X)(F=y)\n, b__(Y),  ||  ||  c d__(Z), || e__(W) "
    row = spark.createDataFrame([(text,)], "t string").select(S.tag_spans(F.col("t")).alias("s"), A.pos_items(F.col("t")).alias("p")).first()
    assert [(x.word, x.tag, "|".join(x.feats)) for x in row.s] == [tuple(x) for x in row.p]
    assert all(text[x.start : x.end] == x.word for x in row.s)


def test_runs_sought_by_their_beginnings(spark):
    """Only runs that begin like an entry leave the texts; letters that become ASCII in lower case are among them."""
    pattern = L.run_pattern(L.entries.table([("d", "the"), ("d", r"an\p{L}*"), ("d", "kg"), ("d", "o"), ("d", "ñu")]))
    text = "The ANY xthe kg Kg Kg İx o of Ñu toad"
    runs = spark.createDataFrame([(text,)], "t string").select(T.found(F.col("t"), pattern)).first()[0]
    assert runs == ["The", "ANY", "kg", "Kg", "Kg", "İx", "o", "of", "Ñu"]


def test_only_features_with_exceptions_are_sorted(spark):
    """Matches of features without exceptions stay where they are, and all features of a tree are found in one scan of the texts."""
    words, tags = ["casa", "Casas", "vino", "el", "vi", "a-casa", "é", "casa,"], ["NOUN", "VERB", "DET"]
    rng, rows = random.Random(5), []
    for k in range(40):
        own = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((k % 37, " ".join(own), ", ".join(f"{w.strip(',')}__({rng.choice(tags)})()" for w in own)))
    docs = spark.createDataFrame([*rows, (None, "casa vino", "casa__(NOUN)(), vino__(DET)()")], "id int, text_norm string, tagged_pos string")
    known = plans.Resources(L.lexicon_of(spark, {"a": ["casa", "casa", "ca\\p{L}*", "vi\\p{L}+"], "b": ["vi\\p{L}*", "NEG:vino", "el casa"]}))
    tagged = Spec("tagged", "WordPerDictionary", dictionary="a", percentage=False, pos_tag="NOUN")
    nodes = [Spec("free", "WordPerDictionary", dictionary="a"), Spec("swept", "WordPerDictionary", dictionary="a|b"), Spec("plain", "WordPerDictionary", dictionary="a", disabled_regexp=True), tagged]
    rows_of = lambda own: sorted(map(str, plans.evidence(docs, own, known).collect()))
    alone = [rows_of([n]) for n in nodes]
    assert all(alone) and rows_of(nodes) == sorted(sum(alone, []))
    plan_of = lambda own: plans.evidence(docs, own, known)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan_of(nodes[:1]) and "Window" in plan_of(nodes[1:2])
    assert "regexp_extract_all" not in plan_of([*nodes[:2], tagged])
