"""Named queries over the test tables, each with DuckDB SQL where SQL can express it.

Queries run over whole tables. Annotations that no table has are made from the tokens by a rule that both sides share.
"""

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from ..operators import evidence as E
from ..operators import lexicon as L
from ..operators import sequences, statistics
from ..operators.audit import LINE_RULES, METADATA_RULES, audit
from ..operators.features import Spec
from ..sources import readers, writers
from ..sources.shared import written
from . import compile as plans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TOKEN = r"\p{N}+(?:[.,]\p{N}+)+|[\p{L}\p{N}]+(?:[-''’][\p{L}\p{N}]+)*"
VOWELS, LETTERS = "[aeiouáéíóúü]+", "^[a-záéíóúüñ]+$"
BASE = rf"""WITH d AS (SELECT doc_id, lang, source, lower(text) AS x, text AS raw FROM documents),
t AS (SELECT *, regexp_extract_all(x, '{TOKEN}') AS w, [v FOR v IN regexp_extract_all(x, '[\p{{L}}\p{{N}}\p{{M}}_]+') IF regexp_matches(v, '{LETTERS}')] AS sw,
  [trim(s, ' ' || chr(9) || chr(10) || chr(13)) FOR s IN regexp_extract_all(x, '[^.!?]+[.!?]*') IF trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> ''] AS sent,
  regexp_replace(regexp_replace(regexp_replace(x, '(\d)\.(\d)', '\1\2', 'g'), '(\d)\.(\d)', '\1\2', 'g'), '(^|[^\p{{L}}.])(dra?|etc|profa?|sra?|srta)\.', '\1\2', 'g') AS y FROM d),
b AS (SELECT *, CAST(len(w) AS DOUBLE) AS nw, CASE WHEN trim(x) = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(y, '[.!?]+'))) END AS ns,
  CAST(coalesce(list_sum([greatest(1, len(regexp_extract_all(v, '{VOWELS}'))) FOR v IN sw]), 0) AS DOUBLE) AS syl FROM t)
"""


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text_norm (only lowered) and text_raw."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.withColumns({"text_raw": T.ensured(F.col("text")), "text_norm": F.lower(T.ensured(F.col("text")))})


TAGS = ["NOUN", "VERB", "ADJ", "DET", "AUX"]
RELATIONS = ["nsubj", "obj", "aux:pass", "det", "root"]


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by the tokens' lengths, sentences of ten tokens, each token's head the one before it."""
    docs = documents(spark, sf_dir).withColumn("words", T.lexical_tokens(F.col("text_norm")))
    of = lambda names, w: F.element_at(F.array(*map(F.lit, names)), F.length(w) % 5 + 1)
    feats = lambda n: "Number=Plur|Gender=Fem" if n % 2 == 0 else "VerbForm=Inf" if n % 3 == 0 else "Number=Sing"
    ends = F.array(*(F.lit(f"__({TAGS[n % 5]})({feats(n)})") for n in range(30)))  # of all remainders that tag and feats go by
    pos = F.transform("words", lambda w: F.concat(w, F.element_at(ends, F.length(w) % 30 + 1)))
    dep = F.transform("words", lambda w, i: F.concat(w, F.lit("__("), of(RELATIONS, w), F.lit(")("), (i % 10).cast("string"), F.lit(")")))
    kinds = F.transform("words", lambda w: F.concat(of(["PER", "LOC", "ORG", "MISC", "PER"], w), F.lit("("), w, F.lit(")")))
    tens = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / 10).cast("int")), lambda k: F.array_join(F.slice(c, k * 10 + 1, F.lit(10)), ", ")), " || ")).otherwise("")
    rows = docs.withColumns({"p": pos, "q": dep, "r": kinds})
    return rows.withColumns({"tagged_pos": tens(F.col("p")), "tagged_dep": tens(F.col("q")), "tagged_ner": F.array_join("r", ", ")}).drop("p", "q", "r")


def features(docs: DataFrame, *specs: Spec, **kwargs) -> DataFrame:
    return plans.features(docs, list(specs), id_col="doc_id", **kwargs)


def spec(key: str, operator: str, **params) -> Spec:
    own = {k: params.pop(k) for k in ("pattern", "dictionary", "universal", "input_column", "pos_tag", "percentage", "strategy", "children") if k in params}
    return Spec(key, operator, params=params, **own)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each document from its normalized text, summarized by language."""
    docs = plans.prepared(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    words = [spec("word_count", "WordCountDimension"), spec("unique", "WordUniqueDimension"), spec("words_per_sentence", "WordPerSentenceDimension"), spec("commas", "CharacterFrequencyDimension", character=",")]
    table = plans.features(docs, [*words, spec("both", "CompositeDimension", strategy="CompositeStrategySum", children=[spec("short", "LengthDimension"), spec("ttr", "RTIEDimension")]), spec("per_word", "RatioDimension", numerator="commas", denominator="word_count")], id_col="doc_id", keep=("lang",))
    return statistics.summary(table, [c for c in table.columns if c not in ("doc_id", "lang")], by=("lang",))


@query("q_common_features", BASE + "SELECT doc_id, length(x) AS text_length, len(w) AS word_count, len(list_distinct(w)) AS unique_word_count, CAST(ns AS BIGINT) AS sentence_count, CAST(syl AS BIGINT) AS syllable_count FROM b")
def common(spark, sf_dir):
    cols = T.common_features()
    return documents(spark, sf_dir).select("doc_id", *(c.cast("bigint").alias(k) for k, c in cols.items() if k != "words"))


@query("q_length", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS len FROM documents")
def q_length(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("len", "LengthDimension"))


@query("q_words", BASE + "SELECT doc_id, nw AS word_count, CASE WHEN nw = 0 THEN 0 ELSE coalesce(list_sum([length(v) FOR v IN w]), 0) / nw END AS average, CASE WHEN nw = 0 THEN 0 ELSE 100.0 * len([v FOR v IN w IF length(v) >= 6]) / nw END AS long_words, CASE WHEN nw = 0 THEN 0 ELSE 100.0 * len(list_distinct(w)) / nw END AS distinct_words FROM b")
def q_words(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("word_count", "WordCountDimension"), spec("average", "AverageWordLengthDimension"), spec("long_words", "WordLengthDimension", comparator=">=", length=6), spec("distinct_words", "WordUniqueDimension"))


@query("q_characters", r"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE 100.0 * (length(text) - length(replace(text, ',', ''))) / length(text) END AS commas, CASE WHEN length(text) = 0 THEN 0 ELSE 100.0 * len(regexp_extract_all(text, '[\s!]')) / length(text) END AS spaces FROM documents")
def q_characters(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("commas", "CharacterFrequencyDimension", character=","), spec("spaces", "CharacterFrequencyDimension", character="\\s!"))


@query("q_readability", BASE + rf""", s AS (SELECT *, len([v FOR v IN regexp_extract_all(x, '[\p{{L}}\p{{M}}\p{{N}}_]+(?:[-''’][\p{{L}}\p{{M}}\p{{N}}_]+)*')]) AS n0, greatest(1, len(regexp_extract_all(x, '[^.!?]+[.!?]*'))) AS spans FROM b)
SELECT doc_id, CASE WHEN ns = 0 THEN 0 ELSE nw / ns END AS per_sentence, CASE WHEN nw = 0 THEN 0 ELSE 206.84 - 60.0 * (syl / nw) - 102.0 * (spans / nw) END AS readability, CASE WHEN nw = 0 OR ns = 0 THEN 0 ELSE 206.835 - 62.3 * (syl / nw) - nw / ns END AS perspicuity FROM s""")
def q_readability(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("per_sentence", "WordPerSentenceDimension"), spec("readability", "ReadabilityDimension"), spec("perspicuity", "PerspicuityDimension"))


@query("q_sentence_counts", BASE + "SELECT doc_id, CAST(CASE WHEN trim(x) = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(x, '[.!?]+'))) END AS DOUBLE) AS endings, syl AS syllables FROM b")
def q_sentence_counts(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("endings", "SentenceCountDimension"), spec("syllables", "SyllableCountDimension"))


#: Runs of letters that nothing but one hyphen or apostrophe ties to letters before them are one word with these.
SYLLABLES = BASE + r""", r AS (SELECT *, regexp_extract_all(x, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+') AS a FROM b),
n AS (SELECT *, len([i FOR i IN range(1, len(a) + 1) IF regexp_matches(a[i], '^\p{L}+$') AND NOT coalesce(i > 2 AND a[i - 1] IN ('-', '''', '’') AND regexp_matches(a[i - 2], '^\p{L}+$'), false)]) AS words FROM r)
SELECT doc_id, CASE WHEN words = 0 THEN 0 ELSE syl / words END AS rate FROM n"""


@query("q_syllables_per_word", SYLLABLES)
def q_syllables_per_word(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("rate", "SyllablePerWordDimension"))


@query("q_type_token", BASE + """, c AS (SELECT *, [len(list_distinct(w[k * 100 + 1 : k * 100 + 100])) / len(w[k * 100 + 1 : k * 100 + 100]) FOR k IN range(CAST(ceil(nw / 100) AS BIGINT))] AS r FROM b)
SELECT doc_id, CASE WHEN nw = 0 THEN 0 ELSE len(list_distinct(w)) / nw END AS whole, coalesce(list_avg(r), 0) AS chunks, CASE WHEN len(r) < 2 THEN 0 ELSE list_stddev_pop(r) END AS deviation FROM c""")
def q_type_token(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("whole", "RTIEDimension", separator="whole"), spec("chunks", "RTIEDimension", separator="by-chunks", chunk_size=100), spec("deviation", "RTIEDeviationDimension", separator="by-chunks", chunk_size=100)).select("doc_id", "whole", F.round("chunks", 9).alias("chunks"), F.round("deviation", 9).alias("deviation"))


ORACLE_SQL["q_type_token"] = ORACLE_SQL["q_type_token"].replace("coalesce(list_avg(r), 0)", "round(coalesce(list_avg(r), 0), 9)").replace("ELSE list_stddev_pop(r) END", "ELSE round(list_stddev_pop(r), 9) END")


@query("q_type_token_by_sentence", BASE + f"""SELECT doc_id, round(coalesce(list_avg([CASE WHEN len(v) = 0 THEN 0 ELSE len(list_distinct(v)) / len(v) END FOR v IN [regexp_extract_all(u, '{TOKEN}') FOR u IN sent]]), 0), 9) AS ttr FROM b""")
def q_type_token_by_sentence(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("ttr", "RTIEDimension", separator="by-sentence")).select("doc_id", F.round("ttr", 9).alias("ttr"))


@query("q_pattern", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)th\p{L}+')) AS DOUBLE) AS n, CASE WHEN length(text) = 0 THEN 0 ELSE 100.0 * len(regexp_extract_all(text, '(?i)\p{N}{2,}')) / length(text) END AS digits FROM documents")
def q_pattern(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("n", "PatternDimension", pattern=r"th\p{L}+", percentage=False), spec("digits", "PatternDimension", pattern=r"\p{N}{2,}"))


@query("q_paragraphs", rf"""WITH p AS (SELECT doc_id, [len(regexp_extract_all(lower(v), '{TOKEN}')) FOR v IN string_split(text, chr(10)) IF trim(v, ' ' || chr(9)) <> ''] AS n, len([v FOR v IN string_split(text, chr(10)) IF regexp_matches(v, '^\s*[—–-]\s*')]) AS dialogue FROM documents)
SELECT doc_id, CAST(len(n) AS DOUBLE) AS paragraphs, round(coalesce(list_avg(n), 0), 9) AS mean_words, CASE WHEN len(n) < 2 THEN 0 ELSE round(list_stddev_pop(n), 9) END AS deviation, CASE WHEN len(n) = 0 THEN 0 ELSE 100.0 * dialogue / len(n) END AS dialogue FROM p""")
def q_paragraphs(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("spread", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    table = features(docs, *(spec(k, o, input_column="spread") for k, o in (("paragraphs", "ParagraphCountDimension"), ("mean_words", "AverageParagraphLengthDimension"), ("deviation", "ParagraphLengthDeviationDimension"), ("dialogue", "DialogueParagraphPercentageDimension"))))
    return table.select("doc_id", "paragraphs", F.round("mean_words", 9).alias("mean_words"), F.round("deviation", 9).alias("deviation"), "dialogue")


WORD_CASE = r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '(?i)https?://\S+|www\.\S+', '', 'g'), '^\s*@[\p{L}\p{N}\p{M}_]+:?\s*', '') AS x FROM documents),
a AS (SELECT doc_id, [v FOR v IN regexp_extract_all(x, '@?[\p{L}\p{N}\p{M}_]+') IF regexp_matches(v, '^@?[\p{L}\p{N}]+$')] AS every FROM c),
w AS (SELECT doc_id, [v FOR v IN every IF v NOT LIKE '@%' AND NOT regexp_matches(v, '^\p{N}+$')] AS words,
  [v FOR v IN [every[i] FOR i IN range(1, len(every) + 1) IF i = 1 OR length(every[i]) > 3] IF v NOT LIKE '@%' AND NOT regexp_matches(v, '^\p{N}+$')] AS longer FROM a)
SELECT doc_id, CASE WHEN len(words) = 0 THEN 0 ELSE 100.0 * len([v FOR v IN words IF v = upper(v)]) / len(words) END AS upper,
  CASE WHEN len(words) = 0 THEN 0 ELSE 100.0 * len([v FOR v IN words IF v = lower(v)]) / len(words) END AS lower,
  CASE WHEN len(longer) = 0 THEN 0 ELSE 100.0 * len([v FOR v IN longer IF regexp_matches(v, '^\p{N}*(?:\p{Lu}\p{Ll}*(?:\p{N}+|$))+$')]) / len(longer) END AS title FROM w"""


@query("q_word_case", WORD_CASE)
def q_word_case(spark, sf_dir):
    return features(documents(spark, sf_dir), *(spec(c, "WordCase", comparator=c) for c in ("upper", "lower", "title")))


@query("q_sentence_starts", BASE + r""", f AS (SELECT doc_id, [v FOR v IN sent IF regexp_matches(v, '\p{L}')] AS s FROM b), g AS (SELECT doc_id, len(s) AS n, [regexp_extract(v, '\p{L}+') FOR v IN s] AS firsts FROM f),
u AS (SELECT doc_id, unnest(firsts) AS word FROM g), k AS (SELECT doc_id, sum(c) AS same FROM (SELECT doc_id, word, count(*) AS c FROM u GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id)
SELECT g.doc_id, CASE WHEN n = 0 THEN 0 ELSE 100.0 * coalesce(same, 0) / n END AS same_start FROM g LEFT JOIN k ON g.doc_id = k.doc_id""")
def q_sentence_starts(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("same_start", "ErrorStyleSentencesStartingWithTheSameWord"))


@query("q_repeated_words")
def q_repeated_words(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("repeated", "ErrorMiscTwoOrMoreEqualWordsDimension"))


@query("q_sentence_errors", BASE + r""", s AS (SELECT doc_id, [v FOR v IN sent IF regexp_matches(v, '[\p{L}\p{N}]')] AS n, [v FOR v IN regexp_extract_all(raw, '[^.!?]+[.!?]*') IF regexp_matches(v, '\p{L}')] AS c FROM b)
SELECT doc_id, CASE WHEN len(n) = 0 THEN 0 ELSE 100.0 * len([v FOR v IN n IF regexp_matches(regexp_extract(v, '[\p{L}\p{N}]+'), '^\p{Nd}')]) / len(n) END AS numbers,
CASE WHEN len(c) = 0 THEN 0 ELSE 100.0 * len([v FOR v IN c IF regexp_matches(regexp_replace(v, '@\w+:?', '', 'g'), '^[\s\p{P}\p{S}]*\p{Ll}')]) / len(c) END AS lower_start FROM s""")
def q_sentence_errors(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("numbers", "ErrorStyleSentencesStartingWithNumbers"), spec("lower_start", "ErrorCapitalizationStartingWithLowerCaseDimension", input_column="text_raw"))


ENTRIES = {
    "words": ["the", "and", "der", "und", "les", "de", "the"],
    "stems": [r"th\p{L}*", r"an\p{L}+", r"ge\p{L}*"],
    "mixed": ["of", r"in\p{L}*", r"of the"],
    "kept": [r"th\p{L}*", r"NEG:the", r"NEG:tha\p{L}*"],
    "verbs": ["the", "has the", "and", "ha that"],
    "infinitives": ["er", "an", "th", "ou"],
}


def lexicons(spark: SparkSession) -> DataFrame:
    return L.lexicon_of(spark, ENTRIES)


RUNS = r"WITH d AS (SELECT doc_id, lower(text) AS x FROM documents), t AS (SELECT *, CAST(len(regexp_extract_all(x, '" + TOKEN + r"')) AS DOUBLE) AS nw, regexp_extract_all(x, '\p{L}+') AS runs FROM d)"


def share(count: str) -> str:
    return f"CASE WHEN nw = 0 THEN 0 ELSE 100.0 * ({count}) / nw END"


@query("q_lexicon", RUNS + f"""SELECT doc_id, {share("len([v FOR v IN runs IF v IN ('and', 'der', 'und', 'les', 'de')]) + 2 * len([v FOR v IN runs IF v = 'the'])")} AS words,
CAST(len([v FOR v IN runs IF v LIKE 'th%']) + len([v FOR v IN runs IF v LIKE 'an_%']) + len([v FOR v IN runs IF v LIKE 'ge%']) AS DOUBLE) AS stems,
{share("len([v FOR v IN runs IF v LIKE 'th%' AND v <> 'the' AND v NOT LIKE 'tha%'])")} AS kept FROM t""")
def q_lexicon(spark, sf_dir):
    resources = plans.Resources(lexicons(spark))
    return features(documents(spark, sf_dir), spec("words", "WordPerDictionary", dictionary="words"), spec("stems", "WordPerDictionary", dictionary="stems", percentage=False), spec("kept", "WordPerDictionary", dictionary="kept"), resources=resources)


@query("q_lexicon_plain", BASE + f"SELECT doc_id, {share(chr(39).join(['len([v FOR v IN w IF v IN (', 'and', ', ', 'der', ', ', 'und', ', ', 'les', ', ', 'de', ', ', 'the', ')])']))} AS words FROM b")
def q_lexicon_plain(spark, sf_dir):
    return features(documents(spark, sf_dir), Spec("words", "WordPerDictionary", dictionary="words", disabled_regexp=True), resources=plans.Resources(lexicons(spark)))


@query("q_lexicon_tags", RUNS + r""", p AS (SELECT doc_id, unnest(w) AS v FROM (SELECT doc_id, regexp_extract_all(x, '""" + TOKEN + r"""') AS w FROM d)), a AS (SELECT doc_id, v, count(*) AS allowed FROM p WHERE length(v) % 5 IN (0, 1) GROUP BY ALL),
r AS (SELECT doc_id, unnest(runs) AS v FROM t), m AS (SELECT doc_id, v, count(*) AS n FROM r WHERE v LIKE 'th%' GROUP BY ALL), s AS (SELECT m.doc_id, sum(least(n, allowed)) AS hits FROM m JOIN a ON m.doc_id = a.doc_id AND m.v = a.v GROUP BY m.doc_id)
SELECT t.doc_id, CASE WHEN nw = 0 THEN 0 ELSE 100.0 * coalesce(hits, 0) / nw END AS nouns FROM t LEFT JOIN s ON t.doc_id = s.doc_id""")
def q_lexicon_tags(spark, sf_dir):
    lexicon = L.lexicon_of(spark, {"th": [r"th\p{L}*"]})
    return features(annotated(spark, sf_dir), spec("nouns", "WordPerDictionary", dictionary="th", pos_tag="NOUN,VERB"), resources=plans.Resources(lexicon))


@query("q_lexicon_phrases", RUNS + rf"SELECT doc_id, {share(chr(39).join(['len([v FOR v IN runs IF v = ', 'of', ' OR v LIKE ', 'in%', ']) + len(regexp_extract_all(replace(x, ', ' ', ', ', '  ', '), ', r'(^|[^\p{L}])of  the([^\p{L}]|$)', '))']))} AS mixed FROM t")
def q_lexicon_phrases(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("mixed", "WordPerDictionary", dictionary="mixed"), resources=plans.Resources(lexicons(spark)))


GENDER = RUNS + r""", p AS (SELECT doc_id, unnest(w) AS v FROM (SELECT doc_id, regexp_extract_all(x, '""" + TOKEN + r"""') AS w FROM d)), a AS (SELECT doc_id, v, count(*) AS allowed FROM p WHERE length(v) % 5 <> 4 GROUP BY ALL),
r AS (SELECT doc_id, unnest(runs) AS v FROM t), m AS (SELECT doc_id, v, count(*) * CASE WHEN v = 'the' THEN 2 ELSE 1 END AS n FROM r WHERE v IN ('the', 'and', 'der', 'und', 'les', 'de') GROUP BY doc_id, v),
s AS (SELECT m.doc_id, sum(least(n, allowed)) AS hits FROM m JOIN a ON m.doc_id = a.doc_id AND m.v = a.v GROUP BY m.doc_id), g AS (SELECT doc_id, sum(allowed) AS items FROM a GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN coalesce(items, 0) = 0 THEN 0 ELSE 100.0 * coalesce(hits, 0) / items END AS gender FROM t LEFT JOIN s ON t.doc_id = s.doc_id LEFT JOIN g ON t.doc_id = g.doc_id"""


@query("q_gender", GENDER)
def q_gender(spark, sf_dir):
    """Tokens of the fifth kind of length are adverbs here, which have no gender."""
    docs = annotated(spark, sf_dir).withColumn("tagged_pos", F.replace("tagged_pos", F.lit("__(AUX)"), F.lit("__(ADV)")))
    return features(docs, spec("gender", "GrammaticalGenderDimension", dictionary="words"), resources=plans.Resources(lexicons(spark)))


@query("q_verbs", BASE + f""", c AS (SELECT doc_id, nw, [CASE WHEN i > 1 AND w[i - 1] IN ({", ".join(f"'{h}'" for h in L.HABER)}) THEN w[i - 1] || ' ' || w[i] ELSE w[i] END FOR i IN range(1, len(w) + 1)] AS cand FROM b)
SELECT doc_id, {share("len([v FOR v IN cand IF v IN ('the', 'has the', 'and', 'ha that')])")} AS verbs FROM c""")
def q_verbs(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("verbs", "VerbPerDictionary", dictionary="verbs"), resources=plans.Resources(lexicons(spark)))


@query("q_enclitics", RUNS + rf"SELECT doc_id, {share('coalesce(list_sum([len([e FOR e IN [' + ', '.join(repr(e) for e in L.ENCLITICS) + '] IF v IN (' + ', '.join(repr(s + e) for s in ENTRIES['infinitives'] for e in L.ENCLITICS) + ') AND v LIKE ' + chr(39) + '%' + chr(39) + ' || e AND v[: length(v) - length(e)] IN (' + ', '.join(map(repr, ENTRIES['infinitives'])) + ')]) FOR v IN [translate(r, ' + repr(L.ACCENTED) + ', ' + repr(L.PLAIN) + ') FOR r IN runs]]), 0)')} AS enclitics FROM t")
def q_enclitics(spark, sf_dir):
    return features(documents(spark, sf_dir), spec("enclitics", "EncliticsPersonalPronounsDictionary", dictionaries="infinitives"), resources=plans.Resources(lexicons(spark)))

#: Matches of a pattern with their places: the running length of what stands between matches and of the matches.
PLACED = """{name} AS (SELECT doc_id, i, v, CAST(sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) - length(v) AS INTEGER) AS a,
  CAST(sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS b, g
  FROM (SELECT doc_id, i, w[i] AS v, gaps[i] AS g FROM (SELECT doc_id, regexp_extract_all({text}, '{pattern}') AS w, string_split_regex({text}, '{pattern}') AS gaps FROM {table}), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)))"""


def placed(name: str, pattern: str, text: str = "text", table: str = "documents") -> str:
    return PLACED.format(name=name, pattern=pattern, text=text, table=table)


@query("q_token_spans", f"""WITH {placed("p", TOKEN)} SELECT doc_id, a AS start, b AS "end", lower(v) AS token FROM p""")
def q_token_spans(spark, sf_dir):
    rows = S.exploded(documents(spark, sf_dir), F.col("doc_id"), S.token_spans(F.col("text_raw")))
    return rows.select("doc_id", "x.start", "x.end", F.col("x.text").alias("token"))


@query("q_paragraph_spans", """WITH p AS (SELECT doc_id, i, lines[i] AS v, sum(length(lines[i]) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(lines[i]) - 2 AS a
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
t AS (SELECT doc_id, a + length(v) - length(ltrim(v, ' ' || chr(9))) AS a, trim(v, ' ' || chr(9)) AS v FROM p)
SELECT doc_id, CAST(a AS INTEGER) AS start, CAST(a + length(v) AS INTEGER) AS "end", v AS paragraph FROM t WHERE v <> ''""")
def q_paragraph_spans(spark, sf_dir):
    spread = F.replace("text_raw", F.lit("\n"), F.lit("\n\n"))
    rows = S.exploded(documents(spark, sf_dir), F.col("doc_id"), S.paragraph_spans(spread))
    return rows.select("doc_id", "x.start", "x.end", F.col("x.text").alias("paragraph"))


@query("q_tag_evidence", BASE + """, k AS (SELECT doc_id, i, w[i] AS v, length(w[i]) % 5 AS k, length(w[i]) AS n FROM b, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
s AS (SELECT *, n + 6 + CASE WHEN k < 2 THEN 4 ELSE 3 END + CASE WHEN n % 2 = 0 THEN 22 WHEN n % 3 = 0 THEN 12 ELSE 11 END + CASE WHEN i % 10 = 0 THEN 4 ELSE 2 END AS tagged, n + CASE k WHEN 3 THEN 4 ELSE 3 END + 4 AS entity FROM k),
p AS (SELECT *, sum(tagged) OVER (PARTITION BY doc_id ORDER BY i) - tagged AS a, sum(entity) OVER (PARTITION BY doc_id ORDER BY i) - entity + CASE k WHEN 3 THEN 4 ELSE 3 END + 1 AS c FROM s)
SELECT doc_id AS id, 'verbs' AS dimension, CAST(a AS INTEGER) AS start, CAST(a + n AS INTEGER) AS "end", v AS text FROM p WHERE k = 1
UNION ALL SELECT doc_id, 'people', CAST(c AS INTEGER), CAST(c + n AS INTEGER), v FROM p WHERE k IN (0, 4)""")
def q_tag_evidence(spark, sf_dir):
    """Items of the serialized tags and entities with the places of their words; an item's signs differ with its tag."""
    return plans.evidence(annotated(spark, sf_dir), [spec("verbs", "POSTaggingTag", tag="VERB"), spec("people", "NERTaggingTag", tag="PER")], id_col="doc_id")


LEXICON_EVIDENCE = f"""WITH l AS (SELECT doc_id, lower(text) AS x FROM documents), {placed("r", "[\\p{L}]+", "x", "l")}, {placed("k", TOKEN, "x", "l")},
a AS (SELECT doc_id, v, count(*) AS allowed FROM k WHERE length(v) % 5 IN (0, 1) GROUP BY ALL),
n AS (SELECT doc_id, v, a, b, row_number() OVER (PARTITION BY doc_id, v ORDER BY a) AS turn FROM r WHERE v LIKE 'th%'),
m AS (SELECT doc_id, 'words' AS dimension, a, b, v FROM r WHERE v IN ('and', 'der', 'und', 'les', 'de', 'the') UNION ALL SELECT doc_id, 'words', a, b, v FROM r WHERE v = 'the'
  UNION ALL SELECT doc_id, 'stems', a, b, v FROM r WHERE v LIKE 'th%' OR v LIKE 'an_%' OR v LIKE 'ge%'
  UNION ALL SELECT doc_id, 'kept', a, b, v FROM r WHERE v LIKE 'th%' AND v <> 'the' AND v NOT LIKE 'tha%'
  UNION ALL SELECT doc_id, 'plain', a, b, v FROM k WHERE v IN ('and', 'der', 'und', 'les', 'de', 'the')
  UNION ALL SELECT n.doc_id, 'tagged', a, b, n.v FROM n JOIN a ON n.doc_id = a.doc_id AND n.v = a.v WHERE turn <= allowed)
SELECT doc_id AS id, dimension, a AS start, b AS "end", v AS text FROM m"""


@query("q_lexicon_evidence", LEXICON_EVIDENCE)
def q_lexicon_evidence(spark, sf_dir):
    """Spans of repeated entries, stems, exceptions, plain words and tags."""
    extra = L.lexicon_of(spark, {"th": [r"th\p{L}*"]})
    nodes = [spec(k, "WordPerDictionary", dictionary=k) for k in ("words", "stems", "kept")]
    nodes += [Spec("plain", "WordPerDictionary", dictionary="words", disabled_regexp=True), spec("tagged", "WordPerDictionary", dictionary="th", pos_tag="NOUN,VERB")]
    return plans.evidence(annotated(spark, sf_dir), nodes, plans.Resources(lexicons(spark).union(extra)), "doc_id")


@query("q_exceptions", f"""WITH l AS (SELECT doc_id, lower(text) AS x FROM documents), {placed("r", "[\\p{L}]+", "x", "l")},
n AS (SELECT *, lead(v) OVER o AS v1, lead(g) OVER o AS g1, lag(v) OVER o AS v0 FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, g1 = ' ' AND ((v = 'of' AND v1 IN ('in', 'the')) OR (v = 'in' AND v1 LIKE 'th%')) AS ahead, g = ' ' AND ((v0 = 'of' AND v IN ('in', 'the')) OR (v0 = 'in' AND v LIKE 'th%')) AS behind FROM n)
SELECT doc_id AS id, 'few' AS dimension, a AS start, b AS "end", v AS text FROM e WHERE (v IN ('of', 'in') OR v LIKE 'th%') AND NOT coalesce(ahead, false) AND NOT coalesce(behind, false)""")
def q_exceptions(spark, sf_dir):
    """Exceptions that overlap each other and cover more than one match, in another dictionary than some of the entries."""
    lexicon = L.lexicon_of(spark, {"a": ["of", "in", "NEG:of in"], "b": [r"th\p{L}*", r"NEG:in th\p{L}*", "NEG:of the"]})
    return plans.evidence(documents(spark, sf_dir), [spec("few", "WordPerDictionary", dictionary="a|b")], plans.Resources(lexicon), "doc_id")


@query("q_periphrases")
def q_periphrases(spark, sf_dir):
    return features(annotated(spark, sf_dir), spec("periphrases", "PeriphrasisDimension", auxiliar_verbs="the+infinitive,and(the|of the)+infinitive"))


@query("q_misspelling", RUNS + f""", k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM benchmark), r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS v FROM documents),
c AS (SELECT doc_id, lower(v) AS v FROM r WHERE length(v) > 1 AND NOT regexp_matches(v, '^\\p{{Lu}}+$|\\p{{Ll}}\\p{{Lu}}'))
SELECT t.doc_id, coalesce(100.0 * bad / n, 0) AS unknown FROM t LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (word IS NULL) AS bad FROM c LEFT JOIN k ON v = word GROUP BY doc_id) q ON t.doc_id = q.doc_id""")
def q_misspelling(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(T.found(F.lower("text"), T.LETTER_RUN)).alias("word")).distinct()
    return features(documents(spark, sf_dir), spec("unknown", "ErrorMispellingDimension"), resources=plans.Resources(known=words))


@query("q_missing_accents", RUNS + f""", k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM benchmark), m AS (SELECT translate(word, '{L.ACCENTED[:-1]}', '{L.PLAIN[:-1]}') AS plain FROM k WHERE word <> translate(word, '{L.ACCENTED[:-1]}', '{L.PLAIN[:-1]}') GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS v FROM documents), h AS (SELECT doc_id, count(*) AS n FROM r JOIN m ON v = plain WHERE lower(v) NOT IN ({", ".join(repr(a) for a in sequences.AMBIGUOUS)}) GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN nw = 0 THEN 0 ELSE 100.0 * coalesce(n, 0) / nw END AS accents FROM t LEFT JOIN h ON t.doc_id = h.doc_id""")
def q_missing_accents(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(T.found(F.lower("text"), T.LETTER_RUN)).alias("word")).distinct()
    return features(documents(spark, sf_dir), spec("accents", "ErrorMispellingAccentsDimension"), resources=plans.Resources(accents=sequences.accent_map(words)))


def tokens_share(condition: str) -> str:
    return f"CASE WHEN nw = 0 THEN 0 ELSE 100.0 * len([v FOR v IN w IF {condition}]) / nw END"


@query("q_tags", BASE + f"SELECT doc_id, {tokens_share('length(v) % 5 = 0')} AS nouns, {tokens_share('length(v) % 2 = 0')} AS feminine, {tokens_share('length(v) % 5 = 1 AND length(v) % 2 <> 0 AND length(v) % 3 = 0')} AS infinitives FROM b")
def q_tags(spark, sf_dir):
    return features(annotated(spark, sf_dir), spec("nouns", "POSTaggingTag", tag="NOUN"), spec("feminine", "POSTaggingTag", universal="Gender=Fem|Number=Plur"), spec("infinitives", "POSTaggingTag", tag="VERB", universal="VerbForm=Inf"))


@query("q_tag_pattern", BASE + "SELECT doc_id, CAST(len([v FOR v IN w IF length(v) % 5 = 0]) AS DOUBLE) AS nouns FROM b")
def q_tag_pattern(spark, sf_dir):
    return features(annotated(spark, sf_dir), spec("nouns", "POSTaggingExpression", pattern=r"__\(NOUN\)", percentage=False))


@query("q_entities", BASE + f"SELECT doc_id, {tokens_share('length(v) % 5 IN (0, 4)')} AS people, {tokens_share('length(v) % 5 = 1')} AS places FROM b")
def q_entities(spark, sf_dir):
    return features(annotated(spark, sf_dir), spec("people", "NERTaggingTag", tag="PER"), spec("places", "NERTaggingTag", tag="LOC", normalizer="words"))


@query("q_dependencies", BASE + f"""SELECT doc_id, {tokens_share('length(v) % 5 = 0')} AS subjects, CAST(CASE WHEN nw <= 1 THEN 0 ELSE 1 END AS DOUBLE) AS distance,
CASE WHEN nw = 0 THEN 0 ELSE CAST(least(nw, 10) - 1 AS DOUBLE) END AS depth, CASE WHEN nw = 0 THEN 0 ELSE 100.0 * len([k FOR k IN range(CAST(ceil(nw / 10) AS BIGINT)) IF len([v FOR v IN w[k * 10 + 1 : k * 10 + 10] IF length(v) % 5 IN (2)]) > 0]) / ceil(nw / 10) END AS passive,
CASE WHEN nw = 0 THEN 0 ELSE 100.0 * len([k FOR k IN range(CAST(ceil(nw / 10) AS BIGINT)) IF length(w[k * 10 + 1]) % 5 = 1]) / ceil(nw / 10) END AS root_verbs FROM b""")
def q_dependencies(spark, sf_dir):
    return features(annotated(spark, sf_dir), spec("subjects", "DependencyTag", deprel="nsubj"), spec("distance", "DependencyDistanceDimension", mode="mean"), spec("depth", "DependencyDepthDimension", mode="max"), spec("passive", "PassiveVoiceDependencyDimension"), spec("root_verbs", "RootPOSTagDimension", tag="VERB"))


@query("q_derived", """WITH a AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS n, CAST(len(regexp_extract_all(text, 'e')) AS DOUBLE) AS e, CAST(len(regexp_extract_all(text, 'th')) AS DOUBLE) AS t FROM documents)
SELECT doc_id, e, t, e + t AS total, (e + t) / 2.0 AS average, greatest(e, t) AS most, least(e, t) AS fewest, CASE WHEN e = 0 THEN -1 ELSE t / e * 10 END AS share FROM a""")
def q_derived(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumns({"e_only": F.regexp_replace("text", "[^e]", ""), "t_only": F.regexp_replace(F.regexp_replace("text", "th", "\x01"), "[^\x01]", "")})
    leaves = [spec("e", "PatternDimension", pattern="e", input_column="e_only", percentage=False), spec("t", "PatternDimension", pattern="\x01", input_column="t_only", percentage=False)]
    tree = [spec("total", "CompositeDimension", strategy="CompositeStrategySum", children=leaves), spec("share", "RatioDimension", numerator="t", denominator="e", scale=10, zero_division=-1)]
    table = features(docs, *tree)
    others = {k: plans.derived.composite(f"CompositeStrategy{s}", ["e", "t"]) for k, s in (("average", "Avg"), ("most", "Max"), ("fewest", "Min"))}
    return table.withColumns(others)


@query("q_normalize")
def q_normalize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.normalized(F.col("text")).alias("text_norm"))


def html_strip_sql() -> str:
    """HTML's rule for references: by number with its corrections, or by the longest known name, with or without a semicolon."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = lambda pairs: "MAP {" + ", ".join(f"{k}: {quoted(v)}" for k, v in pairs) + "}"
    by_length = sorted(html5, key=lambda n: (-len(n), n))
    reference = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|" + "|".join(by_length) + ")"
    odd = table([(0, "\ufffd"), (13, "\r"), *((n, bytes([n]).decode("cp1252", "ignore") or chr(n)) for n in range(0x80, 0xA0))])
    return f"""WITH p AS MATERIALIZED (SELECT row_number() OVER () AS k, page_id, html, regexp_extract_all(html, '{reference}') AS refs, string_split_regex(html, '{reference}') AS gaps FROM pages),
r AS (SELECT k, unnest(range(1, len(refs) + 1)) AS i, unnest(refs) AS ref FROM p),
d AS (SELECT *, CASE WHEN ref LIKE '&#%' THEN CASE WHEN lower(ref[3]) = 'x' THEN try_cast('0x' || rtrim(ref[4:], ';') AS BIGINT) ELSE try_cast(rtrim(ref[3:], ';') AS BIGINT) END END AS n FROM r),
c AS (SELECT k, list(CASE WHEN ref NOT LIKE '&#%' THEN names[ref[2:]] WHEN n IS NULL OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN '\ufffd' WHEN odd[CAST(n AS INTEGER)] IS NOT NULL THEN odd[CAST(n AS INTEGER)]
  WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(CAST(n AS INTEGER)) END ORDER BY i) AS characters
  FROM d, (SELECT {table([(quoted(k), v) for k, v in html5.items()])} AS names, {odd} AS odd) GROUP BY k)
SELECT p.page_id, regexp_replace(CASE WHEN len(refs) = 0 THEN html ELSE array_to_string([gaps[i] || coalesce(characters[i], '') FOR i IN range(1, len(gaps) + 1)], '') END, '<[^>]+>', ' ', 'g') AS plain
FROM p LEFT JOIN c ON p.k = c.k"""


@query("q_html_strip", html_strip_sql())
def q_html_strip(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.strip_html(F.col("html")).alias("plain"))


def quantiles(c: str) -> str:
    return f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75"


def summary_sql(c: str) -> str:
    return f"CAST(count({c}) AS DOUBLE) AS count, CAST(count(*) - count({c}) AS DOUBLE) AS missing_count, (count(*) - count({c})) / count(*) AS missing_ratio, round(sum({c}), 4) AS sum, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, {quantiles(c)}, max({c}) AS max, CAST(count(*) FILTER ({c} <> 0) AS DOUBLE) AS nonzero_count, avg(CASE WHEN {c} <> 0 THEN 1.0 WHEN {c} = 0 THEN 0.0 END) AS nonzero_ratio"


MEASURES = ("l_quantity", "l_discount", "l_tax")
NO_MODE = tuple(s for s in statistics.STATISTICS if s != "mode")


def rounded(table: DataFrame) -> DataFrame:
    return table.withColumns({"sum": F.round("sum", 4), "mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("q_summary", " UNION ALL ".join(f"SELECT '{m}' AS feature, {summary_sql(f'CAST({m} AS DOUBLE)')} FROM lineitem" for m in MEASURES))
def q_summary(spark, sf_dir):
    return rounded(statistics.summary(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), list(MEASURES), NO_MODE))


@query("q_summary_by_language", f"WITH f AS (SELECT lang, CAST(length(text) AS DOUBLE) AS n FROM documents) SELECT lang, 'n' AS feature, {summary_sql('n')} FROM f WHERE lang IS NOT NULL GROUP BY lang")
def q_summary_by_language(spark, sf_dir):
    docs = documents(spark, sf_dir).select("lang", F.length("text").alias("n"))
    return rounded(statistics.summary(docs, ["n"], NO_MODE, ("lang",)))


@query("q_mode", "SELECT l_linenumber, min(v) AS mode FROM (SELECT l_linenumber, CAST(l_quantity AS DOUBLE) AS v, count(*) AS n, max(count(*)) OVER (PARTITION BY l_linenumber) AS most FROM lineitem GROUP BY 1, 2) WHERE n = most GROUP BY 1")
def q_mode(spark, sf_dir):
    return statistics.summary(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity"], ("mode",), ("l_linenumber",)).select("l_linenumber", "mode")


@query("q_summary_long", " UNION ALL ".join(f"SELECT '{m}' AS feature, '{s}' AS statistic, round({f}(CAST({m} AS DOUBLE)), 6) AS value FROM lineitem" for m in MEASURES for s, f in (("min", "min"), ("max", "max"), ("mean", "avg"))))
def q_summary_long(spark, sf_dir):
    wide = statistics.summary(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), list(MEASURES), ("min", "max", "mean"))
    return statistics.long_summary(wide).withColumn("value", F.round("value", 6))


RANKED = " UNION ALL ".join(f"SELECT '{m}' AS feature, round(avg(CAST({m} AS DOUBLE)), 6) AS value, avg(CASE WHEN {m} <> 0 THEN 1.0 ELSE 0.0 END) AS nonzero_ratio FROM (SELECT *, 0 AS nothing, CASE WHEN l_orderkey % 500 = 0 THEN 1 ELSE 0 END AS seldom FROM lineitem)" for m in (*MEASURES, "nothing", "seldom"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"nothing": F.lit(0), "seldom": F.when(F.col("l_orderkey") % 500 == 0, 1).otherwise(0)})
    return statistics.summary(items, [*MEASURES, "nothing", "seldom"], ("mean", "nonzero_count", "nonzero_ratio"))


@query("q_rank", f"SELECT CAST(row_number() OVER (ORDER BY value DESC, feature) AS INTEGER) AS rank, feature, value FROM ({RANKED}) ORDER BY rank LIMIT 3")
def q_rank(spark, sf_dir):
    return statistics.ranked(measured(spark, sf_dir), "mean", 3).withColumn("value", F.round("value", 6))


@query("q_zero_only", f"SELECT feature FROM ({RANKED}) WHERE nonzero_ratio = 0")
def q_zero_only(spark, sf_dir):
    return statistics.zero_only(measured(spark, sf_dir))


@query("q_sparse", f"SELECT feature, nonzero_ratio FROM ({RANKED}) WHERE nonzero_ratio <= 0.01")
def q_sparse(spark, sf_dir):
    return statistics.sparse(measured(spark, sf_dir))


@query("q_metadata", "SELECT d.doc_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_metadata(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return statistics.with_metadata(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", ["quality", "toxic"])


PATTERNS = {"commas": ("text", [","]), "stops": ("text", [r"[.]"])}


def found_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evidence(documents(spark, sf_dir), PATTERNS, "doc_id")


def comma_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evidence(documents(spark, sf_dir), {"commas": PATTERNS["commas"]}, "doc_id")


def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.length("text").alias("length"))


CHARACTERS = "WITH c AS (SELECT doc_id AS id, length(text) AS n, unnest(range(length(text))) AS s, unnest(string_split(text, '')) AS ch FROM documents), e AS (SELECT id, n, CASE ch WHEN ',' THEN 'commas' ELSE 'stops' END AS dimension, s FROM c WHERE ch IN (',', '.'))"
SEGMENTS = ", h AS (SELECT id, dimension, CAST(least(floor((2 * s + 1) / 2.0 / n * 5), 4) AS INTEGER) AS segment FROM e), k AS (SELECT id, dimension, count(*) AS total FROM h GROUP BY ALL), p AS (SELECT id, dimension, total, CAST(unnest(range(5)) AS INTEGER) AS segment FROM k), f AS (SELECT p.id, p.dimension, p.segment, count(h.segment) AS n, count(h.segment) / total AS share, total FROM p LEFT JOIN h ON p.id = h.id AND p.dimension = h.dimension AND p.segment = h.segment GROUP BY p.id, p.dimension, p.segment, total)"


@query("q_evidence", CHARACTERS + " SELECT id, dimension, CAST(s AS INTEGER) AS start, CAST(s + 1 AS INTEGER) AS \"end\", CASE dimension WHEN 'commas' THEN ',' ELSE '.' END AS text FROM e")
def q_evidence(spark, sf_dir):
    return found_spans(spark, sf_dir)


@query("q_positions", CHARACTERS + SEGMENTS + " SELECT id, dimension, segment, n, share, total FROM f")
def q_positions(spark, sf_dir):
    return E.histogram(found_spans(spark, sf_dir), text_lengths(spark, sf_dir))


@query("q_corpus_positions", CHARACTERS + SEGMENTS + " SELECT dimension, segment, CAST(sum(n) AS BIGINT) AS n, sum(n) / sum(total) AS pooled_share, round(avg(share), 9) AS mean_share FROM f GROUP BY ALL")
def q_corpus_positions(spark, sf_dir):
    return E.corpus_positions(q_positions(spark, sf_dir)).withColumn("mean_share", F.round("mean_share", 9))


@query("q_position_report", CHARACTERS + SEGMENTS + """, t AS (
  SELECT dimension, segment, sum(n) AS n, sum(total) AS total, sum(n) / sum(total) AS pooled, avg(share) AS mean, count(*) AS docs FROM f GROUP BY ALL)
SELECT dimension, CAST((SELECT count(*) FROM documents WHERE text IS NOT NULL) AS BIGINT) AS document_count, CAST(max(docs) AS BIGINT) AS documents_with_evidence, CAST(max(total) AS BIGINT) AS total_occurrences,
  string_agg(CAST(CAST(n AS BIGINT) AS VARCHAR), ',' ORDER BY segment) AS occurrence_counts, round(arg_max(pooled, segment) - arg_min(pooled, segment), 9) AS occurrence_delta, round(arg_max(mean, segment) - arg_min(mean, segment), 9) AS mean_document_delta
FROM t GROUP BY dimension""")
def q_position_report(spark, sf_dir):
    lengths = text_lengths(spark, sf_dir)
    report = E.position_report(q_positions(spark, sf_dir), lengths, PATTERNS, 5)
    deltas = [F.round(c, 9).alias(c) for c in ("occurrence_delta", "mean_document_delta")]
    return report.select("dimension", "document_count", "documents_with_evidence", "total_occurrences", F.array_join("occurrence_counts", ",").alias("occurrence_counts"), *deltas)


@query("q_vectors", CHARACTERS + SEGMENTS + " SELECT d.doc_id, coalesce(max(total), 0) AS commas__position_total" + "".join(f", coalesce(max(share) FILTER (segment = {k}), 0) AS commas__position_share_{k + 1}" for k in range(5)) + " FROM documents d LEFT JOIN f ON f.id = d.doc_id AND dimension = 'commas' GROUP BY d.doc_id")
def q_vectors(spark, sf_dir):
    return E.vectors(documents(spark, sf_dir).select("doc_id"), q_positions(spark, sf_dir), ["commas"], id_col="doc_id")


def jsonl(spark: SparkSession, sf_dir: str) -> tuple[dict, DataFrame]:
    """The comma evidence of all documents, through the lines of a structured file and back."""
    docs = documents(spark, sf_dir).select("doc_id", F.length("text").alias("n"), "text")
    described = {"commas": {"kind": "atomic", "evidence": {"kind": "text_span", "source": "text", "unit": "characters"}}}
    table = docs.select("doc_id", "n", F.regexp_count("text", F.lit(",")).alias("commas"))
    lines = writers.jsonl_lines(table, described, comma_spans(spark, sf_dir), {"text": F.col("n")}, "doc_id")
    parsed = lines.where("place = 1").select(F.from_json("value", readers.DOCUMENT).alias("d")).select("d.id", "d.row", "d.reference_lengths", "d.dimensions")
    return {"dimensions": ["commas"]}, parsed


@query("q_jsonl", "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(text) - length(replace(text, ',', '')) AS DOUBLE) AS commas FROM documents")
def q_jsonl(spark, sf_dir):
    return readers.wide_values(*jsonl(spark, sf_dir))


#: Rules that the lines of some documents break, by the remainder of their ids, and how often.
AUDIT = f"""WITH d AS (SELECT doc_id % 7 AS m, length(text) - length(replace(text, ',', '')) AS spans FROM documents),
v AS (SELECT 'dimension is missing' AS rule, count(*) FILTER (m = 1) AS n FROM d UNION ALL SELECT 'dimension is unexpected', count(*) FILTER (m = 1) FROM d UNION ALL SELECT 'record is unknown', count(*) FILTER (m = 2) FROM d
  UNION ALL SELECT 'value is missing', count(*) FILTER (m = 3) FROM d UNION ALL SELECT 'identifier is repeated', greatest(0, count(*) FILTER (m = 4) - 1) FROM d
  UNION ALL SELECT 'length is no count', count(*) FILTER (m = 5) FROM d UNION ALL SELECT 'start is no count', coalesce(sum(spans) FILTER (m = 6), 0) FROM d)
SELECT r.rule, CAST(coalesce(n, 0) AS BIGINT) AS violations FROM (SELECT unnest([{", ".join(repr(r) for r in (*METADATA_RULES, *LINE_RULES))}]) AS rule) r LEFT JOIN v ON r.rule = v.rule"""


@query("q_audit", AUDIT)
def q_audit(spark, sf_dir):
    """Lines of all documents, those of six in seven with a violation."""
    docs = documents(spark, sf_dir).select("doc_id", F.length("text").alias("n"), F.regexp_count("text", F.lit(",")).alias("commas"))
    described = {"commas": {"kind": "atomic", "evidence": {"kind": "text_span", "source": "text", "unit": "characters"}}}
    lines = writers.jsonl_lines(docs, described, comma_spans(spark, sf_dir), {"text": F.col("n")}, "doc_id")
    lines = lines.select(F.get_json_object("value", "$.id").alias("of"), "value")
    m = F.col("of").cast("bigint") % 7
    edits = ((1, '"commas":', '"comas":'), (2, '"_type":"document"', '"_type":"thing"'), (3, '"value":[0-9.]+,', ""), (4, '"id":[0-9]+', '"id":"x"'), (5, '"text":[0-9]+', '"text":-1'), (6, '"start":', '"begin":'))
    value = F.col("value")
    for k, old, new in edits:
        value = F.when(m == k, F.regexp_replace("value", old, new)).otherwise(value)
    edited = written(lines.select(F.coalesce("of", F.lit("metadata")).alias("place"), value.alias("value")), "lines")  # read twice
    return audit(edited).select("rule", "violations")


@query("q_differences", "SELECT 'n_chars' AS \"column\", 'both' AS only_in, count(*) FILTER (doc_id % 7 = 0) AS rows_differing FROM documents UNION ALL SELECT 'lang', 'both', 0 UNION ALL SELECT 'source', 'a', NULL UNION ALL SELECT 'extra', 'b', NULL")
def q_differences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "lang", "source")
    other = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"), "lang", F.lit(1).alias("extra"))
    return statistics.differences(docs, other, "doc_id")


@query("q_conversations", f"SELECT role, count(*) AS turns, round(avg(len(regexp_extract_all(lower(text), '{TOKEN}'))), 9) AS mean_words FROM conversations GROUP BY role")
def q_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.groupBy("role").agg(F.count("*").alias("turns"), F.round(F.avg(F.size(T.lexical_tokens(T.ensured(F.col("text"))))), 9).alias("mean_words"))
