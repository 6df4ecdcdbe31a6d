"""Lexicon operators as joins.

A lexicon is a table (dictionary, entry, is_exception), small enough to be spelled out on the driver. Words join the
letter runs of the texts, beginnings and ends of words their parts, phrases are sought where their first word stands, patterns
where letters that they need stand. Texts are exploded into runs counted per document, so what is shuffled is distinct runs,
and each entry counts every match: entries that overlap or repeat count again. Features with exceptions, and evidence, need
the places of matches: there the runs keep theirs. No Python runs.
"""

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import annotations as A
from ..functions import spans as S
from ..functions import text as T
from ..functions.regex import java_pattern
from ..sources.shared import written
from . import entries
from .features import with_parts

#: Entries without letters to seek them by are literals of the plan, so a lexicon may hold so many of them.
MAX_PATTERNS = 5_000
#: Entries of a lexicon that are spelled out, and rows up to which their table is broadcast instead of shuffled.
MAX_BROADCAST = 500_000
#: Stems that may stand in the plan, so that parts of runs that are none of them are not joined.
MAX_STEMS = 1_000

# The forms of the auxiliary verb and the pronouns that Spanish verbs take at their end.
HABER = """ha habe habed haber habido habiendo habremos habrá habrán habrás habré habréis habría habríais habríamos habrían
habrías habéis había habíais habíamos habían habías han has hay haya hayamos hayan hayas hayáis he hemos hube hubiera hubierais
hubieran hubieras hubiere hubiereis hubieren hubieres hubieron hubiese hubieseis hubiesen hubieses hubimos hubiste hubisteis
hubiéramos hubiéremos hubiésemos hubo""".split()
ENCLITICS = sorted({a + b for a, b in product(["me", "te", "se"], ["", "la", "lo", "le", "las", "los", "les"])} | {"la", "lo", "le", "las", "los", "les", "mo", "mos", "no", "nos"})
ACCENTED, PLAIN = "áàäâãéèëêíìïîóòöôõúùüûñç", "aaaaaeeeeiiiiooooouuuunc"


@dataclass
class LexiconFeature:
    """A feature over the union of some dictionaries, by tags if any are named."""

    key: str
    dictionaries: list[str]
    tags: list[str] = field(default_factory=list)
    feats: list[str] = field(default_factory=list)
    plain: bool = False
    percentage: bool = True
    pos_column: str = "tagged_pos"
    #: Whether the percentage is of the items that have the tags, not of all tokens.
    of_tagged: bool = False


def read_lexicons(spark: SparkSession, folder: str) -> DataFrame:
    """dictionary, entry, is_exception and position (in the order of a file) from a folder of text files, one entry a line.

    Blank lines and lines that begin with # are left out; NEG: marks an exception.
    """
    lines = spark.read.text(f"{folder.rstrip('/')}/*.txt").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("dictionary"), T.trimmed(F.col("value")).alias("line"))
    kept = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    negative = F.col("line").startswith("NEG:")
    entry = F.when(negative, T.trimmed(F.substring("line", 5, 1_000_000))).otherwise(F.col("line"))
    return kept.select("dictionary", entry.alias("entry"), negative.alias("is_exception"), F.monotonically_increasing_id().alias("position"))


def lexicon_of(spark: SparkSession, dictionaries: dict[str, list[str]]) -> DataFrame:
    rows = [(d, e.removeprefix("NEG:").strip(), e.startswith("NEG:"), k) for d, all_of in dictionaries.items() for k, e in enumerate(all_of)]
    return spark.createDataFrame(rows, "dictionary string, entry string, is_exception boolean, position bigint")


def sized(lexicon: DataFrame) -> DataFrame:
    """lexicon, to be broadcast if it has MAX_BROADCAST rows at most."""
    return F.broadcast(lexicon) if lexicon.count() <= MAX_BROADCAST else lexicon


def runs(docs: DataFrame, id_col: str, text: Column, pattern: str = T.LETTER_RUN) -> DataFrame:
    """id, run and n: how often each letter run stands in each document, in lower case."""
    return docs.select(F.col(id_col).alias("id"), F.explode(T.found(F.lower(text), pattern)).alias("run")).groupBy("id", "run").agg(F.count("*").alias("n"))


def whole_runs(kinds: set[str]) -> bool:
    """Whether entries of these kinds match nothing but runs, which begin as the entries do."""
    return not kinds - {"word", "prefix", "longer"}


def beginnings(stems: set[str]) -> str:
    """A look ahead to the first two letters of the stems, in any case, and to any two characters of which one is not ASCII."""
    seconds: dict[str, set[str]] = {}
    for stem in stems:
        if stem[:2].isascii() and stem:
            seconds.setdefault(stem[0], set()).add(stem[1:2])
    both = lambda letters: "[" + "".join(sorted({re.escape(y) for x in letters for y in (x, x.upper())})) + "]"
    alike: dict[str, set[str]] = {}
    for first, own in seconds.items():
        alike.setdefault("" if "" in own else both(own), set()).add(first)
    every = [both(firsts) + second for second, firsts in sorted(alike.items())]
    return "(?=" + "|".join([r"[^\x00-\x7F]", r"[\x00-\x7F][^\x00-\x7F]", *every]) + ")"


def run_pattern(spelled: list[tuple]) -> str:
    """The letter runs that entries may match or be sought by: those that begin like one of them, or all if entries are sought elsewhere."""
    if {r[-4] for r in spelled} & {"suffix", "suffix_longer", "gram"}:
        return T.LETTER_RUN
    return rf"(?<!\p{{L}}){beginnings({r[-3] for r in spelled if r[-4] != 'pattern'})}\p{{L}}+"


def spelled_out(lexicon: DataFrame, *columns: str) -> list[tuple]:
    """Rows of columns, kind, stem, times and pattern of the entries of a lexicon that is small enough."""
    rows = [tuple(r) for r in lexicon.select(*columns, "entry").limit(MAX_BROADCAST + 1).collect()]
    if len(rows) > MAX_BROADCAST:
        raise ValueError(f"a lexicon has {MAX_BROADCAST} entries at most")
    spelled = entries.table(rows)
    if len({r[-1] for r in spelled if r[-4] == "pattern"}) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} entries hold no letters by which to seek them")
    return spelled


def run_hits(rows: DataFrame, known: DataFrame, spelled: list[tuple]) -> DataFrame:
    """rows (run and others) beside the columns of all words, beginnings and ends in known that their runs match: one join."""
    ends = {"prefix": ("prefix", "longer"), "suffix": ("suffix", "suffix_longer")}
    own = {k: sorted({r[-3] for r in spelled if r[-4] in names}) for k, names in {"word": ("word",), **ends}.items()}
    few = sum(map(len, own.values())) <= MAX_STEMS
    part = lambda kind, n, text: F.when((F.length("run") >= n) & (text.isin(own[kind]) if few else F.lit(True)), F.struct(F.lit(kind).alias("of"), text.alias("part")))
    parts = [part("word", 0, F.col("run"))]
    parts += [part("prefix", n, F.substring("run", 1, n)) for n in sorted(set(map(len, own["prefix"])))]
    parts += [part("suffix", n, F.right(F.col("run"), F.lit(n))) for n in sorted(set(map(len, own["suffix"])))]
    each = rows.select("*", F.explode_outer(F.array(*parts)).alias("__x")).where("__x IS NOT NULL").select(*rows.columns, "__x.of", "__x.part")
    stems = known.where(F.col("kind").isin("word", *ends["prefix"], *ends["suffix"])).withColumn("end", F.regexp_replace(F.regexp_replace("kind", "^longer$", "prefix"), "_longer$", ""))
    stems = stems.withColumnRenamed("end", "of_end")
    longer = ~F.col("kind").isin("longer", "suffix_longer") | (F.length("run") > F.length("stem"))
    return each.join(sized(stems), (F.col("part") == F.col("stem")) & (F.col("of") == F.col("of_end")) & longer).drop("of", "part", "of_end")


def sought(docs: DataFrame, of_docs: DataFrame, known: DataFrame, spelled: list[tuple], columns: list[str], id_col: str, text: Column) -> DataFrame | None:
    """id, text, the columns and the bounded pattern of each document and phrase or pattern that may be in it.

    Those are sought by their first word, or by letters that they need; a pattern without either is sought in all texts, in
    the same scan. The patterns of a document are as many as the lexicon has, at most.
    """
    kinds = {r[-4] for r in spelled}
    if not kinds & {"phrase", "gram", "pattern"}:
        return None
    keep = [*columns, "pattern"]
    near = None
    if "phrase" in kinds:
        near = of_docs.join(sized(known.where("kind = 'phrase'")), F.col("run") == F.col("stem")).select("id", *keep)
    if "gram" in kinds:
        grams = known.where("kind = 'gram'")
        places = F.sequence(F.lit(1), F.length("run") - (entries.GRAM - 1))
        pieces = F.array_distinct(F.transform(places, lambda k: F.substring(F.col("run"), k, F.lit(entries.GRAM))))
        cut = of_docs.where(F.length("run") >= entries.GRAM).select("id", F.explode(pieces).alias("piece"))
        hits = cut.join(sized(grams), F.col("piece") == F.col("stem")).select("id", *keep)
        near = near.union(hits) if near is not None else hits
    each = F.struct(*keep)
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    everywhere = [r for r in spelled if r[-4] == "pattern"]
    fixed = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(keep, (*r[: len(columns) - 1], r[-2], r[-1]), strict=True))) for r in everywhere))
    if near is not None:
        near = near.distinct().groupBy(F.col("id").alias("of")).agg(F.collect_list(each).alias("sought"))
        texts = texts.join(near, F.col("id") == F.col("of"), "left" if everywhere else "inner")
        all_of = F.concat(F.coalesce("sought", F.slice(fixed, F.lit(1), F.lit(0))), fixed) if everywhere else F.col("sought")
    else:
        all_of = fixed
    rows = texts.select("id", "text", F.explode(all_of).alias("x")).select("id", "text", *(f"x.{c}" for c in keep))
    return rows.withColumn("pattern", F.concat(F.lit(r"(?iuU)(?<!\p{L})(?:"), java_dialect(F.col("pattern"), spelled), F.lit(r")(?!\p{L})")))


def java_dialect(pattern: Column, spelled: list[tuple]) -> Column:
    """pattern, or what stands for it in Java's dialect where the two differ."""
    changed = {p: java_pattern(p) for p in {r[-1] for r in spelled if r[-4] in ("gram", "pattern")}}
    changed = {p: f"(?-iuU:{j})" if not j.startswith("(?iuU)") else j.removeprefix("(?iuU)") for p, j in changed.items()}
    changed = {p: j for p, j in changed.items() if p != j}
    if not changed:
        return pattern
    table = F.create_map(*(F.lit(x) for pair in changed.items() for x in pair))
    return F.coalesce(F.try_element_at(table, pattern), pattern)


def matches(docs: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text_norm") -> DataFrame:
    """id, dictionary, matched (in lower case) and n: all matches of all entries, exceptions aside."""
    text = T.ensured(F.col(text_col))
    spelled = spelled_out(lexicon.where("NOT is_exception"), "dictionary")
    of_docs = runs(docs, id_col, text, run_pattern(spelled))
    known = docs.sparkSession.createDataFrame(spelled, "dictionary string, kind string, stem string, times bigint, pattern string")
    found = run_hits(of_docs, known, spelled).select("id", "dictionary", F.col("run").alias("matched"), (F.col("n") * F.col("times")).alias("n"))
    near = sought(docs, of_docs, known, spelled, ["dictionary", "times"], id_col, text)
    if near is not None:
        hits = near.select("id", "dictionary", "times", F.explode(F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).alias("matched"))
        found = found.union(hits.groupBy("id", "dictionary", F.lower("matched").alias("matched")).agg(F.sum("times").alias("n")))
    return found.groupBy("id", "dictionary", "matched").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text_norm") -> DataFrame:
    """id, dictionary, is_exception, position, start, end and text: every match of every entry, exceptions too, with its place.

    An index of the letter runs with their places is joined with words, beginnings and ends; only phrases and patterns are
    sought in the texts. position is that of the entry where the lexicon has that column, else 0.
    """
    text, columns = T.ensured(F.col(text_col)), ["dictionary", "is_exception", "position"]
    placed = lexicon if "position" in lexicon.columns else lexicon.withColumn("position", F.lit(0).cast("bigint"))
    spelled = spelled_out(placed, *columns)
    known = docs.sparkSession.createDataFrame(spelled, "dictionary string, is_exception boolean, position bigint, kind string, stem string, times bigint, pattern string")
    index = S.exploded(docs, F.col(id_col).alias("id"), S.spans(text, run_pattern(spelled))).select("id", "x.start", "x.end", "x.text", F.lower("x.text").alias("run"))
    each = lambda rows: rows.select("id", *columns, "start", "end", "text", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("__k")).drop("__k")
    repeated = docs.sparkSession.createDataFrame([r for r in spelled for _ in range(r[-2])], known.schema)  # an entry that repeats matches by each of its rows
    found = run_hits(index, repeated, spelled).select("id", *columns, "start", "end", "text")
    near = sought(docs, index.select("id", "run").distinct(), known, spelled, [*columns, "times"], id_col, text)
    if near is not None:
        hits = near.select("id", *columns, "times", F.explode(S.spans(F.col("text"), F.col("pattern"))).alias("x"))
        found = found.union(each(hits.select("id", *columns, "times", "x.start", "x.end", "x.text")))
    return found


def uncovered(spans: DataFrame, *keys: str) -> DataFrame:
    """The rows of spans(start, end, is_exception, keys) that no exception with the same keys covers, exceptions left out.

    A sweep in the order of the starts: the largest end of the exceptions that began so far tells whether one covers a match.
    """
    so_far = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.coalesce(F.max(F.when(F.col("is_exception"), F.col("end"))).over(so_far), F.lit(-1))
    return spans.withColumn("__reach", reach).where(~F.col("is_exception") & (F.col("end") > F.col("__reach"))).drop("__reach")


def feature_table(spark: SparkSession, features: list[LexiconFeature]) -> DataFrame:
    return spark.createDataFrame([(f.key, d) for f in features for d in f.dictionaries], "feature string, of string")


def plain_words(lexicon: DataFrame, features: list[LexiconFeature]) -> DataFrame:
    """feature and word: the words of a feature's dictionaries, each once, without those that are exceptions."""
    words = lexicon.join(F.broadcast(feature_table(lexicon.sparkSession, features)), F.col("dictionary") == F.col("of"))
    return words.groupBy("feature", F.lower("entry").alias("word")).agg(F.max("is_exception").alias("out")).where("NOT out").select("feature", "word")


def plain_matches(docs: DataFrame, lexicon: DataFrame, features: list[LexiconFeature], id_col: str = "id", text_col: str = "text_norm") -> DataFrame:
    """id, feature, matched and n: lexical tokens that are entries, each once however many entries say so."""
    tokens = docs.select(F.col(id_col).alias("id"), F.explode(T.lexical_tokens(T.ensured(F.col(text_col)))).alias("token"))
    hits = tokens.join(sized(plain_words(lexicon, features)), F.col("token") == F.col("word"))
    return hits.groupBy("id", "feature", F.col("token").alias("matched")).agg(F.count("*").alias("n"))


def swept_keys(lexicon: DataFrame, features: list[LexiconFeature]) -> set[str]:
    """The features that have exceptions in one of their dictionaries."""
    asked = F.col("dictionary").isin(sorted({d for f in features for d in f.dictionaries}))
    excepted = {r.dictionary for r in lexicon.where("is_exception").select("dictionary").distinct().where(asked).collect()}
    return {f.key for f in features if not f.plain and excepted & set(f.dictionaries)}


def feature_hits(docs: DataFrame, lexicon: DataFrame, features: list[LexiconFeature], id_col: str = "id", text_col: str = "text_norm") -> DataFrame:
    """id, feature, is_exception, position, start, end and text of all matches of features, exceptions too."""
    of_feature = feature_table(docs.sparkSession, features)
    needed = lexicon.join(F.broadcast(of_feature.select(F.col("of").alias("dictionary")).distinct()), "dictionary", "left_semi")
    rows = occurrences(docs, needed, id_col, text_col).join(F.broadcast(of_feature), F.col("dictionary") == F.col("of"))
    return rows.select("id", "feature", "is_exception", "position", "start", "end", "text")


def plain_hits(docs: DataFrame, lexicon: DataFrame, features: list[LexiconFeature], id_col: str = "id", text_col: str = "text_norm") -> DataFrame:
    """id, feature, position (0), start, end and text of the tokens that are entries; only those that begin like one leave the texts."""
    words, found = plain_words(lexicon, features), S.spans(T.ensured(F.col(text_col)), T.LEXICAL)
    spelled = [r.word for r in words.select("word").distinct().limit(MAX_BROADCAST + 1).collect()]
    if len(spelled) <= MAX_BROADCAST:
        begin = "(?s)^" + beginnings(set(spelled))
        found = F.filter(found, lambda x: x["text"].rlike(begin))
    tokens = S.exploded(docs, F.col(id_col).alias("id"), found).select("id", "x.*")
    hits = tokens.join(sized(words), F.lower("text") == F.col("word"))
    return hits.select("id", "feature", F.lit(0).cast("bigint").alias("position"), "start", "end", "text")


def accepted_groups(docs: DataFrame, lexicon: DataFrame, groups: list[list[LexiconFeature]], id_col: str = "id", text_col: str = "text_norm") -> list[DataFrame | None]:
    """accepted_spans() of each group of features, None of an empty one.

    The texts are scanned once for all groups. Only matches of features with exceptions are sorted; those of others stay where
    they are. If the matches are read more than once they are written.
    """
    usual = [f for group in groups for f in group if not f.plain]
    swept = swept_keys(lexicon, usual) if usual else set()
    parts = [[{f.key for f in group if not f.plain and (f.key in swept) == sweep} for sweep in (True, False)] for group in groups]
    hits = feature_hits(docs, lexicon, usual, id_col, text_col) if usual else None
    if sum(map(bool, sum(parts, []))) > 1:
        hits = written(hits, "lexicon-hits")
    out = []
    for group, (with_exceptions, others) in zip(groups, parts, strict=True):
        found, plain = [], [f for f in group if f.plain]
        if with_exceptions:
            found.append(uncovered(hits.where(F.col("feature").isin(sorted(with_exceptions))), "id", "feature").drop("is_exception"))
        if others:
            found.append(hits.where(F.col("feature").isin(sorted(others)) & ~F.col("is_exception")).drop("is_exception"))
        if plain:
            found.append(plain_hits(docs, lexicon, plain, id_col, text_col))
        out.append(reduce(DataFrame.unionByName, found) if found else None)
    return out


def accepted_spans(docs: DataFrame, lexicon: DataFrame, features: list[LexiconFeature], id_col: str = "id", text_col: str = "text_norm") -> DataFrame:
    """id, feature, position, start, end and text of all matches of features that no exception covers; tags are not asked for.

    The exceptions of all dictionaries of a feature hold for all its matches. In plain mode matches are tokens, each once.
    """
    return accepted_groups(docs, lexicon, [features], id_col, text_col)[0]


def lexicon_evidence(docs: DataFrame, lexicon: DataFrame, features: list[LexiconFeature], id_col: str = "id", text_col: str = "text_norm") -> DataFrame:
    """id, dimension, start, end and text of what each feature counts.

    With tags, a word has as many spans as the document holds it with them: the first ones, by entry and then by place.
    """
    tagged = [f for f in features if f.tags or f.feats]
    known = [f for f in tagged if f.pos_column in docs.columns]
    free, own = accepted_groups(docs, lexicon, [[f for f in features if f not in tagged], known], id_col, text_col)
    if own is not None:
        allowed = tagged_words(docs, known, id_col, lexicon).withColumnsRenamed({"id": "of_id", "feature": "of_feature"})
        own = own.join(allowed, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("feature") == F.col("of_feature")) & (F.lower("text") == F.col("word")))
        turn = F.row_number().over(Window.partitionBy("id", "feature", "word").orderBy("position", "start", "end"))
        own = own.withColumn("turn", turn).where("turn <= allowed")
    found = [t.select("id", F.col("feature").alias("dimension"), "start", "end", "text") for t in (free, own) if t is not None]
    if not found:
        return docs.select(F.col(id_col).alias("id"), F.lit("").alias("dimension"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text")).limit(0)
    return reduce(DataFrame.unionByName, found)


def tagged_words(docs: DataFrame, features: list[LexiconFeature], id_col: str, lexicon: DataFrame) -> DataFrame:
    """id, feature, word and allowed: how often each word that may be an entry stands with the tags that a feature asks for."""
    own = lexicon.where(F.col("dictionary").isin(sorted({d for f in features for d in f.dictionaries})))
    spelled = [] if any(f.plain for f in features) else spelled_out(own, "dictionary")
    begin = "(?s)^" + beginnings({r[-3] for r in spelled}) if spelled and whole_runs({r[-4] for r in spelled}) else ""
    found = None
    for column in sorted({f.pos_column for f in features}):
        keys = [f for f in features if f.pos_column == column]
        fit = lambda x: reduce(Column.__or__, (A.pos_matches(x, f.tags, f.feats) for f in keys))  # noqa: B023, E731
        items = S.exploded(docs, F.col(id_col).alias("id"), F.filter(A.pos_items(F.col(column), begin), fit)).withColumnRenamed("x", "item")
        wanted = F.array(*(F.when(A.pos_matches(F.col("item"), f.tags, f.feats), f.key) for f in keys))
        rows = items.select("id", F.lower("item.word").alias("word"), F.explode(wanted).alias("feature")).where("feature IS NOT NULL")
        found = found.union(rows) if found else rows
    return found.groupBy("id", "feature", "word").agg(F.count("*").alias("allowed"))


def lexicon_features(docs: DataFrame, lexicon: DataFrame, features: list[LexiconFeature], id_col: str = "id", text_col: str = "text_norm") -> DataFrame:
    """id and a column for each feature (matches, or their percentage of the lexical tokens), with its parts.

    With tags, a word counts as often as the document holds it with them, and no more. The tokens are those of word_count
    where docs has that column.
    """
    swept = swept_keys(lexicon, features)
    counted = [f for f in features if not f.plain and f.key not in swept]
    plain, placed = [f for f in features if f.plain], [f for f in features if f.key in swept]
    rows = []
    if counted:
        of_feature = feature_table(docs.sparkSession, counted)
        needed = lexicon.join(F.broadcast(of_feature.select(F.col("of").alias("dictionary")).distinct()), "dictionary", "left_semi")
        rows.append(matches(docs, needed, id_col, text_col).join(F.broadcast(of_feature), F.col("dictionary") == F.col("of")).select("id", "feature", "matched", "n"))
    if plain:
        rows.append(plain_matches(docs, lexicon, plain, id_col, text_col))
    if placed:
        spans = accepted_spans(docs, lexicon, placed, id_col, text_col)
        rows.append(spans.groupBy("id", "feature", F.lower("text").alias("matched")).agg(F.count("*").alias("n")))
    of_tags = [f.key for f in features if f.tags or f.feats]
    tagged = F.col("feature").isin(of_tags) if of_tags else F.lit(False)
    per_word = reduce(DataFrame.union, rows).groupBy("id", "feature", tagged.alias("tagged"), "matched").agg(F.sum("n").alias("n"))
    filtered = [f for f in features if (f.tags or f.feats) and f.pos_column in docs.columns]
    if filtered:
        allowed = tagged_words(docs, filtered, id_col, lexicon).withColumnsRenamed({"id": "of_id", "feature": "of_feature"})
        joined = per_word.join(allowed, (F.col("id") == F.col("of_id")) & (F.col("feature") == F.col("of_feature")) & (F.col("matched") == F.col("word")), "left")
        per_word = joined.withColumn("n", F.when(F.col("tagged"), F.least("n", F.coalesce("allowed", F.lit(0)))).otherwise(F.col("n")))
    else:
        per_word = per_word.where("NOT tagged")
    totals = per_word.groupBy(F.col("id").alias("of")).agg(*(F.sum(F.when(F.col("feature") == f.key, F.col("n"))).alias(f.key) for f in features))
    tokens = F.col("word_count") if "word_count" in docs.columns else F.size(T.lexical_tokens(T.ensured(F.col(text_col))))
    bases = {f.key: tagged_items(f) if f.of_tagged and f.pos_column in docs.columns else F.lit(0) if f.of_tagged else None for f in features}
    base = docs.select(F.col(id_col).alias(id_col), tokens.alias("__tokens"), *(c.alias(f"__base_{k}") for k, c in bases.items() if c is not None))
    joined = base.join(totals, F.col(id_col) == F.col("of"), "left")
    count = lambda f: F.coalesce(F.col(f"`{f.key}`"), F.lit(0))
    whole = lambda f: F.col("__tokens" if bases[f.key] is None else f"`__base_{f.key}`")
    return joined.select(id_col, *(c for f in features for c in with_parts(f.key, count(f), whole(f), f.percentage)))


def tagged_items(feature: LexiconFeature) -> Column:
    """How many annotated items have the tags of a feature."""
    return F.size(F.filter(A.pos_items(F.col(feature.pos_column)), lambda x: A.pos_matches(x, feature.tags, feature.feats)))


def verb_candidates(words: Column) -> Column:
    """Each token, behind the auxiliary before it if there is one."""
    return T.let(words, lambda w: F.transform(w, lambda x, i: F.when(F.get(w, i - 1).isin(HABER), F.concat_ws(" ", F.get(w, i - 1), x)).otherwise(x)))


def enclitic_stems(text: Column) -> Column:
    """What is left of each letter run without each pronoun that it may end in, accents aside."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    ends = F.array(*map(F.lit, ENCLITICS))
    return F.flatten(F.transform(T.found(plain, T.LETTER_RUN), lambda r: F.transform(F.filter(ends, lambda e: r.endswith(e) & (F.length(r) > F.length(e))), lambda e: F.substring(r, F.lit(1), F.length(r) - F.length(e)))))


def plain_entries(lexicon: DataFrame, dictionaries: list[str]) -> DataFrame:
    """word: the entries of dictionaries in lower case without accents, exceptions aside."""
    own = lexicon.where(F.col("dictionary").isin(dictionaries) & ~F.col("is_exception"))
    return own.select(F.translate(F.lower("entry"), ACCENTED, PLAIN).alias("word")).distinct()


def membership_rates(docs: DataFrame, candidates: Column, lexicon: DataFrame, features: dict[str, list[str]], id_col: str = "id", text_col: str = "text_norm", plain: bool = False) -> DataFrame:
    """id and for each feature the percentage of lexical tokens whose candidates are in its dictionaries, with its parts.

    One scan of the texts and one join for all features: each word carries the features that it serves. The candidates of a
    document are added up where they are made, so a row a document is shuffled.
    """
    entry = F.lower("entry")
    of_feature = docs.sparkSession.createDataFrame([(k, d) for k, every in features.items() for d in every], "feature string, of string")
    own = lexicon.where(~F.col("is_exception")).join(F.broadcast(of_feature), F.col("dictionary") == F.col("of"))
    words = own.groupBy((F.translate(entry, ACCENTED, PLAIN) if plain else entry).alias("word")).agg(F.collect_set("feature").alias("serves"))
    tokens = F.size(T.lexical_tokens(T.ensured(F.col(text_col))))
    made = docs.select(id_col, tokens.alias("__tokens"), candidates.alias("__all"))  # below the explosion, so once a text
    rows = made.select(id_col, "__tokens", F.explode_outer("__all").alias("__candidate")).join(sized(words), F.col("__candidate") == F.col("word"), "left")
    hits = [F.count_if(F.array_contains("serves", k)).alias(f"__hits_{k}") for k in features]
    sums = rows.groupBy(id_col).agg(F.max("__tokens").alias("__tokens"), *hits)
    return sums.select(id_col, *(c for k in features for c in with_parts(k, F.col(f"`__hits_{k}`"), F.col("__tokens"))))


def verb_rates(docs: DataFrame, lexicon: DataFrame, features: dict[str, list[str]], id_col: str = "id", text_col: str = "text_norm") -> DataFrame:
    return membership_rates(docs, verb_candidates(T.lexical_tokens(T.ensured(F.col(text_col)))), lexicon, features, id_col, text_col)


def enclitic_rates(docs: DataFrame, lexicon: DataFrame, features: dict[str, list[str]], id_col: str = "id", text_col: str = "text_norm") -> DataFrame:
    return membership_rates(docs, enclitic_stems(T.ensured(F.col(text_col))), lexicon, features, id_col, text_col, plain=True)
