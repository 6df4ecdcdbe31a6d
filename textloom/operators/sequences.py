"""Operators that walk along a document's tokens or know words one by one.

Misspellings are joins of letter runs with word lists. Periphrases need a scan that does not overlap, an aggregation over
the places where one may begin. No Python runs.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import annotations as A
from ..functions import spans as S
from ..functions import text as T
from .features import with_parts
from .lexicon import ACCENTED, MAX_BROADCAST, PLAIN, runs

# Words that are right with and without an accent, and the pronouns that an auxiliary may take.
AMBIGUOUS = ["el", "tu", "mi", "si", "se", "te", "de", "mas", "aun", "solo"]
PRONOUNS = ["me", "te", "se", "nos", "on"]
FORMS = {"infinitive": "Inf", "gerund": "Ger", "participle": "Part", "participe": "Part"}


def accent_map(words: DataFrame) -> DataFrame:
    """plain and accented of words(word) with an accent; a plain form of several words is left out."""
    rows = words.select("word", F.translate("word", ACCENTED[:-1], PLAIN[:-1]).alias("plain")).where("word <> plain")
    return rows.groupBy("plain").agg(F.min("word").alias("accented"), F.max("word").alias("other")).where("accented = other").drop("other")


def _rate(docs: DataFrame, hits: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(id_col, F.size(T.lexical_tokens(T.ensured(F.col(text_col)))).alias("__tokens"))
    joined = base.join(hits.groupBy(F.col("id").alias("of")).agg(F.sum("n").alias("hits")), F.col(id_col) == F.col("of"), "left")
    return joined.select(id_col, *with_parts(key, F.coalesce("hits", F.lit(0)), F.col("__tokens")))


def unaccented_runs(rows: DataFrame, run: str) -> DataFrame:
    """Runs that may lack an accent: without one, and not right both ways."""
    return rows.where(~F.lower(run).isin(AMBIGUOUS) & ~F.col(run).rlike(f"[{ACCENTED[:-2]}]"))


def checked_runs(rows: DataFrame, run: str) -> DataFrame:
    """Runs that a word list is asked for: two letters and more, no capitals within."""
    return rows.where((F.length(run) > 1) & ~F.col(run).rlike(r"^\p{Lu}+$|\p{Ll}\p{Lu}"))


def known_words(known: DataFrame) -> DataFrame:
    return known.select(F.lower("word").alias("word")).distinct()


def letter_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and run of every letter run of the texts."""
    return S.exploded(docs, F.col(id_col).alias("id"), T.found(T.ensured(F.col(text_col)), T.LETTER_RUN)).select("id", F.col("x").alias("run"))


def missing_accents(docs: DataFrame, accents: DataFrame, key: str, id_col: str = "id", text_col: str = "text_raw") -> DataFrame:
    """id and key: the percentage of tokens that the map knows with an accent only."""
    plain, few = unaccented_runs(letter_runs(docs, id_col, text_col), "run"), accents.count() <= MAX_BROADCAST
    if few:  # the runs meet the map where they stand; a row for each document is shuffled
        hits = plain.join(F.broadcast(accents.select("plain")), F.col("run") == F.col("plain")).groupBy("id").agg(F.count("*").alias("n"))
    else:
        hits = plain.groupBy("id", "run").agg(F.count("*").alias("n")).join(accents, F.col("run") == F.col("plain"))
    return _rate(docs, hits, key, id_col, text_col)


def unknown_words(docs: DataFrame, known: DataFrame, key: str, id_col: str = "id", text_col: str = "text_raw") -> DataFrame:
    """id and key: the percentage of words that known(word) lacks, of those checked: two letters and more, no capitals within."""
    checked = checked_runs(letter_runs(docs, id_col, text_col), "run").select("id", F.lower("run").alias("run"))
    words = known_words(known)
    if words.count() <= MAX_BROADCAST:  # likewise
        rows, words = checked.withColumn("n", F.lit(1).cast("bigint")), F.broadcast(words)
    else:
        rows = checked.groupBy("id", "run").agg(F.count("*").alias("n"))
    met = rows.join(words, F.col("run") == F.col("word"), "left")
    sums = met.groupBy(F.col("id").alias("of")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("bad"))
    joined = docs.select(id_col).join(sums, F.col(id_col) == F.col("of"), "left")
    return joined.select(id_col, *with_parts(key, F.coalesce("bad", F.lit(0)), F.coalesce("all", F.lit(0))))


def grammar(specification: str) -> list[tuple[str, list[str], str]]:
    """Auxiliary, linkers and the verb form behind them, of "verb(linker|linker)+form, ..."."""
    found = []
    for item in filter(None, (x.strip() for x in specification.split(","))):
        head, _, form = item.partition("+")
        verb, _, linkers = head.partition("(")
        found.append((verb.strip().lower(), [x.strip().lower() for x in linkers.rstrip(") ").split("|") if x.strip()], FORMS.get(form.strip().lower(), "")))
    return found


def _steps(tokens: Column, at: Column, rules: dict[tuple[tuple[str, ...], str], list[str]], verb) -> Column:
    """Tokens of the longest periphrasis at a place, null if there is none; verb tells whether a place may be its verb, or None if that is not asked."""
    found = []
    for (linker, form), heads in rules.items():
        place = at + 1 + len(linker)
        here = F.get(tokens, at).isin(heads) & (place < F.size(tokens))
        for k, word in enumerate(linker):
            here = here & (F.get(tokens, at + 1 + k) == word)
        found.append(F.when(here & verb(place, form) if verb else here, F.lit(len(linker) + 2)))
    return F.greatest(*found, F.lit(None).cast("int"), F.lit(None).cast("int"))


def periphrasis_count(tokens: Column, pos: Column, specification: str) -> Column:
    """Auxiliary, linker if there are any, and a verb in the asked form at the same place of the tags; none overlap.

    The tags of a document are read only if auxiliary and linker stand somewhere in it.
    """
    rules: dict[tuple[tuple[str, ...], str], list[str]] = {}
    for head, linkers, form in grammar(specification):
        for linker in linkers or [""]:
            rules.setdefault((tuple(linker.split()), form), []).extend([head, *(head + p for p in PRONOUNS)])
    zero = F.lit(0).cast("bigint")
    if not rules:
        return zero
    heads = sorted({h for every in rules.values() for h in every})

    def counted(items: Column, places: Column) -> Column:
        verb = lambda place, form: let_item(F.get(items, place), lambda x: A.pos_matches(x, ["VERB", "AUX"], [f"VerbForm={form}"]))
        start = F.struct(zero.alias("found"), F.lit(0).alias("free"))
        taken = lambda s, at, step: F.when(step.isNull(), s).otherwise(F.struct((s["found"] + 1).alias("found"), (at + step).alias("free")))
        onward = lambda s, at: F.when(at < s["free"], s).otherwise(T.let(_steps(tokens, at, rules, verb), lambda step: taken(s, at, step)))
        return F.aggregate(places, start, onward, lambda s: s["found"])

    def let_item(item: Column, body) -> Column:
        rest = lambda x: F.struct(A.tag_of(A.rest_of(x)).alias("tag"), A.feats_of(A.rest_of(x)).alias("feats"))
        return item.isNotNull() & T.let(rest(item), body)

    begins = F.array_compact(F.transform(tokens, lambda w, i: F.when(w.isin(heads), i)))
    likely = F.filter(begins, lambda at: _steps(tokens, at, rules, None).isNotNull())
    return T.let(likely, lambda places: F.when(F.size(places) == 0, zero).otherwise(T.let(A.well_formed_items(pos), lambda items: counted(items, places))))


def periphrases(docs: DataFrame, features: dict[str, str], id_col: str = "id", text_col: str = "text_norm", pos_col: str = "tagged_pos") -> DataFrame:
    """id and for each key the number of its periphrases; features: key to specification."""
    pos = F.col(pos_col) if pos_col in docs.columns else F.lit("")
    tokens = T.lexical_tokens(T.ensured(F.col(text_col)))
    found = T.let(tokens, lambda w: F.struct(*(periphrasis_count(w, pos, s).alias(k) for k, s in features.items())))
    return docs.select(id_col, found.alias("__found")).select(id_col, *(F.col("__found")[k].alias(k) for k in features))


__all__ = ["accent_map", "grammar", "missing_accents", "periphrases", "periphrasis_count", "runs", "unknown_words"]
