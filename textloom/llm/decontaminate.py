"""Benchmark decontamination by spaced-seed hashing.

Fixed masks ignore some token positions: at every place of a text each mask's tokens are hashed, and the hashes of
benchmark and training texts are joined. A hit names a diagonal, on which the whole item is laid beside the document
and compared token by token. The overlap is confirmed if MIN_SHARE of the item's tokens agree, or if some stretch of
it scores MIN_SCORE or more, an equal token counting 1 and a different one -2; so substitutions are tolerated.

Tokens are runs of letters, marks and digits of the lowered text, known by 64-bit hash. The masks miss some overlaps
of short items. So an item of under SHORT tokens is sought by its blocks besides: it is cut into one block more than
MIN_SHARE lets it have different tokens, so one block is whole in every overlap of that share and none is missed.
The benchmark is broadcast if it has at most MAX_BROADCAST seeds; a larger one meets the documents' seeds by shuffle.

Cases: null and empty texts have no tokens and no overlaps; null ids are kept as they are, and overlaps of rows with
the same id are told by text_hash; other columns are ignored by overlaps() and kept by clean_documents(), whatever
their names; an empty table on either side gives no overlaps. All of it is DataFrame functions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import without, written

MASKS = ("11011011", "1101100111", "11101011011")
MIN_SHARE = 80
MIN_SCORE, MISMATCH = 13, 2
#: Items with fewer tokens are sought by blocks as well. Of n tokens, n // 5 may differ, so a block has five at most.
SHORT = 40
MAX_BROADCAST = 1_000_000
TOKEN = r"[\p{L}\p{M}\p{N}]+"


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def seed(number: int, mask: str, tokens: Column, place: Column) -> Column:
    """The hash of a mask's tokens from place on; null where the text ends before the mask does."""
    chosen = [F.get(tokens, place + k) for k, bit in enumerate(mask) if bit == "1"]
    return F.when(place + len(mask) <= F.size(tokens), F.xxhash64(F.lit(number), *chosen))


def blocks(size: int) -> list[tuple[int, int]]:
    """Place and length of each block of an item of size tokens."""
    n = size * (100 - MIN_SHARE) // 100 + 1
    bounds = [size * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def benchmark_seeds(benchmark: DataFrame) -> tuple[DataFrame, list[str]]:
    """item (its own hash), item_id, item_size, item_tokens, item_place and seed; and the masks in use, those of blocks last."""
    items = benchmark.select(F.col("item_id"), token_hashes(F.col("text")).alias("item_tokens")).where(F.size("item_tokens") > 0).distinct()
    size = F.size("item_tokens")
    short = sorted(r.n for r in items.where(size < SHORT).select(size.alias("n")).distinct().collect())  # under SHORT numbers
    masks = [*MASKS, *("1" * n for n in sorted({length for n in short for _, length in blocks(n)}))]

    def fits(mask: str) -> Column:
        at = [(n, place) for n in short for place, length in blocks(n) if length == len(mask)]
        found = F.lit(False)
        for n in sorted({n for n, _ in at}):
            found = found | ((F.col("item_size") == n) & F.col("item_place").isin([place for k, place in at if k == n]))
        return found

    each = items.select("*", F.xxhash64("item_id", "item_tokens").alias("item"), size.alias("item_size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("item_place"))
    fit = [F.lit(True) if k < len(MASKS) else fits(m) for k, m in enumerate(masks)]
    seeds = F.array(*(F.when(fit[k], seed(k, m, F.col("item_tokens"), F.col("item_place"))) for k, m in enumerate(masks)))
    return each.select("item", "item_id", "item_size", "item_tokens", "item_place", F.explode(seeds).alias("seed")).where("seed IS NOT NULL"), masks


def window(tokens: Column, start: Column, size: Column) -> Column:
    """The tokens from start on, as many as size; where start is before the text, as many fewer."""
    return F.slice(tokens, F.greatest(start, F.lit(0)) + 1, F.greatest(size + F.least(start, F.lit(0)), F.lit(0)))


def agreeing() -> Column:
    """1 for each of item_tokens that window, which begins at start, has in its place, else 0."""
    return F.transform("item_tokens", lambda x, k: F.when(x == F.get("window", k + F.least(F.col("start"), F.lit(0))), 1).otherwise(0))


def verified(pairs: DataFrame) -> DataFrame:
    """matched and score of pairs(doc_id, text_hash, item_id, start, window, item_tokens), of overlaps only."""
    equal = agreeing()
    rows = pairs.select("doc_id", "text_hash", "item_id", "start", F.size("item_tokens").alias("item_size"), equal.alias("equal"))
    best = F.aggregate(
        "equal", F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, x: F.struct(F.greatest(F.lit(0), s["now"] + F.when(x == 1, 1).otherwise(-MISMATCH)).alias("now"), F.greatest(s["best"], s["now"] + x).alias("best")),
        lambda s: s["best"],
    )
    rows = rows.select("doc_id", "text_hash", "item_id", "start", "item_size", F.aggregate("equal", F.lit(0), lambda s, x: s + x).alias("matched"), best.alias("score"))
    return rows.where((100 * F.col("matched") >= MIN_SHARE * F.col("item_size")) | (F.col("score") >= MIN_SCORE))


def overlaps(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, text_hash, item_id, item_tokens, matched, score and doc_start of the best overlap of each document and item."""
    seeds, masks = benchmark_seeds(benchmark)
    seeds = written(seeds, "seeds")
    items = seeds.select(F.col("item").alias("of_item"), "item_id", "item_tokens").distinct()
    small = seeds.count() <= max_broadcast
    # The row number keeps filters from moving below the tokenizer and running it twice.
    tokens = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), token_hashes(F.col("text")).alias("tokens"))
    if not small:
        tokens = written(tokens, "tokens")
    at = F.explode(F.when(F.size("tokens") > 0, F.sequence(F.lit(0), F.size("tokens") - 1))).alias("place")
    places = tokens.select("row", "doc_id", "text_hash", "tokens", at)
    sought = places.select("*", F.explode(F.array(*(seed(k, m, F.col("tokens"), F.col("place")) for k, m in enumerate(masks)))).alias("doc_seed"))
    start = (F.col("place") - F.col("item_place")).alias("start")
    key = ["row", "doc_id", "text_hash", "item", "start"]
    if small:
        # One span of generated code from the tokens to the hits: only hits leave it, with their own windows, and those
        # only that have as many equal tokens as an overlap, since blocks hit often.
        found = sought.join(F.broadcast(seeds.drop("item_tokens", "item_id")), F.col("doc_seed") == F.col("seed"))
        found = found.select("row", "doc_id", "text_hash", "item", start, window(F.col("tokens"), F.col("place") - F.col("item_place"), F.col("item_size")).alias("window"))
        matched = F.aggregate(agreeing(), F.lit(0), lambda s, x: s + x)
        found = found.join(F.broadcast(items), F.col("item") == F.col("of_item")).where(matched >= F.least(F.ceil(F.size("item_tokens") * MIN_SHARE / 100), F.lit(MIN_SCORE)))
        found = found.groupBy(*key).agg(F.any_value("window").alias("window"))
        pairs = found.join(F.broadcast(items), F.col("item") == F.col("of_item"))
    else:
        found = sought.select("row", "doc_id", "text_hash", "place", "doc_seed").join(seeds.select("item", "item_place", "seed"), F.col("doc_seed") == F.col("seed"))
        found = found.select("row", "doc_id", "text_hash", "item", start).distinct().join(items, F.col("item") == F.col("of_item"))
        found = found.join(tokens.select(F.col("row").alias("of_row"), "tokens"), F.col("row") == F.col("of_row"))
        pairs = found.select(*key, "item_id", "item_tokens", window(F.col("tokens"), F.col("start"), F.size("item_tokens")).alias("window"))
    best = verified(pairs).groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("score", "matched", "item_size", -F.col("start"))).alias("x"))
    return best.select("doc_id", "text_hash", "item_id", F.col("x.item_size").alias("item_tokens"), F.col("x.matched").alias("matched"), F.col("x.score").alias("score"), (-F.col("x.col4")).alias("doc_start"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without an overlap, all their columns as they are."""
    return without(docs, overlaps(docs, benchmark))


def _sql_seeds(source: str, key: str) -> str:
    parts = []
    for k, m in enumerate(MASKS):
        chosen = " || ' ' || ".join(f"t{j}" if j else "tok" for j, bit in enumerate(m) if bit == "1")
        parts.append(f"SELECT {key}, place, '{k}:' || {chosen} AS seed FROM {source} WHERE t{len(m) - 1} IS NOT NULL")
    return " UNION ALL ".join(parts)


def _sql_leads(source: str, key: str) -> str:
    leads = ", ".join(f"lead(tok, {k}) OVER o AS t{k}" for k in range(1, max(map(len, MASKS))))
    return f"SELECT *, {leads} FROM {source} WINDOW o AS (PARTITION BY {key} ORDER BY place)"


#: For benchmarks whose items all have eight tokens or more.
ORACLE_SQL = f"""
WITH d0 AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM documents),
b0 AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS w FROM benchmark),
d1 AS (SELECT doc_id, unnest(w) AS tok, unnest(range(len(w))) AS place FROM d0), b1 AS (SELECT item_id, len(w) AS n, unnest(w) AS tok, unnest(range(len(w))) AS place FROM b0),
d2 AS ({_sql_leads("d1", "doc_id")}), b2 AS ({_sql_leads("b1", "item_id")}),
d3 AS ({_sql_seeds("d2", "doc_id")}), b3 AS ({_sql_seeds("b2", "item_id")}),
h AS (SELECT DISTINCT doc_id, item_id, d3.place - b3.place AS start FROM d3 JOIN b3 USING (seed)),
e AS (SELECT h.*, b1.place AS k, n, CASE WHEN d1.tok IS NOT DISTINCT FROM b1.tok THEN 1 ELSE 0 END AS equal FROM h JOIN b1 USING (item_id) LEFT JOIN d1 ON d1.doc_id = h.doc_id AND d1.place = h.start + b1.place),
s AS (SELECT *, sum(CASE WHEN equal = 1 THEN 1 ELSE -{MISMATCH} END) OVER (PARTITION BY doc_id, item_id, start ORDER BY k) AS upto FROM e),
m AS (SELECT *, least(0, coalesce(min(upto) OVER (PARTITION BY doc_id, item_id, start ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s),
v AS (SELECT doc_id, item_id, start, max(n) AS item_tokens, sum(equal) AS matched, greatest(0, max(upto - low)) AS score FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, matched DESC, start) AS rank FROM v WHERE 100 * matched >= {MIN_SHARE} * item_tokens OR score >= {MIN_SCORE})
SELECT doc_id, item_id, CAST(item_tokens AS INTEGER) AS item_tokens, CAST(matched AS INTEGER) AS matched, CAST(score AS INTEGER) AS score, CAST(start AS INTEGER) AS doc_start FROM r WHERE rank = 1
"""
