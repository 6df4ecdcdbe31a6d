"""Spelling variants by letter-parity bitmask bands.

A word's mask has a bit for each letter that it holds an odd number of times. A replaced letter flips two bits at most, an
inserted or deleted one flips one. The mask is split into three bands of letters, dealt by their frequency so that all bands
tell about as much. Words of one length that differ by a replacement agree in a band; words of lengths L and L + 1 that differ by
an insertion agree in two. Words with equal bands and fitting lengths meet in a cell, where pairs whose masks differ in more
bits are left out 256 rows at a time, and the rest are compared letter by letter. Each pair counts in one cell only: that of
its first equal band. A cell yields a row for each word (how many near words, and the best of them), never its pairs; a key
with over BLOCK words is dealt to cells of pairs of blocks, so no key is one task's work.

All words that have near words, and their chains, stay in Spark: roots are found by doubling steps along the forms. A form has at
least twice the occurrences of its word, so chains have no circles and a few dozen links at most.

Cases: null and empty texts have no words; a null id counts as no characters before the colon; repeated rows count as often as they
stand; ties go to the word that is first in code-point order; very long words are compared pair by pair; extra columns
are ignored; an empty table gives an empty result.
"""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import sized, written

#: Words of one key that are compared in one cell; keys with more are split into cells of pairs of blocks.
BLOCK = 4096
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Rows compared at once, and letters up to which pairs are compared as arrays.
TILE, SHORT = 256, 40
#: Bits of the mask in three bands of 21; letters beyond share bits with the most frequent ones.
BITS, BAND = 63, 21
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def changed(doc_id: int | None, run: str) -> str:
    """run, or without one letter for one in 97 of the pairs of document and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, least_letters: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of all words with so many letters and occurrences; counted within tasks before they are shuffled."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for found, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes lower A-Z alone
                    word = changed(doc_id, found)
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) > HELD:
                    yield batch_of(held)
                    held.clear()
        yield batch_of(held)

    counted = kept.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def letter_bits(words: DataFrame) -> dict[str, int]:
    """The bit of each letter: by frequency, dealt in turn to the three bands."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    ranked = [r.letter for r in letters.orderBy(F.desc("count"), "letter").collect()]  # 90 letters at most
    return {x: (k % BITS) % 3 * BAND + k % BITS // 3 for k, x in enumerate(ranked)}


def mask(word: str, bits: dict[str, int]) -> int:
    found = 0
    for letter in word:
        found ^= 1 << bits[letter]
    return found


def keys(of: int, length: int) -> list[tuple[int, int]]:
    """Keys and sides of a word: 2 meets all of its key (one equal band, equal lengths), 0 meets 1 (two bands, one letter longer)."""
    band = [of >> b * BAND & (1 << BAND) - 1 for b in range(3)]
    found = [(b << 60 | length % (1 << 18) << 42 | band[b], 2) for b in range(3)]
    for kind, (a, b) in enumerate(itertools.combinations(range(3), 2), 3):
        both = band[a] | band[b] << BAND
        found += [(kind << 60 | (length - longer) % (1 << 18) << 42 | both, longer) for longer in (0, 1)]
    return found


def one_letter_apart(a: str, b: str) -> bool:
    """Whether b is a with exactly one letter replaced or inserted."""
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[same + 1 :] == b[same + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[same:] == b[same + 1 :])


def near(words: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each pair of places whether its words are one letter apart; of lengths L and L, or L and L + 1."""
    if not len(first):
        return np.zeros(0, bool)
    size, longest = len(words[first[0]]), len(words[second[0]])
    if longest > SHORT:
        return np.array([one_letter_apart(words[i], words[j]) for i, j in zip(first, second, strict=True)], bool)
    used, places = np.unique(np.concatenate([first, second]), return_inverse=True)
    codes = np.array([words[u].encode("latin-1") for u in used], f"S{longest}").view(np.uint8).reshape(len(used), longest)
    a, b = codes[places[: len(first)]], codes[places[len(first) :]]
    if size == longest:
        return (a != b).sum(axis=1) == 1
    a = a[:, :size]
    ahead = np.logical_and.accumulate(a == b[:, :size], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= size


def pairs_of_cell(kind: int, side: np.ndarray, masks: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all near pairs that this cell has to count. side: 2 meets all, otherwise 0 meets 1 (of kinds from 3 on shorter and longer)."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.flatnonzero(side != 1)
    others = rows if len(rows) and side[rows[0]] == 2 else np.flatnonzero(side == 1)
    lengths = np.array([len(w) for w in words])
    earlier = [np.uint64(((1 << BAND) - 1) << BAND * b) for b in range(kind)] if kind < 3 else []
    for begin in range(0, len(rows), TILE):
        part, against = rows[begin : begin + TILE], others[begin:] if others is rows else others
        apart = masks[part][:, None] ^ masks[against][None, :]
        i, j = np.nonzero(np.bitwise_count(apart) <= (2 if kind < 3 else 1))
        if others is rows:
            i, j = i[i < j], j[i < j]
        apart, i, j = apart[i, j], part[i], against[j]
        fits = lengths[j] - lengths[i] == (kind >= 3)
        for band in earlier:
            fits &= (apart & band) != 0
        i, j = i[fits], j[fits]
        for low in range(0, len(i), 1 << 16):
            a, b = i[low : low + (1 << 16)], j[low : low + (1 << 16)]
            for length in np.unique(lengths[a]):  # one, unless lengths meet by their remainder
                of = lengths[a] == length
                is_near = near(words, a[of], b[of])
                found.append((a[of][is_near], b[of][is_near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, form and form_n (the near word with the largest n, the first of a tie) of words(word, n) that have near words."""
    bits = letter_bits(words)

    def keyed_by(batches):
        for batch in batches:
            masks = [mask(w, bits) for w in batch.column("word").to_pylist()]
            each = [keys(m, len(w)) for m, w in zip(masks, batch.column("word").to_pylist(), strict=True)]
            row = pa.array(np.repeat(np.arange(batch.num_rows), 9))
            key, side = pa.array([k for ks in each for k, _ in ks], pa.int64()), pa.array([s for ks in each for _, s in ks], pa.int32())
            yield pa.RecordBatch.from_arrays([key, side, pa.array(masks, pa.int64()).take(row), batch.column("word").take(row), batch.column("n").take(row)], ["key", "side", "mask", "word", "n"])

    keyed = words.mapInArrow(keyed_by, "key bigint, side int, mask bigint, word string, n bigint")
    large = written(keyed.groupBy(F.col("key").alias("of")).count().where(F.col("count") > block).select("of", F.ceil(F.col("count") / block).cast("int").alias("m")), "large")
    m = F.coalesce("m", F.lit(1))
    dealt = keyed.join(sized(large), F.col("key") == F.col("of"), "left").select("key", "side", "mask", "word", "n", m.alias("m"), F.pmod(F.xxhash64("word"), m).cast("int").alias("s"))
    # words that meet all of their key form cells of two blocks, low and high; of the others each block of 0 meets each of 1
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("t"))
    low = F.when(F.col("side") == 2, F.least("s", "t")).when(F.col("side") == 0, F.col("s")).otherwise(F.col("t"))
    high = F.when(F.col("side") == 2, F.greatest("s", "t")).when(F.col("side") == 0, F.col("t")).otherwise(F.col("s"))
    side = F.when((F.col("side") == 2) & (low != high), F.when(F.col("s") == low, 0).otherwise(1)).otherwise(F.col("side"))
    cells = cells.select("key", low.alias("low"), high.alias("high"), side.cast("int").alias("side"), "mask", "word", "n")
    cells = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if rest is not None:
                table = rest if table is None else pa.concat_tables([rest, table])
            if table is None or not table.num_rows:
                continue
            marks = [table.column(c).to_numpy() for c in ("key", "low", "high")]
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce([np.diff(x) != 0 for x in marks])) + 1).tolist(), table.num_rows]
            if batch is not None:  # the last cell may go on
                rest = table.slice(cuts[-2]).combine_chunks()
                cuts = cuts[:-1]
            out = [x for begin, end in itertools.pairwise(cuts) if end - begin > 1 for x in best_of_cell(int(marks[0][begin]), table.slice(begin, end - begin))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "form", "form_n"])

    rows = cells.mapInArrow(run, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")  # binary order is that of code points
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def best_of_cell(key: int, rows: pa.Table) -> list[tuple[str, int, str, int]]:
    """word, its near words in this cell, the best of them and its n."""
    words, n = np.array(rows.column("word").to_pylist(), object), rows.column("n").to_numpy()
    first, second = pairs_of_cell(key >> 60, rows.column("side").to_numpy(), rows.column("mask").to_numpy().astype(np.uint64), words)
    if not len(first):
        return []
    a, b = np.concatenate([first, second]), np.concatenate([second, first])
    order = sorted(np.unique(b).tolist(), key=lambda i: (-n[i], words[i]))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(order))
    best = np.full(len(words), len(order), np.int64)
    np.minimum.at(best, a, place[b])
    counts = np.bincount(a, minlength=len(words))
    return [(words[i], int(counts[i]), words[order[best[i]]], int(n[order[best[i]]])) for i in np.flatnonzero(counts)]


def roots(forms: DataFrame) -> DataFrame:
    """word and root, where the chain of forms(word, root) ends; each step doubles the links that are followed."""
    now = written(forms, "forms")
    while True:
        onward = now.select(F.col("word").alias("of"), F.col("root").alias("beyond"))
        joined = now.join(onward, F.col("root") == F.col("of"), "left")
        after = written(joined.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("went_on")), "roots")
        now = after.select("word", "root")
        if after.where("went_on").isEmpty():
            return now


def variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, factor: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of docs."""
    words = written(word_counts(docs, least_letters, least_count, id_col, text_col), "words")
    found = neighbours(words).withColumnRenamed("word", "of")
    joined = words.join(found, F.col("word") == F.col("of"), "left")
    known = F.col("form_n") >= factor * F.col("n")
    table = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(known, F.col("form")).alias("form"), F.when(known, F.col("form_n")).alias("form_n")), "variants")
    ends = roots(table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))).withColumnRenamed("word", "of")
    return table.join(ends, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: Every word's patterns with one place left open (replacements) and its beginnings and ends around a left-out letter (deletions).
ORACLE_SQL = """
WITH RECURSIVE t AS (SELECT [list_reduce([CAST(x AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR x IN range(256)] AS crc),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
x AS (SELECT run, n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS hx FROM r),
h AS (SELECT run, n, xor(list_reduce([4294967295] || [CAST('0x' || hx[2 * i + 1 : 2 * i + 2] AS BIGINT) FOR i IN range(len(hx) // 2)], lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM x, t),
c AS (SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, sum(n) AS n FROM h GROUP BY 1),
w AS (SELECT word, CAST(n AS BIGINT) AS n FROM c WHERE length(word) >= 5 AND n >= 3),
g AS (SELECT word, n, i, word[: i] || '?' || word[i + 2 :] AS open, word[: i] || word[i + 2 :] AS less FROM w, LATERAL (SELECT unnest(range(length(word))) AS i)),
p AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM g a JOIN g b ON a.open = b.open AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.less = w.word UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.less = w.word),
b AS (SELECT word, CAST(count(*) AS BIGINT) AS n_near, arg_min(other, (-m, other)) AS best, max(m) AS best_n FROM p GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM w LEFT JOIN b ON w.word = b.word),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, e.root FROM f JOIN (SELECT chain.word, chain.at AS root FROM chain JOIN f ON chain.at = f.word WHERE f.form IS NULL) e ON f.word = e.word"""
