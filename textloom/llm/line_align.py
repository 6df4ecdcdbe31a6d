"""Line deduplication by pairwise alignment.

Overlapping documents are found through shared rare line hashes, aligned with patience diff, and the aligned common
blocks are deleted from the later document. Lines are compared without surrounding white space; blank lines belong to no
block and to no pair. The later of two documents is that with the larger doc_id (a null comes last), then that with the
larger text hash.

Which documents meet: a short line is common by itself and no block alone, so what is hashed is each line with as many of
those behind it as it takes to reach min_words words, a run. Two documents have a common block exactly if they share a run.
The holders of a run are dealt to BUCKETS buckets. The first holders of the buckets, which are nearly all holders of a rare
run, each meet the first of all and the one before them; the other holders meet the first of their own bucket. So every
later holder meets an earlier one, a run costs pairs in proportion to its holders however common it is, no run is a single
task's work, and there is no cap.

Blocks: each pair is aligned once by patience diff. Aligned lines that follow each other in both texts (blank lines between
them do not count) are a block; blocks of at least min_words words are deleted, and a document loses what the blocks of any
of its pairs hold. What moved past a larger common stretch of the same pair is not aligned, and stays unless another pair
aligns it. Lines are aligned by a 64-bit hash, and a line counts as equal only if a second, independent one agrees too.

Cases: a null text stays null, an empty one stays empty; repeated rows (same id and text) are one document and are treated
alike; other columns stay as they are, whatever their names; an empty table gives an empty one. One alignment takes time in
proportion to lines times the depth of its recursion, and lines that are unique in both texts are met in one step.
"""

import itertools
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import free, written

#: Buckets of the holders of one run; a run with fewer holders is rare.
BUCKETS = 16
#: Blocks with fewer words stay: headings, licence lines and the like.
MIN_WORDS = 20
#: Later documents that one task aligns with one and the same earlier document before these are dealt to several.
SLICE = 64
#: White space at the ends; the look behind keeps a long run within a line from being tried from each of its places.
EDGES = r"^[\x20\x09-\x0D]+|(?<![\x20\x09-\x0D])[\x20\x09-\x0D]+$"
WORD = r"[^\x20\x09-\x0D]+"


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, in order of their first numbers, whose second numbers rise too."""
    tails: list[int] = []
    places: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
        places[at : at + 1] = [k]
        before[k] = places[at - 1] if at else -1
    k, found = places[-1] if places else -1, []
    while k >= 0:
        found.append(pairs[k])
        k = before[k]
    return found[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a and b that patience diff aligns: equal ends, then lines unique in both, then between those.

    Where no common line is unique in both, the rarest common line is the anchor, at its first place in each.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        common = in_a.keys() & in_b.keys()
        if not common:
            continue
        if alone := {x for x in common if in_a[x] == 1 and in_b[x] == 1}:
            at = {x: j for j, x in enumerate(b[b0:b1], b0) if x in alone}
            anchors = increasing([(i, at[x]) for i, x in enumerate(a[a0:a1], a0) if x in alone])
        else:
            rarest = min(common, key=lambda x: (in_a[x] + in_b[x], x))
            anchors = [(a.index(rarest, a0), b.index(rarest, b0))]
        found += anchors
        for (i, j), (k, m) in itertools.pairwise([(a0 - 1, b0 - 1), *anchors, (a1, b1)]):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(found)


def common_blocks(later: list[int], earlier: list[int], words: list[int], equal, min_words: int) -> list[int]:
    """Places of later in blocks: aligned lines that follow each other in both and hold at least min_words words.

    equal(i, j) tells whether the aligned lines are the same.
    """
    found, block, total, last = [], [], 0, None
    for i, j in [*patience(later, earlier), (None, None)]:
        if i is not None and not equal(i, j):
            continue
        if block and (i is None or (i - 1, j - 1) != last):
            found += block if total >= min_words else []
            block, total = [], 0
        if i is not None:
            block.append(i)
            total, last = total + words[i], (i, j)
    return found


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def profiles(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc (the key that orders documents), and place, two hashes and words of each line that is not blank; one row a document."""
    doc = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    trimmed = F.transform(lines_of(F.col(text_col)), lambda x, i: F.struct(i.alias("place"), F.regexp_replace(x, EDGES, "").alias("line")))
    rows = docs.select(doc.alias("doc"), F.filter(trimmed, lambda x: x["line"] != "").alias("lines")).where(F.size("lines") > 0)
    facts = lambda x: F.struct(
        x["place"].alias("place"), F.xxhash64(x["line"]).alias("hash"), F.xxhash64(F.lit("second"), x["line"]).alias("check"), F.regexp_count(x["line"], F.lit(WORD)).alias("words")
    )
    rows = rows.select("doc", F.transform("lines", facts).alias("lines"))
    return rows.select("doc", F.col("lines.place").alias("places"), F.col("lines.hash").alias("hashes"), F.col("lines.check").alias("checks"), F.col("lines.words").alias("words"))


def runs_of(hashes: Column, words: Column, min_words: int) -> Column:
    """The hash of the run from each line on; null where the text ends before min_words words are reached.

    A run of one line has the line's own hash.
    """
    step = lambda s, k: F.struct(F.xxhash64(s["hash"], F.get(hashes, k)).alias("hash"), (s["total"] + F.get(words, k)).alias("total"))
    start = F.struct(F.lit(0).cast("bigint").alias("hash"), F.lit(0).alias("total"))
    near = lambda k: F.sequence(k, F.least(k + min_words, F.size(words)) - 1)  # a line has a word at least
    longer = lambda k: F.aggregate(near(k), start, lambda s, i: F.when(s["total"] >= min_words, s).otherwise(step(s, i)), lambda s: F.when(s["total"] >= min_words, s["hash"]))
    return F.transform(hashes, lambda h, k: F.when(F.get(words, k) >= min_words, h).otherwise(longer(k)))


def candidates(profile: DataFrame, buckets: int = BUCKETS, min_words: int = MIN_WORDS) -> DataFrame:
    """later and earlier: the pairs of documents to align."""
    runs = F.array_compact(F.array_distinct(runs_of(F.col("hashes"), F.col("words"), min_words)))
    held = profile.select("doc", F.explode(runs).alias("run")).withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets)))
    rows = held.withColumn("first", F.first("doc").over(Window.partitionBy("run", "bucket").orderBy("doc")))
    within = rows.where("doc <> first").select(F.col("doc").alias("later"), F.col("first").alias("earlier"))
    firsts = rows.where("doc = first").groupBy("run").agg(F.sort_array(F.collect_set("doc")).alias("held")).where(F.size("held") > 1)  # buckets at most
    met = F.transform(F.sequence(F.lit(1), F.size("held") - 1), lambda i: F.struct(F.get("held", i).alias("later"), F.array_distinct(F.array(F.get("held", F.lit(0)), F.get("held", i - 1))).alias("earlier")))
    between = firsts.select(F.explode(met).alias("x")).select("x.later", F.explode("x.earlier").alias("earlier"))
    return within.union(between).distinct()


def alignments(profile: DataFrame, pairs: DataFrame, min_words: int = MIN_WORDS, slice_rows: int = SLICE) -> DataFrame:
    """doc and found (indexes among its lines that are not blank, of blocks to delete) of each pair's later document.

    An earlier document with many later ones is copied to slices of slice_rows of them, so it is no single task's work.
    """
    sides = profile.select("doc", "hashes", "checks", "words").dropDuplicates(["doc"])
    side = lambda name: sides.select(*(F.col(c).alias(f"{name}_{c}") for c in sides.columns))
    sizes = pairs.groupBy(F.col("earlier").alias("of_earlier")).agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices"))
    hot = sizes.where("slices > 1")
    copies = side("e").join(hot, F.col("e_doc") == F.col("of_earlier"), "left").withColumn("e_slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    dealt = pairs.join(hot, F.col("earlier") == F.col("of_earlier"), "left").select("later", "earlier", F.pmod(F.xxhash64("later"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"))
    joined = dealt.join(side("l"), F.col("later") == F.col("l_doc")).join(copies, (F.col("earlier") == F.col("e_doc")) & (F.col("slice") == F.col("e_slice")))

    def run(batches):
        names = ("l_hashes", "l_checks", "l_words", "e_hashes", "e_checks")
        for batch in batches:
            found = []
            for own, check, words, other, other_check in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                found.append(common_blocks(own, other, words, lambda i, j, x=check, y=other_check: x[i] == y[j], min_words))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("last", "id", "hash")), pa.array(found, pa.list_(pa.int32()))], ["last", "id", "hash", "found"])

    flat = joined.select("later.last", "later.id", "later.hash", "l_hashes", "l_checks", "l_words", "e_hashes", "e_checks")
    out = flat.mapInArrow(run, "last boolean, id bigint, hash bigint, found array<int>")
    return out.where(F.size("found") > 0).select(F.struct("last", "id", "hash").alias("doc"), "found")


def blocks(profile: DataFrame, found: DataFrame) -> DataFrame:
    """doc, doomed (places of the lines to delete) and doomed_words of each document with a block to delete."""
    once = found.select("doc", F.explode("found").alias("index")).groupBy("doc").agg(F.collect_set("index").alias("indexes"))  # as many as its lines
    joined = profile.dropDuplicates(["doc"]).join(once.withColumnRenamed("doc", "of_doc"), F.col("doc") == F.col("of_doc"))
    doomed_words = F.aggregate("indexes", F.lit(0), lambda s, i: s + F.get("words", i))
    return joined.select("doc", F.array_sort(F.transform("indexes", lambda i: F.get("places", i))).alias("doomed"), doomed_words.alias("doomed_words"))


def deduplicated(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the blocks deleted from their texts, and __n_lines, __n_deleted and __words_deleted beside their columns.

    Where docs has columns of such names, the new ones take more underscores.
    """
    profile = written(profiles(docs, text_col), "profiles")
    pairs = written(candidates(profile, min_words=min_words), "pairs")
    doomed = written(blocks(profile, alignments(profile, pairs, min_words)), "blocks")
    at_id, at_hash, places, lost = free(docs, "__id", "__hash", "__doomed", "__words")
    doomed = doomed.select(F.col("doc.id").alias(at_id), F.col("doc.hash").alias(at_hash), F.col("doomed").alias(places), F.col("doomed_words").alias(lost))
    joined = docs.join(doomed.hint("merge"), docs["doc_id"].eqNullSafe(F.col(at_id)) & (F.xxhash64(docs[text_col]) == F.col(at_hash)), "left")
    lines = lines_of(F.col(text_col))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
    rest = F.get(F.transform(F.array(lines), lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n")), F.lit(0))
    text = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(rest)
    own = [F.col(c) if c != text_col else text.alias(text_col) for c in docs.columns]
    counts = F.size(lines), F.coalesce(F.size(places), F.lit(0)), F.coalesce(F.col(lost), F.lit(0))
    return joined.select(*own, *(c.cast("bigint").alias(name) for c, name in zip(counts, free(docs, "__n_lines", "__n_deleted", "__words_deleted"), strict=True)))
