"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared in tiles of 64: a tile is stored as 64 bit planes of one 64-bit word, lane by lane, and
one word operation updates the distances of a fingerprint to all 64 lanes in vertical carry-save counters. Rows of
lanes that have all passed the radius are abandoned after each few planes.

Which fingerprints meet: two that differ in at most r bits agree in p of any r + p blocks of bits, so each choice of
p blocks is a key; p grows with the number of distinct fingerprints so that keys stay selective. This is exact.

For a similarity of the shingle sets (candidate_keys="bands") fingerprints cannot decide: at any radius they miss some
pairs and link others that are less alike. There the Jaccard similarity, counted exactly, is the verdict, and every pair that may
reach it meets: the sets are put in one order (rare shingles first), and two that are similar enough share one of their first
shingles, of which each has as many as it may lack, and one. First texts meet that share one of the first few; the bit planes leave
out what is far apart, and most near copies are joined. Then all that share any of those keys and are not joined yet meet: the
parities of their sets in small bitmaps bound the difference from below and rule out most pairs, the rest is counted. This is exact.

Words are [^\\x20\\x09-\\x0D]+ after lowering A-Z; shingles keep repeats; a text with fewer words has one shingle, a
text without words (null, empty, white space) fingerprint zero, linked like any other. Repeated rows and ids keep
all their rows. A null id takes part, but only names a component if its ids are all null. Extra columns are ignored.
An empty table gives an empty result.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .storage import FEW, HOT, free, met, written

#: Fingerprints of one key that are compared in one task; keys with more are split into cells of pairs of blocks.
BLOCK = 4096
#: Bit planes between two looks for rows to abandon, and rows compared at a time.
PLANES, ROWS = 8, 1 << 17
#: Usual radius of "blocks". It is no test of similarity 0.8: such pairs differ in 9.7 bits on average, and 5 % of them in over 14.
NEAR_BITS = 14
#: Radius for the fingerprints of sets that meet first: sets of similarity 0.8 differ in 9.7 bits on average (12, if they have 4 and 5
#: shingles), unlike ones in over 32 in 45 % of all cases. What is beyond it is left to the second step, which has no radius.
SET_BITS = 32
#: Jaccard similarity in percent, of the sets of shingles, from which texts are near copies by "bands".
NEAR_SHARE = 80
#: Texts of one key that are compared in one task; keys with more are split into cells of pairs of blocks.
CELL = 1024
#: Shingles of each text by which texts meet first. Similar ones that share none of these meet by the others.
FIRST = 4
#: Texts whose shingles are counted, and shingles kept, to know which are common. They give an order: results don't depend on them.
ORDER_TEXTS, ORDER_SHINGLES = 10_000, 100_000
SEED = 42


def shingle_hashes(text: str | None, n_words: int) -> np.ndarray:
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z and splits at \x20 \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(words[i : i + n_words]), SEED) for i in range(max(1, len(words) - n_words + 1))], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 14):
        part = hashes[begin : begin + (1 << 14)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.int64)[0])


def common_shingles(docs: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles that some texts, chosen by their hashes, share most."""
    every = max(1, -(-docs.count() // ORDER_TEXTS))
    some = docs.select("text").where(F.pmod(F.xxhash64(F.lit("order"), "text"), F.lit(every)) == 0)

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(text, n_words)) for text in set(batch.column("text").to_pylist())]
            hashes, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts, pa.int64())], ["shingle", "n"])

    counted = some.mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2")
    found = counted.orderBy(F.desc("n"), "shingle").limit(ORDER_SHINGLES).collect()
    hashes, counts = np.array([r.shingle for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def first_shingles(distinct: np.ndarray, share: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of a set (sorted, without repeats) of which any set of similarity share percent has one among its own, rare ones first.

    Of n shingles such a set lacks n - ceil(share * n / 100) at most. A text without shingles has the hash zero.
    """
    if not len(distinct):
        return np.zeros(1, np.uint64)
    hashes, counts = common
    weight = np.zeros(len(distinct), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
        weight = np.where(hashes[at] == distinct, counts[at], 0)
    return distinct[np.argsort(weight, kind="stable")[: len(distinct) + (-share * len(distinct)) // 100 + 1]]


def parities(distinct: np.ndarray) -> bytes:
    """A bitmap of a power of two of bits, as many as the set has elements or more: whether an odd number of hashes falls on a bit.

    Two such bitmaps differ in as many bits as the sets differ in elements at most, also when halves of the longer are added up.
    """
    width = max(64, 1 << (len(distinct) - 1).bit_length() if len(distinct) else 0)
    odd = np.bincount((distinct & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, n_words: int, share: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fingerprint (bigint) and, if a share is given, keys, size and parities of the set of every text.

    Of equal texts in one task only the first has these.
    """
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    common = common_shingles(kept, n_words) if share else ()

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            prints, keys, sizes, bitmaps = [], [], [], []
            for text, text_hash in zip(batch.column("text").to_pylist(), batch.column("text_hash").to_pylist(), strict=True):
                hashes = shingle_hashes(text, n_words)
                prints.append(fingerprint(hashes))
                fresh = bool(share) and text_hash not in seen
                seen.add(text_hash)
                distinct = np.unique(hashes) if fresh else None
                keys.append(first_shingles(distinct, share, common).view(np.int64) if fresh else None)
                sizes.append(len(distinct) if fresh else None)
                bitmaps.append(parities(distinct) if fresh else None)
            more = [pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(bitmaps, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints, pa.int64()), *more], ["doc_id", "text_hash", "fingerprint", "keys", "size", "parities"])

    return kept.mapInArrow(run, "doc_id bigint, text_hash bigint, fingerprint bigint, keys array<bigint>, size bigint, parities binary")


def block_masks(radius: int, n: int) -> list[int]:
    """Bit masks of which any two fingerprints within radius agree in one, for n distinct fingerprints."""

    def cost(p: int) -> float:
        return math.comb(radius + p, p) * (200 + n / 2 ** (64 * p // (radius + p)))

    p = min(range(1, 6), key=cost)
    bounds = [64 * i // (radius + p) for i in range(radius + p + 1)]
    blocks = [sum(1 << bit for bit in range(a, b)) for a, b in itertools.pairwise(bounds)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, p)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masked_keys(distinct: DataFrame, radius: int) -> DataFrame:
    """key and fingerprint for every mask."""
    masks = block_masks(radius, distinct.count())
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)))
    return distinct.select(F.explode(keys).alias("key"), "fingerprint")


def planes_of(tiles: np.ndarray) -> np.ndarray:
    """(tiles, 64 lanes) fingerprints as (tiles, 64 planes): bit l of word p is bit p of lane l."""
    bits = np.unpackbits(tiles.view(np.uint8).reshape(len(tiles), 64, 8), axis=2, bitorder="little")
    words = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(words).view(np.uint64).reshape(len(tiles), 64)


def lanes_within(queries: np.ndarray, planes: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and words: the lanes (bits of a word) of planes[row] that are within radius of queries[row].

    planes: (rows, 64); lanes: the lanes to look at. Only rows with a lane left are returned.
    """
    rows, width = np.arange(len(queries)), radius.bit_length()
    counters, over = [np.zeros(len(queries), np.uint64) for _ in range(width)], np.zeros(len(queries), np.uint64)
    one = np.uint64(1)
    for plane in range(0, 64, 2):
        x, y = (planes[rows, p] ^ (np.uint64(0) - ((queries[rows] >> np.uint64(p)) & one)) for p in (plane, plane + 1))
        if width:
            both = x ^ y  # a full adder takes two planes into the lowest counter
            carry = (x & y) | (counters[0] & both)
            counters[0] ^= both
            for k in range(1, width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
        else:
            over |= x | y
        if plane % PLANES == PLANES - 2:
            alive = (~(over | above(counters, radius)) & lanes[rows]) != 0
            if not alive.all():
                rows, over, counters = rows[alive], over[alive], [c[alive] for c in counters]
            if not len(rows):
                break
    return rows, ~(over | above(counters, radius)) & lanes[rows]


def above(counters: list[np.ndarray], radius: int) -> np.ndarray | np.uint64:
    """Lanes whose vertical counter is over radius."""
    more, equal = np.uint64(0), ~np.uint64(0)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more, equal = more | (equal & counters[k]), equal & ~counters[k]
    return more


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is linked to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_of_cells(cell: np.ndarray, side: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within radius in each cell, as a forest.

    cell: sorted numbers; side: 0 and 1 are compared with each other, 2 with all of its own cell.
    """
    tiles, members, pairs = [], [], []
    for begin, end in itertools.pairwise([0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]):
        if end - begin < 2:
            continue
        own: dict[int, list[int]] = {}
        for s in (0, 1, 2):
            at = begin + np.flatnonzero(side[begin:end] == s)
            for t in range(0, len(at), 64):
                own.setdefault(s, []).append(len(members))
                members.append(at[t : t + 64])
        pairs += itertools.combinations_with_replacement(own.get(2, ()), 2)
        pairs += itertools.product(own.get(0, ()), own.get(1, ()))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tiles = np.zeros((len(members), 64), np.uint64)
    place = np.zeros((len(members), 64), np.int64)
    filled = np.array([len(m) for m in members])
    for t, m in enumerate(members):
        tiles[t, : len(m)], place[t, : len(m)] = prints[m], m
    planes, used = planes_of(tiles), np.where(filled == 64, ~np.uint64(0), (np.uint64(1) << (filled % 64).astype(np.uint64)) - np.uint64(1))
    first, second = np.array(pairs).T
    label = np.arange(len(cell))
    step = max(1, ROWS // 64)
    for begin in range(0, len(first), step):
        of, to = np.repeat(first[begin : begin + step], 64), np.repeat(second[begin : begin + step], 64)
        lane = np.tile(np.arange(64), len(of) // 64)
        later = np.where(of == to, ~np.uint64(0) << lane.astype(np.uint64) << np.uint64(1), ~np.uint64(0))
        later = np.where((of == to) & (lane == 63), np.uint64(0), later)
        lanes = np.where(lane < filled[of], used[to] & later, np.uint64(0))
        some = np.flatnonzero(lanes)
        rows, words = lanes_within(tiles[of[some], lane[some]], planes[to[some]], lanes[some], radius)
        hit, bit = np.nonzero(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        row = some[rows[hit]]
        a, b = place[of[row], lane[row]], place[to[row], bit]
        moved = forest(len(cell), np.concatenate([a, np.arange(len(cell))]), np.concatenate([b, label])) if len(a) else label
        label = moved
    linked = np.flatnonzero(label != np.arange(len(label)))
    return prints[linked].view(np.int64), prints[label[linked]].view(np.int64)


def links(keyed: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges a, b that join all fingerprints within radius that share a key of keyed(key, fingerprint).

    Edges are a spanning forest of each cell, never all pairs of it. A key with more than block fingerprints is
    dealt into m blocks, and each pair of blocks is a cell of its own, so no key is a single task's work.
    """
    distinct = keyed.distinct()
    sizes = distinct.groupBy(F.col("key").alias("of_key")).agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("of_key", F.ceil(F.col("n") / block).cast("int").alias("m"))
    dealt = distinct.join(sizes, F.col("key") == F.col("of_key")).select("key", "fingerprint", "m", F.pmod(F.xxhash64("fingerprint"), F.col("m")).cast("int").alias("s"))
    cells = dealt.select("key", "fingerprint", "s", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("t"))
    low, high = F.least("s", "t"), F.greatest("s", "t")
    side = F.when(low == high, 2).when(F.col("s") == low, 0).otherwise(1)
    cells = cells.select(F.xxhash64("key", low, high).alias("cell"), side.cast("int").alias("side"), "fingerprint")
    cells = cells.repartition("cell").sortWithinPartitions("cell")

    def run(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [batch.column(c).to_numpy() for c in ("cell", "side", "fingerprint")]
                now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
                cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
                rest, now = [x[cut:] for x in now], [x[:cut] for x in now]
            else:
                now, rest = rest, None
            if now is not None and len(now[0]):
                a, b = links_of_cells(now[0], now[1], np.ascontiguousarray(now[2]).view(np.uint64), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return cells.mapInArrow(run, "a bigint, b bigint")


def lanes_near(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint and each tile of 64 the lanes (bits of a word) within radius."""
    tiles = np.zeros((-(-len(prints) // 64), 64), np.uint64)
    tiles.reshape(-1)[: len(prints)] = prints
    planes, found = planes_of(tiles), np.zeros((len(prints), len(tiles)), np.uint64)
    step = max(1, ROWS // len(tiles))
    for begin in range(0, len(prints), step):
        of, to = (x.ravel() for x in np.mgrid[begin : min(begin + step, len(prints)), 0 : len(tiles)])
        rows, words = lanes_within(prints[of], planes[to], np.full(len(of), ~np.uint64(0)), radius)
        found[of[rows], to[rows]] = words
    return found


def links_of_sets(sets: list[np.ndarray], side: np.ndarray, share: int, radius: int = SET_BITS) -> tuple[list[int], list[int]]:
    """Links that join the sets (sorted, without repeats) of Jaccard similarity share percent or more, as a forest.

    side: 0 and 1 are compared with each other, 2 with all. Pairs that are already joined are not compared. Fingerprints of the
    sets, compared by bit planes, leave out what is farther apart than radius; the exact similarity follows.
    """
    near = lanes_near(np.array([fingerprint(x) for x in sets], np.int64).view(np.uint64), radius)
    label, sizes, a, b = np.arange(len(sets)), np.array([len(x) for x in sets]), [], []
    for i in range(1, len(sets)):
        may = (side[:i] != side[i]) | (side[i] == 2)
        may &= np.unpackbits(near[i].view(np.uint8), bitorder="little")[:i].astype(bool)
        may &= 100 * np.minimum(sizes[:i], sizes[i]) >= share * np.maximum(sizes[:i], sizes[i])
        left = np.flatnonzero(may & (label[:i] != label[i]))
        while len(left):
            j, left = left[0], left[1:]
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= share * (sizes[i] + sizes[j] - common):
                a.append(i)
                b.append(j)
                label[label == label[i]] = label[j]
                left = left[label[left] != label[i]]
    return a, b


def pairs_left(sizes: np.ndarray, side: np.ndarray, label: np.ndarray, bitmaps: list[bytes], share: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels that may have a similarity of share percent, going by sizes and parities; sides as in links_of_sets().

    share is 50 or more.
    """
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lengths = np.array([len(x) for x in bitmaps])
    for width in np.unique(lengths):  # of two sizes that are similar enough one bitmap is twice as long as the other at most
        own = np.flatnonzero((lengths == width) | (lengths == 2 * width))
        rows = np.zeros((len(own), width // 8), np.uint64)
        for k, at in enumerate(own):
            halves = np.frombuffer(bitmaps[at], np.uint64).reshape(-1, width // 8)
            rows[k] = np.bitwise_xor.reduce(halves, axis=0)
        for k in range(1, len(own)):
            i, j = own[k], own[:k]
            may = ((side[j] != side[i]) | (side[i] == 2)) & (label[j] != label[i]) & ((lengths[j] == width) | (lengths[i] == width))
            may &= 100 * np.minimum(sizes[j], sizes[i]) >= share * np.maximum(sizes[j], sizes[i])
            left = np.flatnonzero(may)
            apart = np.bitwise_count(rows[left] ^ rows[k]).sum(axis=1, dtype=np.int64)
            left = left[apart * (100 + share) <= (100 - share) * (sizes[j[left]] + sizes[i])]
            found_a.append(np.full(len(left), i))
            found_b.append(j[left])
    return np.concatenate(found_a), np.concatenate(found_b)


def cells_of(keyed: DataFrame, cell: int) -> DataFrame:
    """cell, side and text_hash of keyed(key, text_hash, label) whose key has two texts and two labels.

    Keys that join the same texts are one; those with more than cell texts are dealt to pairs of blocks.
    """
    marks = [F.count("*").alias("n"), F.min("text_hash").alias("least"), *(F.bit_xor(F.xxhash64(F.lit(k), "text_hash")).alias(f"mark{k}") for k in (0, 1))]
    sizes = keyed.groupBy("key").agg(*marks, F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").groupBy("n", "least", "mark0", "mark1").agg(F.min("key").alias("of_key"))
    sizes = sizes.select("of_key", F.ceil(F.col("n") / cell).cast("int").alias("m"))
    dealt = keyed.join(sizes, F.col("key") == F.col("of_key")).select("key", "text_hash", "m", F.pmod(F.xxhash64("text_hash"), F.col("m")).cast("int").alias("s"))
    cells = dealt.select("key", "text_hash", "s", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("t"))
    low, high = F.least("s", "t"), F.greatest("s", "t")
    side = F.when(low == high, 2).when(F.col("s") == low, 0).otherwise(1)
    return cells.select(F.xxhash64("key", low, high).alias("cell"), side.cast("int").alias("side"), "text_hash")


def links_of_texts(docs: DataFrame, prints: DataFrame, cells: DataFrame, n_words: int, share: int, radius: int, few: int = 0) -> DataFrame:
    """Edges a, b (text hashes) of the texts of cells(cell, side, text_hash), whose sets are compared as links_of_sets() does.

    Up to few texts are sought by broadcast; for more the texts of docs are shuffled.
    """
    own_cells = cells.groupBy("text_hash").agg(F.collect_list(F.struct("cell", "side")).alias("cells"))  # its keys, times blocks
    firsts = prints.groupBy(F.col("text_hash").alias("of_text")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("x"))
    wanted = written(own_cells.join(firsts, F.col("text_hash") == F.col("of_text")).select("text_hash", "cells", F.col("x.doc_id").alias("first_id")), "cells")
    own = docs.select(F.col("doc_id").alias("id"), "text")
    wanted = F.broadcast(wanted) if few and (wanted.agg(F.sum(F.size("cells"))).first()[0] or 0) <= few else wanted.hint("merge")
    texts = own.join(wanted, F.col("id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("text_hash")))
    texts = texts.select("text_hash", "text", F.explode("cells").alias("x")).select("text_hash", "text", "x.cell", "x.side")

    def run(rows: pa.Table) -> pa.Table:
        hashes, at = np.unique(rows.column("text_hash").to_numpy(), return_index=True)  # repeated rows once
        sets = [np.unique(shingle_hashes(text, n_words)) for text in rows.column("text").take(at).to_pylist()]
        a, b = links_of_sets(sets, rows.column("side").to_numpy()[at], share, radius)
        return pa.table({"a": pa.array(hashes[a], pa.int64()), "b": pa.array(hashes[b], pa.int64())})

    return texts.groupBy("cell").applyInArrow(run, "a bigint, b bigint")


def similar_links(docs: DataFrame, prints: DataFrame, n_words: int, share: int = NEAR_SHARE, cell: int = CELL) -> DataFrame:
    """Edges a, b (text hashes) that join all texts of similarity share; prints has their keys for that share.

    Edges are a spanning forest of each cell, never all its pairs.
    """
    first = prints.select(F.explode(F.slice("keys", 1, FIRST)).alias("key"), "text_hash").distinct().withColumn("label", F.col("text_hash"))
    joined = written(connected(links_of_texts(docs, prints, cells_of(first, cell), n_words, share, SET_BITS)), "joined")
    return joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links_left(docs, prints, joined, n_words, share, cell))


def links_left(docs: DataFrame, prints: DataFrame, joined: DataFrame, n_words: int, share: int, cell: int) -> DataFrame:
    """Edges a, b of the texts of similarity share that joined(node, component) has in different components, or not at all."""
    of_key = Window.partitionBy("key")
    keyed = prints.select(F.explode("keys").alias("key"), "text_hash")
    shared = keyed.select("key", "text_hash", (F.min("text_hash").over(of_key) < F.max("text_hash").over(of_key)).alias("two")).where("two")
    shared = written(shared.select("key", "text_hash").distinct(), "shared")
    labelled = shared.join(joined, F.col("text_hash") == F.col("node"), "left").select("key", "text_hash", F.coalesce("component", "text_hash").alias("label"))
    of_text = prints.where("keys IS NOT NULL").groupBy(F.col("text_hash").alias("of")).agg(F.first("size").alias("size"), F.first("parities").alias("parities"))
    sketches = of_text.join(joined, F.col("of") == F.col("node"), "left").select("of", "size", "parities", F.coalesce("component", "of").alias("label"))
    members = cells_of(labelled, cell).join(sketches, F.col("text_hash") == F.col("of")).select("cell", "side", "text_hash", "size", "parities", "label")

    def run(rows: pa.Table) -> pa.Table:
        hashes, at = np.unique(rows.column("text_hash").to_numpy(), return_index=True)
        column = lambda c: rows.column(c).to_numpy()[at]
        a, b = pairs_left(column("size"), column("side"), column("label"), rows.column("parities").take(at).to_pylist(), share)
        return pa.table({"a": pa.array(hashes[a], pa.int64()), "b": pa.array(hashes[b], pa.int64())})

    pairs = written(members.groupBy("cell").applyInArrow(run, "a bigint, b bigint").distinct(), "pairs")
    partners = pairs.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count("*") / cell).cast("int").alias("m"))
    dealt = pairs.join(partners, F.col("a") == F.col("of")).select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("m"))).alias("cell"))
    sides = [dealt.select("cell", F.lit(s).alias("side"), F.col(c).alias("text_hash")) for s, c in ((0, "a"), (1, "b"))]
    return links_of_texts(docs, prints, sides[0].union(sides[1]).distinct(), n_words, share, 64, FEW)


def near_duplicates(docs: DataFrame, n_words: int = 5, radius: int = NEAR_BITS, candidate_keys: str = "blocks") -> DataFrame:
    """doc_id, text_hash, fingerprint, component (a node) and component_id (the smallest doc_id that links reach) of every row.

    candidate_keys: "blocks" links fingerprints within radius, all of them; "bands" links texts (nodes are their hashes)
    whose shingle sets have a similarity of NEAR_SHARE, whatever their fingerprints.
    """
    bands = candidate_keys == "bands"
    prints, node = written(fingerprints(docs, n_words, NEAR_SHARE if bands else 0), "fingerprints"), "text_hash" if bands else "fingerprint"
    firsts = written(prints.groupBy(F.col(node).alias("of_node")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")), "nodes")
    if bands:
        found = connected(similar_links(docs, prints, n_words))
    else:
        found = connected(links(masked_keys(firsts.select(F.col("of_node").alias("fingerprint")), radius), radius))
    nodes = written(firsts.join(found, F.col("of_node") == F.col("node"), "left").select("of_node", "component", "first_id", "n_rows"), "linked")
    linked = nodes.where("component IS NOT NULL")
    heads = written(linked.groupBy(F.col("component").alias("head")).agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_nodes")), "heads")
    named = met(linked, heads, "component", "head", F.col("n_nodes") > max(1, linked.count() // HOT)).select("of_node", "component", "component_id", "n_rows")
    alone = nodes.where("component IS NULL").select("of_node", F.col("of_node").alias("component"), F.col("first_id").alias("component_id"), "n_rows")
    facts = written(named.union(alone), "named")
    return met(prints, facts, node, "of_node", F.col("n_rows") > max(1, prints.count() // HOT)).select("doc_id", "text_hash", "fingerprint", "component", "component_id")


def one_of_each(docs: DataFrame, n_words: int = 5, radius: int = NEAR_BITS, candidate_keys: str = "bands") -> DataFrame:
    """The row of docs with the smallest doc_id (then text hash) of each component, all columns as they are, repeated rows once."""
    at_id, at_null, at_hash = free(docs, "__id", "__null", "__hash")
    groups = near_duplicates(docs, n_words, radius, candidate_keys)
    heads = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("x"))
    heads = heads.select(F.coalesce("x.doc_id", F.lit(0)).alias(at_id), F.col("x.doc_id").isNull().alias(at_null), F.col("x.text_hash").alias(at_hash))
    own_id = docs["doc_id"].cast("bigint")
    same = (F.coalesce(own_id, F.lit(0)) == F.col(at_id)) & (own_id.isNull() == F.col(at_null)) & (F.xxhash64(docs["text"]) == F.col(at_hash))
    return docs.join(heads.hint("merge"), same).dropDuplicates([at_id, at_null, at_hash]).drop(at_id, at_null, at_hash)  # by the keys of the join, so texts move once
