import random

import numpy as np
import pytest
import xxhash

from textloom.llm import simhash


def brute_print(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    ids, comp = sorted(prints), {}
    for i in ids:
        if i in comp:
            continue
        comp[i], todo = i, [i]
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in comp and (prints[x] ^ prints[y]).bit_count() <= radius:
                    comp[y] = i
                    todo.append(y)
    return comp


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "Straße", "ﬁn"]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            base = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))))
    return out


@pytest.mark.parametrize(("radius", "block"), [(4, 4096), (4, 16), (9, 8)])
def test_matches_brute_force(spark, radius, block, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (block,))
    rows = list(enumerate([*texts(90, 3), "", " \t\n", "One", "one two three", "A B\x0bC\x0cD"]))
    docs = spark.createDataFrame([*rows, (900, None)], "doc_id bigint, text string")
    found = {r.doc_id: (r.fingerprint & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs, 4, radius).collect()}
    prints = {i: brute_print(t, 4) for i, t in [*rows, (900, None)]}
    comp = brute_components(prints, radius)
    assert found == {i: (prints[i], comp[i]) for i in prints}
    assert len(set(comp.values())) < len(comp)


def test_masks_are_exact():
    rng = np.random.default_rng(1)
    for n in (10, 10**6, 10**9):
        masks = simhash.block_masks(4, n)
        for _ in range(300):
            x = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(x & m == 0 for m in masks)


def test_bands_find_near_copies(spark):
    docs = spark.createDataFrame(list(enumerate(texts(300, 5))), "doc_id bigint, text string")
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in docs.collect()}
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 5, simhash.NEAR_BITS, "bands").collect()}
    close = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(close) > 20
    assert sum(comp[a] == comp[b] for a, b in close) >= 0.98 * len(close)


def share_of(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def similar_texts():
    """Near copies from well under to well over similarity 0.8, some of them mostly one repeated word."""
    rng, out = random.Random(11), []
    for k in range(40):
        base = [f"t{k}w{i}" for i in range(rng.choice([12, 60, 150]))]
        out.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy))
        out.append(" ".join([*base, *["again"] * rng.choice([0, 8, 2000])]))
    return out


@pytest.mark.parametrize("cell", [1024, 3])
def test_bands_are_jaccard(spark, cell, monkeypatch):
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (simhash.NEAR_SHARE, cell))
    rows = list(enumerate([*similar_texts(), "", " \t", "One", "one"]))
    docs = spark.createDataFrame([*rows, *rows[:3], (None, rows[5][1])], "doc_id bigint, text string").repartition(5)
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    comp = {}
    for i in sets:
        if i not in comp:
            comp[i], todo = i, [i]
            while todo:
                x = todo.pop()
                near = [y for y in sets if y not in comp and share_of(sets[x], sets[y])]
                comp |= dict.fromkeys(near, i)
                todo += near
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, 5, candidate_keys="bands").collect()}
    assert found == {*comp.items(), (None, comp[5])}
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(comp.values())
    prints = {i: brute_print(t, 5) for i, t in rows}
    far = lambda a, b: (prints[a] ^ prints[b]).bit_count() > simhash.NEAR_BITS
    assert any(share_of(sets[a], sets[b]) and far(a, b) for a in sets for b in sets)
    assert any(not share_of(sets[a], sets[b]) and not far(a, b) for a in sets for b in sets)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e", 1), (5, "a b c d e", 2), (5, "a b c d e", 2), (7, "x" * 300_000, 3), (8, "y " * 100_000, 3)], "doc_id bigint, text string, fingerprint int")
    rows = sorted(((r.doc_id or -1), r.component_id) for r in simhash.near_duplicates(docs, 4, 4).collect())
    assert rows == [(-1, 5), (5, 5), (5, 5), (7, 7), (8, 8)]
    assert simhash.near_duplicates(docs.limit(0), 4, 4).collect() == []


def test_sets_meet_by_bit_planes():
    """The fingerprints of sets are compared as the method has it; the exact similarity decides only what they leave."""
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    prints[75:] = prints[:75] ^ (np.uint64(1) << rng.integers(0, 64, 75).astype(np.uint64))
    bits = np.unpackbits((prints[:, None] ^ prints[None, :]).view(np.uint8).reshape(150, 150, 8), axis=2).sum(axis=2)
    for radius in (0, 1, 30, 32):
        found = np.unpackbits(simhash.lanes_near(prints, radius).view(np.uint8), axis=1, bitorder="little")[:, :150]
        assert (found == (bits <= radius)).all()
    base = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    sets = [base, np.append(base[:-2], np.uint64(1 << 63)), base[:3]]
    assert simhash.links_of_sets(sets, np.array([2, 2, 2]), 80) == ([1], [0])
    assert simhash.links_of_sets(sets, np.array([2, 2, 2]), 80, radius=0) == ([], [])


def test_first_shingles_and_parities_lose_no_pair():
    rng = np.random.default_rng(5)
    common = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    order = (common, rng.integers(3, 99, len(common)))
    sets = []
    for _ in range(40):
        base = np.unique(np.concatenate([rng.choice(common, rng.integers(0, 40)), rng.integers(0, 1 << 63, rng.integers(1, 150), dtype=np.uint64)]))
        sets += [base, *(np.unique(np.concatenate([rng.permutation(base)[: len(base) - rng.integers(0, 2 + len(base) // 7)], rng.integers(0, 1 << 63, rng.integers(0, 2 + len(base) // 9), dtype=np.uint64)])) for _ in range(3))]
    sets += [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    close = {(i, j) for i in range(len(sets)) for j in range(i) if share_of(set(sets[i].tolist()), set(sets[j].tolist()))}
    exactly = [simhash.first_shingles(s, 80, order) for s in sets]
    assert len(close) > 40 and all(set(exactly[i].tolist()) & set(exactly[j].tolist()) for i, j in close)
    a, b = simhash.pairs_left(np.array([len(s) for s in sets]), np.full(len(sets), 2), np.arange(len(sets)), [simhash.parities(s) for s in sets], 80)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(found) == len(a) and {(max(p), min(p)) for p in found} >= close and len(found) < len(sets) ** 2 // 20


@pytest.mark.parametrize("few", [0, 200_000])
def test_pairs_that_the_first_step_leaves_are_found(spark, few, monkeypatch):
    """Similar texts meet whatever their fingerprints, and also if they share none of the first shingles by which most meet."""
    monkeypatch.setattr(simhash, "SET_BITS", 0)
    monkeypatch.setattr(simhash, "FIRST", 1)
    monkeypatch.setattr(simhash, "FEW", few)
    rows = list(enumerate([*texts(120, 9), *similar_texts()[:60]]))
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id bigint, text string").repartition(3)
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 5, candidate_keys="bands").collect()}
    assert all(comp[a] == comp[b] for a in sets for b in sets if share_of(sets[a], sets[b]))
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(comp.values())


def test_similar_texts_with_far_fingerprints(spark):
    """Four of five shingles are common, but 34 bits of the fingerprints of the sets differ."""
    long = "w85474 w88333 w45018 w55761 w90611 w62169 w54286 w1791 x98629"
    docs = spark.createDataFrame([(1, long), (2, long.rsplit(" ", 1)[0]), (3, "another text of some words")], "doc_id bigint, text string")
    a, b = (simhash.fingerprint(np.unique(simhash.shingle_hashes(t, 5))) for t in (long, long.rsplit(" ", 1)[0]))
    assert ((a ^ b) & (2**64 - 1)).bit_count() == 34
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 3]
