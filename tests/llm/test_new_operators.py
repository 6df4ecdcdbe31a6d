"""Quality model, spelling variants and centroids against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from textloom.llm import centroids, quality_model, spelling

# --- centroids


def brute_clusters(rows, k, rounds):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [int(x) * 256 if abs(x) > 2**60 else math.floor(x * 256) for x in v], v))
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v, x) for i, x, v in kept if i is not None)
    now = [x for _, _, x in starts[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [min(range(len(now)), key=lambda c: (far(x, now[c]), c)) for _, x, _ in kept]
    for _ in range(rounds):
        of = assign()
        for c in range(len(now)):
            own = [x for (_, x, _), o in zip(kept, of, strict=True) if o == c]
            if own:
                now[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    of = assign()
    d = [far(x, now[c]) for (_, x, _), c in zip(kept, of, strict=True)]
    fits = lambda n: n if n < 2**63 else None
    whole = fits(sum(d)) if all(fits(x) is not None for x in d) else None
    inertia = {c: sum(x for x, o in zip(d, of, strict=True) if o == c) for c in set(of)}
    broken = {o for x, o in zip(d, of, strict=True) if fits(x) is None}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return Counter((i, c, fits(x), None if c in broken else fits(inertia[c]), whole, digest[c]) for (i, _, _), c, x in zip(kept, of, d, strict=True))


def vectors(kind):
    rng = random.Random(kind)
    point = lambda scale: [rng.gauss(0, scale) for _ in range(64)]
    if kind == "usual":
        return [(i, point(1)) for i in range(150)] + [(i, [0.0] * 64) for i in range(200, 230)]
    if kind == "ties":  # few values, so that many vectors are as near to two centroids
        return [(i, [float(rng.randint(0, 1)) if j < 3 else 0.0 for j in range(64)]) for i in range(120)]
    if kind == "near_ties":  # differences far below what float32 tells apart
        return [(i, [10_000.0 + (rng.randint(0, 3) / 256 if j < 2 else 0.0) for j in range(64)]) for i in range(120)]
    if kind == "odd":
        rows = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [math.nan] * 64), (7, [math.inf] + [0.0] * 63), (None, point(1)), (8, point(1)), (8, point(1)), (8, [2.0] * 64), (8, [2.0] * 64)]
        return rows + [(i, point(1)) for i in range(20, 40)]
    return [(i, point(1e6) if i % 3 else point(3e36)) for i in range(30)]  # "wide"


@pytest.mark.parametrize("kind", ["usual", "ties", "near_ties", "odd", "wide"])
def test_centroids(spark, kind):
    rows = [(i, v, "x", 1) for i, v in vectors(kind)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cluster string, id int").repartition(3)
    seen = [(r.vec_id, r.embedding) for r in df.collect()]
    found = Counter(tuple(r) for r in centroids.clustered(df, k=12, rounds=3).collect())
    assert found == brute_clusters(seen, 12, 3)


def test_centroids_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    assert centroids.clustered(df).collect() == [] and centroids.clustered(df.limit(0)).collect() == []


def test_shortlists_hold_the_nearest_whatever_the_rounding():
    """Products off by as much as float32 allows, in the worst direction, must not lose the nearest centroid."""
    rng = np.random.default_rng(3)
    for scale in (3, 1000, 1 << 20, 1 << 26):
        x, c = rng.integers(-scale, scale, (200, 64)), rng.integers(-scale, scale, (40, 64))
        c[1::2] = c[::2] + rng.integers(-1, 2, (20, 64))
        exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        n = 66 * centroids.UNIT
        off = n / (1 - n) * np.abs(x).astype(float) @ np.abs(c).astype(float).T
        for sign in (rng.choice([-1, 1], off.shape), np.where(exact == exact.min(axis=1)[:, None], -1, 1)):
            products = x.astype(float) @ c.astype(float).T + sign * off
            left = centroids.shortlists(x, c, products)
            assert left[exact == exact.min(axis=1)[:, None]].all()
        assert (centroids.nearest(x, c) == exact.argmin(axis=1)).all()
    far = rng.integers(-1000, 1000, (200, 64))
    assert centroids.shortlists(far, far[:40]).sum() < 200 * 4  # and the screen does decide


# --- spelling


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = list(itertools.accumulate(zip(b, row, row[1:], strict=False), lambda left, t: min(left + 1, t[2] + 1, t[1] + (x != t[0])), initial=i))
        return row[-1]

    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and distance(w, v) == 1] for w in words}
    form = {}
    for w, of in near.items():
        best = min(of, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return out


def prose(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aebnstéÉñ") for _ in range(rng.randint(4, 8))) for _ in range(60)] + ["x" * 50, "y" * 49 + "z", "y" * 50]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems[: rng.randint(1, len(stems))])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abñ") + w[k:], w[:k] + rng.choice("abñ") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [4096, 5])
def test_variants(spark, block, monkeypatch):
    monkeypatch.setattr(spelling.neighbours, "__defaults__", (block,))
    rows = [*prose(4, 150), (None, "Other othér other otherx OTHER"), (6, " ".join(["chaina"] * 3 + ["chainab"] * 8 + ["chainabc"] * 20 + ["chainabcd"] * 50)), (7, None), (8, ""), (9, "1 2 ... ×÷×÷× ×÷×÷× ×÷×÷×"), (9, "1 2 ... ×÷×÷× ×÷×÷× ×÷×÷×")]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    found = [tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variants(docs).collect()]
    expected = brute_variants(rows)
    assert len(found) == len(set(found)) and set(found) == expected
    assert any(r[5] not in (r[0], r[3]) for r in expected) and any(r[2] > 1 for r in expected)  # chains and several near words


def test_variants_of_long_words_and_nothing(spark):
    long = "ab" * 100_000
    rows = [(1, f"{long} {long} {long}a {long}a {long}a"), (2, f"{long} {long} {long}"), (2, f"{long} {long}b {long}b {long}b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = Counter((len(r.word), r.n, r.n_near) for r in spelling.variants(docs).collect())
    assert found[200_000, 6, 2] == 1 and found[200_001, 3, 2] == 2, found
    assert spelling.variants(docs.limit(0)).collect() == [] and spelling.variants(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).collect() == []


def test_letters_beyond_the_mask_share_bits():
    """Ninety letters share 63 bits, so a replacement may flip none: such pairs are found all the same."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    bits = {x: (k % 63) % 3 * 21 + k % 63 // 3 for k, x in enumerate(letters)}
    words = np.array(sorted({f"abcd{x}" for x in letters} | {f"{x}bcde" for x in letters}), object)
    masks = np.array([spelling.mask(w, bits) for w in words], np.uint64)
    pairs = set()
    for b in range(3):
        band = masks >> np.uint64(21 * b) & np.uint64((1 << 21) - 1)
        for value in np.unique(band):
            at = np.flatnonzero(band == value)
            first, second = spelling.pairs_of_cell(b, np.full(len(at), 2), masks[at], words[at])
            new = {(words[at][i], words[at][j]) for i, j in zip(first, second, strict=True)}
            assert not new & pairs
            pairs |= new
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in itertools.combinations(words, 2) if sum(x != y for x, y in zip(*p, strict=True)) == 1}


# --- quality model


def quality_docs(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        clean = [rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(1, 150))]
        kind = rng.choice(["clean", "clean", "clean", "shout", "repeat", "symbols"])
        bad = {"clean": clean, "shout": [w.upper() + "!!" for w in clean], "repeat": [clean[0]] * len(clean), "symbols": [w + rng.choice(["$$$", "%%%"]) for w in clean]}[kind]
        docs.append((i, " ".join(bad)))
        labels.append((i, int(kind == "clean" or len(clean) < 3)))
    return docs, labels


def brute_scores(docs, labels):
    """The same sums with dictionaries, one place at a time."""
    known, rng = quality_model.Words(), range
    fold = lambda i: zlib.crc32(str(i).encode()) % 5

    def values(text):
        out = Counter()
        for kind in quality_model.ngrams(text, known):
            for place in kind.tolist():
                out[place] += 1.0 / len(kind)
        return out

    z, n = Counter(), Counter()

    def weight(k):
        l1, l2 = (0, 0) if k == "bias" else (quality_model.L1, quality_model.L2)
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((quality_model.BETA + math.sqrt(n[k])) / quality_model.ALPHA + l2)

    def score(text):
        return 1 / (1 + math.exp(-sum((v * weight(k) for k, v in values(text).items()), weight("bias"))))

    for _ in rng(quality_model.EPOCHS):
        for i in labels:
            text, label = docs[i[0]], i[1]
            off = score(text) - label
            for k, v in [*values(text).items(), ("bias", 1.0)]:
                w, slope = weight(k), off * v
                z[k] += slope - (math.sqrt(n[k] + slope * slope) - math.sqrt(n[k])) / quality_model.ALPHA * w
                n[k] += slope * slope
    return {i: (fold(i) == 0, score(t)) for i, t in docs.items()}


def test_quality_model(spark):
    docs, labels = quality_docs(5, 120)
    docs += [(500, None), (501, ""), (502, "one"), (503, "word " * 50_000)]
    df = spark.createDataFrame([(*r, "en") for r in docs], "doc_id bigint, text string, score string").repartition(3)
    marked = spark.createDataFrame([*labels, (500, 7), (502, None)], "doc_id bigint, quality int")
    chosen = [(r.of, r.label) for r in quality_model.sample(df, marked).orderBy("place", "of").collect()]
    assert sorted(chosen) == [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]
    expected = brute_scores(dict(docs), chosen)
    found = {r.doc_id: r for r in quality_model.scores(df, quality_model.fit(df, marked)).collect()}
    assert found.keys() == expected.keys()
    for i, (out, score) in expected.items():
        assert found[i].held_out == out and abs(found[i].score - score) < 1e-9 and found[i].predicted == (score >= 0.3), i


def test_quality_model_on_unseen_rows(spark):
    docs, labels = quality_docs(6, 500)
    df, marked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    found = quality_model.scores(df, quality_model.fit(df, marked)).where("held_out").collect()
    right = [r.predicted == dict(labels)[r.doc_id] for r in found]
    assert len(right) > 80 and sum(right) > 0.95 * len(right)


def test_quality_model_of_odd_rows(spark):
    """Repeated and null ids, labels that contradict each other, one class only, no rows."""
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (None, "e"), (3, "f")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (None, 0)], "doc_id bigint, quality int")
    found = quality_model.scores(docs, quality_model.fit(docs, labels)).collect()
    assert [r.score for r in found] == [0.5] * 4 and [r.held_out for r in found if r.doc_id is None] == [True]
    assert quality_model.sample(docs, labels).count() == (zlib.crc32(b"3") % 5 != 0)
    assert quality_model.scores(docs.limit(0), quality_model.fit(docs.limit(0), labels.limit(0))).collect() == []
