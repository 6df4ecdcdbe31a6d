"""Line alignment against plain Python: one patience diff a pair, blocks that run on in both texts."""

import random
import time

import pytest

from textloom.llm import line_align


def line(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def runs(lines, least):
    found = []
    for k in range(len(lines)):
        total, end = 0, k
        while end < len(lines) and total < least:
            total += len(lines[end].split())
            end += 1
        if total >= least:
            found.append(tuple(lines[k:end]))
    return found


def anchors(a, b):
    """Patience diff by recursion: equal ends, then the longest rising run of lines unique in both, else the rarest line."""
    if not a or not b:
        return []
    if a[0][1] == b[0][1]:
        return [(a[0][0], b[0][0]), *anchors(a[1:], b[1:])]
    if a[-1][1] == b[-1][1]:
        return [*anchors(a[:-1], b[:-1]), (a[-1][0], b[-1][0])]
    own, other = [x for _, x in a], [x for _, x in b]
    alone = [(k, other.index(x)) for k, x in enumerate(own) if own.count(x) == 1 and other.count(x) == 1]
    if alone:
        best = [[]]
        for k, j in alone:
            before = max((r for r in best if not r or r[-1][1] < j), key=len)
            best.append([*before, (k, j)])
        rising = max(best, key=len)
    else:
        common = set(own) & set(other)
        if not common:
            return []
        hashed = {x: line_align_hash(x) for x in common}
        rarest = min(common, key=lambda x: (own.count(x) + other.count(x), hashed[x]))
        rising = [(own.index(rarest), other.index(rarest))]
    found, p, q = [], 0, 0
    for k, j in [*rising, (len(a), len(b))]:
        found += anchors(a[p:k], b[q:j])
        if k < len(a):
            found.append((a[k][0], b[j][0]))
        p, q = k + 1, j + 1
    return found


def line_align_hash(text):
    """Any order will do where it decides a tie: the texts below have none that changes a block."""
    return text


def brute(texts, least):
    """doc -> text without its blocks; every pair of documents that share a run is aligned."""
    docs = {i: [(k, x.strip()) for k, x in enumerate((t or "").split("\n")) if x.strip()] for i, t in texts.items()}
    out = {}
    for later in docs:
        gone = set()
        for earlier in (e for e in docs if e < later):
            own, other = [x for _, x in docs[later]], [x for _, x in docs[earlier]]
            if not set(runs(own, least)) & set(runs(other, least)):
                continue
            block, last = [], None
            for pair in [*sorted(anchors(list(enumerate(own)), list(enumerate(other)))), None]:
                if block and (pair is None or (pair[0] - 1, pair[1] - 1) != last):
                    if sum(len(own[i].split()) for i in block) >= least:
                        gone |= {docs[later][i][0] for i in block}
                    block = []
                if pair:
                    block, last = [*block, pair[0]], pair
        out[later] = "\n".join(x for k, x in enumerate((texts[later] or "").split("\n")) if k not in gone)
    return out


def deduplicated(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    return {r.doc_id: r.text for r in line_align.deduplicated(docs).collect()}


def test_blocks_lie_in_one_earlier_document(spark):
    """Two lines of eleven words from two documents are no block; the same two from one document are."""
    rng = random.Random(1)
    a, b, c = (line(rng, 11, 10**6) for _ in range(3))
    texts = {1: f"{a}\n{c}", 2: f"{b}\nother words", 3: f"{a}\n{b}", 4: f"{a}\n\n  {b}\nmore"}
    assert deduplicated(spark, texts) == {**texts, 4: "\nmore"}


def test_order_matters(spark):
    """What moved past a larger common stretch stays, and a gap in either text ends a block."""
    rng = random.Random(2)
    x = [line(rng, 12, 10**6) for _ in range(8)]
    texts = {1: "\n".join(x), 2: "\n".join([*x[3:], *x[:3]]), 3: "\n".join([x[0], "new line", x[1], "another", x[2]])}
    got = deduplicated(spark, texts)
    assert got[2] == "\n".join(x[:3]) and got[3] == texts[3]


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [line(rng, rng.choice([5, 9, 25, 60])) for _ in range(30)]
    texts = {}
    for i in range(40):
        if texts and rng.random() < 0.6:
            lines = rng.choice(list(texts.values())).split("\n")
            at = rng.randrange(len(lines) + 1)
            lines[at : at + rng.randint(0, 2)] = [line(rng, 12) for _ in range(rng.randint(0, 2))]
            fresh = [line(rng, 30) for _ in range(rng.randint(0, 2))]
            texts[i] = "\n".join([*fresh, *lines]) if rng.random() < 0.5 else "\n".join([*lines, "", *fresh])
        else:
            texts[i] = "\n".join(rng.sample(pool, 1) + [line(rng, rng.choice([5, 25])) for _ in range(rng.randint(1, 5))])
    want, got = brute(texts, line_align.MIN_WORDS), deduplicated(spark, texts)
    assert sum(want[i] != texts[i] for i in texts) > 5
    # Not every pair is aligned, only such as hold each run between them: what is left never holds less than by all pairs.
    for i in texts:
        kept, least = got[i].split("\n"), want[i].split("\n")
        assert not [x for x in least if x not in kept], i
    differ = [i for i in texts if got[i] != want[i]]
    assert len(differ) <= 1, differ


def test_pairs_stand_for_each_run(spark):
    """Every run that an earlier document holds is met with an earlier holder of it; a rare run with first and previous."""
    rng = random.Random(5)
    pool = [line(rng, 25) for _ in range(12)]
    texts = {i: "\n".join(rng.sample(pool, rng.randint(1, 5))) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    pairs = {(r.later.id, r.earlier.id) for r in line_align.candidates(line_align.profiles(docs), buckets=4).collect()}
    held = {x: [i for i in texts if x in texts[i].split("\n")] for x in pool}
    assert all(e < l for l, e in pairs)
    for x, holders in held.items():
        for i in holders[1:]:
            assert any((i, e) in pairs for e in holders if e < i), x
    assert len(pairs) < 2 * sum(map(len, held.values()))


def test_hot_document_is_dealt(spark):
    rng = random.Random(6)
    shared = line(rng, 40)
    texts = {0: shared} | {i: f"{line(rng, 30)}\n{shared}" for i in range(1, 150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    profile = line_align.profiles(docs).cache()
    pairs = line_align.candidates(profile)
    rows = line_align.alignments(profile, pairs, slice_rows=8).collect()
    assert {(r.doc.id, tuple(r.found)) for r in rows} == {(i, (1,)) for i in range(1, 150)}


def test_second_hash_decides():
    assert line_align.common_blocks([1, 2], [1, 2], [30, 30], lambda i, j: i != 1, 20) == [0]


def test_long_and_repetitive_texts():
    n = 20_000
    for a, b in (([*range(n)], [*range(n)][::-1]), ([k % 50 for k in range(n)], [k % 49 for k in range(n)]), ([1] * n, [1] * (n - 7))):
        begin = time.time()
        found = line_align.patience(a, b)
        assert found and all(a[i] == b[j] for i, j in found) and time.time() - begin < 20


def test_odd_rows(spark):
    rng = random.Random(7)
    x = line(rng, 30)
    rows = [(5, x, 1), (5, x, 1), (None, x, 2), (None, None, 3), (6, "", 4), (7, " \n\t\n", 5), (8, f"{x}\n{x}", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __doomed int")
    got = sorted(((r.doc_id or -1), r.text or "", r["__doomed"]) for r in line_align.deduplicated(docs).collect())
    assert got == sorted([(5, x, 1), (5, x, 1), (-1, "", 2), (-1, "", 3), (6, "", 4), (7, " \n\t\n", 5), (8, x, 6)])
    assert line_align.deduplicated(docs.limit(0)).columns[:3] == docs.columns
