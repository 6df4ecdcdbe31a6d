import copy
import random
import re
import time

import public_tokenizers
from pyspark.sql import functions as F

from textloom.llm import byte_bpe, edit_counts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
KIT = ["word", " the", "  ", "\n", "é", "漢字", "12345", "'s", " a", ".", "\t", "x" * 40, " ", " 's"]


def count(text):
    return len(byte_bpe.encode(text, RANKS, PATTERN))


def plainly(text, edits):
    """Edits by start, each from where the one before ended."""
    out, at = "", 0
    for start, length, new in sorted(edits, key=lambda e: min(e[0], len(text))):
        start = max(at, min(start, len(text)))
        out += text[at:start] + new
        at = max(start, min(start + length, len(text)))
    return out + text[at:]


def test_edits_match_whole_counts(monkeypatch):
    monkeypatch.setattr(edit_counts, "LEAF", 12)
    monkeypatch.setattr(edit_counts, "FAN", 3)
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(KIT) for _ in range(rng.randint(0, 60)))
        tree = edit_counts.build(text, count)
        assert tree.n_tokens == count(text)
        for _ in range(5):
            edits = [(rng.randint(0, len(text) + 3), rng.choice([0, 0, 1, 5, 50]), "".join(rng.choice(KIT) for _ in range(rng.randint(0, 3)))) for _ in range(rng.choice([0, 1, 1, 2, 5]))]
            want, old = plainly(text, edits), copy.deepcopy(tree)
            text, work = edit_counts.edit(text, tree, edits, count)
            assert text == want and work <= len(text)
            assert tree.n_tokens == count(text), text
            assert sum(tree.lengths[0]) == len(text)
            fresh = edit_counts.Tree([list(tree.lengths[0])], [list(tree.tokens[0])])
            fresh.renew([(0, len(tree.lengths[0]))])
            assert (fresh.lengths, fresh.tokens) == (tree.lengths, tree.tokens), old.lengths


def test_only_touched_leaves_are_encoded():
    text = "some words here " * 5000
    tree = edit_counts.build(text, count)
    seen = []
    edit_counts.edit(text, tree, [(40_000, 3, "zz"), (40_010, 1, ""), (70_000, 0, "q")], lambda t: seen.append(len(t)) or count(t))
    assert sum(seen) < 8 * edit_counts.LEAF


def test_stored_counts_are_used():
    """A leaf that no edit touches keeps its stored count, and the sums above it come from the stored ones."""
    tree = edit_counts.build("some words here " * 500, count)
    before = tree.n_tokens
    tree.tokens[0][-1] += 1000
    tree.renew([(len(tree.tokens[0]) - 1, len(tree.tokens[0]))])
    assert tree.n_tokens == before + 1000
    text, _ = edit_counts.edit("some words here " * 500, tree, [(5, 5, "lines")], count)
    assert tree.n_tokens == count(text) + 1000


def test_many_edits_take_linear_work():
    took = []
    for n in (4_000, 32_000):
        text = "some words and 12345 more " * n
        tree, begin = edit_counts.build(text, count), time.time()
        edits = [(m.start(), 5, "<n>") for m in re.finditer("12345", text)]
        new, work = edit_counts.edit(text, tree, edits, count)
        took.append(time.time() - begin)
        assert tree.n_tokens == count(new) and work <= len(new)
    assert took[1] < 30 * took[0]


def test_long_white_space():
    text = f"a 12345{' ' * 2_000_000}b 99999{chr(10) * 100_000}"
    tree = edit_counts.build(text, count)
    new, _ = edit_counts.edit(text, tree, [(m.start(), 5, "<n>") for m in re.finditer("[0-9]{5}", text)], count)
    assert tree.n_tokens == count(new) and new == re.sub("[0-9]{5}", "<n>", text)


def test_frames(spark):
    texts = [None, "", "call 12345 now, 99999", "é 漢字 😀 1234", "x" * 50_000, "a b " * 30_000 + "77777"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, texts[2], 2)], "doc_id bigint, text string, edits int")
    built, masked = edit_counts.trees(docs, RANKS, PATTERN), edit_counts.masking("[0-9]{4,}", "<n>")
    done = edit_counts.edited(built, RANKS, PATTERN, lambda text: [*masked(text), (len(text), 0, "\nEnd.")])
    rows = done.collect()
    assert len(rows) == 7
    for r in rows:
        before = texts[r.doc_id] or ""
        after = re.sub("[0-9]{4,}", "<n>", before) + "\nEnd."
        assert (r.n_before, r.n_after, r.text) == (count(before), count(after), after)
    again = edit_counts.edited(done.drop("n_before", "n_after").withColumn("edits", edit_counts.appended(F.col("text"), " Or not.")), RANKS, PATTERN)
    assert all(r.n_after == count(r.text) and r.text.endswith("End. Or not.") for r in again.collect())
    assert edit_counts.edited(built.limit(0), RANKS, PATTERN, masked).collect() == []


def test_null_edits(spark):
    built = edit_counts.trees(spark.createDataFrame([(i, "a b 12") for i in range(5)], "doc_id bigint, text string"), RANKS, PATTERN)
    given = ["CAST(NULL AS {0})", "CAST(array(NULL) AS {0})", "CAST(array(struct(NULL, 1, 'x')) AS {0})", "CAST(array(struct(2, NULL, 'x')) AS {0})", "CAST(array(struct(2, 1, NULL)) AS {0})"]
    edits = F.coalesce(*(F.when(F.col("doc_id") == i, F.expr(e.format(edit_counts.EDITS))) for i, e in enumerate(given)))
    rows = {r.doc_id: r for r in edit_counts.edited(built.withColumn("edits", edits), RANKS, PATTERN).collect()}
    assert [rows[i].text for i in range(5)] == ["a b 12", "a b 12", "a b 12", "a xb 12", "a  12"]
    assert all(r.n_after == count(r.text) for r in rows.values())
