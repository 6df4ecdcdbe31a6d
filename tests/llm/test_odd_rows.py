"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

import hashlib
import itertools
import random
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import byte_bpe, decontaminate, line_align, orc_tokens, quality, warc
from textloom.llm.storage import fresh_path

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum  dolor\n" * 20_000
BLOCK = " ".join(f"tok{i}" for i in range(30))
TEXTS = [None, "", "   \n\t", LONG, "é 漢字 😀 it's 12345", BLOCK, f"intro line\n{BLOCK}\nend", "a b c"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None, i, "x") for i, t in enumerate(TEXTS)] + [(3, LONG, "en", None, 1, "y"), (None, BLOCK, None, "s", 2, "z"), (5, BLOCK, "en", None, 3, "x"), (5, BLOCK, "en", None, 3, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, __id bigint, words string")


def test_bpe_chunks_do_not_change_ids(monkeypatch):
    enc, rng = byte_bpe.encoding(RANKS, PATTERN), random.Random(2)
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 7)
    kit = ["a", "'s", " ", "  ", "\n", "1", "é", "漢", " ", "\t", ".", " \n ", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(kit) for _ in range(rng.randint(0, 40)))
        assert byte_bpe.encode(text, RANKS, PATTERN) == enc.encode_ordinary(text)


def test_bpe_long_white_space(monkeypatch):
    """The ids of the library for runs that it can take, and whole round trips for those of two million characters."""
    enc = byte_bpe.encoding(RANKS, PATTERN)
    kinds = [" ", "\n", " \n\t", "\u3000", "\xa0 ", "\x1c", "\r\n"]
    with monkeypatch.context() as small:
        small.setattr(byte_bpe, "CHUNK_CHARS", 50)
        for run, n in itertools.product(kinds, (999, 1000, 1001, 5000)):
            for text in (run * n, f"{run * n}x", f"a{run * n}", f"a b{run * n}'s{run * n}. {run * n} c", f"1{run * n}\n{run}x"):
                assert byte_bpe.encode(text, RANKS, PATTERN) == enc.encode_ordinary(text)
    for run in (" ", "\n", " \n\t "):
        long = run * (2_000_000 // len(run))
        for text in (f"{long}x", f"a b {long}c d", f"a b{long}"):
            ids = byte_bpe.encode(text, RANKS, PATTERN)
            assert byte_bpe.decode(ids, RANKS, PATTERN) == text.encode()
            cut = text.replace(long, run * 1000)
            assert len(ids) > len(byte_bpe.encode(cut, RANKS, PATTERN))


def test_bpe_frames(docs):
    rows = byte_bpe.round_trip(docs, RANKS, PATTERN).collect()
    assert len(rows) == 12 and all(r.exact for r in rows)
    by_text = {r.doc_id: r for r in rows}
    assert by_text[0].n_tokens == by_text[1].n_tokens == 0 and by_text[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    back = byte_bpe.decoded(byte_bpe.encoded(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(bytes(r.raw) for r in back.collect()) == sorted((r.text or "").encode() for r in docs.collect())
    assert byte_bpe.round_trip(docs.limit(0), RANKS, PATTERN).count() == 0


def test_word_ids_match_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    rng, kit = random.Random(1), [*"aAbé É1²½ \t\n\r\x0b\x0c\x1c\x85\xa0 ́'’.,!<>|İΣςß漢😀", "'s", " <|endoftext|> ", "<|startoftext|>", "<|EndOfText|>", "<unk>"]
    texts = ["".join(rng.choice(kit) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    ids, bounds = orc_tokens.encode_texts(pa.array(texts), WORDS)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_orc_round_trip(spark, docs):
    path = fresh_path(spark, "orc")
    orc_tokens.write(docs, path, WORDS, 2, 3)
    tokens = orc_tokens.read(spark, path)
    rows = sorted(orc_tokens.digests(tokens).collect(), key=lambda r: r.start)
    assert len(rows) == 12 and rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    texts = {**dict(enumerate(TEXTS)), None: BLOCK}
    for r in rows:
        ids, _ = orc_tokens.encode_texts(pa.array([texts[r.doc_id]], pa.string()), WORDS, 2)
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
    assert tokens.where("doc_id = 5").count() == 3
    empty = fresh_path(spark, "orc")
    orc_tokens.write(docs.limit(0), empty, WORDS, 2, 1)
    assert orc_tokens.digests(orc_tokens.read(spark, empty)).count() == 0


def rows_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getName() else plan
    return plan.collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_orc_filters_skip_row_groups_and_files(spark):
    """A filter on doc_id reads one row group by the index, none where the Bloom filter says no, and only files whose range fits."""
    texts = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    path = fresh_path(spark, "orc")
    orc_tokens.write(texts, path, WORDS, 2, 2)
    tokens = orc_tokens.read(spark, path)
    assert rows_read(tokens.where("doc_id = 12344").select("n_tokens")) == orc_tokens.INDEX_ROWS
    absent = [rows_read(tokens.where(f"doc_id = {k}").select("n_tokens")) for k in range(12_341, 12_361, 2)]
    assert absent.count(0) >= 8  # the chance of a wrong yes is 1 %
    assert rows_read(tokens.where("doc_id > 39000").select("n_tokens")) <= 2 * orc_tokens.INDEX_ROWS  # groups that begin before and after


def test_warc(spark):
    html = "<p>" + "é" * 200
    rows = [(1, "http://a/", html, 1), (2, None, html, 2), (3, "http://b/ \r\nX: y", "short", 3), (4, "u", None, 4), (5, "u", "", 5), (6, "u", "short", 6), (None, "u", html, 7), (7, "u", "x\r\n\r\ny" * 50_000, 8), (1, "u", html, 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, archive int")
    root = fresh_path(spark, "warc")
    index = warc.write_archives(pages, root)
    facts = {(r.page_id, r.record_type): r for r in warc.payload_facts(warc.read_records(index, root)).collect()}
    assert all(r.intact for r in facts.values())
    digest = hashlib.sha256(html.encode()).hexdigest()
    assert facts[2, "revisit"].refers_to == 1 and facts[2, "revisit"].payload_digest == digest and facts[2, "revisit"].payload_bytes == len(html.encode())
    assert facts[None, "revisit"].refers_to == 1 and facts[1, "response"].payload_digest == digest
    assert facts[3, "response"].payload_bytes == facts[6, "response"].payload_bytes == 5
    assert facts[4, "response"].payload_bytes == facts[5, "response"].payload_bytes == 0 and facts[7, "response"].payload_bytes == 300_000
    some = warc.read_records(index.where("page_id in (3, 7)"), root, max_gap=0).collect()
    assert sorted((r.page_id, len(r.payload)) for r in some) == [(3, 5), (7, 300_000)]
    assert warc.byte_ranges(index, 1 << 30, 1 << 30).count() == index.select("archive").distinct().count()
    empty = fresh_path(spark, "warc")
    assert warc.read_records(warc.write_archives(pages.limit(0), empty), empty).count() == 0


def brute_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("packed", [1 << 16, 1])
def test_quality_counts(spark, docs, packed, monkeypatch):
    monkeypatch.setattr(quality, "PACKED", packed)
    rng = random.Random(3)
    more = [" ".join(rng.choice(["a", "b", "c#", "dé"]) for _ in range(rng.randint(0, 30))).replace("b a", "b\na") for _ in range(60)]
    table = docs.select("doc_id", "text", "lang", "source", "words").union(spark.createDataFrame([(100 + i, t, "en", "s", "w") for i, t in enumerate(more)], "doc_id bigint, text string, lang string, source string, words string"))
    texts = {r.doc_id: r.text for r in table.collect()}
    rows = quality.verdicts(table).collect()
    assert len(rows) == 72
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_keeps_columns(docs):
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and quality.kept_documents(docs.limit(0)).count() == 0


def test_line_dedup(docs):
    rows = line_align.deduplicated(docs).collect()
    assert len(rows) == 12
    text = {(r.doc_id, r.words): r.text for r in rows}
    assert text[0, "x"] is None and text[1, "x"] == "" and text[3, "x"] == text[3, "y"] == LONG and text[5, "x"] == BLOCK and text[6, "x"] == "intro line\nend" and text[None, "z"] == ""
    assert line_align.deduplicated(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (40, 20, 12, 5, 15)]
    held = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    planted = {}
    for i in range(20):
        item = rng.randrange(5)
        part = items[item].split()
        for k in range(3, len(part), 7) if len(part) > 12 else ():
            part[k] = "other"
        held[i] = " ".join([*held[i].split()[:20], *part, *held[i].split()[20:]])
        planted[1000 + i] = item
    table = docs.select("doc_id", "text", "__id").union(spark.createDataFrame([(1000 + i, t, 0) for i, t in enumerate(held)], "doc_id bigint, text string, __id bigint"))
    benchmark = spark.createDataFrame([*enumerate(items), (None, None), (9, "")], "item_id bigint, text string")
    for limit in (decontaminate.MAX_BROADCAST, 0):
        found = {r.doc_id: r.item_id for r in decontaminate.overlaps(table, benchmark, limit).collect()}
        assert found == planted
    kept = decontaminate.clean_documents(table, benchmark)
    assert kept.columns == table.columns and kept.count() == 12 + 10
    assert decontaminate.overlaps(table, benchmark.limit(0)).count() == 0 and decontaminate.overlaps(table.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST, 0])
def test_short_items_are_found_by_share(spark, limit):
    """Every pattern of as many substitutions as the share allows, for items of up to 13 tokens; the sparsest for others."""
    items = {n: [f"i{n}t{k}" for k in range(n)] for n in range(1, 40)}
    rows, want = [], set()
    for n, tokens in items.items():
        few = n // 5
        holes = list(itertools.combinations(range(n), few)) if n <= 13 else [tuple(range(shift, n, 5))[:few] for shift in range(5)]
        for hole in [*holes, tuple(range(few + 1))]:
            rows.append((len(rows), " ".join(["before", *("other" if k in hole else t for k, t in enumerate(tokens)), "behind"])))
            if len(hole) <= few:
                want.add((rows[-1][0], n))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table, benchmark, limit).collect() if 100 * r.matched >= 80 * r.item_tokens}
    assert found == want


def test_word_pattern_matches_queries(docs):
    assert docs.select(F.size(quality.words_of(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] > 0
