import random

import corpus_pipeline
from textloom.llm import simhash
from textloom.llm.queries import ORACLE_SQL, QUERIES


def rows(spark, tmp_path):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in ("an", "or", "ish", "ell", "um") for c in ("a", "en", "ish", "ot", "er", "in", "al", "us")]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    line = lambda: " ".join(sentence(12) for _ in range(4))
    clean = ["\n".join(line() for _ in range(6)) for _ in range(40)]
    items = [sentence(25) for _ in range(3)]
    long_line = sentence(150)
    near = long_line.split()
    near[70] = "changed"
    special = {100: clean[0], 101: "| x " * 200, 102: f"{line()}\n{line()}\n{items[0]}", 103: long_line, 104: " ".join(near), 105: "short text", 106: "\n".join([line(), clean[2].split("\n")[1], line(), line()])}
    docs = [(i, t, "en", "s", len(t)) for i, t in [*enumerate(clean), *special.items()]]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return clean, special


def test_stages(spark, tmp_path):
    clean, special = rows(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "byte_bpe":
            assert sorted(docs.columns) == sorted(columns)
    assert kept["quality_rules"].keys() == {*range(40), 100, 102, 103, 104, 106}
    lines = kept["line_dedup"]
    assert lines[100].text == "" and lines[100].n_chars == 0 and clean[2].split("\n")[1] not in lines[106].text and lines[5].text == clean[5]
    assert kept["near_duplicates"].keys() == {*range(40), 100, 102, 103, 106}
    assert kept["decontamination"].keys() == {*range(40), 100, 103, 106}
    assert kept["byte_bpe"].keys() == kept["decontamination"].keys()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["byte_bpe"])


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing column names; and no rows at all."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("an", "or", "ish", "ell", "um", "ata", "ine")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(120) for _ in range(8)]
    rows = [(i, t, "en", "s", len(t), 1, "x") for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "s", len(texts[0]), 1, "x"), (None, texts[1], None, None, None, None, None), (3, texts[2], "en", None, 5, 2, "y")]
    rows += [(20, None, "en", "s", None, 3, "z"), (21, "", "en", "s", 0, 4, "z"), (22, f"{prose(100)}{' ' * 1_500_000}{prose(20)}", "en", "s", 7, 5, "z"), (23, "\n" * 1000, "en", "s", 1000, 6, "z")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_hash int, __hash string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(texts[7].split()[:40])), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "byte_bpe":
            assert sorted(docs.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "text_hash", "__hash"])
    ids = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    # 3 is two different documents; what is left of copies is one empty text, that of the smallest id among them
    assert [i for i in ids if i not in (3,)] == [0, 1, 2, 4, 5, 6, 22] and ids.count(3) == 2
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert ORACLE_SQL.keys() <= QUERIES.keys()
    assert simhash.NEAR_BITS < 32
