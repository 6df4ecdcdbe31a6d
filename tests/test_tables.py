"""Statistics, evidence, sources, sinks, trees and streams."""

import json

import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.operators import evidence as E
from textloom.operators import statistics as S
from textloom.operators.audit import audit
from textloom.plans import catalog
from textloom.plans import spec as trees
from textloom.plans.catalog import spec
from textloom.sources import readers, writers
from textloom.streaming.features import streamed_features


def test_statistics(spark):
    rows = [(3.5, "7", 0), (9.0, "-1", 0), (3.5, None, 0), (-2.0, "x7", 0), (float("nan"), "0.5", 0), (10.0, " ", 0)]
    table = spark.createDataFrame(rows, "a double, b string, z int")
    got = {r.feature: r for r in S.summary(table, ["a", "b", "z"]).collect()}
    a = got["a"]
    assert (a["count"], a.missing_count, a["sum"], a.q25, a.median, a.q75, a.mode, a.nonzero_ratio) == (5, 1, 24, 3.5, 3.5, 9, 3.5, 1)
    assert a.std == pytest.approx(23.575**0.5) and got["b"]["count"] == 3 and got["z"].nonzero_count == 0
    empty = S.summary(table.limit(0), ["a"]).collect()
    assert [(r.feature, r["count"], r.missing_count, r.nonzero_count, r["mean"], r["median"], r["mode"]) for r in empty] == [("a", 0, 0, 0, None, None, None)] and S.numeric_columns(table) == ["a", "z"]
    assert [r.feature for r in S.zero_only(S.summary(table, ["a", "z"])).collect()] == ["z"]
    assert [r.feature for r in S.ranked(S.summary(table, ["a", "z"]), "mean", 1).collect()] == ["a"]
    assert [r.feature for r in S.sparse(S.summary(table, ["a", "z"])).collect()] == ["z"]


def test_exact_quantiles_by_ranges(spark, monkeypatch):
    """Those of the state that holds all values, for hot groups, ties, few rows and infinite values, with ranges that are many or few."""
    import random

    rng, rows = random.Random(4), []
    for g, n in (("hot", 3000), ("ties", 400), ("one", 1), ("two", 2), ("three", 3), ("none", 2)):
        for _ in range(n):
            v = {"hot": rng.gauss(0, 1), "ties": float(rng.randint(0, 3)), "none": None}.get(g, rng.random())
            rows.append((g, v, rng.choice([v, None, -v if v else 0.0, 1e300])))
    rows += [("far", x, 0.0) for x in (float("inf"), float("-inf"), 1.0, float("nan"), 0.0)]
    table = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    long = S.long_values(table, ["a", "b"], ("g",))
    plain = long.groupBy("g", "feature").agg(*(F.percentile("value", F.lit(p)).alias(s) for s, p in S.QUANTILES.items()), F.mode("value", True).alias("mode"))
    expected = {(r.g, r.feature): tuple(repr(x) for x in r[2:]) for r in plain.collect()}
    for ranges in (64, 5):
        monkeypatch.setattr(S.exact_quantiles, "__defaults__", (ranges,))
        found = S.summary(table, ["a", "b"], ("q25", "median", "q75", "mode"), ("g",))
        got = {(r.g, r.feature): tuple(repr(x) for x in r[2:]) for r in found.collect()}
        assert {k: tuple(x.replace("-0.0", "0.0") for x in v) for k, v in got.items()} == {k: tuple(x.replace("-0.0", "0.0") for x in v) for k, v in expected.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert " percentile(" not in plan and "mode(" not in plan.replace("executionMode(", "")


def test_groups_drop_null_keys(spark):
    table = spark.createDataFrame([("x", 1.0), (None, 2.0), ("x", 3.0)], "g string, a double")
    rows = S.summary(table, ["a"], ("mean",), ("g",)).collect()
    assert [(r.g, r.mean) for r in rows] == [("x", 2.0)]


def test_histogram(spark):
    spans = spark.createDataFrame([(1, "d", 0, 2, ""), (1, "d", 8, 10, ""), (1, "d", 9, 10, "")], "id bigint, dimension string, start int, end int, text string")
    lengths = spark.createDataFrame([(1, 10), (2, 0)], "id bigint, length int")
    rows = E.histogram(spans, lengths, 2).orderBy("segment").collect()
    assert [(r.segment, r.n, r.share, r.total) for r in rows] == [(0, 1, 1 / 3, 3), (1, 2, 2 / 3, 3)]
    delta = E.deltas(E.corpus_positions(E.histogram(spans, lengths, 2))).first()
    assert delta.pooled_delta == pytest.approx(1 / 3)
    with pytest.raises(Exception, match="outside its text"):
        E.histogram(spans, lengths.withColumn("length", F.lit(5)), 2).collect()
    assert [tuple(x) for x in spark.range(1).select(E.bounds(F.lit(5), 2).alias("b")).first().b] == [(0, 0, 2), (1, 2, 5)]


def test_documents(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,tweet,label\n7,"hola, ""mundo""\nadiós",x\n8,,y\n')
    rows = readers.read_documents(spark, str(path), "tweet").orderBy("id").collect()
    assert [(r.id, r.text, r.label) for r in rows] == [(7, 'hola, "mundo"\nadiós', "x"), (8, "", "y")]
    with pytest.raises(ValueError):
        readers.read_documents(spark, str(path), "text")
    numbered = readers.with_ids(spark.range(50).select(F.col("id").alias("v")).repartition(5).sortWithinPartitions("v")).collect()
    assert sorted(r.id for r in numbered) == list(range(50))


def test_jsonl_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a,b,"), (2, None), (3, "é,")], "id bigint, text string")
    table = docs.select("id", F.when(F.col("id") == 2, float("inf")).otherwise(F.col("id").cast("double")).alias("commas"))
    found = E.evidence(docs, {"commas": ("text", [","])})
    described = {"commas": {"kind": "atomic", "evidence": {"kind": "text_span", "source": "text", "unit": "characters"}}}
    table = table.join(docs.select(F.col("id").alias("of"), F.length(F.coalesce("text", F.lit(""))).alias("n")), F.col("id") == F.col("of")).drop("of")
    writers.write_jsonl(writers.jsonl_lines(table, described, found, {"text": F.col("n")}), str(tmp_path / "out"))
    writers.merged(str(tmp_path / "out"), str(tmp_path / "out.jsonl"))
    assert json.loads((tmp_path / "out.jsonl").read_text().splitlines()[0])["_type"] == "metadata"
    meta, parsed = readers.read_jsonl(spark, str(tmp_path / "out.jsonl"))
    assert {r.id: r.commas for r in readers.wide_values(meta, parsed).collect()} == {"1": 1.0, "2": None, "3": 3.0}
    assert sorted((r.id, r.start, r.end) for r in readers.spans(meta, parsed).collect()) == [("1", 1, 2), ("1", 3, 4), ("3", 1, 2)]
    assert all(r.violations == 0 for r in audit(readers.numbered_lines(spark, str(tmp_path / "out.jsonl"))).collect())
    vectors = E.vectors(readers.wide_values(meta, parsed), E.histogram(readers.spans(meta, parsed), readers.source_lengths(parsed, "text"), 2), ["commas"], 2)
    assert {r.id: r.commas__position_total for r in vectors.collect()} == {"1": 2, "2": 0, "3": 1}
    (tmp_path / "bad.jsonl").write_text('{"_type":"document","id":"1"}\n')
    with pytest.raises(ValueError):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"))


def test_sinks(spark, tmp_path):
    for form in writers.WRITERS:
        writers.write(spark.range(3), str(tmp_path / f"x.{form}"))
    with pytest.raises(ValueError):
        writers.write(spark.range(3), str(tmp_path / "x.foo"))


CONFIG = """
includes: [more.yaml]
dimensions:
  - key: total
    strategy: CompositeStrategySum
    children:
      - {key: words, class: textloom.WordCountDimension}
      - {key: commas, class: PatternDimension, pattern: ",", percentage: false, input_column: text_raw}
  - {key: ratio, class: RatioDimension, numerator: commas, denominator: words}
"""


def test_trees(tmp_path, spark, capsys):
    (tmp_path / "main.yaml").write_text(CONFIG)
    (tmp_path / "more.yaml").write_text("dimensions:\n  - {key: len, class: LengthDimension}\n")
    nodes = trees.load(tmp_path / "main.yaml")
    assert [n.key for n in trees.post_order(nodes)] == ["words", "commas", "total", "ratio", "len"] and not trees.problems(nodes)
    assert [n.key for n, _ in trees.walk(trees.pruned(nodes, ["ratio"]))] == ["total", "words", "commas", "ratio"]
    assert trees.explain(nodes, "commas")["path"] == ["total", "commas"] and "  words" in trees.tree_text(nodes)
    (tmp_path / "again.yaml").write_text(trees.dump(nodes))
    assert trees.dump(trees.load(tmp_path / "again.yaml")) == trees.dump(nodes)
    bad = [spec("a", "Nothing"), spec("a", "RatioDimension", numerator="x")]
    assert len(trees.problems(bad)) == 4
    with pytest.raises(ValueError):
        trees.from_dict({"key": "k", "pattern": "x", "params": {"pattern": "y"}})
    path = tmp_path / "docs.csv"
    path.write_text("id,text\n1,\"a, b\"\n2,c\n")
    options = cli.parser().parse_args(["analyze", str(path), "--config", str(tmp_path / "main.yaml"), "--cache", str(tmp_path / "cache")])
    for _ in range(2):
        options.run(options)
    out = capsys.readouterr().out.strip().splitlines()
    assert out[0] == "id,words,commas,total,ratio,len" and len(out) == 6
    options = cli.parser().parse_args(["extract", str(path), "--config", str(tmp_path / "main.yaml"), "--output", str(tmp_path / "x.jsonl")])
    options.run(options)
    options = cli.parser().parse_args(["position", str(tmp_path / "x.jsonl"), "--dimension", "commas"])
    options.run(options)
    one = json.loads(capsys.readouterr().out)
    assert (one["dimension"], one["document_count"], one["documents_with_evidence"], one["occurrence_counts"]) == ("commas", 2, 1, [0, 1, 0])  # its middle is 1.5 of 4
    assert (one["occurrence_delta"], one["mean_document_delta"]) == (0.0, 0.0)
    options = cli.parser().parse_args(["position", str(tmp_path / "x.jsonl"), "--output", str(tmp_path / "position.json")])
    options.run(options)
    assert [x["dimension"] for x in json.loads((tmp_path / "position.json").read_text())] == ["words", "commas", "total", "ratio", "len"]
    options = cli.parser().parse_args(["position", str(tmp_path / "x.jsonl"), "--dimension", "nothing"])
    with pytest.raises(ValueError, match="not declared"):
        options.run(options)
    options = cli.parser().parse_args(["vectorize", str(tmp_path / "x.jsonl")])
    options.run(options)
    assert "commas__position_share_5" in capsys.readouterr().out


def test_position_report(spark):
    """Documents without a span, of length zero and without a length; a dimension without any span."""
    spans = spark.createDataFrame([("a", "d", 0, 2), ("a", "d", 8, 10), ("a", "d", 9, 10), ("b", "d", 1, 2)], "id string, dimension string, start int, end int")
    lengths = spark.createDataFrame([("a", 10), ("b", 10), ("c", 7), ("z", 0), ("n", None)], "id string, length int")
    d, none = E.position_report(E.histogram(spans, lengths, 2), lengths, ["d", "none", "d"], 2).orderBy("dimension").collect()
    assert (d.document_count, d.documents_with_evidence, d.total_occurrences, d.occurrence_counts) == (4, 2, 4, [2, 2])
    assert d.mean_document_shares == pytest.approx([2 / 3, 1 / 3]) and d.occurrence_shares == [0.5, 0.5]
    assert (d.occurrence_delta, d.mean_document_delta) == pytest.approx((0.0, -1 / 3))
    assert (none.document_count, none.documents_with_evidence, none.occurrence_counts, none.occurrence_shares, none.occurrence_delta) == (4, 0, [0, 0], [0.0, 0.0], None)
    empty = E.position_report(E.histogram(spans.limit(0), lengths.limit(0), 2), lengths.limit(0), ["d"], 2).collect()
    assert [(r.document_count, r.total_occurrences, r.mean_document_delta) for r in empty] == [(0, 0, None)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Hola mundo")], "id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, text string").parquet(str(tmp_path / "in"))
    out = streamed_features(stream, [spec("words", "WordCountDimension")])
    run = out.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(60)
    assert spark.table("streamed").collect()[0].words == 2


def test_evidence_and_parts_of_more_features(spark, tmp_path):
    """Spans of lexicons (without what exceptions cover), characters and repeated words, and the parts of rates, in the JSON lines."""
    folder = tmp_path / "lexicons"
    folder.mkdir()
    (folder / "d.txt").write_text("ca\\p{L}+\nNEG:cada\n")
    (tmp_path / "t.yaml").write_text("dimensions:\n- {key: lex, class: WordPerDictionary, dictionary: d}\n- {key: commas, class: CharacterFrequencyDimension, pattern: ','}\n- {key: twice, class: ErrorMiscTwoOrMoreEqualWordsDimension, input_column: text_norm}\n")
    (tmp_path / "docs.csv").write_text("id,text\n1,\"casa cada cama, la la\"\n2,\n")
    from textloom import cli

    options = cli.parser().parse_args(["extract", str(tmp_path / "docs.csv"), "--config", str(tmp_path / "t.yaml"), "--lexicons", str(folder), "--output", str(tmp_path / "x.jsonl")])
    options.run(options)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "x.jsonl")).collect()]
    row = next(x for x in lines if x["_type"] == "document" and str(x["id"]) == "1")["dimensions"]
    assert [(x["text"], x["start"], x["end"]) for x in row["lex"]["evidence"]] == [("casa", 0, 4), ("cama", 10, 14)]
    assert [x["start"] for x in row["commas"]["evidence"]] == [14] and (row["commas"]["numerator"], row["commas"]["denominator"]) == (1.0, 21.0)
    assert [x["text"] for x in row["twice"]["evidence"]] == ["la la"]


def test_html_references_as_in_sql(spark, tmp_path):
    """References cut off at the end of a page, by number, without semicolons and unknown ones."""
    duckdb = pytest.importorskip("duckdb")
    pages = ["a &amp", "&am &amp;lt; &ampx &notit; &notin;", "&#0; &#13 &#x80; &#129;&#xD800; &#1114112; &#99999999999999999999;", "&#xFFFE;&#1;&#65;&#x41 &# &#x &;", "&lt;b&gt;x<i>", None, "", "&CounterClockwiseContourIntegral;&nbsp&copy©"]
    spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(connection.execute(catalog.ORACLE_SQL["q_html_strip"]).fetchall())
    assert {r.page_id: r.plain for r in catalog.QUERIES["q_html_strip"](spark, str(tmp_path)).collect()} == want
    assert want[0] == "a &" and want[4] == " x "
