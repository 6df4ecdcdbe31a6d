"""Command line: python -m textloom.cli COMMAND ... over files or folders that Spark reads."""

import argparse
import csv
import hashlib
import json
import shutil
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import evidence as E
from .operators import lexicon, places, statistics
from .operators.audit import audit
from .plans import compile as plans
from .plans import spec as trees
from .sources import hunspell, readers, writers
from .sources.shipping import ship


def session() -> SparkSession:
    return ship(SparkSession.builder.appName("textloom").getOrCreate())


def show(df: DataFrame, path: str | None, form: str | None = None) -> None:
    """To a sink, or as CSV to the screen, partition by partition."""
    if path:
        writers.write(df, path, form)
    else:
        out = csv.writer(sys.stdout)
        out.writerow(df.columns)
        out.writerows(df.toLocalIterator())


def loaded(args) -> list:
    nodes = trees.load(args.config)
    return trees.pruned(nodes, args.only.split("|")) if getattr(args, "only", None) else nodes


def cache_key(args) -> str:
    """Of the stage and the version of the package, of what it reads (path, time and size) and of its parameters."""
    path = Path(args.input)
    facts = [str(path.resolve()), path.stat().st_mtime, path.stat().st_size] if path.exists() else [args.input]
    return hashlib.md5(json.dumps(["prepared", __version__, *facts, args.text, args.preserve_case], sort_keys=True).encode()).hexdigest()


def ready_documents(spark: SparkSession, args) -> DataFrame:
    """Documents with normalized text and common features; kept in the cache folder where the input is a whole file."""
    folder = Path(args.cache) / cache_key(args) if args.cache and args.input != "-" and not args.head else None
    if folder and (folder / "_SUCCESS").exists():
        return spark.read.parquet(str(folder))
    docs = readers.read_documents(spark, args.input, args.text)
    if args.head:
        docs = docs.orderBy("id").limit(args.head)
    docs = plans.prepared(docs, preserve_case=args.preserve_case)
    if folder and not getattr(args, "only", None):
        docs.write.parquet(str(folder), mode="overwrite")
        return spark.read.parquet(str(folder))
    return docs


def resources(spark: SparkSession, args) -> plans.Resources:
    known = hunspell.words(spark, args.hunspell) if getattr(args, "hunspell", None) else None
    return plans.Resources(lexicon.read_lexicons(spark, args.lexicons) if args.lexicons else None, known=known)


def analyze(args) -> None:
    spark, began = session(), time.time()
    table = plans.features(ready_documents(spark, args), loaded(args), resources(spark, args))
    show(table, args.output, args.format)
    if args.stats:
        print(json.dumps({"stage": "analyze", "seconds": round(time.time() - began, 3)}), file=sys.stderr)


def extract(args) -> None:
    spark, nodes = session(), loaded(args)
    docs = ready_documents(spark, args)
    known = resources(spark, args)
    table, found = plans.features(docs, nodes, known, with_parts=True), plans.evidence(docs, nodes, known)
    sources = {n.key: places.source_of(n) for n in trees.post_order(nodes) if places.has_places(n, known)}
    described = {n.key: {"kind": plans.kind(n), "class_name": n.operator} | ({"evidence": {"kind": "text_span", "source": sources[n.key], "unit": "characters"}} if n.key in sources else {}) for n in trees.post_order(nodes)}
    columns = sorted(set(sources.values()) & set(docs.columns))
    lengths = docs.select(F.col("id").alias("__of"), *(F.length(c).alias(f"__n_{c}") for c in columns))
    table = table.join(lengths, F.col("id") == F.col("__of")).drop("__of")
    lines = writers.jsonl_lines(table, described, found, {c: F.col(f"__n_{c}") for c in columns}, numerators=plans.parts_in(table))
    writers.write_jsonl(lines, args.output)


def summarize(args) -> None:
    table = readers.read_features(session(), args.input)
    wide = statistics.summary(table)
    if args.top or args.bottom:
        wide = statistics.ranked(wide, args.by, args.top or args.bottom, bool(args.bottom))
    elif args.zero_only:
        wide = statistics.zero_only(wide)
    elif args.sparse is not None:
        wide = statistics.sparse(wide, args.sparse)
    elif args.long:
        wide = statistics.long_summary(wide)
    show(wide, args.output)


def aggregate(args) -> None:
    spark = session()
    table = readers.read_features(spark, args.input)
    if args.metadata:
        table = statistics.with_metadata(table, readers.read_features(spark, args.metadata), args.id, [args.group])
    show(statistics.summary(table, by=(args.group,)), args.output)


def positions(args) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    meta, docs = readers.read_jsonl(session(), args.input)
    if args.dimension and args.dimension not in meta["dimensions"]:
        raise ValueError(f"{args.input}: dimension {args.dimension} is not declared")
    described = json.loads(meta["dimension_metadata"].get(args.dimension) or "{}") if args.dimension else {}
    of = (described.get("evidence") or {}).get("source", "text_norm")
    spans = readers.spans(meta, docs, [args.dimension] if args.dimension else None)
    lengths = readers.source_lengths(docs, of)
    return meta, docs, E.histogram(spans, lengths, args.segments), lengths


def position(args) -> None:
    """A JSON object for the dimension asked for, an array for all; or a table of segments as CSV."""
    meta, _, found, lengths = positions(args)
    if args.segments < 1:
        raise ValueError("there must be a segment")
    if args.table:
        show(E.corpus_positions(found).orderBy("dimension", "segment"), args.output)
        return
    asked = [args.dimension] if args.dimension else meta["dimensions"]
    rows = [r.asDict() for r in E.position_report(found, lengths, asked, args.segments).collect()]  # a row for each dimension
    rows.sort(key=lambda r: asked.index(r["dimension"]))
    out = json.dumps(rows[0] if args.dimension else rows, ensure_ascii=False, indent=2)
    if args.output:
        Path(args.output).write_text(out + "\n", encoding="utf-8")
    else:
        print(out)


def vectorize(args) -> None:
    """Vectors of the dimension asked for, or of all that are described as having evidence."""
    meta, docs, found, _ = positions(args)
    described = lambda d: json.loads(meta["dimension_metadata"].get(d) or "{}").get("evidence")
    asked = [args.dimension] if args.dimension else [d for d in meta["dimensions"] if described(d)]
    show(E.vectors(readers.wide_values(meta, docs), found, asked, args.segments), args.output)


def inspect(args) -> None:
    """One feature of one text, with what it matched."""
    spark, nodes = session(), trees.pruned(trees.load(args.config), [args.key])
    docs = spark.createDataFrame([(0, args.input, args.input, args.input)], "id bigint, text string, text_raw string, text_norm string")
    known = resources(spark, args)
    value = plans.features(docs, nodes, known).first().asDict()[args.key]
    found = plans.evidence(docs, [n for n in trees.post_order(nodes) if n.key == args.key], known)
    matches = [r.asDict() for r in found.drop("id").orderBy("start", "end").collect()] if found is not None else []
    print(json.dumps({"key": args.key, "value": value, "matches": matches}, ensure_ascii=False, indent=2))


def config(args) -> None:
    nodes = trees.load(args.config)
    if args.action == "validate":
        wrong = trees.problems(nodes)
        print("\n".join(wrong) or "valid")
        sys.exit(bool(wrong))
    print(trees.tree_text(nodes, args.depth) if args.action == "tree" else trees.dump(nodes))


def explain(args) -> None:
    print(json.dumps(trees.explain(trees.load(args.config), args.key), ensure_ascii=False, indent=2))


def cache(args) -> None:
    entries = sorted((p for p in Path(args.cache).glob("*") if p.is_dir()), key=lambda p: -p.stat().st_mtime)
    if args.action in ("clear", "prune"):
        for p in entries if args.action == "clear" else entries[args.keep :]:
            shutil.rmtree(p)
    else:
        print(json.dumps([{"entry": p.name, "bytes": sum(f.stat().st_size for f in p.rglob("*") if f.is_file())} for p in entries]))


def check(args) -> None:
    found = audit(readers.numbered_lines(session(), args.input))
    show(found.withColumn("offenders", F.array_join("offenders", "; ")), None)


def diff(args) -> None:
    spark = session()
    show(statistics.differences(readers.read_features(spark, args.input), readers.read_features(spark, args.other), args.id), None)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *options) -> None:
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        for flags, kwargs in options:
            own.add_argument(*flags, **kwargs)

    def opt(*flags, **kwargs):
        return flags, kwargs

    reading = [opt("input"), opt("--text", default="text"), opt("--head", type=int), opt("--preserve-case", action="store_true"), opt("--cache"), opt("--config", required=True), opt("--only"), opt("--lexicons"), opt("--hunspell", help="path of the .aff and .dic files without their ending")]
    output, segments = opt("--output"), opt("--segments", type=int, default=5)
    command("analyze", analyze, *reading, output, opt("--format"), opt("--stats", action="store_true"))
    command("extract", extract, *reading, opt("--output", required=True))
    command("summarize", summarize, opt("input"), output, opt("--by", default="mean"), opt("--top", type=int), opt("--bottom", type=int), opt("--zero-only", action="store_true"), opt("--sparse", type=float), opt("--long", action="store_true"))
    command("aggregate", aggregate, opt("input"), opt("--group", required=True), opt("--metadata"), opt("--id", default="id"), output)
    command("position", position, opt("input"), opt("--dimension"), opt("--segments", type=int, default=3), opt("--table", action="store_true"), output)
    command("vectorize", vectorize, opt("input"), opt("--dimension"), segments, output)
    command("inspect", inspect, opt("key"), opt("input"), opt("--config", required=True), opt("--lexicons"))
    command("config", config, opt("action", choices=["validate", "tree", "convert"]), opt("config"), opt("--depth", type=int))
    command("explain", explain, opt("key"), opt("--config", required=True))
    command("cache", cache, opt("action", choices=["info", "list", "prune", "clear"]), opt("--cache", required=True), opt("--keep", type=int, default=10))
    command("audit", check, opt("input"))
    command("diff", diff, opt("input"), opt("other"), opt("--id", default="id"))
    return top


if __name__ == "__main__":
    options = parser().parse_args()
    options.run(options)
