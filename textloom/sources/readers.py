"""Document, feature and structured JSON Lines sources."""

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions.text import ensured

VERSIONS = ("1.0", "1.1")
METADATA = "_type string, schema_version string, dimensions array<string>, dimension_metadata map<string, string>"
SPAN_TYPE = "struct<text:string,start:int,end:int>"
DOCUMENT = f"_type string, id string, row bigint, reference_lengths map<string, bigint>, dimensions map<string, string>"
VALUE = f"value double, numerator double, denominator double, evidence array<{SPAN_TYPE}>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, quote='"', escape='"')


READERS = {".csv": read_csv, ".parquet": lambda s, p: s.read.parquet(p), ".json": lambda s, p: s.read.json(p, multiLine=True), ".jsonl": lambda s, p: s.read.json(p), ".ndjson": lambda s, p: s.read.json(p)}


def with_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """df with ids from 0 in the order of its rows, where it has none.

    Rows are numbered within their partitions; a small table of the partitions' sizes gives where each begins.
    """
    if id_col in df.columns:
        return df
    marked = df.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    sizes = marked.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    from pyspark.sql import Window

    base = sizes.select(F.col("__part").alias("__of"), "__first", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    joined = marked.join(F.broadcast(base), F.col("__part") == F.col("__of"))  # a row for each partition
    return joined.select((F.col("__base") + F.col("__at") - F.col("__first")).alias(id_col), *df.columns)


def read_documents(spark: SparkSession, path: str, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """All columns, with text and text_raw (null: empty) and an id."""
    if path == "-":
        return read_stdin(spark, text_col, id_col)
    reader = READERS.get(Path(path.rstrip("/")).suffix)
    if not reader:
        raise ValueError(f"no source reads {path}")
    return documents(reader(spark, path), text_col, id_col)


def documents(df: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    if text_col not in df.columns:
        raise ValueError(f"no column {text_col}")
    return with_ids(df.withColumns({"text": ensured(F.col(text_col)), "text_raw": ensured(F.col(text_col))}), id_col)


def read_stdin(spark: SparkSession, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """CSV with the text column, or else all of it as one document."""
    import csv
    import io

    whole = sys.stdin.read()
    rows = list(csv.DictReader(io.StringIO(whole)))
    if rows and text_col in rows[0] and None not in rows[0]:
        names = [n for n in rows[0] if n]
        schema = Ty.StructType([Ty.StructField(n, Ty.StringType()) for n in names])
        return documents(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema), text_col, id_col)
    return documents(spark.createDataFrame([(0, whole)], f"{id_col} bigint, {text_col} string"), text_col, id_col)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), place (file:line) and value of text files, numbered without a sort of all lines.

    Lines are counted by file and block; where a block begins is the sum of those before it in its file.
    """
    from pyspark.sql import Window

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(F.col("file").alias("of_file"), F.col("block").alias("of_block"), "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    joined = lines.join(base, (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block")))
    line = F.col("before") + F.col("at") - F.col("first") + 1
    return joined.select("file", line.alias("line"), F.concat_ws(":", "file", line).alias("place"), "value")


def check_lines(lines: DataFrame) -> None:
    """Raises an error that names the first line that is no JSON (or repeats a key), is of an unknown record, or stands before the metadata."""
    parsed = F.try_parse_json("value")
    record = F.coalesce(F.try_variant_get(parsed, "$._type", "string"), F.lit(""))
    rows = lines.where(F.trim("value") != "").select("file", "line", F.when(parsed.isNull(), "broken").otherwise(record).alias("record"))
    first = rows.groupBy("record").agg(F.min(F.struct("file", "line")).alias("at"), F.count("*").alias("n")).orderBy("record")
    found = {r.record: r for r in first.limit(100).collect()}  # a row for each kind of record
    said = lambda r: f"{r.at.file}:{r.at.line}"
    if "broken" in found:
        raise ValueError(f"{said(found['broken'])}: no JSON, or a key stands twice")
    for record in found.keys() - {"metadata", "document"}:
        raise ValueError(f"{said(found[record])}: unknown record {record!r}")
    if "metadata" in found and "document" in found and tuple(found["document"].at) < tuple(found["metadata"].at):
        raise ValueError(f"{said(found['document'])}: a document stands before the metadata")


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> tuple[dict, DataFrame]:
    """The metadata record and the documents of structured JSON Lines: id, row, reference_lengths, dimensions (text of each).

    strict also refuses lines that are no JSON or repeat a key, documents before the metadata (all with file and line), unknown
    versions and dimensions that the metadata does not declare.
    """
    if strict:
        check_lines(numbered_lines(spark, path))
    lines = spark.read.text(path).where(F.trim("value") != "")
    kinds = lines.select(F.get_json_object("value", "$._type").alias("kind")).groupBy("kind").count().collect()  # a row for each type
    counts = {r.kind: r["count"] for r in kinds}
    if counts.get("metadata") != 1:
        raise ValueError(f"{path}: {counts.get('metadata', 0)} metadata records instead of one")
    if odd := counts.keys() - {"metadata", "document"}:
        raise ValueError(f"{path}: unknown records {sorted(map(str, odd))}")
    record = lines.where(F.get_json_object("value", "$._type") == "metadata").select(F.from_json("value", METADATA).alias("m")).select("m.*").first()
    if not isinstance(record.dimensions, list) or not record.dimension_metadata and record.dimension_metadata != {}:
        raise ValueError(f"{path}: the metadata lacks dimensions")
    meta = record.asDict()
    docs = lines.where(F.get_json_object("value", "$._type") == "document").select(F.from_json("value", DOCUMENT).alias("d")).select("d.id", "d.row", "d.reference_lengths", "d.dimensions")
    if strict:
        if meta["schema_version"] not in VERSIONS:
            raise ValueError(f"{path}: version {meta['schema_version']}")
        if len(set(meta["dimensions"])) != len(meta["dimensions"]):
            raise ValueError(f"{path}: a dimension is declared twice")
        if strange := docs.select(F.explode(F.map_keys("dimensions")).alias("d")).where(~F.col("d").isin(meta["dimensions"])).limit(1).collect():
            raise ValueError(f"{path}: dimension {strange[0].d} is not declared")
    return meta, docs


def wide_values(meta: dict, docs: DataFrame) -> DataFrame:
    """id and the value of each declared dimension; objects and plain numbers both count, what is none is null."""
    raw = lambda d: F.element_at("dimensions", F.lit(d))
    value = lambda d: F.coalesce(F.get_json_object(raw(d), "$.value"), raw(d)).try_cast("double")
    return docs.select(F.coalesce("id", F.col("row").cast("string")).alias("id"), *(value(d).alias(d) for d in meta["dimensions"]))


def spans(meta: dict, docs: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """id, dimension, start, end and text of the evidence of the documents."""
    names = dimensions or meta["dimensions"]
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), F.from_json(F.element_at("dimensions", F.lit(d)), VALUE)["evidence"].alias("all")) for d in names))
    rows = docs.select(F.coalesce("id", F.col("row").cast("string")).alias("id"), F.explode(each).alias("x")).select("id", "x.dimension", F.explode("x.all").alias("s"))
    return rows.select("id", "dimension", "s.start", "s.end", "s.text")


def source_lengths(docs: DataFrame, source: str) -> DataFrame:
    return docs.select(F.coalesce("id", F.col("row").cast("string")).alias("id"), F.element_at("reference_lengths", F.lit(source)).alias("length"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith((".jsonl", ".ndjson")):
        return wide_values(*read_jsonl(spark, path, strict=False))
    return READERS.get(Path(path.rstrip("/")).suffix, read_csv)(spark, path)
