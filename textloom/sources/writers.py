"""Sinks by format, and structured JSON Lines with evidence."""

import json
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRITERS = {
    "csv": lambda df, path: df.write.csv(path, header=True, mode="overwrite"),
    "json": lambda df, path: df.write.json(path, mode="overwrite", ignoreNullFields=False),
    "jsonl": lambda df, path: df.write.json(path, mode="overwrite", ignoreNullFields=False),
    "parquet": lambda df, path: df.write.parquet(path, mode="overwrite"),
}


def write(df: DataFrame, path: str, form: str | None = None) -> None:
    """Write a folder of part files in the format that is named or that the path ends in."""
    form = (form or Path(path.rstrip("/")).suffix.lstrip(".")).lower()
    if form not in WRITERS:
        raise ValueError(f"no sink writes {form or path}")
    WRITERS[form](df, path)


def finite(value: Column) -> Column:
    """Null for what JSON cannot hold."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def metadata_line(dimensions: dict[str, dict]) -> str:
    record = {"_type": "metadata", "schema_version": "1.1", "dimensions": list(dimensions), "dimension_metadata": dimensions}
    return json.dumps(record, ensure_ascii=False, separators=(",", ":"))


def jsonl_lines(features: DataFrame, dimensions: dict[str, dict], evidence: DataFrame | None = None, lengths: dict[str, Column] | None = None, id_col: str = "id", numerators: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """place (0 for the metadata, 1 for documents) and value, the lines of the file.

    evidence: id, dimension, start, end, text; lengths: source to the column that holds its length.
    """
    table = features
    if evidence is not None:
        ordered = F.array_sort(F.collect_list(F.struct("start", "end", "text")))
        per = evidence.groupBy(F.col("id").alias("__of"), "dimension").agg(F.transform(ordered, lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
        maps = per.groupBy("__of").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "spans"))).alias("__spans"))
        table = table.join(maps, F.col(id_col) == F.col("__of"), "left")

    def entry(name: str) -> Column:
        found = [finite(F.col(f"`{name}`")).alias("value")]
        if numerators and name in numerators:
            found += [finite(c).alias(k) for c, k in zip(numerators[name], ("numerator", "denominator"), strict=True)]
        if evidence is not None and "evidence" in dimensions[name]:
            none = F.expr("CAST(array() AS array<struct<text:string,start:int,end:int>>)")
            found.append(F.coalesce(F.element_at("__spans", F.lit(name)), none).alias("evidence"))
        return F.struct(*found).alias(name)

    own = [F.lit("document").alias("_type"), F.col(id_col).alias("id")]
    if lengths:
        own.append(F.struct(*(c.alias(k) for k, c in lengths.items())).alias("reference_lengths"))
    body = F.to_json(F.struct(*own, F.struct(*map(entry, dimensions)).alias("dimensions")), {"ignoreNullFields": "false"})
    head = features.sparkSession.createDataFrame([(0, metadata_line(dimensions))], "place int, value string")
    return head.union(table.select(F.lit(1), body))


def write_jsonl(lines: DataFrame, path: str) -> None:
    """A folder of text parts, the first of which begins with the metadata."""
    lines.repartitionByRange("place", "value").sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)


def merged(folder: str, target: str) -> None:
    """The parts of a local folder in one file, in order."""
    with open(target, "wb") as out:
        for part in sorted(Path(folder).glob("part-*")):
            with open(part, "rb") as source:
                shutil.copyfileobj(source, out)
