"""Checks of structured JSON Lines: every rule is counted in one pass over the lines, with a few offenders of each, after one that seeks the metadata.

Lines are read as variants, so the kinds of JSON values are known (a string of digits is no number). Offenders are those with
the smallest hashes, so their sample does not grow with the violations.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

VERSIONS = ("1.0", "1.1")
#: Offenders that are shown of each rule.
SHOWN = 3
# The rules in the order of the report.
METADATA_RULES = ("metadata is missing or repeated", "version is unknown", "dimensions are no list", "dimension is declared twice", "dimension has no metadata", "metadata of no dimension", "descriptor is no mapping", "descriptor lacks a field")
LINE_RULES = (
    "line is no JSON", "record is unknown", "identifier is missing", "identifier is repeated", "dimensions are no mapping", "dimension is missing", "dimension is unexpected",
    "lengths are no mapping", "length is no count", "dimension is no mapping", "value is missing", "numerator is no number", "denominator is no number", "evidence is no list", "evidence is missing",
    "numerator is not the number of spans", "length of the source is missing", "span is no mapping", "start is no count", "end is no count", "span ends before it starts", "span ends beyond its text",
)
REPEATED = "identifier is repeated"
NUMBER, COUNT = r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "BIGINT"


def kind(v: Column, path: str = "$") -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a kind of number; null where there is nothing."""
    found = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.regexp_extract(found, r"^[A-Z]+(?:\(.*\))?", 0)


def count_at(v: Column, path: str) -> Column:
    """A whole number that is not negative, or null."""
    number = F.try_variant_get(v, path, "bigint")
    return F.when((F.schema_of_variant(F.try_variant_get(v, path, "variant")) == COUNT) & (number >= 0), number)


def given(v: Column, path: str) -> Column:
    """Whether there is anything, be it null."""
    return F.try_variant_get(v, path, "variant").isNotNull()


def mapping_at(v: Column, path: str = "$") -> Column:
    """The values of a mapping by name, null if it is none; cheaper than kind(), which looks at all that is within."""
    return F.try_variant_get(v, path, "map<string,variant>")


def problem(rule: str, wrong: Column, detail: Column | str = "") -> Column:
    return F.when(wrong, F.struct(F.lit(rule).alias("rule"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")))


def metadata_problems(meta: dict | None) -> list[tuple[str, str]]:
    """(rule, detail) of the one metadata record."""
    if meta is None:
        return [("metadata is missing or repeated", "")]
    found = [] if meta.get("schema_version") in VERSIONS else [("version is unknown", str(meta.get("schema_version")))]
    names, of = meta.get("dimensions"), meta.get("dimension_metadata")
    if not isinstance(names, list):
        return [*found, ("dimensions are no list", "")]
    found += [("dimension is declared twice", d) for k, d in enumerate(names) if d in names[:k]]
    of = of if isinstance(of, dict) else {}
    found += [("dimension has no metadata", d) for d in dict.fromkeys(names) if not isinstance(of.get(d), dict)]
    found += [("metadata of no dimension", d) for d in of if d not in names]
    for d, own in of.items():
        if isinstance(own, dict) and own.get("evidence") is not None:
            if not isinstance(own["evidence"], dict):
                found.append(("descriptor is no mapping", d))
            else:
                found += [("descriptor lacks a field", f"{d}: {f}") for f in ("kind", "source", "unit") if not isinstance(own["evidence"].get(f), str)]
    return found


def of_span(span: Column, length: Column, name: Column) -> Column:
    def checked(x: Column) -> Column:
        return F.array(
            problem("span is no mapping", ~x["mapping"], name),
            problem("start is no count", x["mapping"] & x["start"].isNull(), name),
            problem("end is no count", x["mapping"] & x["end"].isNull(), name),
            problem("span ends before it starts", x["end"] < x["start"], name),
            problem("span ends beyond its text", x["end"] > length, name),
        )

    return let(F.struct(mapping_at(span).isNotNull().alias("mapping"), count_at(span, "$.start").alias("start"), count_at(span, "$.end").alias("end")), checked)


def of_dimension(name: Column, d: Column, lengths: Column, sources: Column, counted: Column) -> Column:
    """The problems of one dimension of a document; lengths: by source, sources: dimension to the source of its evidence, counted: those whose numerators count spans."""
    source = F.try_element_at(sources, name)
    of_source = F.try_element_at(lengths, source)
    facts = F.struct(mapping_at(d).isNotNull().alias("mapping"), F.try_variant_get(d, "$.evidence", "array<variant>").alias("spans"), count_at(of_source, "$").alias("length"))
    numerator = F.try_variant_get(d, "$.numerator", "double")

    def checked(x: Column) -> Column:
        mapping, spans = x["mapping"], x["spans"]
        listed, length = spans.isNotNull(), x["length"]
        bad = lambda path: mapping & ~kind(d, path).rlike(NUMBER) & ~kind(d, path).isin("VOID")
        own = F.array(
            problem("dimension is no mapping", ~mapping & ~kind(d).rlike(NUMBER) & (kind(d) != "VOID"), name),
            problem("value is missing", mapping & ~given(d, "$.value"), name),
            problem("numerator is no number", bad("$.numerator"), name),
            problem("denominator is no number", bad("$.denominator"), name),
            problem("evidence is no list", mapping & given(d, "$.evidence") & ~listed, name),
            problem("evidence is missing", mapping & source.isNotNull() & ~given(d, "$.evidence"), name),
            problem("numerator is not the number of spans", listed & F.array_contains(counted, name) & ~numerator.eqNullSafe(F.size(spans).cast("double")), name),
            problem("length of the source is missing", listed & source.isNotNull() & of_source.isNull(), name),
        )
        return F.concat(own, F.when(listed, F.flatten(F.transform(spans, lambda s: of_span(s, length, name)))).otherwise(F.slice(own, 1, 0)))

    return let(facts, checked)


def line_problems(v: Column, names: list[str], sources: dict[str, str], counted: list[str]) -> Column:
    """All problems of one document line but repeated identifiers."""
    text = "CAST(array() AS array<string>)"
    declared = F.array(*map(F.lit, names)) if names else F.expr(text)
    of = F.create_map(*(F.lit(x) for pair in sources.items() for x in pair)) if sources else F.expr("CAST(map() AS map<string,string>)")
    counts = F.array(*map(F.lit, counted)) if counted else F.expr(text)

    def checked(x: Column) -> Column:
        dims, each = x["dims"], x["lengths"]
        mapping = dims.isNotNull()
        missing, odd = F.array_except(declared, F.map_keys(dims)), F.array_except(F.map_keys(dims), declared)
        own = F.array(
            problem("record is unknown", ~F.coalesce(F.try_variant_get(v, "$._type", "string") == "document", F.lit(False))),
            problem("identifier is missing", F.coalesce(kind(v, "$.id"), F.lit("VOID")).isin("VOID") & F.coalesce(kind(v, "$.row"), F.lit("VOID")).isin("VOID")),
            problem("dimensions are no mapping", ~mapping),
            problem("lengths are no mapping", given(v, "$.reference_lengths") & each.isNull()),
        )
        none = F.slice(own, 1, 0)
        more = [
            F.when(mapping, F.transform(missing, lambda d: F.struct(F.lit("dimension is missing").alias("rule"), d.alias("detail")))).otherwise(none),
            F.when(mapping, F.transform(odd, lambda d: F.struct(F.lit("dimension is unexpected").alias("rule"), d.alias("detail")))).otherwise(none),
            F.when(each.isNotNull(), F.transform(F.map_entries(each), lambda e: problem("length is no count", count_at(e["value"], "$").isNull(), e["key"]))).otherwise(none),
            F.when(mapping, F.flatten(F.transform(F.map_entries(dims), lambda e: of_dimension(e["key"], e["value"], each, of, counts)))).otherwise(none),
        ]
        return F.filter(F.concat(own, *more), lambda p: p.isNotNull())

    return let(F.struct(mapping_at(v, "$.dimensions").alias("dims"), mapping_at(v, "$.reference_lengths").alias("lengths")), checked)


def audit(lines: DataFrame) -> DataFrame:
    """rule, violations and offenders (place and detail of a few) of all rules; lines: place (such as file:line) and value.

    The lines are read twice: for the metadata (only lines that may hold its word are parsed), then for all else.
    """
    # Values are taken inside of generators: a filter on them would be moved into what makes the lines and make each several times.
    full = lambda t: F.trim(t) != ""
    likely = lambda t: full(t) & (t.contains("metadata") | t.contains("\\u"))  # the word as it stands or with an escaped letter
    parsed = F.explode_outer(let(F.col("value"), lambda t: F.when(likely(t), F.array(F.try_parse_json(t))))).alias("v")
    record = lambda v: F.coalesce(F.try_variant_get(v, "$._type", "string") == "metadata", F.lit(False))
    heads = lines.select(parsed).where(record(F.col("v"))).select(F.to_json("v").alias("v")).limit(2).collect()
    meta = json.loads(heads[0].v) if len(heads) == 1 else None
    names = meta["dimensions"] if meta and isinstance(meta.get("dimensions"), list) else []
    of = {d: x["evidence"] for d, x in ((meta or {}).get("dimension_metadata") or {}).items() if isinstance(x, dict) and isinstance(x.get("evidence"), dict)}
    sources = {d: e["source"] for d, e in of.items() if isinstance(e.get("source"), str)}
    counted = [d for d, e in of.items() if e.get("cardinality") == "numerator"]
    broken = F.array(F.struct(F.lit("line is no JSON").alias("rule"), F.lit("").alias("detail")))
    key = lambda v: F.coalesce(F.try_variant_get(v, "$.id", "string"), F.try_variant_get(v, "$.row", "string"))
    identity = lambda v: F.array(F.struct(F.lit(REPEATED).alias("rule"), key(v).alias("detail")))
    of_line = lambda v: F.when(v.isNull(), broken).when(~record(v), F.concat(identity(v), line_problems(v, names, sources, counted)))
    problems_of = let(F.col("value"), lambda t: F.when(full(t), let(F.try_parse_json(t), of_line)))
    found = lines.select("place", F.explode_outer(problems_of).alias("p")).where("p IS NOT NULL").select("place", "p.*")  # each line is parsed once
    # Problems by rule, and by identifier the lines that have it, in one grouping; of identifiers only those of several lines go on.
    repeated = F.col("rule") == REPEATED
    marks = lambda place, detail: [F.struct(F.xxhash64(F.lit(k), place, detail).alias("mark"), place.alias("place"), detail.alias("detail")) for k in range(SHOWN)]
    seen = found.where(~repeated | F.col("detail").isNotNull()).withColumn("of", F.when(repeated, F.col("detail")))
    shown = [F.min(F.when(~repeated, x)).alias(f"x{k}") for k, x in enumerate(marks(F.col("place"), F.col("detail")))]
    each = seen.groupBy("rule", "of").agg(F.count("*").alias("n"), F.min(F.when(repeated, F.col("place"))).alias("first"), *shown).where(~repeated | (F.col("n") > 1))
    again = [F.when(repeated, x).otherwise(F.col(f"x{k}")).alias(f"x{k}") for k, x in enumerate(marks(F.col("first"), F.col("of")))]
    every = each.select("rule", F.when(repeated, F.col("n") - 1).otherwise(F.col("n")).alias("n"), *again)
    own = found.sparkSession.createDataFrame([(r, "metadata", d) for r, d in metadata_problems(meta)], "rule string, place string, detail string")
    every = every.union(own.select("rule", F.lit(1).cast("bigint"), *marks(F.col("place"), F.col("detail"))))
    sums = every.groupBy("rule").agg(F.sum("n").alias("violations"), *(F.min(f"x{k}").alias(f"x{k}") for k in range(SHOWN)))
    offenders = F.array_distinct(F.array(*(F.concat_ws(" ", f"x{k}.place", f"x{k}.detail") for k in range(SHOWN))))
    rules = found.sparkSession.createDataFrame([(r,) for r in (*METADATA_RULES, *LINE_RULES)], "of_rule string")
    joined = F.broadcast(rules).join(sums, F.col("of_rule") == F.col("rule"), "left")  # a row for each rule
    none = F.expr("CAST(array() AS array<string>)")
    return joined.select(F.col("of_rule").alias("rule"), F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"), F.when(F.col("violations").isNotNull(), offenders).otherwise(none).alias("offenders"))
