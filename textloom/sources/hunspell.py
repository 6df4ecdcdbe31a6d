"""Hunspell dictionaries (.aff and .dic) as a table of words.

The affix file is small and becomes a table of rules; stems join the rules of their flags, conditions are patterns, and prefixes
meet suffixed forms where both allow it. Suffixes may carry flags of their own, for one more suffix. The words are made by joins and
never pass the driver. Cases: lines that are no entries are left out; a flag without rules adds nothing; forms that are forbidden are no
words, a stem that needs an affix is none by itself, and one for compounds only is left out.
"""

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of an affix file, at most; they are broadcast.
MAX_RULES = 200_000
RULES = "kind string, of_flag string, cross boolean, strip string, add string, condition string, more string"


@dataclass
class Affixes:
    rules: list[tuple]
    charset: str = "UTF-8"
    flag: str = "char"
    aliases: list[str] = field(default_factory=list)
    special: dict[str, str] = field(default_factory=dict)


def content(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_affixes(spark: SparkSession, path: str) -> Affixes:
    """The rules and options of an affix file."""
    raw = bytes(content(spark, path).first().content)
    charset = re.search(rb"^SET\s+(\S+)", raw, re.MULTILINE)
    found = Affixes([], {"microsoft-cp1251": "windows-1251"}.get(x := charset[1].decode() if charset else "ISO-8859-1", x))
    crossed: dict[tuple, bool] = {}
    for line in raw.decode(found.charset).lstrip("﻿").splitlines():
        words = line.split()
        if len(words) < 2 or words[0].startswith("#"):
            continue
        if words[0] == "FLAG":
            found.flag = words[1].lower()
        elif words[0] == "AF":
            found.aliases.append(words[1])
        elif words[0] in ("NEEDAFFIX", "PSEUDOROOT", "FORBIDDENWORD", "ONLYINCOMPOUND"):
            found.special[words[0].replace("PSEUDOROOT", "NEEDAFFIX")] = words[1]
        elif words[0] in ("PFX", "SFX") and len(words) >= 4:
            if (words[0], words[1]) not in crossed:  # the head of a class: whether it crosses, and how many rules it has
                crossed[words[0], words[1]] = words[2] == "Y"
                continue
            add, _, more = words[3].partition("/")
            condition = re.sub(r"(?<=[^\[])-(?=[^\]]*\])", r"\-", words[4]) if len(words) > 4 else "."
            pattern = f"^(?:{condition})" if words[0] == "PFX" else f"(?:{condition})$"
            found.rules.append((words[0], words[1], crossed[words[0], words[1]], words[2].replace("0", "") if words[2] == "0" else words[2], "" if add == "0" else add, pattern, more))
    found.aliases = found.aliases[1:]  # the first tells how many there are
    if len(found.rules) > MAX_RULES:
        raise ValueError(f"{path}: over {MAX_RULES} affix rules")
    return found


def flags(text: Column, affixes: Affixes) -> Column:
    """The flags of a field as an array; by number where the file has aliases."""
    if affixes.aliases:
        table = F.create_map(*(F.lit(x) for k, a in enumerate(affixes.aliases, 1) for x in (str(k), a)))
        text = F.coalesce(F.try_element_at(table, text), text)
    if affixes.flag == "num":
        return F.array_remove(F.split(text, ","), "")
    return F.regexp_extract_all(text, F.lit("(?s).." if affixes.flag == "long" else "(?s)."), F.lit(0))


def affixed(stems: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """word, flags (of the rule), base (flags of the stem) and cross of all forms that rules of a kind make of stems(word, flags, base)."""
    each = stems.select("word", "base", F.explode(F.array_distinct("flags")).alias("flag"))
    own = rules.where(F.col("kind") == kind)
    met = each.join(F.broadcast(own), (F.col("flag") == F.col("of_flag")) & F.rlike(F.col("word"), F.col("condition")))  # MAX_RULES at most
    size = F.length("word") - F.length("strip")
    if kind == "PFX":
        kept, made = F.col("word").startswith(F.col("strip")), F.concat("add", F.right("word", size))
    else:
        kept, made = F.col("word").endswith(F.col("strip")), F.concat(F.substring("word", F.lit(1), size), "add")
    return met.where(kept & (size > 0)).select(made.alias("word"), F.col("own").alias("flags"), "base", "cross")


def words(spark: SparkSession, path: str) -> DataFrame:
    """word: all forms of the dictionary path.dic by the affixes of path.aff, each once."""
    affixes = read_affixes(spark, f"{path}.aff")
    rules = spark.createDataFrame(affixes.rules, RULES).withColumn("own", flags(F.col("more"), affixes))

    def decoded(batches):  # Spark's decode() knows few of the charsets of dictionaries
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([line for file in batch.column("content").to_pylist() for line in file.decode(affixes.charset).splitlines()], pa.string())], ["line"])

    lines = content(spark, f"{path}.dic").mapInArrow(decoded, "line string").where(~F.col("line").rlike(r"^\s*(?:\d+\s*|#.*)?$"))
    entry = r"^((?:\\/|[^/\t])+?)(?:/(\S+))?(?:\s+\w\w:.*|\t.*|\s*)$"
    parsed = lines.repartition("line").select(F.regexp_extract("line", entry, 1).alias("word"), flags(F.regexp_extract("line", entry, 2), affixes).alias("flags"))
    stems = parsed.where("word <> ''").select(F.replace("word", F.lit("\\/"), F.lit("/")).alias("word"), "flags", F.col("flags").alias("base"))
    has = lambda c, name: F.array_contains(c, affixes.special[name]) if name in affixes.special else F.lit(False)
    usable = stems.where(~has("flags", "ONLYINCOMPOUND") & ~has("flags", "FORBIDDENWORD"))
    once = affixed(usable, rules, "SFX")
    twice = affixed(once.select("word", "flags", "base"), rules, "SFX")
    suffixed = once.union(twice)
    crossing = suffixed.where("cross").select("word", F.array_union("base", "flags").alias("flags"), "base")
    both = affixed(crossing, rules, "PFX").where("cross")
    forms = usable.where(~has("flags", "NEEDAFFIX")).select("word").union(suffixed.where(~has("flags", "NEEDAFFIX")).select("word")).union(affixed(usable, rules, "PFX").select("word")).union(both.select("word"))
    found = forms.distinct()
    if "FORBIDDENWORD" in affixes.special:
        found = found.join(stems.where(has("flags", "FORBIDDENWORD")).select("word").distinct(), "word", "left_anti")
    return found
