"""Tables of the operators and joins that they share; the folder that driver and executors share is that of sources."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores behind as it takes to be no column of df (case aside)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


#: Rows up to which a table is broadcast.
FEW = 200_000


def sized(facts: DataFrame) -> DataFrame:
    """facts (few columns of fixed width), to be broadcast if it has FEW rows at most; beyond, the join decides for itself."""
    return F.broadcast(facts) if facts.count() <= FEW else facts


#: Keys that each hold over one HOT-th of the rows are HOT at most.
HOT = 1_000


def met(rows: DataFrame, facts: DataFrame, key: str, of_key: str, hot: Column) -> DataFrame:
    """rows joined with facts, which has one row for each of_key; hot tells which keys hold over one HOT-th of the rows.

    Rows of hot keys meet their facts, HOT at most, by broadcast and stay where they are; all others meet by shuffle.
    """
    few = facts.where(hot)
    by_broadcast = rows.join(F.broadcast(few), F.col(key) == F.col(of_key))
    others = rows.join(F.broadcast(few.select(of_key)), F.col(key) == F.col(of_key), "left_anti")
    return by_broadcast.unionByName(others.join(facts.where(~hot), F.col(key) == F.col(of_key)))


def without(docs: DataFrame, keys: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose doc_id and text hash are not in keys(doc_id, text_hash), all their columns as they are."""
    at_id, at_hash = free(docs, "__id", "__hash")
    gone = keys.select(F.col("doc_id").alias(at_id), F.col("text_hash").alias(at_hash)).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(F.col(at_id)) & (F.xxhash64(docs[text_col]) == F.col(at_hash)), "left_anti")
