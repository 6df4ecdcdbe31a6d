"""The thin queries opN_<name>, with the DuckDB SQL of those that SQL can express."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, decontaminate, edit_counts, license_scan, line_align, orc_tokens, pii, quality, quality_model, simhash, spelling, warc
from .storage import fresh_path, table

#: Texts of one file in the ORC output, in rows of the table.
ORC_ROWS = 8_000
END_ID = 2
#: The key of the pseudonyms; a deployment passes its own secret.
KEY = "test-key"


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct("__replaced.kind")), ",")
    return found.select("doc_id", "text", F.size("__replaced").cast("bigint").alias("n_replaced"), kinds.alias("kinds"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "warc")
    index = warc.write_archives(table(spark, sf_dir, "pages"), root)
    facts = warc.payload_facts(warc.read_records(index, root))
    return facts.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_line_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_align.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256")
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_deleted").alias("n_deleted"), F.col("__words_deleted").alias("words_deleted"), digest)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after each run of four digits or more is masked and a line is appended."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    built, masked = edit_counts.trees(table(spark, sf_dir, "documents"), ranks, pattern), edit_counts.masking("[0-9]{4,}", "<number>")
    found = edit_counts.edited(built, ranks, pattern, lambda text: [*masked(text), (len(text), 0, "\nEnd of document.")])
    return found.select("doc_id", "n_before", "n_after", F.length("text").cast("bigint").alias("n_chars_after"), "reencoded")


def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "tokens")
    parts = max(1, docs.count() // ORC_ROWS)
    orc_tokens.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), END_ID, parts)
    return orc_tokens.digests(orc_tokens.read(spark, path))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(table(spark, sf_dir, "documents"))


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_tokens", "matched", "score", "doc_start")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs, n_words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.scores(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op12_spelling_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_feistel_pii": op1_feistel_pii,
    "op2_warc_index": op2_warc_index,
    "op3_line_align": op3_line_align,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_edit_counts": op6_edit_counts,
    "op7_orc_tokens": op7_orc_tokens,
    "op8_license_scan": op8_license_scan,
    "op9_spaced_seeds": op9_spaced_seeds,
    "op10_simhash": op10_simhash,
    "op11_quality_model": op11_quality_model,
    "op12_spelling_bands": op12_spelling_bands,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL = {
    "op9_spaced_seeds": decontaminate.ORACLE_SQL,
    "op12_spelling_bands": spelling.ORACLE_SQL,
    "op13_centroids": centroids.ORACLE_SQL,
    "op5_quality_rules": quality.ORACLE_SQL,
    "op2_warc_index": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN g ON payload_digest = d""",
}
