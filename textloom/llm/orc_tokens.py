"""Token ids as ORC: sorted by document, integer run-length encoded, with row indexes and Bloom filters.

Each file holds an ascending range of document ids, so readers prune files and stripes by their min and max,
row groups by the row index and the Bloom filter on doc_id, and read stripes in parallel.

Cases: the string of a special token in a text is that token, as the library has it; a null text is empty (only the end id is stored); null document ids come first, in one run; repeated
ids keep all their rows, in the order of their texts' hashes; extra columns are ignored; an empty table writes
an empty one.
"""

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries of each of the two generations of a worker's cache of encoded words; words in use move on to the younger one.
CACHE_WORDS = 500_000
#: Files of one table at most, and so rows of the table of their totals.
MAX_PARTS = 200_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 22
#: Rows between two entries of ORC's row index, and with them Bloom filters.
INDEX_ROWS = 2_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    plain, words = Tokenizer.from_file(path), Tokenizer.from_file(path)
    words.encode_special_tokens = True  # words are lowered before they come here, so the string of an added token is only text
    added = [x.content for x in plain.get_added_tokens_decoder().values()]
    return plain, words, added, [{}, {}]


def _core(word: str) -> str:
    """word without closing punctuation, which is a token of its own after a letter."""
    core = word.rstrip(".,;:!?")
    return core if core and len(core) < len(word) and core.lower()[-1].isalpha() else word


def _learn(words: list[str], path: str) -> dict[str, bytes]:
    """The worker's cache (word to its ids as little-endian 32-bit integers), now with all these words."""
    _, tokenizer, _, generations = _tokenizer(path)
    if len(generations[0]) > CACHE_WORDS:
        generations[:] = [{}, generations[0]]
    cache, older = generations
    if older:
        cache.update((w, older[w]) for w in words if w not in cache and w in older)
    parts = {w: (core, w[len(core) :]) for w in words if w not in cache for core in (_core(w),)}
    pieces = [p for p in dict.fromkeys(x for both in parts.values() for x in both if x) if p not in cache]
    cache[""] = b""
    other = []
    for piece in pieces:
        if piece.isascii() and piece.isalpha():  # nothing to normalize or split: the model alone
            cache[piece] = np.asarray([t.id for t in tokenizer.model.tokenize(piece)], dtype="<i4").tobytes()
        else:
            other.append(piece)
    for piece, got in zip(other, tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
        cache[piece] = np.asarray(got.ids, dtype="<i4").tobytes()
    for word, (core, end) in parts.items():
        cache[word] = cache[core] + cache[end]
    return cache


def encode_texts(texts: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array, and where those of each text begin, with the total at the end.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its words in turn;
    each distinct word is encoded once. ASCII letters are lowered first, which the tokenizer does anyway. A text that holds
    the string of an added token goes to the library whole, which finds these before all else.
    """
    texts = pc.fill_null(texts, "")
    plain, _, added, _ = _tokenizer(path)
    special = np.flatnonzero(np.logical_or.reduce([pc.match_substring(texts, x).to_numpy(zero_copy_only=False) for x in added])) if added and len(texts) else []
    whole = {}
    if len(special):
        for row in special.tolist():
            whole[row] = np.asarray(plain.encode(texts[row].as_py(), add_special_tokens=False).ids, dtype="<i4")
        keep = np.ones(len(texts), bool)
        keep[special] = False
        texts = pc.if_else(pa.array(keep), texts, "")
    ids, bounds = _encode_words(texts, path)
    if whole:
        parts = [whole.get(k, ids[bounds[k] : bounds[k + 1]]) for k in range(len(texts))]
        ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    if end_id is not None:
        ids = np.insert(ids, bounds[1:], np.int32(end_id))
        bounds = bounds + np.arange(len(bounds))
    return ids, bounds


def _encode_words(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    begins = words.offsets.to_numpy() - words.offsets[0].as_py()
    coded = words.flatten().dictionary_encode()
    distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    cache = _learn(distinct, path)
    raw = [cache[w] for w in distinct]
    sizes, pool = np.array([len(r) // 4 for r in raw], dtype=np.int64), np.frombuffer(b"".join(raw), dtype="<i4")
    at = np.cumsum(sizes) - sizes
    each = sizes[which]
    ends = np.cumsum(each)
    ids = pool[np.repeat(at[which] - (ends - each), each) + np.arange(int(each.sum()))]
    return ids, np.concatenate([np.zeros(1, np.int64), ends])[begins]


def slices(texts: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Runs of rows whose texts have limit bytes together, a longer text by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    found, begin, total = [], 0, 0
    for row, size in enumerate(sizes):
        if total and total + size > limit:
            found.append((begin, row))
            begin, total = row, 0
        total += size
    return [*found, (begin, len(texts))] if len(texts) else []


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, parts: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write doc_id, part, part_start, n_tokens and ids to path, parts files in ascending order of doc_id.

    part_start counts the ids before the document in its own file; starts() adds those of the files before.
    """
    parts = max(1, min(parts, MAX_PARTS))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    in_order = source.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                rows = batch.slice(begin, end - begin)
                ids, bounds = encode_texts(rows.column("text"), tokenizer_path, end_id)
                columns = [rows.column("doc_id"), pa.array(np.full(end - begin, part, np.int32)), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
                before += len(ids)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "part_start", "n_tokens", "ids"])

    tokens = in_order.mapInArrow(run, "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>")
    writer = tokens.write.option("compression", "zstd").option("orc.create.index", "true").option("orc.row.index.stride", INDEX_ROWS)
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table that write() left; filters on doc_id reach ORC's indexes and Bloom filters."""
    return spark.read.schema("doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>").orc(path)


def starts(tokens: DataFrame) -> DataFrame:
    """tokens with start, the number of ids of all documents before; two levels, so no task orders all documents."""
    sums = tokens.groupBy(F.col("part").alias("of_part")).agg(F.sum("n_tokens").alias("size"))  # a row for each file
    ahead = Window.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("of_part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("base"))
    joined = tokens.join(F.broadcast(base), F.col("part") == F.col("of_part"))  # MAX_PARTS rows at most
    return joined.withColumn("start", F.col("base") + F.col("part_start")).drop("of_part", "base")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (crc32 of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts(tokens).select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
