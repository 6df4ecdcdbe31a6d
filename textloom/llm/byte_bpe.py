"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A text is encoded as tiktoken's encode_ordinary would, special tokens excluded. Long texts are cut first
at boundaries that the splitting pattern (public_tokenizers.PATTERN) can never cross, so that one call never holds
more than a chunk.

A run of 1000 or more white-space characters in a long text is encoded as the one piece that it is, without the pattern.

Cases: a null text counts as empty (no ids); a text of nothing but white space, of any length, is one piece; an id column may be null or repeated, each row is encoded by
itself; other columns of the input are ignored, so clashing names do no harm; an empty table gives an empty one.
"""

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A chunk of a long text has about so many characters, more only where no safe boundary follows.
CHUNK_CHARS = 1 << 16
#: Before white space that follows anything else, the pattern always begins a new piece: no alternative of it
#: holds white space after another character, and what is left of the boundary never looks past it.
SAFE = re.compile(r"(?<=\S)[ \n]")
#: Long runs of white space (what the pattern's \s matches) never meet the pattern, whose matcher recurses over them.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file; one per worker process."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int | None = None) -> Iterator[str]:
    """text in order, cut at the first safe boundary after each size characters."""
    begin, size = 0, size or CHUNK_CHARS
    while len(text) - begin > size:
        cut = SAFE.search(text, begin + size)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """text in order, in chunks for the pattern (false) and long runs of white space that are one piece of it (true).

    The pattern makes one piece of a run that ends the text. Of any other run the last character is left for the
    piece after it.
    """
    begin = 0
    for run in LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((chunk, False) for chunk in chunks(text[begin : run.start()]))
        yield text[run.start() : end], True
        begin = end
    yield from ((chunk, False) for chunk in chunks(text[begin:]))


def encode(text: str | None, ranks_path: str, pattern: str) -> list[int]:
    enc = encoding(ranks_path, pattern)
    if not text:
        return []
    if len(text) <= CHUNK_CHARS:
        return enc.encode_ordinary(text)
    return [i for part, whole in stretches(text) for i in (enc._encode_single_piece(part) if whole else enc.encode_ordinary(part))]


def decode(ids: Iterable[int], ranks_path: str, pattern: str) -> bytes:
    """The raw bytes of ids, which need not be valid UTF-8 for an arbitrary id sequence."""
    return encoding(ranks_path, pattern).decode_bytes(list(ids))


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array<int>) of every text."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            ids = [encode(t, ranks_path, pattern) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    id_type = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and raw (binary), the bytes that the ids stand for; null ids give no bytes."""
    kept = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        for batch in batches:
            raw = [decode(ids or (), ranks_path, pattern) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], ["id", "raw"])

    id_type = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {id_type}, raw binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass, as digests.

    Returns id_col, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the
    decoded bytes) and exact (the decoded bytes are those of the text). Ids never leave the task.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            n, by_id, by_raw, same = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text, ranks_path, pattern)
                raw = decode(ids, ranks_path, pattern)
                n.append(len(ids))
                by_id.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                by_raw.append(hashlib.sha256(raw).hexdigest())
                same.append(raw == (text or "").encode())
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(by_id, pa.string()), pa.array(by_raw, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    id_type = kept.schema["id"].dataType.simpleString()
    out = kept.mapInArrow(run, f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean")
    return out.withColumnRenamed("id", id_col)
