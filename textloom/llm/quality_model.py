"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are n-grams of one to three words, and of the words' shapes (runs of capitals, small letters and digits as one
sign each, other characters as they are, and whether one of the three words before is the same), hashed to 2 ** BITS places.
An n-gram's value is its share of the n-grams of its kind, so the score of a text is one sparse dot product: the sum of the
mean weights of the six kinds, whatever the text's length. Neither labels nor doc_id, lang or source are inputs of a score.

Learned are at most MAX_SAMPLE labelled documents, those with the smallest hashes of their ids, in that order. Their
features are made in parallel and written; each epoch is one pass of one task over them, with constant memory (two numbers for
each place), as the updates follow one another. Per-place learning rates and the l1 term leave most weights at zero.

Cases: null and empty texts have no n-grams, their score is that of the bias; a null doc_id is held out and never learned from;
of a repeated id the text with the smallest hash is learned, and every row is scored; documents with labels that contradict
each other, and labels but 0 and 1, are not learned from. Without labels of both kinds all scores are 0.5. Extra columns are
ignored; an empty table gives an empty result.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Labelled documents that are learned from, at most.
MAX_SAMPLE = 8_000
BITS, MOST_WORDS, BACK = 18, 3, 3
#: Parameters of the updates: step size, its offset, l1 and l2 terms, passes.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 0.1, 0.001, 0.01, 4
#: Words of a task's table of hashes; beyond it the table starts anew.
KNOWN = 500_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def shape(word: str) -> str:
    signs = ("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    out: list[str] = []
    for sign in signs:
        if not out or out[-1] != sign:
            out.append(sign)
    return "".join(out)


class Words(dict):
    """The place of each word in the table of the hashes of words and shapes, learned as they come."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.empty((1 << 12, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        if place == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[place] = xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(shape(word.decode()).encode(), 2)
        return place


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def ngrams(text: str | None, known: Words) -> list[np.ndarray]:
    """The places of all n-grams of a text, an array for each kind that it has."""
    if len(known) > KNOWN:
        known.clear()
    words = (text or "").encode().split()  # bytes: at \x20 and \x09-\x0D alone
    if not words:
        return []
    at = np.fromiter((known[w] for w in words), np.int64, len(words))
    hashes = known.table[at]
    plain, shapes = hashes[:, 0], hashes[:, 1].copy()
    for back in range(BACK, 0, -1):
        again = np.flatnonzero(at[back:] == at[:-back]) + back if len(at) > back else at[:0]
        shapes[again] = _mixed(shapes[again] + np.uint64(back))
    found = []
    for kind, single in enumerate((plain, shapes)):
        now = single
        for n in range(1, min(MOST_WORDS, len(words)) + 1):
            if n > 1:
                now = _mixed(now[:-1] * _B + single[n - 1 :])
            found.append((_mixed(now + np.uint64(10 * kind + n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return found


def vector(kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their values."""
    if not kinds:
        return np.zeros(0, np.int64), np.zeros(0)
    places, at = np.unique(np.concatenate(kinds), return_inverse=True)
    return places, np.bincount(at, np.concatenate([np.full(len(k), 1.0 / len(k)) for k in kinds]))


def chance(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(margin, -500.0, 500.0))))


def weights(z: np.ndarray, n: np.ndarray, l1: float = L1, l2: float = L2) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))


def learn(z: np.ndarray, n: np.ndarray, places: np.ndarray, values: np.ndarray, label: int) -> None:
    """One update of the state (z, n), whose last place is the bias, which has no l1 and l2 terms."""
    now, bias = weights(z[places], n[places]), float(weights(z[-1:], n[-1:], 0.0, 0.0)[0])
    off = chance(float(now @ values) + bias) - label
    for at, slope, old in ((places, off * values, now), (slice(-1, None), np.array([off]), np.array([bias]))):
        step = (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / ALPHA
        z[at] += slope - step * old
        n[at] += slope * slope


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """place, label, places and values of the documents to learn from; written."""
    own = labels.select(F.col(id_col).cast("bigint").alias("of"), F.col(label_col).cast("int").alias("label")).where("of IS NOT NULL AND label IN (0, 1)")
    agreed = own.where(~held_out(F.col("of"))).groupBy("of").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    chosen = agreed.select("of", "label", F.xxhash64("of").alias("place")).orderBy("place", "of").limit(most)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("of"))  # most rows
    one = texts.groupBy("of", "place", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        known = Words()
        for batch in batches:
            found = [vector(ngrams(t, known)) for t in batch.column("text").to_pylist()]
            columns = [pa.array([p for p, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("of"), batch.column("label"), *columns], ["place", "of", "label", "places", "values"])

    return written(one.mapInArrow(run, "place bigint, of bigint, label int, places array<int>, values array<double>"), "learned")


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """The model of at most MAX_SAMPLE labelled documents."""
    rows = sample(docs, labels, **options)
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return Model(np.zeros(1 << BITS), 0.0)
    in_order = rows.repartition(1).sortWithinPartitions("place", "of")  # a bounded sample, in the order of its updates
    state = np.zeros((2, (1 << BITS) + 1)).tobytes()
    for _ in range(EPOCHS):

        def run(batches, state=state):
            z, n = np.frombuffer(state).reshape(2, -1).copy()
            for batch in batches:
                for i in range(batch.num_rows):
                    learn(z, n, batch.column("places")[i].values.to_numpy(), batch.column("values")[i].values.to_numpy(), batch.column("label")[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([z, n]).tobytes()], pa.binary())], ["state"])

        state = bytes(in_order.mapInArrow(run, "state binary").first().state)  # 2 ** BITS pairs of numbers
    z, n = np.frombuffer(state).reshape(2, -1)
    return Model(weights(z[:-1], n[:-1]), float(weights(z[-1:], n[-1:], 0.0, 0.0)[0]))


def margin(text: str | None, model: Model, known: Words) -> float:
    return sum((float(model.weights[kind].mean()) for kind in ngrams(text, known)), model.bias)


def scores(docs: DataFrame, model: Model, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (that a text is of quality 1) and predicted of every row."""

    def run(batches):
        known = Words()
        for batch in batches:
            found = [chance(margin(t, model, known)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))
