"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes at most ``TRAIN_ROWS`` labelled texts of at most ``TRAIN_CHARS``
characters, those whose ids hash lowest. For each hashed n-gram the log ratio of
its smoothed document counts in the two classes is computed; n-grams whose
ratio is small or within chance are left out; a logistic regression is fitted to the binary
features times their ratios. Scoring looks up one small table for every n-gram
of every whole text and adds up each distinct hit once.

Edge cases: null and empty texts have no features and score the model's bias;
rows without a label are not learnt from; without both classes every score is
0.5 (predicted 0); very long texts are scored whole; a score equal to the
threshold counts as toxic; repeated rows are kept; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import chunks, tidy, trim, trimmed

TRAIN_ROWS, TRAIN_CHARS = 6_000, 20_000
BUCKET_BITS, ORDERS = 20, (4, 5, 7)
LEAST_RATIO, LEAST_Z, ALPHA, L2, STEPS = 1.0, 3.0, 0.5, 1e-5, 300
#: Weight of a toxic row: toxic texts are the rarer class.
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.7
_SALT = {n: 0x9E3779B1 + 0x5851F42C * (n - 4) & 0xFFFFFFFF | 1 for n in range(3, 10)}


class Model(NamedTuple):
    """``slot``: each bucket's place in ``weight``, or -1."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float


def grams(texts: list[str], order: int, pad: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character n-gram of the lower-cased texts, framed by spaces, and where each text ends."""
    low = [f" {t.lower()} " if pad else t for t in texts]
    raw = "".join(low)
    if raw.isascii():
        code = np.frombuffer(raw.encode(), dtype=np.uint8).astype(np.uint32)
    else:
        code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    if len(code) < order:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    n = len(code) - order + 1
    h = np.zeros(n, dtype=np.uint32)
    for k in range(order):
        h *= np.uint32(0x01000193)
        h += code[k : k + n]
    h *= np.uint32(_SALT[order])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(32 - BUCKET_BITS)
    return h, np.cumsum(size)


def _owned(at: np.ndarray, end: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of each position, and which n-grams stay within their text."""
    own = np.searchsorted(end, at, side="right")
    return own, at + order <= end[own]


def distinct_hits(texts: list[str], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) pairs, each once, of n-grams that have a slot."""
    found = [np.zeros(0, dtype=np.int64)]
    for a, z in chunks(texts):
        some = []
        for order in ORDERS:
            h, end = grams(texts[a:z], order)
            at = np.flatnonzero(slot[h] >= 0)
            own, inside = _owned(at, end, order)
            some.append(((own[inside] + a) << 32) | slot[h[at[inside]]].astype(np.int64))
        found.append(np.unique(np.concatenate(some)))  # a text lies in one chunk, so repeats go before chunks add up
    pairs = np.concatenate(found)
    return pairs >> 32, pairs & 0xFFFFFFFF


def fit(texts: list[str], labels: np.ndarray) -> Model:
    labels = np.asarray(labels, dtype=np.float64)
    everything = np.arange(1 << BUCKET_BITS, dtype=np.int64)
    none = Model(np.full(1 << BUCKET_BITS, -1, dtype=np.int32), np.zeros(0), 0.0)
    if not len(texts) or labels.min() == labels.max():
        return none
    count = np.zeros((2, 1 << BUCKET_BITS))
    for a in range(0, len(texts), 50):  # counts first, so that the sample's n-grams are never all held
        doc, bucket = distinct_hits(texts[a : a + 50], everything)
        for y in (0, 1):
            count[y] += np.bincount(bucket[labels[a : a + 50][doc] == y], minlength=1 << BUCKET_BITS)
    share = (count + ALPHA) / (count + ALPHA).sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    sure = np.abs(ratio) / np.sqrt((1 / (count + ALPHA)).sum(axis=0))
    keep = np.flatnonzero((np.abs(ratio) >= LEAST_RATIO) & (sure >= LEAST_Z))
    slot = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
    slot[keep] = np.arange(len(keep))
    doc, feature = distinct_hits(texts, slot)
    x = ratio[keep][feature] / np.abs(ratio[keep]).max(initial=1.0)
    w, b = np.zeros(len(keep)), float(np.log(labels.mean() / (1 - labels.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share_of = np.where(labels > 0, TOXIC_WEIGHT, 1.0)
    share_of /= share_of.sum()
    for step in range(1, STEPS + 1):  # Adam over all rows
        z = np.bincount(doc, weights=w[feature] * x, minlength=len(texts)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) * share_of
        g, gb = np.bincount(feature, weights=err[doc] * x, minlength=len(keep)) + L2 * w, err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = 0.05 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= scale * m / (np.sqrt(v) + 1e-9)
        b -= scale * mb / (np.sqrt(vb) + 1e-9)
    return Model(slot, w * ratio[keep] / np.abs(ratio[keep]).max(initial=1.0), b)


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    doc, feature = distinct_hits(texts, model.slot)
    z = np.bincount(doc, weights=model.weight[feature], minlength=len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows of (doc_id, text) and (doc_id, toxic)."""
    few = labels.select(F.col("doc_id").alias("_id"), "toxic").filter(F.col("toxic").isNotNull() & F.col("_id").isNotNull())
    few = few.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= TRAIN_CHARS)
    got = texts.join(F.broadcast(few), texts["doc_id"] == few["_id"]).select("doc_id", "text", "toxic").limit(rows).toPandas()
    got = got.sort_values(["doc_id", "text"])
    texts, toxic = got["text"].tolist(), got["toxic"].to_numpy()
    del got
    try:
        return fit(texts, toxic)
    finally:
        del texts, toxic
        trim()  # the driver outlives the training by far


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            if texts:
                yield pa.record_batch([b.column(0), pa.array(score_texts(texts, shared.value), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the rows that score below ``threshold``.

    A null or empty text scores the model's bias, a score equal to the
    threshold is rejected, repeated rows get one verdict, extra columns are
    kept whatever their names, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @trimmed
    def score(text: pa.Array) -> pa.Array:
        some = (text.slice(at, 500) for at in range(0, len(text), 500))
        return pa.array(np.concatenate([np.zeros(0), *(score_texts([x or "" for x in t.to_pylist()], shared.value) for t in some)]))

    return docs.filter(score(F.col("text")) < threshold)


def held_out(fold: int, of: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(1, 3)))
    return score_documents(docs, model).select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
