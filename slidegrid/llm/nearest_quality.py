"""Quality by the vote of nearest neighbours in a latent-semantic space.

Training takes at most ``TRAIN_ROWS`` labelled texts of at most ``TRAIN_CHARS``
characters, those whose ids hash lowest. Each text becomes the tf-idf weights of
its hashed character n-grams (digits alike, upper case kept apart) and the shares
of its n-grams by frequency; a truncated singular value decomposition maps
these to ``DIMS`` dimensions. The labelled vectors, whose number and width are
fixed by these parameters, go to the tasks. There every whole text is mapped
likewise and its cosines with all labelled vectors are computed as one matrix
product a block of texts, exactly. The
``NEIGHBOURS`` nearest, with all that tie with the last of them, vote with
their label, weighted by a power of their similarity.

Edge cases: a null or empty text has no features and gets the share of label 1
in training; so does a text that is like none of the labelled ones; without
labelled rows every score is 0.5; very long texts are counted piece by piece,
whole; ties all vote, similarities within ``TIE`` count as equal; rows without
a label or an id are not learnt from; repeated rows are kept; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import tidy

TRAIN_ROWS, TRAIN_CHARS = 5_000, 20_000
BUCKET_BITS, ORDERS, DIMS = 12, (1, 2, 3), 64
OCTAVES, SHAPE = 16, 0.3
NEIGHBOURS, POWER, TIE = 15, 16, 1e-5
THRESHOLD = 0.3
#: Texts of one matrix product, and characters of one piece of a text.
BLOCK, PIECE = 128, 1 << 18


class Model(NamedTuple):
    """``base``: (features, dims); ``vectors``: unit rows; ``labels``: 0 or 1; ``prior``: for texts without a vote."""

    idf: np.ndarray
    base: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def count_grams(text: str) -> np.ndarray:
    """How often each bucket of the text's character n-grams occurs."""
    total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    longest = max(ORDERS)
    for begin in range(0, len(text), PIECE):
        # a piece brings the characters with which its last n-grams end
        piece = text[begin : begin + PIECE + longest - 1]
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.where((code >= 48) & (code <= 57), np.uint32(48), code)
        for order in ORDERS:
            n = min(PIECE, len(code) - order + 1)
            if n <= 0:
                continue
            h = np.full(n, order, dtype=np.uint32)
            for k in range(order):
                h *= np.uint32(0x01000193)
                h += code[k : k + n]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h >>= np.uint32(32 - BUCKET_BITS)
            total += np.bincount(h, minlength=1 << BUCKET_BITS)
    return total


def weights(texts: list[str], idf: np.ndarray | None = None) -> np.ndarray:
    """Unit rows: damped counts of the n-grams, and how much of the text falls to n-grams of each octave of frequency.

    The second part, of share ``SHAPE``, tells texts that say one thing over
    and over from prose, whatever their language.
    """
    size = 1 << BUCKET_BITS
    out = np.zeros((len(texts), size + OCTAVES), dtype=np.float32)
    for i, t in enumerate(texts):
        n = count_grams(t)
        seen = np.flatnonzero(n)
        if len(seen):
            share = n[seen] / n.sum()
            out[i, seen] = np.log1p(n[seen])
            out[i, size:] = np.sqrt(np.bincount(np.minimum(-np.log2(share), OCTAVES - 1).astype(np.int64), weights=share, minlength=OCTAVES))
    if idf is not None:
        out[:, :size] = unit(out[:, :size] * idf) * np.float32(np.sqrt(1 - SHAPE))
        out[:, size:] *= np.float32(np.sqrt(SHAPE))
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 1e-9)


def principal(x: np.ndarray, dims: int, passes: int = 6) -> np.ndarray:
    """The leading right singular vectors of ``x``, as columns, by subspace iteration from fixed random ones."""
    q = np.random.default_rng(5).standard_normal((x.shape[1], dims + 16)).astype(np.float32)
    for _ in range(passes):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :dims]


def fit(texts: list[str], labels: np.ndarray) -> Model:
    labels = np.asarray(labels, dtype=np.float32)
    if not len(texts):
        return Model(np.ones(1 << BUCKET_BITS, np.float32), np.zeros((OCTAVES + (1 << BUCKET_BITS), 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    blocks = [texts[a : a + BLOCK] for a in range(0, len(texts), BLOCK)]
    held = sum((weights(b)[:, : 1 << BUCKET_BITS] > 0).sum(axis=0, dtype=np.int64) for b in blocks)
    idf = np.log((1 + len(texts)) / (1 + held)).astype(np.float32) + 1
    x = np.concatenate([weights(b, idf) for b in blocks])
    base = principal(x, min(DIMS, len(x)))
    return Model(idf, base, unit(x @ base), labels, float(labels.mean(dtype=np.float64)))


def vote(cosines: np.ndarray, labels: np.ndarray, prior: float) -> np.ndarray:
    """The weighted vote of each row's nearest neighbours; the rarer label's count for more, by the root of its rarity."""
    k = min(NEIGHBOURS, cosines.shape[1])
    if not k:
        return np.full(len(cosines), prior)
    last = np.partition(cosines, -k, axis=1)[:, -k]
    w = np.where(cosines >= last[:, None] - TIE, np.maximum(cosines, 0), 0).astype(np.float64) ** POWER
    if 0 < prior < 1:
        w *= np.where(labels > 0, 1 / np.sqrt(prior), 1 / np.sqrt(1 - prior))
    total = w.sum(axis=1)
    return np.divide(w @ labels, total, out=np.full(len(cosines), prior), where=total > 1e-12)


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    out = np.zeros(len(texts))
    for a in range(0, len(texts), BLOCK):
        rows = unit(weights(texts[a : a + BLOCK], model.idf) @ model.base)
        out[a : a + BLOCK] = vote(rows @ model.vectors.T, model.labels, model.prior)
    return np.clip(out.round(6), 0, 1)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows of (doc_id, text) and (doc_id, quality)."""
    order = ["_h", "_id", "quality"]
    few = labels.select(F.xxhash64("doc_id").alias("_h"), F.col("doc_id").alias("_id"), "quality").dropna().orderBy(*order).limit(rows)
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= TRAIN_CHARS)
    got = texts.join(F.broadcast(few), "_id").orderBy(*order, "text").limit(rows).select("text", "quality").toPandas()
    return fit(got["text"].tolist(), got["quality"].to_numpy())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                texts = [x or "" for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(score_texts(texts, shared.value), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def held_out(fold: int, of: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(0, 5)))
    return score_documents(docs, model).select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
