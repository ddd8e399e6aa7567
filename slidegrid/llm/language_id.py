"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts bigrams and trigrams of code points into ``BUCKETS`` buckets for
each language, over every row it may learn from; counts are summed by Spark. The
log-probability matrix, whose size is fixed by buckets and languages, goes to
the tasks, which score blocks of texts by gathering the matrix rows of the
n-grams that occur and adding them up text by text.

Edge cases: a text without a letter, or null, is ``und`` with score 1; ties go
to the language first in name order; without any training row all is ``und``;
very long texts are counted whole; repeated rows are kept; an empty table gives
no rows; extra columns are ignored. The matrix has a column for each language
that occurs in training, of which there are as many as distinct ``lang`` values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import chunks

BUCKETS, ORDERS, ALPHA = 1 << 15, (2, 3), 0.5
UNKNOWN = "und"
_EASY = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_EASY.search(text)) or any(map(str.isalpha, text))


def gram_buckets(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each lower-cased text, framed by spaces, and where each text's grams begin."""
    pad = " " * (order - 1)
    low = [pad[:1] + t.lower() + pad for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = np.zeros(len(code), dtype=np.uint64)
    for k in range(order):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h[: len(code) - k] += code[k:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9 + 2 * order)
    h >>= np.uint64(64 - BUCKETS.bit_length() + 1)
    end = np.cumsum([len(t) for t in low])
    begin = np.concatenate(([0], end[:-1]))
    for k in range(order - 1):  # grams that would cross into the next text
        h[end - 1 - k] = BUCKETS
    return h.astype(np.int64), begin


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their matrix (buckets and one empty row, languages), from (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = [x or "" for x in b.column(0).to_pylist()], b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = seen.setdefault(lang, np.zeros((len(ORDERS), BUCKETS + 1), dtype=np.int64))
                for a, z in chunks(own):
                    for k, order in enumerate(ORDERS):
                        total[k] += np.bincount(gram_buckets(own[a:z], order)[0], minlength=BUCKETS + 1)
            yield from ()
        for lang, total in seen.items():
            for k in range(len(ORDERS)):
                at = np.flatnonzero(total[k, :BUCKETS])
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at + k * BUCKETS, pa.int64()), pa.array(total[k, at], pa.int64())], ["lang", "bucket", "n"])

    sums = rows.select("text", "lang").filter(F.col("lang").isNotNull()).mapInArrow(count, "lang string, bucket long, n long")
    got = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    matrix = np.zeros((len(ORDERS), BUCKETS + 1, len(langs)))
    where = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    matrix[got["bucket"] // BUCKETS, got["bucket"] % BUCKETS, where] = got["n"]
    for k in range(len(ORDERS)):
        m = matrix[k, :BUCKETS] + ALPHA
        matrix[k, :BUCKETS] = np.log(m / m.sum(axis=0))
    return langs, matrix.astype(np.float32)


def score(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text (rows) in each language."""
    out = np.zeros((len(texts), matrix.shape[2]))
    for a, z in chunks(texts):
        for k, order in enumerate(ORDERS):
            h, begin = gram_buckets(texts[a:z], order)
            out[a:z] += np.add.reduceat(matrix[k].take(h, axis=0), begin, axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            known = np.array([bool(langs) and has_letter(t) for t in texts])
            best, sure = np.full(len(texts), -1), np.ones(len(texts))
            if known.any():
                s = score([t for t, k in zip(texts, known, strict=True) if k], model.value)
                best[known] = s.argmax(axis=1)
                sure[known] = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.record_batch([b.column(0), pa.array([langs[i] if i >= 0 else UNKNOWN for i in best], pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(fold: int, of: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, *train(docs.filter(~held_out(0, 5)).select("text", "lang")))
    return out.select("doc_id", held_out(0, 5).alias("held_out"), "lang_pred", "score")
