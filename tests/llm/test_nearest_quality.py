"""Neighbour voting against a plain version, held-out accuracy and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid.llm import nearest_quality as nq

DATA = "/root/testdata/sf0.001"
GOOD = ["The house on the hill is old and {} people live in it, though few know why.", "A letter came in spring, and {} of us read it aloud by the fire.", "Rain fell on the {} fields while we walked home along the river."]
BAD = ["BUY!! NOW!! {} CHEAP!! CLICK!! HERE!!", "win*** win*** {} win*** cash### free$$$", "a | b | c | {} | d | e | f |"]


def bucket(gram):
    h = len(gram)
    for c in gram:
        c = 48 if "0" <= c <= "9" else ord(c)
        h = (h * 0x01000193 + c) & 0xFFFFFFFF
    h ^= h >> 15
    return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - nq.BUCKET_BITS)


def features(text, idf):
    n = Counter(bucket(text[i : i + k]) for k in nq.ORDERS for i in range(len(text) - k + 1))
    out = np.zeros((1 << nq.BUCKET_BITS) + nq.OCTAVES)
    total = sum(n.values())
    for b, m in n.items():
        out[b] = math.log1p(m) * idf[b]
    length = math.sqrt((out**2).sum()) or 1.0
    out *= math.sqrt(1 - nq.SHAPE) / length
    for m in n.values():
        out[(1 << nq.BUCKET_BITS) + min(int(-math.log2(m / total)), nq.OCTAVES - 1)] += m / total
    out[1 << nq.BUCKET_BITS :] = np.sqrt(out[1 << nq.BUCKET_BITS :]) * math.sqrt(nq.SHAPE)
    return out


def plain_score(text, model):
    """Every cosine one by one, sorted, the nearest and all ties with the last of them."""
    v = features(text, model.idf) @ model.base
    size = math.sqrt(v @ v)
    if not len(model.labels) or size < 1e-9:
        return model.prior
    near = sorted(((float(v @ w) / size, int(y)) for w, y in zip(model.vectors, model.labels)), reverse=True)
    last = near[min(nq.NEIGHBOURS, len(near)) - 1][0]
    weight = {0: 0.0, 1: 0.0}
    for c, y in near:
        if c >= last - nq.TIE and c > 0:
            weight[y] += c**nq.POWER / math.sqrt(model.prior if y else 1 - model.prior)
    total = weight[0] + weight[1]
    return weight[1] / total if total > 1e-12 else model.prior


@pytest.fixture(scope="module")
def model():
    texts = [t.format(f"{i} x{i}") for i in range(60) for t in (*GOOD, BAD[i % 3])]
    return nq.fit(texts, np.array([int(k % 4 < 3) for k in range(len(texts))]))


def test_matches_the_plain_version(model, monkeypatch):
    texts = [t.format(f"{i * 37} é日🙂") for i in range(8) for t in GOOD + BAD] + ["", "a", "ab", "1234 5678", " " * 50, "long text " * 3_000]
    got = nq.score_texts(texts, model)
    assert got == pytest.approx([plain_score(t, model) for t in texts], abs=2e-4)
    monkeypatch.setattr(nq, "PIECE", 7)  # pieces do not lose or repeat an n-gram
    assert (nq.score_texts(texts[:20], model) == got[:20]).all()


def test_tells_good_from_bad(model):
    good, bad = nq.score_texts([t.format("some new") for t in GOOD], model), nq.score_texts([t.format("SOME NEW") for t in BAD], model)
    assert (good >= nq.THRESHOLD).all() and (bad < nq.THRESHOLD).all()
    assert nq.score_texts([""], model)[0] == pytest.approx(model.prior)


def test_labels_in_part_or_not_at_all():
    assert nq.score_texts(["x", ""], nq.fit([], np.zeros(0))).tolist() == [0.5, 0.5]
    one = nq.fit(["some text"], np.ones(1))
    assert nq.score_texts(["some text", ""], one).tolist() == [1.0, 1.0]
    assert nq.score_texts(["x"], nq.fit(["", ""], np.array([1, 0])))[0] == 0.5


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id at all"), (5, "é 日本 🙂 \x00 x"), (6, "long " * 60_000), (7, " \n\t")]


def test_odd_rows_and_empty_tables(spark, model):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit("x"), "quality": F.lit(7)})
    got = nq.score_documents(docs, model).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (i for i, _ in ODD)))
    assert {round(r.score, 6) for r in got if r.doc_id in (1, 2)} == {round(model.prior, 6)}
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert nq.score_documents(docs.limit(0), model).collect() == []
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    assert len(nq.train(docs, labels).labels) == 5  # text of id 1, and both rows of id 3 with both labels
    assert len(nq.train(docs, labels, 2).labels) <= 2
    assert nq.train(docs.limit(0), labels).prior == nq.train(docs, labels.limit(0)).prior == 0.5


def test_query_learns_only_from_its_fold(spark):
    got = {r.doc_id: r for r in nq.query(spark, DATA).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.quality is not None}
    out = {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert got.keys() == docs.keys() and {i for i, r in got.items() if r.held_out} == out
    learnt = [i for i in docs if i in known and i not in out and len(docs[i]) <= nq.TRAIN_CHARS]
    m = nq.fit([docs[i] for i in learnt], np.array([known[i] for i in learnt]))
    assert m.prior == pytest.approx(nq.train(*(spark.createDataFrame([(i, x[i]) for i in learnt], f"doc_id long, {c}") for x, c in ((docs, "text string"), (known, "quality int")))).prior)
    for r in got.values():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= nq.THRESHOLD)
    held = [i for i in out if i in known]
    assert sum(got[i].predicted == known[i] for i in held) >= 0.8 * len(held)
