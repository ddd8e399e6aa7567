"""The corpus pipeline stage by stage against plain Python versions, each on what the stage before it kept."""

import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from slidegrid.llm import pii, suffix_dedup, toxicity
from slidegrid.llm.text import materialize

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = {"a b": 1, "x.y:z`q": "k", "_cut": 2, "_row": 3, "_new": 4, "root": 5}


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows of the input, rows of the output) of each stage; the input has columns of odd names."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    # rows that share an id, repeated rows, null and empty texts, no id
    more = docs.limit(3).withColumn("text", F.lit("other words under an id that is taken"))
    null = docs.limit(2).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(9001).cast("long")})
    none = docs.limit(1).withColumns({"text": F.lit(""), "doc_id": F.lit(None).cast("long")})
    docs = materialize(docs.unionByName(more).unionByName(docs.limit(4)).unionByName(null).unionByName(none), "start")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, DATA), name)
        if name != "packing":
            assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        out[name] = docs, after
        docs = after
    return out


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.text is None) for r in df.select("doc_id", "text").collect())


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "pii", "packing"]


def plain_scores(texts, learnt, labels):
    """The classifier with a dictionary of features a text and no vectors."""
    def features(t):
        chars = " " + t.lower() + " "
        return {(n, chars[i : i + n]) for n in toxicity.ORDERS for i in range(len(chars) - n + 1)}

    model = toxicity.fit(learnt, np.array(labels))
    slot = lambda n, g: model.slot[int(toxicity.grams([g], n, pad=False)[0][0])]
    out = []
    for t in texts:
        hit = {int(slot(n, g)) for n, g in features(t)} - {-1}
        out.append(1 / (1 + math.exp(-max(-60, min(60, model.bias + sum(float(model.weight[k]) for k in hit))))))
    return out


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    all_rows = rows(before)
    learnt = [(i, t) for i, t, _ in all_rows if i in labels and len(t) <= toxicity.TRAIN_CHARS]
    score = plain_scores([t for _, t, _ in all_rows], [t for _, t in learnt], [labels[i] for i, _ in learnt])
    sure = [(r, s) for r, s in zip(all_rows, score, strict=True) if abs(s - 0.7) > 1e-6]
    assert Counter(rows(after)) == Counter(r for r, s in sure if s < 0.7) and len(sure) == len(all_rows)


def test_ngram_join(stages):
    before, after = stages["ngram_join"]

    def shingles(t):
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {r: shingles(r[1]) for r in rows(before)}
    named = [r for r in sets if sets[r] and r[0] >= 0]
    root = {r: r for r in named}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(named):
        for b in named[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    members = defaultdict(list)
    for r in named:
        members[find(r)].append(r)
    got, count = Counter(rows(after)), Counter(rows(before))
    for group in members.values():  # the least id of a group stays, once
        stay = [r for r in group if got[r]]
        assert len(stay) == 1 and got[stay[0]] == 1 and stay[0][0] == min(r[0] for r in group)
    for r in set(sets) - set(named):
        assert got[r] == (count[r] if r[0] < 0 else 1)


def test_suffix_dedup(stages):
    before, after = stages["suffix_dedup"]
    texts, held = defaultdict(set), Counter()
    for i, t, _ in rows(before):
        texts[i].add(t)
    first, want = {}, Counter()
    for i, t, null in sorted(rows(before)):
        w = WORDS.findall(t)
        for k in range(len(w) - 49):
            if i >= 0:
                first.setdefault(tuple(w[k : k + 50]), i)
    for i, t, null in rows(before):
        spans, cut = list(WORDS.finditer(t)), set()
        if i >= 0 and len(texts[i]) == 1:
            for k in range(len(spans) - 49):
                if first[tuple(m[0] for m in spans[k : k + 50])] < i:
                    cut |= set(range(k, k + 50))
        left = [k for k in range(len(spans)) if k not in cut]
        if cut and len(left) < 10:
            continue
        if cut:
            head = t[: spans[0].start()] if 0 not in cut else ""
            t = head + "".join(t[spans[k].start() : spans[k + 1].start() if k + 1 < len(spans) else len(t)] for k in left)
        want[i, t, null] += 1
    assert Counter(rows(after)) == want


def test_texts_are_cut_once(stages):
    # each call of a Python function in a plan takes a worker of its own beside the others of its task
    before, _ = stages["suffix_dedup"]
    plan = suffix_dedup.cut_copies(before)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_pii(stages):
    before, after = stages["pii"]
    model = pii.train(before)
    assert model is not None
    want = Counter()
    for i, t, null in rows(before):
        base, more = plain_spans(t, model)
        out, at = [], 0
        for s, k, e in sorted(base + more):
            if s >= at:
                out += [t[at:s], f"<{pii.KINDS[k]}>"]
            at = max(at, e)
        want[i, "".join([*out, t[at:]]), null] += 1
    assert Counter(rows(after)) == want


def plain_spans(t, model):
    """Windows one by one, each character labelled by the window in whose middle it lies deepest."""
    base, label, deep = pii.base_spans(t), {}, {}
    for s in range(0, max(1, len(t) - pii.SHARED), pii.SPAN - pii.SHARED) if t else ():
        part = pii.codes(t[s : s + pii.SPAN])
        code = np.zeros((1, -(-len(part) // pii.PAD) * pii.PAD), dtype=np.uint8)
        code[0, : len(part)] = part
        for k, tag in enumerate(pii.decode(model, code)[0, : len(part)].tolist()):
            d = min(k if s else len(t), len(part) - 1 - k if s + len(part) < len(t) else len(t))
            if d > deep.get(s + k, -1):
                label[s + k], deep[s + k] = tag, d
    more, p = [], 0
    while p < len(t):
        if tag := label.get(p, 0):
            kind, q = (tag - 1) // 2, p + 1
            while label.get(q, 0) == 2 + 2 * kind:
                q += 1
            if not any(p < z and a < q for a, _, z in base) and pii.sound(kind, t[p:q]):
                more.append((p, kind, q))
            p = q
        else:
            p += 1
    return base, more


def test_packing(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want, seqs = Counter(), defaultdict(list)
    for i, x, _ in rows(before):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], dtype="<u4")
        for s in range(0, len(ids), 2048):
            want[i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += 1
    got = Counter()
    for r in after.collect():
        got[-1 if r.doc_id is None else r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        seqs[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
