"""Merkle manifests against a plain tree, over several fan-outs, depths and sizes."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from slidegrid.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def tree(nodes, fanout):
    """Root, and each node's siblings by level as (left, right)."""
    paths, owner, now = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(now) > 1:
        runs = [list(range(i, min(i + fanout, len(now)))) for i in range(0, len(now), fanout)]
        for run in runs:
            for j in run:
                for i in owner[j]:
                    paths[i].append(("".join(now[k] for k in run if k < j), "".join(now[k] for k in run if k > j)))
        owner, now = [[i for j in run for i in owner[j]] for run in runs], [H("".join(now[j] for j in run)) for run in runs]
    return now[0], paths


def plain_version(rows, fanout=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for k in names:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        subs[k] = tree([leaf_of(r) for r in groups[k]], fanout)
    root, over = tree([subs[k][0] for k in names], fanout) if names else (None, [])
    out = []
    for k, above in zip(names, over, strict=True):
        for r, path in zip(groups[k], subs[k][1], strict=True):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf_of(r, 1 if hit else 0)
            for a, b in path + above:
                node = H(a + node + b)
            out.append((r["doc_id"], leaf_of(r), subs[k][0], root, H("".join(a + b for a, b in path + above)), node, node == root))
    return sorted(out, key=repr)


def made(spark, rows, **how):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.verify(merkle.manifest(df.withColumns({"node": F.lit("x"), "tree": F.lit(1), "idx": F.lit(2)}), changed={"n_chars": more}, **how))
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.collect()), key=repr)


def row(i, lang, text="some text", source="s", n=9):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n}


ODD = [row(1, None, None, None, None), row(2, "", ""), row(3, "en", "one"), row(3, "en", "one"), row(3, "en", "another"), row(None, "en"), row(None, None, n=None), row(6, "é", "long " * 30_000), row(7, "日本", "é 🙂 \x00"), row(-8, "en", n=2**63 - 2)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 9, 17, 70])
def test_one_group(spark, n):
    rows = [row(i * 3 - 20, "en", f"text {i}") for i in range(n)]
    assert made(spark, rows, depth=2) == plain_version(rows)


@pytest.mark.parametrize(("fanout", "depth"), [(2, 3), (3, 2), (16, 1), (2, 8)])
def test_groups_and_shapes(spark, fanout, depth):
    rows = ODD + [row(100 + i, f"l{i % 11}" if i % 3 else "hot", f"text {i}") for i in range(150)]
    got = made(spark, rows, fanout=fanout, depth=depth)
    assert got == plain_version(rows, fanout)
    assert {v for *_, v in got} == {True, False}


def test_a_changed_row_changes_the_root(spark):
    rows = [row(i, "en") for i in range(20)]
    roots = {made(spark, [*rows[:k], row(k, "en", "changed"), *rows[k + 1 :]], depth=2)[0][3] for k in (0, 7, 19)}
    assert len(roots) == 3
