"""Fill-in-middle against a plain version, exact restoration and odd rows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from slidegrid.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(ident, text, seed=42, percent=50, spm=80):
    """(n, form, output) by the rule, word for word."""
    t = text or ""
    units = UNIT.findall(t)
    h = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", t
    return (n, "spm", f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < spm else (n, "psm", f"<P>{x}<S>{z}<M>{y}")


ODD = [None, "", "one", " lead and trail \n\t", " \n\t", "é 日本 🙂 \x00 x", "a <P> b", "x<S", "< < <P < M>", "<", "a<\n<S> b", "$1 \\2 $ \\", "(?s) {2} [a]", "x" * 200_000, "long text " * 30_000, "  no break wide", "\x1f\x0b\x0c\r\n"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_matches_the_plain_version_and_restores(spark):
    rng = random.Random(7)
    some = ["".join(rng.choice(["a", "bé", "🙂", " ", "\n", "\t ", "$", "\\", "<", "<P", "S>", "日"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(ODD * 6 + some)] + [(None, "no id at all"), (3, "one"), (3, "one")]
    for percent, spm in ((50, 80), (100, 0), (100, 100), (0, 50)):
        made = fim.transform(frame(spark, rows), percent=percent, spm_percent=spm)
        got = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n, r.form, r.output) == plain_version(r.doc_id, r.text, 42, percent, spm)
            assert r.back == (r.text or "")


def test_digest_columns(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 8)]
    for r in fim.digest(fim.transform(frame(spark, rows))).collect():
        n, form, out = plain_version(r.doc_id, dict(rows)[r.doc_id])
        assert (r.n, r.form, r.output_sha256) == (n, form, hashlib.sha256(out.encode()).hexdigest())
        assert r.restored_sha256 == hashlib.sha256((dict(rows)[r.doc_id] or "").encode()).hexdigest()
        assert (r.prefix_chars is None) == (r.middle_chars is None) == (form == "plain")


def test_other_columns_and_empty_tables(spark):
    docs = frame(spark, [(1, "a b c")]).withColumns({"n": F.lit("x"), "form": F.lit(1), "a.b": F.lit(2), "_x": F.lit(3)})
    row = fim.transform(docs, percent=100).collect()[0].asDict()
    assert (row["a.b"], row["_x"], row["n"]) == (2, 3, 3)
    assert fim.transform(docs.limit(0)).collect() == []


def test_own_markers(spark):
    m = fim.Markers("$pre\\", "[suf]", "(mid)")
    rows = [(i, f"word{i} and {i} more words") for i in range(40)]
    for r in fim.transform(frame(spark, rows), percent=100, spm_percent=50, markers=m).withColumn("back", fim.restore(F.col("output"), F.col("form"), m)).collect():
        assert r.back == r.text and all(x in r.output for x in m)
