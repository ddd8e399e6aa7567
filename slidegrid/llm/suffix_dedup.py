"""Sparse suffix-array deduplication of word passages.

Only suffixes that start at a minimiser are kept: of every ``MIN_WORDS - K + 1``
consecutive K-word grams the one that hashes lowest. Two documents that share
``MIN_WORDS`` words in a row share a minimiser within them. Keys of minimisers
that lie in one document only are dropped early, by counts summed in blocks.
The remaining suffixes carry the words beside them and are

1. compared with the least suffix of their key, the leader;
2. where a suffix of a key matches its leader too little, all suffixes of that
   key are sorted over the whole cluster, once by the words to the right and
   once by those to the left, and neighbours from different documents compared;
3. of such a key, and of any other with two suffixes whose contexts leave that
   of the leader, all windows of ``MIN_WORDS`` words that hold its gram are
   hashed, and the two smallest documents of each hash are its holders, so that
   neither an order of the suffixes nor the leader hides a smaller document.

A match is extended left and right; it counts from ``MIN_WORDS`` words on. A
word is a copy if a match ties it to a document with a smaller id, so the
smallest document keeps each passage.

Edge cases: words are split at ``[\\x20\\x09-\\x0D]`` and compared exactly; null,
empty and short texts have no passages; rows that repeat a doc_id and text are
one document; rows without a doc_id are left alone; very long texts are read
whole; of documents that tie in a passage the smallest doc_id keeps it; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import Scratch, byte_column, chunks, column, materialize, mix, shared_dir, split_by_ids, tidy, trimmed, window_hashes, with_text, word_hashes

MIN_WORDS, K, FLUSH = 50, 16, 400_000
#: Keys with more suffixes than this are spread over the cluster by window.
LARGE = 2000
SIDE = MIN_WORDS - K
_KEY = np.dtype([("key", "<i8"), ("doc", "<i8"), ("last", "<i8"), ("pos", "<i4")])
_HOLD = np.dtype([("window", "<i8"), ("doc", "<i8")])


def minimisers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of the minimisers of one text's word hashes."""
    g = window_hashes(h, K)
    w = SIDE + 1
    if len(g) < w:
        return np.zeros(0, dtype=np.int64), g[:0]
    at = np.unique(np.lib.stride_tricks.sliding_window_view(g, w).argmin(axis=1) + np.arange(len(g) - w + 1))
    return at, g[at]


def _hashed(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    for a, z in chunks(texts):
        h, first, _, _ = word_hashes(texts[a:z], lower=False)
        for i in range(z - a):
            yield a + i, h[first[i] : first[i + 1]]


def _sampled(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).to_pylist(), byte_column(b.column(1))
            rows = []
            for i, h in _hashed(texts):
                at, key = minimisers(h)
                if len(at) and keys[i] is not None:
                    rows.append((keys[i], at.astype("<i4").tobytes(), key.tobytes()))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "pos", "keys"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, pos binary, keys binary")


def _least_of_key(x: np.ndarray) -> np.ndarray:
    """One row for each key: its least (doc, pos) and its largest doc."""
    x = x[np.lexsort((x["pos"], x["doc"], x["key"]))]
    edge = np.flatnonzero(np.diff(x["key"], prepend=x["key"][:1] ^ 1))
    out = x[edge]
    out["last"] = np.maximum.reduceat(x["last"], edge)
    return out


def repeated_keys(sampled: DataFrame) -> DataFrame:
    """(key, leader_doc, leader_pos) of keys in two or more documents."""
    n = 4 * int(sampled.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(held):
        x = _least_of_key(np.concatenate(held))
        bucket = (x["key"].view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(n + 1))
        some = np.flatnonzero(np.diff(edge)).tolist()
        return pa.record_batch([pa.array(some, pa.int32()), pa.array([x[order[edge[b] : edge[b + 1]]].tobytes() for b in some], pa.binary())], ["bucket", "rows"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, pos, keys in zip(*[c.to_pylist() for c in b.columns], strict=True):
                x = np.empty(len(pos) // 4, dtype=_KEY)
                x["key"], x["doc"], x["last"], x["pos"] = np.frombuffer(keys, "<i8"), doc, doc, np.frombuffer(pos, "<i4")
                held.append(x)
                size += len(x)
                if size > FLUSH:
                    yield emit(held)
                    held, size = [], 0
        if size:
            yield emit(held)

    def close(parts):
        x = _least_of_key(np.frombuffer(b"".join(parts), dtype=_KEY))
        x = x[x["last"] != x["doc"]]
        return pa.record_batch([pa.array(x["key"]), pa.array(x["doc"]), pa.array(x["pos"])], ["key", "leader_doc", "leader_pos"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for bucket, rows in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if bucket != now and parts:
                    yield close(parts)
                    parts = []
                now = bucket
                parts.append(rows)
        if parts:
            yield close(parts)

    sent = sampled.mapInArrow(tidy(send), "bucket int, rows binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(add), "key long, leader_doc long, leader_pos int")


def _exploded(sampled: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = [np.frombuffer(p, "<i4") for p in b.column(1).to_pylist()]
            keys = [np.frombuffer(k, "<i8") for k in b.column(2).to_pylist()]
            if pos:
                doc = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(p) for p in pos])
                yield pa.record_batch([pa.array(doc), pa.array(np.concatenate(pos)), pa.array(np.concatenate(keys))], ["doc_id", "pos", "key"])

    return sampled.mapInArrow(tidy(run), "doc_id long, pos int, key long")


_CONTEXT = "key long, doc_id long, pos int, right binary, left binary, leads boolean"


def _contexts(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Marked suffixes with the hashed words beside their gram, nearest word first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, marks = b.column(0).to_pylist(), byte_column(b.column(1)), b.column(2).to_pylist()
            out: list[tuple] = []
            for i, h in _hashed(texts):
                g = window_hashes(h, K).view(np.int64)
                w = (h >> np.uint64(32)).astype(">u4")
                for m in marks[i]:
                    p = m["pos"]
                    if p < len(g) and g[p] == m["key"]:
                        out.append((m["key"], ids[i], p, w[p + K : p + K + SIDE].tobytes(), w[max(0, p - SIDE) : p][::-1].tobytes(), m["leads"]))
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    def batch(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_())
        return pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["key", "doc_id", "pos", "right", "left", "leads"])

    by_doc = marked.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "key", "leads")).alias("marks"))
    met = docs.select("doc_id", "text").join(by_doc, "doc_id").select("doc_id", "text", "marks")
    return met.mapInArrow(tidy(run), _CONTEXT).dropDuplicates(["key", "doc_id", "pos"])


def _common(x: bytes, y: bytes) -> int:
    """Words that two contexts share from their near end."""
    n = min(len(x), len(y)) // 4
    if x[: 4 * n] == y[: 4 * n]:
        return n
    a, b = np.frombuffer(x, "<u4", n), np.frombuffer(y, "<u4", n)
    return int((a != b).argmax())


_SPAN = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("other", pa.int64()), ("key", pa.int64()), ("short", pa.bool_()), ("apart", pa.bool_())])
_SPAN_SQL = "doc_id long, pos int, start int, end int, other long, key long, short boolean, apart boolean"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SPAN)], schema=_SPAN)


def _match(doc, pos, right, left, doc2, pos2, right2, left2, key) -> list[tuple]:
    """Spans for both sides of a match of enough words, else none."""
    if doc == doc2:
        return []
    r, el = _common(right, right2), _common(left, left2)
    if r + el + K < MIN_WORDS:
        return []
    return [(doc, pos, pos - el, pos + K + r, doc2, key, False, False), (doc2, pos2, pos2 - el, pos2 + K + r, doc, key, False, False)]


def _with_leader(contexts: DataFrame) -> DataFrame:
    """Matches with the leader of each key.

    ``apart`` rows name suffixes whose context leaves that of the leader, or
    that lie in its document; those without a match are ``short`` too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, lead = [], {}
            for key, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                spans = _match(*row, key)
                if not spans:
                    out.append((row[0], row[1], 0, 0, row[4], key, True, True))
                    continue
                out.append(spans[0])
                d, p, s, e, o, *_ = spans[1]
                if 4 * (e - s - K) < len(row[2]) + len(row[3]):
                    out.append((row[0], row[1], 0, 0, row[4], key, False, True))
                if (at := lead.get((d, p))) is None:
                    lead[d, p] = [s, e, o, key]
                else:  # a leader's spans all hold its gram, so their union is one span
                    at[:3] = min(at[0], s), max(at[1], e), min(at[2], o)
            yield _batch([*out, *((d, p, s, e, o, k, False, False) for (d, p), (s, e, o, k) in lead.items())])

    lead = contexts.filter("leads").select("key", *[F.col(c).alias(f"l_{c}") for c in ("doc_id", "pos", "right", "left")])
    met = contexts.filter("NOT leads").join(lead, "key")
    return met.select("key", "doc_id", "pos", "right", "left", "l_doc_id", "l_pos", "l_right", "l_left").mapInArrow(tidy(run), _SPAN_SQL)


def _neighbours(contexts: DataFrame, side: str) -> DataFrame:
    """Matches of neighbours from different documents in the suffix order of one side."""
    order = ["key", side, "doc_id", "pos"]
    columns = ["key", "doc_id", "pos", "right", "left"]
    edge_schema = "key long, doc_id long, pos int, right binary, left binary"

    def spans(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = other = None  # the row before, and the last one of another document than that
        for row in rows:
            key, doc, pos, right, left = row
            if last is not None and last[0] != key:
                last = other = None
            if last is not None:
                before = last if last[1] != doc else other
                if before is not None:
                    yield from _match(doc, pos, right, left, *before[1:], key)
            if last is not None and last[1] != doc:
                other = last
            last = row

    def walk(batches: Iterator[pa.RecordBatch], edges: list | None = None) -> Iterator[pa.RecordBatch]:
        def rows():
            first, last = None, None
            for b in batches:
                for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    first, last = first or row, row
                    yield row
            if edges is not None and first is not None:
                edges.extend([first] if first is last else [first, last])

        out = []
        for s in spans(rows()):
            out.append(s)
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in batches:
            if b.num_rows:
                first = first or b.slice(0, 1).to_pylist()[0]
                last = b.slice(b.num_rows - 1, 1).to_pylist()[0]
        rows = [] if first is None else [first] if first == last else [first, last]
        yield pa.Table.from_pylist(rows, pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("right", pa.binary()), ("left", pa.binary())])).combine_chunks().to_batches()[0] if rows else pa.record_batch([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())], columns)

    ranged = contexts.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize_sorted(ranged)
    inner = ranged.mapInArrow(tidy(walk), _SPAN_SQL)
    # two rows of each partition: the neighbours across its borders
    border = ranged.mapInArrow(tidy(ends), edge_schema).repartition(1).sortWithinPartitions(*order)
    return inner.unionByName(border.mapInArrow(tidy(walk), _SPAN_SQL))


def materialize_sorted(df: DataFrame) -> DataFrame:
    """Cut into reliable files, one for each partition, in the same order."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _windows(key: np.ndarray, right: list[bytes], left: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, words left of the gram, hash) of the windows of MIN_WORDS words that hold the gram of each suffix."""
    words = np.empty((len(key), 2 * SIDE), dtype=np.uint64)
    for part, side in ((words[:, SIDE - 1 :: -1], left), (words[:, SIDE:], right)):
        part[:] = np.frombuffer(b"".join(x.ljust(4 * SIDE, b"\0") for x in side), ">u4").reshape(-1, SIDE)
    h, at = np.zeros((len(key), SIDE + 1), dtype=np.uint64), np.arange(SIDE + 1)
    for k in range(SIDE):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[:, k : k + SIDE + 1]
    h = mix(h + mix(key.view(np.uint64)[:, None] + at.astype(np.uint64)))
    size = [np.fromiter((len(x) // 4 for x in side), np.int64, len(key))[:, None] for side in (left, right)]
    row, j = np.nonzero((SIDE - at <= size[0]) & (at <= size[1]))
    return row, SIDE - j, h[row, j].view(np.int64)


def _two_holders(x: np.ndarray) -> np.ndarray:
    """The rows of the two smallest documents of each window."""
    x = x[np.lexsort((x["doc"], x["window"]))]
    other = np.diff(x["window"], prepend=x["window"][:1] ^ 1) != 0
    keep = other | (np.diff(x["doc"], prepend=x["doc"][:1]) != 0)
    x, other = x[keep], other[keep]
    return x[other | np.append(False, other[:-1])]


def _window_parts(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...]) -> Iterator[tuple]:
    """For some thousand suffixes at a time: (words left of the gram, hash, values of ``columns``) of their windows."""
    for b in batches:
        for a in range(0, b.num_rows, 4096):
            c = b.slice(a, 4096)
            row, words, h = _windows(c.column(0).to_numpy(zero_copy_only=False), c.column(1).to_pylist(), c.column(2).to_pylist())
            yield words, h, *(c.column(k).to_numpy(zero_copy_only=False)[row] for k in columns)


def repeated_windows(suffixes: DataFrame) -> DataFrame:
    """(window, first, second): the two smallest documents of windows in two or more."""
    n = 4 * int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(held):
        x = _two_holders(np.concatenate(held))
        bucket = (x["window"].view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        edge = np.searchsorted(bucket[order := np.argsort(bucket, kind="stable")], np.arange(n + 1))
        some = np.flatnonzero(np.diff(edge)).tolist()
        return pa.record_batch([pa.array(some, pa.int32()), pa.array([x[order[edge[b] : edge[b + 1]]].tobytes() for b in some], pa.binary())], ["bucket", "rows"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, h, doc in _window_parts(batches, (3,)):
            x = np.empty(len(h), dtype=_HOLD)
            x["window"], x["doc"] = h, doc
            held.append(x)
            size += len(x)
            if size > 2 * FLUSH:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    def close(parts):
        x = _two_holders(np.frombuffer(b"".join(parts), dtype=_HOLD))
        at = np.flatnonzero(x["window"][1:] == x["window"][:-1])
        return pa.record_batch([pa.array(x["window"][at]), pa.array(x["doc"][at]), pa.array(x["doc"][at + 1])], ["window", "first", "second"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for bucket, rows in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if bucket != now and parts:
                    yield close(parts)
                    parts = []
                now = bucket
                parts.append(rows)
        if parts:
            yield close(parts)

    sent = suffixes.select("key", "right", "left", "doc_id").mapInArrow(tidy(send), "bucket int, rows binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(add), "window long, first long, second long")


def _spread_windows(suffixes: DataFrame, tables: Scratch) -> DataFrame:
    """(doc_id, pos, start, end, other) of the windows of suffixes that lie in another document too, whatever the size of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, h, doc, pos in _window_parts(batches, (3, 4)):
            yield pa.record_batch([pa.array(h), pa.array(doc), pa.array(pos.astype(np.int64) << 6 | words)], ["window", "doc_id", "at"])

    repeated = tables.put(repeated_windows(suffixes), "windows")
    # the leader is the smallest document and was compared with all
    held = suffixes.filter("NOT leads").select("key", "right", "left", "doc_id", "pos")
    held = held.mapInArrow(tidy(run), "window long, doc_id long, at long").join(repeated, "window")
    pos = F.shiftright("at", 6).cast("int")
    start = (pos - F.col("at").bitwiseAND(63)).cast("int")
    other = F.when(F.col("first") == F.col("doc_id"), F.col("second")).otherwise(F.col("first"))
    return held.select("doc_id", pos.alias("pos"), start.alias("start"), (start + MIN_WORDS).alias("end"), other.alias("other"))


def _windows_of_keys(suffixes: DataFrame) -> DataFrame:
    """The same for keys of bounded size, each met as a whole in one task."""
    names = ["doc_id", "pos", "start", "end", "other"]

    def spans(t: pa.Table) -> pa.RecordBatch:
        doc, pos = (t.column(k).to_numpy() for k in (3, 4))
        row, words, h = _windows(t.column(0).to_numpy(), t.column(1).to_pylist(), t.column(2).to_pylist())
        x = np.empty(len(h), dtype=_HOLD)
        x["window"], x["doc"] = h, doc[row]
        two = _two_holders(x)
        two = two[np.flatnonzero(two["window"][1:] == two["window"][:-1])[:, None] + np.arange(2)]  # (first, second)
        if not len(two):
            return pa.record_batch([pa.array([], k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())], names)
        at = np.minimum(np.searchsorted(two["window"][:, 0], h), len(two) - 1)
        hit = two["window"][at, 0] == h
        row, start, first, second = row[hit], pos[row[hit]] - words[hit], two["doc"][at[hit], 0], two["doc"][at[hit], 1]
        copy = first < doc[row]
        order = np.lexsort((copy, row))
        row, start, copy, other = row[order], start[order], copy[order], np.where(copy, first, second)[order]
        # the windows of one suffix all hold its gram, so their union is one span
        edge = np.flatnonzero(np.diff(2 * row + copy, prepend=-1))
        row, end = row[edge], np.maximum.reduceat(start, edge) + MIN_WORDS
        columns = doc[row], pos[row].astype(np.int32), np.minimum.reduceat(start, edge).astype(np.int32), end.astype(np.int32), np.minimum.reduceat(other, edge)
        return pa.record_batch([pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            part = pa.Table.from_batches([b])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < 4096:
                continue
            key = held.column(0).to_numpy()
            z = int(np.searchsorted(key, key[-1]))  # its last key may go on
            if z:
                yield spans(held.slice(0, z))
                held = held.slice(z)
        if held is not None and held.num_rows:
            yield spans(held)

    met = suffixes.select("key", "right", "left", "doc_id", "pos").repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(tidy(run), "doc_id long, pos int, start int, end int, other long")


def copied_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, copy, first_doc_id): repeated passages of each document.

    Spans of one document are merged where they touch, those that copy a
    smaller document apart from those that others copy.
    """
    with Scratch(docs.sparkSession) as tables:
        sampled = tables.put(_sampled(docs), "sampled")
        repeated = tables.put(repeated_keys(sampled), "repeated")
        marked = _exploded(sampled).join(repeated, "key")
        marked = marked.select("doc_id", "pos", "key", ((F.col("doc_id") == F.col("leader_doc")) & (F.col("pos") == F.col("leader_pos"))).alias("leads"))
        contexts = tables.put(_contexts(docs, marked), "contexts")
        led = tables.put(_with_leader(contexts), "led")
        sizes = led.groupBy("key").agg(F.max("short").alias("short"), F.count("*").alias("n"), F.count_if("apart").alias("apart"), F.max(F.col("apart") & (F.col("other") == F.col("doc_id"))).alias("within"))
        # one suffix apart has no partner that the leader does not stand for
        rest = contexts.join(sizes.filter("apart > 1 OR short OR within").select("key", "short", "n"), "key")
        rest = tables.put(rest, "rest")
        windows = _windows_of_keys(rest.filter(F.col("n") <= LARGE)).unionByName(_spread_windows(rest.filter(F.col("n") > LARGE), tables))
        windows = tables.put(windows, "held")
        short = rest.filter("short")
        spans = led.filter("NOT apart").unionByName(_neighbours(short, "right")).unionByName(_neighbours(short, "left"))
        spans = spans.select(windows.columns).unionByName(windows)
        copy = F.col("other") < F.col("doc_id")
        # spans at one position all hold its gram, so their union is one span
        spans = spans.groupBy("doc_id", "pos", copy.alias("copy")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other"))
        by_doc = spans.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("start", "end", "other"))).alias("s"))
        merged = F.expr("""aggregate(s, CAST(array() AS array<struct<start:int,end:int,other:bigint>>), (a, x) ->
            CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).end
                 THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end), 'other', least(element_at(a, -1).other, x.other))))
                 ELSE concat(a, array(x)) END)""")
        out = by_doc.select("doc_id", "copy", F.explode(merged).alias("m"))
        out = out.select("doc_id", F.col("m.start").cast("long").alias("start_word"), F.col("m.end").cast("long").alias("end_word"), "copy", F.col("m.other").alias("first_doc_id"))
        return materialize(out, "spans")


def cut_copies(docs: DataFrame, least_words: int = 10) -> DataFrame:
    """Documents without the passages that copy a smaller document.

    A document that loses words and keeps fewer than ``least_words`` is left
    out. All columns stay, whatever their names; ``n_chars`` follows the text
    where it exists. Rows that share a doc_id with another text, and rows with a
    null id, a null or an empty text, stay as they are; repeated rows are cut
    alike; an empty table gives no rows.
    """
    keys = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    spans = copied_spans(docs).filter("copy").join(keys.filter("lo <> hi"), "doc_id", "left_anti")
    spans = materialize(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("cut")), "cuts")

    @F.arrow_udf("string")
    @trimmed
    def without(text: pa.Array, cut: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(text), 500):
            for t, spans in zip(byte_column(text.slice(at, 500)), cut.slice(at, 500).to_pylist(), strict=True):
                out.append(_cut_text(t, [(c["start_word"], c["end_word"]) for c in spans or []], least_words))
        return pa.array(out, pa.string())

    without = without.asNondeterministic()  # else the filter on its result calls it a second time, in a worker of its own
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("_row")).withColumn("doc_id", F.col("_row.doc_id"))
    near, clear = split_by_ids(rows, "doc_id", spans)
    near = near.join(spans, "doc_id", "left")
    part = near.filter("cut IS NOT NULL").withColumn("_new", without(F.col("_row.text"), F.col("cut"))).filter("_new IS NOT NULL")
    return clear.select("_row.*").unionByName(near.filter("cut IS NULL").select("_row.*")).unionByName(part.select(*with_text(docs, F.col("_new"))))


def _cut_text(t: bytes, spans: list[tuple[int, int]], least_words: int) -> str | None:
    """A text without the given runs of words, or nothing if too few are left."""
    _, _, start, _ = word_hashes([t], lower=False)
    keep = np.ones(len(start), dtype=bool)
    for a, z in spans:
        keep[a:z] = False
    if int(keep.sum()) < max(1, least_words):
        return None
    begin = np.append(start[1:], len(t))  # a cut word goes with the space behind it
    at = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=0, append=0))
    parts = [t[start[a] : begin[z - 1] if z < len(start) else len(t)] for a, z in zip(at[0::2].tolist(), at[1::2].tolist(), strict=True)]
    return ((t[: start[0]] if keep[0] else b"") + b"".join(parts)).decode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copied_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
