"""Exact Jaccard self-join of documents over word n-grams, as connected groups.

Two documents link when 100 * |A & B| >= 75 * |A | B| for their sets of
distinct 5-word shingles. The plan:

1. Equal sets become one class, so copies cost one row each.
2. Shingles in many documents are counted over the whole corpus and ordered
   last; each class posts the first n - ceil(0.75 n) + 1 shingles of its set in
   that order. Linked classes share at least one posted shingle.
3. The classes that post one shingle form size-banded tiles. A pair of a tile
   passes if the places of the shared shingle and then hashed bitmaps allow
   enough overlap; only such pairs go on to the exact intersection of sorted
   arrays.
4. First the row of each tile's middle is compared, the class that meets most
   others for its size; these links join most groups of near copies. Then all
   pairs of classes that still lie in different groups are, so no link between
   different groups is lost and no group of copies is paired member by member.
   Large tiles are dealt over pairs of blocks, and the largest group of a tile
   meets only the rest of it.

Links within a group that is joined already are not looked for: the result is
the groups, not the number of their links.

Edge cases: a text with fewer than five words has its word sequence as its only
shingle; without words or text the set is empty and links with nothing; a
repeated row links with its copies; rows of one doc_id with different texts are
told apart; a null doc_id keeps its row and never names a group; very long
texts are read whole; a share of exactly 75 percent links; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .text import Scratch, byte_column, chunks, column, materialize, mix, shingle_sets, split_by_ids, tidy

WORDS, PERCENT = 5, 75
#: A shingle in as many documents is ordered last; at most so many are ordered so.
OFTEN, MOST_OFTEN = 50, 200_000
BLOCK, FLUSH = 1500, 400_000
#: Partners of one class for which its set is sent once.
PARTNERS = 500


def _buckets(spark: SparkSession, rows: int = 0) -> int:
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // FLUSH)


def _by_bucket(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row indices by bucket of a 32-bit key."""
    bucket = (key.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edge)).tolist():
        yield b, order[edge[b] : edge[b + 1]]


def frequent_keys(docs: DataFrame, words: int = WORDS, often: int = OFTEN) -> np.ndarray:
    """The upper halves of the hashes of shingles in at least ``often`` documents, sorted.

    Tasks send blocks of distinct keys with counts by bucket; buckets are summed
    one by one. Only the order of shingles depends on the result.
    """
    n = _buckets(docs.sparkSession)

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, count = np.unique(np.concatenate(held), return_counts=True)
        rows = [(b, key[at].tobytes(), count[at].astype(np.uint32).tobytes()) for b, at in _by_bucket(key, n)]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            texts = byte_column(b.column(0))
            for a, z in chunks(texts):
                for s in shingle_sets(texts[a:z], words):
                    held.append((s >> np.uint64(32)).astype(np.uint32))
                    size += len(s)
                if size > FLUSH:
                    yield from emit(held)
                    held, size = [], 0
        if size:
            yield from emit(held)

    def merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(k, kind="stable")
        k = k[order]
        edge = np.flatnonzero(np.diff(k, prepend=k[:1] ^ np.uint32(1)))
        return k[edge], np.add.reduceat(c[order], edge)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, size, least = None, [], [], 0, FLUSH

        def close():
            k, total = merged(keys, counts)
            many = total >= often
            return pa.record_batch([pa.array(k[many].astype(np.int64)), pa.array(total[many])], ["key", "n"])

        for b in batches:
            for bucket, k, c in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if bucket != now and keys:
                    yield close()
                    keys, counts, size, least = [], [], 0, FLUSH
                now = bucket
                keys.append(np.frombuffer(k, dtype=np.uint32))
                counts.append(np.frombuffer(c, dtype=np.uint32))
                size += len(keys[-1])
                if size > least:  # what is held never exceeds the distinct keys of a bucket by much
                    k, c = merged(keys, counts)
                    keys, counts, size, least = [k], [c], len(k), max(FLUSH, 2 * len(k))
        if keys:
            yield close()

    sent = docs.select("text").mapInArrow(tidy(count), "bucket int, keys binary, counts binary")
    sums = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(add), "key long, n long")
    got = sums.orderBy(F.desc("n"), "key").limit(MOST_OFTEN).select("key").toPandas()
    return np.sort(got["key"].to_numpy(dtype=np.uint32))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def document_sets(docs: DataFrame, frequent: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n, node, check, prefix, bits): each document's set, digested."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            texts = byte_column(b.column(2))
            for a, z in chunks(texts):
                rows = []
                for s in shingle_sets(texts[a:z], words):
                    if not len(s):
                        rows.append((0, 0, 0, b"", b""))
                        continue
                    order = s
                    if len(often):
                        key = (s >> np.uint64(32)).astype(np.uint32)
                        at = np.minimum(np.searchsorted(often, key), len(often) - 1)
                        last = often[at] == key
                        order = np.concatenate((s[~last], s[last]))
                    check = np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
                    rows.append((len(s), _node(s), check.astype(np.int64), order[: prefix_length(len(s), percent)].tobytes(), bitmap(s)))
                yield pa.record_batch([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]], ["doc_id", "text_key", "n", "node", "check", "prefix", "bits"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(tidy(run), "doc_id long, text_key long, n long, node long, check long, prefix binary, bits binary")


def _by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, its values) of sorted (key, value) rows; the values are to be read before the next key."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for key, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield key, (r[1] for r in group)


_POST = np.dtype([("h", "<i8"), ("node", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def shared_postings(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(h, node, n, pos): posted shingles of two or more classes of fitting sizes, and their place in the set's order."""
    n_buckets = _buckets(classes.sparkSession, classes.agg(F.sum(F.expr(f"n - ceil({percent} * n / 100) + 1"))).first()[0] or 0)

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        post = np.concatenate(held)
        rows = [(b, post[at].tobytes()) for b, at in _by_bucket((post["h"].view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32), n_buckets)]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "posts"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for node, n, prefix in zip(*[c.to_pylist() for c in b.columns], strict=True):
                h = np.frombuffer(prefix, dtype="<i8")
                rows = np.empty(len(h), dtype=_POST)
                rows["h"], rows["node"], rows["n"], rows["pos"] = h, node, n, np.arange(len(h))
                held.append(rows)
                size += len(h)
                if size > FLUSH:
                    yield from emit(held)
                    held, size = [], 0
        if size:
            yield from emit(held)

    def send(x: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x[c]) for c in _POST.names], list(_POST.names))

    def close(x: np.ndarray) -> np.ndarray:
        x = x[np.lexsort((x["node"], x["n"], x["h"]))]
        near = (x["h"][1:] == x["h"][:-1]) & (100 * x["n"][:-1].astype(np.int64) >= percent * x["n"][1:].astype(np.int64))
        return x[np.concatenate((near, [False])) | np.concatenate(([False], near))]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by_first(batches):
            held, size, least, shared = [], 0, 4 * FLUSH, np.zeros(0, dtype=np.int64)
            for p in parts:
                held.append(np.frombuffer(p, dtype=_POST))
                size += len(held[-1])
                if size <= least:
                    continue
                # a bucket with very common shingles: these go on as they come, the others wait for a partner
                x = np.concatenate(held)
                h, count = np.unique(x["h"], return_counts=True)
                shared = np.union1d(shared, h[count > 1])
                ready = np.isin(x["h"], shared)
                for a in range(0, len(x), FLUSH):
                    yield send(x[a : a + FLUSH][ready[a : a + FLUSH]])
                held = [x[~ready]]
                size, least = len(held[0]), max(4 * FLUSH, 2 * len(held[0]))
            x = np.concatenate(held)
            ready = np.isin(x["h"], shared)
            if ready.any():
                yield send(x[ready])
                x = x[~ready]
            yield send(close(x))

    sent = classes.select("node", "n", "prefix").mapInArrow(tidy(post), "bucket int, posts binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(match), "h long, node long, n int, pos int")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, tables: Scratch, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection of sorted arrays.

    Only texts of classes in ``pairs`` move, as their ids fall into one of a
    bounded number of broadcast slots. Their sets meet at b; a class b with many
    partners is dealt over several keys, each of which gets its set once.
    """
    kinds = pa.schema([("b", pa.int64()), ("salt", pa.int32()), ("a", pa.int64()), ("tokens", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nodes, goals = byte_column(batch.column(0)), batch.column(1).to_pylist(), batch.column(2)
            for i, z in chunks(texts):
                out, size = [], 0
                for k, s in enumerate(shingle_sets(texts[i:z], words), i):
                    if not len(s) or _node(s) != nodes[k]:  # another text under the same doc_id
                        continue
                    raw = s.tobytes()
                    for goal in goals[k].as_py():
                        out.append((goal["b"], goal["salt"], None if goal["held"] else nodes[k], raw))
                        size += len(raw)
                        if size > 1 << 22:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                            out, size = [], 0
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 50):
                for b, salt, a, tokens in zip(*[c.to_pylist() for c in batch.slice(at, 50).columns], strict=True):
                    x = np.frombuffer(tokens, dtype=np.uint64)
                    if a is None:
                        key, held = (b, salt), x
                    elif key == (b, salt) and _linked(x, held, percent):
                        out.append((a, b))
            yield pa.record_batch([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    left = pairs.join(many, "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("salt"), F.lit(False).alias("held"))
    right = many.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("held"))
    goals = left.unionByName(right).groupBy("node", F.pmod(F.xxhash64("b"), F.lit(64)).alias("_deal")).agg(F.collect_list(F.struct("b", "salt", "held")).alias("goals"))
    wanted = tables.put(goals.join(classes.select("node", "rep"), "node").select("rep", "node", "goals"), "wanted")
    texts = split_by_ids(docs.select(F.col("doc_id").alias("rep"), "text"), "rep", wanted.select(F.col("rep").alias("doc_id")))[0]
    texts = texts.join(wanted, "rep").select("text", "node", "goals")
    met = texts.mapInArrow(tidy(sets), "b long, salt int, a long, tokens binary").repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return met.mapInArrow(tidy(meet), "a long, b long").distinct()


def _node(s: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(s + np.uint64(len(s)))).astype(np.int64))


_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bits of a set, in a power of two that is one and a half to three times its size."""
    size = 1 << max(6, (3 * len(s) // 2).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(s >> np.uint64(20)) & np.uint64(size - 1)] = True
    return np.packbits(bits).tobytes()


def _ones(bits: np.ndarray) -> np.ndarray:
    return _POP[bits].sum(axis=-1, dtype=np.int64)


def _fold(bits: bytes, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(bits, dtype=np.uint8).reshape(-1, width))


def may_link(n1: int, bits1: bytes, n2: int, bits2: bytes, percent: int = PERCENT) -> bool:
    """Whether the bitmaps allow a link: each bit that the other set lacks rules an element out."""
    width = min(len(bits1), len(bits2))
    x, y = _fold(bits1, width), _fold(bits2, width)
    both = int(_POP[x & y].sum())
    most = min(n1 - (int(_POP[x].sum()) - both), n2 - (int(_POP[y].sum()) - both))
    return (100 + percent) * most >= percent * (n1 + n2)


_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("an", "<i4"), ("bn", "<i4")])


def _tile_pairs(h, n, node, pos, root, part, percent) -> Iterator[np.ndarray]:
    """Pairs of neighbours 1, 2, ... apart in postings sorted by size, within the size band and of different groups.

    A pair is passed over where what follows a shared shingle in either set is
    too little for a link: the first shingle that the pair shares, if it may
    link, is never such a place.
    ``part`` differs in a tile of two blocks, whose pairs go across.
    """
    at, d = np.arange(len(h)), 0
    while len(at):
        d += 1
        at = at[at + d < len(h)]
        j = at + d
        near = (h[at] == h[j]) & (100 * n[at].astype(np.int64) >= percent * n[j].astype(np.int64))
        at = at[near]  # sizes rise, so a row past its band is done
        j = at + d
        least = np.minimum(n[at] - pos[at], n[j] - pos[j]).astype(np.int64)
        fit = (root[at] != root[j]) & ((100 + percent) * least >= percent * (n[at].astype(np.int64) + n[j]))
        i, j = at[fit], j[fit]
        cross = part[i] >= 0
        ok = ~cross | (part[i] != part[j])
        i, j = i[ok], j[ok]
        if len(i):
            out = np.empty(len(i), dtype=_PAIR)
            swap = node[i] < node[j]
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            out["a"], out["b"], out["an"], out["bn"] = node[a], node[b], n[a], n[b]
            yield out


def _distinct(held: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(held)
    x = x[np.lexsort((x["b"], x["a"]))]
    return x[(np.diff(x["a"], prepend=x["a"][:1] ^ 1) != 0) | (np.diff(x["b"], prepend=x["b"][:1] ^ 1) != 0)]


def tile_pairs(posts: DataFrame, roots: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b, an, bn) of classes in different groups whose places in the order allow a link.

    The classes that post a shingle are one tile, or tiles of blocks of about
    ``BLOCK``: the blocks of the largest group meet those of the rest, and these
    each other.
    """
    x = posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = x.groupBy("h", "root").agg(F.count("*").alias("m"))
    mixed = groups.groupBy("h").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("m")).filter("m > main.m")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    mixed = mixed.select("h", F.col("main.root").alias("main"), (F.col("m") <= BLOCK).alias("whole"), blocks(F.col("main.m")).alias("ours"), blocks(F.col("m") - F.col("main.m")).alias("theirs"))
    x = x.join(mixed, "h").withColumn("own", F.col("root") == F.col("main"))
    x = x.withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("own"), F.col("ours")).otherwise(F.col("theirs"))).cast("int"))
    # (p, q) names a tile, part the side of a row in a tile of two blocks
    x = x.withColumn("tiles", F.expr("""CASE
        WHEN whole THEN array(struct(-1 AS p, 0 AS q, -1 AS part))
        WHEN own THEN transform(sequence(0, theirs - 1), j -> struct(-2 - at AS p, j AS q, 0 AS part))
        ELSE concat(transform(sequence(0, ours - 1), i -> struct(-2 - i AS p, at AS q, 1 AS part)),
                    transform(sequence(0, theirs - 1), j -> struct(least(at, j) AS p, greatest(at, j) AS q, CASE WHEN j = at THEN -1 ELSE at END AS part))) END"""))
    x = x.select("h", F.explode("tiles").alias("t"), "n", "node", "pos", "root").select("h", "t.p", "t.q", "n", "node", "pos", "root", "t.part")

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        s = _distinct(held)
        return pa.record_batch([pa.array(s[c]) for c in _PAIR.names], list(_PAIR.names))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rest = [], 0, None
        for batch in _with_end(batches):
            if batch is not None:
                rest = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
                if rest.num_rows < 20_000:
                    continue
            if rest is None or not rest.num_rows:
                continue
            h, pp, q, n, node, pos, root, part = (c.to_numpy() for c in rest.columns)
            cut = len(h)
            if batch is not None:  # the last tile may go on in the next batch
                same = (h == h[-1]) & (pp == pp[-1]) & (q == q[-1])
                cut = int(np.argmax(same))
            if cut:
                key = np.cumsum((np.diff(h[:cut], prepend=h[0]) != 0) | (np.diff(pp[:cut], prepend=pp[0]) != 0) | (np.diff(q[:cut], prepend=q[0]) != 0))
                for out in _tile_pairs(key, n[:cut], node[:cut], pos[:cut], root[:cut], part[:cut], percent):
                    held.append(out)
                    size += len(out)
                    if size > FLUSH:
                        yield send(held)
                        held, size = [], 0
            rest = rest.slice(cut)
        if size:
            yield send(held)

    return x.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q", "n", "node").mapInArrow(tidy(count), "a long, b long, an int, bn int").distinct()


def bounded(pairs: DataFrame, bits: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) that may link by the bits of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            keep = [(a, b) for a, b, an, x, bn, y in rows if may_link(an, x, bn, y, percent)]
            yield pa.record_batch([pa.array([k[i] for k in keep], pa.int64()) for i in (0, 1)], ["a", "b"])

    met = pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("y")), "b")
    return met.select("a", "b", "an", "x", "bn", "y").mapInArrow(tidy(run), "a long, b long")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def middle_pairs(posts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, an, bn): each class with the middle that it meets most, where sizes and places allow a link.

    The middle of a tile is the class that meets most others for its size.
    """
    size = posts.groupBy("h").agg(F.count("*").alias("m"))
    meets = posts.join(size, "h").groupBy("node").agg((F.sum("m") / F.first("n")).alias("meets"))
    pick = F.max_by(F.struct(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bpos")), F.struct("meets", "node"))
    middle = posts.join(meets, "node").groupBy("h").agg(pick.alias("s")).select("h", "s.*")
    met = posts.join(middle, "h").filter(f"node <> b AND 100 * least(n, bn) >= {percent} * greatest(n, bn)")
    met = met.groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("m"), F.first("n").alias("an"), F.first("bn").alias("bn"), F.max(F.least(F.col("n") - F.col("pos"), F.col("bn") - F.col("bpos"))).alias("least"))
    met = met.filter(f"{100 + percent} * CAST(least AS BIGINT) >= {percent} * (CAST(an AS BIGINT) + bn)")
    return met.groupBy("a").agg(F.max_by(F.struct("b", "an", "bn"), F.struct("m", -F.col("b"))).alias("s")).select("a", "s.*")


def document_groups(docs: DataFrame, tables: Scratch, words: int = WORDS, percent: int = PERCENT, often: int = OFTEN) -> DataFrame:
    """(doc_id, text_key, n, root, component_id) of every document; ``root`` is null for empty sets and rows without an id."""
    docs = docs.select("doc_id", "text")
    sets = tables.put(document_sets(docs, frequent_keys(docs, words, often), words, percent), "sets")
    classes = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("node", "check", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = tables.put(classes, "classes")
    posts = tables.put(shared_postings(classes, percent), "posts")
    bits = classes.select("node", "bits")
    pairs = tables.put(bounded(middle_pairs(posts, percent), bits, percent), "middles")
    links = tables.put(verify(pairs, docs, classes, tables, words, percent), "links")
    roots = tables.put(components(links, tables), "roots")
    pairs = tables.put(bounded(tile_pairs(posts, roots, percent), bits, percent), "pairs")
    links = tables.put(links.unionByName(verify(pairs, docs, classes, tables, words, percent)), "links")
    roots = components(links, tables)
    named = classes.select("node", "check", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = tables.put(named, "named")
    name = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(name, "root").select("node", "check", "root", "component_id")
    out = sets.select("doc_id", "text_key", "n", "node", "check").join(named, ["node", "check"], "left")
    whole = F.col("n").isNotNull() & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_key", "n", F.when(whole, F.col("root")).alias("root"), F.when(whole, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, often: int = OFTEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    with Scratch(docs.sparkSession) as tables:
        out = document_groups(docs, tables, words, percent, often)
        return materialize(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "components")


def keep_first(docs: DataFrame) -> DataFrame:
    """All columns of the first row, by doc_id and text, of each group of near duplicates.

    Rows without a doc_id and rows with an empty set stay. Of rows that repeat
    a doc_id and its text one stays; another text under the same doc_id is
    judged on its own. Extra columns are kept whatever their names; an empty
    table gives no rows.
    """
    with Scratch(docs.sparkSession) as tables:
        rows = tables.put(document_groups(docs, tables), "groups")
        first = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
        key = F.struct("doc_id", "text_key")
        gone = rows.join(first, "root").filter(key != F.col("first")).select("doc_id", "text_key", F.lit(0).alias("most"))
        twice = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1")
        judged = gone.unionByName(twice.select("doc_id", "text_key", F.lit(1).alias("most"))).groupBy("doc_id", "text_key").agg(F.min("most").alias("most"))
        judged = materialize(judged, "judged")
    return _judged(docs, judged)


def _judged(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of ``docs`` but for those that ``judged`` gives: none, or one, of its (doc_id, text_key) stays.

    Only rows whose doc_id may be in ``judged`` are shuffled.
    """
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("_row"))
    rows = rows.withColumns({"_id": F.col("_row.doc_id"), "_text": F.xxhash64("_row.text")})
    near, clear = split_by_ids(rows, "_id", judged)
    judged = judged.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), "most")
    near = near.join(judged, ["_id", "_text"], "left")
    once = near.filter("most = 1").dropDuplicates(["_id", "_text"])
    kept = clear.select("_row").unionByName(near.filter("most IS NULL").select("_row")).unionByName(once.select("_row"))
    return kept.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows as DuckDB SQL.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (WITH RECURSIVE t(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.d, e.b FROM t JOIN e ON e.a = t.r) SELECT d, min(r) AS component_id FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.d = d.doc_id
"""
