"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of texts are laid out as one sequence of byte
tokens. An inverted index maps each mergeable pair, named by its rank, to the
positions where it stands; ranks are applied lowest first, each to all its
positions at once, and only the neighbours of a merge are looked up again. A
word in which a merge opens a pair of a lower rank than its own is replayed
alone, position by position, so the result is that of the plain algorithm.

Encoded words are kept from block to block, up to ``CACHE`` entries. Edge
cases: a null or empty text has no ids; repeated rows are kept; an empty table
gives no rows; extra columns are ignored; very long texts are encoded whole,
very long words are never kept; of equal pairs in a word the leftmost is merged
first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

CACHE, KEEP = 600_000, 64
_SEGMENT = re.compile(r"\s*\S+|\s+")
_TWO_SPACES = re.compile(r"\s\s")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes words by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.byte = np.array([ranks[bytes([x])] for x in range(256)], dtype=np.int64)
        self.first = np.full((256, 256), -1, dtype=np.int64)
        for x in range(256):
            for y in range(256):
                self.first[x, y] = ranks.get(bytes((x, y)), -1)
        self.token = dict(map(reversed, ranks.items()))
        self.known: dict[str, bytes] = {}

    def alone(self, word: bytes) -> list[int]:
        """The plain algorithm over one word, with a heap of (rank, position)."""
        tok, n = self.byte[np.frombuffer(word, dtype=np.uint8)].tolist(), len(word)
        nxt, prv, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.get
        heap = [(r, p) for p in range(n - 1) if (r := get(tok[p] << 32 | tok[p + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, p = heapq.heappop(heap)
            q = nxt[p]
            if tok[p] < 0 or q >= n or get(tok[p] << 32 | tok[q]) != r:
                continue
            tok[p], tok[q], nxt[p] = r, -1, nxt[q]
            if nxt[q] < n:
                prv[nxt[q]] = p
                if (s := get(r << 32 | tok[nxt[q]])) is not None:
                    heapq.heappush(heap, (s, p))
            if prv[p] >= 0 and (s := get(tok[prv[p]] << 32 | r)) is not None:
                heapq.heappush(heap, (s, prv[p]))
        return [t for t in tok if t >= 0]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(size)
        owner = np.repeat(np.arange(len(words)), size)
        n = len(flat)
        tok = self.byte[flat].tolist()
        nxt = np.arange(1, n + 1)
        nxt[end - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[end - size] = -1
        start = self.first[flat[:-1], flat[1:]] if n > 1 else np.zeros(0, dtype=np.int64)
        start[end[:-1] - 1] = -1
        at = np.flatnonzero(start >= 0)
        order = at[np.argsort(start[at], kind="stable")]
        cut = np.flatnonzero(np.diff(start[order], prepend=-1))
        edge = [*cut.tolist(), len(order)]  # without any mergeable pair the index is empty
        index = {int(start[order[a]]): order[a:b].tolist() for a, b in zip(edge, edge[1:])}
        nxt, prv, get, again = nxt.tolist(), prv.tolist(), self.pairs.get, set()
        heap = sorted(index)
        while heap:
            r = heapq.heappop(heap)
            for p in sorted(index.pop(r)):
                t = tok[p]
                if t < 0 or (q := nxt[p]) < 0 or get(t << 32 | tok[q]) != r:
                    continue
                tok[p], tok[q] = r, -1
                nxt[p] = after = nxt[q]
                if after >= 0:
                    prv[after] = p
                    s = get(r << 32 | tok[after])
                    if s is not None:
                        if s < r:
                            again.add(int(owner[p]))
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heapq.heappush(heap, s)
                before = prv[p]
                if before >= 0:
                    s = get(tok[before] << 32 | r)
                    if s is not None:
                        if s < r:
                            again.add(int(owner[p]))
                        if s in index:
                            index[s].append(before)
                        else:
                            index[s] = [before]
                            heapq.heappush(heap, s)
        tok = np.array(tok, dtype=np.int64)
        live = np.concatenate(([0], np.cumsum(tok >= 0)))
        ids = tok[tok >= 0].astype("<u4").tobytes()
        bound = (4 * live[np.concatenate(([0], end))]).tolist()
        out = [ids[a:b] for a, b in zip(bound, bound[1:])]
        for k in again:
            out[k] = np.array(self.alone(words[k]), dtype="<u4").tobytes()
        return out

    def segments(self, text: str) -> list[str]:
        """Parts of a text that the pattern never matches across."""
        if not text:
            return []
        if _TWO_SPACES.search(text):
            return _SEGMENT.findall(text)
        head, *rest = text.split(" ")
        out = [" " + x for x in rest]
        return [head, *out] if head else out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        parts = [self.segments(t) for t in texts]
        new = list(set().union(*parts) - known.keys())
        if new:
            words = list(map(self.pattern.findall, new))
            fresh = list(set().union(*words) - known.keys())  # a word alone is a segment too
            known.update(zip(fresh, self.replay([w.encode() for w in fresh]), strict=True))
            known.update((x, b"".join(map(known.__getitem__, w))) for x, w in zip(new, words, strict=True) if len(w) != 1)
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        if new:
            for x in {x for x in (*new, *fresh) if len(x) > KEEP}:
                del known[x]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_held: dict[tuple[str, str], MergeReplay] = {}


def replayer(path: str, pattern: str) -> MergeReplay:
    """One for each Python worker, which outlives a task."""
    if (path, pattern) not in _held:
        _held[path, pattern] = MergeReplay(read_ranks(path), pattern)
    return _held[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): every whole text as little-endian 32-bit ids."""
    return _mapped(docs, path, pattern, False)


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), decoded from the ids."""
    return _mapped(docs, path, pattern, True)


def _mapped(docs: DataFrame, path: str, pattern: str, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replayer(path, pattern)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 22):
                    size += len(texts[to])
                    to += 1
                ids = bpe.encode(texts[at:to])
                keys = b.column(0).slice(at, to - at)
                if digest:
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    yield pa.record_batch([keys, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(bpe.decode(x)) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.record_batch([keys, pa.array(ids, pa.binary())], ["doc_id", "ids"])
                at = to

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
