"""Token packing by best-fit decreasing.

Texts are tokenised and cut into full windows; what is left of each is placed,
longest first, into the open window with the least room that still holds it. A
segment tree over remaining capacities finds that window. Pieces are dealt at
random into packing groups of about ``GROUP`` pieces, so that groups are packed
side by side and at most the last few windows of a group stay ill filled.

Edge cases: a null or empty text is the end token alone; repeated rows are
packed as often as they occur; ties are packed in order of doc_id, then start;
very long texts are cut into full windows, whole; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import materialize, tidy

WINDOW, END_ID, GROUP = 2048, 1, 100_000
CACHE, KEEP = 600_000, 64


class BestFit:
    """Open windows by remaining capacity; ``node[k]`` says whether any is under k."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.node = [False] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]
        self.count = 0

    def _mark(self, room: int, full: bool) -> None:
        k, node = room + self.leaves, self.node
        node[k] = full
        while k > 1:
            k >>= 1
            now = node[2 * k] or node[2 * k + 1]
            if node[k] == now:
                return
            node[k] = now

    def _tightest(self, length: int) -> int:
        """The least room of ``length`` or more that an open window has, else -1."""
        k, node = length + self.leaves, self.node
        if node[k]:
            return length
        while k > 1:
            if not k & 1 and node[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if node[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of a piece."""
        room = self._tightest(length)
        if room < 0:
            room, at = self.window, self.count
            self.count += 1
        else:
            at = self.open[room].pop()
            if not self.open[room]:
                self._mark(room, False)
        if left := room - length:
            self.open[left].append(at)
            if len(self.open[left]) == 1:
                self._mark(left, True)
        return at, self.window - room


class Tokens:
    """Ids of texts by a word-level BPE file, whose words never cross white space.

    Latin-1 texts are looked up by white-space separated part; parts not seen
    before are tokenised together. Any other text is tokenised as a whole.
    """

    _plain = bytes(x for x in range(256) if x in (9, 10, 13) or 0x20 <= x < 0x7F or x > 0xA0)
    _word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.base = Tokenizer.from_file(path)
        self.base.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.base.get_vocab_size()
        self.ends = np.array([(self.base.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {}

    def odd(self, text: str) -> bool:
        """Whether a text holds a control character or one outside Latin-1."""
        try:
            return bool(text.encode("latin-1").translate(None, self._plain))
        except UnicodeEncodeError:
            return True

    def whole(self, text: str) -> bytes:
        return np.array(self.base.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; they are tokenised as one text and cut at word ends."""
        if not words:
            return []
        ids = np.array(self.base.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        end = np.flatnonzero(self.ends[ids]) + 1
        if len(end) != len(words):
            return [self.whole(w) for w in words]
        raw, bound = ids.tobytes(), [0, *(4 * end).tolist()]
        return [raw[a:b] for a, b in zip(bound, bound[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        parts = [None if self.odd(t) else t.lower().split() for t in texts]
        new = list(set().union(*[p for p in parts if p]) - known.keys())
        if new:
            words = list(map(self._word.findall, new))
            fresh = list(set().union(*words) - known.keys())
            for at in range(0, len(fresh), 4000):
                some = fresh[at : at + 4000]
                known.update(zip(some, self._words(some), strict=True))
            known.update((x, b"".join(map(known.__getitem__, w))) for x, w in zip(new, words, strict=True) if len(w) != 1)
        out = [self.whole(t) if p is None else b"".join(map(known.__getitem__, p)) for t, p in zip(texts, parts, strict=True)]
        if new:
            for x in {x for x in (*new, *fresh) if len(x) > KEEP}:
                del known[x]
        return out


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("deal", pa.int64())])


def cut_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Full windows and the rest of each document, with the crc32 of their ids."""
    close = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, deal = Tokens(path), 0  # goes with the task, which its worker outlives
        for b in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            keys, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size, rows = at, 0, []
                while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 22):
                    size += len(texts[to])
                    to += 1
                for key, ids in zip(keys[at:to], t.encode(texts[at:to]), strict=True):
                    ids += close
                    n = len(ids) // 4
                    for s in range(0, n, window):
                        part = ids[4 * s : 4 * (s + window)]
                        rows.append((key, s, len(part) // 4, zlib.crc32(part), n, deal))
                        deal += 1
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)
                at = to

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long")


def pack(pieces: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Place pieces; adds (sequence_id, offset). ``pieces`` must be stored rows."""
    n = max(1, -(-pieces.count() // group))
    spread = F.pmod(F.xxhash64("doc_id", "start", "deal", "ids_crc32"), F.lit(n))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        fit = BestFit(window)
        spots = [fit.place(x) for x in pdf["length"].tolist()]
        base = int(pdf["part"].iloc[0]) << 32
        return pdf.assign(sequence_id=[base + s for s, _ in spots], offset=[o for _, o in spots]).drop(columns=["part", "deal"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.withColumn("part", spread).groupBy("part").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """The pieces of all ``docs`` in packed sequences, tokenised by the vocabulary at ``path``; edge cases as the module says."""
    return pack(materialize(cut_pieces(docs, path, window), "pieces"), window)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
