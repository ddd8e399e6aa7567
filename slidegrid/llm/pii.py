"""Personal data by patterns and a character BiLSTM with CRF transitions.

The patterns give the base spans of every whole text. The model, a character
bidirectional LSTM with a linear-chain CRF on top, is trained in numpy from
labelled spans: base spans found in at most ``TRAIN_WINDOWS`` windows of the
corpus, together with copies of those windows in which the same data are
written in ways that the patterns miss ("name at host dot org", numbers without
a plus sign, dots in brackets). The model, run by onnxruntime in the tasks,
then decodes every whole text, in windows of ``SPAN`` characters of which
neighbours share ``SHARED``; each character takes its label from the window in
whose middle it lies deepest, and the spans of the whole text are reconciled:
base spans stay, model spans that meet one go, model spans must pass a check of
their kind (``sound``).

Edge cases: null and empty texts have no spans; ties between windows go to the
earlier one; without any labelled window only base spans are reported; very
long texts are searched whole; repeated rows are kept; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import Scratch, column, tidy, trimmed, with_text

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, REACH, PROSE = 96, 48, 24, 1000  # windows to learn from
SPAN, SHARED, PAD, LANES = 384, 64, 128, 512  # windows to decode
TRAIN_WINDOWS, EPOCHS, BATCH, HIDDEN, EMBED, RATE = 1500, 6, 48, 20, 12, 0.02
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

# The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
#: The windows to learn from lie round these, and every ``PROSE`` characters.
_TRIGGER = re.compile(r"[0-9@aA](?:(?<=[0-9@])[0-9@]*|(?<=\b[aA])[tT]\b)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, sorted."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # an address needs its @, so matches are grown from there
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > done and text[start - 1] in _LOCAL_SET:
                start -= 1
            if start < at:
                done = m.end()
                out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def sound(kind: int, value: str) -> bool:
    """What a model span of a kind must hold."""
    digits = _NOT_DIGIT.sub("", value)
    if kind == 0:
        low = value.lower()
        return ("@" in value or "at" in low) and ("." in value or "dot" in low) and sum(c.isalnum() for c in value) >= 6
    if kind == 1:
        parts = [p for p in _NOT_DIGIT.split(value) if p]
        return len(parts) == 4 and all(map(_small, parts))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


# --- characters -------------------------------------------------------------

_PUNCT = "@.+-_%()[]{}<>:;,/ \n"
_CODE = np.full(0x180, 3, dtype=np.uint8)  # other
_CODE[[ord(c) for c in "0123456789"]] = 1
for _c in "abcdefghijklmnopqrstuvwxyz":
    _CODE[ord(_c)] = _CODE[ord(_c) - 32] = 4 + ord(_c) - 97
for _k, _c in enumerate(_PUNCT):
    _CODE[ord(_c)] = 30 + _k
VOCAB = 30 + len(_PUNCT)


def codes(text: str) -> np.ndarray:
    """One small code a character; every letter outside a-z is 2."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _CODE[np.minimum(raw, 0x17F)]
    if not text.isascii():
        out[(raw >= 0xC0) & (out == 3)] = 2
    return out


def window_starts(text: str) -> list[int]:
    """Starts of windows to learn from: over all triggers and ``REACH`` characters beside them, and here and there."""
    zones: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, z = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if zones and a <= zones[-1][1]:
            zones[-1][1] = z
        else:
            zones.append([a, z])
    out = []
    for a, z in zones:
        a -= min(a, (WINDOW - STRIDE) // 2)
        out += range(a, max(a + 1, z - (WINDOW - STRIDE) // 2), STRIDE)
    return sorted({*out, *range(0, len(text), PROSE)})


def cuts(n: int) -> range:
    """Starts of the windows in which a text of n characters is decoded."""
    return range(0, max(1, n - SHARED), SPAN - SHARED)


def _cut(code: np.ndarray, starts: list[int]) -> np.ndarray:
    pad = np.concatenate((code, np.zeros(WINDOW, dtype=np.uint8)))
    return pad[np.asarray(starts, dtype=np.int64)[:, None] + np.arange(WINDOW)]


# --- model ------------------------------------------------------------------


class Model(NamedTuple):
    embed: np.ndarray
    wx: np.ndarray  # (2, EMBED, 4 H): forward and backward
    wh: np.ndarray
    bias: np.ndarray
    out: np.ndarray  # (2 H, TAGS)
    out_bias: np.ndarray
    move: np.ndarray  # CRF transitions, (from, to)


def fresh(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    bias = np.zeros((2, 4 * HIDDEN), dtype=np.float32)
    bias[:, HIDDEN : 2 * HIDDEN] = 1
    return Model(r(VOCAB, EMBED), r(2, EMBED, 4 * HIDDEN), r(2, HIDDEN, 4 * HIDDEN), bias, r(2 * HIDDEN, TAGS), np.zeros(TAGS, dtype=np.float32), np.zeros((TAGS, TAGS), dtype=np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, wh: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (T, B, H) from input gates x (T, B, 4 H)."""
    t, b, _ = x.shape
    h, c = np.zeros((b, HIDDEN), dtype=np.float32), np.zeros((b, HIDDEN), dtype=np.float32)
    out = np.empty((t, b, HIDDEN), dtype=np.float32)
    for k in range(t):
        z = x[k] + h @ wh
        gate = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, gate, g, tc))
        h = o * tc
        out[k] = h
    return out


def emissions(m: Model, win: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Scores (T, B, TAGS) of windows (B, T)."""
    e = m.embed[win.T]
    both, held = [], []
    for d in (0, 1):
        x = e if d == 0 else e[::-1]
        state: list = []
        h = _lstm(x @ m.wx[d] + m.bias[d], m.wh[d], state if keep is not None else None)
        both.append(h if d == 0 else h[::-1])
        held.append(state)
    hidden = np.concatenate(both, axis=2)
    if keep is not None:
        keep.update(e=e, hidden=hidden, held=held)
    return hidden @ m.out + m.out_bias


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(m: Model, win: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean CRF loss of labelled windows and its gradient."""
    held: dict = {}
    e = emissions(m, win, held).astype(np.float64)
    t, b, _ = e.shape
    y, move = tags.T, m.move.astype(np.float64)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[0], beta[-1] = e[0], 0
    for k in range(1, t):
        alpha[k] = e[k] + _sum_exp(alpha[k - 1][:, :, None] + move, 1)
        beta[t - 1 - k] = _sum_exp(move + (e[t - k] + beta[t - k])[:, None, :], 2)
    z = _sum_exp(alpha[-1], 1)
    rows = np.arange(b)
    gold = e[np.arange(t)[:, None], rows, y].sum(axis=0) + move[y[:-1], y[1:]].sum(axis=0)
    de = np.exp(alpha + beta - z[:, None])
    de[np.arange(t)[:, None], rows, y] -= 1
    pair = np.exp(alpha[:-1, :, :, None] + move + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum(axis=(0, 1))
    np.subtract.at(pair, (y[:-1], y[1:]), 1)
    de = (de / b).astype(np.float32)
    hidden = held["hidden"]
    g_out = hidden.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
    dh_all = de @ m.out.T
    g_wx, g_wh, g_bias, de_in = np.zeros_like(m.wx), np.zeros_like(m.wh), np.zeros_like(m.bias), np.zeros_like(held["e"])
    for d in (0, 1):
        dh_seq = dh_all[:, :, :HIDDEN] if d == 0 else dh_all[::-1, :, HIDDEN:]
        dz_seq = np.empty((t, b, 4 * HIDDEN), dtype=np.float32)
        dh, dc = np.zeros((b, HIDDEN), dtype=np.float32), np.zeros((b, HIDDEN), dtype=np.float32)
        for k in range(t - 1, -1, -1):
            h0, c0, gate, g, tc = held["held"][d][k]
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            dh = dh + dh_seq[k]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * g, dc * c0, dh * tc), axis=1) * gate * (1 - gate)
            dz = np.concatenate((dz, dc * i * (1 - g * g)), axis=1)
            dz_seq[k] = dz
            g_wh[d] += h0.T @ dz
            dh, dc = dz @ m.wh[d].T, dc * f
        x = held["e"] if d == 0 else held["e"][::-1]
        g_wx[d] = x.reshape(-1, EMBED).T @ dz_seq.reshape(-1, 4 * HIDDEN)
        g_bias[d] = dz_seq.sum(axis=(0, 1))
        back = dz_seq @ m.wx[d].T
        de_in += back if d == 0 else back[::-1]
    g_embed = np.zeros_like(m.embed)
    np.add.at(g_embed, win.T.reshape(-1), de_in.reshape(-1, EMBED))
    return float((z - gold).mean()), [g_embed, g_wx, g_wh, g_bias, g_out, de.sum(axis=(0, 1)), (pair / b).astype(np.float32)]


def fit(win: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam over shuffled batches of labelled windows."""
    m, rng, step = [p.copy() for p in fresh(seed)], np.random.default_rng(seed), 0
    first, second = [np.zeros_like(p) for p in m], [np.zeros_like(p) for p in m]
    for epoch in range(epochs):
        order = rng.permutation(len(win))
        for a in range(0, len(win), BATCH):
            at = order[a : a + BATCH]
            _, grads = gradient(Model(*m), win[at], tags[at])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = RATE * 0.7**epoch * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, u, v in zip(m, grads, first, second, strict=True):
                g = g * min(1.0, 5 / (norm + 1e-9))
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                p -= (rate * u / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return Model(*m)


def _field(number: int, value: int | str | bytes) -> bytes:
    """One field of a message in the wire format of ONNX files."""

    def varint(n: int) -> bytes:
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def onnx_file(m: Model) -> bytes:
    """The emissions as ONNX: ``x`` (T, EMBED + 1, B), characters and a one for the bias, to ``e`` (T, TAGS, B).

    One scan a direction. Rows are gates and columns windows, so that every
    step works on whole blocks of memory.
    """

    def tensor(name: str, a: np.ndarray) -> bytes:
        return _field(5, b"".join(_field(1, n) for n in a.shape) + _field(2, 1) + _field(8, name) + _field(9, np.ascontiguousarray(a, dtype="<f4").tobytes()))

    def node(kind: str, takes: str, gives: str, *how: bytes) -> bytes:
        return _field(1, b"".join(_field(1, x) for x in takes.split()) + b"".join(_field(2, x) for x in gives.split()) + _field(4, kind) + b"".join(_field(5, x) for x in how))

    def port(name: str, *dims: int | str) -> bytes:
        shape = b"".join(_field(1, _field(1 if isinstance(d, int) else 2, d)) for d in dims)
        return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))

    number = lambda name, n: _field(1, name) + _field(3, n) + _field(20, 2)
    numbers = lambda name, *n: _field(1, name) + b"".join(_field(8, x) for x in n) + _field(20, 7)
    graph = _field(2, "emissions") + tensor("bias", m.out_bias[:, None])
    for d in (0, 1):
        step = node("Concat", "h x", "hx", number("axis", 0)) + node("MatMul", f"gates{d} hx", "z") + node("Split", "z", "zi zf zo zg", number("axis", 0))
        step += node("Sigmoid", "zi", "i") + node("Sigmoid", "zf", "f") + node("Sigmoid", "zo", "o") + node("Tanh", "zg", "g")
        step += node("Mul", "f c", "kept") + node("Mul", "i g", "new") + node("Add", "kept new", "c1") + node("Tanh", "c1", "t") + node("Mul", "o t", "h1") + node("Identity", "h1", "y")
        step += _field(2, "step") + b"".join(_field(11, port(x, n, "b")) for x, n in (("h", HIDDEN), ("c", HIDDEN), ("x", EMBED + 1))) + b"".join(_field(12, port(x, HIDDEN, "b")) for x in ("h1", "c1", "y"))
        body = _field(1, "body") + _field(6, step) + _field(20, 5)
        graph += node("Scan", "zero zero x", f"h{d} c{d} y{d}", body, number("num_scan_inputs", 1), numbers("scan_input_directions", d), numbers("scan_output_directions", d))
        graph += node("MatMul", f"out{d} y{d}", f"e{d}") + tensor(f"gates{d}", np.concatenate((m.wh[d], m.wx[d], m.bias[d][None])).T) + tensor(f"out{d}", m.out[d * HIDDEN : (d + 1) * HIDDEN].T)
    graph += node("Add", "e0 e1", "both") + node("Add", "both bias", "e")
    graph += _field(11, port("x", "t", EMBED + 1, "b")) + _field(11, port("zero", HIDDEN, "b")) + _field(12, port("e", "t", TAGS, "b"))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 14))


def session(m: Model):
    """The emissions on one thread; its memory goes with it, as Python workers outlive their tasks."""
    import onnxruntime

    how = onnxruntime.SessionOptions()
    how.intra_op_num_threads = how.inter_op_num_threads = 1
    how.log_severity_level = 3
    return onnxruntime.InferenceSession(onnx_file(m), how, providers=["CPUExecutionProvider"])


def scores(m: Model, win: np.ndarray, by=None) -> np.ndarray:
    """``emissions`` as (T, TAGS, B), by onnxruntime, in the session ``by``."""
    table = np.concatenate((m.embed.T, np.ones((1, VOCAB), dtype=np.float32)))
    x = np.empty((win.shape[1], EMBED + 1, len(win)), dtype=np.float32)
    for to, at in zip(x, np.ascontiguousarray(win.T).astype(np.intp), strict=True):
        np.take(table, at, axis=1, out=to, mode="clip")
    return (by or session(m)).run(None, {"x": x, "zero": np.zeros((HIDDEN, len(win)), dtype=np.float32)})[0]


def best_tags(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best path (T, B) through scores (T, TAGS, B) and transitions; ties go to the lower tag."""
    t, _, b = e.shape
    score = e.copy()
    for k in range(1, t):
        score[k] += (score[k - 1][:, None] + move[:, :, None]).max(axis=0)
    out = np.empty((t, b), dtype=np.int8)
    out[-1] = score[-1].argmax(axis=0)
    for k in range(t - 1, 0, -1):
        out[k - 1] = (score[k - 1] + move[:, out[k]]).argmax(axis=0)
    return out


def may_hold(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Windows of scores (T, TAGS, B) whose best path may leave tag 0.

    Against 0 throughout, a run of other tags gains the scores over those of
    tag 0, with a transition into each and one back to 0. ``most`` bounds the
    gain of the runs that end at a character, with the best transition of each
    tag; where no run can gain, 0 throughout is the best path.
    """
    rel = move - move[0, 0]
    first, on = (np.full((len(e), e.shape[2]), -np.inf, dtype=np.float32) for _ in range(2))
    for k in range(1, TAGS):
        over = e[:, k] - e[:, 0]
        np.maximum(on, over + rel[1:, k].max(), out=on)
        over[1:] += rel[0, k]  # none leads to the first character
        np.maximum(first, over, out=first)
    back = rel[1:, 0].max()
    most = first[0]
    top = most.copy()
    for a, b in zip(first[1:], on[1:], strict=True):
        most = np.maximum(a, most + b)
        np.maximum(top, most, out=top)
    return np.maximum(top + back, most) + 0.1 >= 0  # with room for rounding; none leads from the last one


def decode(m: Model, win: np.ndarray) -> np.ndarray:
    """Best tags (B, T) of windows under the CRF; paths are looked for together in the windows that may hold one."""
    by, out = session(m), np.zeros(win.shape, dtype=np.int8)
    rows, held = [], []

    def close():
        if rows:
            out[np.concatenate(rows)] = best_tags(np.concatenate(held, axis=2), m.move).T
            rows.clear()
            held.clear()

    for a in range(0, len(win), LANES):
        e = scores(m, win[a : a + LANES], by)
        some = np.flatnonzero(may_hold(e, m.move))
        if len(some):
            rows.append(a + some)
            held.append(e[:, :, some])
        if sum(map(len, rows)) >= LANES:
            close()
    close()
    return out


# --- labelled windows -------------------------------------------------------


def tag_text(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(n + WINDOW, dtype=np.uint8)
    for start, kind, end in reversed(spans):  # of spans that overlap the first stays whole
        tags[start] = 1 + 2 * kind
        tags[start + 1 : end] = 2 + 2 * kind
    return tags


def variants(value: str, kind: int) -> list[str]:
    """Other ways to write what a pattern found."""
    if kind == 0:
        name, _, host = value.partition("@")
        return [f"{name} at {host.replace('.', ' dot ')}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} (at) {host}"]
    if kind == 1:
        return [value.replace(".", "[.]"), value.replace(".", " . ")]
    if kind == 2:
        d = _NOT_DIGIT.sub("", value)
        return [".".join(d[i : i + 4] for i in range(0, len(d), 4)), "/".join(d[i : i + 4] for i in range(0, len(d), 4))]
    return [value.lstrip("+"), "00" + value.lstrip("+")]


def labelled_windows(text: str) -> list[tuple[bytes, bytes]]:
    """(codes, tags) of a text's windows, and of rewritten copies around each span."""
    spans = base_spans(text)
    starts = window_starts(text)
    out = []
    if starts:
        code, tags = codes(text), tag_text(len(text), spans)
        out += [(c.tobytes(), tags[s : s + WINDOW].tobytes()) for s, c in zip(starts, _cut(code, starts), strict=True)]
    for start, kind, end in spans:
        if end - start > WINDOW // 2:
            continue
        for other in variants(text[start:end], kind):
            left, right = text[max(0, start - 24) : start], text[end : end + WINDOW]
            tags = tag_text(WINDOW, [(len(left), kind, len(left) + len(other))])
            out.append((_cut(codes((left + other + right)[:WINDOW]), [0])[0].tobytes(), tags[:WINDOW].tobytes()))
    return out


def train(docs: DataFrame, limit: int = TRAIN_WINDOWS) -> Model | None:
    """Fit on at most ``limit`` distinct labelled windows, those that hash lowest.

    Every task keeps no more of either class than could be chosen, so the
    choice is that of the whole corpus however it is partitioned.
    """
    most = {True: 2 * limit // 3, False: limit // 3}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rows = {r for t in b.column(0).slice(at, 1000).to_pylist() if t for r in labelled_windows(t)}
                for c, t in rows:
                    held[any(t)].append((int.from_bytes(hashlib.blake2b(c, digest_size=7).digest(), "big"), c, t))
                held = {has: sorted(set(x))[: most[has]] for has, x in held.items()}
        rows = [(*r, has) for has, x in held.items() for r in x]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.bool_()))], ["rank", "codes", "tags", "labelled"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((c, t) for b in batches for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if any(any(t) for _, t in rows):
            win, tags = (np.frombuffer(b"".join(r[k] for r in rows), dtype=np.uint8).reshape(-1, WINDOW) for k in (0, 1))
            yield pa.record_batch([pa.array([pickle.dumps(fit(win, tags.astype(np.int64)))], pa.binary())], ["model"])

    with Scratch(docs.sparkSession) as tables:
        some = docs.select("text").mapInArrow(tidy(run), "rank long, codes binary, tags binary, labelled boolean")
        some = tables.put(some.distinct(), "windows")
        best = [some.filter(F.col("labelled") == has).orderBy("rank", "codes", "tags").limit(n) for has, n in most.items()]
        # a bounded number of windows, so one task fits the model
        got = best[0].unionByName(best[1]).select("codes", "tags").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(got[0].model) if got else None


# --- decoding ---------------------------------------------------------------


def _joined(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs in a row of tags."""
    out, k = [], 0
    at = np.flatnonzero(tags)
    while k < len(at):
        start, kind = int(at[k]), (int(tags[at[k]]) - 1) // 2
        k += 1
        while k < len(at) and at[k] == at[k - 1] + 1 and tags[at[k]] == 2 + 2 * kind:
            k += 1
        out.append((start, kind, int(at[k - 1]) + 1))
    return out


def label_texts(texts: list[str], model: Model) -> list[np.ndarray]:
    """The tag of every character of whole texts, none of them empty.

    Windows are filled up to a multiple of ``PAD`` and decoded with others of
    their length; where two overlap, each gives the half that it holds deeper.
    """
    rows: dict[int, list] = {}
    for i, t in enumerate(texts):
        code = codes(t)
        for s in cuts(len(t)):
            part = code[s : s + SPAN]
            rows.setdefault(-(-len(part) // PAD) * PAD, []).append((i, s, part))
    out = [np.zeros(len(t), dtype=np.int8) for t in texts]
    for size, some in rows.items():
        win = np.zeros((len(some), size), dtype=np.uint8)
        for row, (_, _, part) in zip(win, some, strict=True):
            row[: len(part)] = part
        for row, (i, s, part) in zip(decode(model, win), some, strict=True):
            lo, hi = s and SHARED // 2, len(part)
            if s + hi < len(texts[i]):
                hi = SPAN - SHARED // 2
            out[i][s + lo : s + hi] = row[lo:hi]
    return out


def find_spans(texts: list[str], model: Model | None) -> list[tuple[list, list]]:
    """(base, added) spans of each text."""
    distinct = [t for t in dict.fromkeys(texts) if t]
    found = {t: (base_spans(t), []) for t in ["", *distinct]}
    if model is not None:
        for t, label in zip(distinct, label_texts(distinct, model), strict=True):
            base, added = found[t]
            for s, kind, e in _joined(label):
                if not any(s < z and a < e for a, _, z in base) and sound(kind, t[s:e]):
                    added.append((s, kind, e))
    return [found[t] for t in texts]


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > 1 << 21:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def personal_data(docs: DataFrame, model: Model | None) -> DataFrame:
    """Counts and digest of base spans, and all spans, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            texts = [x or "" for x in b.column(1).to_pylist()]
            for a, z in _blocks(texts):
                found = find_spans(texts[a:z], shared.value)
                counts = [pa.array([sum(k == i for _, k, _ in base) for base, _ in found], pa.int64()) for i in range(len(KINDS))]
                sha = pa.array([hashlib.sha256(_text(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.record_batch([b.column(0).slice(a, z - a), *counts, sha, pa.array([_text(sorted(base + more)) for base, more in found], pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of spans that overlap the first names both."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows and columns, with personal data in ``text`` replaced.

    Null texts stay null and empty ones empty; of spans that overlap the first
    names both; repeated rows are changed alike; extra columns are kept
    whatever their names; an empty table gives no rows. Without a model only
    base spans are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    @trimmed
    def clean(text: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(text), 500):
            some = text.slice(at, 500).to_pylist()
            for a, z in _blocks([t or "" for t in some]):
                found = find_spans([t or "" for t in some[a:z]], shared.value)
                out += [t if t is None or not (base or more) else redacted(t, base + more) for t, (base, more) in zip(some[a:z], found, strict=True)]
        return pa.array(out, pa.string())

    rows = docs.select(F.struct(*map(column, docs.columns)).alias("_row")).withColumn("_new", clean(F.col("_row.text")))
    return rows.select(*with_text(docs, F.col("_new")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return personal_data(docs, train(docs))
