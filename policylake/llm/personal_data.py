"""Personal data: pattern spans, and more spans by a character BiLSTM with CRF transitions.

Base spans come from the four patterns (leftmost, without overlap within a kind, then checked).
The model reads overlapping windows of the text, is trained in numpy on the driver from the base
spans of at most `sample` texts (the smallest by hash, 20,000 code points of each), and decodes each window with the CRF's
transitions. Where windows overlap, each code point takes the label of the window in which it lies
further from an edge; so one labelling of the whole text remains, and its runs are spans. A model
span is added if its mean posterior is at least `sure`, it passes the check of its kind, and it
meets no base span. Base spans always stay.

Every kind needs a digit or an @, so a window without either can hold no span and is not run;
running it changes nothing. A null or empty text has no spans. Positions are code points, end
exclusive. Repeated rows are read row by row; a long text is many windows, `batch` at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm import bytewise
from policylake.llm.bilstm import Adam, BiLSTM
from policylake.llm.staging import sampled, small_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 64
Span = tuple[int, int, str]

# Each begins where a run begins: inside a run of its first class no other match can start.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The check of a kind on a match."""
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and (len(p.lstrip("0")) < 3 or int(p[-4:]) <= 255 and len(p.lstrip("0")) == 3) for p in parts)
    if kind == "card":
        d = _digits(text)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(text)) <= 15
    return True


def base(text: str) -> list[Span]:
    """Pattern spans by start, then kind as listed."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out.extend((m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(kind, m.group()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_SYMBOL = np.full(0x250, 1, np.uint8)  # 1: other letters and signs
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 2
_SYMBOL[48:58] = 3
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(4, 30)
for _i, _c in enumerate("@._%+-()[]{}:/,;"):
    _SYMBOL[ord(_c)] = 30 + _i
SYMBOLS = 46


def _symbols(text: str) -> np.ndarray:
    return _SYMBOL[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x24F)]


class Tagger:
    """Label 0 is none; label k is KINDS[k - 1]."""

    def __init__(self, hidden: int = 16, width: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.lstm = BiLSTM(width, hidden, rng)
        self.p = self.lstm.p
        labels = len(KINDS) + 1
        self.p["embed"] = (rng.standard_normal((SYMBOLS, width)) * 0.5).astype(np.float32)
        self.p["emit"] = (rng.standard_normal((2 * hidden, labels)) * 0.3).astype(np.float32)
        self.p["bias"] = np.zeros(labels, np.float32)
        self.p["move"] = (np.eye(labels) * 1.0).astype(np.float32)

    def _emissions(self, windows: np.ndarray, keep: dict | None = None):
        x = self.p["embed"][windows.T]
        h = self.lstm.forward(x, None, keep)
        return h @ self.p["emit"] + self.p["bias"], h, x

    def _chain(self, emit: np.ndarray):
        """Log forward and backward sums, and the log total."""
        move = self.p["move"]
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        add = lambda s, axis: (m := s.max(axis=axis)) + np.log(np.exp(s - np.expand_dims(m, axis)).sum(axis=axis))
        for t in range(1, len(emit)):
            alpha[t] = add(alpha[t - 1][:, :, None] + move, 1) + emit[t]
        for t in range(len(emit) - 2, -1, -1):
            beta[t] = add(move[None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, add(alpha[-1], 1)

    def learn(self, windows: np.ndarray, label: np.ndarray, optimiser: Adam) -> None:
        """One step on windows (batch, WINDOW) with labels of the same shape."""
        keep: dict = {}
        emit, h, x = self._emissions(windows, keep)
        alpha, beta, total = self._chain(emit)
        y, batch = label.T, windows.shape[0]
        posterior = np.exp(alpha + beta - total[:, None])
        hot = np.eye(emit.shape[2], dtype=np.float32)[y]
        de = ((posterior - hot) / batch).astype(np.float32)
        pair = alpha[:-1][:, :, :, None] + self.p["move"] + (emit[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]
        dm = np.exp(pair).sum(axis=(0, 1))
        np.add.at(dm, (y[:-1].ravel(), y[1:].ravel()), -1.0)
        dx, grads = self.lstm.backward(x, de @ self.p["emit"].T, keep)
        grads["emit"] = np.einsum("tbh,tbo->ho", h, de)
        grads["bias"] = de.sum(axis=(0, 1))
        grads["move"] = (dm / batch).astype(np.float32)
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], windows.T.ravel(), dx.reshape(-1, dx.shape[2]))
        optimiser.step(self.p, grads)

    def decode(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels of each window (batch, WINDOW) and the posterior of each label taken."""
        emit, _, _ = self._emissions(windows)
        alpha, beta, total = self._chain(emit)
        best, back = emit[0], []
        for t in range(1, len(emit)):
            s = best[:, :, None] + self.p["move"]
            back.append(s.argmax(axis=1))
            best = s.max(axis=1) + emit[t]
        path = [best.argmax(axis=1)]
        for b in reversed(back):
            path.append(b[np.arange(len(windows)), path[-1]])
        label = np.stack(path[::-1])
        posterior = np.exp(alpha + beta - total[:, None])
        return label.T, np.take_along_axis(posterior, label[:, :, None], 2)[:, :, 0].T


def _starts(symbols: np.ndarray, every: bool = False) -> np.ndarray:
    """Windows that may hold a span: those with a digit or an @."""
    start = np.arange(0, max(1, len(symbols) - (WINDOW - STRIDE)), STRIDE)
    if every:
        return start
    mark = np.r_[0, np.cumsum((symbols == 3) | (symbols == 30))]
    return start[mark[np.minimum(start + WINDOW, len(symbols))] > mark[start]]


def _cut(symbols: np.ndarray, start: np.ndarray) -> np.ndarray:
    padded = np.r_[symbols, np.zeros(WINDOW, np.uint8)]
    return padded[start[:, None] + np.arange(WINDOW)]


def added(model: Tagger, text: str, found: list[Span], sure: float = 0.9, batch: int = 256, every: bool = False) -> list[Span]:
    """Model spans that meet no base span."""
    symbols = _symbols(text)
    start = _starts(symbols, every)
    if not len(start):
        return []
    n = len(symbols)
    label, trust, depth = np.zeros(n, np.int8), np.zeros(n, np.float32), np.full(n, -1, np.int16)
    inner = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.int16)
    for lo in range(0, len(start), batch):
        some = start[lo : lo + batch]
        got, chance = model.decode(_cut(symbols, some))
        for s, one, p in zip(some.tolist(), got, chance, strict=True):
            size = min(WINDOW, n - s)
            better = inner[:size] > depth[s : s + size]
            at = s + np.flatnonzero(better)
            label[at], trust[at], depth[at] = one[:size][better], p[:size][better], inner[:size][better]
    edge = np.flatnonzero(np.diff(np.r_[0, label, 0]))
    taken = np.zeros(n + 1, bool)
    for a, b, _ in found:
        taken[a:b] = True
    out = []
    for a, b in zip(edge.tolist(), edge.tolist()[1:], strict=False):
        k = int(label[a]) if a < n else 0
        if not k or taken[a:b].any() or trust[a:b].mean() < sure:
            continue
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        span, kind = text[a:b], KINDS[k - 1]
        if len(span) > 4 and re.search(r"[0-9@]", span) and valid(kind, span) and (kind != "email" or "@" in span):
            out.append((a, b, kind))
    return out


def trained(documents: DataFrame, sample: int = 600, rounds: int = 160, seed: int = 5) -> Tagger:
    texts = sampled(documents.where(F.col("text").rlike("[0-9@]")), "text", sample, 20_000)
    windows, labels = [], []
    for text in texts:
        symbols, y = _symbols(text), np.zeros(len(text) + WINDOW, np.int64)
        for a, b, kind in base(text):
            y[a:b] = KINDS.index(kind) + 1
        for start in (_starts(symbols), _starts(symbols[17:]) + 17):  # another cut of the same text
            if len(start):
                windows.append(_cut(symbols, start))
                labels.append(y[np.minimum(start[:, None] + np.arange(WINDOW), len(y) - 1)])
    model, rng, optimiser = Tagger(seed=seed), np.random.default_rng(seed), Adam(0.02)
    if not windows:
        return model
    x, y = np.concatenate(windows), np.concatenate(labels)
    marked = np.flatnonzero(y.any(axis=1)) if y.any() else np.arange(len(x))
    for r in range(rounds):
        some = np.r_[rng.integers(len(x), size=24), rng.choice(marked, 24)]  # spans are rare
        optimiser.rate = 0.02 if r < rounds * 2 // 3 else 0.005
        model.learn(x[some], y[some], optimiser)
    return model


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find(documents: DataFrame, model: Tagger, key: str = "doc_id") -> DataFrame:
    """key, base counts n_email, n_ip, n_card, n_phone, base (joined spans) and spans (base and added) of every row."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    slim = documents.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    mark = np.zeros(256, bool)
    mark[[64, *range(48, 58)]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            counts = np.zeros((len(KINDS), len(batch)), np.int64)
            own, every = [""] * len(batch), [""] * len(batch)
            for row, _, data, at in bytewise.chunks(batch.column("text")):
                for i in np.unique(np.searchsorted(at, np.flatnonzero(mark[data]), "right") - 1).tolist():
                    text = data[at[i] : at[i + 1]].tobytes().decode()
                    found = base(text)
                    for _, _, kind in found:
                        counts[KINDS.index(kind), row + i] += 1
                    own[row + i] = joined(found)
                    every[row + i] = joined([*found, *added(tagger, text, found)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, counts), pa.array(own, pa.string()), pa.array(every, pa.string())], ["key", *(f"n_{k}" for k in KINDS), "base", "spans"])

    numbers = ", ".join(f"n_{k} long" for k in KINDS)
    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, {numbers}, base string, spans string").withColumnRenamed("key", key)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
