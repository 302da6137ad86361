"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by back-propagation through time on a bounded
sample of text windows; every position of a window is labelled.  Prediction cuts
each whole text into windows (the state starts anew in each), labels every byte
and pools the probabilities over the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW, HIDDEN, PER_LANGUAGE = 128, 8, 1500
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SAMPLE_BUCKETS = 30
_BATCH = 2048  # windows that go through the network together


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """Parameters for both directions stacked: x (2, 256, 3H), u (2, H, 3H), out (2H, L), bias (L); gates in the order z, r, candidate."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        self.p = {"x": rnd.normal(0, 0.3, (2, 256, 3 * hidden)), "u": rnd.normal(0, hidden ** -0.5, (2, hidden, 3 * hidden)),
                  "out": rnd.normal(0, 0.3, (2 * hidden, len(labels))), "bias": np.zeros(len(labels))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, data: np.ndarray, keep: bool):
        """``data``: bytes (time, batch).  States (2, time, batch, H), each direction in its own order of time."""
        n, b, h = *data.shape, self.h
        x, u = self.p["x"], self.p["u"]
        state = np.zeros((2, b, h), np.float32)
        states = np.empty((2, n, b, h), np.float32)
        kept = []
        for t in range(n):
            gx = np.stack([x[0][data[t]], x[1][data[n - 1 - t]]])
            gu = state @ u
            zr = _sigmoid(gx[..., :2 * h] + gu[..., :2 * h])
            z, r = zr[..., :h], zr[..., h:]
            c = np.tanh(gx[..., 2 * h:] + r * gu[..., 2 * h:])
            new = c + z * (state - c)
            if keep:
                kept.append((state, z, r, c, gu[..., 2 * h:]))
            state = states[:, t] = new
        return states, kept

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """Label probabilities of every position: (time, batch, L)."""
        states, _ = self._run(data, False)
        a = states[0] @ self.p["out"][:self.h] + states[1, ::-1] @ self.p["out"][self.h:] + self.p["bias"]
        a -= a.max(axis=-1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=-1, keepdims=True)
        return a

    def gradients(self, data: np.ndarray, label: np.ndarray):
        """Mean cross-entropy over all positions of (time, batch) and its gradients."""
        n, b, h = *data.shape, self.h
        states, kept = self._run(data, True)
        both = np.concatenate([states[0], states[1, ::-1]], axis=-1)
        a = both @ self.p["out"] + self.p["bias"]
        a -= a.max(axis=-1, keepdims=True)
        e = np.exp(a)
        p = e / e.sum(axis=-1, keepdims=True)
        loss = -np.log(p[:, np.arange(b), label] + 1e-12).mean()
        p[:, np.arange(b), label] -= 1
        p /= n * b
        g = {"out": both.reshape(-1, 2 * h).T @ p.reshape(n * b, -1), "bias": p.sum(axis=(0, 1)), "x": np.zeros_like(self.p["x"]), "u": np.zeros_like(self.p["u"])}
        back = p @ self.p["out"].T
        up = np.stack([back[..., :h], back[::-1, :, h:]])
        carry, u = np.zeros((2, b, h), np.float32), self.p["u"]
        for t in reversed(range(n)):  # through time
            state, z, r, c, uc = kept[t]
            d = up[:, t] + carry
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (state - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], axis=-1)
            dx = np.concatenate([dz, dr, dc], axis=-1)
            g["u"] += state.transpose(0, 2, 1) @ du
            np.add.at(g["x"][0], data[t], dx[0])
            np.add.at(g["x"][1], data[n - 1 - t], dx[1])
            carry = d * z + du @ u.transpose(0, 2, 1)
        return loss, g

    def fit(self, windows: np.ndarray, label: np.ndarray, steps: int = 350, batch: int = 128, rate: float = 0.02, seed: int = 11) -> float:
        """Adam with clipped gradients and a falling rate; ``windows``: bytes (rows, time).  Returns the last losses' mean."""
        rnd = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            i = rnd.integers(0, len(windows), batch)
            data = windows[i].T.copy()
            short = rnd.random(batch) < 0.15  # padded windows, as texts' last ones are
            data[:, short] *= (np.arange(len(data))[:, None] < rnd.integers(1, len(data) + 1, batch)[None, :])[:, short].astype(np.uint8)
            loss, g = self.gradients(data, label[i])
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            lr = rate * (1 - 0.9 * step / steps)
            for k in self.p:
                x = g[k] / max(1.0, norm)
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, chars: int) -> list:
    """At most ``per_language`` windows of each language (lang, window), each from a hashed place of a text that has a letter."""
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    n = F.char_length(text_col)
    at = F.pmod(F.xxhash64(h), F.greatest(n - chars + 1, F.lit(1))).cast("int") + 1
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), h.alias("h"), F.substr(F.col(text_col), at, F.lit(chars)).alias("window"))
    # a limit by language and hash bucket, which tasks apply before the exchange too; buckets spread a language over many tasks
    w = Window.partitionBy("lang", F.pmod("h", F.lit(_SAMPLE_BUCKETS))).orderBy("h", "window")
    each = max(1, per_language // _SAMPLE_BUCKETS)
    return sorted(map(tuple, rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= each).select("lang", "window").collect()))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
          window: int = WINDOW, hidden: int = HIDDEN, steps: int = 350) -> BiGRU:
    """Fit on at most ``per_language`` windows of each value of ``lang_col`` (the bounded sample); nulls in it are left out."""
    rows = training_windows(docs, id_col, text_col, lang_col, per_language, window)
    labels = sorted({lang for lang, _ in rows})
    net = BiGRU(labels, hidden)
    if rows:
        data = np.zeros((len(rows), window), np.uint8)
        for k, (_, text) in enumerate(rows):
            raw = text.encode()[:window]
            data[k, :len(raw)] = np.frombuffer(raw, np.uint8)
        net.fit(data, np.array([labels.index(lang) for lang, _ in rows]), steps)
    return net


def _positions(net: BiGRU, texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into windows: bytes (windows, time), each window's length and text number."""
    counts = np.array([-(-len(t) // window) for t in texts])
    data = np.zeros((counts.sum(), window), np.uint8)
    flat, at = data.reshape(-1), 0
    size = np.full(len(data), window)
    for t, c in zip(texts, counts):
        if c:
            flat[at:at + len(t)] = np.frombuffer(t, np.uint8)
            at += c * window
            size[at // window - 1] = len(t) - (c - 1) * window
    return data, size, np.repeat(np.arange(len(texts)), counts)


def pooled(net: BiGRU, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Mean probabilities over all positions of each text."""
    data, size, owner = _positions(net, texts, window)
    out = np.zeros((len(texts), len(net.labels)))
    for lo in range(0, len(data), _BATCH):
        part, n = data[lo:lo + _BATCH], size[lo:lo + _BATCH]
        p = net.probabilities(part.T)
        if (n < window).any():
            p *= (np.arange(window)[:, None] < n[None, :])[..., None]
        np.add.at(out, owner[lo:lo + _BATCH], p.sum(axis=0))
    return out / np.maximum(np.array([len(t) for t in texts]), 1)[:, None]


def label_spans(net: BiGRU, text: str, window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(start, end, language) of the runs of equally labelled bytes of a text."""
    data, size, _ = _positions(net, [text.encode()], window)
    if not len(data):
        return []
    label = np.concatenate([net.probabilities(data[k:k + 1].T)[:n, 0].argmax(axis=-1) for k, n in enumerate(size)])
    cut = np.flatnonzero(np.diff(label)) + 1
    return [(int(a), int(b), net.labels[label[a]]) for a, b in zip([0, *cut], [*cut, len(label)])]


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, net: BiGRU, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, lang_pred, score of every whole text: the language with the highest pooled probability, and that probability.

    ``und`` with score 0 for a text that is null or has no letter, and for all
    texts if nothing was learned.  Repeated rows give repeated rows; no shuffle; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = [t if t and net.labels and _LETTER.search(t) else None for t in part.column(1).to_pylist()]
                p = pooled(net, [t.encode() if t else b"" for t in texts], window) if net.labels else np.zeros((len(texts), 1))
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([net.labels[k] if t else UNKNOWN for t, k in zip(texts, best)], pa.string()),
                                                  pa.array([min(float(x), 1.0) if t else 0.0 for t, x in zip(texts, p.max(axis=1))], pa.float64())], schema=_OUT)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
