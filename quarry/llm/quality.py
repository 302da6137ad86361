"""Quality classifier: a generalised additive model with pairwise interactions.

Features are numbers of a whole text.  Each is cut into bins; cyclic boosting
goes round the features again and again, each time fitting one shallow tree on the
bins' gradients and adding it, damped, to the feature's lookup table.  Then the
pairs with the strongest interaction in the residual get tables of their own the
same way.  A score is the sum of looked-up numbers, so scoring is bin search and
additions over whole batches.  The fit uses a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import worker_state

MAX_TRAIN = 20_000
BINS, COARSE, PAIRS, ROUNDS, RATE = 48, 8, 8, 150, 0.1
FEATURES = ("log_chars", "log_words", "word_length", "distinct_words", "repeated_neighbours", "longest_repeat", "upper", "digits", "exclaims", "bars",
            "signs", "full_stops", "commas", "line_breaks", "line_length", "distinct_lines", "non_ascii", "ended_words", "capital_words")
_CLASSES = {"upper": range(65, 91), "digits": range(48, 58), "exclaims": b"!", "bars": b"|", "signs": b"#$%&*+<=>@[\\]^_`{}~/", "full_stops": b".?",
            "commas": b",;:", "line_breaks": b"\n", "non_ascii": range(128, 256)}
_CLASS_MATRIX = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_MATRIX[list(_bytes), _k] = 1


# ---------------------------------------------------------------- features
def features(text: str | None) -> list[float]:
    """The numbers of one whole text, in the order of FEATURES (a null text is empty; an empty text has zeros)."""
    text = text or ""
    raw = text.encode()
    share = dict(zip(_CLASSES, np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_MATRIX / max(len(raw), 1)))
    words = text.split()
    n, lines = max(len(words), 1), text.split("\n")
    same = list(map(operator.eq, words, words[1:]))
    longest = 0
    if any(same):
        longest = max(map(len, bytes(same).split(b"\0")))
    ended = sum(not w[-1].isalnum() for w in words)
    capital = sum(w[0].isupper() for w in words)
    out = share | {"log_chars": math.log1p(len(text)), "log_words": math.log1p(len(words)), "word_length": len(text) / n, "distinct_words": len(set(words)) / n,
                   "repeated_neighbours": sum(same) / n, "longest_repeat": math.log1p(longest), "line_length": math.log1p(len(text) / len(lines)),
                   "distinct_lines": len(set(lines)) / len(lines) if text else 0.0, "ended_words": ended / n, "capital_words": capital / n}
    return [float(out[f]) for f in FEATURES]


def _feature_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


# ---------------------------------------------------------------- the model
@dataclass
class AdditiveModel:
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)  # by feature: the bins' inner edges
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        total = np.full(len(x), self.intercept)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher"))


def _split(g: np.ndarray, h: np.ndarray, lo: int, hi: int):
    """Best cut of bins lo..hi-1 into two: (gain, place), by the gradients' sums."""
    if hi - lo < 2:
        return 0.0, lo
    cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
    left, right = cg[:-1] ** 2 / (ch[:-1] + 1), (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1)
    k = int((left + right).argmax())
    return float(left[k] + right[k] - cg[-1] ** 2 / (ch[-1] + 1)), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A shallow tree over one feature's bins: the value for each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, cut, part = max((*_split(g, h, *p), p) for p in parts)
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of depth two over a pair's cells, one cut of a row and in each half one of a column: (gain, value for each cell)."""
    best = (0.0, np.zeros_like(g))
    whole = g.sum() ** 2 / (h.sum() + 1)
    for cut in range(1, len(g)):
        out, gain = np.zeros_like(g), -whole
        for rows in (slice(0, cut), slice(cut, None)):
            cg, ch = g[rows].sum(axis=0), h[rows].sum(axis=0)
            _, at = _split(cg, ch, 0, len(cg))
            for cols in (slice(0, at), slice(at, None)):
                sg, sh = cg[cols].sum(), ch[cols].sum()
                out[rows, cols] = sg / (sh + 1)
                gain += sg ** 2 / (sh + 1)
        if gain > best[0]:
            best = (gain, out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
    """Fit on rows of features and 0/1 labels; one label alone gives a constant near it, no rows give 0.5."""
    m = AdditiveModel()
    k = x.shape[1]
    base = (y.sum() + 1) / (len(y) + 2)
    m.intercept = float(np.log(base / (1 - base)))
    m.cuts = [_edges(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(k)]
    m.coarse = [_edges(x[:, j], COARSE) if len(x) else np.zeros(0) for j in range(k)]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    if len(np.unique(y)) < 2:
        return m
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(m.cuts)]
    total = np.full(len(x), m.intercept)

    def slope():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):  # cyclic: one small tree a feature and round
            g, h = slope()
            n = len(m.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            m.tables[j] += step
            total += step[bins[j]]

    small = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(m.coarse)]

    def cells(a, b, v):
        shape = (len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)
        return np.bincount(small[a] * shape[1] + small[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = slope()
    strength = sorted(((_pair_tree(cells(a, b, g), cells(a, b, h))[0], a, b) for a in range(k) for b in range(a + 1, k)), reverse=True)[:pairs]
    m.pairs = [(a, b, np.zeros((len(m.coarse[a]) + 1, len(m.coarse[b]) + 1))) for gain, a, b in strength if gain > 0]
    for _ in range(rounds // 3):
        for a, b, table in m.pairs:
            g, h = slope()
            step = RATE * _pair_tree(cells(a, b, g), cells(a, b, h))[1]
            table += step
            total += step[small[a], small[b]]
    return m


# ---------------------------------------------------------------- the operator
def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN) -> DataFrame:
    """(id, label, features) of at most ``max_rows`` labelled rows, those with the smallest hashed ids (and texts, of one id)."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = _feature_rows(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows.tolist(), pa.list_(pa.float64()))], schema=schema)

    # the sample has ``max_rows`` short rows at most; an id may have several texts, so the bound holds for what comes out as well
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(
        run, "doc_id long, label int, x array<double>")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN) -> AdditiveModel:
    """Fit on a bounded sample of the documents that ``labels`` marks 0 or 1 (other labels and null ids are left out)."""
    rows = sorted(tuple(r) for r in training_rows(docs, labels, label_col, id_col, text_col, max_rows).collect())
    return fit(np.array([r[2] for r in rows], np.float64).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], np.float64))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, label 1) and predicted of every whole text; repeated rows give repeated rows; other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            p = model.score(_feature_rows(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model predicts as label 1, unchanged."""
    def run(batches: Iterator[pa.RecordBatch]):
        worker_state("quality", dict)  # what another operator has left in the worker goes
        for b in batches:
            p = model.score(_feature_rows(b.column(b.schema.get_field_index(text_col)).to_pylist()))
            yield b.filter(pa.array(p >= 0.5))

    return docs.mapInArrow(run, docs.schema)
