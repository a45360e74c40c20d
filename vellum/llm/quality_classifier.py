"""Quality classifier: naive Bayes support vectors.

A text is the set of its hashed n-grams: words, word pairs, word shapes (runs of letters, digits and symbols), shape pairs,
and whether a word repeats the one before. Each indicator is scaled by the log ratio of its smoothed shares in the two
classes, counted over all labelled rows; a linear hinge-loss model is then fitted by dual coordinate descent, and a
logistic curve turns its margin into a score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_text, narrow, worker_own
from vellum.llm.labelled import bounded_sample, labelled_texts, remainder, training

BITS = 18
SIZE = 1 << BITS
CACHE = 400_000
#: Rows of each class, and bytes of their texts, that the hinge-loss model is fitted on at most; the log-count ratios use all labelled rows.
MAX_FIT = 3000
MAX_FIT_BYTES = 256 << 20
_RUNS = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"))


def shape(word: str) -> str:
    """Letter runs as a, A or Aa, digit runs as 0, symbols as they are."""
    letters = _RUNS[0].sub(lambda m: "a" if m[0].islower() else "A" if m[0].isupper() and len(m[0]) > 1 else "Aa", word)
    return _RUNS[1].sub("0", letters)


class Grams(dict):
    """Words to their places in tables of hashes; kept for each worker."""

    def __init__(self):
        self.words, self.shapes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
        self.seen = np.zeros(SIZE, bool)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        if i == len(self.words):
            self.words, self.shapes = np.resize(self.words, 2 * i), np.resize(self.shapes, 2 * i)
        self.words[i] = zlib.crc32(word.lower().encode())
        self.shapes[i] = zlib.crc32(shape(word).encode(), 1)
        return i

    def features(self, text: str | None) -> np.ndarray:
        """The sorted places, under SIZE, of the n-grams that the whole text has."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64)
        if len(self) > CACHE:
            self.clear()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        seen = self.seen
        for table, salt in ((self.words, 0x9E3779B1), (self.shapes, 0x85EBCA77)):
            h = table[ids]
            seen[(h * np.uint32(salt)) >> (32 - BITS)] = True
            seen[((h[:-1] * np.uint32(0xC2B2AE3D) ^ (h[1:] + np.uint32(salt))) * np.uint32(0x27D4EB2F)) >> (32 - BITS)] = True
        if (ids[1:] == ids[:-1]).any():
            seen[0] = True
        out = np.flatnonzero(seen)
        seen[out] = False
        return out


def grams() -> Grams:
    """One for each Python worker."""
    return worker_own("grams", Grams)


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # by place: hinge weight times log-count ratio
    ratio: np.ndarray  # by place: log-count ratio
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        if not len(features):
            return self.bias
        return float(self.weight[features].sum() / max(np.sqrt(np.square(self.ratio[features]).sum()), 1e-9)) + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -30, 30))))


def log_count_ratios(rows: DataFrame) -> np.ndarray:
    """The ratio of each n-gram's smoothed shares among rows (text, y), over all of them; at most SIZE counts come to the driver."""

    def count(batches):
        table = np.zeros((2, SIZE), np.int64)
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                table[y][grams().features(t)] += 1
        at = np.flatnonzero(table.any(axis=0))
        yield pa.record_batch([pa.array(at), pa.array(table[0][at]), pa.array(table[1][at])], ["f", "n0", "n1"])

    counts = rows.select("text", "y").mapInArrow(count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    p, q = np.ones(SIZE), np.ones(SIZE)
    at = counts.column("f").to_numpy()
    p[at] += counts.column("n1").to_numpy()
    q[at] += counts.column("n0").to_numpy()
    return np.log(p / p.sum()) - np.log(q / q.sum())


class Scaled:
    """The values of each row, made when asked for: the ratios at its places, scaled to length 1."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.rows, self.ratio = rows, ratio
        self.length = [max(np.sqrt(np.square(ratio[r]).sum()), 1e-9) for r in rows]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ratio[self.rows[i]] / self.length[i]


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray] | Scaled, y: np.ndarray, cost: float = 1.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss over sparse rows; y is 1 or -1."""
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            step = min(max(alpha[i] - (y[i] * (w[at] @ v + bias) - 1) / square[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w[at] += step * y[i] * v
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of the smoothed logistic fit of y (1 or 0) to margins."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, p = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        step = np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - s) - 1e-3 * p)
        p = p + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(p[0]), 1e-3), float(p[1])


def fit(docs: DataFrame, labels: DataFrame, divisor: int = 3, held_out: int = 1, max_fit: int = MAX_FIT, max_bytes: int = MAX_FIT_BYTES) -> Model:
    """A model learned from labels.quality of the rows that aren't held out; without such rows every score is one half."""
    docs = narrow(docs, "doc_id", "text")
    ratio = log_count_ratios(labelled_texts(docs, training(labels, "quality", divisor, held_out)))
    rows = bounded_sample(docs, labels, "quality", divisor, held_out, {0: max_fit, 1: max_fit}, max_bytes)

    def featurise(batches):
        for b in batches:
            rows = [grams().features(t).astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.record_batch([pa.array([r.tobytes() for r in rows], pa.binary()), b.column("y"), b.column("doc_id")], ["f", "y", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = rows.select("text", "y", "doc_id").mapInArrow(featurise, f"f binary, y int, doc_id {kind}").toArrow()
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("f", "ascending")]).to_numpy()
    y = table.column("y").to_numpy()[order].astype(np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(SIZE), ratio, 0.0, 1.0, 0.0)
    rows = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("f")]  # views: what came is the only copy that the driver holds
    rows = [rows[i] for i in order]
    values = Scaled(rows, ratio)
    w, bias = dual_coordinate_descent(rows, values, np.where(y == 1, 1, -1))
    margin = np.array([w[r] @ v + bias for r, v in zip(rows, values, strict=True)])
    slope, shift = logistic_curve(margin, y)
    return Model((w * ratio).astype(np.float32), ratio.astype(np.float32), float(bias), slope, shift)


def score(docs: DataFrame, model: Model, divisor: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    A null or empty text has no n-grams and gets the score of the bias. Repeated rows are scored each for itself; a null
    doc_id isn't held out; columns other than doc_id and text are ignored; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        m, g = sent.value, grams()
        s = [m.score(g.features(t)) for t in part.column("text").to_pylist()]
        return pa.record_batch([part.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    docs = narrow(docs, "doc_id", "text")
    scored = map_text(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(remainder(divisor) == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose predicted label is 1.

    A null or empty text is judged by the bias alone; repeated rows are judged each for itself; an empty table gives an
    empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text = names.index("text")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        m, g = sent.value, grams()
        return part.filter(pa.array([m.score(g.features(t)) >= 0.5 for t in part.column(text).to_pylist()], pa.bool_()))

    return map_text(docs, run, docs.schema)
