"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance of being toxic is a logistic function of the summed weights of its
different words, a word's weight being the sum of those of its whole and of its beginnings; the document's is the
noisy-or of its sentences. Only document labels are learned from: weights start at zero and stay there unless several
documents ask for them (an L1 penalty), so that what few labelled texts share by chance isn't learned. A sentence without
a word that has weight takes no part in scores, lest length alone make a text toxic. The sentences that carry a
document's score are then located.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_text, narrow, worker_own
from vellum.llm.cut import WHITE, Texts
from vellum.llm.labelled import bounded_sample, remainder

BITS = 18
SIZE = 1 << BITS
CACHE = 400_000
#: Rows that the model is fitted on at most, by label, and the bytes of text of each label's rows (by hash of doc_id, the first that fit).
MAX_FIT = {0: 4000, 1: 2000}
MAX_FIT_BYTES = 64 << 20
#: What a sentence is: it ends with an end mark, with its line, or with so many words.
MAX_WORDS = 64
PREFIXES = range(2, 9)
_END_MARKS, _CLOSERS, _EDGES = ".!?", "\"')]", ".,;:!?\"'()[]|*#%&$"


def word_features(word: str) -> list[int]:
    """Places of the word and of its beginnings of 2 to 8 letters; punctuation around it is dropped."""
    w = word.lower().strip(_EDGES)
    if not w:
        return []
    grams = {f"={w}", *(f"<{w[:n]}" for n in PREFIXES if n <= len(w))}
    return sorted({zlib.crc32(g.encode()) >> (32 - BITS) for g in grams})


def ends_sentence(part: str) -> bool:
    """Whether a sentence ends with this word and the white space behind it."""
    word = part.rstrip(WHITE)
    return "\n" in part[len(word) :] or word.rstrip(_CLOSERS).endswith(tuple(_END_MARKS))


class Sentences:
    """A batch of texts cut into words (each with the white space behind it) and these into sentences; a text without words is one empty sentence."""

    def __init__(self, column: pa.Array, info):
        """info: for a list of words an array of whatever is known of each, and whether it ends a sentence."""
        self.texts = texts = Texts(column)
        white = texts.white()
        begin = np.zeros(len(white), bool)
        begin[1:] = white[:-1] & ~white[1:]
        words, self.place, self.first = texts.parts(begin)
        self.starts = np.flatnonzero(begin)
        self.known, ends = info(words.to_pylist())
        n = len(self.place)
        opens = np.zeros(n + 1, bool)
        opens[1:] = np.append(ends[self.place[:-1]], True) if n else True
        opens[self.first[:-1]] = True
        opens = opens[:n]
        start = np.flatnonzero(opens)
        since = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        opens |= since % MAX_WORDS == 0
        number = np.cumsum(opens) - 1  # sentences that have words
        count = np.diff(np.append(0, np.cumsum(opens))[self.first])
        empty = count == 0
        # texts without words have a sentence too
        self.count = np.where(empty, 1, count)
        self.of_text = np.repeat(np.arange(len(count)), self.count)
        filled = np.flatnonzero(~empty[self.of_text])
        self.number = filled[number] if n else number
        self.begin = np.flatnonzero(opens)
        self.filled = filled

    def pairs(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, word's place) of each different word of each sentence, of words for which keep says so."""
        at = np.flatnonzero(keep[self.place])
        width = max(len(keep), 1)
        both = self.number[at] * width + self.place[at]
        del at
        both.sort()
        both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        return both // width, both % width


def noisy_or(z: np.ndarray) -> float:
    """1 - the product of the chances that each sentence isn't toxic."""
    return float(-np.expm1(-np.logaddexp(0, np.clip(z, -30, 30)).sum()))


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float


@dataclass
class Bags:
    """Sentences of labelled texts: features of words, words of sentences, sentences of texts."""

    feature: np.ndarray
    owner: np.ndarray
    word: np.ndarray
    sentence: np.ndarray
    bag: np.ndarray
    y: np.ndarray
    cost: np.ndarray
    n_words: int
    n_features: int

    def loss(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
        """The mean log loss of the noisy-or, and its gradient by w and, last, the bias."""
        of_word = np.bincount(self.owner, w[self.feature], self.n_words)
        z = np.clip(np.bincount(self.sentence, of_word[self.word], len(self.bag)) + bias, -30, 30)
        clean = np.bincount(self.bag, np.logaddexp(0, z), len(self.y))  # -log of the chance that no sentence is toxic
        toxic = np.maximum(-np.expm1(-clean), 1e-12)
        value = (self.cost * np.where(self.y == 1, -np.log(toxic), clean)).sum() / self.cost.sum()
        # by z: p where the label is 0, -p (1 - P) / P where it is 1
        outer = self.cost * np.where(self.y == 1, -(1 - toxic) / toxic, 1.0)
        g = outer[self.bag] / (1 + np.exp(-z))
        by_word = np.bincount(self.word, g[self.sentence], self.n_words)
        return float(value), np.append(np.bincount(self.feature, by_word[self.owner], self.n_features), g.sum()) / self.cost.sum()


def bags(texts: pa.Array, y: np.ndarray) -> tuple[Bags, np.ndarray]:
    """The texts' sentences, and the place of each feature that they have."""
    words: list[str] = []

    def info(found: list[str]):
        words.extend(found)
        return None, np.fromiter(map(ends_sentence, found), bool, len(found))

    cut = Sentences(texts, info)
    sentence, word = (x.astype(np.int32) for x in cut.pairs(np.ones(len(words), bool)))
    of_text = cut.of_text.astype(np.int32)
    del cut
    size, feature = array("i"), array("i")  # compact, as the driver holds them
    for x in words:
        own = word_features(x.rstrip(WHITE))
        feature.extend(own)
        size.append(len(own))
    feature, owner = np.frombuffer(feature, np.int32), np.repeat(np.arange(len(words), dtype=np.int32), np.frombuffer(size, np.int32))
    there = np.zeros(SIZE, bool)
    there[feature] = True
    places = np.flatnonzero(there)
    feature = (np.cumsum(there) - 1).astype(np.int32)[feature]
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    cost = np.where(y == 1, min(4.0, max(1.0, n0 / max(n1, 1))), 1.0)  # the rarer label counts up to four times
    return Bags(feature, owner, word, sentence, of_text, y, cost, len(words), len(places)), places


def fit_bags(texts: pa.Array, y: np.ndarray, rounds: int = 100, rate: float = 0.3, least: float = 2.0, share: float = 5.5e-4) -> Model:
    """Weights by proximal Adam steps on the loss and an L1 penalty: a feature must explain about `least` texts, and `share` of all."""
    weight = np.zeros(SIZE, np.float32)
    if len(set(y.tolist())) < 2:
        return Model(weight, -4.0)
    data, places = bags(texts, y)
    w, bias, penalty = np.zeros(len(places)), -4.0, max(share, least / data.cost.sum())
    m, v = np.zeros(len(places) + 1), np.zeros(len(places) + 1)
    for t in range(1, rounds + 1):
        _, grad = data.loss(w, bias)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        size = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        step = size * m / (1 - 0.9**t)
        w = w - step[:-1]
        w, bias = np.sign(w) * np.maximum(np.abs(w) - penalty * size[:-1], 0), bias - float(step[-1])
    weight[places] = w
    return Model(weight, bias)


def fit(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0, max_fit: dict[int, int] | None = None, max_bytes: int = MAX_FIT_BYTES) -> Model:
    """A model learned from labels.toxic of a bounded sample of the rows that aren't held out: `max_fit` rows and `max_bytes` of text of each label."""
    rows = bounded_sample(docs, labels, "toxic", divisor, held_out, max_fit or MAX_FIT, max_bytes)
    table = rows.select("doc_id", "text", "y").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit_bags(table.column("text").combine_chunks(), np.array(table.column("y").to_pylist(), np.int64))


class Scorer:
    """Scores batches by one model and keeps what it knows of words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def info(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE:
            self.known.clear()
        known, weight = self.known, self.model.weight
        for x in set(words) - known.keys():
            known[x] = float(weight[word_features(x.rstrip(WHITE))].sum()), ends_sentence(x)
        found = np.array([known[x] for x in words]).reshape(-1, 2)
        return found[:, 0], found[:, 1] > 0

    def score(self, column: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """Each text's score and the (start, end, score), in characters, of sentences that are toxic more likely than not, or of the likeliest; none for a score under one half."""
        cut = Sentences(column, self.info)
        sentence, word = cut.pairs(cut.known != 0)
        z = np.bincount(sentence, cut.known[word], len(cut.of_text)) + self.model.bias
        none = np.ones(len(z), bool)
        none[sentence] = False
        z = np.where(none, -30.0, np.clip(z, -30, 30))
        score = -np.expm1(-np.bincount(cut.of_text, np.logaddexp(0, z), len(cut.count)))
        spans: list[list[dict]] = [[] for _ in score]
        first = np.cumsum(cut.count) - cut.count
        begin = np.zeros(len(z) + 1, np.int64)  # each sentence's first word
        begin[cut.filled], begin[-1] = cut.begin, len(cut.place)
        starts = np.append(cut.starts, len(cut.texts.data))
        for t in np.flatnonzero(score >= 0.5).tolist():
            own = np.arange(first[t], first[t] + cut.count[t])
            if cut.first[t] == cut.first[t + 1]:
                continue
            base = int(cut.texts.offsets[t])
            for s in own[z[own] >= min(0.0, z[own].max())].tolist():
                last = cut.first[t + 1] if s == own[-1] else begin[s + 1]
                a, b = int(starts[begin[s]]), int(starts[last])
                text, at = cut.texts.data[a:b].tobytes().decode(), len(cut.texts.data[base:a].tobytes().decode())
                spans[t].append({"start": at + len(text) - len(text.lstrip(WHITE)), "end": at + len(text.rstrip(WHITE)), "score": float(1 / (1 + np.exp(-z[s])))})
        return score, spans


def score(docs: DataFrame, model: Model, divisor: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences) for every row; sentences: the spans that make a predicted document toxic.

    A null or empty text scores zero. Repeated rows are scored each for itself; a null doc_id isn't held out;
    columns other than doc_id and text are ignored; an empty table gives an empty one. Very long texts are scored whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        model = sent.value
        s, found = worker_own(("toxicity", id(model)), lambda: Scorer(model)).score(part.column("text"))
        return pa.record_batch([part.column("doc_id"), pa.array(s, pa.float64()), pa.array(found, spans)], ["doc_id", "score", "sentences"])

    docs = narrow(docs, "doc_id", "text")
    scored = map_text(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, sentences array<struct<start:int,end:int,score:double>>")
    held = F.coalesce(remainder(divisor) == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
