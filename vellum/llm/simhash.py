"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Equal fingerprints are one row. Fingerprints that differ in at most k bits agree on one of k + 1 blocks, and on one of
k + 1 parts of the other bits, so each goes to the (k + 1) squared lists of these; a list holds about the fingerprints
that agree on some 28 bits. In a task the lists are sorted by Gray rank, runs of neighbours become nodes, and each node
keeps the bits that all below it share and its parent does not. A search adds up differences on the way down and drops a
node, with all below it, beyond k. Nodes whose members can't differ by more than k are taken whole, and nodes that are
already tied to the searcher are skipped, so a dense group costs about its size and yields a star, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, map_text, narrow, stored
from vellum.llm.components import components, unite

FAN = 8
FRONTIER = 1 << 18  # nodes that a search opens at once; FAN at least
PLACE_BITS = 20  # shingles are counted by this many bits of their hash, however many there are
PLACES = 1 << PLACE_BITS
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of so many words, repeats included; fewer words: the whole sequence; no word: none."""
    import xxhash

    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else iter([b" ".join(w)])
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(1, len(w) - words + 1))


def majority(h: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes; of none: zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): every row's fingerprint as a signed long."""
    make = partial(fingerprint, words=words, seed=seed)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([make(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.record_batch([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    docs = narrow(docs, "doc_id", "text")
    return map_text(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


#: Odd multipliers of the min-wise hashes, and the pairs of these that make a list; no two lists share one.
MINS = tuple(int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1 for i in range(24))
PAIRS = tuple((i, i + 1) for i in range(0, 24, 2))


def min_lists(h: np.ndarray) -> list[int]:
    """For each pair of min-wise hashes the list that a set of shingles is in, as a signed number."""
    if not len(h):
        return [0] * len(PAIRS)
    mins = [((h ^ h >> np.uint64(31)) * np.uint64(m)).min() for m in MINS]
    return [int((np.uint64(i + 1) * mins[a] + (mins[b] ^ mins[b] >> np.uint64(29)) * np.uint64(MINS[2])).astype(np.int64)) for i, (a, b) in enumerate(PAIRS)]


def shingle_set(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The different shingle hashes in rising order."""
    return np.unique(shingle_hashes(text, words, seed))


def sketches(docs: DataFrame, words: int, seed: int = 42) -> DataFrame:
    """(k1, k2, doc_id, fp, node, lists): the fingerprint of each row's shingle set, a hash of the set, and the lists in which similar sets meet."""
    make = partial(shingle_set, words=words, seed=seed)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        sets = [make(t) for t in part.column("text").to_pylist()]
        fp = np.array([majority(h) for h in sets], np.uint64).view(np.int64)
        node = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
        with np.errstate(over="ignore"):
            lists = [min_lists(h) for h in sets]
        return pa.record_batch([*(part.column(c) for c in ("k1", "k2", "doc_id")), pa.array(fp), pa.array(node), pa.array(lists, pa.list_(pa.int64()))], ["k1", "k2", "doc_id", "fp", "node", "lists"])

    return map_text(docs, run, f"k1 long, k2 int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, node long, lists array<long>")


def shingle_sets(docs: DataFrame, words: int, seed: int = 42) -> DataFrame:
    """(node, n, h): each row's shingle set, its hash and its size."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        sets = [shingle_set(t, words, seed) for t in part.column("text").to_pylist()]
        node = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
        n = np.array([len(h) for h in sets], np.int64)
        return pa.record_batch([pa.array(node), pa.array(n), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["node", "n", "h"])

    return map_text(docs, run, "node long, n long, h array<long>")


def blocks(k: int) -> list[int]:
    """(k + 1) squared masks; any two 64-bit numbers that differ in at most k bits agree on all bits of one of them."""

    def cut(bits: list[int]) -> list[list[int]]:
        return [bits[i * len(bits) // (k + 1) : (i + 1) * len(bits) // (k + 1)] for i in range(k + 1)]

    out = []
    for a in cut(list(range(64))):
        rest = [b for b in range(64) if b not in a]
        out += [sum(1 << x for x in a + b) for b in cut(rest)]
    return out


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each number in the Gray sequence."""
    out = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Hierarchical index over lists of fingerprints; `key` says which list a row is in."""

    def __init__(self, key: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), key))
        self.key, self.fp, self.order = key[order], fp[order], order
        n = len(fp)
        first, last = np.arange(n), np.arange(1, n + 1)
        shared, value = np.full(n, ONES), self.fp
        group = np.concatenate([[0], np.cumsum(self.key[1:] != self.key[:-1])]) if n else np.zeros(0, np.int64)
        self.levels = [(first, last, shared, value, None, None)]
        while n and len(group) > group[-1] + 1:  # until each list has one node
            start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            place = np.arange(len(group)) - np.repeat(start, np.diff([*start, len(group)]))
            head = np.flatnonzero(place % FAN == 0)
            low = np.bitwise_and.reduceat(shared & value, head)
            none = np.bitwise_and.reduceat(shared & ~value, head)
            a, b = head, np.append(head[1:], len(group))
            first, last, shared, value, group = first[a], last[b - 1], low | none, low, group[head]
            self.levels.append((first, last, shared, value, a, b))
        # each node's own bits: those that its parent does not hold
        self.own = [None] * len(self.levels)
        self.own[-1] = self.levels[-1][2] if n else None
        for d in range(len(self.levels) - 1, 0, -1):
            _, _, shared, _, a, b = self.levels[d]
            self.own[d - 1] = self.levels[d - 1][2] & ~np.repeat(shared, b - a)
        self.list_of = np.cumsum(np.concatenate([[0], self.key[1:] != self.key[:-1]])).astype(np.int64) if n else np.zeros(0, np.int64)

    def tie(self, k: int) -> np.ndarray:
        """For each row (in index order) the least row that links of at most k bits, over all lists, tie it to."""
        n = len(self.fp)
        same = np.unique(self.fp, return_inverse=True)[1]
        label = np.zeros(0, np.int64)
        first_of = np.full(same.max() + 1 if n else 0, n, np.int64)
        np.minimum.at(first_of, same, np.arange(n))
        label = first_of[same]
        for first, last, shared, *_ in self.levels[1:]:  # nodes whose members are all within k of each other
            tight = np.flatnonzero(64 - np.bitwise_count(shared) <= k)
            size = last[tight] - first[tight] - 1
            a = np.repeat(first[tight], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            label = unite(label, a, a + 1)
        at, step = 0, 512
        while at < n:
            q = np.arange(at, min(at + step, n))
            at, step = at + step, min(2 * step, 1 << 15)
            label = self._search(q, k, label)
        return label

    def _search(self, q: np.ndarray, k: int, label: np.ndarray) -> np.ndarray:
        """label after tying rows q to all later rows of their lists within k.

        Depth first, in parts that open about FRONTIER nodes at once: whatever the length of a list, memory is bounded
        by the levels, and what a part ties is skipped by the next ones.
        """
        top = len(self.levels) - 1
        label, *part = self._reach(top, q, self.list_of[q], np.zeros(len(q), np.int64), k, label)
        stack = [(top, *part)]
        while stack:
            d, q, node, diff = stack.pop()
            if not d or not len(q):
                continue
            a, b = self.levels[d][4:]
            size = b[node] - a[node]
            upto = np.cumsum(size)
            if upto[-1] > FRONTIER:
                ends = [0, *(np.flatnonzero(np.diff((upto - 1) // FRONTIER)) + 1).tolist(), len(q)]
                stack += [(d, q[i:j], node[i:j], diff[i:j]) for i, j in zip(ends[-2::-1], ends[:0:-1], strict=True)]
                continue
            child = np.repeat(a[node] - upto + size, size) + np.arange(upto[-1])
            label, *part = self._reach(d - 1, np.repeat(q, size), child, np.repeat(diff, size), k, label)
            stack.append((d - 1, *part))
        return label

    def _reach(self, d: int, q: np.ndarray, node: np.ndarray, diff: np.ndarray, k: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """label, with what nodes of level d settle, and the q, node and diff that are to be searched below."""
        first, last, shared, value, *_ = self.levels[d]
        diff = diff + np.bitwise_count((self.fp[q] ^ value[node]) & self.own[d][node])
        go = (diff <= k) & (last[node] > q + 1)
        if d:
            low, high = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
            go &= ~((low[node] == label[q]) & (high[node] == label[q]))
        q, node, diff = q[go], node[go], diff[go]
        whole = diff + 64 - np.bitwise_count(shared[node]) <= k if d else np.ones(len(q), bool)
        if whole.any():
            label = unite(label, q[whole], first[node[whole]])
            q, node, diff = q[~whole], node[~whole], diff[~whole]
        return label, q, node, diff


def pigeonhole(fps: DataFrame, k: int) -> DataFrame:
    """(fp, block, bits): the lists of each different fingerprint; any two that differ in at most k bits share one."""
    masks = blocks(k)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    lists = F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])
    return fps.select("fp").distinct().select("fp", F.explode(lists).alias("l")).select("fp", "l.block", "l.bits")


def links(rows: DataFrame, k: int = 3) -> DataFrame:
    """(a, b): ties between different fingerprints whose components are those of all links of at most k bits within lists (fp, block, bits)."""

    def run(batches):
        parts = [(b.column("fp").to_numpy(), b.column("block").to_numpy(), b.column("bits").to_numpy()) for b in batches]
        if not parts:
            return
        fp, block, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((bits, block))
        fp, block, bits = fp[order].view(np.uint64), block[order], bits[order]
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (bits[1:] != bits[:-1])])
        key = np.cumsum(new)
        many = np.bincount(key)[key] > 1
        key, fp = key[many], fp[many]
        index = GrayIndex(key, fp)
        label = index.tie(k)
        at = np.flatnonzero(label != np.arange(len(label)))
        a, b = index.fp[at], index.fp[label[at]]
        go = a != b
        pair = np.unique(np.stack([a[go], b[go]], 1).view(np.int64), axis=0)
        yield pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return rows.repartition("block", "bits").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, words: int = 3, k: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): every row with the least doc_id that links reach.

    Texts that are null, empty or without a word have fingerprint zero and are linked like any other. Repeated rows and
    texts share a component. A row without doc_id is linked but names no component. Other columns are ignored; an empty
    table gives an empty one. Texts are hashed once; fingerprints stay distributed.
    """
    made = fingerprints(docs, words, seed).checkpoint()
    return _named(made, links(pigeonhole(made, k), k))


def _named(made: DataFrame, ties: DataFrame) -> DataFrame:
    """made (doc_id, fp) with component_id, the least doc_id that ties between fingerprints reach."""
    firsts = made.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
    tied = components(ties)
    rooted = firsts.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")).checkpoint()
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).checkpoint()
    named = rooted.join(least, "root").select("fp", "component_id").checkpoint()
    return made.join(named, "fp").select("doc_id", "fp", "component_id")


def row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2")]


def bits_at(similarity: float) -> int:
    """The bits that fingerprints of sets with this Jaccard similarity differ in at most: the mean and six sigma (26 at 0.8)."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(64 * p + 6 * math.sqrt(64 * p * (1 - p)))


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each of PLACES places by the upper bits of their hash; that many numbers come to the driver at most."""

    def count(batches):
        table = np.zeros(PLACES, np.int64)
        for b in batches:
            table += np.bincount(_places(b.column("h").flatten().to_numpy()), minlength=PLACES)
        at = np.flatnonzero(table)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(table[at])], ["p", "c"])

    found = sets.select("h").mapInArrow(count, "p int, c long").groupBy("p").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(PLACES, np.int64)
    out[found.column("p").to_numpy()] = found.column("c").to_numpy()
    return out


def _places(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def postings(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(h, node, n, pos): the shingles, rarest first, of which two sets with a Jaccard similarity of num / den share one.

    A set of n shingles needs num / den of them in common with the other, so one of the first n - ceil(n num / den) + 1
    is, in whatever order all sets are sorted. That is by the count of the shingle's place, then its hash: a place that
    holds a frequent shingle comes late. pos is the shingle's place in the set; those alone in theirs are left out.
    """
    sent = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))

    def run(batches):
        counts = sent.value
        for batch in batches:
            ends = np.cumsum(batch.column("n").to_numpy())
            i = 0
            while i < batch.num_rows:  # some half million shingles at a time
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 19), side="right")))
                part = batch.slice(i, j - i)
                i = j
                h, n = part.column("h").flatten().to_numpy(), part.column("n").to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                c = counts[_places(h)]
                order = np.lexsort((h, c, row))
                h, c = h[order], c[order]
                pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                keep = (c > 1) & ((n[row] - pos) * den >= n[row] * num)
                node, pos = part.column("node").to_numpy()[row[keep]], pos[keep]
                yield pa.record_batch([pa.array(x) for x in (h[keep], node, n[row[keep]], pos)], ["h", "node", "n", "pos"])

    each = sets.select("h", "node", "n").mapInArrow(run, "h long, node long, n long, pos long")
    return each


def pairs(rows: DataFrame, low: int, high: int, num: int, den: int) -> DataFrame:
    """(a, b): pairs of different labels, `low` to `high` - 1 places apart within a shingle of rows (h, node, n, pos, label), that can be similar.

    The first shingle that two sets share has all they share behind it in both, so pairs with too few there are left out.
    """

    def run(batches):
        parts = [[b.column(c).to_numpy() for c in ("h", "node", "n", "pos", "label")] for b in batches]
        if not parts:
            return
        h, node, n, pos, label = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((node, n, h))
        h, node, n, pos, label = (x[order] for x in (h, node, n, pos, label))
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff([*first, len(h)])
        start, end = np.repeat(first, size), np.repeat(first + size, size)
        # every pair has a row whose label is not the commonest of its shingle
        label = np.unique(label, return_inverse=True)[1]
        both, at, count = np.unique(start * (label.max() + 1) + label, return_inverse=True, return_counts=True)
        most = np.lexsort((count, both // (label.max() + 1)))
        most = most[np.concatenate([np.diff(both[most] // (label.max() + 1)) > 0, [True]])]
        rest = np.flatnonzero(~np.isin(at, most))
        for off in range(low, high):
            rest = rest[end[rest] - start[rest] > off]
            if not len(rest):
                break
            q, j = np.concatenate([rest, rest]), np.concatenate([rest - off, rest + off])
            go = (j >= start[q]) & (j < end[q])
            q, j = q[go], j[go]
            go = (label[q] != label[j]) & (np.minimum(n[q] - pos[q], n[j] - pos[j]) * (num + den) >= num * (n[q] + n[j]))
            q, j = q[go], j[go]
            found = np.unique(np.stack([np.minimum(node[q], node[j]), np.maximum(node[q], node[j])], 1), axis=0)
            yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return rows.repartition("h").mapInArrow(run, "a long, b long").distinct()


def similar(found: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of which the sets have a Jaccard similarity of num / den or more."""
    one, other = (sets.select(F.col("node").alias(x), F.col("h").alias(f"h{x}")) for x in "ab")
    same = F.size(F.array_intersect("ha", "hb"))
    return found.join(one, "a").join(other, "b").where(same * (num + den) >= num * (F.size("ha") + F.size("hb"))).select("a", "b")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(node, root, first): each different shingle set, the component that it is in, and the least row (none, doc_id, k1, k2) that has it.

    Rows without doc_id come after the others.

    Sets are tied if their Jaccard similarity is `similarity` or more, which is decided by the sets themselves. Lists by
    pairs of min-wise hashes, searched through the Gray-order index with a wide bound of bits, only name the sets that
    may have a fellow; sets at 0.8 miss all twelve with a chance of (1 - 0.64)^12, about 5 in a million. Among these, pairs come from shared rare shingles, neighbours first; what is by then tied is not
    compared, so a dense group costs about its size.
    """
    num, den = Fraction(str(similarity)).as_integer_ratio()
    docs = narrow(docs, "doc_id", "text").select(*row_key(), "doc_id", "text")
    made = sketches(docs, words, seed).checkpoint()
    rows = made.select("fp", F.posexplode("lists").alias("block", "bits")).distinct()
    ties = links(rows, bits_at(similarity)).checkpoint()
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    nodes = made.groupBy("fp", "node").agg(F.min(row).alias("first")).checkpoint()
    near = ties.select(F.col("a").alias("fp")).union(ties.select("b")).union(nodes.groupBy("fp").count().where("count > 1").select("fp")).distinct()
    chosen = nodes.join(near, "fp", "left_semi").select("first.k1", "first.k2")
    sets = stored(shingle_sets(docs.join(chosen.hint("shuffle_hash"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), words, seed))
    each = stored(postings(sets, num, den))
    shared = each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    left = stored(each.join(shared, "h", "left_semi").withColumn("label", F.col("node")))
    discard(each)
    root, low, high = None, 1, 5
    while not left.isEmpty():
        found = similar(pairs(left, low, high, num, den), sets, num, den)
        root = components(found if root is None else found.union(root.select("node", "root"))).checkpoint()
        named = left.drop("label").join(root, "node", "left").select("h", "node", "n", "pos", F.coalesce("root", "node").alias("label"))
        open_ = named.groupBy("h").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).where(f"m > {high} and x != y")
        last, left = left, stored(named.join(open_, "h", "left_semi"))
        discard(last)  # and the shuffles of the round
        low, high = high, 8 * high
    discard(left)
    discard(sets)
    if root is None:
        return nodes.select("node", F.col("node").alias("root"), "first")
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row, with all its columns, of each group of similar texts: that with the least doc_id, or without one if none has any.

    Rows are told apart by hashes of doc_id and text, so different texts under one doc_id are different rows.
    """
    kept = similar_groups(docs, words, similarity).groupBy("root").agg(F.min("first").alias("first")).select("first.k1", "first.k2")
    keyed = docs.select("*", *row_key())
    return keyed.join(kept.hint("shuffle_hash"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(docs.columns)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
