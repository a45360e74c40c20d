"""Exact removal of byte strings that repeat anywhere in the corpus, through suffix arrays over the places that can repeat.

1. Anchors. In each string of `least` bytes the leftmost smallest hash among its 48-byte substrings is its anchor. Equal
   strings have equal anchors at equal places, so what repeats is found among the contexts of equal anchors: up to
   `least` bytes before and after, which hold every string with that anchor.
2. Leaves. Equal contexts are one leaf of an anchor's suffix array, with a count; they are merged by hash (64 bits of the
   anchor and 64 of the context) before any text is moved. A leaf with two occurrences or more is a repeat throughout.
3. Tree. An anchor with several leaves, some of them single, has their contexts gathered and sorted by Spark. The
   common-prefix interval tree of that enhanced suffix array gives the maximal repeats with all their members.
4. Pieces. An anchor with more leaves than one task should hold is split by longer shared parts. A string of the anchor
   starts up to `least` - 48 bytes before it; halves of that range share a core, so contexts with equal cores (counted
   with partial sums) are a piece of the tree. Pieces are split on until each is small enough and goes to step 3. What
   all strings of a half cover together is counted too: where that repeats there is nothing left to find.
5. Each text's covered ranges are united and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, map_text, narrow, ready, slices, stored
from vellum.llm.cut import Texts, strings
from vellum.llm.suffix_array import common, maximal_repeats, neighbours, reach

GRAM = 48
#: Leaves that a piece of a tree is built from at most; with more it is split.
MAX_CONTEXTS = 4096
SLICE = 1 << 20

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _C[0]
    return x ^ x >> np.uint64(29)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


class Hashes:
    """Hashes of substrings of at least 8 bytes of some bytes."""

    def __init__(self, data: np.ndarray):
        n = self.n = max(len(data) - 7, 0)
        wide = np.zeros(n, np.uint64)
        for i in range(8):
            wide |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
        self.words = _mix(wide)
        power, self.inverse = _power(n + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.words * power[:n])])

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k bytes (a multiple of 8, up to 48) from each place."""
        m = max(self.n - k + 8, 0)
        out = np.zeros(m, np.uint64)
        for i in range(k // 8):
            out += self.words[8 * i : 8 * i + m] * _C[i]
        return _mix(out)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end - 7] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _C[1])


def anchors(grams: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """The places of the leftmost smallest gram of each window of so many grams; windows lie within [first, last) ranges."""
    n = len(grams)
    bits = np.uint64(max(n, 1).bit_length())
    key = (grams >> bits << bits) | np.arange(n, dtype=np.uint64)
    low, width = key, 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
        width *= 2
    rest = window - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:]) if len(low) > rest else low[:0]
    count = np.maximum(last - first - window + 1, 0)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, first[count > 0], 1)
    np.add.at(inside, (first + count)[count > 0], -1)
    valid = np.cumsum(inside[: len(low)]) > 0
    return np.unique((low[valid] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(k1, k2, doc_id, text) and more columns: null texts are empty; equal rows have equal keys, 96 bits wide."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
    return docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"), "doc_id", "text", *more)


def _contexts(docs: DataFrame, least: int) -> DataFrame:
    """(ah, ch, k1, at, form): the contexts of each text's anchors, in five longs.

    `at` holds k2 and the anchor's place, `form` the bytes before and from it and how often the context counts here; see _place().
    """
    window = least - GRAM + 1

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        size = pa.compute.binary_length(part.column("text")).to_numpy().astype(np.int64)
        text = part.column("text")
        whole = np.frombuffer(b"".join(t.encode() for t in text.to_pylist()), np.uint8)
        to = np.cumsum(size)
        h = Hashes(whole)
        grams = h.grams(GRAM)
        pos = anchors(grams, to - size, np.maximum(to - GRAM + 1, to - size), window)
        doc = np.searchsorted(to, pos, side="right")
        base = (to - size)[doc]
        start, end = np.maximum(base, pos - (least - GRAM)), np.minimum(to[doc], pos + least)
        ah = grams[pos]
        ch = h.of(start, end) + (pos - start).astype(np.uint64) * _C[2] if len(pos) else ah
        order = np.lexsort((pos, ch, ah, doc))
        doc, ah, ch, pos, start, end, base = (x[order] for x in (doc, ah, ch, pos, start, end, base))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])
        n = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(doc) else np.zeros(0, np.int64)
        # a context that its own text repeats is counted as two at its first place and as none at the others
        n = np.where(n == 1, 1, np.where(new, 2, 0))
        k2 = part.column("k2").to_numpy()[doc].astype(np.int64)
        columns = [ah.view(np.int64), ch.view(np.int64), part.column("k1").to_numpy()[doc], k2 << 32 | pos - base, (pos - start) << 32 | (end - pos) << 2 | n]
        return pa.record_batch([pa.array(x) for x in columns], ["ah", "ch", "k1", "at", "form"])

    return map_text(docs.select("k1", "k2", "text"), run, "ah long, ch long, k1 long, at long, form long", max_bytes=SLICE)


def _place() -> list[Column]:
    """k1, k2, pos, start and end from k1, at and form."""
    pos = F.col("at").bitwiseAND(0xFFFFFFFF)
    start, end = pos - F.shiftright("form", 32), pos + F.shiftright(F.col("form").bitwiseAND(0xFFFFFFFF), 2)
    return [F.col("k1"), F.shiftright("at", 32).cast("int").alias("k2"), pos.cast("int").alias("pos"), start.cast("int").alias("start"), end.cast("int").alias("end")]


def _cut_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (ah, ch, k1, k2, pos, start, end, single, hot) with the bytes of each context instead of its end."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("ah", "ch", "pos", "start", "end", "single", "hot")).alias("wanted"))
    joined = docs.join(lists.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "wanted")
    names = ("ah", "ch", "pos", "start", "single", "hot")

    def run(batches):
        met: set[tuple[int, int]] = set()  # equal rows, which share a task, have equal contexts: one will do
        for batch in batches:
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
            first = [k not in met and not met.add(k) for k in keys]
            for part in slices(batch.filter(pa.array(first, pa.bool_())), "text", 4 << 20):
                yield cut(part)

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column("wanted")
        flat = column.flatten()
        owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
        texts = Texts(part.column("text"))
        base = texts.offsets[owner].astype(np.int64)
        first, last = (base + flat.field(c).to_numpy() for c in ("start", "end"))
        data = texts.data.tobytes()
        held = pa.array([data[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
        return pa.record_batch([part.column("k1").take(pa.array(owner)), part.column("k2").take(pa.array(owner)), *(flat.field(c) for c in names), held], ["k1", "k2", *names, "bytes"])

    return joined.mapInArrow(run, "k1 long, k2 int, ah long, ch long, pos int, start int, single boolean, hot boolean, bytes binary")


SPAN = "k1 long, k2 int, start int, end int"


TREE = ("key", "ah", "ch", "k1", "k2", "pos", "single", "before", "after")


def _leaves(contexts: DataFrame, key: Column) -> DataFrame:
    """Rows of TREE: a context's leaf in the tree (or the piece of one) that `key` names."""
    return contexts.select(key.alias("key"), "ah", "ch", "k1", "k2", "pos", "single", F.expr("substring(bytes, 1, pos - start)").alias("before"), F.expr("substring(bytes, pos - start + 1)").alias("after"))


def _trees(leaves: DataFrame, least: int, fn, schema: str) -> DataFrame:
    """fn(rows of whole trees, in order; the first row of each; common prefixes of neighbours) over all trees, about SLICE bytes at a time.

    Spark sorts the suffixes. Trees of different anchors that share a key are one tree, which finds the same, as bytes are compared.
    """

    def trees(table: pa.Table):
        table = table.combine_chunks()
        key = table.column("key").to_numpy()
        offsets, data = strings(table.column("after").combine_chunks())
        lcp = neighbours(data, offsets.astype(np.int64), least)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return fn(table, first, lcp)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                held.append(batch.slice(i, 4096))
                size += held[-1].num_rows * least
                if size < SLICE:
                    continue
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                cut = int(np.flatnonzero(key == key[-1])[0])  # the last tree may go on
                if cut:
                    yield trees(table.slice(0, cut))
                    held, size = table.slice(cut).combine_chunks().to_batches(), (len(key) - cut) * least
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield trees(table)

    return leaves.select(*TREE).repartition("key").sortWithinPartitions("key", "after").mapInArrow(run, schema)


def _reached(least: int):
    """For _trees(): the spans of single leaves that repeats cover."""

    def spans(table: pa.Table, first: np.ndarray, lcp: np.ndarray) -> pa.RecordBatch:
        single = table.column("single").to_numpy()
        before = [x[::-1] for x in table.column("before").to_pylist()]
        n = len(before)
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        sizes = np.diff(np.append(first, n))
        two = first[sizes == 2]  # a tree of two leaves has one interval
        for i, h in zip(two.tolist(), lcp[two].tolist(), strict=True):
            if (l := common(before[i], before[i + 1])) + h >= least:
                low[i : i + 2], high[i : i + 2] = l, h
        for i, m in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            after = table.column("after").slice(i, m).to_pylist()
            for x, (l, h) in reach(before[i : i + m], after, least, lcp[i : i + m - 1].tolist()).items():
                low[i + x], high[i + x] = l, h
        at = np.flatnonzero((high > 0) & single)
        pos = table.column("pos").to_numpy()[at].astype(np.int64)
        k1, k2 = (table.column(c).to_numpy()[at] for c in ("k1", "k2"))
        return pa.record_batch([pa.array(k1), pa.array(k2), pa.array((pos - low[at]).astype(np.int32)), pa.array((pos + high[at]).astype(np.int32))], ["k1", "k2", "start", "end"])

    return spans


def _grouped(least: int):
    """For _trees(): (group, length, ah, ch, l) for each member of each maximal repeat, which starts l bytes before the member's anchor."""

    def groups(table: pa.Table, first: np.ndarray, lcp: np.ndarray) -> pa.RecordBatch:
        out = []
        ah, ch, key, after = (table.column(c).to_pylist() for c in ("ah", "ch", "key", "after"))
        before = [x[::-1] for x in table.column("before").to_pylist()]
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
            for l, h, members in maximal_repeats(before[i:j], after[i:j], least, lcp[i : j - 1].tolist()):
                name = hashlib.blake2b(before[i + members[0]][:l][::-1] + after[i + members[0]][:h], digest_size=8).digest()
                out += [(int.from_bytes(name, signed=True), l + h, ah[i + m], ch[i + m], l) for m in members]
        x = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.record_batch([pa.array(v, k) for v, k in zip(x, kinds, strict=True)], ["group", "length", "ah", "ch", "l"])

    return groups


def _by_halving(contexts: DataFrame, least: int, most: int, whole: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """The contexts of anchors with more than `most` leaves as pieces of at most `most`, and those that need no tree.

    A node is a range of `l`, how far before the anchor a string starts; a row is a context with its node. What all strings
    of a node share is its core, from -low to least - high; their union goes from -high to least - low. Rows with equal
    cores are a piece. Where a union repeats the rows are done (ah, ch, k1, k2, pos, open, low, high, all); unless `whole`
    says to keep all, one of them then stands for the others in the smaller nodes. A piece that is too large down to a
    single string ends there, as that string is then its core and its union.
    """
    reach = 1
    while reach < least - GRAM + 1:
        reach *= 2
    names = ["ah", "ch", "k1", "k2", "pos", "start", "bytes", "weight", "open", "low", "high"]
    rows = contexts.select("ah", "ch", "k1", "k2", "pos", "start", "bytes", F.when(F.col("single"), 1).otherwise(2).alias("weight"), F.col("single").alias("open"), F.lit(0).alias("low"), F.lit(reach - 1).alias("high"))
    schema = "ah long, ch long, k1 long, k2 int, pos int, start int, bytes binary, weight int, open boolean, low int, high int, core binary, all binary"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def halve(batches):
        for b in batches:
            rows = []
            for r in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                pos, start, data, low, high = r[4], r[5], r[6], r[9], r[10]
                a = pos - start
                lowest, highest = max(0, least - (len(data) - a)), a  # the strings that the context has
                mid = (low + high) // 2
                for x, y in ((low, mid), (mid + 1, high)):
                    if y < lowest or x > highest or x > y:
                        continue
                    # the core needs no more than the row's own strings in the node; partial rows never have a full union
                    core = hashlib.blake2b(data[a - x : a + least - y], digest_size=16).digest()
                    full = x >= lowest and y <= highest
                    union = hashlib.blake2b(data[a - y : a + least - x], digest_size=16).digest() if full else None
                    rows.append((*r[:9], x, y, core, union))
            x = list(zip(*rows, strict=True)) or [[]] * 13
            yield pa.record_batch([pa.array(v, k) for v, k in zip(x, kinds, strict=True)], [*names, "core", "all"])

    done, pieces, width = [], [], reach
    while width > 1:
        width //= 2
        rows = stored(rows.select(*names).mapInArrow(halve, schema))
        cores = rows.groupBy("ah", "low", "core").agg(F.sum("weight").alias("n_core"), F.count("*").alias("m"))
        unions = rows.where(F.col("all").isNotNull()).groupBy("ah", "low", "all").agg(F.sum("weight").alias("n_all"), F.min(F.struct("k1", "k2", "pos")).alias("first"))
        known = rows.join(cores, ["ah", "low", "core"]).where("n_core > 1").join(unions, ["ah", "low", "all"], "left")
        known = stored(known.select(*names, "core", "all", "n_core", "m", F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce(F.col("first") == F.struct("k1", "k2", "pos"), F.lit(False)).alias("is_first")))
        small = known.where(f"m <= {most}")
        pieces.append(_leaves(small.withColumnRenamed("open", "single"), F.xxhash64("ah", "low", "core")))
        known = known.where(f"m > {most}")
        done.append(known.where("n_all > 1").select("ah", "ch", "k1", "k2", "pos", "open", "low", "high", "all"))
        if whole:
            rows = known
            continue
        # those that repeat throughout go on as one partner, while others share their core
        left = known.where("n_all <= 1 or (is_first and n_core > n_all)")
        rows = left.withColumn("weight", F.expr("if(n_all > 1, 2, weight)")).withColumn("open", F.expr("open and n_all <= 1")).select(*names)
    return done, pieces


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, as ranges that don't touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _leaves_of(seen: DataFrame) -> DataFrame:
    """(ah, ch, n, k1, at, form): each different context, how often it occurs, and one occurrence."""
    # the first row of a context stands for it; which one that is makes no difference
    one = [F.first(c).alias(c) for c in ("k1", "at", "form")]
    return seen.groupBy("ah", "ch").agg(F.sum(F.col("form").bitwiseAND(3)).alias("n"), *one)


def _wanted(distinct: DataFrame, max_contexts: int) -> DataFrame:
    """The leaves of anchors that have several of which some are single."""
    many = distinct.groupBy("ah").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1").select("ah", (F.col("contexts") > max_contexts).alias("hot"))
    return distinct.join(many, "ah").select("ah", "ch", *_place(), (F.col("n") == 1).alias("single"), "hot")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def _all_leaves(contexts: DataFrame, least: int, max_contexts: int, whole: bool) -> tuple[DataFrame, list[DataFrame]]:
    """The leaves of all trees and pieces of trees, and what the splitting of large ones has done."""
    done, pieces = [], [_leaves(contexts.where("not hot"), F.col("ah"))]
    if contexts.where("hot").limit(1).count():
        done, more = _by_halving(contexts.where("hot"), least, max_contexts, whole)
        pieces += more
    return _union(pieces), done


def repeated_spans(keyed: DataFrame, least: int, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """(k1, k2, start, end): ranges that cover exactly the bytes of strings of `least` bytes that start twice or more."""
    seen = stored(_contexts(keyed, least))
    distinct = stored(_leaves_of(seen))
    twice = distinct.where("n > 1").select("ah", "ch")
    copies = stored(seen.join(twice, ["ah", "ch"]).select(*[c for i, c in enumerate(_place()) if i != 2]))
    wanted = stored(_wanted(distinct, max_contexts))
    discard(seen, distinct)  # the largest tables; what follows reads `wanted` and `copies`
    contexts = stored(_cut_contexts(keyed, wanted))
    discard(wanted)
    leaves, done = _all_leaves(contexts, least, max_contexts, False)
    spans = [copies, _trees(leaves, least, _reached(least), SPAN)]
    spans += [d.where("open").select("k1", "k2", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") + least - F.col("low")).alias("end")) for d in done]
    return _union(spans)


def repeat_groups(docs: DataFrame, least: int = 200, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """(group, length, doc_id, start): every occurrence, by byte offset, of each repeat of `least` bytes or more around an anchor.

    A group is a maximal repeat as far as the contexts reach (`least` bytes from the anchor): a longer one is several
    groups that overlap. Groups of leaves are named by their hash, those of trees by that of their bytes. Of anchors with
    more than `max_contexts` leaves also repeats that more than that many leaves share are groups, maximal or not. Null
    and empty texts are in none; equal rows are occurrences of their own; an empty table gives an empty one.
    """
    docs = ready(narrow(docs, "doc_id", "text"))
    keyed = _keyed(docs)
    seen = stored(_contexts(keyed, least))
    distinct = stored(_leaves_of(seen))
    contexts = stored(_cut_contexts(keyed, _wanted(distinct, max_contexts)))
    leaves, done = _all_leaves(contexts, least, max_contexts, True)
    size = F.shiftright("form", 32) + F.shiftright(F.col("form").bitwiseAND(0xFFFFFFFF), 2)
    parts = [distinct.where("n > 1").select(F.xxhash64("ah", "ch").alias("group"), size.cast("int").alias("length"), "ah", "ch", F.shiftright("form", 32).cast("int").alias("l"))]
    parts.append(_trees(leaves, least, _grouped(least), "group long, length int, ah long, ch long, l int"))
    parts += [d.select(F.xxhash64("ah", "low", "all"), F.col("high") - F.col("low") + least, "ah", "ch", "high") for d in done]
    found = _union(parts).distinct().join(seen, ["ah", "ch"]).select("group", "length", *_place()[:3], "l")
    return found.join(keyed.select("k1", "k2", "doc_id"), ["k1", "k2"]).select("group", "length", "doc_id", (F.col("pos") - F.col("l")).alias("start"))


def _with_spans(keyed: DataFrame, least: int, max_contexts: int) -> DataFrame:
    # equal rows have equal spans: one of each
    spans = repeated_spans(keyed, least, max_contexts)
    lists = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return keyed.join(lists.hint("shuffle_hash"), ["k1", "k2"], "left")


def _lists(part: pa.RecordBatch) -> list[list[tuple[int, int]]]:
    """Each row's united ranges."""
    column = part.column("spans")
    flat, offsets = column.values, column.offsets.to_numpy()
    a, b = flat.field("start").to_numpy(), flat.field("end").to_numpy()
    valid = column.is_valid().to_pylist()
    return [merged(list(zip(a[i:j].tolist(), b[i:j].tolist(), strict=True))) if v else [] for i, j, v in zip(offsets, offsets[1:], valid, strict=False)]


def dedup_digest(docs: DataFrame, least: int = 200, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row: what is left when all repeated bytes go.

    A null text is empty; texts of under `least` bytes lose nothing; matches never cross texts; a repeated row repeats the
    other, so both lose all that is in a string of `least` bytes. Other columns are ignored; an empty table gives an
    empty one. Equality of contexts is by 128 bits of hash; of strings in a suffix array by their bytes.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(part.column("text").to_pylist(), _lists(part), strict=True):
            data, at, digest = text.encode(), 0, hashlib.sha256()
            for a, b in spans:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
        x = list(zip(*out, strict=True)) or [[]] * 4
        return pa.record_batch([part.column("doc_id"), *[pa.array(v, pa.int64()) for v in x[:3]], pa.array(x[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _with_spans(_keyed(narrow(docs, "doc_id", "text")), least, max_contexts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(found.select("doc_id", "text", "spans"), run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_text(docs: DataFrame, least: int = 200, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with the repeated bytes cut out of each text, and n_chars as it then is.

    A range that begins or ends inside a character is cut back to whole ones. No row goes; a text may be left empty.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, spans in zip(part.column("text").to_pylist(), _lists(part), strict=True):
            if spans:
                data, at, kept = text.encode(), 0, []
                for a, b in spans:
                    while a < b and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    kept.append(data[at:a])
                    at = b
                text = b"".join([*kept, data[at:]]).decode()
            texts.append(text)
        size = pa.array([len(t) for t in texts], pa.int64())
        return pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string()), part.column("lang"), part.column("source"), size], ["doc_id", "text", "lang", "source", "n_chars"])

    keyed = _keyed(docs, "lang", "source")
    found = _with_spans(keyed, least, max_contexts).select("doc_id", "text", "lang", "source", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(found, run, f"doc_id {kind}, text string, lang string, source string, n_chars long")
