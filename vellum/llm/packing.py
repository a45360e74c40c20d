"""Best-fit packing by minimum bin slack.

Pieces are a histogram of lengths, so the plan is made from at most `capacity` numbers whatever the data. For each bin a
bitset subset-sum over the lengths that are left finds the fullest combination with the largest of them; that
combination is used as often as the counts allow, which uses up a length, so there are about as many steps as lengths.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.bpe import encoder
from vellum.llm.common import map_text, narrow

SALTS = 128  # parts into which the pieces of one length are ranked


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of a feasible combination with the largest length and the least slack; few, long pieces are preferred."""
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    room = capacity - lengths[0]
    full = (1 << room + 1) - 1
    reach, layers = 1, []
    for n in lengths:
        if n > room:
            continue
        left, size = counts[n] - (n == lengths[0]), 1
        while left > 0 and size * n <= room:  # one, two, four ... of this length
            take = min(size, left)
            new = (reach | reach << take * n) & full
            if new != reach:
                layers.append((n, take, reach))
                reach = new
            left -= take
            size *= 2
        if reach >> room & 1:
            break
    got = reach.bit_length() - 1
    chosen = {lengths[0]: 1}
    for n, take, before in reversed(layers):
        if not before >> got & 1:
            got -= take * n
            chosen[n] = chosen.get(n, 0) + take
    return sorted(chosen.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, per sequence, offset).

    The pieces of that length whose rank is in the range lie, `per sequence` to each, in consecutive sequences.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    out, sequence = [], 0
    while left:
        chosen = fullest(left, capacity)
        times = min(left[n] // k for n, k in chosen)
        at = 0
        for n, k in chosen:
            out.append((n, used[n], used[n] + k * times, sequence, k, at))
            at += n * k
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        sequence += times
    return out


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and `end_id`, cut into pieces of at most `capacity`."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        who, piece, start, length, crc = [], [], [], [], []
        flat, first = encoder(path).ids(part.column("text"))
        ids, first = memoryview(flat).cast("B"), first.tolist()
        for i, (low, high) in enumerate(zip(first, first[1:], strict=False)):
            for k, a in enumerate(range(low, high + 1, capacity)):  # one more than the text's own, for the end
                b = min(a + capacity, high + 1)
                whole = b <= high
                who.append(i)
                piece.append(k)
                start.append(a - low)
                length.append(b - a)
                x = zlib.crc32(ids[4 * a : 4 * min(b, high)])
                crc.append(x if whole else zlib.crc32(tail, x))
        return pa.record_batch([part.column("doc_id").take(pa.array(who, pa.int32())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = narrow(docs, "doc_id", "text")
    return map_text(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to `capacity`; other columns stay.

    `pieces` is read twice, for the histogram and to be placed, and must give the same rows both times (a checkpoint).
    To the driver come at most `capacity` x SALTS counts, and the plan of the same order goes back.
    """
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns]), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    table = counts.toPandas().sort_values(["length", "_salt"])
    histogram = {int(k): int(v) for k, v in table.groupby("length")["n"].sum().items()}
    base = np.zeros((capacity + 1, SALTS), np.int64)
    base[table["length"].to_numpy(), table["_salt"].to_numpy()] = table["n"].to_numpy()
    base = np.cumsum(base, axis=1) - base
    runs: dict[int, list[tuple]] = {}
    for n, *rest in plan(histogram, capacity):
        runs.setdefault(n, []).append(tuple(rest))
    runs_of = {n: np.array(x, np.int64).T for n, x in runs.items()}
    sent = pieces.sparkSession.sparkContext.broadcast((base[sorted(histogram)], {n: i for i, n in enumerate(sorted(histogram))}, runs_of))
    from pyspark.sql import Window

    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*[F.col(f"`{c}`") for c in pieces.columns])).cast("long") - 1)
    names = pieces.columns

    def run(batches):
        base, row_of, runs_of = sent.value
        for b in batches:
            n = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy() + base[[row_of[x] for x in n.tolist()], b.column("_salt").to_numpy()]
            seq, at = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
                size, r = int(n[some[0]]), rank[some]
                first, _, s0, per, off = runs_of[size]
                k = np.searchsorted(first, r, side="right") - 1
                r = r - first[k]
                seq[some], at[some] = s0[k] + r // per[k], off[k] + r % per[k] * size
            yield pa.record_batch([*[b.column(c) for c in names], pa.array(seq), pa.array(at)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row and its place.

    A null or empty text is one piece of one id. Repeated rows are packed each for itself; other columns are ignored; an
    empty table gives an empty one.
    """
    return place(pieces(docs, path, capacity, end_id).checkpoint(), capacity)
