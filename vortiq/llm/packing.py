"""Packing of tokenized documents into fixed-length sequences as a cutting-stock problem.

Every document's ids (with an end id) are cut into full pieces of the sequence length and one remainder. The histogram
of lengths (at most `size` numbers, whatever the corpus) goes to the driver; there a linear program over patterns is
solved by column generation: duals price the lengths, an unbounded knapsack by dynamic programming finds the pattern
of least reduced cost, until none is left or the bound shows the gap to be small. Rounded patterns become intervals of
ranks within each length, and every piece finds its place from its own rank.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"
_ENCODINGS: dict[tuple, object] = {}


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies in JSON use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def encoding(path: str, pattern: str):
    """The byte-level BPE of a tokenizers JSON file, run by its ranks; one a worker process.

    In such a file the ids of merged tokens follow the order of the merges, so ranks say the same as the merge list.
    The strings of the file's added tokens stand for their ids wherever a text holds them, as they do in the tokenizers
    library unless it is told to encode them like other text.
    """
    import tiktoken

    if (path, pattern) not in _ENCODINGS:
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODINGS[path, pattern]


def pieces(docs: DataFrame, path: str, pattern: str, size: int, end_id: int) -> DataFrame:
    """Pieces of every document; (part, nth) number the pieces of one length within a task, for ranks without a sort."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoding(path, pattern), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(enc.encode_to_numpy(text.as_py() or "", allowed_special="all"), end_id).astype("<u4")
                for start in range(0, len(ids), size):
                    own = ids[start : start + size]
                    rows.append((doc, start, len(own), zlib.crc32(own.tobytes()), len(ids), part, seen[len(own)]))
                    seen[len(own)] += 1
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=PIECES.replace(" long", "").split(", "))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class Knapsack:
    """Most valuable multiset of lengths with each exact total up to size, every length any number of times."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.lengths, self.size = lengths, size

    def solve(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, last = np.full(self.size + 1, -np.inf), np.full(self.size + 1, -1)
        best[0] = 0
        for total in range(1, self.size + 1):
            n = np.searchsorted(self.lengths, total, "right")
            if n:
                got = best[total - self.lengths[:n]] + values[:n]
                k = int(got.argmax())
                if got[k] > -np.inf:
                    best[total], last[total] = got[k], k
        return best, last

    def pattern(self, last: np.ndarray, total: int) -> Counter:
        out: Counter = Counter()
        while total:
            out[int(last[total])] += 1
            total -= int(self.lengths[last[total]])
        return out


def padded(total: int, size: int) -> int:
    """What a sequence of so many tokens takes: a power of two stays as it is."""
    return total if total & (total - 1) == 0 else size


def exact_patterns(demand: dict[int, int], size: int, grain: int) -> list[tuple[int, list[int]]]:
    """patterns() over lengths rounded up to multiples of grain, then split into patterns of the exact lengths.

    The pieces of a rounded length are dealt to its places in order of exact length, so the number of patterns grows
    by one at each change of exact length at most; a pattern wastes less than grain tokens a piece.
    """
    grouped: Counter = Counter()
    for x, n in demand.items():
        grouped[-(-x // grain)] += n
    queues = {g: [[x, demand[x]] for x in sorted(demand, reverse=True) if -(-x // grain) == g and demand[x]] for g in grouped}
    out = []
    for times, groups in patterns(grouped, size // grain):
        # each place of the pattern takes its own run of `times` pieces
        runs = []
        for g in groups:
            run, missing = [], times
            while missing:
                x, n = queues[g][-1]
                got = min(n, missing)
                run.append([x, got])
                missing -= got
                if got == n:
                    queues[g].pop()
                else:
                    queues[g][-1][1] -= got
            runs.append(run[::-1])
        while times:
            n = min(run[-1][1] for run in runs)
            out.append((n, [run[-1][0] for run in runs]))
            times -= n
            for run in runs:
                run[-1][1] -= n
                if not run[-1][1]:
                    run.pop()
    return out


def patterns(demand: dict[int, int], size: int, gap: float = 5e-4, rounds: int = 4000) -> list[tuple[int, list[int]]]:
    """(times, lengths) of whole patterns that hold exactly the demand: {length: count}, lengths below size.

    Column generation by a revised simplex from one-length patterns; stops when no column improves or when the
    cost is within `gap` of the number of tokens, a lower bound. Fractions are rounded down, then up where the demand allows, and the few
    pieces left over are placed best fit, longest first.
    """
    lengths = np.array(sorted(x for x in demand if demand[x] > 0))
    if not len(lengths):
        return []
    need, m = np.array([float(demand[int(x)]) for x in lengths]), len(lengths)
    sack, powers = Knapsack(lengths, size), [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    columns = [Counter({i: size // int(x)}) for i, x in enumerate(lengths)]
    cost = np.array([float(padded(int(x) * (size // int(x)), size)) for x in lengths])
    inverse = np.diag([1.0 / (size // int(x)) for x in lengths])
    level = inverse @ need
    lower = float(lengths @ need)
    for _ in range(rounds):
        duals = cost @ inverse
        if cost @ level <= lower * (1 + gap):
            break
        # The lengths themselves are feasible duals, near the best ones; prices halfway to them keep columns from
        # swinging to and fro. Where these find nothing, the plain duals decide.
        for steady in (0.8, 0.0):
            best, last = sack.solve(steady * lengths + (1 - steady) * duals)
            top = int(best.argmax())
            found = [(sack.pattern(last, t), t) for t in {top, *powers} if best[t] > -np.inf]
            gain, column, total = max(((sum(duals[i] * k for i, k in c.items()) - padded(t, size), c, t) for c, t in found), key=lambda x: x[0])
            if gain > 1e-7 * size:
                break
        else:
            break
        way = inverse[:, list(column)] @ np.array([float(x) for x in column.values()])
        usable = way > 1e-9
        step = np.where(usable, level / np.where(usable, way, 1), np.inf)
        out = int(step.argmin())
        level = np.maximum(level - step[out] * way, 0)
        level[out] = step[out]
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        columns[out], cost[out] = column, float(padded(total, size))
    left = {i: int(n) for i, n in enumerate(need)}
    times = []
    for column, x in zip(columns, level):
        n = min([int(x + 1e-6), *(left[i] // k for i, k in column.items())])
        times.append(n)
        for i, k in column.items():
            left[i] -= n * k
    for j in np.argsort(-(level - np.array(times)), kind="stable"):
        column = columns[j]
        if level[j] - times[j] > 0.2 and all(left[i] >= k for i, k in column.items()):
            times[j] += 1
            for i, k in column.items():
                left[i] -= k
    out = [(n, [int(lengths[i]) for i, k in sorted(c.items(), reverse=True) for _ in range(k)]) for n, c in zip(times, columns) if n]
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(left, reverse=True):
        for _ in range(left[i]):
            x = int(lengths[i])
            at = bisect_left(rooms, (x, -1))
            room, k = rooms.pop(at) if at < len(rooms) else (size, len(bins))
            if k == len(bins):
                bins.append([])
            bins[k].append(x)
            insort(rooms, (room - x, k))
    return out + [(n, list(b)) for b, n in Counter(tuple(b) for b in bins).items()]


def slots(plan: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Of each length: intervals (first rank, first sequence, offset), in order of rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    filled: Counter = Counter()
    first = 0
    for n, lengths in plan:
        offset = 0
        for x in lengths:
            out.setdefault(x, []).append((filled[x], first, offset))
            filled[x] += n
            offset += x
        first += n
    return {x: np.array(v, dtype=np.int64) for x, v in out.items()}


def pack(docs: DataFrame, path: str, pattern: str, size: int = 1024, end_id: int = 0, grain: int = 8) -> DataFrame:
    """Places every piece of every document in a sequence of at most `size` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text counts as empty and so has
    the end id alone; a null doc_id stays null; repeated rows are documents of their own; other columns are ignored.
    An empty table gives an empty result. Only the histogram of lengths (at most `size` rows) reaches the driver.
    """
    cut = materialize(pieces(docs, path, pattern, size, end_id), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "lengths")
    demand = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = exact_patterns({x: n for x, n in demand.items() if x < size}, size, grain)
    if demand.get(size):
        plan.append((demand[size], [size]))
    place = slots(plan)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = cut.join(before, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                got = place[int(x)][np.searchsorted(place[int(x)][:, 0], rank[own], "right") - 1]
                sequence[own], offset[own] = got[:, 1] + rank[own] - got[:, 0], got[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
