"""Packing texts into sequences of fixed length by bin completion.

Texts become token ids and an end id; only a text longer than a sequence is cut, into full sequences and, in front, a shorter
first piece. How many pieces there are of each length (at most ``capacity`` numbers, whatever the size of the corpus) is all
that the search needs. It fills the sequence around the largest piece left: undominated fillings of the rest are enumerated,
those of least waste first, and the chosen one is repeated as often as the counts allow. Branches whose waste exceeds what the
best solution so far may waste are pruned; best-fit decreasing is the first such solution, and the search ends at the lower
bound or after a number of steps. The plan is a list of patterns with multiplicities.

Pieces then take their places without meeting each other: the pieces of a length are numbered, by salted groups whose counts
are summed up, and the number says which pattern, repetition and offset is theirs. A length that a third of all pieces share
is thus spread over many tasks.

Null and empty texts are one piece of the end id alone. Repeated rows are texts of their own. No rows, no sequences.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmart.session import cut_lineage

from . import kernels, tokens
from .catalog import query, table

CAPACITY = 1024
END = 2
NODES = 400       # of the enumeration of one filling
STEPS = 6_000     # of the whole search
WIDTH = 4         # fillings of a sequence that are tried
GROUP = 1_000     # pieces of one length that are numbered in one group, about
CACHE = 250_000   # words whose ids a Python worker keeps, about 50 MB; they stay there through the stages that follow

Plan = list[tuple[tuple[int, ...], int]]  # lengths in a sequence, how many such sequences


def bounds(counts: dict[int, int], capacity: int) -> int:
    """A number of sequences that no packing can go below: by total length, and with larger pieces apart."""
    total = sum(s * c for s, c in counts.items())
    best = -(-total // capacity)
    for k in {s for s in counts if 2 * s <= capacity} | {0}:
        big = sum(c for s, c in counts.items() if s > capacity - k)
        mid = {s: c for s, c in counts.items() if capacity - k >= s > capacity / 2}
        small = sum(s * c for s, c in counts.items() if k <= s <= capacity / 2)
        room = sum((capacity - s) * c for s, c in mid.items())
        best = max(best, big + sum(mid.values()) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on counts: pieces of a length go to the fullest sequences that still take one."""
    rows: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            room = min((f for f in rows if f >= s), default=None)
            if room is None:
                each = capacity // s
                for n, m in ((each, left // each), (left % each, 1)):
                    if n and m:
                        rows.setdefault(capacity - n * s, []).append(((s,) * n, m))
                break
            pattern, m = rows[room].pop()
            if not rows[room]:
                del rows[room]
            use = min(m, left)
            if m > use:
                rows.setdefault(room, []).append((pattern, m - use))
            rows.setdefault(room - s, []).append(((*pattern, s), use))
            left -= use
    return [p for group in rows.values() for p in group]


def fillings(counts: dict[int, int], sizes: list[int], room: int, width: int = WIDTH, nodes: int = NODES) -> list[tuple[int, ...]]:
    """Undominated multisets of lengths within ``room``, least waste first, then fewest pieces.

    sizes: ascending lengths with a count. A filling is dominated if an unused piece could stand in for one or two of its own,
    being as long or longer, and still fit.
    """
    found: list[tuple[int, int, tuple[int, ...]]] = []
    steps, exact = 0, 0

    def grow(left: int, top: int, chosen: tuple[int, ...]) -> None:
        nonlocal steps, exact
        steps += 1
        if exact >= width or steps > nodes and found:
            return
        at, grew = bisect_right(sizes, min(left, top)) - 1, False
        while at >= 0:
            s = sizes[at]
            at -= 1
            if chosen.count(s) < counts[s]:
                grew = True
                grow(left - s, s, (*chosen, s))
                if exact >= width or steps > nodes and found:
                    return
        if not grew and not _dominated(chosen, left):
            found.append((left, len(chosen), chosen))
            exact += left == 0

    def _dominated(chosen: tuple[int, ...], waste: int) -> bool:
        own = Counter(chosen)
        sums = set(chosen) | {a + b for i, a in enumerate(chosen) for b in chosen[i + 1:]}
        for y in sums:
            lo = bisect_right(sizes, y if y in own else y - 1)
            while lo < len(sizes) and sizes[lo] <= y + waste:
                if counts[sizes[lo]] > own[sizes[lo]]:
                    return True
                lo += 1
        return False

    grow(room, room, ())
    return [f for _, _, f in sorted(found)[:width]] or [()]


def complete(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """Bin completion by branch and bound on counts of lengths."""
    counts = {s: c for s, c in counts.items() if c}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must be between 1 and the capacity")
    least = bounds(counts, capacity)
    best = best_fit(counts, capacity)
    most, used, total = sum(m for _, m in best), 0, sum(s * c for s, c in counts.items())
    left, path, waste, bins = dict(counts), [], 0, 0
    stack: list[tuple[list[tuple[int, ...]], int]] = []  # options not tried yet, length of the path when they came up

    def undo(to: int) -> None:
        nonlocal waste, bins
        while len(path) > to:
            pattern, m = path.pop()
            bins -= m
            waste -= m * (capacity - sum(pattern))
            for s in pattern:
                left[s] = left.get(s, 0) + m

    def apply(pattern: tuple[int, ...]) -> None:
        nonlocal waste, bins
        own = Counter(pattern)
        m = min(left[s] // n for s, n in own.items())
        for s, n in own.items():
            left[s] -= m * n
            if not left[s]:
                del left[s]
        path.append((pattern, m))
        bins += m
        waste += m * (capacity - sum(pattern))

    while most > least and used < steps:
        used += 1
        if not left:
            if bins < most:
                most, best = bins, list(path)
        elif waste <= (most - 1) * capacity - total:
            sizes = sorted(left)
            top = sizes[-1]
            left[top] -= 1
            rest = sizes if left[top] else sizes[:-1]
            options = fillings(left, rest, capacity - top)
            left[top] += 1
            options = [(top, *f) for f in options]
            stack.append((options[1:], len(path)))
            apply(options[0])
            continue
        while stack and not stack[-1][0]:
            stack.pop()
        if not stack:
            break
        options, at = stack[-1]
        undo(at)
        apply(options.pop(0))
    return best


def places(plan: Plan) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """For each length: the first number of a run of pieces, the sequence of this first one, the offset in it. And how many
    sequences there are. The sequence grows by one with the number, up to the next run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    base = 0
    for pattern, m in plan:
        offset = 0
        for s in pattern:
            runs.setdefault(s, []).append((taken[s], base, offset))
            taken[s] += m
            offset += s
        base += m
    return {s: tuple(np.array(x, np.int64) for x in zip(*r)) for s, r in runs.items()}, base


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
           with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit) of each text's pieces."""
    tail = np.array([end], "<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, CACHE)
        for whole in batches:
            for batch in kernels.slices(whole, "t"):
                rows: list[tuple] = []
                for name, t in zip(batch["doc_id"], batch["t"].to_pylist()):
                    ids = enc.encode(t or "") + tail
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    rows += [(name, i, a, b - a, zlib.crc32(ids[4 * a: 4 * b]), ids[4 * a: 4 * b])
                             for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                cols = list(zip(*rows)) or [[]] * 6
                types = [batch["doc_id"].type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)][: len(names)], names=names)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).mapInArrow(
        work, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def place(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece"), group: int = GROUP) -> DataFrame:
    """The rows of ``items`` (stored, with a column ``length``) with sequence_id and offset.

    The driver gets one count per length. ``order`` and a hash of the row only fix which of equally long pieces goes where.
    """
    counts = {r.length: r["count"] for r in items.groupBy("length").count().collect()}
    where, _ = places(complete(counts, capacity))
    names = items.columns
    salts = F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, math.ceil(n / group))]) if counts else F.lit(None)
    salted = items.withColumn("salt_", F.pmod(F.xxhash64(*[F.col(c) for c in order]), salts[F.col("length")] if counts else F.lit(1)))
    before = salted.groupBy("length", "salt_").agg(F.count(F.lit(1)).alias("n_")).withColumn(
        "before_", F.coalesce(F.sum("n_").over(Window.partitionBy("length").orderBy("salt_").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    within = F.row_number().over(Window.partitionBy("length", "salt_").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    numbered = salted.withColumn("within_", within).join(before, ["length", "salt_"]) \
        .select(*names, (F.col("within_") - 1 + F.col("before_")).alias("number_"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = (np.asarray(batch[c]).astype(np.int64) for c in ("length", "number_"))
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size).tolist():
                mine = size == s
                first, base, offset = where[s]
                at = np.searchsorted(first, number[mine], side="right") - 1
                seq[mine], off[mine] = base[at] + number[mine] - first[at], offset[at]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(seq), pa.array(off)],
                                             names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(work, items.schema.add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """The pieces of all texts with their places."""
    return place(cut_lineage(pieces(docs, path, capacity=capacity, with_ids=with_ids), "pieces"), capacity, group=group)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (int array) of each sequence of ``pack(..., with_ids=True)``: at most ``capacity`` pieces a row."""
    joined = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(joined.alias("parts")) \
        .select("sequence_id", F.unhex(F.array_join("parts.ids", "")).alias("ids"))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokens.public("byte_bpe_50k.json"))
