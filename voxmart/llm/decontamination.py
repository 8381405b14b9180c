"""Benchmark decontamination by greedy string tiling.

Texts are words (A-Z lower-cased). A tile is a run of MATCH or more equal words of a document and a benchmark item; the longest
unmarked one is marked again and again, no word twice on either side, until none is left. The share of the item's words under
tiles is its coverage. As tiles may lie in any order, an item whose parts were moved about is found as well. An item of fewer
than MATCH words has to occur as a whole; one without words never does.

Every tile begins with a window of MATCH words that both sides have, so windows (their Karp-Rabin hashes) are the seeds:

1. A bit table of the benchmark's seeds, of at most 16 MB, goes to every task. A task keeps of each document the windows that
   hit it, nearly all documents none.
2. The hits meet the seeds of the items in a join. Pairs that share too few windows to reach the threshold are left out.
3. A pair's hits on both sides are all that tiling needs: runs of hits along a diagonal are the matches. Longest first, a run
   is marked, or cut where others have been marked in the meantime and put back.

Equal items are tiled once, and rows that repeat (doc_id, text) share their result. Null and empty texts match nothing; null
ids are ids like any other. The benchmark may be of any size: the bit table only saves work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmart.session import cut_lineage

from . import kernels
from .catalog import query, table

MATCH = 4        # words in the shortest tile
COVER = 0.6      # of an item's words; clean documents stay far below, moved sentences cost the words at their edges
MOST_BITS = 27   # of the bit table


def windows(data: np.ndarray, bounds: np.ndarray, match: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words (fewer only in shorter texts), their count before each text, word counts."""
    word, first, _ = kernels.words(data, bounds)
    h, start = kernels.shingles(word, first, width)
    return h, start, np.diff(first)


def tile(hits: list[tuple[int, int]], item: list[int], size: int, width: int) -> list[tuple[int, int, int]]:
    """Tiles (document word, item word, words), in the order in which they are marked.

    hits: (word position, window hash) of the document, ascending; item: the window hashes of the item, which has ``size``
    words; width: words of a window.
    """
    at: dict[int, list[int]] = {}
    for j, h in enumerate(item):
        at.setdefault(h, []).append(j)
    open_runs: dict[int, list[int]] = {}  # diagonal: document position where the run began, and of its last window
    heap: list[tuple[int, int, int]] = []

    def push(p: int, j: int, words: int) -> None:
        heapq.heappush(heap, (-words, p, j))

    for p, h in hits:
        for j in at.get(h, ()):
            run = open_runs.get(p - j)
            if run and run[1] == p - 1:
                run[1] = p
            else:
                if run:
                    push(run[0], run[0] - (p - j), run[1] - run[0] + width)
                open_runs[p - j] = [p, p]
    for d, (a, b) in open_runs.items():
        push(a, a - d, b - a + width)
    marked_doc: set[int] = set()
    marked = bytearray(size)
    tiles = []
    while heap:
        words, p, j = heapq.heappop(heap)
        free = [not marked[j + i] and p + i not in marked_doc for i in range(-words)]
        if all(free):
            tiles.append((p, j, -words))
            marked_doc.update(range(p, p - words))
            marked[j: j - words] = b"\1" * -words
            continue
        begin = None
        for i, ok in enumerate([*free, False]):
            if ok and begin is None:
                begin = i
            elif not ok and begin is not None:
                if i - begin >= width:
                    push(p + begin, j + begin, i - begin)
                begin = None
    return tiles


def benchmark_items(bench: DataFrame, key: str, text: str, match: int) -> DataFrame:
    """(item_id, words, width, same, seeds binary): same is a digest of the words, so that equal items are known."""
    kind = bench.schema[key].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = kernels.text_bytes(batch["t"])
            word, first, _ = kernels.words(data, bounds)
            size = np.diff(first)
            seeds = []
            for i, n in enumerate(size.tolist()):
                mine = word[first[i]: first[i + 1]]
                seeds.append(kernels.shingles(mine, np.array([0, n]), match)[0].tobytes())
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(size, pa.int64()), pa.array(np.minimum(size, match), pa.int64()),
                                              pa.array(seeds, pa.binary())], names=["item_id", "words", "width", "seeds"])

    out = bench.select(F.col(key).alias("item_id"), F.col(text).alias("t")).mapInArrow(
        work, f"item_id {kind.simpleString()}, words bigint, width bigint, seeds binary")
    return out.filter("words > 0").withColumn("same", F.sha2("seeds", 256))


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """Bits at the seeds' hashes, a power of two of them: 32 a seed, up to the limit."""
    n = seeds.agg(F.approx_count_distinct("seed")).first()[0]
    bits = min(MOST_BITS, max(16, int(32 * (n + 1)).bit_length()))
    spot = F.shiftrightunsigned("seed", 64 - bits)
    words = seeds.select((spot / 32).cast("bigint").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) % 32 as int))").alias("m")) \
        .groupBy("w").agg(F.expr("bit_or(m)").alias("m")).collect()
    table_ = np.zeros(1 << (bits - 5), np.uint32)
    table_[[r.w for r in words]] = [r.m for r in words]
    return np.unpackbits(table_.view(np.uint8), bitorder="little").view(bool) if bits <= 22 else table_


def contaminated(docs: DataFrame, bench: DataFrame, match: int = MATCH, cover: float = COVER, key: str = "doc_id",
                 text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, words, covered, coverage, tiles, longest) of all pairs whose coverage is ``cover`` or more."""
    items = cut_lineage(benchmark_items(bench, item_key, item_text, match), "items")
    apart = items.groupBy("same").agg(F.first("words").alias("words"), F.first("width").alias("width"), F.first("seeds").alias("seeds"))
    numbers = lambda batch: [np.frombuffer(s, np.int64) for s in batch.to_pylist()]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = numbers(batch["seeds"])
            many = pa.array(np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["same"].take(many), batch["words"].take(many), batch["width"].take(many),
                                              pa.array(np.concatenate(seeds) if seeds else [], pa.int64())],
                                             names=["same", "words", "width", "seed"])

    seeds = cut_lineage(apart.mapInArrow(spell, "same string, words bigint, width bigint, seed bigint")
                        .groupBy("same", "words", "width", "seed").agg(F.count(F.lit(1)).alias("times")), "seeds")
    bits = _bit_table(seeds)
    widths = sorted(r.width for r in seeds.select("width").distinct().collect())
    kind = docs.schema[key].dataType
    kept = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = kept.value
        shift = np.uint64(64 - (len(held) * (32 if held.dtype == np.uint32 else 1)).bit_length() + 1)
        for whole in batches:
            for batch in kernels.slices(whole, "t", 1 << 20):
                data, bounds = kernels.text_bytes(batch["t"])
                rows: list[tuple[int, int, bytes, bytes]] = []
                for width in widths:
                    h, start, _ = windows(data, bounds, match, width)
                    spot = h >> shift
                    hit = held[spot] if held.dtype == bool else (held[spot >> np.uint64(5)] >> (spot & np.uint64(31)).astype(np.uint32)) & 1 == 1
                    where = np.flatnonzero(hit)
                    owner = np.searchsorted(start, where, side="right") - 1
                    for i in np.unique(owner).tolist():
                        mine = where[owner == i] if len(where) < 64 else where[np.searchsorted(owner, i): np.searchsorted(owner, i, side="right")]
                        rows.append((i, width, (mine - start[i]).astype(np.int64).tobytes(), h[mine].tobytes()))
                cols = list(zip(*rows)) or [[]] * 4
                take = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(take), batch["text_hash"].take(take), pa.array(cols[1], pa.int64()),
                                                  pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                                 names=["doc_id", "text_hash", "width", "at", "hash"])

    hits = cut_lineage(docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t")).mapInArrow(
        scan, f"doc_id {kind.simpleString()}, text_hash bigint, width bigint, at binary, hash binary"), "hits")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(s) for s in numbers(batch["hash"])]
            many = pa.array(np.repeat(np.arange(len(own)), [len(s) for s in own]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["text_hash"].take(many), batch["width"].take(many),
                                              pa.array(np.concatenate(own) if own else [], pa.int64())],
                                             names=["text_hash", "width", "seed"])

    # Equal texts hit alike, so the search goes by text; documents come in again at the end.
    texts = cut_lineage(hits.groupBy("text_hash", "width").agg(F.first("at").alias("at"), F.first("hash").alias("hash")), "texts")
    shared = texts.select("text_hash", "width", "hash").mapInArrow(distinct, "text_hash bigint, width bigint, seed bigint") \
        .join(seeds, ["width", "seed"]).groupBy("text_hash", "width", "same").agg(F.sum("times").alias("n"), F.first("words").alias("words"))
    pairs = shared.filter(F.col("n") * F.col("width") >= F.col("words") * F.lit(cover)).select("text_hash", "width", "same")
    both = pairs.join(texts, ["text_hash", "width"]).join(apart.drop("width"), "same")

    def tiling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, h, item, n, width in zip(numbers(batch["at"]), numbers(batch["hash"]), numbers(batch["seeds"]),
                                             batch["words"].to_pylist(), batch["width"].to_pylist()):
                mine = np.isin(h, item)
                found = tile(list(zip(at[mine].tolist(), h[mine].tolist())), item.tolist(), n, width)
                rows.append((sum(t[2] for t in found), len(found), max((t[2] for t in found), default=0)))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch["text_hash"], batch["same"], *(pa.array(c, pa.int64()) for c in cols)],
                                             names=["text_hash", "same", "covered", "tiles", "longest"])

    tiled = both.select("text_hash", "same", "words", "width", "at", "hash", "seeds") \
        .mapInArrow(tiling, "text_hash bigint, same string, covered bigint, tiles bigint, longest bigint")
    full = tiled.join(items.select("item_id", "same", "words"), "same") \
        .withColumn("coverage", F.col("covered") / F.col("words")).filter(F.col("coverage") >= cover).drop("same")
    rows = hits.select("doc_id", "text_hash").distinct()
    return rows.join(full, "text_hash").select("doc_id", "text_hash", "item_id", "words", "covered", "coverage", "tiles", "longest")


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text covers no benchmark item."""
    bad = contaminated(docs.select("doc_id", "text"), bench).select(F.col("text_hash").alias("bad_")).distinct()
    return docs.join(bad, F.xxhash64("text") == F.col("bad_"), "left_anti")


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
