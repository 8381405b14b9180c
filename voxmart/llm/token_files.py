"""Token ids in wavelet matrix files.

Documents are dealt by ascending doc_id (nulls first, equal ids by text) into shards; a shard is one file that holds a wavelet
matrix of its ids: one plane of bits per bit of an id, each plane the ids in an order that is stably parted by the bits above.
With the ones of a plane counted per block, rank and select of a bit are constant and logarithmic, and so the file answers
"the id at i", "how often does t occur before i" and "where is the k-th t" without its ids being spelled out. Planes and
directories are compressed (zstd) one by one, so a lookup opens only what it needs.

    file: b"WMX1", length of the header (u32), header (JSON: n, bits, documents, zeros of each plane, place of each section),
    sections: doc_ids (i64), doc_null (u8), doc_sizes (i64), ones.k (u32, before each BLOCK bits), plane.k (bits, high first)

Files are written under a name that their place in the order fixes, first under a temporary one, so a task that runs again or
twice leaves the same files. What counts is in ``manifest``, a table that Spark commits.

Null and empty texts are documents of the end id alone; a shard closes after the document that fills it. No rows, no files.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from contextlib import suppress
from functools import cached_property
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmart.session import scratch_path

from . import kernels, tokens
from .catalog import query, table

MAGIC = b"WMX1"
BLOCK = 512              # bits between counts of a plane
SHARD = 6_000_000        # ids after which a file closes
PART_BYTES = 16 << 20    # text in one task
END = 2


def build(ids: np.ndarray, doc_ids: list[int | None], sizes: list[int]) -> bytes:
    """A file of ids and of the documents they belong to."""
    v = ids.astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32)
    bits = max(1, int(v.max()).bit_length()) if len(v) else 1
    sections: dict[str, np.ndarray] = {
        "doc_ids": np.array([d or 0 for d in doc_ids], np.int64), "doc_null": np.array([d is None for d in doc_ids], np.uint8),
        "doc_sizes": np.array(sizes, np.int64)}
    zeros = []
    for k in range(bits):
        one = (v & v.dtype.type(1 << (bits - 1 - k))) != 0
        plane = np.packbits(one)
        padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(plane)] = plane
        per = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
        sections[f"ones.{k}"] = np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)
        sections[f"plane.{k}"] = plane
        zeros.append(len(v) - int(sections[f"ones.{k}"][-1]))
        v = np.concatenate([np.compress(~one, v), np.compress(one, v)])
    pack, body, places = zstandard.ZstdCompressor(level=1), [], {}
    for name, data in sections.items():
        raw = pack.compress(data.tobytes())
        places[name] = [sum(map(len, body)), len(raw), data.dtype.str]
        body.append(raw)
    head = json.dumps({"n": len(ids), "bits": bits, "documents": len(sizes), "zeros": zeros, "sections": places}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


class WaveletFile:
    """The ids of a file; sections are unpacked when first needed."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token file")
        size, = struct.unpack_from("<I", raw, 4)
        self.head, self.raw, self.at = json.loads(raw[8: 8 + size]), raw, 8 + size
        self.n, self.bits = self.head["n"], self.head["bits"]
        self.held: dict[str, np.ndarray] = {}

    def section(self, name: str) -> np.ndarray:
        if name not in self.held:
            at, size, kind = self.head["sections"][name]
            raw = self.raw[self.at + at: self.at + at + size]
            self.held[name] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)
        return self.held[name]

    @cached_property
    def documents(self) -> list[tuple[int | None, int]]:
        """(doc_id, number of ids) in order."""
        return [(None if null else d, s) for d, null, s in
                zip(*(self.section(x).tolist() for x in ("doc_ids", "doc_null", "doc_sizes")))]

    def _bit(self, k: int, i: int) -> int:
        return int(self.section(f"plane.{k}")[i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before i."""
        block, plane = i // BLOCK, self.section(f"plane.{k}")
        got = int(self.section(f"ones.{k}")[block])
        tail = plane[block * BLOCK // 8: (i + 7) >> 3]
        if i % BLOCK and len(tail):
            got += int(np.bitwise_count(tail[:-1]).sum()) + (int(tail[-1]) >> (-i % 8)).bit_count()
        return got

    def _pass(self, k: int, bit: int, i: int) -> int:
        one = self._ones(k, i)
        return self.head["zeros"][k] + one if bit else i - one

    def access(self, i: int) -> int:
        """The id at i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            bit = self._bit(k, i)
            value, i = value << 1 | bit, self._pass(k, bit, i)
        return value

    def rank(self, token: int, i: int) -> int:
        """How often the token occurs before i."""
        lo, hi = 0, min(max(i, 0), self.n)
        if token >> self.bits or token < 0:
            return 0
        for k in range(self.bits):
            bit = token >> (self.bits - 1 - k) & 1
            lo, hi = self._pass(k, bit, lo), self._pass(k, bit, hi)
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        return max(0, self.rank(token, self.n if hi is None else hi) - self.rank(token, lo))

    def select(self, token: int, k: int) -> int:
        """Where the token occurs for the k-th time, from 0."""
        if not 0 <= k < self.rank(token, self.n):
            raise IndexError(k)
        at = 0
        for level in range(self.bits):
            at = self._pass(level, token >> (self.bits - 1 - level) & 1, at)
        at += k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._find(level, bit, at - self.head["zeros"][level] if bit else at)
        return at

    def _find(self, k: int, bit: int, nth: int) -> int:
        """Position of the nth bit of this kind in plane k, from 0."""
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            before = self._ones(k, mid) if bit else mid - self._ones(k, mid)
            lo, hi = (lo, mid) if before > nth else (mid, hi)
        return lo

    def ids(self) -> np.ndarray:
        """All ids in order: the parting of each plane is undone, the lowest first."""
        v = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.section(f"plane.{k}"), count=self.n).view(bool)
            zeros, out = self.head["zeros"][k], np.empty_like(v)
            out[np.flatnonzero(~one)] = v[:zeros]
            out[np.flatnonzero(one)] = v[zeros:] | v.dtype.type(1 << (self.bits - 1 - k))
            v = out
        return v


def _store(folder: str, name: str, raw: bytes) -> None:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    new = f"{base}/_{name}.{uuid4().hex}"
    with store.open_output_stream(new) as f:
        f.write(raw)
    with suppress(FileExistsError):
        store.move(new, f"{base}/{name}")


def write(docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end: int = END, shard: int = SHARD,
          part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the files of ``docs`` into ``folder`` (of a store that pyarrow opens and all executors share); the manifest.

    One row per file: part, number, file, n_ids, n_documents, bytes.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("t")]
    dealt = rows.repartitionByRange(int(total // part_bytes) + 1, order[0], F.xxhash64("t")).sortWithinPartitions(*order)
    names = ["part", "number", "file", "n_ids", "n_documents", "bytes"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = tokens.encoder(path), TaskContext.get().partitionId(), 0
        tail = np.array([end], "<u4").tobytes()
        ids: list[bytes] = []
        who: list = []
        held = 0

        def close() -> pa.RecordBatch:
            raw = build(np.frombuffer(b"".join(ids), "<u4"), who, [len(x) // 4 for x in ids])
            name = f"part-{part:06d}-{number:06d}.wmx"
            _store(folder, name, raw)
            row = [part, number, name, held, len(who), len(raw)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(
                row, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=names)

        for batch in batches:
            for name, t in zip(batch["doc_id"].to_pylist(), batch["t"]):
                ids.append(enc.encode(t.as_py()) + tail)
                who.append(name)
                held += len(ids[-1]) // 4
                if held >= shard:
                    yield close()
                    ids, who, held, number = [], [], 0, number + 1
        if who:
            yield close()

    kind = "part bigint, number bigint, file string, n_ids bigint, n_documents bigint, bytes bigint"
    dealt.mapInArrow(work, kind).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(kind).parquet(f"{folder}/manifest")


def read(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian u32)."""
    files = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*.wmx").load(folder) \
        .select("path", "content")
    names = ["file", "doc_id", "within", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, raw in zip(batch["path"].to_pylist(), batch["content"]):
                f = WaveletFile(raw.as_py())
                ids, name = f.ids().astype("<u4"), place.rsplit("/", 1)[-1]
                ends = np.cumsum([s for _, s in f.documents]).tolist()
                spans = [(b - s, b) for (_, s), b in zip(f.documents, ends)]
                raws = [ids[a:b].tobytes() for a, b in spans]
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(raws)), pa.array([d for d, _ in f.documents], pa.int64()),
                    pa.array([a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()),
                    pa.array(map(zlib.crc32, raws), pa.int64()), *([pa.array(raws, pa.binary())] if with_ids else [])], names=names)

    part, inner = Window.orderBy("part"), Window.partitionBy("part").orderBy("number")
    ahead = (Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")) \
        .select("part", F.coalesce(F.sum("n").over(part.rowsBetween(*ahead)), F.lit(0)).alias("before"))
    starts = manifest.join(parts, "part").select(
        "file", (F.col("before") + F.coalesce(F.sum("n_ids").over(inner.rowsBetween(*ahead)), F.lit(0))).alias("before"))
    decoded = files.mapInArrow(work, "file string, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint"
                               + ", ids binary" * with_ids)
    return decoded.join(starts, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), *names[3:])


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    return read(write(table(spark, sf_dir, "documents"), tokens.public("word_bpe_49k.json"), folder), folder)
