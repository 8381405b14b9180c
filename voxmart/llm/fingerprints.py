"""Document fingerprints: bottom-k sketches of hashed word shingles.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles, in ascending order. The sketch of a union is the k
smallest of the united sketches, so parts of a text, tasks and corpora merge in any order. Two sketches estimate the
resemblance and containment of the shingle sets, one estimates how many distinct shingles there are. With fewer than k
shingles all of this is exact.

Empty and null texts have the empty sketch: it is like another empty one (1.0) and unlike any other (0.0). Equal texts have
equal sketches. Rows are kept one by one, repeated ones too; a null key is kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels
from .catalog import query, table

K = 128       # standard error of a resemblance is below 0.045
WORDS = 5     # words in a shingle
PART_BYTES = 16 << 20  # text in one task of the neighbour pass
CHUNK = 1 << 20        # shingles whose hashes are sorted at once


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, block by block."""
    best = np.empty(0, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        best = np.unique(np.concatenate([best, hashes[at: at + CHUNK]]))[:k]
    return best


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.empty(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A or B|."""
    union = merge(a, b, k=k)
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / len(union)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0 ** 64 / (float(a[k - 1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A|; 1.0 where A is empty."""
    size = distinct_count(a, k)
    return 1.0 if not size else min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k=k), k) / size)


def encode(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def sketches(data: np.ndarray, bounds: np.ndarray, k: int = K, n: int = WORDS) -> list[np.ndarray]:
    word, first, _ = kernels.words(data, bounds)
    h, start = kernels.shingles(word, first, n)
    return [sketch(h[a:b], k) for a, b in zip(start[:-1].tolist(), start[1:].tolist())]


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, n: int = WORDS) -> DataFrame:
    """All columns of ``docs`` and ``fingerprint`` (base64 of the sketch); a column of that name is replaced."""
    names = [c for c in docs.columns if c != "fingerprint"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernels.slices(whole, text):
                found = sketches(*kernels.text_bytes(batch[text]), k, n)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(encode, found), pa.string())],
                                                 names=[*names, "fingerprint"])

    schema = docs.select(*names).schema.add("fingerprint", "string")
    return docs.select(*names).mapInArrow(work, schema)


def merge_by(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """One fingerprint per key from the fingerprints of its parts (a text cut into parts whose shingles overlap, a folder,
    a source). Each task first merges its own rows, so the second step gets at most one row per key and task; a null key is
    a key of its own. Null fingerprints count as empty."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for name, s in zip(batch[key].to_pylist(), batch["fingerprint"].to_pylist()):
                held[name] = merge(held.get(name, np.empty(0, np.uint64)), decode(s or ""), k=k)
            if len(held) > 50_000:
                yield out(held)
                held = {}
        yield out(held)

    def out(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, kind), pa.array(map(encode, held.values()), pa.string())],
                                          names=[key, "fingerprint"])

    rows = parts.select(key, "fingerprint")
    kind = to_arrow_type(rows.schema[key].dataType)
    once = rows.mapInArrow(partial, rows.schema)
    return once.repartition(key).sortWithinPartitions(key).mapInArrow(_merge_sorted(key, kind, k), rows.schema)


def _merge_sorted(key: str, kind: pa.DataType, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list = []
        held: list = []
        for batch in batches:
            for name, s in zip(batch[key].to_pylist(), batch["fingerprint"].to_pylist()):
                if names and names[-1] == name:
                    held[-1] = merge(held[-1], decode(s or ""), k=k)
                else:
                    names.append(name)
                    held.append(decode(s or ""))
            if len(names) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(names[:-1], kind), pa.array(map(encode, held[:-1]))],
                                                 names=[key, "fingerprint"])
                names, held = names[-1:], held[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(map(encode, held), pa.string())],
                                         names=[key, "fingerprint"])
    return work


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows in ranges of ascending key, each range followed by the first row of the next one.

    Returns ``slot`` (number of the range), ``key``, ``text``, ``extra`` (row that only follows). The range bounds are
    quantiles of the key, as many as the bytes of text ask for, so a range holds about ``part_bytes``; after the last row
    comes the very first one. Texts move once, in one shuffle. Null keys come first, equal keys in the order of their texts.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    low = F.coalesce("key", F.lit(-(1 << 63)))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.min(low).alias("least")).first()
    parts = int((size["b"] or 0) // part_bytes) + 1
    cuts: list[int] = []
    if parts > 1:
        cuts = rows.agg(F.percentile_approx(low, [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    edge = np.array(sorted({c for c in cuts if c > size["least"]}), np.int64)
    top = len(edge)
    first = {int(c): i for i, c in enumerate([size["least"], *edge.tolist()])} if size["least"] is not None else {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch["low"]).astype(np.int64)
            slot = np.searchsorted(edge, at, side="right")
            again = np.flatnonzero(np.isin(at, list(first)))
            before = np.array([(first[int(v)] - 1) % (top + 1) for v in at[again]], np.int64)
            take = np.concatenate([np.arange(len(at)), again])
            extra = np.concatenate([np.zeros(len(at), bool), np.ones(len(again), bool)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([slot, before])), batch["key"].take(pa.array(take)), batch["text"].take(pa.array(take)),
                 pa.array(extra)], names=["slot", "key", "text", "extra"])

    kind = rows.schema["key"].dataType.simpleString()
    dealt = rows.withColumn("low", low).mapInArrow(work, f"slot bigint, key {kind}, text string, extra boolean")
    return dealt.repartition(top + 1, "slot").sortWithinPartitions("slot", "extra", F.col("key").asc_nulls_first(), "text")


def neighbour_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, n: int = WORDS,
                           part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of each text, of its edited form (second half replaced by the start of the next text) and likenesses."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(block: list[tuple], after: tuple | None) -> pa.RecordBatch:
        plain = [b[1] for b in block]
        follow = [*plain[1:], after[1] if after is not None else plain[-1]]
        edited = [(t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode() for t, f in zip(plain, follow)]
        own = sketches(*kernels.join_texts([t.encode() for t in [*plain, follow[-1]]]), k, n)
        new = sketches(*kernels.join_texts(edited), k, n)
        return pa.RecordBatch.from_arrays([
            pa.array([b[0] for b in block], key_type), pa.array(map(len, plain), pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(map(encode, own[:-1])), pa.array(map(encode, new)),
            pa.array([resemblance(a, b, k) for a, b in zip(own, new)], pa.float64()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:])], pa.float64()),
            pa.array([containment(a, b, k) for a, b in zip(own, new)], pa.float64()),
            pa.array([distinct_count(a, k) for a in own[:-1]], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                   "contained_in_edited", "distinct_shingles"])

    key_type = to_arrow_type(docs.schema[key].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, slot, follower = 0, None, None
        for batch in batches:
            for s, name, t, extra in zip(*(batch[c].to_pylist() for c in ("slot", "key", "text", "extra"))):
                if s != slot:
                    if held:
                        yield rows(held, follower)
                    held, size, slot, follower = [], 0, s, None
                if extra:
                    follower = follower or (name, t)
                    continue
                if size > 4 << 20 and len(held) > 1:  # the last one waits for its successor
                    yield rows(held, (name, t))
                    held, size = [], 0
                held.append((name, t))
                size += len(t)
        if held:
            yield rows(held, follower)

    return with_next(docs, key, text, part_bytes).mapInArrow(
        work, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, contained_in_edited double, distinct_shingles double")


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))
