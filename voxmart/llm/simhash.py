"""SimHash near-duplicates: fingerprints of word shingles, linked where few bits differ.

A-Z are lower-cased; words are runs of characters other than space and TAB..CR. Every shingle of three words joined by
single spaces, repeats included, is hashed by XXH64 with seed 42 over its UTF-8; a text of fewer words is one shingle. A bit
of the fingerprint is set where it is set in more than half of the hashes. Null, empty and blank texts have fingerprint zero
and are linked like any other.

Links: 64 bits are cut into four blocks of 16. Two fingerprints that differ in at most two bits agree in two blocks at
least, so they meet under one of six keys of 32 bits; each meeting is verified by the Hamming distance. Only distinct
fingerprints take part, copies do not meet each other. Where more than ``hot`` fingerprints share a key, they are not
compared in pairs: those within two bits agree once some two of the 32 other bits are blanked, and such a blanked value
has at most four members, so the hot ones are joined to stars under the 496 blanked values each. Both ways are exact.
Links become classes by connected components. A row without a doc_id keeps its fingerprint and takes the class of the rows
that share or reach it; where none of those has a doc_id either, the class is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from voxmart.operators.components import connected
from voxmart.session import cut_lineage

from . import kernels
from .catalog import query, table

WORDS = 3
BITS = 2      # fingerprints link at so many differing bits or fewer; the blocks below are made for two
HOT = 4096
SEED = 42
BYTES = 2 << 20  # of text in one piece of work; only a single longer text makes it more
UNNAMED = 1 << 62  # doc_ids are below
PAIRS = list(combinations(range(4), 2))  # of blocks
_LOWER = kernels.LOWER.tobytes()


def simhash(text: bytes, n: int = WORDS) -> int:
    """The 64-bit fingerprint of a text in UTF-8, unsigned."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends[min(n, len(words)) - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), 1 << 15):
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[at: at + (1 << 15)], last[at: at + (1 << 15)])])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big")


def with_simhash(docs: DataFrame, text: str = "text", keep: list[str] | None = None, n: int = WORDS) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``simhash`` bigint, which replaces a column of that name."""
    names = [c for c in (docs.columns if keep is None else keep) if c != "simhash"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernels.slices(whole, "shingled", BYTES):
                found = np.array([simhash((t or "").encode(), n) for t in batch["shingled"].to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(found)], names=[*names, "simhash"])

    schema = docs.select(*names).schema.add("simhash", "long")
    return docs.select(*names, F.col(text).alias("shingled")).mapInArrow(work, schema)


def _near(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BITS


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a < b, whose connections are those of all pairs within two bits.

    prints: a column ``simhash`` of distinct values. Pairs under a key that is not hot are all given.
    """
    one = prints.select(F.col("simhash").alias("f"))
    block = [F.shiftrightunsigned("f", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = one.select("f", F.posexplode(F.array(*[(block[i] * 65536 + block[j]) for i, j in PAIRS])).alias("k", "v"))
    crowded = keys.groupBy("k", "v").count().filter(F.col("count") > hot).select("k", "v")
    calm = keys.join(crowded, ["k", "v"], "left_anti")
    pairs = calm.alias("x").join(calm.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.v") == F.col("y.v"))
                                 & (F.col("x.f") < F.col("y.f")) & _near("x.f", "y.f")) \
        .select(F.col("x.f").alias("a"), F.col("y.f").alias("b"))
    blanks = [sum(1 << p for p in two) for two in combinations(range(64), 2)]
    of_key = [[m for m in blanks if not m & sum(0xFFFF << (48 - 16 * i) for i in PAIRS[k])] for k in range(len(PAIRS))]
    signed = [F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in ms]) for ms in of_key]
    masks = F.element_at(F.array(*signed), F.col("k") + 1)
    stars = keys.join(crowded, ["k", "v"], "left_semi").select("k", "f", F.explode(masks).alias("m")) \
        .groupBy("k", "m", F.expr("f & ~m").alias("rest")) \
        .agg(F.min("f").alias("a"), F.collect_set("f").alias("all")).filter(F.size("all") > 1) \
        .select("a", F.explode("all").alias("b")).filter("a <> b")
    return pairs.unionByName(stars.distinct())


def numbered(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(simhash, c) of distinct (simhash, doc_id) rows, doc_id being the smallest with that fingerprint; c names the class: its
    smallest doc_id, or a number of UNNAMED or more where it has none."""
    found = links(prints, hot)
    # A fingerprint without a doc_id goes by a number above all of them. Its two lowest bits may be cut: fingerprints that
    # differ in these only are linked anyway.
    own = prints.select("simhash", F.coalesce("doc_id", UNNAMED + F.shiftrightunsigned("simhash", 2)).alias("id"))
    left, right = own.toDF("a", "from"), own.toDF("b", "to")
    parts = connected(found.join(left, "a").join(right, "b"), "from", "to")
    return own.join(parts, "id", "left").select("simhash", F.coalesce("component", "id").alias("c"))


def classes(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(simhash, component_id) of distinct (simhash, doc_id) rows; null where a class has no doc_id."""
    return numbered(prints, hot).select("simhash", F.when(F.col("c") < UNNAMED, F.col("c")).alias("component_id"))


def _least_ids(rows: DataFrame) -> DataFrame:
    return cut_lineage(rows.groupBy("simhash").agg(F.min("doc_id").alias("doc_id")), "prints")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, simhash bigint, component_id (smallest doc_id that can be reached)."""
    rows = cut_lineage(with_simhash(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")), "t", ["doc_id"]), "simhash")
    return rows.join(cut_lineage(classes(_least_ids(rows), hot), "classes"), "simhash")


def drop_near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` that stand for their class: of each class exactly one of its own rows stays.

    It is the one with the smallest doc_id (rows without one come last), of rows that share it the one with the smallest SHA-256
    of its text, of repeats of that the one with the smallest other columns. Only fingerprints, doc_ids and digests are
    grouped; texts move once, to meet what stays.
    """
    names = docs.columns
    tag = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    own = F.coalesce("doc_id", F.lit(UNNAMED))
    rows = cut_lineage(with_simhash(docs.select(own.alias("doc_id"), tag.alias("tag"), F.col("text").alias("t")), "t", ["doc_id", "tag"]), "simhash")
    prints = _least_ids(rows.withColumn("doc_id", F.nullif("doc_id", F.lit(UNNAMED))))
    parts = cut_lineage(numbered(prints, hot), "classes")
    stay = rows.groupBy("simhash").agg(F.min(F.struct("doc_id", "tag")).alias("s")).join(parts, "simhash") \
        .groupBy("c").agg(F.min("s").alias("s")).select("s.*")
    rest = docs.select(own.alias("doc_id"), tag.alias("tag"), F.struct(*names).alias("r")).join(stay, ["doc_id", "tag"])
    return rest.groupBy("doc_id", "tag").agg(F.min("r").alias("r")).select("r.*")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")
