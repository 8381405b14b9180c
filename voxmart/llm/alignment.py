"""Alignment of the tokens that two tokenizers make of the same texts, by pointer jumping.

A text is encoded by A (a byte-level file of the tokenizers library, on a space and the text) and by B (a sentencepiece model,
which adds the space itself). Tokens of both cover the same bytes. Every token points to the farthest-right token that overlaps
it; successors are doubled over whole arrays until nothing moves, and then every token knows the last token of its component:
the group between two byte offsets where tokens of A and of B end. All A-B pairs of one group are links. The count of a pair of
ids is the number of documents that hold it linked.

One pass encodes, groups and stores the distinct pairs of every text. Their counts are summed by Spark. The HOT most frequent
pairs, a fixed number, go to all tasks and are looked up in place; the other pairs of a text travel to their counts, where no
pair has more than a share of 1 in HOT of the rows.

Both tokenizers cut at a single space between characters that are not blank, so pieces between such spaces are encoded apart
and short ones are kept in a bounded cache; nothing else is assumed of a text.

Null and empty texts, and those whose tokens do not spell the space and the text (B reads U+2581 as a space), have no tokens:
zeros and an empty ``groups_sha256``. Every row of the table, repeated or without a doc_id, is a document of its own. A text is
worked on as a whole, so a task's memory follows its longest text. Empty tables give no rows. Only the named columns are read,
so other columns may have any name.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from voxmart.session import cut_lineage

from . import kernels, tokens
from .catalog import query, table

HOT = 1 << 16     # pairs whose counts are broadcast, 17 bytes each
CACHE = 400_000   # pieces whose ids a Python worker keeps
SHORT = 48        # characters of a piece worth keeping
BYTES = 1 << 20   # of text worked on at once; only a single longer text makes it more
WIDE = 1 << 16    # links of one group from which on its ids are counted first

_LOOSE = re.compile(r" \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_open: dict[tuple[str, str], "Pair"] = {}


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, left-aligned, and how many there are."""
    text = np.arange(n).astype(f"S{len(str(n))}")
    return text.view(np.uint8).reshape(n, -1), np.char.str_len(text).astype(np.int64)


class Pair:
    """Two tokenizers, the bytes of their entries, and a cache of pieces with the ids both make of them."""

    def __init__(self, first: str, second: str, cache: int = CACHE):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.size = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second), cache
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = entry.encode() if entry in added else bytes(letters[c] for c in entry)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_size, self.b_size = (np.array([len(x) for x in s], np.int64) for s in (self.a_bytes, self.b_bytes))
        self.digits, self.width = digits(max(len(self.a_bytes), len(self.b_bytes)))

    def _new(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids of pieces as bytes of 32-bit numbers, none where the tokens do not spell a space and the piece."""
        spelled = [b" " + p.encode() for p in pieces]
        size, joined = np.array(list(map(len, spelled)), np.int64), b"".join(spelled)
        whole, found = np.ones(len(pieces), bool), []
        first = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        for ids, entry, width in ((first, self.a_bytes, self.a_size), (self.b.encode(pieces, num_threads=1), self.b_bytes, self.b_size)):
            n = np.array(list(map(len, ids)), np.int64)
            flat = list(chain.from_iterable(ids))
            number = np.array(flat, np.int64)
            whole &= _sums(width[number], n) == size
            if not whole.all() or b"".join(map(entry.__getitem__, flat)) != joined:
                whole &= np.array([b"".join(map(entry.__getitem__, one)) == x for one, x in zip(ids, spelled)], bool)
            raw, at = number.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(n)])).tolist()
            found.append(list(map(raw.__getitem__, map(slice, at, at[1:]))))
        out = dict(zip(pieces, zip(*found)))
        out.update((pieces[i], (b"", b"")) for i in np.flatnonzero(~whole).tolist())
        return out

    def encode(self, texts: list[str | None]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B in all texts, and how many each text has; none where a text has no tokens."""
        cut = [() if not t else _CUT.split(t) if t[0] == " " or t[-1] == " " or _LOOSE.search(t) else t.split(" ") for t in texts]
        kept, nothing = self.kept, (b"", b"")
        new = self._new(list(set(chain.from_iterable(cut)).difference(kept)))
        bad = {p for p, g in new.items() if g == nothing}
        if bad:
            cut = [() if bad.intersection(pieces) else pieces for pieces in cut]
        room = len(kept) < self.size
        kept.update(new)
        got = list(map(kept.__getitem__, chain.from_iterable(cut)))
        for p in new:  # what is not worth keeping leaves again
            if not room or len(p) > SHORT or p in bad:
                del kept[p]
        if room:
            gc.freeze()  # what is kept need not be looked through by every collection
        size = np.array(list(map(len, cut)), np.int64)
        sides = zip(*got) if got else ((), ())
        return tuple(zip(*((np.frombuffer(b"".join(side), "<u4"), _sums(np.array(list(map(len, side)), np.int64) // 4, size)) for side in sides)))


def pair(first: str, second: str) -> Pair:
    """The tokenizers of two files, shared by the tasks of a Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (first, second) not in _open:
        _open[first, second] = Pair(first, second)
    return _open[first, second]


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups, in order, of tokens of A and of B that end at the given offsets of the same bytes.

    Both are increasing and end at the same offset. The terminal token of a group is the one of A that ends with it.
    """
    n = len(a_end)
    over = np.searchsorted(b_end, a_end)  # the token of B that holds the last byte
    succ = np.concatenate([np.where(b_end[over] > a_end, over + n, np.arange(n)), np.searchsorted(a_end, b_end)]) if n else np.empty(0, np.int64)
    while True:
        far = succ[succ]
        if np.array_equal(far, succ):
            break
        succ = far
    last = np.zeros(n, bool)
    last[succ] = True
    number = np.cumsum(last) - 1
    return number[succ[:n]], number[succ[n:]]


class Aligned:
    """The groups of a block of texts given by the ids of both tokenizers and how many each text has."""

    def __init__(self, made: Pair, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.made, self.a, self.b, self.n_a, self.n_b = made, a, b, n_a, n_b
        self.of_a, self.of_b = components(np.cumsum(made.a_size[a]), np.cumsum(made.b_size[b]))
        groups = int(self.of_a[-1]) + 1 if len(a) else 0
        self.size_a, self.size_b = np.bincount(self.of_a, minlength=groups), np.bincount(self.of_b, minlength=groups)
        self.doc = np.zeros(groups, np.int64)  # the text of each group
        self.doc[self.of_a] = np.repeat(np.arange(len(n_a)), n_a)
        self.groups = np.bincount(self.doc, minlength=len(n_a))

    def links(self) -> np.ndarray:
        """Number of links of each text."""
        return _sums(self.size_a * self.size_b, self.groups)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, a * entries of B + b, number of links) of the distinct pairs of each text, in order."""
        a0, b0 = (np.cumsum(s) - s for s in (self.size_a, self.size_b))
        many, wide = self.size_a * self.size_b, len(self.made.b_bytes)
        span = len(self.made.a_bytes) * wide
        small = np.flatnonzero(many <= WIDE)
        count = many[small]
        g = np.repeat(small, count)
        k = np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count)
        code, times = np.unique(self.doc[g] * span + self.a[a0[g] + k // self.size_b[g]].astype(np.int64) * wide
                                + self.b[b0[g] + k % self.size_b[g]], return_counts=True)
        for g in np.flatnonzero(many > WIDE).tolist():
            (x, nx), (y, ny) = (np.unique(ids[at: at + n], return_counts=True) for ids, at, n in
                                ((self.a, a0[g], self.size_a[g]), (self.b, b0[g], self.size_b[g])))
            more = (self.doc[g] * span + x.astype(np.int64)[:, None] * wide + y).ravel()
            code, at = np.unique(np.concatenate([code, more]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, (nx[:, None] * ny).ravel()])).astype(np.int64)
        return code // span, code % span, times

    def digests(self) -> list[str]:
        """SHA-256 of the ids of each text as ``a1,a2|b1;a3|b2,b3``, '' for a text without tokens."""
        total = len(self.a) + len(self.b)
        value, mark = np.empty(total, np.int64), np.empty(total, np.uint8)
        before_b, upto_a = np.cumsum(self.size_b) - self.size_b, np.cumsum(self.size_a)
        for ids, of, place, end in ((self.a, self.of_a, before_b, b"|"), (self.b, self.of_b, upto_a, b";")):
            at = np.arange(len(ids)) + place[of]
            value[at] = ids
            last = np.ones(len(ids), bool)
            last[:-1] = of[1:] != of[:-1]
            mark[at] = np.where(last, ord(end), ord(","))
        width = self.made.width[value]
        ends = np.cumsum(width + 1)
        starts, out = ends - width - 1, np.empty(int(ends[-1]) if total else 0, np.uint8)
        for k in range(self.made.digits.shape[1]):
            has = np.flatnonzero(width > k)
            out[starts[has] + k] = self.made.digits[value[has], k]
        out[ends - 1] = mark
        bound = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return [hashlib.sha256(out[lo: hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(bound, bound[1:])]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes, exact."""
    total = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return total[at[1:]] - total[at[:-1]]


def aligned(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct
    pairs of its links (a * entries of B + b) with how many links each has."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pair(first, second)
        for batch in batches:
            for part in kernels.slices(batch, "t", BYTES):
                (a, b), (n_a, n_b) = made.encode(part["t"].to_pylist())
                found = Aligned(made, a, b, n_a, n_b)
                doc, code, times = found.pairs()
                at = pa.array(np.searchsorted(doc, np.arange(len(n_a) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["row"], part["doc_id"], *map(pa.array, (n_a, n_b, found.groups, found.links())), pa.array(found.digests(), pa.string()),
                     pa.ListArray.from_arrays(at, pa.array(code)), pa.ListArray.from_arrays(at, pa.array(times))],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(work, f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                                 "pairs array<bigint>, times array<bigint>")


def pair_counts(rows: DataFrame, entries: int, seconds: int) -> DataFrame:
    """(pair, c, best): documents that hold each pair linked, and whether no pair of the same A id is held by more.

    entries, seconds: how many entries A and B have. There is one highest count per entry of A, which is broadcast up to a
    million entries.
    """
    found = cut_lineage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("c")), "pair-counts")
    first = F.expr(f"pair div {seconds}")
    most = found.groupBy(first.alias("a")).agg(F.max("c").alias("most"))
    return found.withColumn("a", first).join(F.broadcast(most) if entries <= 1 << 20 else most, "a") \
        .select("pair", "c", (F.col("c") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """``rows`` of ``aligned`` with n_best and count_sum in place of their pairs."""
    top = counts.orderBy(F.desc("c"), "pair").limit(hot).toArrow()
    order = np.argsort(np.asarray(top["pair"]))
    known = rows.sparkSession.sparkContext.broadcast(tuple(np.asarray(top[c])[order] for c in ("pair", "c", "best")))
    names = [c for c in rows.columns if c not in ("pairs", "times")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = known.value
        for batch in batches:
            size = np.diff(np.asarray(batch["pairs"].offsets))
            pairs, times = (np.asarray(batch[c].flatten()) for c in ("pairs", "times"))
            at = np.minimum(np.searchsorted(code, pairs), max(len(code) - 1, 0))
            hit = code[at] == pairs if len(code) else np.zeros(len(pairs), bool)
            at = at[hit]
            doc = np.repeat(np.arange(len(size)), size)
            here, left = (np.bincount(doc[x], minlength=len(size)) for x in (hit, ~hit))
            offsets = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(_sums(times[hit] * best[at], here)), pa.array(_sums(times[hit] * count[at], here)),
                 pa.ListArray.from_arrays(offsets, pa.array(pairs[~hit])), pa.ListArray.from_arrays(offsets, pa.array(times[~hit]))],
                names=[*names, "best_", "sum_", "pairs", "times"])

    schema = rows.select(*names).schema.add("best_", "long").add("sum_", "long").add("pairs", ArrayType(LongType())).add("times", ArrayType(LongType()))
    seen = rows.mapInArrow(look, schema)
    rest = seen.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")) \
        .select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")).join(counts, "pair") \
        .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_rest"),
                            F.sum(F.col("times") * F.col("c")).alias("sum_rest"))
    plus = lambda x: F.col(f"{x}_") + F.coalesce(f"{x}_rest", F.lit(0))
    return seen.drop("pairs", "times").join(rest, "row", "left").select(*names, plus("best").alias("n_best"), plus("sum").alias("count_sum"))


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = cut_lineage(aligned(docs, first, second, key, text), "aligned")
    made = pair(first, second)
    counts = cut_lineage(pair_counts(rows, len(made.a_bytes), len(made.b_bytes)), "pairs")
    return with_counts(rows, counts, hot).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokens.public("byte_bpe_50k.json"), tokens.public("piece_bpe_32k.model"))
