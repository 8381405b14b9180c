"""Language model scoring by deleted interpolation of bigrams.

A text is its words (A-Z lower-cased) and an end token; the context of the first word is the end token. The probability of a
word after a context is a mixture of maximum-likelihood estimates,

    p(w | v) = l2 c(v,w)/c(v) + l1 c(w)/N + l0 / (V + 1),

whose weights depend on the bucket (the bit length) of the context's frequency. V distinct words and one class for all unseen
ones share the last term, so the mixture is a distribution. The weights of each bucket are learned by expectation-maximisation
on held-out counts in the deleted way: every training occurrence is taken out of the counts in turn and predicted by the rest,
with (c(v,w)-1)/(c(v)-1) and (c(w)-1)/(N-1). Every word is a context of its own, whatever its frequency, and all counts are exact.

How it runs. One pass counts words; a second one pairs, map-side combined, and sums them up to the statistics of EM; a third
one scores. No table that grows with the corpus is sent to every task: the tasks know the KNOWN most frequent words only (a
matter of speed, results do not depend on it), and the occurrences of pairs travel packed as numpy arrays to a bucket: that of
the pair if both words are known, of the rare word if one is, of the context if both are rare. All training occurrences of a
pair meet there, and they come back as sums per document. The counts of rare words travel to their own bucket and to those of
the rare contexts they follow. Pairs of the HOT most frequent words are counted in the second pass and scored where they are,
so no pair that travels can hold more than 1/HOT of all occurrences.

Words are told apart by 64-bit hashes. Rows are scored one by one, repeated ones too. A null text is empty; a row without
a doc_id is never learned from and counts as held out. Without training rows V and N are zero and every token has p = 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmart.session import cut_lineage

from . import kernels
from .catalog import query, table

KNOWN = 1 << 18        # words that every task knows, at most: a table of 8 MB
HOT = 512              # words whose pairs do not travel, at most: a table of 2 MB
RECORDS = 1_500_000    # occurrences that meet in one bucket, about
FINE = 4               # steps an octave, in which EM's statistics are kept
ROUNDS = 60
BUCKETS = 64           # of context frequency, by bit length; 0: contexts never seen
END = np.uint64(0xE0D0E0D0E0D0E0D1)
U64 = np.uint64
ROW = "bucket bigint, slot bigint, kind int, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
COLUMNS = ROW.replace(" bigint", "").replace(" int", "").replace(" binary", "").split(", ")
# records: both words known; the word rare; a row's own numbers; the context rare; both rare; counts of rare words
FREQUENT, RARE, DOCS, CONTEXT, BOTH, COUNT = range(6)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(True))


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts one after the other, the context of each, and the number of the text it is in."""
    word, first, _ = kernels.words(*kernels.text_bytes(texts))
    size = np.diff(first) + 1
    owner = np.repeat(np.arange(len(size)), size)
    token = np.full(len(owner), END, U64)
    token[np.arange(len(word)) + np.repeat(np.arange(len(size)), size - 1)] = word
    context = np.roll(token, 1)
    context[np.cumsum(size) - size] = END
    return token, context, owner


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(COLUMNS)
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=COLUMNS)


def _small(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of 8 MB of text and fewer than 2**15 rows."""
    for whole in batches:
        for batch in kernels.slices(whole, column):
            for at in range(0, len(batch), 30_000):
                yield batch.slice(at, 30_000)


class Words:
    """The known words, most frequent first, with their counts, and the totals of the corpus."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, least: int):
        self.count, self.tokens, self.distinct, self.least = counts, tokens, distinct, least
        order = np.argsort(words)
        self.sorted, self.rank = words[order], order
        self.n = len(words)
        self.width = U64(max(1, self.n))
        self.hot = min(HOT, self.n)
        self.flat = 1.0 / (distinct + 1)
        self.hot_count = np.zeros((self.hot, self.hot), np.int64)
        self.weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Ranks, -1 for words that are not known."""
        if not self.n:
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.sorted, words), self.n - 1)
        return np.where(self.sorted[at] == words, self.rank[at], -1)

    def log_probability(self, context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 p from the counts of context, pair and word."""
        w = self.weights[np.frexp(context)[1]]
        two = pair / np.maximum(1, context)
        return np.log10(w[:, 0] * two + w[:, 1] * word / max(1, self.tokens) + w[:, 2] * self.flat)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.distinct + 1))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the texts ``t``: hashes of words and how often they occur. Tasks add up pieces before they send them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, U64), np.empty(0, np.int64)]
        for batch in _small(batches, "t"):
            word, n = np.unique(stream(batch["t"])[0], return_counts=True)
            word, inverse = np.unique(np.concatenate([held[0], word]), return_inverse=True)
            held = [word, np.bincount(inverse, np.concatenate([held[1], n])).astype(np.int64)]
            if len(word) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], names=["word", "n"])
                held = [np.empty(0, U64), np.empty(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], names=["word", "n"])

    return docs.mapInArrow(work, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, known: int) -> Words:
    """The totals and, of stored counts, the words seen at least so often that no more than ``known`` are."""
    by = sorted((r.n, r.k) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect())
    total, least = 0, 1 << 62
    for n, k in reversed(by):
        total += k
        if total > known:
            break
        least = n
    top = counts.filter(F.col("n") >= least).toArrow()
    word, n = top["word"].to_numpy().view(U64), top["n"].to_numpy()
    order = np.lexsort((word, -n))
    return Words(word[order], n[order], sum(n * k for n, k in by), sum(k for _, k in by), least)


def _five(pair: np.ndarray) -> bytes:
    return np.ascontiguousarray(pair.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = _numbers(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _split(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and where their records are."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    ends = np.bincount(bucket, minlength=n).cumsum()
    for b in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        yield b, order[(ends[b - 1] if b else 0): ends[b]]


def _buckets(words: Words) -> int:
    return 1 << max(2, int(words.tokens // RECORDS).bit_length())


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "slot", "kind")


def _by_bucket(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """Rows of one bucket after the other."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _place(words: np.ndarray, n: int) -> np.ndarray:
    return (kernels.mix(words) >> U64(64 - (n.bit_length() - 1))).astype(np.int64)


def rare_counts(docs: DataFrame, counts: DataFrame, words: Words) -> DataFrame:
    """COUNT records: the count of each rare word, for its own bucket and for the buckets of the rare contexts that it follows in
    the texts ``t``."""
    n, known = _buckets(words), docs.sparkSession.sparkContext.broadcast(words)
    rare = counts.filter(F.col("n") < words.least)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = _place(np.asarray(batch["word"]).view(U64), n)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch["word"], batch["n"]], names=["bucket", "word", "n"])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in _small(batches, "t"):
            token, context, _ = stream(batch["t"])
            both = (model.find(token) < 0) & (model.find(context) < 0)
            word, bucket = token[both], _place(context[both], n)
            away = _place(word, n) != bucket
            some = np.unique(np.stack([word[away], bucket[away].astype(U64)], axis=1), axis=0).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(some[:, 1].copy()), pa.array(some[:, 0].copy())], names=["bucket", "word"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, times = np.asarray(batch["word"]).view(U64), np.asarray(batch["n"]).astype("<i8")
            yield _batch([(b, -1, COUNT, word[at].tobytes(), times[at].tobytes(), *[None] * 5)
                          for b, at in _split(np.asarray(batch["bucket"]), n)])

    far = docs.mapInArrow(wanted, "bucket bigint, word bigint").distinct().join(rare, "word").select("bucket", "word", "n")
    return rare.mapInArrow(own, "bucket bigint, word bigint, n bigint").unionByName(far) \
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pack, ROW)


def _look_up(rows: list[dict]):
    """From words to their counts, by the COUNT records of a bucket; 0 for words that have none."""
    mine = [r for r in rows if r["kind"] == COUNT]
    word = np.concatenate([np.empty(0, U64), *(_numbers(r["a"], U64) for r in mine)])
    count = np.concatenate([np.empty(0, np.int64), *(_numbers(r["b"], "<i8") for r in mine)])
    order = np.argsort(word)
    word, count = np.append(word[order], U64(0)), np.append(count[order], 0)

    def look(words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(word[:-1], words)
        return np.where(word[at] == words, count[at], 0)
    return look


def _occurrences(model: Words, token: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """Ranks of tokens and contexts, and by kind: the occurrences, the word whose bucket they go to, and the other word."""
    rank, before = model.find(token), model.find(context)
    w, v = rank >= 0, before >= 0
    kinds = {RARE: np.flatnonzero(v & ~w), CONTEXT: np.flatnonzero(w & ~v), BOTH: np.flatnonzero(~v & ~w)}
    return rank, before, {RARE: (kinds[RARE], token[kinds[RARE]], before[kinds[RARE]].astype("<u4")),
                          CONTEXT: (kinds[CONTEXT], context[kinds[CONTEXT]], rank[kinds[CONTEXT]].astype("<u4")),
                          BOTH: (kinds[BOTH], context[kinds[BOTH]], token[kinds[BOTH]])}


def _group(key: np.ndarray, other: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct (key, other) occurs first, the sum of its times, and the number of the pair of each occurrence."""
    order = np.lexsort((other, key))
    k, o = key[order], other[order]
    fresh = np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))[: len(k)]
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return order[fresh], np.bincount(inverse, times, fresh.sum()), inverse


def _meet(model: Words, look, kind: int, rows: list[dict], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of context, pair and word of the distinct pairs of a kind, and the number of the pair of each occurrence."""
    key = np.concatenate([_numbers(r["a"], U64) for r in rows])
    other = np.concatenate([_numbers(r["c"], U64 if kind == BOTH else "<u4") for r in rows])
    first, pair, inverse = _group(key, other, times)
    near, far = look(key[first]), look(other[first]) if kind == BOTH else model.count[other[first]]
    return (far, pair, near, inverse) if kind == RARE else (near, pair, far, inverse)


def learn(docs: DataFrame, known_words: int = KNOWN) -> tuple[Words, DataFrame]:
    """From the rows of ``docs`` (held_out, t) that are not held out: words, weights and counts of hot pairs; and the stored counts of rare
    words as the buckets need them to score ``docs``. The driver gets the known words, the table of hot pairs and EM's statistics,
    all of bounded size."""
    spark, texts = docs.sparkSession, docs.filter("NOT held_out").select("t")
    counts = cut_lineage(count_words(texts), "words")
    words = frequent_words(counts, known_words)
    n, known = _buckets(words), spark.sparkContext.broadcast(words)
    rare = cut_lineage(rare_counts(docs.select("t"), counts, words), "rare_words")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in _small(batches, "t"):
            token, context, _ = stream(batch["t"])
            rank, before, kinds = _occurrences(model, token, context)
            rows, both = [], (rank >= 0) & (before >= 0)
            pair, times = np.unique(rank[both].astype(U64) * model.width + before[both].astype(U64), return_counts=True)
            for b, at in _split(_place(pair, n), n):
                rows.append((b, 0, FREQUENT, _five(pair[at]), times[at].astype("<u4").tobytes(), *[None] * 5))
            for kind, (at, key, other) in kinds.items():
                first, times, _ = _group(key, other, np.ones(len(at)))
                key, other, times = key[first], other[first], times.astype("<u4")
                for b, at in _split(_place(key, n), n):
                    rows.append((b, 0, kind, key[at].tobytes(), times[at].tobytes(), other[at].tobytes(), *[None] * 4))
            yield _batch(rows)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, weight): for EM, cell >= 0; for hot pairs, cell = -1 - pair."""
        model = known.value
        for rows in _by_bucket(batches, "bucket"):
            out, look = [(np.empty(0, np.int64), np.empty(0))], _look_up(rows)
            mine = [r for r in rows if r["kind"] == FREQUENT]
            if mine:
                pair, inverse = np.unique(np.concatenate([_from_five(r["a"]) for r in mine]), return_inverse=True)
                times = np.bincount(inverse, np.concatenate([_numbers(r["b"], "<u4") for r in mine]))
                rank, before = (pair // model.width).astype(np.int64), (pair % model.width).astype(np.int64)
                out.append(_cells(model, model.count[before], times, model.count[rank]))
                hot = (rank < model.hot) & (before < model.hot)
                out.append((-1 - (rank[hot] * model.hot + before[hot]), times[hot]))
            for kind in (RARE, CONTEXT, BOTH):
                mine = [r for r in rows if r["kind"] == kind]
                if mine:
                    context, pair, word, _ = _meet(model, look, kind, mine, np.concatenate([_numbers(r["b"], "<u4") for r in mine]))
                    out.append(_cells(model, context, pair, word))
            cell, inverse = np.unique(np.concatenate([c for c, _ in out]), return_inverse=True)
            weight = np.bincount(inverse, np.concatenate([w for _, w in out]), len(cell))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(weight)], names=["cell", "weight"])

    found = _dealt(texts.mapInArrow(pairs, ROW).unionByName(rare), n).mapInArrow(cells, "cell bigint, weight double") \
        .groupBy("cell").agg(F.sum("weight").alias("weight")).toArrow()
    cell, weight = found["cell"].to_numpy(), found["weight"].to_numpy()
    hot = cell < 0
    words.hot_count.ravel()[-1 - cell[hot]] = weight[hot].astype(np.int64)
    words.weights = expectation_maximisation(cell[~hot], weight[~hot], BUCKETS)
    return words, rare


def _cells(model: Words, context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the two deleted estimates in proportion to the flat one, in steps of 1/FINE octave (0: the estimate is zero)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        two = (pair - 1) / (context - 1) / model.flat
        one = (word - 1) / (model.tokens - 1) / model.flat
        step = [np.where(x > 0, np.clip(np.rint(FINE * np.log2(np.where(x > 0, x, 1))) + 512, 1, 1023), 0).astype(np.int64) for x in (two, one)]
    return (np.frexp(context)[1].astype(np.int64) * 1024 + step[0]) * 1024 + step[1], pair


def expectation_maximisation(cell: np.ndarray, weight: np.ndarray, buckets: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (pair, word, flat) of each bucket. Buckets without occurrences, as of contexts never seen, get weights of
    word and flat alone, learned from all occurrences."""
    bucket, step = cell >> 20, np.stack([cell >> 10 & 1023, cell & 1023], axis=1)
    f = np.concatenate([np.where(step > 0, 2.0 ** ((step - 512) / FINE), 0), np.ones((len(cell), 1))], axis=1)
    out = _mixtures(bucket, f, weight, buckets, rounds)
    out[np.bincount(bucket, minlength=buckets) == 0] = _mixtures(np.zeros(len(cell), int), f * [0, 1, 1], weight, 1, rounds)[0]
    # a word never seen may follow any context, so the flat part is never quite zero
    out = np.maximum(out, [0, 0, 1e-6])
    return out / out.sum(axis=1, keepdims=True)


def _mixtures(bucket: np.ndarray, f: np.ndarray, weight: np.ndarray, buckets: int, rounds: int) -> np.ndarray:
    out = np.full((buckets, 3), 1 / 3) if len(bucket) else np.tile([0.0, 0.0, 1.0], (buckets, 1))
    for _ in range(rounds):
        part = out[bucket] * f
        part *= (weight / part.sum(axis=1))[:, None]
        total = np.stack([np.bincount(bucket, part[:, k], buckets) for k in range(3)], axis=1)
        seen = total.sum(axis=1) > 0
        out[seen] = total[seen] / total[seen].sum(axis=1, keepdims=True)
    return out


def score(docs: DataFrame, words: Words, rare: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for rows of ``docs`` (doc_id, held_out, t), by what
    ``learn`` returned for them."""
    n, known = _buckets(words), docs.sparkSession.sparkContext.broadcast(words)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slot = known.value, TaskContext.get().partitionId() << 24
        for batch in _small(batches, "t"):
            token, context, owner = stream(batch["t"])
            held = np.asarray(batch["held_out"].fill_null(True)).astype(bool)
            rank, before, kinds = _occurrences(model, token, context)
            some, both = rank >= 0, (rank >= 0) & (before >= 0)
            hot = both & (rank < model.hot) & (before < model.hot)
            size, docs_ = np.bincount(owner), len(held)
            local = np.bincount(owner[hot], model.log_probability(model.count[before[hot]], model.hot_count[rank[hot], before[hot]],
                                                                  model.count[rank[hot]]), docs_)
            base = np.bincount(owner[some], model.base(model.count[rank[some]]), docs_)
            ids = batch["doc_id"]
            rows = [(slot & (n - 1), slot, DOCS, np.asarray(ids.fill_null(0)).astype("<i8").tobytes(), np.asarray(ids.is_null()).astype(np.uint8).tobytes(),
                     held.astype(np.uint8).tobytes(), size.astype("<i8").tobytes(), np.bincount(owner[some], minlength=docs_).astype("<i8").tobytes(),
                     base.tobytes(), local.tobytes())]
            mark = (owner | np.where(held, 0, 1 << 15)[owner]).astype("<u2")  # the top bit: counts as training
            far = np.flatnonzero(both & ~hot)
            pair = rank[far].astype(U64) * model.width + before[far].astype(U64)
            for b, at in _split(_place(pair, n), n):
                rows.append((b, slot, FREQUENT, _five(pair[at]), mark[far[at]].tobytes(), *[None] * 5))
            for kind, (far, key, other) in kinds.items():
                for b, at in _split(_place(key, n), n):
                    rows.append((b, slot, kind, key[at].tobytes(), mark[far[at]].tobytes(), other[at].tobytes(), *[None] * 4))
            yield _batch(rows)
            slot += 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for rows in _by_bucket(batches, "bucket"):
            out, look = [tuple(r[c] for c in COLUMNS) for r in rows if r["kind"] == DOCS], _look_up(rows)
            mine = [r for r in rows if r["kind"] == FREQUENT]
            if mine:
                mark = np.concatenate([_numbers(r["b"], "<u2") for r in mine])
                pair, inverse = np.unique(np.concatenate([_from_five(r["a"]) for r in mine]), return_inverse=True)
                times = np.bincount(inverse, mark >> 15)
                rank, before = (pair // model.width).astype(np.int64), (pair % model.width).astype(np.int64)
                p = model.log_probability(model.count[before], times, model.count[rank])[inverse]
                out += back(mine, mark, p, None, None)
            for kind in (RARE, CONTEXT, BOTH):
                mine = [r for r in rows if r["kind"] == kind]
                if mine:
                    mark = np.concatenate([_numbers(r["b"], "<u2") for r in mine])
                    context, pair, word, inverse = _meet(model, look, kind, mine, mark >> 15)
                    p = model.log_probability(context, pair, word)[inverse]
                    base, seen = (None, None) if kind == CONTEXT else (model.base(word)[inverse], (word > 0)[inverse])
                    out += back(mine, mark, p, base, seen)
            yield _batch(out)

    def back(rows: list[dict], mark: np.ndarray, p: np.ndarray, base: np.ndarray | None, seen: np.ndarray | None) -> list[tuple]:
        out, at = [], 0
        for r in rows:
            here = slice(at, at + len(r["b"]) // 2)
            at = here.stop
            owner = (mark[here] & 0x7FFF).astype(np.int64)
            who = np.unique(owner)
            sums = [np.bincount(owner, x[here])[who] for x in (p, base, seen) if x is not None]
            out.append((r["slot"], r["slot"], r["kind"], who.astype("<u2").tobytes(), *(s.tobytes() for s in sums), *[None] * (6 - len(sums))))
        return out

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for rows in _by_bucket(batches, "slot"):
            d, = (r for r in rows if r["kind"] == DOCS)
            size, seen = _numbers(d["d"], "<i8"), _numbers(d["e"], "<i8").astype(np.float64)
            base, total = _numbers(d["f"], np.float64).copy(), _numbers(d["g"], np.float64).copy()
            for r in rows:
                if r["kind"] != DOCS:
                    who = _numbers(r["a"], "<u2").astype(np.int64)
                    total[who] += _numbers(r["b"], np.float64)
                    if r["kind"] in (RARE, BOTH):
                        base[who] += _numbers(r["c"], np.float64)
                        seen[who] += _numbers(r["d"], np.float64)
            yield pa.RecordBatch.from_arrays([
                pa.array(_numbers(d["a"], "<i8"), mask=_numbers(d["b"], np.uint8).astype(bool)), pa.array(_numbers(d["c"], np.uint8).astype(bool)),
                pa.array(size), pa.array(np.rint(seen).astype(np.int64)), pa.array(np.full(len(size), model.tokens)), pa.array(base), pa.array(total)],
                names=names)

    met = _dealt(docs.mapInArrow(send, ROW).unionByName(rare), n).mapInArrow(meet, ROW)
    return met.repartition("slot").sortWithinPartitions("slot", "kind", "bucket").mapInArrow(
        add, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


@query("op6_language_model")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("t"))
    return score(docs, *learn(docs.select("held_out", "t")))
