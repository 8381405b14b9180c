"""Language identification by error-correcting output codes over hashed byte trigrams.

Each language has a codeword; every bit of the code is one binary question ("is the language one of these?") with its own
classifier: naive Bayes over trigrams, whose weight for a trigram is the log-ratio of its mean frequency in the languages on
both sides. A text answers each question with a margin, the weights averaged over its trigrams. Decoding compares the margins
with every codeword: the loss of a language is the sum of logistic losses of the bits, each weighted by how well its question
separates the learned languages, and the smallest loss wins. Where the runner-up is close, or the text has few letters, the
answer is flagged ambiguous. With up to seven languages the code is exhaustive (all 2**(L-1) - 1 questions); beyond, it has
8 * ceil(log2 L) + 16 questions, the most separated of some random draws with a fixed seed.

Trigram counts are learned from all given rows in one pass (per task one row per language goes to the shuffle).
ASCII letters are lower-cased, other ASCII bytes count as blanks. Texts that are null or have no letter are ``und`` with score
0 and ambiguous. With one learned language every text with a letter gets it; with none all are ``und``. Rows and columns stay
as they are; a column named like an added one is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .catalog import query, table

BITS = 15               # of the trigram hash
SIZE = 1 << BITS
EVIDENCE = 64           # trigrams that count as independent evidence, at most
MARGIN = 0.5            # ambiguous: a loss this close to the smallest one
LETTERS = 3             # ambiguous: fewer trigrams with a letter
BLOCK = 1 << 18         # trigrams looked up at once
BYTES = 2 << 20         # of text in one piece of work; only a single longer text makes it more
UNKNOWN = "und"
OUT = ("lang_pred", "score", "ambiguous")

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the texts, one per byte (each text gets a blank on both sides), -1 where all is blank."""
    n = len(bounds) - 1
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(bounds))
    padded[at] = _FOLD[data]
    code = (padded[at - 1].astype(np.uint32) << 16) | (padded[at].astype(np.uint32) << 8) | padded[at + 1]
    mixed = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    mixed[code == 0x202020] = -1
    return mixed, bounds


def blocks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes."""
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + BLOCK, side="right")) - 1)
        yield lo, hi
        lo = hi


def trigram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, counts binary: SIZE int64): one row per language and task that saw it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in kernels.slices(whole, "t", BYTES)):
            data, bounds = kernels.text_bytes(batch["t"])
            names = batch["l"].to_pylist()
            for lo, hi in blocks(bounds):
                gram, _ = trigrams(data[bounds[lo]: bounds[hi]], bounds[lo: hi + 1] - bounds[lo])
                label = np.array(names[lo:hi], object)
                for name in set(names[lo:hi]):
                    mine = gram[np.repeat(label == name, np.diff(bounds[lo: hi + 1]))]
                    seen.setdefault(name, np.zeros(SIZE, np.int64))
                    seen[name] += np.bincount(mine[mine >= 0], minlength=SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([c.tobytes() for c in seen.values()],
                                                                                      pa.binary())], names=["lang", "counts"])

    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    return rows.mapInArrow(work, "lang string, counts binary")


def _sum_counts(parts: DataFrame) -> DataFrame:
    """One row per language. Tasks first merge their own rows, in two steps, so no task reads more than a share of them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, raw in zip(batch["lang"].to_pylist(), batch["counts"].to_pylist()):
                seen[name] = seen.get(name, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([c.tobytes() for c in seen.values()],
                                                                                      pa.binary())], names=["lang", "counts"])

    return parts.withColumn("part", F.spark_partition_id() % 32).repartition("lang", "part").select("lang", "counts") \
        .mapInArrow(work, parts.schema).repartition("lang").mapInArrow(work, parts.schema)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1; every column splits the languages, no two columns ask the same."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        return np.array([(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c], float).T
    width, rng, best = 8 * math.ceil(math.log2(n)) + 16, np.random.default_rng(seed), None
    for _ in range(20):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


class Model:
    """Languages, their codewords, the weights of the bits' classifiers and the bits' reliability."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        p = np.array([(counts[g] + 0.5) / (counts[g].sum() + 0.5 * SIZE) for g in self.langs]).reshape(-1, SIZE)
        width = self.code.shape[1]
        self.weights, reliable = np.zeros((SIZE, width), np.float32), np.ones(width)
        for b in range(width):
            yes, no = (p[self.code[:, b] == side].mean(axis=0) for side in (1, -1))
            w = np.log(yes) - np.log(no)
            self.weights[:, b] = w
            reliable[b] = max(1e-3, float(np.min(self.code[:, b] * (p @ w))))  # of its worst language
        self.reliable = reliable / reliable.mean() if width else reliable

    def decode(self, margin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language with the least loss, its probability, the lead in loss over the next one."""
        z = margin * np.minimum(size, EVIDENCE)[:, None]
        loss = np.stack([(self.reliable * np.logaddexp(0, -z * c)).sum(axis=1) for c in self.code], axis=1)
        order = np.sort(loss, axis=1)
        lead = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(z), np.inf)
        return loss.argmin(axis=1), 1 / np.exp(order[:, :1] - loss).sum(axis=1), lead

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean weights per text and bit, and the number of trigrams with a letter."""
        n = len(bounds) - 1
        total, size = np.zeros((n, self.weights.shape[1])), np.zeros(n)
        padded = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]), np.float32)])
        for lo, hi in blocks(bounds):
            gram, at = trigrams(data[bounds[lo]: bounds[hi]], bounds[lo: hi + 1] - bounds[lo])
            if hi - lo == 1 and len(gram) > BLOCK:
                hist = np.bincount(gram[gram >= 0], minlength=SIZE)
                total[lo], size[lo] = hist @ self.weights, hist.sum()
                continue
            some = np.flatnonzero(np.diff(at)) if len(gram) else []
            if len(some):
                total[lo + some] = np.add.reduceat(padded[gram], at[some], axis=0)
                size[lo + some] = np.add.reduceat((gram >= 0).astype(np.int64), at[some])
        return total / np.maximum(size, 1)[:, None], size


def with_letters(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts have a letter; only those without one of A-Z are decoded."""
    plain = np.concatenate([[0], np.cumsum((_FOLD[data] > 96) & (data < 128), dtype=np.int64)])[bounds]
    found = plain[1:] > plain[:-1]
    for i in np.flatnonzero(~found & (np.diff(bounds) > 0)).tolist():
        found[i] = any(map(str.isalpha, data[bounds[i]: bounds[i + 1]].tobytes().decode()))
    return found


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows with a text and a language. The driver gets one count table per language."""
    rows = _sum_counts(trigram_counts(docs, text, lang)).collect()
    return Model({r.lang: np.frombuffer(r.counts, np.int64) for r in rows})


def judge(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and whether it is ambiguous, of each text."""
    data, bounds = kernels.text_bytes(texts)
    letters = with_letters(data, bounds)
    pred, score, unsure = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters)), np.ones(len(letters), bool)
    if model.langs and len(letters):
        margin, size = model.margins(data, bounds)
        best, p, lead = model.decode(margin, size)
        pred[letters] = np.array(model.langs, object)[best[letters]]
        score[letters] = p[letters]
        unsure[letters] = ((lead < MARGIN) | (size < LETTERS))[letters]
    return pred, score, unsure


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with lang_pred, score and ambiguous."""
    names = [c for c in docs.columns if c not in OUT]
    # A text that stays is sent to the tasks' Python once.
    held, sent = (text, []) if text in names else ("identified", [F.col(text).alias("identified")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in kernels.slices(whole, held, BYTES)):
            pred, score, unsure = judge(batch[held], model)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(pred, pa.string()), pa.array(score),
                                              pa.array(unsure)], names=[*names, *OUT])

    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return docs.select(*names, *sent).mapInArrow(work, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are not learned from; those without a doc_id are none to learn from either."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language is told without ambiguity, learned from those of ``docs`` that are not held out."""
    model = learn(docs.filter(~held_out()).select("text", "lang"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in kernels.slices(whole, "text", BYTES)):
            yield batch.filter(pa.array(~judge(batch["text"], model)[2]))

    return docs.mapInArrow(work, docs.schema)


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model) \
        .select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
