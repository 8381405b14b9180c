"""Quality classifier: a convolutional network over bytes, in numpy.

Every byte has a learned vector; learned filters of WIDTH bytes slide over the text. The text is read in chunks that overlap
by WIDTH - 1 bytes, so every window of the whole text is seen once. Each filter keeps its largest response in a chunk
(rectified); a text keeps for each filter the largest and the mean of its chunks' maxima, and one logistic unit combines
them into the probability of label 1.

Training (Adam, on the driver) uses a bounded sample: at most ``per_class`` texts of each label, those with the smallest
hashes of their ids; of a doc_id with several texts the smallest. All chunks of these texts are learned from, block by block,
so that training pools over a whole text as scoring does. The sample is balanced; weights bring the share of the labels back
to that of all labelled rows. With labels of one kind only, or none, every score is the same constant (the
label, or 0.5). Scoring always reads whole texts. Null and empty texts are scored as texts without bytes. Rows and columns
stay as they are; a column named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .catalog import query, table

WIDTH, DEPTH, FILTERS = 6, 6, 24
CHUNK = 512            # bytes that start a window in one chunk
PER_CLASS = 1000       # labelled texts in training, of each label
EPOCHS = 16
GOOD = 0.7             # predicted is 1 from here on
KEEP = GOOD            # the filter follows the classifier's decision
BLOCK = 1 << 16        # bytes convolved at once
CHUNKS = 128           # chunks convolved at once in training
OUT = ("score", "predicted")


def held_out(key: str = "doc_id") -> Column:
    """Rows that are not learned from; those without a doc_id are none to learn from either."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.5, (256, DEPTH)), "conv": rng.normal(0, 0.3, (WIDTH * DEPTH, FILTERS)),
                  "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "b": np.zeros(1)}
        self.constant: float | None = None

    def tables(self) -> np.ndarray:
        """Response of every filter to every byte at every offset: (WIDTH, 256, FILTERS)."""
        return np.einsum("vd,wdf->wvf", self.p["embed"], self.p["conv"].reshape(WIDTH, DEPTH, FILTERS)).astype(np.float32)

    def maxima(self, data: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Rectified maxima of each chunk of one text, (chunks, FILTERS). Zero bytes follow a text shorter than a filter."""
        if len(data) < WIDTH:
            data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
        last, parts = len(data) - WIDTH + 1, []
        for lo in range(0, last, BLOCK):
            hi = min(last, lo + BLOCK)
            r = tables[0][data[lo:hi]]
            for k in range(1, WIDTH):
                r += tables[k][data[lo + k: hi + k]]
            parts.append(np.maximum.reduceat(r, np.arange(0, hi - lo, CHUNK), axis=0))
        return np.maximum(np.concatenate(parts) + self.p["bias"].astype(np.float32), 0)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        tables = self.tables()
        pooled = [self.maxima(t, tables) for t in texts]
        z = np.array([np.concatenate([m.max(axis=0), m.mean(axis=0)]) for m in pooled]).reshape(-1, 2 * FILTERS)
        z = (z * self.p["out"]).sum(axis=1) + self.p["b"][0]  # row by row, so that equal texts get equal scores in any batch
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, texts: list[list[bytes]], label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, batch: int = 32,
            rate: float = 0.01, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                step += 1
                grads = self._gradients([texts[i] for i in order[at: at + batch]], label[order[at: at + batch]],
                                        weight[order[at: at + batch]])
                for k, g in grads.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    now = rate * (1 - epoch / epochs)
                    self.p[k] -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)

    def _gradients(self, texts: list[list[bytes]], label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        chunks = [np.frombuffer(c.ljust(WIDTH, b"\0"), np.uint8) for t in texts for c in t]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        first = np.searchsorted(owner, np.arange(len(texts)))
        tables = self.tables()
        parts = [self._largest(chunks[at: at + CHUNKS], tables) for at in range(0, len(chunks), CHUNKS)]
        windows, top = (np.concatenate(p) for p in zip(*parts))          # (chunks, FILTERS, WIDTH), (chunks, FILTERS)
        top = top + self.p["bias"]
        act = np.maximum(top, 0)
        most, mean = np.maximum.reduceat(act, first), np.add.reduceat(act, first)
        many = np.diff(np.append(first, len(owner)))[:, None]
        z = np.concatenate([most, mean / many], axis=1)
        p = 1 / (1 + np.exp(-np.clip(z @ self.p["out"] + self.p["b"][0], -30, 30)))
        d = weight * (p - label) / len(texts)
        dz = d[:, None] * self.p["out"]
        dact = dz[owner, FILTERS:] / many[owner] + dz[owner, :FILTERS] * (act == most[owner]) * (act > 0)
        dtop = dact * (top > 0)
        dconv, dembed = np.zeros_like(self.p["conv"]).reshape(WIDTH, DEPTH, FILTERS), np.zeros(256 * DEPTH)
        conv = self.p["conv"].reshape(WIDTH, DEPTH, FILTERS)
        for at in range(0, len(chunks), CHUNKS):
            here, change = windows[at: at + CHUNKS], dtop[at: at + CHUNKS]
            for k in range(WIDTH):
                dconv[k] += np.einsum("cfd,cf->df", self.p["embed"][here[:, :, k]], change)
                spot = here[:, :, k, None].astype(np.int64) * DEPTH + np.arange(DEPTH)
                dembed += np.bincount(spot.ravel(), (change[:, :, None] * conv[k].T).ravel(), 256 * DEPTH)
        dembed = dembed.reshape(256, DEPTH)
        return {"embed": dembed + 1e-4 * self.p["embed"], "conv": dconv.reshape(WIDTH * DEPTH, FILTERS) + 1e-4 * self.p["conv"],
                "bias": dtop.sum(axis=0), "out": z.T @ d + 1e-4 * self.p["out"], "b": np.array([d.sum()])}


    def _largest(self, chunks: list[np.ndarray], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each filter's best window in each chunk, and its response before the bias."""
        width = max(map(len, chunks))
        data = np.zeros((len(chunks), width), np.uint8)
        for i, c in enumerate(chunks):
            data[i, : len(c)] = c
        spots = width - WIDTH + 1
        r = tables[0][data[:, :spots]]
        for k in range(1, WIDTH):
            r += tables[k][data[:, k: spots + k]]
        r[np.arange(spots)[None] > np.array([len(c) - WIDTH for c in chunks])[:, None]] = -1e9
        where = r.argmax(axis=1)                                         # (chunks, FILTERS)
        return data[np.arange(len(data))[:, None, None], where[:, :, None] + np.arange(WIDTH)], \
            np.take_along_axis(r, where[:, None], axis=1)[:, 0]


def all_chunks(text: bytes) -> list[bytes]:
    """The chunks of a text, with the bytes that their last windows reach into."""
    n = max(1, -(-(len(text) - WIDTH + 1) // CHUNK))
    return [text[i * CHUNK: (i + 1) * CHUNK + WIDTH - 1] for i in range(n)]


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", per_class: int = PER_CLASS) -> Network:
    """A network from the texts of ``docs`` that ``labels`` (doc_id, quality 0/1) marks. A doc_id marked twice counts with its
    smaller label; labels without a text, or other than 0 and 1, are left out."""
    marked = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = {r.quality: r.n for r in marked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [marked.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class rows of two numbers

    rows = docs.select("doc_id", F.col(text).alias("t")).filter("t IS NOT NULL").join(few, "doc_id") \
        .groupBy("doc_id", "quality").agg(F.min("t").alias("t")).orderBy("doc_id").collect()
    net, label = Network(), np.array([r.quality for r in rows], float)
    if len(set(label.tolist())) < 2:
        net.constant = float(label[0]) if len(label) else 0.5
        return net
    share = total[1] / (total[0] + total[1])
    weight = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean()))
    net.fit([all_chunks(r.t.encode()) for r in rows], label, weight)
    return net


def judge(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with score and predicted."""
    names = [c for c in docs.columns if c not in OUT]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernels.slices(whole, "judged"):
                data, bounds = kernels.text_bytes(batch["judged"])
                score = net.scores([data[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(score),
                                                  pa.array((score >= GOOD).astype(np.int32))], names=[*names, *OUT])

    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*names, F.col(text).alias("judged")).mapInArrow(work, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier takes for good (score KEEP or more), learned from the labels that are not held out."""
    net = learn(docs, labels.filter(~held_out()))
    names = docs.columns
    judged = judge(docs.select(F.struct(*names).alias("r"), F.col("text").alias("t")), net, "t")
    return judged.filter(F.col("score") >= KEEP).select("r.*")


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = learn(docs, labels.filter(~held_out()))
    return judge(docs.select("doc_id", held_out().alias("held_out"), "text"), net).select("doc_id", "held_out", *OUT)
