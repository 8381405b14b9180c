r"""Phrase collocations by SON partitioning, exact and per language.

A-Z are lower-cased; texts are cut into pieces at ``. , ; : ! ?`` and LF..CR, pieces into words at spaces and tabs. A phrase is
up to LONGEST words in a row within a piece; f counts all its occurrences, overlaps included.

1. Mining. Texts are dealt by hash to SHARDS shards, each of which may spread over any number of tasks. A shard is mined
   completely, level by level, at ``support / SHARDS``: a phrase with ``support`` occurrences has that many in one shard at
   least, whatever the shards' real sizes are. A longer phrase is only counted where its two parts of one word less are
   frequent in some shard, as they must be. Mining counts 62-bit hashes: two phrases of one hash can only add a candidate.
2. Union. The hashes of a level's locally frequent phrases become one table of bits, at most 2 ** MOST_BITS of them however
   many phrases there are. A full table prunes less; it loses nothing.
3. Count. One more pass counts the words and all candidates by their spelling, never by a hash. What has ``support``
   occurrences is in the union, so the count is whole.

The score of a phrase is that of its weakest cut in two: floor(1000000 * a * a / (l * r)), in decimals.

Null texts count as empty, a null language is ``und``; repeated rows count as often as they occur. A text is parsed as a whole,
so a task's memory follows its longest text. Empty tables give no rows. Only the named columns are read, so other columns may
have any name. Ties in score go to the larger a, then to the smaller phrase in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from voxmart.session import cut_lineage

from . import kernels
from .catalog import query, table

LONGEST = 3
SUPPORT = 10
SHARDS = 4        # at most four: the lowest two bits of a mined key name the shard
INSIDE = 50       # per cent of a phrase's occurrences that lie in one longer candidate, from which on it is dropped
TOP = 2000
BUFFER = 1 << 21  # hashes a task holds before it combines them
BYTES = 4 << 20   # of text parsed at once; only a single longer text makes it more
MOST_BITS = 27
HOT = 256         # words used by most candidates, whose counts are broadcast
DEALT = 64        # parts of a language that are ranked apart first

U64 = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True


class Parsed:
    """The words of a block of texts.

    word: number of each word in ``spelled``, the block's distinct words; doc: its text; left: how many words follow it in its
    piece, up to LONGEST - 1.
    """

    def __init__(self, texts: pa.Array, longest: int = LONGEST):
        data, bounds = kernels.text_bytes(texts)
        data = kernels.LOWER[data]
        solid = ~_GAP[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        begin[inner] |= solid[inner]
        end[inner - 1] |= solid[inner - 1]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.doc = np.searchsorted(bounds, begin, "right") - 1
        piece = self.doc + np.cumsum(_BREAK[data], dtype=np.int32)[begin]
        offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
        coded = words.dictionary_encode()
        self.word, self.spelled = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        self.left = np.zeros(len(begin), np.int8)
        for k in range(1, longest):
            self.left[:-k][piece[k:] == piece[:-k]] = k
        at = np.frombuffer(self.spelled.buffers()[1], np.int64)[: len(self.spelled) + 1]
        raw = np.frombuffer(self.spelled.buffers()[2] or b"", np.uint8)
        self.hashed = kernels.hash_spans(raw, at[:-1], at[1:])[self.word] if len(self.spelled) else np.empty(0, U64)

    def starts(self, m: int) -> np.ndarray:
        """Where phrases of m words start."""
        return np.flatnonzero(self.left >= m - 1)

    def hashes(self, at: np.ndarray, m: int, salt: np.ndarray) -> np.ndarray:
        """Hashes of the m words from each of ``at``, told apart by the salt of their text."""
        h = salt[self.doc[at]] + U64(m)
        for k in range(m):
            h = (h ^ self.hashed[at + k]) * U64(0xD6E8FEB86659FD93)
            h ^= h >> U64(32)
        return kernels.mix(h)


def _salts(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    return np.array([xxh64_intdigest(x, 7) for x in coded.dictionary.to_pylist()], U64)[np.asarray(coded.indices)]


def _in_table(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    spot = (h >> U64(2)) & U64(8 * len(bits) - 1)
    return (bits[spot >> U64(3)] >> (spot & U64(7)).astype(np.uint8) & 1).astype(bool)


def _promising(parsed: Parsed, m: int, salt: np.ndarray, tables: dict) -> np.ndarray:
    """Where phrases of m words start whose two parts of m - 1 words are candidates."""
    at = parsed.starts(m)
    if m - 1 in tables:
        bits = tables[m - 1].value
        for shift in (0, 1):
            at = at[_in_table(bits, parsed.hashes(at + shift, m - 1, salt))]
    return at


def _mined(rows: DataFrame, m: int, tables: dict) -> DataFrame:
    """(key, c): occurrences of phrases of m words, by hash and shard, combined within tasks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def combined() -> pa.RecordBatch:
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c, pa.int64())], names=["key", "c"])

        for batch in batches:
            for part in kernels.slices(batch, "t", BYTES):
                parsed, salt = Parsed(part["t"]), _salts(part["lang"])
                at = _promising(parsed, m, salt, tables)
                shard = np.asarray(part["shard"]).astype(U64)
                keys = parsed.hashes(at, m, salt) & ~U64(3) | shard[parsed.doc[at]]
                held.append(keys)
                n += len(keys)
                if n >= BUFFER:
                    yield combined()
                    held, n = [], 0
        if n:
            yield combined()

    return rows.mapInArrow(work, "key bigint, c bigint")


def _bit_table(found: DataFrame) -> np.ndarray:
    """Bits at the hashes of a written table, 16 a hash up to the limit, as bytes."""
    bits = min(MOST_BITS, max(16, int(16 * found.count()).bit_length()))
    spot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = found.select(F.shiftright(spot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("m")) \
        .groupBy("w").agg(F.expr("bit_or(m)").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[np.asarray(words["w"])] = np.asarray(words["m"])
    return out.astype("<i8").view(np.uint8)


def _counted(rows: DataFrame, tables: dict, longest: int) -> DataFrame:
    """(lang, w, phrase, c): words and candidates of each block with their occurrences; w = 0 counts all words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "t", BYTES):
                parsed, salt = Parsed(part["t"]), _salts(part["lang"])
                coded = part["lang"].dictionary_encode()
                lang, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
                size = len(parsed.spelled)
                n = np.bincount(lang[parsed.doc], minlength=len(names))
                yield _rows(names, np.arange(len(names)), 0, pa.array([""] * len(names)), n)
                for m in range(1, longest + 1):
                    at = parsed.starts(m)
                    if m > 1:
                        at = at[_in_table(tables[m].value, parsed.hashes(at, m, salt))]
                    code = lang[parsed.doc[at]]
                    for k in range(m):  # numbers of the distinct phrases, exact at every step
                        code = code * size + parsed.word[at + k]
                        if k < m - 1:
                            code = np.unique(code, return_inverse=True)[1]
                    _, one, c = np.unique(code, return_index=True, return_counts=True)
                    first = at[one]
                    words = [parsed.spelled.take(pa.array(parsed.word[first + k])) for k in range(m)]
                    spelled = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if m > 1 else words[0]
                    yield _rows(names, lang[parsed.doc[first]], m, spelled.cast(pa.binary()).cast(pa.string()), c)

    def _rows(names, at, m, phrase, c) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(np.full(len(at), m), pa.int32()), phrase, pa.array(c, pa.int64())],
                                          names=["lang", "w", "phrase", "c"])

    return rows.mapInArrow(work, "lang string, w int, phrase string, c bigint")


def counts(docs: DataFrame, support: int = SUPPORT, text: str = "text", lang: str = "lang", longest: int = LONGEST) -> DataFrame:
    """(lang, w, phrase, f) of all phrases of w words, 1 to ``longest``, with f >= support; w = 0 holds the number of words."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(t.alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.pmod(F.xxhash64(t), F.lit(SHARDS)).alias("shard"))
    tables: dict = {}
    for m in range(2, longest + 1):
        frequent = _mined(rows, m, dict(tables)).groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("c") * SHARDS >= support)
        found = cut_lineage(frequent.select(F.shiftright("key", 2).alias("h")).distinct(), f"phrases-{m}")
        tables[m] = docs.sparkSession.sparkContext.broadcast(_bit_table(found))
    return cut_lineage(_counted(rows, tables, longest).groupBy("lang", "w", "phrase").agg(F.sum("c").alias("f"))
                       .filter((F.col("f") >= support) | (F.col("w") == 0)), "phrase-counts")


def _with_count(rows: DataFrame, known: DataFrame, part: str, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in column ``part``.

    Few words are in very many candidates: the HOT most used ones are broadcast, and what travels by key then holds at most
    one row in HOT under any key.
    """
    of = known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    hot = rows.groupBy("lang", part).count().orderBy(F.desc("count"), "lang", part).limit(HOT).drop("count")
    tried = rows.join(F.broadcast(of.join(F.broadcast(hot), ["lang", part])), ["lang", part], "left")
    rest = tried.filter(F.col(name).isNull()).drop(name).join(of, ["lang", part])
    return tried.filter(F.col(name).isNotNull()).unionByName(rest)


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, w, a, l, r, score) of all candidates: the counts of the cut with the lowest score, the first of such."""
    part = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = found.filter("w > 1").withColumn("words", F.split("phrase", " ")) \
        .select("lang", "phrase", "w", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("w") - 1)).alias("k")) \
        .select("lang", "phrase", "w", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("w")).alias("right"))
    known = found.filter("w > 0")
    both = _with_count(_with_count(cuts, known, "left", "l"), known, "right", "r")
    wide = lambda c: f"cast({c} as decimal(16,0))"
    score = F.expr(f"({wide('a')} * {wide('a')} * cast(1000000 as decimal(7,0))) div ({wide('l')} * {wide('r')})")
    return both.groupBy("lang", "phrase", "w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")) \
        .select("lang", "phrase", "w", "a", "s.l", "s.r", "s.score")


def standing(candidates: DataFrame, longest: int = LONGEST, inside: int = INSIDE) -> DataFrame:
    """The candidates but those of which ``inside`` per cent or more lie in one longer candidate, dropped or not."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("w") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("w") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    inner = candidates.filter("w > 2").withColumn("words", words).select("lang", F.col("a").alias("longer"), F.explode(spans).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return candidates.join(inner, ["lang", "phrase"], "left") \
        .filter(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, top: int = TOP, support: int = SUPPORT, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found = counts(docs, support, text, lang)
    kept = standing(cut_lineage(scored(found), "phrase-scores"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    dealt = kept.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "dealt").orderBy(*order))).filter(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    n = found.filter("w = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
                       'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || chr(32)) AS t FROM documents),
  p AS (SELECT lang, unnest(string_split(t, chr(10))) AS piece FROM d),
  q AS (SELECT row_number() OVER () AS id, lang, list_filter(string_split(piece, chr(32)), lambda x: x <> '') AS ws FROM p),
  w AS (SELECT id, lang, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM q),
  v AS (SELECT lang, a, lead(a, 1) OVER (PARTITION BY id ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY id ORDER BY i) AS c FROM w),
  g AS (SELECT lang, 1 AS m, a AS phrase FROM v
        UNION ALL SELECT lang, 2, a || chr(32) || b FROM v WHERE b IS NOT NULL
        UNION ALL SELECT lang, 3, a || chr(32) || b || chr(32) || c FROM v WHERE c IS NOT NULL),
  f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
  n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
  c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, chr(32)) AS ws FROM f WHERE m > 1 AND f >= 10),
  cuts AS (SELECT c.lang, c.m, c.phrase, a, k, l.f AS l, r.f AS r,
             (1000000::hugeint * a * a) // (l.f::hugeint * r.f) AS score
           FROM c JOIN (VALUES (1), (2)) AS ks(k) ON k < c.m
           JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], chr(32))
           JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:c.m], chr(32))),
  low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  inn AS (SELECT lang, phrase, max(a) AS longer FROM (
            SELECT lang, a, array_to_string(ws[1:2], chr(32)) AS phrase FROM c WHERE m = 3
            UNION ALL SELECT lang, a, array_to_string(ws[2:3], chr(32)) FROM c WHERE m = 3) GROUP BY lang, phrase),
  kept AS (SELECT low.* FROM low LEFT JOIN inn USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n::bigint AS n, score::bigint AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_phrases", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
