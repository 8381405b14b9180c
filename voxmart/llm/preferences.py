"""Chat formatting of preference pairs, in DataFrame operations only.

A pair is two conversations, each an array of turns (role, text). The turns they begin with in common are rendered once, as the
prompt; what follows is rendered for each as its completion. The mask of a completion is the spans to be trained: of every
assistant turn the text and the end mark, nothing of the other turns or of headers. Spans are in characters from the start of
the completion.

Turns are rendered as ``<|im_start|>role LF text <|im_end|> LF``. Control marks in a text are rendered as ``<\\|im_start|>``, so
a text cannot open or close a turn. Null roles and texts count as empty. Where one conversation begins with all of the other,
the shorter one's completion is empty; ``usable`` is true where both completions have something to train and differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def plain(turns: Column) -> Column:
    return F.transform(F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>")), lambda t: F.struct(
        F.coalesce(t["role"], F.lit("")).alias("role"),
        F.regexp_replace(F.coalesce(t["text"], F.lit("")), r"<\|(im_start|im_end)\|>", r"<\\|$1|>").alias("text")))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations begin with in common."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first > 0, (first - 1).cast("int")).otherwise(shorter)


def rendered(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def spans(turns: Column) -> Column:
    """array<struct<start,end>> of what is trained in rendered turns."""
    empty = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.array().cast("array<struct<start:bigint,end:bigint>>").alias("found"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + len(OPEN) + F.length(t["role"]) + 1
        end = start + F.length(t["text"]) + len(CLOSE)
        mine = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"),
                        F.when(t["role"] == "assistant", F.concat(state["found"], mine)).otherwise(state["found"]).alias("found"))

    return F.aggregate(turns, empty, step, lambda s: s["found"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """The other columns of ``pairs`` and prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans, usable."""
    added = ["prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans", "usable"]
    names = [c for c in pairs.columns if c not in (chosen, rejected, *added)]
    both = pairs.select(*names, plain(F.col(chosen)).alias("chosen"), plain(F.col(rejected)).alias("rejected"))
    split = both.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(F.col(c), F.col("prompt_turns") + 1, F.size(c))
    cut = split.select(*names, "prompt_turns", F.slice("chosen", 1, F.col("prompt_turns")).alias("prompt"),
                       rest("chosen").alias("c"), rest("rejected").alias("r"))
    out = cut.select(*names, "prompt_turns", render(F.col("prompt")).alias("prompt"), render(F.col("c")).alias("chosen"),
                     render(F.col("r")).alias("rejected"), spans(F.col("c")).alias("chosen_spans"), spans(F.col("r")).alias("rejected_spans"))
    return out.withColumn("usable", (F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0))


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: key and ``turns``, by turn number, then role and text; nulls first. A conversation is one
    record, so its turns come together; nothing says that rows without a key belong together, so each is a conversation of its own."""
    turn, known = F.struct("turn", "role", "text"), F.col(key).isNotNull()
    each = turns.filter(known).groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    alone = turns.filter(~known).select(key, F.array(turn).alias("turns"))
    return each.unionByName(alone) \
        .select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def stale_reply_pairs(chats: DataFrame) -> DataFrame:
    """Pairs out of single conversations: chosen is the conversation, in rejected the assistant's last reply is the one before
    it said again, or is left out if it is the only one. Without any reply both are the same."""
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.coalesce(F.get("turns", i - 1)["role"] == "assistant", F.lit(False)))
    at = chats.withColumn("replies", replies).withColumns({
        "last": F.get("replies", F.size("replies") - 1), "previous": F.get("replies", F.size("replies") - 2)})
    before, after = F.slice("turns", 1, F.col("last") - 1), F.slice("turns", F.col("last") + 1, n)
    again = F.when(F.col("previous").isNotNull(), F.array(F.get("turns", F.col("previous") - 1))) \
        .otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return at.select(*[c for c in chats.columns if c != "turns"], F.col("turns").alias("chosen"),
                     F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.concat(before, again, after)).alias("rejected"))


def listed(c: str) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")


_RENDER = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"
_SIDE = """
    {0}_cut AS (SELECT t.conv_id, t.i, t.role, {render} AS line,
                       {head} + length(t.role) AS header, length(t.text) + {tail} AS trained
                FROM {0} t JOIN common USING (conv_id) WHERE t.i > prompt_turns),
    {0}_at AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
                                                          AND 1 PRECEDING), 0) + header AS start FROM {0}_cut),
    {0}_out AS (SELECT conv_id, string_agg(line, '' ORDER BY i) AS {0},
                       string_agg(CASE WHEN role = 'assistant' THEN CAST(start AS BIGINT) || '-' || CAST(start + trained AS BIGINT) END,
                                  ',' ORDER BY i) AS {0}_spans
                FROM {0}_at GROUP BY conv_id)"""
_ORACLE = """
    WITH chosen AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
                           coalesce(role, '') AS role,
                           regexp_replace(coalesce(text, ''), '<\\|(im_start|im_end)\\|>', '<\\\\|\\1|>', 'g') AS text
                    FROM conversations),
    last_reply AS (SELECT conv_id, max(i) AS l FROM chosen WHERE role = 'assistant' GROUP BY conv_id),
    earlier AS (SELECT c.conv_id, max(c.i) AS p FROM chosen c JOIN last_reply USING (conv_id)
                WHERE role = 'assistant' AND i < l GROUP BY c.conv_id),
    rejected AS (SELECT c.conv_id, CASE WHEN p IS NULL AND i > l THEN i - 1 ELSE i END AS i, c.role,
                        CASE WHEN i = l THEN (SELECT x.text FROM chosen x WHERE x.conv_id = c.conv_id AND x.i = p) ELSE c.text END AS text
                 FROM chosen c LEFT JOIN last_reply USING (conv_id) LEFT JOIN earlier USING (conv_id)
                 WHERE l IS NULL OR i <> l OR p IS NOT NULL),
    common AS (SELECT conv_id, coalesce(min(CASE WHEN a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text THEN i END) - 1,
                                        max(i)) AS prompt_turns
               FROM chosen a FULL JOIN rejected b USING (conv_id, i) GROUP BY conv_id),
    prompts AS (SELECT t.conv_id, string_agg({render}, '' ORDER BY i) AS prompt
                FROM chosen t JOIN common USING (conv_id) WHERE i <= prompt_turns GROUP BY t.conv_id),
    {chosen}, {rejected}
    SELECT c.conv_id, CAST(prompt_turns AS INTEGER) AS prompt_turns, coalesce(prompt, '') AS prompt,
           coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected, coalesce(chosen_spans, '') AS chosen_spans,
           coalesce(rejected_spans, '') AS rejected_spans,
           coalesce(chosen_spans, '') <> '' AND coalesce(rejected_spans, '') <> '' AS usable
    FROM common c LEFT JOIN prompts USING (conv_id) LEFT JOIN chosen_out USING (conv_id) LEFT JOIN rejected_out USING (conv_id)"""
_PARTS = {"render": _RENDER, "head": len(OPEN) + 1, "tail": len(CLOSE)}


@query("op7_preferences", _ORACLE.format(render=_RENDER, chosen=_SIDE.format("chosen", **_PARTS),
                                         rejected=_SIDE.format("rejected", **_PARTS)))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = format_pairs(stale_reply_pairs(conversations(table(spark, sf_dir, "conversations"))))
    return pairs.select("conv_id", "prompt_turns", "prompt", "chosen", "rejected", listed("chosen_spans").alias("chosen_spans"),
                        listed("rejected_spans").alias("rejected_spans"), "usable")
