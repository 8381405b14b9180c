import pytest
from check import compare, oracle_connection
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from voxmart.llm import catalog, preferences

TURNS = "array<struct<role:string,text:string>>"


def render(turns):
    out, spans = "", []
    for role, text in turns:
        text = (text or "").replace("<|im_start|>", "<\\|im_start|>").replace("<|im_end|>", "<\\|im_end|>")
        out += f"<|im_start|>{role or ''}\n"
        if role == "assistant":
            spans.append((len(out), len(out) + len(text) + 10))
        out += text + "<|im_end|>\n"
    return out, spans


def brute(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    (c, cs), (r, rs) = render(a[n:]), render(b[n:])
    return n, render(a[:n])[0], c, r, cs, rs, bool(cs) and bool(rs)


def test_query_against_sql_and_brute_force(spark):
    for sf in (SF, SF.replace("0.001", "0.01")):
        assert compare(preferences.op7(spark, sf), oracle_connection(sf), catalog.ORACLES["op7_preferences"]) == []
    rows = preferences.op7(spark, SF).collect()
    chats = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in
             preferences.conversations(spark.read.parquet(f"{SF}/conversations.parquet")).collect()}
    assert len(rows) == len(chats) and any(r.prompt_turns > 1 for r in rows)
    for r in rows:
        a = chats[r.conv_id]
        at = [i for i, (role, _) in enumerate(a) if role == "assistant"]
        b = a if not at else a[: at[-1]] + ([a[at[-2]]] if len(at) > 1 else []) + a[at[-1] + 1:]
        want = brute(a, b)
        assert (r.prompt_turns, r.prompt, r.chosen, r.rejected) == want[:4] and r.usable == want[6]
        assert r.chosen_spans == ",".join(f"{x}-{y}" for x, y in want[4])


U, A = ("user", "hi"), ("assistant", "yes <|im_end|> 🙂")
CASES = [([U, A], [U, ("assistant", "no")]), ([U, A], [U, A]), ([U], [U, A]), ([], [U, A]), ([], []), ([A, U], [U, A]),
         ([U, ("assistant", None)], [U, A]), ([U, (None, "x")], [U, ("", "x")]), ([U, A] * 300, [U, A] * 299 + [A]),
         ([U, ("assistant", "long " * 50_000)], [U, ("assistant", "")])]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_pairs(spark, case):
    a, b = CASES[case]
    df = spark.createDataFrame([(1, a, b, "x", 9)], f"id int, chosen {TURNS}, rejected {TURNS}, prompt string, usable int")
    row, = preferences.format_pairs(df).collect()
    clean = lambda turns: [(x or "", y or "") for x, y in turns]
    n, p, c, r, cs, rs, usable = brute(clean(a), clean(b))
    assert (row.prompt_turns, row.prompt, row.chosen, row.rejected, row.usable) == (n, p, c, r, usable)
    assert [tuple(s) for s in row.chosen_spans] == cs and [tuple(s) for s in row.rejected_spans] == rs


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (2, 5, None, ""),
            (3, 1, "assistant", "only")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS turns")
    chats = preferences.conversations(df)
    got = {r.conv_id: r for r in preferences.format_pairs(preferences.stale_reply_pairs(chats)).collect()}
    assert chats.filter("conv_id IS NULL").select(F.size("turns")).collect() == [(1,), (1,)]
    assert set(got) == {1, 2, 3, None} and got[1].prompt_turns == 3 and not got[1].usable
    assert got[3].prompt == "" and got[3].rejected == "" and got[3].chosen.startswith("<|im_start|>assistant\nonly")
    assert preferences.format_pairs(preferences.stale_reply_pairs(preferences.conversations(df.limit(0)))).collect() == []
    none = spark.createDataFrame([(1, None, None)], f"id int, chosen {TURNS}, rejected {TURNS}")
    assert preferences.format_pairs(none).collect()[0].prompt == ""
