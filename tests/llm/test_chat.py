import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from __spark_entry__ import oracle_sql
from cohortspark.llm import chat as C
from cohortspark.llm.op01_chat import HOSTILE, op1_chat

PARTS = st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "[", "|end|>", "a", "\n", "é", "probe"]), max_size=8).map("".join)


@given(PARTS)
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible_and_hides_control_strings(text):
    hidden = C.escape(text)
    assert C.unescape(hidden) == text
    assert not any(c in hidden for c in C.CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<|end|>"]), PARTS), max_size=40))
@settings(max_examples=100, deadline=None)
def test_spans_and_pieces_of_all_turns(turns):
    renderer = C.Renderer(C.marked_turns, "assistant")
    rows = [renderer.turn({"role": r, "text": t}) for r, t in turns]
    whole = C.marked_turns([{"role": r, "text": t} for r, t in turns])
    assert "".join(r["piece"] for r in rows) == whole
    for row, (role, text) in zip(rows, turns, strict=True):
        assert whole[row["start"] : row["end"]] == row["piece"] and not row["rewrites"]
        assert C.read_back(row["piece"]) == (role, text)
        assert C.unescape(whole[row["text_start"] : row["text_end"]]) == text
        assert row["in_loss"] == (role == "assistant")


def test_template_that_rewrites_history_is_found():
    """Drops the thoughts of earlier answers as soon as another turn follows."""

    def forgetful(messages):
        last = len(messages) - 1
        return "".join(f"[{m['role']}]{m['text'] if k == last else m['text'].split('</think>')[-1]}\n" for k, m in enumerate(messages))

    renderer = C.Renderer(forgetful, "assistant")
    rows = [renderer.turn({"role": r, "text": t}) for r, t in (("user", "q"), ("assistant", "<think>x</think>a"), ("user", "r"))]
    assert [r["rewrites"] for r in rows] == [False, False, True]
    assert rows[2]["rewritten_from"] == len("[user]q\n[assistant]")


def test_templates_without_declared_reach_see_the_whole_prefix():
    """One that numbers its turns, and one that rewrites the first of many turns late."""

    def numbered(messages):
        return "".join(f"{k}:{m['text']}\n" for k, m in enumerate(messages))

    def late(messages):
        return "".join(f"{'~' if k == 5 and len(messages) > 40 else ''}{m['text']}\n" for k, m in enumerate(messages))

    turns = [{"role": "user", "text": f"t{k}"} for k in range(60)]
    renderer = C.Renderer(numbered, "user")
    rows = [renderer.turn(m) for m in turns]
    whole = numbered(turns)
    assert "".join(r["piece"] for r in rows) == whole
    assert [whole[r["text_start"] : r["text_end"]] for r in rows] == [m["text"] for m in turns]
    renderer = C.Renderer(late, "user")
    rows = [renderer.turn(m) for m in turns]
    assert [k for k, r in enumerate(rows) if r["rewrites"]] == [40]
    assert rows[40]["rewritten_from"] == len(late(turns[:5]))
    renderer = C.Renderer(C.marked_turns, "user")
    assert all(not renderer.turn(m)["rewrites"] for m in turns) and len(renderer.window) == C.HEAD + C.REACH


def test_declared_reach_bounds_the_window():
    renderer = C.Renderer(lambda messages: "".join(m["text"] for m in messages), "user", 3)
    for k in range(30):
        assert renderer.turn({"role": "user", "text": f"t{k}"})["piece"] == f"t{k}"
    assert len(renderer.window) == C.HEAD + 3


def test_digests_of_awkward_rows(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", HOSTILE), (1, 2, None, None), (1, 3, "assistant", None), (1, 3, "assistant", None),
        (None, 0, "assistant", "ü" * 3), (2, None, "system", "s"), (2, 5, "assistant", "<|end|>\n<|start|>user"),
    ]
    turns += [(3, k, "assistant" if k % 2 else "user", f"turn {k} " + "x" * k) for k in range(500)]
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, piece string")
    got = {r["conv"]: r for r in C.digests(C.format_turns(table)).collect()}
    for conv in (1, 2, 3, None):
        mine = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        learnt = "".join(t for r, t in mine if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(mine) and not row["rewrites"]
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert row["formatted_chars"] == len(C.marked_turns([{"role": r, "text": t} for r, t in mine]))
    assert C.digests(C.format_turns(table.limit(0))).count() == 0


def test_turns_without_a_number_come_first_in_sql_too(spark, tmp_path):
    rows = [(1, 2, "assistant", "c"), (1, None, "user", "a"), (1, 1, "assistant", "b"), (2, None, "assistant", None), (2, 0, None, "<|end|>")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    got = op1_chat(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    answer = con.execute(oracle_sql()["op1_chat"])
    names = [d[0] for d in answer.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(answer.fetchall())
