import hashlib

from pagewright.llm.chat_format import chat_examples, conversation_digests

SAID = "\\### Assistant: </turn> ok"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted int, last string, head string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    talks = {}
    for conv, turn, role, text, *_ in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out.add((conv, len(turns), digest(told), len(loss), digest(loss)))
    return out


def test_read_back_is_exact(spark):
    hard = [SAID, "\\", "\\\\b", "<turn user>\nx</turn>\n", "</tu</turn>rn>", "a>\n", "", None, "é\U0001f600" * 9, "<turn </turn>", "\\c\\o\\g", "x" * 200_000]
    rows = [(1, i, ("user", "assistant")[i % 2], t, 1, "", "") for i, t in enumerate(hard)]
    rows += [(2, i, ("assistant", "us>er", "</turn>", None)[i % 4], t, 1, "", "") for i, t in enumerate(hard)]
    rows += [(3, 0, "user", "only", 1, "", ""), (None, None, "assistant", "b", 1, "", ""), (None, 3, "assistant", "a", 1, "", "")]
    rows += [(4, 1, "assistant", "same", 1, "", "")] * 3 + [(4, 1, "user", "tie", 1, "", "")]
    found = conversation_digests(chat_examples(spark.createDataFrame(rows, SCHEMA)))
    assert {tuple(r)[:5] for r in found.collect()} == expected(rows)


def test_examples_hold_context_and_one_reply(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "bye")]
    df = chat_examples(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    found = sorted(df.collect(), key=lambda r: r.n_turns)
    assert [r.n_turns for r in found] == [2, 4, 5] and [r.last for r in found] == [False, False, True]
    assert [r.loss_start and r.formatted[r.loss_start :][: r.loss_length] for r in found] == ["a1", "a2", None]
    assert found[1].formatted.startswith(found[0].formatted) and found[1].formatted.count("<turn ") == 4


def test_empty_table_and_native_plan(spark):
    df = conversation_digests(chat_examples(spark.createDataFrame([], SCHEMA)))
    assert df.collect() == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
