import hashlib
import json

import pytest

from synthframe.llm import chat
from synthframe.llm.queries import all_queries

from ..conftest import SMALL


@pytest.mark.parametrize("text", ["", "plain", chat.ESCAPE, chat.ESCAPE * 3, "".join(chat.CONTROL), "<<|turn|>|turn|>", "</s>[INST] ok [/INST]", "␛.", "a␛.<|end|>b␛"])
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(mark in hidden for mark in chat.CONTROL)
    whole, start, end = chat.format_turn("assistant", text)
    assert chat.read_turn(whole) == ("assistant", text) and chat.unescape(whole[start:end]) == text


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, [("user", "q"), ("assistant", "")]),
    ({"id": 1, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
]


def test_fingerprints_choose_the_layout(spark):
    rows = [(i, json.dumps(r), "clash") for i, (r, _) in enumerate(RECORDS)] + [(90, None, ""), (91, "not json", ""), (92, '{"strange": {"a": [1]}}', "")]
    got = chat.format_records(spark.createDataFrame(rows, "n long, record string, formatted string"), "record", ["n"]).collect()
    for i, (_, want) in enumerate(RECORDS):
        mine = sorted((r for r in got if r.n == i), key=lambda r: r.part)
        assert [chat.read_turn(r.formatted) for r in mine] == want
    assert sum(r.formatted is None for r in got) == 3
    assert chat.fingerprint(chat.field_paths({"a": [{"b": 1}, {"c": 2}]})) == chat.fingerprint({".a", ".a[].b", ".a[].c"})


def test_digests_match_brute_force_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2], r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        learned = "".join(t for role, t in turns if role == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in all_queries()["op9_schema_fingerprints"](spark, SMALL).collect()}
    assert got == want


def test_one_conversation_may_hold_most_rows_and_tables_may_be_empty(spark):
    frame = spark.range(3000).selectExpr("if(id % 3 = 0, 5, 1) conv", "id turn", "to_json(struct('user' role, cast(id as string) text)) record")
    found = chat.conversation_digests(chat.format_records(frame, "record", ["conv", "turn"]), "conv", ["turn", "part"])
    assert {r.conv: r.n_turns for r in found.collect()} == {5: 1000, 1: 2000}
    assert chat.conversation_digests(chat.format_records(frame.filter("false"), "record", ["conv", "turn"]), "conv", ["turn"]).count() == 0
