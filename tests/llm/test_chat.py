import hashlib
import json

import pytest
from pyspark.sql import functions as F, types as T

from loanmart.llm import chat

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                     T.StructField("text", T.StringType()), T.StructField("record", T.StringType()), T.StructField("formatted", T.StringType())])


def records(spark, *found):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(found)], "id long, json string").select(
        "id", F.parse_json("json").alias("record"), F.lit("x").alias("mask")
    )


def read(df):
    turns, learned = chat.read_back(F.col("formatted"), F.col("mask"))
    rows = chat.format_chats(df).select("id", "fingerprint", "formatted", turns.alias("t"), learned.alias("l")).orderBy("id").collect()
    return [([(t["role"], t["text"]) for t in r["t"]], r["l"], r["formatted"], r["fingerprint"]) for r in rows]


def test_layouts_meet_in_canonical_turns(spark):
    got = read(records(
        spark,
        {"messages": [{"role": "user", "content": "q", "id": 1}, {"role": "assistant", "content": "a"}], "meta": {"x": [1]}},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "in", "output": "a"},
        {"prompt": "q", "completion": "a"},
        {"prompt": "q", "response": "a", "system": "s"},
        {"question": "q", "answer": None},
        {"other": 1},
        {"messages": []},
    ))
    qa = [("user", "q"), ("assistant", "a")]
    assert [g[0] for g in got] == [qa, qa, qa, [("user", "q\n\nin"), ("assistant", "a")], qa, [("system", "s"), *qa], [("user", "q"), ("assistant", "")], [], []]
    assert [g[1] for g in got] == [["a"]] * 6 + [[""], [], []]
    assert got[0][2] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert len({g[3] for g in got[:6]}) == 6


@pytest.mark.parametrize("text", ["", "<|im_end|>", "\\", "\\s", "<\\|", "<\\s|", "a\\\\<|<||>\n\\n", "<|im_start|>user\n", "𝄞 é\n\n", "x" * 50000])
def test_any_text_and_role_come_back(spark, text):
    got = read(records(spark, {"messages": [{"role": "assistant", "content": text}, {"role": text, "content": text}, {"role": "user", "content": text}]}))
    assert got[0][0] == [("assistant", text), (text, text), ("user", text)]
    assert got[0][1] == [text]
    assert got[0][2].count("<|im_end|>") == 3


def test_rows_by_turn(spark):
    rows = [(1, 1, "assistant", "b", "r", "f"), (1, 0, "user", "a", None, None), (2, None, None, None, None, None), (None, 0, "assistant", "n", "", ""),
            (3, 0, "user", "t", "", ""), (3, 0, "user", "t", "", ""), (3, 0, "assistant", "t", "", "")]
    got = {r["conv_id"]: r for r in chat.chat_report(chat.records_from_rows(spark.createDataFrame(rows, ROWS))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (2, sha("user\na\nassistant\nb\n"), 1, sha("b"))
    assert got[2]["turns_sha256"] == sha("\n\n") and got[2]["loss_chars"] == 0 and got[2]["formatted_chars"] == 24
    assert got[None]["loss_sha256"] == sha("n")
    assert got[3]["turns_sha256"] == sha("assistant\nt\nuser\nt\nuser\nt\n")
    assert chat.chat_report(chat.records_from_rows(spark.createDataFrame([], ROWS))).count() == 0
