from __future__ import annotations

import random

from pyspark.sql import functions as F

from sortfolio.llm import chat

PARTS = ["\\", "<", "[", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<<SYS>>", "\n", " ", "a", "é😀", "\\\\[INST]", "$1", "im_end|>", "s>"]


def escaped(t: str) -> str:
    t = t.replace("\\", "\\\\")
    for i in range(len(t) - 1, -1, -1):
        if any(t.startswith(c, i) for c in chat.CONTROLS):
            t = t[: i + 1] + "\\" + t[i + 1 :]
    return t


def test_round_trip_of_every_layout(spark):
    r = random.Random(6)
    text = lambda: "".join(r.choices(PARTS, k=r.randint(0, 12)))
    turns = [[(r.choice(["user", "assistant", "system", "tool", "[INST]"]), text()) for _ in range(r.randint(1, 6))] for _ in range(60)]
    records = spark.createDataFrame([(i, [{"role": a, "content": t} for a, t in x], None, None, 5) for i, x in enumerate(turns)]
                                    + [(100, None, "ask</s>", "answer [INST]", 5), (101, None, "only a prompt", None, 5)],
                                    "conv_id int, messages array<struct<role:string,content:string>>, prompt string, completion string, turns int")
    out = chat.format_chats(chat.canonical_turns(records.drop("turns"), ("conv_id",)))
    got = {x.conv_id: x for x in out.select("*", chat.parsed(F.col("formatted")).alias("back"),
                                            chat.masked(F.col("formatted"), F.col("loss_mask")).alias("learnt")).collect()}
    for i, x in enumerate(turns):
        assert [tuple(t) for t in got[i].back] == x and got[i].layout == "messages"
        assert got[i].learnt == "".join(t for a, t in x if a == "assistant")
        assert got[i].formatted == "".join(f"<|im_start|>{escaped(a)}\n{escaped(t)}<|im_end|>\n" for a, t in x)
        masked, at = "", 0
        for m in got[i].loss_mask:
            masked += got[i].formatted[at + m.skip : at + m.skip + m.length] if m.learn else ""
            at += m.skip + m.length + len(chat.END) + 1
        assert at == len(got[i].formatted) and masked == "".join(escaped(t) for a, t in x if a == "assistant")
    assert [tuple(t) for t in got[100].back] == [("user", "ask</s>"), ("assistant", "answer [INST]")] and got[100].layout == "prompt"
    assert got[101].layout == "unknown" and got[101].turns is None


def test_mixed_json_records(spark):
    lines = ['{"instruction":"add","input":"1 2","output":"3"}', '{"instruction":"hi","output":"ho"}', '{"question":"q","answer":"a","system":"s"}',
             '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":null},{"from":"gpt","value":"y"}]}', '{"other":{"deep":[1]}}', "{}"]
    records = spark.read.json(spark.createDataFrame([(x,) for x in lines], "value string").rdd.map(lambda r: r.value))
    got = sorted((r.layout, [tuple(t) for t in r.turns or []]) for r in chat.canonical_turns(records, ()).collect())
    assert got == sorted([("instruction", [("user", "add\n1 2"), ("assistant", "3")]), ("instruction", [("user", "hi"), ("assistant", "ho")]),
                          ("question", [("system", "s"), ("user", "q"), ("assistant", "a")]),
                          ("conversations", [("user", "x"), ("assistant", ""), ("assistant", "y")]), ("unknown", []), ("unknown", [])])


def test_rows_by_turn_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, "x"), (None, 0, "user", "z")]
    got = chat.grouped_messages(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert {r.conv_id: [tuple(m) for m in r.messages] for r in got} == {
        1: [("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "")], 2: [("", "x")], None: [("user", "z")]}
    out = chat.format_chats(chat.canonical_turns(chat.grouped_messages(
        spark.createDataFrame([], "conv_id int, turn int, role string, text string")), ("conv_id",)))
    assert out.collect() == []


def test_foreign_paths_and_null_contents_keep_the_layout(spark):
    """One more column, one more field in the messages, only null contents, and an empty array."""
    kind = "conv_id int, messages array<struct<role:string,content:string,weight:double,tool:struct<name:string>>>, prompt string, completion string, source string, n array<int>"
    rows = [(1, [("user", "a", 0.5, None), ("assistant", "b", None, ("t",))], None, None, "web", None), (2, [("user", None, None, None), ("assistant", None, None, None)], None, None, None, None),
            (3, [], None, None, None, [1]), (4, None, "p", "c", "web", None), (5, None, "p", None, "web", None), (6, None, None, None, None, None), (7, [None, ("user", "x", None, None)], None, None, None, None)]
    got = {r.conv_id: r for r in chat.format_chats(chat.canonical_turns(spark.createDataFrame(rows, kind), ("conv_id",))).collect()}
    turns = {k: None if r.turns is None else [tuple(t) for t in r.turns] for k, r in got.items()}
    assert turns == {1: [("user", "a"), ("assistant", "b")], 2: [("user", ""), ("assistant", "")], 3: [], 4: [("user", "p"), ("assistant", "c")], 5: None, 6: None,
                     7: [("", ""), ("user", "x")]}
    assert [got[k].layout for k in range(1, 8)] == ["messages"] * 3 + ["prompt", "unknown", "unknown", "messages"]
    assert got[1].extra == ["messages[].tool.name", "messages[].weight", "source"] and got[4].extra == ["source"] and got[3].formatted == ""
    assert got[3].extra == ["messages[].tool.name", "messages[].weight", "n[]"] and got[5].extra == ["prompt", "source"]


def test_of_two_layouts_in_one_record_the_first_mapping_counts(spark):
    df = spark.createDataFrame([("p", "c", "r")], "prompt string, completion string, response string")
    row = chat.canonical_turns(df, ()).first()
    assert (row.layout, row.extra, [tuple(t) for t in row.turns]) == ("prompt", ["response"], [("user", "p"), ("assistant", "c")])
