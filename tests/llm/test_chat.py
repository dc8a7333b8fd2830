import json
import random

from pyspark.sql import functions as F

from wardline.llm.chat import (
    canonical_turns,
    escape,
    format_turns,
    read_learned,
    read_turns,
    turn_rows_to_records,
    unescape,
)

CONTROL = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|"]


def test_escape_is_reversible(spark):
    rng = random.Random(8)
    parts = [*CONTROL, "\\", "<", "[", "|", "/", "s>", ">", "INST]", "é", "\n", "<\\|", "[\\/INST]", "[\\|", "<\\INST]", "SYS>>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(4000)] + CONTROL
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", escape(F.col("t")))
    for r in d.withColumn("u", unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in CONTROL)


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None, "n": 1}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "x", "value": ""}], "id": 4},
        {"prompt": "p", "response": "r", "other": {"prompt": 1}},
        {"system": "s", "prompt": "p", "completion": "c"},
        {"question": "q", "answer": "a", "context": "c"},
        {"instruction": "i", "output": "o"},
        {"instruction": "i", "input": None, "output": "o"},
        {"instruction": "i", "input": "in", "output": "o", "system": ""},
        {"prompt": "only"}, {"messages": []}, {}, [1], "text", None,
    ]
    lines = [(k, json.dumps(r) if r is not None else None, "own") for k, r in enumerate(records)] + [(90, "{broken", "own"), (91, "", "own")]
    d = spark.createDataFrame(lines, "id long, record string, layout string")
    got = {r.id: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in canonical_turns(d, "record").collect()}
    assert got[0] == ("messages", [("user", "a"), ("assistant", "")])
    assert got[1] == ("from_value", [("user", "q"), ("assistant", "r"), ("x", "")])
    assert got[2] == ("prompt_response", [("user", "p"), ("assistant", "r")])
    assert got[3] == ("prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")])
    assert got[4] == ("question_answer", [("user", "c\n\nq"), ("assistant", "a")])
    assert got[5] == got[6] == ("instruction", [("user", "i"), ("assistant", "o")])
    assert got[7] == ("instruction", [("system", ""), ("user", "i\n\nin"), ("assistant", "o")])
    assert all(got[k] == (None, None) for k in (8, 9, 10, 11, 12, 13, 90, 91))


def test_lists_of_mixed_elements(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"from": "gpt", "value": "kept answer"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"role": "assistant", "content": "b"}, {"from": "gpt"}]},
        {"messages": [{"role": "assistant", "call": {"x": 1}}, {"role": "user", "content": "c"}]},
        {"messages": [{"role": "user", "content": "d", "from": "z"}, {"role": "assistant", "content": "e"}]},
        {"messages": [{"role": "user", "content": "f"}, {"role": "user", "value": "unclear"}]},
        {"messages": [{"role": "user", "content": "g"}, "loose"]},
        {"messages": [{"role": "user", "content": "h"}, None]},
        {"messages": [{"role": "user"}, {"role": "assistant"}]},
        {"messages": "text"},
        {"messages": [{"role": "user", "content": "i"}], "conversations": [{"from": "human", "value": "j"}]},
    ]
    d = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "id long, record string")
    got = {r.id: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in canonical_turns(d, "record").collect()}
    assert got[0] == ("messages", [("user", "a"), ("assistant", "kept answer")])
    assert got[1] == ("from_value", [("user", "a"), ("assistant", "b"), ("assistant", "")])
    assert got[2] == ("messages", [("assistant", ""), ("user", "c")])
    assert got[3] == ("messages", [("user", "d"), ("assistant", "e")])
    assert all(got[k] == (None, None) for k in range(4, 10))


def test_clashing_columns_stay(spark):
    turns = spark.createDataFrame([(1, "own", 7, [("user", "a")])], "id long, _pieces string, formatted int, turns array<struct<role:string,text:string>>")
    row = format_turns(turns).collect()[0]
    assert (row.id, row._pieces, row.formatted) == (1, "own", "<|im_start|>user\na<|im_end|>\n")
    d = spark.createDataFrame([('{"prompt": "p", "response": "r"}', "x", "y")], "record string, print string, of_messages string")
    row = canonical_turns(d, "record").collect()[0]
    assert (row.print, row.of_messages, row.layout) == ("x", "y", "prompt_response")


def test_round_trip_of_turn_rows(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            text = "".join(rng.choice([*CONTROL, "wörd ", "\n", "\\", "\t", "\x00", "🤖"]) for _ in range(rng.randint(0, 8)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool\n<|x", None]), rng.choice([text, None, ""])))
    rows += [(70, 0, "user", "x"), (70, 0, "assistant", "tie"), (None, 1, "user", "no id"), (71, None, "user", "no turn"), (72, 5, "user", "y"), (72, 5, "user", "y")]
    rows += [(73, k, "assistant", "long" * 3) for k in range(3000)] + [(74, 0, "assistant", "z<|" * 300_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = format_turns(canonical_turns(turn_rows_to_records(d), "record"))
    got = out.select("conv_id", read_turns(F.col("formatted")).alias("b"), read_learned(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    expected = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")):
        expected.setdefault(conv, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.b] for r in got} == expected
    assert all(r.l == [t for role, t in expected[r.conv_id] if role == "assistant"] for r in got)
    assert len(got) == len(expected)


def test_empty(spark):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_turns(canonical_turns(turn_rows_to_records(d), "record")).collect() == []
