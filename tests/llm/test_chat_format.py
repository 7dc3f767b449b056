import hashlib
import json

from pyspark.sql import functions as F

from fernweave.llm import chat_format as C

SAID = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\/s> [/\\INST]", "", " a ", "<s><s>", "[ROLE] x [/ROLE] ", "é\n[OUT] [", "<", "["]


def read(df):
    return df.select("*", C.read_turns(F.col("formatted")).alias("read"), C.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))


def test_layouts_map_to_the_same_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "extra": {"id": 1}},
        {"prompt": "q", "completion": "a"},
        {"prompt": "q", "response": "a", "unknown": [1]},
        {"instruction": "q", "output": "a"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, j string").withColumn("record", C.parse_records(F.col("j")))
    rows = C.chat_format(df).orderBy("i").collect()
    assert [r.layout for r in rows] == ["messages", "from_value", "prompt_completion", "prompt_response", "instruction"]
    assert {tuple((t.role, t.text) for t in r.turns) for r in rows} == {(("user", "q"), ("assistant", "a"))}
    assert len({r.fingerprint for r in rows}) == 5


def formatted(spark, records):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "i int, j string")
    return C.chat_format(df.withColumn("record", C.parse_records(F.col("j")))).orderBy("i").collect()


def test_system_input_unknown_and_bad_records(spark):
    rows = formatted(spark, ['{"system":"s","instruction":"i","input":"x","output":"o"}', '{"prompt":"alone"}', "not json", None, '{"messages":[]}'])
    assert [r.layout for r in rows] == ["system_instruction_input", None, None, None, "messages"]
    assert [(t.role, t.text) for t in rows[0].turns] == [("system", "s"), ("user", "i\n\nx"), ("assistant", "o")]
    # what no mapping fits is reported, not rendered
    assert all(r.turns is None and r.formatted is None and r.loss_spans is None for r in rows[1:4])
    assert rows[1].surplus == ["prompt"] and (rows[4].formatted, rows[4].turns, rows[4].loss_spans) == ("<s>", [], [])


def test_surplus_and_empty_fields_lose_no_conversation(spark):
    said = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    records = [
        {"messages": said, "prompt": "stray"},
        {"prompt": "q", "completion": "a", "input": ""},
        {"instruction": "q", "input": "", "output": "a"},
        {"question": "q", "answer": "a"},
        {"system": "", "prompt": "q", "response": "a"},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": "a"}]},
    ]
    rows = formatted(spark, records)
    assert [r.layout for r in rows] == ["messages", "prompt_completion", "instruction", "question_answer", "prompt_response", "messages_parts"]
    assert {tuple((t.role, t.text) for t in r.turns) for r in rows} == {(("user", "q"), ("assistant", "a"))}
    assert len({r.formatted for r in rows}) == 1 and [r.surplus for r in rows] == [["prompt"], [], [], [], [], []]


def test_paths_come_from_the_records(spark):
    df = spark.createDataFrame([({"m": [{"role": "user", "n": None}, {"role": None, "n": {"deep": 1}}], "x": None},)], "record struct<m:array<struct<role:string,n:struct<deep:int>>>,x:string>")
    row = C.canonical_turns(df).first()
    assert row.surplus == ["m[]", "m[].n.deep", "m[].role"] and row.layout is None


def test_many_turns_take_linear_time(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"said {i}") for i in range(20_000)]
    (row,) = read(C.chat_format(C.gather_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    assert len(row.read) == 20_000 and row.loss == "".join(f"said {i}" for i in range(1, 20_000, 2))


def test_query_has_several_layouts(spark):
    got = C.op1_chat_format(spark, "/root/testdata/sf0.01").collect()
    assert {"prompt_completion", "system_instruction", "from_value", "messages"} <= {r.layout for r in got}


def test_round_trip_with_control_strings_and_any_role(spark):
    roles = ["user", "assistant", "system", "tool", "[/ROLE] ", ""]
    rows = [(c, t, roles[(c + t) % 6], SAID[(c * 4 + t) % len(SAID)]) for c in range(30) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in read(C.chat_format(C.gather_turns(df))).collect()}
    for c in range(30):
        want = [(r[2], r[3]) for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in out[c].read] == want
        assert out[c].loss == "".join(t for role, t in want if role == "assistant")


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, None, None, "x"), (1, None, "user", "first", "x"), (None, 1, "assistant", "b", "x"), (None, 1, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in read(C.chat_format(C.gather_turns(df))).collect()}
    assert [(t.role, t.text) for t in out[1].read] == [("user", "first"), ("", ""), ("", "")]
    assert out[None].loss == "ab"
    clash = C.gather_turns(df).withColumn("layout", F.lit("mine"))
    assert {r.layout for r in C.chat_format(clash).collect()} == {"messages"}


def test_empty_and_long(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert C.chat_format(C.gather_turns(spark.createDataFrame([], schema))).collect() == []
    long = "word </s> " * 100_000
    (row,) = read(C.chat_format(C.gather_turns(spark.createDataFrame([(1, 0, "assistant", long)], schema)))).collect()
    assert row.loss == long and hashlib.sha256(row.read[0].text.encode()).digest() == hashlib.sha256(long.encode()).digest()


def test_empty_system_turns_survive(spark):
    rows = [(c, t, role, text) for c, told in ((1, ""), (2, None), (3, "be brief")) for t, (role, text) in enumerate([("system", told), ("user", "q"), ("assistant", "a")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in read(C.chat_format(C.as_layouts(C.gather_turns(df)))).collect()}
    assert [(t.role, t.text) for t in out[1].read] == [("system", ""), ("user", "q"), ("assistant", "a")] == [(t.role, t.text) for t in out[2].read]
    assert [(t.role, t.text) for t in out[3].read] == [("system", "be brief"), ("user", "q"), ("assistant", "a")]
    assert [out[i].layout for i in (1, 2, 3)] == ["messages", "messages", "system_instruction"]


def test_fingerprints_select_the_mappings(spark):
    known = {p for x in C.LAYOUTS for p in (*x.paths, *x.optional)}
    owned = C.owners(C.LAYOUTS, known)
    assert all(owned) and len({n for own in owned for n in own}) == sum(map(len, owned))
    (row,) = spark.range(1).select(C.fingerprint_of(F.array(F.lit("completion"), F.lit("prompt"))).alias("n")).collect()
    assert row.n in owned[[x.name for x in C.LAYOUTS].index("prompt_completion")]
    # a layout that priority alone would never take is chosen by its fingerprint, and one with a surplus path by priority
    alone = (C.Layout("first", ("a", "b"), lambda r: F.array(C._turn("user", r["a"]))), C.Layout("second", ("a",), lambda r: F.array(C._turn("user", r["a"]))))
    df = spark.createDataFrame([(("x", "y", None),), (("x", None, None),), (("x", None, "z"),)], "record struct<a:string,b:string,c:string>")
    assert [r.layout for r in C.canonical_turns(df, layouts=alone).collect()] == ["first", "second", "second"]
    plan = C.op1_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan
