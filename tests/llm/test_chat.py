from pyspark.sql import functions as F

from caregauge.llm import chat

ODD = [
    "", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\s>", "<\\/s> </s", "<<SYS>><</SYS>>\n", "[TEXT][/ROLE]", "<<s>>",
    "[\\INST]", "\n", " x ", "[[INST]]", "漢😀",
]


def read_back(frame):
    found = frame.select(
        "conv_id", "errors", "valid",
        chat.read_turns(chat.formatted(F.col("segments"))).alias("turns"), chat.loss_text(F.col("segments")).alias("learned"),
    )
    return {r.conv_id: r for r in found.collect()}


def test_any_text_and_role_comes_back(spark):
    roles = ["system", "user", "assistant", "tool", "", None, "[TEXT]", "</s>"]
    turns = [(1, i, roles[i % 8], t, "x") for i, t in enumerate(ODD * 8)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, segments string").repartition(4)
    got = read_back(chat.format_chats(df))[1]
    assert [(t.role, t.text) for t in got.turns] == [(r or "", t) for _, _, r, t, _ in turns]
    assert got.learned == "".join(t for _, _, r, t, _ in turns if r == "assistant")


def test_order_of_roles(spark):
    cases = {
        "user,assistant": 0, "system,user,assistant,user": 0, "assistant,user": 1, "user,user,assistant": 1, "system": 1,
        "user,system,user": 2, "user,tool,assistant": 3,
    }
    rows = [(i, n, role, "t") for i, case in enumerate(cases) for n, role in enumerate(case.split(","))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = read_back(chat.format_chats(df))
    for i, (case, errors) in enumerate(cases.items()):
        # A turn after a state that has no successors counts, and so does a last turn that may not end it.
        assert (got[i].errors > 0) == (errors > 0) and got[i].valid == (errors == 0), case


def test_ties_nulls_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", None), (None, 1, None, None), (None, 1, None, None)]
    got = read_back(chat.format_chats(spark.createDataFrame(rows, schema)))
    assert [(t.role, t.text) for t in got[1].turns] == [("system", ""), ("user", "a"), ("user", "b")]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")] * 2
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
