from oracle import assert_same, connect

from tessera.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_sql(spark, medium):
    assert_same(queries.op3_chat(spark, medium), connect(medium), chat.ORACLE_SQL)


def kept(spark, rows):
    return {r["conv_id"]: r["rendered"] for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_prefixes_and_equals_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", "more")
    rows = [(i, t, *x) for i, conv in {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b, c], 6: [b]}.items() for t, x in enumerate(conv)]
    assert set(kept(spark, rows)) == {3, 5}


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, None, None, None), (2, 1, "user", ""), (3, 0, "user", None), (4, 0, "user", ""), (None, 0, "user", "x"), (5, -3, "user", "hi"), (5, 9, "user", "hi")]
    got = kept(spark, rows)
    assert set(got) == {2, 3, 4, 5} and got[2] == "<|im_start|>unknown\n<|im_end|>\n<|im_start|>user\n<|im_end|>"
    assert kept(spark, []) == {}


def test_a_long_conversation_comes_in_parts(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(700)] + [(2, i, "user", f"t{i}") for i in range(600)]
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("part").collect()
    assert [(r["conv_id"], r["part"], r["n_turns"]) for r in got] == [(1, 0, 700), (1, 1, 700), (1, 2, 700)]
    assert "\n".join(r["rendered"] for r in got) == "\n".join(f"<|im_start|>user\nt{i}<|im_end|>" for i in range(700))


def test_only_dataframe_functions(spark):
    plan = chat.format_conversations(spark.createDataFrame([(1, 0, "u", "t")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
