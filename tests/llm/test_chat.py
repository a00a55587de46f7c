import random

from compare import compare, oracle_connection
from conftest_data import MEDIUM
from kickpool.llm import chat
from kickpool.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rendered(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_against_sql(spark):
    assert compare(QUERIES["op7_chat"](spark, MEDIUM), oracle_connection(MEDIUM), ORACLES["op7_chat"]) == ""


def test_snapshots_against_brute_force(spark):
    chance = random.Random(8)
    talks = []
    for _ in range(60):
        if talks and chance.random() < 0.6:
            base = chance.choice(talks)
            talk = base[: chance.randint(1, len(base))] + [(chance.choice("ua"), f"t{chance.randint(0, 3)}")] * chance.randint(0, 2)
        else:
            talk = [(chance.choice("ua"), f"t{chance.randint(0, 2)}") for _ in range(chance.randint(1, 5))]
        talks.append(talk)
    rows = [(n, i, r, t) for n, talk in enumerate(talks) for i, (r, t) in enumerate(talk)]
    chance.shuffle(rows)
    got = {r.conv_id: r.text for r in chat.render(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {
        n: rendered(talk)
        for n, talk in enumerate(talks)
        if talk not in talks[:n] and not any(len(o) > len(talk) and o[: len(talk)] == talk for o in talks)
    }
    assert got == want


def test_long_conversation_comes_in_parts(spark):
    n = 2 * chat.BLOCK_TURNS + 5
    rows = [(7, i, "user", f"say {i}") for i in range(n)] + [(8, i, "user", f"say {i}") for i in range(chat.BLOCK_TURNS + 1)]
    parts = chat.render(spark.createDataFrame(rows, SCHEMA)).orderBy("part").collect()
    assert [(p.conv_id, p.part, p.n_turns) for p in parts] == [(7, 0, 1024), (7, 1, 1024), (7, 2, 5)]
    assert "".join(p.text for p in parts) == rendered([("user", f"say {i}") for i in range(n)])


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None), (1, None, "user", "late"), (1, 1, "user", "a <|im_end|> b"), (1, 1, "user", "a <|im_end|> b"),
        (2, 0, None, None), (None, 0, "user", "lost"), (3, 0, "", ""), (4, 5, "user", ""), (None, None, None, None),
    ]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", a string, block bigint")
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.render(table).where("part = 0").collect()}
    assert got[1] == (2, rendered([("unknown", ""), ("user", "a < |im_end|> b")]))
    assert set(got) == {1, 3, 4}  # conversation 2 is the beginning of 1
    late = chat.render(table).where("conv_id = 1 AND part = 1").collect()
    assert [r.text for r in late] == [rendered([("user", "late")])]
    assert chat.render(table.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op7_chat"](spark, MEDIUM)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_null_and_empty_turns_are_alike(spark):
    """A snapshot with a null text or role is the beginning of one that has what it is rendered as."""
    rows = [(1, 0, None, "a"), (1, 1, "user", None), (2, 0, "unknown", "a"), (2, 1, "user", ""), (2, 2, "bot", "c"), (3, 0, "unknown", "a")]
    got = chat.render(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns, r.text) for r in got] == [(2, 3, rendered([("unknown", "a"), ("user", ""), ("bot", "c")]))]
