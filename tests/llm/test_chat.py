import duckdb
import pytest

from marlstone.llm import chat

TURNS = "conv_id long, turn long, role string, text string, segment string"
ROWS = (
    [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé <|im_end|> you"), (1, 3, "ann", None), (1, 2, "cy\n|", "same turn")]
    + [(2, 0, "user", "q"), (2, 0, "user", "q"), (2, None, "user", "first"), (2, 1, None, ""), (2, 1, "unknown", "x")]
    + [(3, 0, "system", "alone")]
    + [(None, 0, "ann", "null id"), (None, 1, "bob", "other")]
    + [(4, k, ("ann", "bob", "system")[k % 3], f"t{k} " * (k % 7)) for k in range(-70, 400)]
    + [(5, 0, "ann", "long " * 50_000)]
)


def plain(rows):
    said = [(c, t, r if r is not None else "unknown", (x or "").replace("<|im_", "<| im_")) for c, t, r, x in rows]
    out = []
    for c in {r[0] for r in said}:
        own = sorted((r[1:] for r in said if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        for p in {r[1] for r in own} - {"system"}:
            at = 0
            for k, (turn, who, text) in enumerate(own):
                kind = "assistant" if who == p else "system" if who == "system" else "user"
                head = f"<|im_start|>{kind}" + (f" name={who.translate(str.maketrans('<|>' + chr(10) + chr(13), '___  '))}" if kind == "user" else "") + "\n"
                seg = f"{head}{text}<|im_end|>\n"
                end = at + len(seg)
                out.append((c, p, k, turn, who, kind, seg, at, end, who == p, at + len(head) if who == p else None, end - 1 if who == p else None))
                at = end
    return out


def key(r):
    return tuple((x is not None, x) if not isinstance(x, (int, type(None))) else (x is not None, x or 0) for x in r)


@pytest.mark.parametrize("block", [64, 3])
def test_against_brute_force(spark, block):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], TURNS).repartition(3)
    got = [tuple(r) for r in chat.rotate(df, block=block).collect()]
    assert sorted(got, key=key) == sorted(plain(ROWS), key=key)


def test_sql_agrees(spark):
    import pandas as pd

    con = duckdb.connect()
    con.register("t", pd.DataFrame([r for r in ROWS if r[1] is not None and r[0] is not None], columns=["conv_id", "turn", "role", "text"]))
    con.execute("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM t")
    want = con.execute(chat.ORACLE).fetchall()
    assert sorted(want, key=key) == sorted(plain([r for r in ROWS if r[1] is not None and r[0] is not None]), key=key)


def test_empty_and_plan(spark):
    df = spark.createDataFrame([(*r, None) for r in ROWS], TURNS)
    assert chat.rotate(df.limit(0)).collect() == []
    plan = chat.rotate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
