from pyspark.sql import functions as F

from sparkpact.llm.preference import END, format_pairs, op7_preference

from ..oracle import agree


def brute(chosen, rejected):
    """turns: (turn, role, text)"""
    order = lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or "")
    a, b = ([(r or "", t or "") for _, r, t in sorted(x, key=order)] for x in (chosen, rejected))
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1

    def shown(turns):
        text, spans = "", []
        for role, t in turns:
            text += f"<|{role}|>\n"
            if role == "assistant":
                spans.append(f"{len(text)}:{len(t) + len(END)}")
            text += t + END + "\n"
        return text, ",".join(spans)

    return (n, shown(a[:n])[0], *shown(a[n:]), *shown(b[n:]))


def test_pairs(spark):
    u, s, c = "user", "assistant", "system"
    pairs = {
        0: ([(0, u, "hi"), (1, s, "yes")], [(0, u, "hi"), (1, s, "no"), (2, u, "why")]),
        1: ([(0, c, "é😀"), (1, u, "q")], [(0, c, "é😀"), (1, u, "q")]),
        2: ([(0, u, "a")], [(0, s, "a")]),
        3: ([(5, u, None), (1, None, "x"), (None, u, "first")], [(0, u, "first"), (9, "", "x")]),
        4: ([(0, u, "same"), (0, u, "same"), (1, s, "")], [(0, u, "same"), (1, s, "w" * 5000)]),
        5: ([(0, u, "alone")], []),
    }
    rows = [(p, side, *t, "clash", "clash") for p, (a, b) in pairs.items() for side, turns in ((True, a), (False, b)) for t in turns]
    rows += [(None, True, 0, u, "none", "", ""), (7, None, 0, u, "none", "", "")]
    df = spark.createDataFrame(rows, "p long, c boolean, turn long, role string, text string, prompt string, chosen string")
    got = {r[0]: tuple(r[1:]) for r in format_pairs(df, F.col("p"), F.col("c")).collect()}
    assert got == {p: brute(a, b) for p, (a, b) in pairs.items() if b}
    assert got[1][2] == "" and got[1][4] == ""
    assert format_pairs(df.filter("false"), F.col("p"), F.col("c")).collect() == []


def test_query(spark, sf_dir):
    from sparkpact.llm.entries import ORACLE_SQL

    df = op7_preference(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    agree(df, ORACLE_SQL["op7_preference"], sf_dir)
