import duckdb

from sigweave.llm import chat

ROWS = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi é"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 300, "ann", ""), (1, None, "cy", "?"), (1, 3, None, "x"), (2, 0, "system", "alone"), (None, 1, "ann", "n"), (None, 2, "bob", "m"), (3, 600, "z", "w " * 5000), (3, -1, "y", "w")]


def brute(rows):
    key = lambda x: (x is not None, x)
    out = []
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (key(r[1]), key(r[2]), r[3] or ""))
        for p in {r[2] for r in own} - {None, "system"}:
            at = 0
            for k, (_, turn, role, text) in enumerate(own):
                kind = "assistant" if role == p else "system" if role == "system" else "user"
                name = (role or "unknown") if kind == "user" else None
                head = f"<|{kind}" + (f" name={name}" if name else "") + "|>\n"
                segment = head + (text or "") + "<|end|>\n"
                end = at + len(segment)
                start = at + len(head) if kind == "assistant" else end
                out.append((c, p, k, turn, role, kind, name, segment, at, end, start, end, end - start))
                at = end
    return sorted(out, key=str)


def test_small_table(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, position int")
    for spans in (1, 5, 64):
        assert sorted((tuple(r) for r in chat.rotate(df, spans=spans).collect()), key=str) == brute(ROWS)
    assert chat.rotate(df.limit(0)).count() == 0


def test_long_conversations_lie_in_many_spans(spark):
    """Turns that are null or all the same, turns that repeat, and far more rows than any other conversation has."""
    rows = [(1, None if i % 3 else 7, "abc"[i % 3], f"t{i % 211}") for i in range(1500)] + [(1, 7, "a", "same")] * 400 + [(i, 0, "x", "y") for i in range(2, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in chat.rotate(df, spans=16).collect()), key=str) == brute(rows)


def test_whole_table_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in chat.query(spark, sf).collect()), key=str)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    names = "conv_id, perspective, position, turn, speaker, chat_role, name, segment, char_start, char_end, mask_start, mask_end, masked"
    assert sorted(con.sql(f"SELECT {names} FROM ({chat.SQL})").fetchall(), key=str) == got
