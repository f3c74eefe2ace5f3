from pyspark.sql import functions as F

from tideq.llm import chat


def test_layouts_and_round_trip(spark):
    rows = [
        (1, '{"messages":[{"role":"us\\ner\\\\n","content":"<|x <\\\\|y <<|im_end|>"},{"role":"assistant","content":null}]}'),
        (2, '{"instruction":"a","input":"b","output":"c"}'),
        (3, '{"prompt":"p","completion":"c"}'),
        (4, '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}'),
        (5, '{"messages":[]}'),
        (6, '{"odd":1}'),
        (7, None),
        (8, "no json"),
        (9, '{"messages":[{"role":"user","content":{"parts":["deep"]}}]}'),
        (10, '{"messages":[{"role":"user","content":{"parts":[{"a":[{"b":1}]}]}}]}'),
        (11, '{"messages":[{"role":"user","content":{"parts":[{"a":[{"c":1}]}]}}]}'),
        (12, '{"messages":[{"role":"user","content":7},{"role":"assistant","content":"8"}]}'),
        (13, '{"messages":[{"role":"user","content":"x"},{"role":"assistant","content":["x"]}]}'),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id int, record string"))
    got = {r.conv_id: r for r in out.withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    turns = {i: r.turns and [(t.role, t.text) for t in r.turns] for i, r in got.items()}
    assert turns[1] == [("us\ner\\n", "<|x <\\|y <<|im_end|>"), ("assistant", "")]
    assert turns[2] == [("user", "a\n\nb"), ("assistant", "c")] and turns[3] == [("user", "p"), ("assistant", "c")]
    assert turns[4] == [("user", "hi"), ("assistant", "yo")] and turns[5] == []
    assert turns[6] is turns[7] is turns[8] is turns[9] is turns[13] is None and turns[12] == [("user", "7"), ("assistant", "8")]
    assert len({got[i].layout for i in (1, 2, 3, 4, 9, 10, 11)}) == 7
    assert all([(t.role, t.text) for t in r.back] == turns[i] for i, r in got.items() if r.turns is not None)


def test_rows_by_turn(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (1, None, None, "z"), (None, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(chat.as_records(rows))).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2 and got[None].n_turns == 1
    assert chat.digest(chat.format_chats(chat.as_records(rows.limit(0)))).count() == 0


def test_conversations_come_in_several_layouts(spark):
    """Which layout a conversation is dealt to shows in its fingerprint, and in nothing else."""
    roles = ("user", "assistant", "human", "gpt", "system")
    rows = [(i, t, roles[(i + t) % (2 if i % 2 else 5)], f"text {i} {t}") for i in range(40) for t in range(1 + i % 4)]
    made = chat.format_chats(chat.as_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = made.collect()
    assert {r.layout_name for r in got} == {"messages", "share", "turns"}
    want = {i: [(x[2], x[3]) for x in rows if x[0] == i] for i in range(40)}
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == want


def test_very_long_conversations(spark):
    """Far beyond what the engine parses as a variant: in many turns, in one, and full of escapes."""
    rows = spark.sql("select 1L conv_id, id turn, 'user' role, repeat(concat('ab', char(10), char(34)), 300000) text from range(20) union all select 2L, 0L, 'assistant', repeat('x', 22000000)")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(chat.as_records(rows))).collect()}
    assert got[1].n_turns == 20 and got[1].formatted_chars == 20 * (1_200_000 + 28) and got[2].loss_chars == 22_000_000
