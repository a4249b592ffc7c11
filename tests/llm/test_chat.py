"""Chat windows against a sequential Python reading of the contract."""

import hashlib

from pyspark.sql import functions as F

from pressloom.llm import catalog, chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
HARD = ["</s>[INST] ok [/INST]", "\\", "\\e\\l\\b", "<|end|>\n", "<|turn:user|>", "<<SYS>> <</SYS>>", "[INST", "日本 😀\\", "", None]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def expected(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(made):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}


def conversations():
    rows = [(1, k, ("system", "user", "assistant")[min(k, 1 + k % 2)], f"turn {k} " + HARD[k % len(HARD)] if HARD[k % len(HARD)] is not None else None) for k in range(300)]
    rows += [(2, k, ("assistant", "user")[k % 2], "long words here " * (1 + 10 * (k % 4))) for k in range(40)]
    rows += [(3, 5, "user", "tie"), (3, 5, "assistant", "tie"), (3, 5, "assistant", "tie"), (3, None, None, None)]
    rows += [(None, 0, "system", "s"), (None, 1, "assistant", "a"), (4, 0, "weird:|>\nrole<|end|>\n", "x")]
    return rows


def test_windows_read_back_whole_and_mask_each_answer_once(spark):
    rows = conversations()
    made = chat.windows(table(spark, rows), F.size(F.split("text", " ")), budget=200, history=50)
    assert got(made) == expected(rows)


def test_budget_system_turn_and_history(spark):
    rows = conversations()
    made = chat.windows(table(spark, rows), F.size(F.split("text", " ")), budget=200, history=50)
    seen = made.withColumn("turns", chat.parsed("formatted")).where("conv_id in (1, 2)").orderBy("conv_id", "win").collect()
    longest = 4 + max(len((t or "").split(" ")) for *_, t in rows)
    assert longest < 200
    assert all(r.n_tokens <= 200 and not r.over_budget for r in seen)
    one = [r for r in seen if r.conv_id == 1]
    assert len(one) > 5
    assert [t.again for t in one[0].turns] == [False] * len(one[0].turns)
    for r in one[1:]:
        assert r.turns[0].again and r.turns[0].role == "system" and r.turns[0].text == rows[0][3]
        assert any(t.again and t.role != "system" for t in r.turns)
    two = [r for r in seen if r.conv_id == 2]
    assert not any(t.role == "system" for r in two for t in r.turns)


def test_a_turn_over_the_budget_stands_alone(spark):
    rows = [(1, 0, "user", "a b"), (1, 1, "assistant", "w " * 500), (1, 2, "user", "c")]
    made = chat.windows(table(spark, rows), F.size(F.split("text", " ")), budget=64, history=16)
    assert [(r.over_budget, sum(not t.again for t in r.turns)) for r in made.withColumn("turns", chat.parsed("formatted")).orderBy("win").collect()] == [(False, 1), (True, 1), (False, 1)]
    assert got(made) == expected(rows)


def test_long_system_turns_stay_within_the_budget(spark):
    """No window is over the budget unless the system turn and one other turn are; the system turn is in every window, and history where there is room."""
    sizes = {1: (1500, 100), 2: (1000, 100), 3: (1900, 100), 4: (1990, 100), 5: (5000, 100), 6: (0, 1500), 7: (700, 1300), 8: (2040, 1), 9: (2044, 1)}
    rows = [(c, 0, "system", " ".join(["s"] * s)) for c, (s, _) in sizes.items() if s]
    rows += [(c, k, ("user", "assistant")[k % 2], " ".join(["w"] * (t if k % 5 else t // 3 + 1))) for c, (_, t) in sizes.items() for k in range(1, 61)]
    made = chat.windows(table(spark, rows), F.size(F.split("text", " ")), budget=2048, history=512)
    assert got(made) == expected(rows)
    for r in made.withColumn("turns", chat.parsed("formatted")).collect():
        s, t = sizes[r.conv_id]
        fresh = [x for x in r.turns if not x.again and x.role != "system"]
        assert r.over_budget == (r.n_tokens > 2048)
        if r.n_tokens > 2048:
            assert len(fresh) == 1 and s + 4 + max(len(x.text.split()) + 4 for x in fresh) > 2048 or s + 4 > 2045
        assert not s or sum(x.role == "system" for x in r.turns) == 1 and r.turns[0].role == "system"
    some = made.where("conv_id = 1 and win > 0").withColumn("turns", chat.parsed("formatted")).collect()
    assert all(any(x.again and x.role != "system" for x in r.turns) for r in some) and len(some) > 5


def test_no_control_string_of_a_text_survives(spark):
    rows = [(k, 0, "user", t) for k, t in enumerate(HARD)]
    made = chat.windows(table(spark, rows), F.lit(1))
    for r in made.collect():
        inner = r.formatted.removeprefix("<|turn:user|>").removesuffix("<|end|>\n")
        assert not any(c in inner for c in chat.CONTROL)
    assert got(made) == expected(rows)


def test_query_and_empty_table(spark, tmp_path):
    found = {r.conv_id: r for r in catalog.QUERIES["op10_chat"](spark, "/root/testdata/sf0.001").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0])]
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in found.items()} == expected(rows)
    table(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in catalog.QUERIES["op10_chat"](spark, str(tmp_path)).collect()] == [-7]
    assert chat.digests(chat.windows(table(spark, []), F.lit(1))).count() == 0


def test_string_ids_and_a_very_long_text(spark):
    """Ids of other types keep them; a text of a million characters is one turn, whole."""
    rows = [("a", 0, "system", "s"), ("a", 1, "user", "long \\ [INST] " * 80_000), ("a", 2, "assistant", "y" * 1_000_000), (None, 0, "assistant", "n")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA.replace("conv_id long", "conv_id string"))
    made = chat.windows(turns, F.size(F.split("text", " ")), budget=200, history=50)
    assert got(made) == expected(rows)
    assert chat.digests(made).schema["conv_id"].dataType.simpleString() == "string"
