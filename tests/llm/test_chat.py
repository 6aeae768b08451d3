"""Chat formatting: exact round trips and loss spans."""

import hashlib

import duckdb

from emberlake.llm import chat

ROWS = [
    (1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "a\\<|b<\\|c"), (1, 2, "assistant", "one\n<|im_start|>assistant\n"), (1, 3, "user", None), (1, 4, "assistant", "two"), (1, 5, "user", "no answer"),
    (2, 0, "user", "alone"), (3, 0, "assistant", ""), (3, 1, "assistant", "\\"), (4, 0, "ro\nle", "<"), (4, 1, None, "|"), (5, 0, "assistant", "x" * 20000), (6, 0, "user", "same"), (6, 0, "user", "same"),
    (7, None, "user", "first"), (7, 0, "assistant", "last"), (None, 0, "user", "lost"),
]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_digests_equal_sql(spark):
    rows = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA)
    found = chat.digests(chat.prefix_target_examples(rows))
    con = duckdb.connect()
    con.register("rows", rows.drop("formatted").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    names = found.columns
    want = con.sql(f"SELECT {', '.join(names)} FROM ({chat.DIGESTS_SQL % 'SELECT conv_id, turn, role, text FROM rows'})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_examples(spark):
    rows = spark.createDataFrame([(*r, "") for r in ROWS if r[0] == 1], SCHEMA)
    found = chat.prefix_target_examples(rows).orderBy("example").collect()
    assert [(e.has_target, e.is_last) for e in found] == [(True, False), (True, False), (False, True)]
    spans = [e.formatted[e.loss_start : e.loss_start + e.loss_length] for e in found]
    assert spans == ["one\n<\\|im_start|>assistant\n", "two", ""]
    assert all(e.formatted.count("<|im_end|>") == n for e, n in zip(found, [3, 5, 6], strict=True)) and found[1].formatted.startswith(found[0].formatted)
    digest = chat.digests(chat.prefix_target_examples(rows)).first()
    turns = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in ROWS if r[0] == 1)
    assert digest.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and digest.loss_chars == len("one\n<|im_start|>assistant\ntwo")


def test_empty(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.prefix_target_examples(rows)).count() == 0
