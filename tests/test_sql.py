"""Table functions in SQL against the DataFrame functions, on awkward texts; views of an engine."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from sparkloom import sql
from sparkloom.engine import engine
from sparkloom.functions import text
from sparkloom.operators import answers, chunking

TEXTS = [
    "", None, "   ", "no header here. Two sentences! And three? yes", "HISTORY:\nHad HTN and DM. Took 5 mg.\n\nPLAN / NEXT:\nRest. Walk daily.\nEMPTY:\n", "intro goes\nREASON FOR VISIT:\nChest pain since May.\n- item one\n- item two",
    "The studies' classes, passes and glasses; A1c 7.5/8.0 e.g. x-ray bp.", "Ünïcode stays. İstanbul ß end.", "one\n\n\ntwo\n three", " ".join(f"Sentence number {i} has a few words of its own." for i in range(80)),
]
ANSWERS = [
    ("Dose is 5 mg [S1]. It was 7.50 on 2024-01-02 [S2].", {"S1": "5 mg daily", "S2": "7.5 on 2024-01-02"}), ("Dose is 6 mg [S1]. Unknown [S9]. No mark. Talk to your doctor.", {"S1": "5 mg"}), ("Marks behind. [S1] [S2] Next one [S1, S2]! - ... \n2 lines [S2]", {"S1": "a", "S2": "2"}), ("", {}), ("Nothing known [S1].", None),
]


def test_tokens_and_chunks_equal_the_columns(spark):
    sql.register(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string")
    docs.createOrReplaceTempView("awkward")
    got = {(int(r.key), r.pos, r.term) for r in spark.sql("SELECT * FROM loom_tokens(TABLE(SELECT k, text FROM awkward))").collect()}
    assert got == {(r.k, r.pos, r.t) for r in docs.select("k", F.posexplode(text.tokens(F.col("text"))).alias("pos", "t")).collect()}
    got = {(int(r.key), r.chunk_id, r.section, r.text) for r in spark.sql("SELECT * FROM loom_chunks(TABLE(SELECT k, text FROM awkward))").collect()}
    assert got == {tuple(r) for r in chunking.chunks(docs, "k", "text", 120).collect()}
    assert spark.sql("SELECT * FROM loom_tokens(TABLE(SELECT k, text FROM awkward WHERE k < 0))").count() == 0


def test_check_equals_the_columns(spark):
    sql.register(spark)
    rng = random.Random(4)
    bits = ["Take 5 mg", " [S1]", " [S2, S3]", ".", "!", " ", "\n", "7,500 units", "ask your doctor", "1.0", "[S1]", "X"]
    cases = ANSWERS + [("".join(rng.choices(bits, k=rng.randrange(12))), {"S1": "5 mg and 7500", "S2": "1"}) for _ in range(80)]
    spark.createDataFrame([(i, a, e) for i, (a, e) in enumerate(cases)], "k long, answer string, evidence map<string,string>").createOrReplaceTempView("told")
    got = {(int(r.key), r.pos, r.sentence, r.status) for r in spark.sql("SELECT * FROM loom_check(TABLE(told))").collect()}
    plain = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "k long, answer string")
    evidence = spark.createDataFrame([(i, k, t, "") for i, (_, e) in enumerate(cases) for k, t in (e or {}).items()], "k long, key string, text string, title string")
    assert got == {(r.k, r.pos, r.sentence, r.status) for r in answers.check_sentences(plain, evidence, "k").collect()} and len(got) > 60


def test_views_of_an_engine(spark):
    passages = spark.createDataFrame([("topic:a#x#0", "guidelines", "A", "Asthma is treated with inhalers.")], "id string, namespace string, title string, text string")
    facts = spark.createDataFrame([("P0001", "f1", "condition", "P0001 has asthma.")], "subject string, id string, title string, text string")
    records = spark.createDataFrame([("patient:P0001", "{}", None), ("meta:version:P0001", "3", None), ("gone", "x", 1.0)], "key string, value string, expires_at double")
    sql.register(spark)
    assert sorted(sql.views(spark, engine(spark, facts, passages, records, 100.0, dt.date(2026, 10, 1)))) == ["loom_facts", "loom_passages", "loom_records", "loom_versions"]
    row = spark.sql("""
        SELECT f.subject, v.version, count(DISTINCT t.term) AS shared, (SELECT count(*) FROM loom_records) AS alive FROM loom_facts f JOIN loom_versions v ON v.subject = f.subject,
          loom_tokens(TABLE(SELECT id, text FROM loom_passages)) t WHERE contains(lower(f.text), t.term) GROUP BY f.subject, v.version""").first()
    assert (row.subject, row.version, row.shared, row.alive) == ("P0001", 3, 1, 2)


def test_tokens_of_a_batch_come_in_lots():
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(7000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([text] * 9 + [None])], names=["id", "text"])
    tables = list(sql.Tokens().eval(batch))
    assert max(t.num_rows for t in tables) <= 20_000 and sum(t.num_rows for t in tables) == 63_000
    assert pa.concat_tables(tables).slice(7000, 2).to_pylist() == [{"key": "1", "pos": 0, "term": "w0"}, {"key": "1", "pos": 1, "term": "w1"}]
