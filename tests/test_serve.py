"""Streams: write-through with versions, stored answers, stage rows; replays and restarts."""

from __future__ import annotations

import json
from collections import defaultdict

from sparkloom.operators import lifecycle
from sparkloom.streaming import serve

LABS = "patient_id string, lab string, date string, value double"
ASKED = "qid long, query string, scope string"


def labs(spark, *rows):
    return spark.createDataFrame([(p, "hemoglobin a1c", d, v) for p, d, v in rows], LABS)


def state(store):
    return sorted((r.key, r.value, r.subject) for r in store.records().collect())


def test_write_through_is_idempotent_and_versions_rise(spark, tmp_path):
    store = serve.Store(spark, str(tmp_path / "store"))
    assert store.records().count() == store.versions().count() == store.stored().count() == 0
    known = spark.createDataFrame([("P0001",), ("P0002",)], "patient_id string")
    source, check = str(tmp_path / "in"), str(tmp_path / "check")

    def feed(*rows):
        labs(spark, *rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LABS).option("maxFilesPerTrigger", 1).parquet(source)
        serve.write_stream(stream, store, check, known).awaitTermination()

    feed(("P0001", "2026-01-01", 7.0), ("P0001", "2026-02-01", 6.0), ("P0002", "2026-01-01", 5.0), ("P0099", "2026-01-01", 5.0))
    assert {r.subject: r.version for r in store.versions().collect()} == {"P0001": 2, "P0002": 1}
    feed(("P0001", "2026-02-01", 9.5))  # a restart from the checkpoint: the first file is not read again
    assert {r.subject: r.version for r in store.versions().collect()} == {"P0001": 3, "P0002": 1}
    values = {r.key: json.loads(r.value) for r in store.records().collect() if r.key.startswith("patient:")}
    assert values["patient:P0001:lab:hemoglobin_a1c:2026-02-01"]["value"] == 9.5 and len(values) == 3
    before = state(store)
    store.put(serve.lab_rows(labs(spark, ("P0001", "2026-02-01", 9.5))), 1)  # the second batch again
    assert state(store) == before
    store.compact(0)
    assert state(store) == before
    store.compact(1)
    assert state(store) == before and store._base()[0] == 1
    store.put(serve.lab_rows(labs(spark, ("P0002", "2026-01-01", 4.0))), 2)
    assert {r.subject: r.version for r in store.versions().collect()} == {"P0001": 3, "P0002": 2}


def lifecycle_of(spark, store, passages):
    return lambda batch: lifecycle.run(batch, None, passages, records=store.records().select("key", "value"), min_score=0.01)


def events_of(store):
    out = defaultdict(list)
    for r in store.events().orderBy("batch", "qid", "seq").collect():
        out[r.qid].append((r.seq, r.event, json.loads(r.data)))
    return out


def test_questions_as_a_stream(spark, tmp_path):
    store = serve.Store(spark, str(tmp_path / "store"))
    store.put(serve.lab_rows(labs(spark, ("P0001", "2026-08-05", 7.1), ("P0002", "2026-08-05", 5.0))), 0)
    passages = spark.createDataFrame([("n1", "patient_notes", "note", "The patient reports ankle swelling since the spring visit.", "P0001", None, 20260301)], "id string, namespace string, title string, text string, owner string, drug string, date_num long")
    run = lifecycle_of(spark, store, passages)
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    lab, note, flag = "What is the latest HbA1c for P0001?", "What did the notes say about ankle swelling?", "I have crushing chest pain spreading to my left arm"

    def ask(*rows):
        spark.createDataFrame(list(rows), ASKED).coalesce(1).write.mode("append").parquet(source)
        serve.answer_stream(spark.readStream.schema(ASKED).option("maxFilesPerTrigger", 1).parquet(source), store, check, run).awaitTermination()

    rows = [(1, lab, None), (2, note, "P0001"), (3, flag, "P0001"), (4, "What medications is P0002 taking?", "P0001"), (5, None, None), (6, lab, None)]
    ask(*rows)
    got = events_of(store)
    assert all([s for s, *_ in x] == list(range(len(x))) for x in got.values()) and set(got) == {1, 2, 3, 4, 5, 6}
    assert [e for _, e, _ in got[5]] == ["error"] and [e for _, e, _ in got[3]] == ["meta", "final"] == [e for _, e, _ in got[4]]
    assert [e for _, e, _ in got[2]][:2] == ["meta", "retrieval"] and got[1] == got[6]
    # The stream equals the batch.
    plain = {r.qid: r for r in lifecycle.run_batch(spark.createDataFrame([r for r in rows if r[1]], ASKED), None, passages, records=store.records().select("key", "value"), min_score=0.01).collect()}
    for q, x in got.items():
        if q != 5:
            last = x[-1][2]
            assert (last["status"], last.get("answer"), last.get("reason")) == (plain[q].status, plain[q].answer, plain[q].reason)
            if plain[q].answer:
                assert "".join(d["text"] for _, e, d in x if e == "token") == plain[q].answer
    assert got[1][-1][2]["status"] == "answered" and "7.1" in got[1][-1][2]["answer"]
    # A stored answer is served until its subject changes.
    ask((7, lab, None), (8, "What is the latest HbA1c for P0002?", None))
    got = events_of(store)
    assert got[7][0][2]["cache"] == "exact" and got[7][-1][2]["answer"] == got[1][-1][2]["answer"] and "cache" not in got[8][0][2] and len(got[1]) > 3
    store.put(serve.lab_rows(labs(spark, ("P0001", "2026-09-05", 6.4))), 1)
    ask((9, lab, None), (10, "What is the latest HbA1c for P0002?", None))
    got = events_of(store)
    assert "cache" not in got[9][0][2] and "6.4" in got[9][-1][2]["answer"] and got[10][0][2]["cache"] == "exact"
    # A batch that runs again replaces itself.
    before, stored = store.events().count(), store.stored().count()
    serve.answer_batch(spark.createDataFrame([(9, lab, None), (10, "What is the latest HbA1c for P0002?", None)], ASKED), store, 2, run)
    assert store.events().count() == before and store.stored().count() == stored and events_of(store) == got
