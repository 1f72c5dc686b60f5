"""Retrieval under a filter for each question, against plain Python; and the lifecycle on top of it."""

from __future__ import annotations

import datetime as dt
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.engine import engine
from sparkloom.operators import lifecycle, scoped

SPACES = ("guidelines", "patient_notes", "drug_labels")
ROWS = "id long, namespace string, owner string, drug string, date_num long, label int, title string, text string, embedding array<float>"
ASKED = "qid long, text string, embedding array<float>, scope string, namespaces array<string>, drugs array<string>, start long, stop long, filter string"
FILTERS = {"low": {"label": {"$lt": 3}}, "odd": {"$or": [{"label": {"$in": [1, 3]}}, {"drug": "b"}]}, "known": {"label": {"$exists": True}}}


def make(spark, n=300, m=40, seed=1):
    rng = random.Random(seed)
    vec = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]
    rows = []
    for i in range(n):
        ns = rng.choice([*SPACES, None])
        rows.append((i, ns, f"P{rng.randrange(4)}" if ns == "patient_notes" or rng.random() < 0.1 else None, rng.choice(["a", "b", "c", None]) if ns == "drug_labels" else None, rng.choice([None, 20200000 + rng.randrange(9)]), rng.choice([None, *range(5)]), "t", " ".join(rng.choices(["fever", "cough", "dose", "rash", "pain"], k=6)), rng.choice([None, rows[0][8]] if rows and rng.random() < 0.1 else [vec()])))
    asked = []
    for q in range(m):
        asked.append((q, rng.choice(["fever dose", "cough", "pain and rash", ""]), None if q == 7 else vec(), rng.choice([None, *(f"P{x}" for x in range(5))]), rng.sample([*SPACES, "elsewhere"], rng.randrange(4)) + ["guidelines"] * (q % 2), rng.choice([[], [], ["a"], ["b", "a", "b"], ["z"]]), rng.choice([None, 20200003]), rng.choice([None, 20200006]), rng.choice([None, None, *FILTERS])))
    return rows, asked, spark.createDataFrame(rows, ROWS), spark.createDataFrame(asked, ASKED)


def passes(name, label, drug):
    return name is None or {"low": label is not None and label < 3, "odd": label in (1, 3) or drug == "b", "known": label is not None}[name]


def may(row, ns, asked):
    _, space, owner, drug, date, label, *_ = row
    _, _, _, scope, _, drugs, start, stop, chosen = asked
    if space != ns or not passes(chosen, label, drug):
        return False
    if ns == "patient_notes":
        return scope is not None and owner == scope and (start is None or date is not None and date >= start) and (stop is None or date is not None and date <= stop)
    return ns != "drug_labels" or not drugs or drug in drugs


@pytest.mark.parametrize("lot", [4096, 9])
def test_dense_under_masks_equals_brute_force(spark, lot):
    rows, asked, passages, questions = make(spark)
    got = defaultdict(list)
    for r in scoped.dense(passages.repartition(5), scoped.jobs_of(questions), 6, filters=FILTERS, lot=lot).collect():
        got[r.qid, r.namespace].append((r["rank"], r.id))
    exp = {}
    for a in asked:
        for ns in set(a[4]):
            scores = sorted((-round(float(np.dot(np.array(r[8], dtype=float), np.array(a[2], dtype=float))), 9), r[0]) for r in rows if r[8] is not None and a[2] is not None and may(r, ns, a))
            if scores:
                exp[a[0], ns] = [(k + 1, i) for k, (_, i) in enumerate(scores[:6])]
    assert {k: sorted(v) for k, v in got.items()} == exp


def test_words_under_masks_see_the_same_rows(spark):
    rows, asked, passages, questions = make(spark, seed=2)
    got = defaultdict(set)
    for r in scoped.words(passages, scoped.jobs_of(questions), 1000, filters=FILTERS).collect():
        got[r.qid, r.namespace].add(r.id)
    exp = {(a[0], ns): {r[0] for r in rows if may(r, ns, a) and set(r[7].split()) & set(a[1].split())} for a in asked for ns in set(a[4])}
    assert dict(got) == {k: v for k, v in exp.items() if v}


def test_no_row_of_another_subject_and_leaks_are_counted(spark):
    rows, asked, passages, questions = make(spark, seed=3)
    by_id = {r[0]: r for r in rows}
    for hybrid in (True, False):
        hits, report = scoped.retrieve(questions, passages, 5, hybrid=hybrid, filters=FILTERS)
        hits = hits.collect()
        scope = {a[0]: a[3] for a in asked}
        assert hits and all(by_id[h.id][2] in (None, scope[h.qid]) for h in hits)
        assert all(n <= 5 for n in Counter(h.qid for h in hits).values()) and {(h.qid, h["rank"]) for h in hits if h["rank"] == 1} == {(h.qid, 1) for h in hits}
        told = {r.qid: r for r in report.collect()}
        assert len(told) == len(asked) and sum(r.blocked for r in told.values()) > 0
        for a in asked:
            assert told[a[0]].skipped == (["patient_notes"] if "patient_notes" in a[4] and a[3] is None else [])
            assert set(told[a[0]].searched) == set(a[4]) - set(told[a[0]].skipped)


def test_empty_tables_and_unknown_filters(spark):
    _, _, passages, questions = make(spark, 20, 5)
    assert scoped.dense(passages.limit(0), scoped.jobs_of(questions), 3, filters=FILTERS).count() == 0
    assert scoped.dense(passages, scoped.jobs_of(questions.limit(0)), 3).count() == 0
    hits, report = scoped.retrieve(questions.limit(0), passages, 3)
    assert hits.count() == report.count() == 0
    with pytest.raises(ValueError, match="unknown filters"):
        scoped.dense(passages, scoped.jobs_of(questions.withColumn("filter", F.lit("nobody")).withColumn("namespaces", F.array(F.lit("guidelines")))), 3)


def test_engine_refuses_notes_without_a_subject(spark):
    _, _, passages, questions = make(spark, 60, 12)
    e = engine(spark, None, passages.drop("embedding").withColumn("id", F.col("id").cast("string")), spark.createDataFrame([], "key string, value string, expires_at double"), 0.0, dt.date(2026, 10, 1))
    asked = questions.drop("embedding", "filter")
    with pytest.raises(ValueError, match="requires a scope"):
        e.scoped_search(asked.withColumn("namespaces", F.array(F.lit("patient_notes"))).withColumn("scope", F.lit(None).cast("string")))
    hits, _ = e.scoped_search(asked.where("scope is not null"), 3)
    assert hits.count() > 0


def test_lifecycle_reads_records_and_passages_of_the_subject_only(spark):
    lab = lambda who, day, v: (f"patient:{who}:lab:hemoglobin_a1c:{day}", json.dumps({"lab": "hemoglobin a1c", "date": day, "value": v, "unit": "%"}))
    records = spark.createDataFrame([("patient:P0001", '{"name": "A"}'), ("patient:P0002", '{"name": "B"}'), lab("P0001", "2026-01-05", "7.1"), lab("P0001", "2026-08-05", "6.4"), lab("P0002", "2026-09-05", "9.9")], "key string, value string")
    passages = spark.createDataFrame(
        [("n1", "patient_notes", "note", "The patient reports ankle swelling since the spring visit.", "P0001", None, 20260301), ("n2", "patient_notes", "note", "The patient reports ankle swelling and great pain.", "P0002", None, 20260301),
         ("l1", "drug_labels", "apixaban", "Apixaban warnings: bleeding can be serious.", None, "apixaban", None), ("l2", "drug_labels", "warfarin", "Warfarin warnings: bleeding can be serious and fatal.", None, "warfarin", None)],
        "id string, namespace string, title string, text string, owner string, drug string, date_num long",
    )
    q = spark.createDataFrame([(1, "What is the latest HbA1c for P0001?", None), (2, "What did the notes say about ankle swelling?", "P0001"), (3, "What are the warnings for apixaban?", None), (4, "What medications is P0002 taking?", "P0001")], "qid long, query string, scope string")
    run = lifecycle.run(q, None, passages, records=records, min_score=0.01)
    told = {r.qid: r for r in run.final.collect()}
    evidence = defaultdict(set)
    for r in run.evidence.collect():
        evidence[r.qid].add(r.id)
    assert evidence[1] == {"patient:P0001:lab:hemoglobin_a1c:2026-08-05"} and told[1].status == "answered" and "6.4" in told[1].answer
    assert "n1" in evidence[2] and "n2" not in evidence[2] and told[2].status == "answered"
    assert "l1" in evidence[3] and "l2" not in evidence[3] and told[3].status == "answered"
    assert told[4].status == "violation" and not evidence[4]
    # A brand of a catalogue table stands for its drug.
    brand = spark.createDataFrame([(5, "What are the warnings for Elomax Forte?", None)], "qid long, query string, scope string")
    names = spark.createDataFrame([("drugs", "elomax forte", "apixaban"), ("drugs", "elomax", "warfarin")], "kind string, surface string, canonical string")
    run = lifecycle.run(brand, None, passages, records=records, min_score=0.01, names=names)
    assert run.questions.first().drugs == ["apixaban"] and {r.id for r in run.evidence.collect()} == {"l1"}


def test_many_queries_come_in_lots(spark):
    from sparkloom.operators import vectors

    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.select(F.col("id").alias("qid"), "embedding")
    one = {tuple(r) for r in vectors.many_top_k(v, q, 3).select("qid", "id", "rank").collect()}
    assert {tuple(r) for r in vectors.many_top_k(v, q, 3, lot=7).select("qid", "id", "rank").collect()} == one and len(one) == 240


def test_gates_know_ascii_words_only(spark):
    asked = spark.createDataFrame([(1, "history of overdose documented for P0001 ié", None)], "qid long, query string, scope string")
    row = lifecycle.routed(asked, spark.createDataFrame([("P0001",)], "subject string"), dt.date(2026, 10, 1)).first()
    assert (row.status, row.subject) == ("red_flag", "P0001")


def test_words_are_scored_in_blocks_and_lots(spark, monkeypatch):
    from sparkloom.operators import lexical

    _, _, passages, questions = make(spark, 60, 12)
    jobs = scoped.jobs_of(questions)
    one = {(r.qid, r.namespace, r.id, round(r.score, 9), r.rank) for r in scoped.words(passages, jobs, 3).collect()}
    monkeypatch.setattr(lexical, "LOT", 20)
    monkeypatch.setattr(lexical, "CELLS", 30)
    found = scoped.words(passages, jobs, 3)
    assert {(r.qid, r.namespace, r.id, round(r.score, 9), r.rank) for r in found.collect()} == one and one
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan  # no row for each term that a passage shares with a job


def test_a_task_passes_on_the_best_of_all_its_blocks(spark, monkeypatch):
    from sparkloom.operators import lexical

    _, _, passages, questions = make(spark, 400, 20, seed=4)
    monkeypatch.setattr(lexical, "CELLS", 100)
    monkeypatch.setattr(scoped, "_ranked", lambda found, *_: found)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
        passed = scoped.words(passages.coalesce(1), scoped.jobs_of(questions), 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert passed and max(Counter((r.qid, r.namespace) for r in passed).values()) <= 4  # the two best, and rows that tie with them


def test_texts_of_passages_do_not_travel_with_questions(spark, monkeypatch):
    from sparkloom.operators import fusion
    from sparkloom.sources import shared

    passages = spark.createDataFrame([(f"g{i}", "guidelines", f"asthma {i}" if i % 3 == 0 else None, f"Asthma should be treated step by step. Step {i} is inhaled therapy. " + "More is not said of asthma here. " * (i % 4)) for i in range(12)], "id string, namespace string, title string, text string")
    records = spark.createDataFrame([("patient:P0001", '{"name": "A"}')], "key string, value string")
    written = {}

    def kept(df, name):
        out = shared.saved(df, name)
        written[name] = sum(len(r.text or "") for r in out.select("text").collect()) if "text" in out.columns else 0
        return out

    monkeypatch.setattr(scoped, "saved", kept)
    monkeypatch.setattr(lifecycle, "saved", kept)
    run = lifecycle.run(spark.createDataFrame([(q, "How should asthma be treated?" + " Step by step" * q, None) for q in range(3)], "qid long, query string, scope string"), None, passages, records=records, min_score=0.0001)
    assert {r.status for r in run.final.collect()} == {"answered"} and all(r.text for r in run.evidence.collect())
    assert {"merged", "evidence"} <= written.keys() and not any(written[x] for x in ("merged", "evidence"))
    # What is counted where words are scored ranks as the texts do.
    _, _, rows, questions = make(spark, 200, 30, seed=5)
    rows = rows.drop("embedding").withColumn("title", F.when(F.col("id") % 4 == 0, "rash, cough").when(F.col("id") % 4 == 1, "the fever"))
    rows = rows.withColumn("text", F.when(F.col("id") % 9 > 0, F.concat_ws(" ", "text", "title", F.repeat(F.lit("word "), (F.col("id") % 7).cast("int")))))
    one, other = ({tuple(r) for r in scoped.retrieve(questions.drop("embedding"), rows, 5, filters=FILTERS, rerank=f)[0].collect()} for f in (fusion.rerank, lambda *a: fusion.rerank(*a)))
    assert one == other and len(one) > 50


def test_postings_of_repeated_missing_and_empty_documents(spark):
    from sparkloom.operators import lexical

    texts = [("a", "fever and coughs, HTN"), ("b", "Fever fever-3 x"), ("a", "cough dose"), ("c", None), ("d", ""), (None, "fever"), (None, "rash fever"), ("e", "the of"), ("f", "été fever 12.5")]
    docs = spark.createDataFrame([(k, n, t, "HTN fever" if n % 2 else None) for n, (k, t) in enumerate(texts)], "id string, n int, text string, title string")
    terms = spark.createDataFrame([(t,) for t in ("fever", "cough", "hypertension", "rash", "12.5")], "term string")
    asked = {r.term for r in terms.collect()}
    counted = defaultdict(Counter)
    for r in lexical.token_rows(docs.select("id", "text"), "id").collect():
        counted[r.id][r.term] += 1
    exp = {k: (sum(c.values()), {t: n for t, n in c.items() if t in asked}) for k, c in counted.items()}
    got = {r.id: (r.length, {t: n for t, n in r.found}) for r in lexical.postings(docs, terms, "id").collect()}
    assert got == exp and None in got
    rows = {r.n: r for r in lexical.postings(docs, terms, "id", keep=("n",), beside="title").collect()}
    assert {n: (r.length, {x.term: x.tf for x in r.found if x.tf}) for n, r in rows.items()} == {n: exp.get(k, (0, {})) if k else (0, {}) for n, (k, _) in enumerate(texts)}
    assert {x.term: (x.tf, x.titled) for x in rows[1].found} == {"fever": (1, 1), "hypertension": (0, 1)} and rows[1].size == rows[1].length + 2 and rows[3].size == 2


def test_long_conversations_keep_their_questions_apart(spark):
    from sparkloom.plans import scoped_queries

    rows = spark.createDataFrame([(0, 8, "a", None), (1, 0, "b", None), (0, 398, "c", None)], "conv_id long, turn long, query string, scope string")
    keys = [r.qid for r in scoped_queries.told_apart(rows).collect()]
    assert len(set(keys)) == 3 and [(k >> 32, k & 0xFFFFFFFF) for k in keys] == [(0, 8), (1, 0), (0, 398)]
