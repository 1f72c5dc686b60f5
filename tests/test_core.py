"""Key-value, text, filter, retrieval, routing, answer, measure and state operators."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
from collections import Counter, OrderedDict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import filters, routing, text
from sparkloom.functions import fixed_values as V
from sparkloom.operators import answers, chunking, fusion, kv, lexical, measures, records, vectors
from sparkloom.plans.registry import ORACLES, QUERIES
from sparkloom.sources import files
from sparkloom.streaming import state


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def value(spark, col):
    return one(spark, col.alias("x")).x


# --- key-value ---------------------------------------------------------------------------------
LOG = "batch_id long, seq long, op string, key string, value string, ttl_s double, at double"


def test_log_resolution(spark):
    log = spark.createDataFrame([
        (1, 1, "put", "a", "1", 10.0, 0.0), (1, 2, "put", "b", "1", None, 0.0), (2, 3, "put", "a", "2", None, 1.0), (3, 4, "delete", "b", None, None, 2.0),
        (4, 5, "put", "c", "9", None, 3.0), (4, 6, "put", "d", None, None, 3.0), (5, 7, "put", "e", "x", 2.0, 3.0),
    ], LOG)
    rows = lambda now: {r.key: (r.value, r.expires_at) for r in kv.resolve(log, now).collect()}
    assert rows(4.0) == {"a": ("2", None), "e": ("x", 5.0)}  # the put without ttl cleared it; batch 4 never happened
    assert rows(5.0) == {"a": ("2", None)}
    assert [r.existed for r in kv.deleted(log).collect()] == [True]


def test_prefix_scan_purge_snapshot(spark, tmp_path):
    t = spark.createDataFrame([(f"patient:P0001:lab:hemoglobin_a1c:{d}", "v", None) for d in ("b", "a", "c")] + [("patient:P0001:lab:hemoglobin:a", "v", None), ("patient:P00010", "v", 5.0)], "key string, value string, expires_at double")
    assert [r.key[-1] for r in kv.prefix_scan(t, "patient:P0001:lab:hemoglobin_a1c:", 0).collect()] == ["a", "b", "c"]
    assert kv.prefix_scan(t, "patient:", 9, 2).count() == 2
    stays, gone = kv.purge(t, 5.0)
    assert stays.count() == 4 and gone.first().purged == 1
    assert kv.snapshot(stays, f"{tmp_path}/s").count() == 4
    kinds = spark.createDataFrame([("patient:P1",), ("patient:P1:med:x",), ("patient:P1:lab:x:d",), ("drug:rx:1",), ("icd10:I10",)], "k string").select(kv.kind_of(F.col("k")).alias("x"))
    assert [r.x for r in kinds.collect()] == ["demographics", "medication", "lab", "drug", "icd10"]
    assert value(spark, kv.data_version(F.lit(2), F.lit(3))) == 2_000_003


# --- text --------------------------------------------------------------------------------------
def test_tokens_stems_numbers(spark):
    assert value(spark, text.tokens(F.lit("The patient's A1c studies: 5 labs, glasses & 2.5/3"))) == ["hemoglobin", "a1c", "study", "5", "lab", "glasse", "2.5/3"]
    assert sorted(value(spark, text.numbers(F.lit("On 2024-01-05: 1,000 mg, 7.50 and 3.0, B12")))) == ["1000", "2", "2024-01-05", "3", "7.5"]
    assert value(spark, text.sentences(F.lit("One. Two! three? Four\nFive"))) == ["One.", "Two! three?", "Four", "Five"]
    assert value(spark, text.slug(F.lit("  Type 2 (Diabetes) "))) == "type_2_diabetes"
    assert value(spark, text.strip_html(F.lit("<p>a &amp;lt; b</p><ul><li>x</li></ul>"))) == "a &lt; b\n- x"
    assert value(spark, text.clip(F.lit("aaaa bbbb. cccc dddd"), 14)) == "aaaa bbbb."


def test_pack_and_sections(spark):
    parts = F.array(*[F.lit(s) for s in ("a b c", "d e", "f g h", "i")])
    assert value(spark, chunking.pack(parts, 5, 1)) == ["a b c d e", "d e f g h", "f g h i"]
    assert value(spark, chunking.pack(parts, 5, 0)) == ["a b c d e", "f g h i"]
    assert value(spark, chunking.pack(F.array().cast("array<string>"), 5)) == []
    note = "intro\nCURRENT MEDICATIONS:\nmetformin\nASSESSMENT AND PLAN:  \nstay\nEMPTY PART:\n"
    assert [tuple(s) for s in value(spark, chunking.sections(F.lit(note)))] == [("Current Medications", "metformin"), ("Assessment And Plan", "stay")]
    assert [tuple(s) for s in value(spark, chunking.sections(F.lit(" plain ")))] == [("note", "plain")]
    assert [tuple(s) for s in value(spark, chunking.topic_sections(F.lit("Lead\nWhat is it?\nThis.\nThat.")))] == [("Summary", "Lead"), ("What is it?", "This.\nThat.")]


@pytest.mark.parametrize(
    ("spec", "passes"),
    [
        ({}, "abcd"), ({"p": "P1"}, "a"), ({"p": {"$ne": "P1"}}, "bcd"), ({"p": {"$in": ["P1", "P2"]}}, "ab"), ({"p": {"$nin": ["P1"]}}, "bcd"), ({"n": {"$gte": 2, "$lt": 4}}, "bc"), ({"p": {"$exists": False}}, "cd"),
        ({"t": "x"}, "ab"), ({"t": {"$ne": "x"}}, "cd"), ({"$or": [{"p": "P1"}, {"$and": [{"n": 3}, {"t": {"$nin": ["z"]}}]}]}, "ac"), ({"n": {"$gt": "2"}}, ""), ({"zz": {"$ne": 1}}, "abcd"), ({"zz": 1}, ""),
    ],
)
def test_filter_language(spark, spec, passes):
    rows = spark.createDataFrame([("a", "P1", 1, ["x", "y"]), ("b", "P2", 2, ["x"]), ("c", None, 3, ["y"]), ("d", None, None, None)], "k string, p string, n int, t array<string>")
    assert "".join(sorted(r.k for r in filters.apply_filter(rows, spec).collect())) == passes


def test_filter_rejects_unknown_operators(spark):
    with pytest.raises(ValueError):
        filters.apply_filter(spark.range(1), {"id": {"$like": 1}})
    assert filters.all_of(None, {"a": 1}) == {"a": 1} and filters.all_of({"a": 1}, {"b": 2}) == {"$and": [{"a": 1}, {"b": 2}]}


# --- retrieval ---------------------------------------------------------------------------------
def test_vectors(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ns int, embedding array<float>")
    got = [r.id for r in vectors.top_k(df, df.where("id = 0"), 5).collect()]
    exact = {i: sum(a * b for a, b in zip(e, rows[0][2], strict=True)) for i, _, e in rows}
    assert got == sorted(exact, key=lambda i: -exact[i])[:5]
    assert vectors.top_k(df, df.where("id = 0"), 2, namespace="ns").count() == 6
    new = spark.createDataFrame([(1, 9, [0.0] * 4, 1), (1, 8, [0.0] * 4, 2), (99, 9, [0.0] * 4, 1)], "id long, ns int, embedding array<float>, seq int")
    assert {r.id: r.ns for r in vectors.upsert(df, new).where("ns > 2").collect()} == {1: 8, 99: 9}
    assert [r.id for r in vectors.fetch(df, [5, 77, 2]).collect()] == [5, 2]
    assert vectors.delete(df).count() == 0 and vectors.delete(df, spec={"ns": 0}).count() == 26


def test_bm25_against_plain_formula(spark):
    docs = [(1, "red fox red"), (2, "blue fox"), (3, "green tree tree tree"), (4, "")]
    asked = [(1, "red fox fox")]
    got = {r.id: r.score for r in lexical.bm25(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "q long, text string"), "id", "q", 9).collect()}
    toks = {i: t.split() for i, t in docs}
    avg = sum(map(len, toks.values())) / 4
    df = lambda w: sum(w in t for t in toks.values())
    score = lambda t: sum(math.log(1 + (4 - df(w) + 0.5) / (df(w) + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in ("red", "fox", "fox"))
    assert got == pytest.approx({1: score(toks[1]), 2: score(toks[2])})


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i, 1 - 0.1 * k, k + 1, i[0]) for k, i in enumerate(ids)], "q long, id string, score double, rank int, ns string")
    out = fusion.rrf([ranked(["a", "b", "c"]), ranked(["b", "d"])], "id", "q", 3).orderBy("rank").collect()
    assert [r.id for r in out] == ["b", "a", "d"] and out[0].fused == pytest.approx(1 / 62 + 1 / 61)
    kept = fusion.diversify(ranked(["a1", "a2", "a3", "b1", "c1"]), "id", "q", "ns", 4).orderBy("rank").collect()
    assert [r.id for r in kept] == ["a1", "a2", "b1", "c1"] and [r["rank"] for r in kept] == [1, 2, 3, 4]
    rows = spark.createDataFrame([(1, "x", "insulin dose", "Dosage", "The insulin dose is fixed.", 0.1), (1, "y", "insulin dose", "Other", "Nothing of it.", 0.2)], "q long, id string, question string, section string, text string, score double")
    assert [r.id for r in fusion.rerank(rows, "id", "q", 2).orderBy("rank").collect()] == ["x", "y"]


# --- routing and safety ------------------------------------------------------------------------
TODAY = dt.date(2026, 10, 1)


def routed(spark, q, scope=None):
    df = spark.createDataFrame([(q, scope)], "query string, scope string").withColumn("q", routing.normalize(F.col("query")))
    df = df.withColumn("e", routing.entities(F.col("query"), F.col("q"), TODAY))
    return df.select("q", "e", routing.route(F.col("q"), F.col("e"), F.col("scope")).alias("r"), routing.precheck(F.col("query"), F.lit(False)).alias("p")).first()


@pytest.mark.parametrize(
    ("q", "scope", "route"),
    [
        ("What is the latest HbA1c for P0001?", None, "KV"), ("side effects of metformin", None, "VECTOR"), ("Given P0003's eGFR, is metformin appropriate?", None, "HYBRID"), ("what does E11.9 mean", None, "KV"),
        ("what did the notes say about swelling", "P0001", "VECTOR"), ("hello there", None, "VECTOR"), ("tell me more", "P0001", "HYBRID"), ("RxCUI for warfarin", None, "KV"),
    ],
)
def test_routes(spark, q, scope, route):
    assert routed(spark, q, scope).r.route == route


def test_entities(spark):
    x = routed(spark, "Since 2023, BP and HTN of p0007's chart: E11.9, RxCUI: 6809, dose of warfarin").e
    assert x.patient_ids == ["P0007"] and x.icd10_codes == ["E11.9"] and x.rxnorm_codes == ["6809"] and x.drugs == ["warfarin"] and x.conditions == ["hypertension"]
    assert x.labs == ["diastolic blood pressure", "systolic blood pressure"] and x.dosage_intent and x.time_range.start == dt.date(2023, 1, 1)
    assert routed(spark, "labs in the last six months").e.time_range.start == TODAY - dt.timedelta(days=180)
    assert value(spark, routing.negated("conditions", F.lit("she denies any history of asthma but has hypertension"))) == ["asthma"]


@pytest.mark.parametrize(
    ("q", "verdict", "category"),
    [
        ("crushing chest pain spreading to my arm", "red_flag", "cardiac"), ("I want to die and took too many pills", "red_flag", "self_harm"), ("history of overdose documented for P0001", "ok", "record_query_on_red_flag_topic"),
        ("who won the match", "out_of_scope", "non_clinical"), ("cholesterol lowering diet", "ok", None),
    ],
)
def test_precheck(spark, q, verdict, category):
    assert tuple(routed(spark, q).p) == (verdict, category)


# --- answers -----------------------------------------------------------------------------------
def test_citation_check(spark):
    evidence = spark.createDataFrame([(1, "S1", "Metformin 500 mg twice daily since 2024-01-05.", "kv"), (1, "S2", "Take 1,000 mg at most.", "label")], "q long, key string, text string, title string")
    answer = "Based on the retrieved sources, this is educational. Metformin 500 mg [S1]. Up to 1000 mg [S2]. It is 700 mg [S1]. Unsure [S7]. No source here."
    df = spark.createDataFrame([(1, answer)], "q long, answer string")
    assert [r.status for r in answers.check_sentences(df, evidence, "q").orderBy("pos").collect()] == ["exempt", "supported", "supported", "number", "invalid_key", "uncited"]
    got = answers.check_answers(df, evidence, "q").first()
    assert (got.counted, got.supported, got.grounding_rate, got.passed) == (5, 2, 0.4, False) and got.kept_text.endswith("Up to 1000 mg [S2].")


def test_compose_quotes_and_caps(spark):
    evidence = spark.createDataFrame([(1, "S1", "kv", "lab", "Glucose was high today. Glucose was low yesterday. Glucose was fine before.", 0), (1, "S2", "vector", "", "Glucose was high today. Nothing else matters here.", 1)], "q long, key string, origin string, title string, text string, order int")
    q = spark.createDataFrame([(1, "glucose today"), (2, "nothing")], "q long, question string")
    got = {r.q: r.answer for r in answers.compose(q, evidence, "q").collect()}
    assert got[2] == "INSUFFICIENT_EVIDENCE" and got[1].count("[S1]") == 2 and "[S2]" not in got[1]


# --- records and measures ----------------------------------------------------------------------
def test_as_of_and_age(spark):
    left = spark.createDataFrame([(1, 10), (1, 3), (2, 5)], "k long, at long").withColumn("id", F.monotonically_increasing_id())
    right = spark.createDataFrame([(1, 3, "x", 1), (1, 3, "y", 2), (1, 8, "z", 3), (1, 11, "w", 4)], "k long, at long, v string, tie long")
    assert {(r.k, r.at): (r.as_of, r.v) for r in records.as_of(left, right, "k", "at", "tie", ["v"]).collect()} == {(1, 10): (8, "z"), (1, 3): (3, "y"), (2, 5): (None, None)}
    ages = [value(spark, records.age_on(F.lit(dt.date(2000, 2, 29)), F.lit(d))) for d in (dt.date(2024, 2, 28), dt.date(2024, 2, 29), dt.date(2023, 3, 1))]
    assert ages == [23, 24, 23]


def test_measures(spark):
    df = spark.createDataFrame([("KV", "KV"), ("KV", "VECTOR"), ("VECTOR", "VECTOR"), ("HYBRID", None)], "t string, g string")
    rep = {r.label: r for r in measures.classification_report(df, "t", "g").collect()}
    assert (rep["KV"].precision, rep["KV"].recall, rep["VECTOR"].precision, rep["HYBRID"].f1) == (1.0, 0.5, 0.5, 0.0)
    empty = measures.binary(df.limit(0), F.lit(True), F.lit(True)).first()
    assert (empty.precision, empty.recall) == (1.0, 1.0)
    hist = {r.le: r.n for r in measures.histogram(spark.createDataFrame([(1.0,), (1.5,), (20000.0,)], "v double"), "v").collect()}
    assert hist[1] == 1 and hist[2] == 1 and hist[-1] == 1 and len(hist) == 14 and sum(hist.values()) == 3


# --- state -------------------------------------------------------------------------------------
OPS = "shard string, seq long, op string, key string, tags string, ttl double, at double"


def cache_log(n=300):
    rng = random.Random(8)
    kinds = ["get"] * 5 + ["set"] * 4 + ["invalidate", "invalidate_tag"]
    return [(f"s{rng.randrange(3)}", i, rng.choice(kinds), f"k{rng.randrange(8)}", f"t{rng.randrange(3)}", rng.choice([None, 5.0, 50.0]), float(i)) for i in range(n)]


def test_lru_replay_equals_stream(spark, tmp_path):
    log = spark.createDataFrame(cache_log(), OPS)
    batch = {(r.shard, r.seq): (r.outcome, r.size) for r in state.lru_replay(log, 4).collect()}
    assert len(batch) == 300 and {"hit", "miss", "expired", "evicted"} <= {o for o, _ in batch.values()} and max(s for _, s in batch.values()) == 4
    plain = OrderedDict()
    for shard, seq, op, key, tags, ttl, at in cache_log():
        if shard != "s0":
            continue
        if op == "get":
            if key in plain and plain[key][0] is not None and plain[key][0] <= at:
                del plain[key]
                assert batch["s0", seq][0] == "expired"
            else:
                assert batch["s0", seq][0] == ("hit" if key in plain else "miss")
                key in plain and plain.move_to_end(key)
        elif op == "set":
            plain.pop(key, None)
            plain[key] = (None if ttl is None else at + ttl, tags)
            len(plain) > 4 and plain.popitem(last=False)
        elif op == "invalidate":
            plain.pop(key, None)
        else:
            for k in [k for k, v in plain.items() if v[1] == tags]:
                del plain[k]
    log.orderBy("seq").repartitionByRange(1, "seq").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = state.lru_stream(spark.readStream.schema(OPS).parquet(f"{tmp_path}/in"), 4)
        q = stream.writeStream.format("memory").queryName("lru").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {(r.shard, r.seq): (r.outcome, r.size) for r in spark.table("lru").collect()} == batch


def test_token_bucket_and_single_flight(spark):
    log = spark.createDataFrame([("u", i, t) for i, t in enumerate([0.0, 0.0, 0.0, 30.0, 31.0])], "user string, seq long, at double")
    got = state.token_bucket(log, per_minute=2, burst=2).orderBy("seq").collect()
    assert [r.allowed for r in got] == [True, True, False, True, False] and got[2].wait == pytest.approx(30)
    calls = spark.createDataFrame([("k", i, t) for i, t in enumerate([0.0, 1.0, 9.0, 9.5])], "key string, seq long, at double")
    assert [r.leader for r in state.single_flight(calls, "key", "at", "seq", 2.0).orderBy("seq").collect()] == [True, False, True, False]


# --- sources -----------------------------------------------------------------------------------
def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert files.read_jsonl(spark, f"{tmp_path}/a.jsonl", "x int").count() == 2 and files.read_jsonl(spark, f"{tmp_path}/none.jsonl", "x int").count() == 0
    (tmp_path / "icd.txt").write_text("E119    Type 2 diabetes\nI10     Hypertension\n")
    assert [(r.code, r.name) for r in files.read_icd(spark, f"{tmp_path}/icd.txt").collect()] == [("E11.9", "Type 2 diabetes"), ("I10", "Hypertension")]
    (tmp_path / "t.xml").write_text('<t><health-topic id="7" title="Flu" url="u" language="English"><full-summary>&lt;p&gt;Rest.&lt;/p&gt;</full-summary></health-topic></t>')
    assert [(r.topic_id, r.title, r.summary) for r in files.read_topics(spark, f"{tmp_path}/t.xml").collect()] == [(7, "Flu", "Rest.")]
    import hashlib

    good = hashlib.sha256((tmp_path / "icd.txt").read_bytes()).hexdigest()
    m = spark.createDataFrame([("icd.txt", good, "CC0"), ("a.jsonl", "0", "CC0"), ("gone", "0", "x"), ("t.xml", hashlib.sha256((tmp_path / "t.xml").read_bytes()).hexdigest(), " ")], "name string, sha256 string, licence string")
    assert {r.name: r.status for r in files.verify_manifest(spark, m, str(tmp_path)).collect()} == {"icd.txt": "ok", "a.jsonl": "changed", "gone": "missing", "t.xml": "no_licence"}


# --- registered queries ------------------------------------------------------------------------
def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


# --- word boundaries ------------------------------------------------------------------------------------
def test_precheck_knows_ascii_words_only(spark):
    p = one(spark, routing.precheck(F.lit("history of overdose documented for P0001 ié"), F.lit(True)).alias("p")).p
    assert (p.verdict, p.category) == ("red_flag", "overdose")  # "i" before "é" is a word for the SQL


def test_route_knows_ascii_words_only(spark):
    q = F.lit("what does the note say about chest pain doñes")
    r = one(spark, routing.route(q, routing.entities(q, q, dt.date(2026, 10, 1)), F.lit(None).cast("string")).alias("r")).r
    assert (r.route, r.confidence) == ("VECTOR", 0.88)


def test_score_blocks_are_bounded_by_products(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(lexical, "CELLS", 5000)
    pairs = [(q, f"t{t}", 1.0) for q in range(40) for t in range(20)]
    asked = lexical._Asked(pa.Table.from_pylist([{"qid": q, "term": t, "w": w} for q, t, w in pairs]), "qid")
    found = pa.array([[{"term": f"t{t}", "tf": 1 + d % 3} for t in range(20)] for d in range(100)], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))
    got = list(asked.blocks(found, np.full(100, 20.0), 20.0))
    assert max(len(s) for _, s in got) * 20 * 40 <= 5000 and sum(len(s) for _, s in got) == 100  # before: 100 documents, 80,000 products at once
    for first, s in got:
        for n, row in enumerate(s):
            assert np.allclose(row, 20 * lexical.part(1 + (first + n) % 3, 20.0, 20.0))
    nothing = pa.array([[], []], found.type)
    assert [s.dtype for _, s in asked.blocks(nothing, np.zeros(2), 1.0)] == [np.float64]


def test_feature_counts_are_those_of_each_row(spark, tmp_path):
    texts = [(1, "Insulin dose and insulin doses"), (1, "the insulin pump"), (2, ""), (3, "the and"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES["hash_embed_features"](spark, str(tmp_path))
    # insulin dose insulin dose: two words, seven trigrams, two pairs; insulin pump: two, seven, one.
    assert sorted(plan.collect()) == [(1, 2, 7, 1, 10, 445), (1, 4, 14, 3, 11, 960)]
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_route_reads_beyond_other_line_separators(spark):
    q = spark.createDataFrame([(f"is it {c} on",) for c in ("\u2028", "\u2029", "\u0085", "still")], "q string")
    assert [r[0] for r in q.select(routing.has(F.col("q"), V.LOOKUP)).collect()] == [True] * 4


def test_doc_freq_of_repeated_and_missing_ids_equals_its_sql(spark, tmp_path):
    """A row without an id was a document; a text's tokens each became a row."""
    words = ["Labs", "lab", "htn", "a1c", "HbA1c", "hemoglobin", "type-2", "x..y", "a/b-c", "the", "ESS", "berries", "é", "3.5", "-", "ﬁ", "s", "bp."]
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(12)]) if i % 3 else 100 + i, rng.choice(["", ".", " "]) + " ".join(rng.choices(words, k=rng.randrange(9)))) for i in range(300)] + [(None, "nowhere"), (5, None), (None, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["doc_freq"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(ORACLES["doc_freq"]).fetchall())
    assert ("nowhere", 0, 1) in got


def test_texts_without_rows_or_tokens_have_no_terms(spark):
    for rows in ([], [(1, "")], [(1, None), (2, "... -")]):
        assert lexical.term_frequencies(spark.createDataFrame(rows, "id long, text string"), "id").count() == 0


def test_terms_of_lots_of_texts_are_cut_as_by_the_pattern(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab7.-/ é_", k=rng.randrange(25))) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), pa.array(texts)], names=["id", "hash", "text"])
    found = [[t for t in re.findall(text.TOKEN, x) if t != "a"] for x in texts]  # a stop word
    for most in (1 << 23, 100, 1):
        monkeypatch.setattr(lexical, "CUT", most)
        df, tf, rows = Counter(), Counter(), 0
        for b in lexical._counted(lambda h: h < 0)([batch]):
            for r in b.to_pylist():
                df[r["term"]] += r["df"]
                tf[r["term"]] += r["tf"]
                rows += 1
        assert tf == Counter(t for x in found for t in x) and df == Counter(t for x in found for t in set(x))
        assert (most > 1000) == (rows == len(tf))  # one row for each term of a lot
