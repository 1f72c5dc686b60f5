"""Lookup, evaluation, loading, entities, embedding and the engine, against plain Python or worked examples."""

from __future__ import annotations

import datetime as dt
import difflib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.engine import engine
from sparkloom.functions import embed, fuzzy, routing, text
from sparkloom.operators import answers, evaluation, ingest, lexical, lookup, vectors, writes
from sparkloom.streaming import state

TODAY = dt.date(2026, 10, 1)


# --- evaluation --------------------------------------------------------------------------------
def test_source_matches(spark):
    cases = [
        ("kv:patient:P0001:lab", "kv:patient:P0001:lab:a1c:2024", True), ("kv:patient:P0001", "vec:patient:P0001", False), ("doc:note:P1:E1", "vec:note:P1:E1#plan#0", True),
        ("doc:note:P1", "vec:note:P1:E1#plan#0", False), ("doc:a", "kv:a", False), ("web:1", "web:1", True), ("web:1", "web:12", False),
    ]
    df = spark.createDataFrame(cases, "e string, s string, want boolean")
    assert df.where(evaluation.source_matches(F.col("e"), F.col("s")) != F.col("want")).count() == 0


def test_retrieval_scores_and_strict_pairs(spark):
    expected = spark.createDataFrame([(1, "kv:a"), (1, "doc:d"), (2, "doc:z")], "id long, expected string")
    ranked = spark.createDataFrame([(1, "vec:x#0", 1), (1, "kv:a:b", 2), (1, "vec:d#3", 4), (2, "vec:y#0", 1)], "id long, source string, rank int")
    got = {r.id: r for r in evaluation.retrieval_scores(expected, ranked, "id").collect()}
    assert (got[1].rr, got[1].recall_1, got[1].recall_3, got[1].recall_5) == (0.5, 0.0, 0.5, 1.0) and (got[2].rr, got[2].recall_10) == (0.0, 0.0)
    gold = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(ValueError):
        evaluation.paired(gold, spark.createDataFrame([(1,), (1,), (2,)], "id long"), "id")
    with pytest.raises(ValueError):
        evaluation.paired(gold, gold.where("id = 1"), "id")


# --- entities ------------------------------------------------------------------------------------
def one(spark, q: str, column):
    return spark.createDataFrame([(q,)], "q string").select(column(F.col("q")).alias("x")).first().x


def plain_negated(q: str) -> list[str]:
    lex, out = routing.LEXICON["conditions"], set()
    for m in re.finditer(routing.gazetteer("conditions"), q):
        window = q[max(0, m.start() - 40) : m.start()]
        hits = list(re.finditer(routing.V.NEGATION, window))
        if hits and len(window[hits[-1].end() :].split()) <= 4:
            out.add(lex[m[1]])
    return sorted(out)


def test_negation_against_plain_python(spark):
    rng = random.Random(5)
    pieces = ["no", "denies", "without", "history of", "asthma", "copd", "anemia", "diabetes", "hypertension", "and", "or any", "has", "the", "chest pain", "not", "gerd", "migraine", "a very long stretch of other words"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(2, 25))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "q string").select("q", routing.negated("conditions", F.col("q")).alias("x"))
    for r in df.collect():
        assert list(r.x) == plain_negated(r.q), r.q


def test_brands_known_codes_and_near_names(spark):
    brands = {"Glucophage": "metformin", "Zor": "simvastatin", "X99Plus": "aspirin"}
    assert routing.brand_lexicon(brands) == {"glucophage": "metformin"}
    e = lambda q, **kw: one(spark, q, lambda c: routing.entities(c, F.lower(c), TODAY, **kw))
    assert e("does glucophage help", brands=brands).drugs == ["metformin"] and e("does glucophage help").drugs == []
    assert e("I10 again", known_codes=["I10"]).icd10_codes == ["I10"] and e("I10 again").icd10_codes == [] and e("I10 code").icd10_codes == ["I10"]
    words = spark.createDataFrame([(1, w) for w in "how much metfornin and aspirin".split()], "k long, word string")
    spelled = [r.name for r in fuzzy.near_names(words, spark.createDataFrame([("aspirin",), ("metformin",), ("ferrous sulfate",)], "name string"), "k").collect()]
    near = e("how much metfornin and aspirin", near_drugs=F.array(*[F.lit(x) for x in spelled]))
    assert near.drugs == ["aspirin", "metformin"]
    assert e("no asthma but she takes a daily dose of warfarin").negated_terms == ["asthma"]


def test_unknown_words_in_any_letter(spark):
    known = ["hypertension", "metformin", "carefully", "diagnosis", "treatment", "warfarin", "potassium"]
    asked = ["xypertension", "hypertensiom", "metformin", "etformin", "mmetformin", "quetzalcoatl", "diagnosys", "treatmnet", "potasium", "glorbulent"]
    got = {r.word for r in fuzzy.unknown_words(spark.createDataFrame([(1, w) for w in asked], "k long, word string"), spark.createDataFrame([(w,) for w in known], "word string"), "k").collect()}
    assert got == {w for w in asked if w not in known and all(difflib.SequenceMatcher(None, k, w).ratio() < 0.85 for k in known)}


# --- embedding, search -----------------------------------------------------------------------------
def test_embedding_against_plain_python(spark):
    import xxhash

    docs = spark.createDataFrame([(1, "Chest pain and swelling, chest pain again"), (2, ""), (3, None), (4, "of the")], "id long, text string")
    got = {r.id: r.embedding for r in embed.hashing_embedding(docs, "id", "text", 64).collect()}
    words = docs.where("id = 1").select(text.tokens(F.col("text")).alias("w")).first().w
    tf: dict[str, float] = {}
    for w in words:
        tf[f"w:{w}"] = tf.get(f"w:{w}", 0) + 1
        for i in range(len(w) if len(w) >= 5 else 0):
            tf[f"c:{f'#{w}#'[i : i + 3]}"] = tf.get(f"c:{f'#{w}#'[i : i + 3]}", 0) + 0.25
    for a, b in zip(words, words[1:], strict=False):
        tf[f"b:{a}_{b}"] = tf.get(f"b:{a}_{b}", 0) + 0.7
    out = [0.0] * 64
    for f, n in tf.items():
        h = xxhash.xxh64_intdigest(f, 42)
        out[h % 64] += (1 if h >> 63 else -1) * (1 + math.log(n) if n >= 1 else n)
    norm = math.sqrt(sum(x * x for x in out))
    assert got[1] == pytest.approx([x / norm for x in out], abs=1e-6)
    assert got[2] == got[3] == got[4] == [0.0] * 64


def test_token_rows_are_tokens(spark):
    docs = spark.createDataFrame([(1, "HTN and diabetes: visits, meds for the Patients' illnesses"), (2, None), (3, "s t a1c dose")], "id long, text string")
    rows: dict[int, list[str]] = {}
    for r in lexical.token_rows(docs, "id").collect():
        rows.setdefault(r.id, []).append(r.term)
    want = {r.id: sorted(r.t) for r in docs.select("id", text.tokens(F.col("text")).alias("t")).collect() if r.t}
    assert {k: sorted(v) for k, v in rows.items()} == want


def test_many_queries_keep_ties_by_id(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(5000)]
    v = spark.createDataFrame([*rows, (9000, None)], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "qid long, embedding array<double>")
    got = {(r.qid, r["rank"]): r.id for r in vectors.many_top_k(v, q, 3).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == [2, 5, 8] and [got[2, k] for k in (1, 2, 3)] == [0, 1, 2]
    assert vectors.many_top_k(v, q.limit(0), 3).count() == 0


def test_semantic_hits_of_a_hot_bucket(spark):
    rng = random.Random(3)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    cached = [(i, i % 7 > 0, vec()) for i in range(300)]
    asked = [(i, i % 2 > 0, vec()) for i in range(30)]
    c = spark.createDataFrame(cached, "id long, bucket boolean, embedding array<double>")
    a = spark.createDataFrame(asked, "qid long, bucket boolean, embedding array<double>")
    got = {r.qid: r.cached_id for r in writes.semantic_hits(a, c, 1.0, block=20).collect()}
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    want = {}
    for i, b, x in asked:
        best = max((dot(x, y), -j) for j, bb, y in cached if bb == b)
        if best[0] >= 1.0:
            want[i] = -best[1]
    assert got == want


# --- records, loading ------------------------------------------------------------------------------
def test_records_of_entities(spark):
    pre = "patient:P0001"
    labs = [(f"{pre}:lab:tsh:2024-0{m}-01", f'{{"lab":"tsh","date":"2024-0{m}-01"}}') for m in range(1, 6)]
    rows = [(pre, '{"name":"A"}'), (f"{pre}:condition:I10", '{"name":"hypertension"}'), (f"{pre}:med:aspirin", '{"drug":"aspirin","status":"active"}'), (f"{pre}:med:old", '{"drug":"old","status":"stopped"}'), ("drug:aspirin", '{"name":"aspirin"}'), ("icd10:I10", '{"code":"I10"}'), ("patient:P00010", '{"name":"B"}'), *labs]
    kv = spark.createDataFrame(rows, "key string, value string")
    schema = "qid int, scope string, icd10_codes array<string>, rxnorm_codes array<string>, drugs array<string>, labs array<string>, conditions array<string>, record_types array<string>, start string, stop string, latest_only boolean"
    asked = [
        (1, "P0001", [], [], ["aspirin"], ["tsh"], [], [], None, None, False), (2, None, ["I10", "Z99"], [], ["aspirin"], [], [], [], None, None, False), (3, "P0001", ["I10"], [], [], [], [], [], None, None, False),
        (4, "P0001", [], [], [], ["tsh"], ["hypertension"], [], "2024-02-01", "2024-03-31", False), (5, "P0001", [], [], [], ["tsh"], [], ["labs", "conditions"], None, None, True),
    ]
    got: dict[int, list[str]] = {}
    for r in lookup.records_for(spark.createDataFrame(asked, schema), kv).orderBy("qid", "seq").collect():
        got.setdefault(r.qid, []).append(r.key.removeprefix(pre + ":"))
    lab = lambda m: f"lab:tsh:2024-0{m}-01"
    assert got[1] == [lab(5), lab(4), lab(3), "med:aspirin", "drug:aspirin"] and got[2] == ["icd10:I10", "drug:aspirin"]
    assert got[3] == ["icd10:I10", pre, "condition:I10", "med:aspirin"] and got[4] == [lab(3), lab(2), "condition:I10"] and got[5] == [lab(5), "condition:I10"]
    assert {r.key for r in lookup.of_subject(kv, "P0001", ["demographics"]).collect()} == {pre}


def test_load_only_what_changed(spark, tmp_path):
    listed = spark.createDataFrame([("b", "2"), ("a", "1")], "name string, digest string")
    found = ingest.fingerprint(listed, "name", "digest", "hashing")
    assert len(found) == 24 and found == ingest.fingerprint(listed.orderBy("name"), "name", "digest", "hashing") != ingest.fingerprint(listed, "name", "digest", "other")
    built = []

    def build():
        built.append(1)
        return listed

    for changed in (True, False):
        table, did = ingest.load_if_changed(spark, f"{tmp_path}/t", found, build)
        assert did is changed and table.count() == 2
    assert built == [1] and ingest.load_if_changed(spark, f"{tmp_path}/t", "other", build)[1]


def test_label_rows_and_choice(spark):
    labels = spark.createDataFrame([("Aspirin", "g", "", ["5", "6"]), ("Other Drug", "h", "7", []), ("None", "i", None, [])], "drug string, generic_name string, rxcui string, rxcuis array<string>")
    assert {r.key for r in ingest.label_rows(labels).collect()} == {"drug:aspirin", "drug:other_drug", "drug:none", "rxcui:5", "rxcui:7"}
    c = spark.createDataFrame([("d", "D Sodium", False, True, True, "3", "a"), ("d", "d", True, False, False, "1", "b"), ("d", "d and e", True, True, True, "9", "c")], "drug string, generic_name string, route_ok boolean, has_rx boolean, has_dose boolean, effective_time string, set_id string")
    assert [r.set_id for r in ingest.best_labels(c, ("sodium",)).collect()] == ["b"]


def test_single_flight_follows_leaders(spark):
    calls = spark.createDataFrame([("a", 0.0, 1), ("a", 8.0, 2), ("a", 15.0, 3), ("a", 24.0, 4), ("b", 9.0, 5)], "k string, at double, i long")
    got = {r.i: (r.flight, r.leader) for r in state.single_flight(calls, "k", "at", "i", 10.0).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (2, True), 4: (2, False), 5: (1, True)}


def test_citations_and_abstaining(spark):
    a = spark.createDataFrame([(1, "First thing here [S2]. Second one there [S1, S2]. Third now [S9].")], "qid long, answer string")
    e = spark.createDataFrame([(1, "S1", "one  text", "A"), (1, "S2", "two\ntext", "B")], "qid long, key string, text string, title string")
    assert [(r.nth, r.key, r.snippet) for r in answers.citations(a, e, "qid").orderBy("nth").collect()] == [(1, "S2", "two text"), (2, "S1", "one text")]
    told = one(spark, "sources disagree", lambda c: answers.abstain_text(c, F.array(F.struct(F.lit("aspirin").alias("drug"), F.lit("75 mg").alias("dose"), F.lit("100 mg").alias("noted")))))
    assert told.endswith("Reason: sources disagree. Conflicts: aspirin: record 75 mg, note 100 mg.")


# --- engine ----------------------------------------------------------------------------------------
def test_engine_end_to_end(spark):
    passages = spark.createDataFrame([("topic:asthma#a#0", "guidelines", "Asthma", "Asthma is treated with inhalers. Asthma control needs a plan for every patient."), ("topic:gerd#a#0", "guidelines", "GERD", "Reflux is treated with diet.")], "id string, namespace string, title string, text string")
    facts = spark.createDataFrame([("P0001", "f1", "condition", "P0001 has asthma, status active.")], "subject string, id string, title string, text string")
    records = spark.createDataFrame([("patient:P0001", '{"name":"A"}', None), ("meta:v", "1", None), ("gone", "x", 1.0)], "key string, value string, expires_at double")
    e = engine(spark, facts, passages, records, 100.0, TODAY)
    q = spark.createDataFrame([(1, "how is asthma treated", None)], "qid long, query string, scope string")
    asked = spark.createDataFrame([(1, "how is asthma treated", None), (2, "how is quetzalitis treated", None), (3, "what is the latest aspirin dose of P0001", None)], "qid long, query string, scope string")
    vocabulary = spark.createDataFrame([("asthma",), ("treated",)], "word string")
    meds = spark.createDataFrame([("P0001", "aspirin", "75 mg")], "subject string, drug string, dose string")
    notes = spark.createDataFrame([("P0001", "Aspirin 100 mg daily.")], "subject string, text string")
    told = {r.qid: (r.status, r.reason) for r in e.query(asked, min_score=0.1, meds=meds, notes=notes, vocabulary=vocabulary).collect()}
    assert told[1][0] == "answered" and told[2][1] in ("unknown subject", "non_clinical") and told[3][0] == "abstained" and told[3][1] in ("sources disagree", "dose without label")
    found = e.search(q.select("qid", F.col("query").alias("text")), 1).collect()
    assert [(r.qid, r.id) for r in found] == [(1, "topic:asthma#a#0")]
    src = {r.source_id: (r.namespace, r.content) for r in e.source(spark.createDataFrame([("kv:patient:P0001",), ("vec:topic:gerd#a#0",), ("kv:none",)], "source_id string")).collect()}
    assert src["kv:patient:P0001"][1] == '{"name":"A"}' and src["vec:topic:gerd#a#0"] == ("guidelines", "Reflux is treated with diet.") and src["kv:none"][1] is None
    more = e.ingest(spark.createDataFrame([("topic:copd#a#0", "guidelines", "COPD", "COPD is long.")], "id string, namespace string, title string, text string"), spark.createDataFrame([("patient:P0001", "new", None)], "key string, value string, expires_at double"))
    assert more.passages.count() == 3 and more.records.get(spark.createDataFrame([("patient:P0001",)], "key string")).first().value == "new"
    assert e.records.browse("meta:", 5).count() == 0 and e.records.scan("").count() == 2 and e.records.purge().rows.count() == 2


def test_cells_are_searched_in_blocks_without_rows_of_pairs(spark):
    from sparkloom.operators import vectors

    rng = random.Random(4)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)], "id long, embedding array<float>")
    q = v.where("id % 10 = 0").select(F.col("id").alias("qid"), "embedding")
    found = vectors.ivf_search(v, q, 5, 6, 6, lot=7)
    exact = {(r.qid, r.id, r["rank"]) for r in vectors.many_top_k(v, q, 5).collect()}
    assert {(r.qid, r.id, r["rank"]) for r in found.collect()} == exact and len(exact) == 150
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_recall_by_label_counts_labels_and_makes_no_pairs(spark):
    from sparkloom.operators import measures

    rng = random.Random(9)
    rows = spark.createDataFrame([(i, rng.choice([0, 1, 2, None])) for i in range(60)] + [(60, 9)], "id long, label long")
    asked = rows.where("id % 10 = 0").select(F.col("id").alias("qid"), "label")
    ranked = spark.createDataFrame([(q, i, n + 1) for q in range(0, 61, 10) for n, i in enumerate(rng.sample([x for x in range(61) if x != q], 10))], "qid long, id long, rank int")
    pairs = asked.join(rows, "label").where("qid <> id").select("qid", "id")
    by_label = measures.retrieval_by_label(ranked, rows, asked, "qid", "id", "label")
    assert sorted(map(tuple, by_label.collect())) == sorted(map(tuple, measures.retrieval(ranked, pairs, "qid", "id").collect()))


def test_embedder_remembers_the_hashes_of_a_word_once():
    known: dict = {}
    embed.vector(["insulin", "dose", "insulin"], 64, known)
    assert {w: (h.dtype.name, len(h)) for w, h in known.items()} == {"insulin": ("uint64", 8), "dose": ("uint64", 1)}
