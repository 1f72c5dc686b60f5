"""Lookup, evaluation, loading and telemetry queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import slug
from ..operators import answers, evaluation, fusion, ingest, lookup, measures, vectors
from .base import query, read

LABS4 = list(V.LABS)[:4]
CONDITIONS = list(V.CONDITIONS)


def _list(xs) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs) + "]"


def _at(xs, i):
    return F.get(F.array(*[F.lit(x) for x in xs]), (i % len(xs)).cast("int"))


# --- records of subjects ---------------------------------------------------------------------
def _clinic(spark, d):
    """customers and orders as a key table of subjects: header, condition, medication, labs; and reference rows of drugs and codes."""
    c, pid = F.col("c_custkey"), F.format_string("P%06d", F.col("c_custkey"))
    pre = F.concat(F.lit("patient:"), pid)
    customers = read(spark, d, "customer")
    value = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    codes = [V.CONDITIONS[k][0] for k in CONDITIONS]
    head = customers.select(pre.alias("key"), value(name=F.col("c_name")).alias("value"))
    cond = customers.select(F.concat(pre, F.lit(":condition:"), _at(codes, c)).alias("key"), value(name=_at(CONDITIONS, c), icd10=_at(codes, c)).alias("value"))
    med = customers.select(F.concat(pre, F.lit(":med:"), slug(_at(V.DRUGS, c))).alias("key"), value(drug=_at(V.DRUGS, c), status=F.when(c % 2 == 0, "active").otherwise("stopped")).alias("value"))
    o = F.col("o_orderkey")
    lab, day = _at(LABS4, o), F.date_format("o_orderdate", "yyyy-MM-dd")
    labs = read(spark, d, "orders").select(F.concat(F.format_string("patient:P%06d:lab:", F.col("o_custkey")), slug(lab), F.lit(":"), day, F.lit(":"), o.cast("string")).alias("key"), value(lab=lab, date=day, value=F.col("o_totalprice")).alias("value"))
    drugs = customers.where(c < len(V.DRUGS)).select(F.concat(F.lit("drug:"), slug(_at(V.DRUGS, c))).alias("key"), value(name=_at(V.DRUGS, c)).alias("value")).distinct()
    icd = customers.where(c < len(CONDITIONS)).select(F.concat(F.lit("icd10:"), _at(codes, c)).alias("key"), value(code=_at(codes, c), name=_at(CONDITIONS, c)).alias("value")).distinct()
    out = head
    for part in (cond, med, labs, drugs, icd):
        out = out.unionByName(part)
    return out.withColumn("expires_at", F.lit(None).cast("double"))


_SLUG = "regexp_replace({0}, '[^a-z0-9]+', '_', 'g')"
_D, _C, _K, _L = _list(V.DRUGS), _list(CONDITIONS), _list([V.CONDITIONS[k][0] for k in CONDITIONS]), _list(LABS4)
_NC, _ND = len(CONDITIONS), len(V.DRUGS)
CLINIC = f"""(SELECT 'patient:P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key, c_custkey AS c, 'demographics' AS kind, '' AS date, '' AS lab, '' AS name, '' AS drug, '' AS status FROM customer
  UNION ALL SELECT 'patient:P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ':condition:' || {_K}[c_custkey % {_NC} + 1], c_custkey, 'condition', '', '', {_C}[c_custkey % {_NC} + 1], '', '' FROM customer
  UNION ALL SELECT 'patient:P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ':med:' || {_SLUG.format(f"{_D}[c_custkey % {_ND} + 1]")}, c_custkey, 'medication', '', '', '', {_D}[c_custkey % {_ND} + 1], CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'stopped' END FROM customer
  UNION ALL SELECT 'patient:P' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || ':lab:' || {_SLUG.format(f"{_L}[o_orderkey % 4 + 1]")} || ':' || strftime(o_orderdate, '%Y-%m-%d') || ':' || o_orderkey, o_custkey, 'lab', strftime(o_orderdate, '%Y-%m-%d'), {_L}[o_orderkey % 4 + 1], '', '', '' FROM orders)"""


def _asked(spark, d):
    """One question per customer; what it names is chosen by its number."""
    c = F.col("c_custkey")
    some = lambda test, xs: F.when(test, F.array(xs)).otherwise(F.array().cast("array<string>"))
    return read(spark, d, "customer").select(
        c.alias("qid"), F.when(c % 5 < 4, F.format_string("P%06d", c)).alias("scope"), some(c % 7 == 0, _at([V.CONDITIONS[k][0] for k in CONDITIONS], c + 1)).alias("icd10_codes"), some(c < 0, F.lit("")).alias("rxnorm_codes"),
        some(c % 3 == 0, _at(V.DRUGS, c)).alias("drugs"), some(c % 2 == 0, _at(LABS4, c)).alias("labs"), some(c % 4 == 1, _at(CONDITIONS, c)).alias("conditions"), some(c % 11 == 0, F.lit("labs")).alias("record_types"),
        F.when(c % 6 == 0, "1995-01-01").alias("start"), F.when(c % 6 == 0, "1996-12-31").alias("stop"), (c % 6 == 2).alias("latest_only"),
    )


@query(
    "entity_records",
    f"""WITH kv AS (SELECT *, row_number() OVER (PARTITION BY c, kind, lab ORDER BY date DESC, key DESC) AS nth FROM {CLINIC}),
    own AS (SELECT c AS qid, key, CASE WHEN kind = 'lab' AND c % 2 = 0 AND lab = {_L}[c % 4 + 1] AND CASE WHEN c % 6 = 2 THEN nth = 1 WHEN c % 6 = 0 THEN date BETWEEN '1995-01-01' AND '1996-12-31' ELSE nth <= 3 END THEN 4
        WHEN kind = 'medication' AND c % 3 = 0 THEN 5 WHEN kind = 'condition' AND c % 4 = 1 THEN 6 WHEN c % 11 = 0 AND kind = 'lab' AND nth = 1 THEN 7
        WHEN c % 2 <> 0 AND c % 3 <> 0 AND c % 4 <> 1 AND c % 11 <> 0 AND (kind IN ('demographics', 'condition') OR (kind = 'medication' AND status = 'active')) THEN 8 END AS step,
        CASE kind WHEN 'demographics' THEN 1 WHEN 'condition' THEN 2 WHEN 'medication' THEN 3 ELSE 5 END AS a, date FROM kv WHERE c % 5 < 4),
    refs AS (SELECT c_custkey AS qid, 'icd10:' || {_K}[(c_custkey + 1) % {_NC} + 1] AS key, 1 AS step FROM customer WHERE c_custkey % 7 = 0
      UNION ALL SELECT c_custkey, 'drug:' || {_SLUG.format(f"{_D}[c_custkey % {_ND} + 1]")}, CASE WHEN c_custkey % 5 < 4 THEN 5 ELSE 3 END FROM customer WHERE c_custkey % 3 = 0),
    known AS (SELECT DISTINCT 'icd10:' || {_K}[c_custkey % {_NC} + 1] AS key FROM customer WHERE c_custkey < {_NC} UNION SELECT DISTINCT 'drug:' || {_SLUG.format(f"{_D}[c_custkey % {_ND} + 1]")} FROM customer WHERE c_custkey < {_ND}),
    u AS (SELECT qid, key, step, a, date, 0 AS b FROM own WHERE step IS NOT NULL UNION ALL SELECT qid, key, step, 0, '', 1 FROM refs JOIN known USING (key))
    SELECT qid, key, CAST(row_number() OVER (PARTITION BY qid ORDER BY step, CASE WHEN step IN (7, 8) THEN a ELSE 0 END, b, CASE WHEN step IN (4, 7) THEN date END DESC, key) AS INTEGER) AS seq FROM u QUALIFY seq <= 24""",
)
def entity_records(spark, d):
    return lookup.records_for(_asked(spark, d), _clinic(spark, d))


@query("subject_records", f"SELECT key, kind FROM {CLINIC} WHERE c = 7 AND kind IN ('demographics', 'medication', 'lab')")
def subject_records(spark, d):
    rows = lookup.of_subject(_clinic(spark, d), "P000007", ["demographics", "medication", "lab"])
    return lookup.with_record(rows).select("key", "kind")


@query("summary_search", f"SELECT c_custkey FROM customer WHERE contains(lower('P' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ' ' || c_name || ' ' || {_C}[c_custkey % {_NC} + 1]), 'migraine') ORDER BY c_custkey LIMIT 20")
def summary_search(spark, d):
    c = F.col("c_custkey")
    subjects = read(spark, d, "customer").select("c_custkey", F.format_string("P%06d", c).alias("patient_id"), F.col("c_name").alias("name"), F.array(_at(CONDITIONS, c)).alias("conditions"))
    return lookup.search_summaries(subjects, "Migraine", 20).select("c_custkey")


@query(
    "namespace_filter",
    """SELECT doc_id, item_id FROM (SELECT doc_id, lang, source, doc_id % 28 + 20240101 AS day FROM documents) d JOIN (SELECT item_id, item_id % 3 AS k FROM benchmark WHERE item_id % 5 = 0) q
    ON CASE lang WHEN 'en' THEN k <> 0 OR source = 'src' || item_id % 20 WHEN 'de' THEN day BETWEEN 20240101 + k AND 20240110 ELSE true END""",
)
def namespace_filter(spark, d):
    space = F.when(F.col("lang") == "en", "drug_labels").when(F.col("lang") == "de", "patient_notes").otherwise("guidelines")
    docs = read(spark, d, "documents").select("doc_id", space.alias("space"), "source", (F.col("doc_id") % 28 + 20240101).alias("day"))
    k = F.col("item_id") % 3
    q = read(spark, d, "benchmark").where("item_id % 5 = 0").select("item_id", F.when(k == 0, F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))).otherwise(F.array().cast("array<string>")).alias("drugs"), (20240101 + k).alias("start"))
    fits = lookup.namespace_predicate(F.col("space"), F.col("source"), F.col("day"), F.col("drugs"), F.col("start"), F.lit(20240110))
    return docs.join(q, fits).select("doc_id", "item_id")


@query("flat_metadata", "SELECT doc_id, CAST(doc_id AS VARCHAR) || '#' || lang AS chunk_id, source AS title, 'x' AS extra FROM documents")
def flat_metadata(spark, d):
    docs = read(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    chunks = docs.select("doc_id", F.concat(i, F.lit("#"), "lang").alias("chunk_id"), F.col("lang").alias("section"), F.col("source").alias("title"), F.lit(None).cast("string").alias("patient_id"), F.create_map(F.lit("title"), F.lit("old"), F.lit("extra"), F.lit("x")).alias("metadata"))
    flat = lookup.flat_metadata(chunks)
    m = F.col("metadata")
    return flat.select(m["doc_id"].cast("long").alias("doc_id"), "chunk_id", m["title"].alias("title"), m["extra"].alias("extra"))


@query(
    "source_dispatch",
    """SELECT source_id, kind, CASE WHEN kind = 'vec' THEN CASE n WHEN 0 THEN 'patient_notes' WHEN 1 THEN 'drug_labels' ELSE 'guidelines' END END AS namespace, digest FROM (
    SELECT CASE k WHEN 0 THEN 'vec:' || ['note', 'label', 'topic'][doc_id % 3 + 1] || ':' || doc_id || '#part#' || doc_id % 4 WHEN 1 THEN 'vec:note:x' || doc_id || '#a' ELSE 'web:' || doc_id END AS source_id, CASE WHEN k < 2 THEN 'vec' ELSE 'unknown' END AS kind,
      CASE k WHEN 0 THEN doc_id % 3 ELSE 0 END AS n, CASE WHEN k = 0 THEN sha256(text) END AS digest FROM documents, range(3) r(k)
    UNION ALL SELECT 'kv:c:' || c_custkey, 'kv', 0, sha256(c_name) FROM customer)""",
)
def source_dispatch(spark, d):
    i = F.col("doc_id").cast("string")
    known = F.concat(_at(["note", "label", "topic"], F.col("doc_id")), F.lit(":"), i)
    docs = read(spark, d, "documents").select(known.alias("doc_id"), "text", i.alias("i"), (F.col("doc_id") % 4).cast("string").alias("part"))
    kv = read(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"))
    c = F.concat
    ids = docs.select(F.explode(F.array(c(F.lit("vec:"), "doc_id", F.lit("#part#"), "part"), c(F.lit("vec:note:x"), "i", F.lit("#a")), c(F.lit("web:"), "i"))).alias("source_id"))
    asked = ids.unionByName(kv.select(c(F.lit("kv:"), "key").alias("source_id")))
    return lookup.resolve_sources(asked, kv, docs).select("source_id", "kind", "namespace", F.sha2("content", 256).alias("digest"))


@query("subject_documents", "SELECT doc_id FROM documents WHERE source = 'src1'")
def subject_documents(spark, d):
    docs = read(spark, d, "documents").select(F.concat(F.lit("note:"), "source", F.lit(":"), F.col("doc_id").cast("string")).alias("doc_id"))
    return lookup.documents_of(docs, "src1").select(F.substring_index("doc_id", ":", -1).cast("long").alias("doc_id"))


# --- evaluation --------------------------------------------------------------------------------
_DOT = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(
    "source_retrieval_scores",
    f"""WITH r AS (SELECT q.vec_id AS id, q.label AS ql, e.vec_id, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY rank <= 10),
    x AS (SELECT id, min(rank) FILTER (WHERE label = ql AND vec_id % 2 = 0) AS a, min(rank) FILTER (WHERE vec_id % 2 = 1 AND vec_id BETWEEN 100 AND 199) AS b FROM r GROUP BY 1)
    SELECT id, round(coalesce(1.0 / least(a, b), 0.0), 6) AS rr, {", ".join(f"round((CASE WHEN a <= {k} THEN 1 ELSE 0 END + CASE WHEN b <= {k} THEN 1 ELSE 0 END) / 2.0, 6) AS recall_{k}" for k in evaluation.KS)} FROM x""",
)
def source_retrieval_scores(spark, d):
    """Even vectors are chunks of a document named by their label, odd ones keys; a question expects its label's document and a key prefix."""
    e = read(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), "embedding")
    top = vectors.many_top_k(e, q, 10, "vec_id", "id").join(e.select("vec_id", "label"), "vec_id")
    i = F.col("vec_id").cast("string")
    source = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("vec:d"), F.col("label").cast("string"), F.lit("#"), i)).otherwise(F.concat(F.lit("kv:"), F.lpad(i, 9, "0"), F.lit(":x")))
    labels = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.explode(F.array(F.concat(F.lit("doc:d"), F.col("label").cast("string")), F.lit("kv:0000001"))).alias("expected"))
    return evaluation.retrieval_scores(labels, top.select("id", source.alias("source"), "rank"), "id")


def _runs(spark, d):
    """(gold, responses, replay): labelled documents with what a rule on symbols and length says of them."""
    j = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")
    n = F.length("text")
    good = F.regexp_count("text", F.lit("[#$%&*|!]")) * 20 < n
    want = F.when(F.col("toxic") == 1, "red_flag").when(F.col("quality") == 1, "answered").otherwise("abstained")
    got = F.when(n % 13 == 0, "red_flag").when(good, "answered").otherwise("abstained")
    gold = j.select(F.col("doc_id").alias("id"), F.when(F.col("lang") != "es", F.when(F.col("lang") == "en", "KV").when(F.col("lang") == "de", "VECTOR").otherwise("HYBRID")).alias("expected_route"), want.alias("expected_status"), F.when(F.col("doc_id") % 9 == 0, F.lit(1)).alias("paraphrase_of"))
    g = (n % 101) / 100
    cache = F.when(n % 4 == 0, "exact").when(n % 4 == 1, "semantic").otherwise("miss")
    made = j.select(F.col("doc_id").alias("id"), _at(["KV", "VECTOR", "HYBRID"], n).alias("route"), got.alias("status"), cache.alias("cache"), (n / 10).alias("total_ms"), F.when(got == "answered", g).alias("grounding"), (g >= 0.5).alias("passed"), (n % 50 == 0).cast("int").alias("leaks"))
    return gold, made, made.where("id % 2 = 0")


_RUNS = """r AS (SELECT doc_id, CASE WHEN lang <> 'es' THEN CASE lang WHEN 'en' THEN 'KV' WHEN 'de' THEN 'VECTOR' ELSE 'HYBRID' END END AS er, CASE WHEN toxic = 1 THEN 'red_flag' WHEN quality = 1 THEN 'answered' ELSE 'abstained' END AS es,
    ['KV', 'VECTOR', 'HYBRID'][length(text) % 3 + 1] AS route, CASE WHEN length(text) % 13 = 0 THEN 'red_flag' WHEN len(regexp_extract_all(text, '[#$%&*|!]')) * 20 < length(text) THEN 'answered' ELSE 'abstained' END AS status,
    CASE length(text) % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' ELSE 'miss' END AS cache, (length(text) % 101) / 100.0 AS g, length(text) % 50 = 0 AS leak FROM labels JOIN documents USING (doc_id))"""


def _rate(hit: str, of: str, empty: str) -> str:
    return f"coalesce(round(count(*) FILTER (WHERE ({hit}) AND ({of})) / nullif(CAST(count(*) FILTER (WHERE {of}) AS DOUBLE), 0), 4), {empty})"


_CARD = {
    ("answers", "answered"): "count(*) FILTER (WHERE status = 'answered')", ("answers", "abstained"): "count(*) FILTER (WHERE status = 'abstained')",
    ("answers", "faithfulness"): _rate("g >= 0.5", "status = 'answered'", "0.0"), ("answers", "grounding_rate_mean"): "coalesce(round(avg(g) FILTER (WHERE status = 'answered'), 4), 0.0)",
    ("abstention", "accuracy"): _rate("(es = 'abstained') = (status = 'abstained')", "es IN ('answered', 'abstained')", "0.0"), ("abstention", "precision"): _rate("es = 'abstained'", "es IN ('answered', 'abstained') AND status = 'abstained'", "1.0"),
    ("abstention", "recall"): _rate("status = 'abstained'", "es = 'abstained'", "1.0"), ("safety", "red_flag_n"): "count(*) FILTER (WHERE es = 'red_flag')", ("safety", "red_flag_recall"): _rate("status = 'red_flag'", "es = 'red_flag'", "1.0"),
    ("safety", "red_flag_precision"): _rate("es = 'red_flag'", "status = 'red_flag'", "1.0"), ("safety", "scope_violation_recall"): "1.0", ("safety", "out_of_scope_recall"): "1.0", ("safety", "scope_leaks"): "count(*) FILTER (WHERE leak)",
    ("status", "accuracy"): _rate("es = status", "true", "0.0"), ("router", "accuracy"): _rate("er = route", "er IS NOT NULL", "0.0"), ("cache", "paraphrase_items"): "count(*) FILTER (WHERE doc_id % 9 = 0)",
    ("cache", "semantic_hits"): "count(*) FILTER (WHERE cache = 'semantic')", ("cache", "paraphrase_semantic_hits"): "count(*) FILTER (WHERE cache = 'semantic' AND doc_id % 9 = 0)",
    ("cache", "replayed"): "count(*) FILTER (WHERE doc_id % 2 = 0)", ("cache", "hit_rate"): _rate("cache <> 'miss'", "doc_id % 2 = 0", "0.0"), ("cache", "exact_hits"): "count(*) FILTER (WHERE doc_id % 2 = 0 AND cache = 'exact')",
}
_F1 = """(WITH c AS (SELECT l, count(*) FILTER (WHERE er = l) AS s, count(*) FILTER (WHERE route = l) AS p, count(*) FILTER (WHERE er = l AND route = l) AS t FROM r, (VALUES ('KV'), ('VECTOR'), ('HYBRID')) v(l) WHERE er IS NOT NULL GROUP BY 1)
    SELECT round(avg(round(CASE WHEN t > 0 THEN 2.0 * t / (s + p) ELSE 0.0 END, 6)), 4) FROM c WHERE s > 0)"""
SCORECARD = f"""WITH {_RUNS}, a AS (SELECT {", ".join(f"CAST({v} AS DOUBLE) AS v{i}" for i, v in enumerate(_CARD.values()))} FROM r)
    {" UNION ALL ".join(f"SELECT '{b}' AS block, '{m}' AS metric, v{i} AS value FROM a" for i, (b, m) in enumerate(_CARD))} UNION ALL SELECT 'router', 'macro_f1', CAST({_F1} AS DOUBLE)"""


@query("scorecard", SCORECARD)
def scorecard(spark, d):
    return evaluation.scorecard(*_runs(spark, d))


@query(
    "ablation",
    f"""WITH {_RUNS}, c AS (SELECT 'plain' AS config, * FROM r UNION ALL SELECT 'cautious', * REPLACE (CASE WHEN g < 0.5 THEN 'abstained' ELSE status END AS status) FROM r)
    SELECT config, {_CARD["status", "accuracy"]} AS status_accuracy, {_CARD["abstention", "recall"]} AS abstention_recall, {_CARD["answers", "faithfulness"]} AS answers_faithfulness FROM c GROUP BY 1""",
)
def ablation(spark, d):
    gold, made, replay = _runs(spark, d)
    g = F.coalesce("grounding", F.lit(1.0)) < 0.5
    cautious = made.withColumn("status", F.when(g & (F.col("status") == "answered"), "abstained").otherwise(F.col("status")))
    red = F.col("status") == "red_flag"
    cautious = made.withColumn("low", ~F.col("passed")).withColumn("status", F.when(F.col("low"), "abstained").otherwise(F.col("status"))).drop("low")
    cautious = cautious.withColumn("grounding", F.when(F.col("status") == "answered", F.col("grounding")))
    del red
    runs = {"plain": evaluation.scorecard(gold, made, replay), "cautious": evaluation.scorecard(gold, cautious, replay)}
    return evaluation.ablation(runs, [("status", "accuracy"), ("abstention", "recall"), ("answers", "faithfulness")])


@query("noop_rerank", f"SELECT vec_id, CAST(row_number() OVER (ORDER BY {_DOT} DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q QUALIFY rank <= 8")
def noop_rerank(spark, d):
    e = read(spark, d, "embeddings")
    rows = vectors.many_top_k(e, e.where("vec_id = 5").select(F.lit(0).alias("qid"), "embedding"), 24, "vec_id")
    return fusion.keep_order(rows, "qid", 8).select("vec_id", "rank")


@query("filtered_index_topk", f"SELECT q.vec_id AS qid, e.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.label IN (1, 2) AND e.vec_id % 3 = 0 QUALIFY rank <= 10".replace("e.vec_id % 3 = 0", "e.third = 0").replace("FROM embeddings e,", "FROM (SELECT *, vec_id % 3 AS third FROM embeddings) e,"))
def filtered_index_topk(spark, d):
    """Few rows pass the filter, so many questions are short of ten after over-fetching and are searched exactly."""
    e = read(spark, d, "embeddings").withColumn("third", (F.col("vec_id") % 3).cast("int"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return vectors.filtered_search(e, q, 10, {"$and": [{"label": {"$in": [1, 2]}}, {"third": 0}]}, cells=4, probes=4, key="vec_id").select("qid", "vec_id", "rank")


@query(
    "latency_map",
    "SELECT user_id, array_to_string(list(event_type || '=' || CAST(CAST(round(ms * 1000) AS BIGINT) AS VARCHAR) ORDER BY event_type), ',') AS told FROM (SELECT user_id, event_type, round(sum(value), 3) AS ms FROM events GROUP BY 1, 2) GROUP BY 1",
)
def latency_map(spark, d):
    spans = read(spark, d, "events").select("user_id", F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    told = F.transform(F.map_entries("latency"), lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 1000).cast("long").cast("string")))
    return evaluation.latency_map(spans, "user_id").select("user_id", F.array_join(told, ",").alias("told"))


@query(
    "metrics_snapshot",
    """WITH q AS (SELECT user_id % 3 AS route, user_id % 2 AS cache, coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0) AS kv, coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) AS vector, sum(value) AS total FROM events GROUP BY user_id),
    x AS (SELECT 'route' AS part, 'r' || route AS name, total AS ms FROM q UNION ALL SELECT 'cache', 'c' || cache, total FROM q UNION ALL SELECT 'retrieval', 'r' || route, kv + vector FROM q UNION ALL SELECT 'stage', 'kv', kv FROM q UNION ALL SELECT 'stage', 'vector', vector FROM q)
    SELECT part, name, count(*) AS n, round(avg(ms), 3) AS mean, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95, round(quantile_cont(ms, 0.99), 3) AS p99 FROM x GROUP BY 1, 2""",
)
def metrics_snapshot(spark, d):
    total = lambda t: F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("value"))), F.lit(0.0))
    q = read(spark, d, "events").groupBy("user_id").agg(F.create_map(F.lit("kv"), total("view"), F.lit("vector"), total("click")).alias("stages"), F.sum("value").alias("total_ms"))
    named = q.select("stages", "total_ms", F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("route"), F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string")).alias("cache"))
    return evaluation.snapshot(named)


@query(
    "abstain_text",
    "SELECT o_orderkey, '" + V.ABSTAIN + "' || ' Reason: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'sources disagree' ELSE 'nothing retrieved' END || '.' || CASE WHEN o_orderkey % 3 = 0 THEN ' Conflicts: ' || o_orderpriority || ': record 500 mg, note 750 mg.' ELSE '' END AS told FROM orders",
)
def abstain_text(spark, d):
    hit = F.col("o_orderkey") % 3 == 0
    one = F.array(F.struct(F.col("o_orderpriority").alias("drug"), F.lit("500 mg").alias("dose"), F.lit("750 mg").alias("noted")))
    told = answers.abstain_text(F.when(hit, "sources disagree").otherwise("nothing retrieved"), F.filter(one, lambda c: hit))
    return read(spark, d, "orders").select("o_orderkey", told.alias("told"))


# --- loading -----------------------------------------------------------------------------------
@query(
    "ingest_key_rows",
    r"""SELECT 'icd10:N' || n_nationkey AS key, sha256('{"code":"N' || n_nationkey || '","name":"' || n_name || '"}') AS digest FROM nation
    UNION ALL SELECT 'drug:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || p_partkey, sha256('{"generic_name":"' || p_type || '","name":"' || p_name || ' ' || p_partkey || '"' || coalesce(',"rxcui":"' || rx || '"', '') || '}') FROM p
    UNION ALL SELECT 'rxcui:' || rx, sha256('{"generic_name":"' || p_type || '","name":"' || p_name || ' ' || p_partkey || '","rxcui":"' || rx || '"}') FROM p WHERE rx IS NOT NULL""".replace(" FROM p WHERE", " FROM {P} WHERE").replace("|| '}') FROM p\n", "|| '}') FROM {P}\n").replace("{P}", "(SELECT *, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 3 = 1 THEN CAST(p_partkey * 10 AS VARCHAR) END AS rx FROM part)"),
)
def ingest_key_rows(spark, d):
    codes = read(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"))
    k = F.col("p_partkey")
    labels = read(spark, d, "part").select(F.concat_ws(" ", "p_name", k.cast("string")).alias("drug"), F.col("p_type").alias("generic_name"), F.when(k % 3 == 0, k.cast("string")).otherwise("").alias("rxcui"), F.when(k % 3 == 1, F.array((k * 10).cast("string"))).otherwise(F.array().cast("array<string>")).alias("rxcuis"))
    return ingest.icd_rows(codes).unionByName(ingest.label_rows(labels)).select("key", F.sha2("value", 256).alias("digest"))


@query("ingest_note_rows", "SELECT 'doc:note:' || source || ':' || doc_id AS key, 1 AS n FROM documents UNION ALL SELECT 'meta:notes:' || source, count(*) FROM documents GROUP BY source")
def ingest_note_rows(spark, d):
    notes = read(spark, d, "documents").select("doc_id", F.col("source").alias("patient_id"), F.col("lang").alias("title"), "text")
    return ingest.note_rows(notes).select("key", F.coalesce(F.get_json_object("value", "$.n").cast("long"), F.lit(1)).alias("n"))


@query(
    "label_choice",
    """SELECT p_brand AS drug, p_partkey FROM part WHERE p_size % 3 > 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 2 = 0 DESC, p_partkey % 5 = 0 DESC, p_partkey % 7 = 0 DESC, p_retailprice DESC, lpad(CAST(p_partkey AS VARCHAR), 12, '0')) = 1""",
)
def label_choice(spark, d):
    """Labels of other generic names (a third of them here) are no candidates; salt words do not count."""
    k = F.col("p_partkey")
    generic = F.when(F.col("p_size") % 3 > 0, F.concat("p_brand", F.lit(", Hydrochloride"))).otherwise(F.concat("p_brand", F.lit(" and another")))
    c = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("drug"), generic.alias("generic_name"), (F.col("p_size") % 2 == 0).alias("route_ok"), (k % 5 == 0).alias("has_rx"), (k % 7 == 0).alias("has_dose"), F.col("p_retailprice").alias("effective_time"), F.lpad(k.cast("string"), 12, "0").alias("set_id"))
    return ingest.best_labels(c, ("hydrochloride", "sodium")).select("drug", "p_partkey")


@query("first_identifiers", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS rxcui FROM part")
def first_identifiers(spark, d):
    answer = F.when(F.col("p_size") % 2 == 0, F.format_string('{"idGroup":{"rxnormId":["%d","9"]}}', "p_partkey")).otherwise('{"idGroup":{}}')
    return read(spark, d, "part").select("p_partkey", ingest.first_identifier(answer).alias("rxcui"))


def _fingerprint_sql(rows: str) -> str:
    levels = f"l AS (SELECT sha256(d) AS h FROM {rows}), l9 AS (SELECT h AS p, h FROM l)"
    last = "l9"
    for n in ingest.FINGERPRINT_LEVELS:
        levels += f", l{n} AS (SELECT substr(p, 1, {n}) AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM {last} GROUP BY 1)"
        last = f"l{n}"
    return f"WITH {levels} SELECT substr(sha256(h || '|hashing|120'), 1, 24) AS fingerprint FROM {last}"


@query("input_fingerprint", _fingerprint_sql("(SELECT CAST(doc_id AS VARCHAR) || '=' || sha256(coalesce(text, '')) AS d FROM documents)"))
def input_fingerprint(spark, d):
    listed = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return ingest.fingerprint_row(listed, "name", "digest", "hashing", "120")


@query("embed_upsert", "SELECT vec_id AS id, vec_id % 3 = 0 AS fresh FROM embeddings UNION SELECT doc_id, true FROM documents WHERE doc_id % 3 = 0 OR doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embed_upsert(spark, d):
    """Documents are embedded and put into the vector table in place of the rows of their id."""
    from ..functions.embed import hashing_embedding

    e, docs = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    put = docs.where("id % 3 = 0").unionByName(docs.join(e, "id", "left_anti").where("id % 3 <> 0"))
    more = e.where("id % 3 = 0").join(docs, "id", "left_anti").select("id", F.lit("late").alias("text"))
    t = ingest.embed_upsert(e, put.unionByName(more), lambda x: hashing_embedding(x, "id", "text", 64))
    fresh = t.join(put.unionByName(more).select("id", F.lit(True).alias("f")), "id", "left")
    return fresh.select("id", F.coalesce("f", F.lit(False)).alias("fresh"))


@query("manifest_counts", "SELECT o_orderpriority AS kind, count(*) AS n, CAST(sum(lines) AS BIGINT) AS items FROM orders JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def manifest_counts(spark, d):
    nested = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("lines"))
    return measures.nested_counts(read(spark, d, "orders").join(nested, "o_orderkey"), F.col("o_orderpriority"), "lines")


@query("condition_names", f"SELECT c_custkey, {_C}[c_custkey % {_NC} + 1] AS name FROM customer")
def condition_names(spark, d):
    """Every condition code finds its name; one without a name would be an error."""
    codes = [V.CONDITIONS[k][0] for k in CONDITIONS]
    c = F.col("c_custkey")
    rows = read(spark, d, "customer")
    names = rows.where(c < len(CONDITIONS)).select(_at(codes, c).alias("code"), _at(CONDITIONS, c).alias("name")).unionByName(rows.where(c == len(CONDITIONS)).select(_at(codes, c).alias("code"), _at(CONDITIONS, c).alias("name"))).distinct()
    return measures.joined_strictly(rows.select("c_custkey", _at(codes, c).alias("code")), names, "code", "name").select("c_custkey", "name")
