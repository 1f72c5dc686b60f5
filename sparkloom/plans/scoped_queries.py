"""Retrieval in which every question has a filter of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import slug
from ..operators import lifecycle, scoped
from .base import query, read, spread
from .language_queries import _NAMES, _SIG2, TODAY, _flag_sql, _questions, sql_text
from .retrieval_queries import ASK_TOKENS, DOC_TOKENS, DOT

SPACES = ("guidelines", "patient_notes", "drug_labels")
DRUGS = ("apixaban", "metformin", "warfarin", "lisinopril")


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _pick(xs, n) -> F.Column:
    return F.get(F.array(*[F.lit(x) for x in xs]), (n % len(xs)).cast("int"))


def _meta(n, subjects: int) -> dict:
    """Namespace, subject, drug and date of a row with this number; one guideline in 97 is filed under a subject, by mistake."""
    space = _pick(SPACES, n)
    return {
        "namespace": space, "owner": F.when((space == "patient_notes") | (n % 97 == 0), F.format_string("P%04d", (F.floor(n / 3) % subjects).cast("int"))),
        "drug": F.when(space == "drug_labels", _pick(DRUGS, F.floor(n / 7).cast("long"))), "date_num": F.when(space == "patient_notes", 20200101 + (n % 6) * 10000 + F.floor(n / 11) % 28),
    }


def _meta_sql(n: str, subjects: int) -> str:
    return f"""{_list(SPACES)}[{n} % 3 + 1] AS namespace, CASE WHEN {n} % 3 = 1 OR {n} % 97 = 0 THEN printf('P%04d', {n} // 3 % {subjects}) END AS owner,
      CASE WHEN {n} % 3 = 2 THEN {_list(DRUGS)}[{n} // 7 % 4 + 1] END AS drug, CASE WHEN {n} % 3 = 1 THEN 20200101 + {n} % 6 * 10000 + {n} // 11 % 28 END AS date_num"""


def _asked(n, subjects: int) -> dict:
    """Scope, namespaces, drugs and dates of question number n: one in five has no subject, one in three names a drug, one in four a range."""
    return {
        "scope": F.when(n % 5 > 0, F.format_string("P%04d", (n % subjects).cast("int"))), "namespaces": F.when(n % 7 == 0, F.array(F.lit("patient_notes"))).otherwise(F.array(*[F.lit(x) for x in SPACES])),
        "drugs": F.when(n % 3 == 0, F.array(_pick(DRUGS, n), F.lit("warfarin"))).otherwise(F.array().cast("array<string>")), "start": F.when(n % 4 == 0, 20220101), "stop": F.when(n % 8 == 0, 20241231),
    }


def _asked_sql(n: str, subjects: int) -> str:
    return f"""CASE WHEN {n} % 5 > 0 THEN printf('P%04d', {n} % {subjects}) END AS scope, CASE WHEN {n} % 7 = 0 THEN ['patient_notes'] ELSE {_list(SPACES)} END AS spaces,
      CASE WHEN {n} % 3 = 0 THEN [{_list(DRUGS)}[{n} % 4 + 1], 'warfarin'] END AS drugs, CASE WHEN {n} % 4 = 0 THEN 20220101 ELSE 0 END AS start, CASE WHEN {n} % 8 = 0 THEN 20241231 ELSE 99999999 END AS stop"""


MAY = """list_contains(q.spaces, e.namespace) AND CASE e.namespace WHEN 'patient_notes' THEN e.owner = q.scope AND e.date_num BETWEEN q.start AND q.stop WHEN 'drug_labels' THEN q.drugs IS NULL OR list_contains(q.drugs, e.drug) ELSE true END"""


def _vectors(spark, d):
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label", *[c.alias(n) for n, c in _meta(F.col("vec_id"), 5).items()])


def _vector_questions(spark, d):
    e = read(spark, d, "embeddings").where("vec_id % 20 = 0")
    n = F.floor(F.col("vec_id") / 20).cast("long")
    return e.select(F.col("vec_id").alias("qid"), "embedding", *[c.alias(k) for k, c in _asked(n, 5).items()], F.when(n % 6 == 1, "low").when(n % 6 == 2, "some").alias("filter"))


_E = f"(SELECT vec_id, embedding, label, {_meta_sql('vec_id', 5)} FROM embeddings)"
_Q = f"(SELECT vec_id AS qid, embedding, vec_id // 20 % 6 AS f, {_asked_sql('(vec_id // 20)', 5)} FROM embeddings WHERE vec_id % 20 = 0)"


@query(
    "scoped_dense",
    f"""SELECT q.qid, e.namespace, e.vec_id AS id, {DOT} AS score, CAST(row_number() OVER (PARTITION BY q.qid, e.namespace ORDER BY round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) DESC, e.vec_id) AS INTEGER) AS rank
    FROM {_Q} q, {_E} e WHERE {MAY} AND CASE q.f WHEN 1 THEN e.label < 4 WHEN 2 THEN e.label IN (2, 5, 7) AND e.vec_id >= 40 ELSE true END QUALIFY rank <= 8""",
)
def scoped_dense(spark, d):
    """Every question sees its own subject's notes in its own range, the labels of its own drugs, and passes a filter of its own."""
    filters = {"low": {"label": {"$lt": 4}}, "some": {"$and": [{"label": {"$in": [2, 5, 7]}}, {"id": {"$gte": 40}}]}}
    jobs = scoped.jobs_of(_vector_questions(spark, d))
    return scoped.dense(_vectors(spark, d), jobs, 8, filters=filters).select("qid", "namespace", "id", F.round("score", 6).alias("score"), "rank")


_NUM = "CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])"


@query(
    "scope_report",
    f"""WITH h AS (SELECT q.qid, q.scope, e.owner FROM {_Q} q, {_E} e WHERE {MAY} QUALIFY row_number() OVER (PARTITION BY q.qid, e.namespace ORDER BY round(list_dot_product({_NUM}), 9) DESC, e.vec_id) <= 24)
    SELECT q.qid, array_to_string(list_sort(list_filter(q.spaces, lambda s: s <> 'patient_notes' OR q.scope IS NOT NULL)), '|') AS searched, CASE WHEN q.scope IS NULL THEN 'patient_notes' ELSE '' END AS skipped,
      count(*) FILTER (WHERE h.qid IS NOT NULL AND (h.owner IS NULL OR h.owner IS NOT DISTINCT FROM h.scope)) AS candidates, count(*) FILTER (WHERE h.owner IS NOT NULL AND h.owner IS DISTINCT FROM h.scope) AS blocked
    FROM {_Q} q LEFT JOIN h USING (qid) GROUP BY q.qid, q.spaces, q.scope""",
)
def scope_report(spark, d):
    """What was searched, what was skipped for want of a subject, and how many rows of other subjects were taken out again."""
    q = _vector_questions(spark, d).drop("filter").withColumn("text", F.lit(""))
    rows = _vectors(spark, d).withColumns({"title": F.lit(""), "text": F.lit("")})
    report = scoped.retrieve(q, rows, hybrid=False)[1]
    return report.select("qid", F.array_join("searched", "|").alias("searched"), F.array_join("skipped", "|").alias("skipped"), "candidates", "blocked")


_D = f"(SELECT doc_id, {_meta_sql('doc_id', 20)} FROM documents)"


@query(
    "scoped_words",
    f"""WITH e AS {_D}, q AS (SELECT item_id AS qid, {_asked_sql('item_id', 20)} FROM benchmark), t AS (SELECT doc_id, term, count(*) AS tf FROM {DOC_TOKENS} GROUP BY ALL),
    l AS (SELECT doc_id, namespace, CAST(coalesce(sum(tf), 0) AS DOUBLE) AS len FROM e LEFT JOIN t USING (doc_id) GROUP BY ALL), s AS (SELECT namespace, count(*) AS n, avg(len) AS avgdl FROM l GROUP BY 1),
    df AS (SELECT namespace, term, count(*) AS df FROM t JOIN e USING (doc_id) GROUP BY ALL), a AS (SELECT item_id AS qid, term, count(*) AS times FROM {ASK_TOKENS} GROUP BY ALL),
    r AS (SELECT qid, e.namespace, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score
      FROM a JOIN q USING (qid) JOIN t USING (term) JOIN e USING (doc_id) JOIN l USING (doc_id) JOIN s ON s.namespace = e.namespace JOIN df ON df.namespace = e.namespace AND df.term = t.term WHERE {MAY} GROUP BY ALL)
    SELECT qid, namespace, doc_id AS id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid, namespace ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 5""",
)
def scoped_words(spark, d):
    """BM25 under each question's own filter, with the statistics of whole namespaces."""
    n = F.col("item_id")
    jobs = scoped.jobs_of(read(spark, d, "benchmark").select(n.alias("qid"), "text", *[c.alias(k) for k, c in _asked(n, 20).items()]))
    docs = spread(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", *[c.alias(k) for k, c in _meta(F.col("doc_id"), 20).items()]))
    return scoped.words(docs, jobs, 5).select("qid", "namespace", "id", F.round("score", 6).alias("score"), "rank")


# --- the whole lifecycle -------------------------------------------------------------------------------
def clinic_records(spark, d):
    """Customers and their orders as the records of fifty subjects: a header, a medication and a condition of each customer, a lab of each order."""
    c, labs = F.col("c_custkey"), list(V.LABS)
    pid = F.format_string("P%04d", (c % 50).cast("int"))
    value = lambda **kw: F.to_json(F.struct(*[v.alias(k) for k, v in kw.items()]))
    key = lambda *parts: F.concat_ws(":", F.lit("patient"), *parts)
    customers = read(spark, d, "customer")
    med, cond = _pick(V.DRUGS, c), _pick(list(V.CONDITIONS), c)
    out = customers.groupBy(key(pid).alias("key")).agg(F.min(value(name=F.col("c_name"))).alias("value"))
    out = out.unionByName(customers.select(key(pid, F.lit("med"), slug(med)).alias("key"), value(drug=med, status=F.lit("active"), dose=F.lit("5 mg")).alias("value")))
    out = out.unionByName(customers.select(key(pid, F.lit("condition"), slug(cond)).alias("key"), value(key=cond, name=cond).alias("value")))
    o, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    lab = _pick(labs, o)
    who = F.format_string("P%04d", (F.col("o_custkey") % 50).cast("int"))
    out = out.unionByName(read(spark, d, "orders").select(key(who, F.lit("lab"), slug(lab), day).alias("key"), value(lab=lab, date=day, value=F.col("o_totalprice").cast("string"), unit=F.lit("u")).alias("value")))
    return out.groupBy("key").agg(F.min("value").alias("value"))


def clinic_passages(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text", *[c.alias(k) for k, c in _meta(F.col("doc_id"), 50).items()])


def clinic_questions(spark, d):
    return _questions(spark, d).select((F.col("conv_id") * 8 + F.col("turn")).alias("qid"), "query", "scope")


@query("lifecycle_batch")
def lifecycle_batch(spark, d):
    """A batch of questions through safety, routing, scope, records by what is named, passages under each question's filter, sufficiency, answer and citation check."""
    told = lifecycle.run_batch(told_apart(_questions(spark, d)), None, clinic_passages(spark, d), records=clinic_records(spark, d))
    return told.withColumn("qid", F.shiftright("qid", 32) * 8 + F.col("qid").bitwiseAND(F.lit(0xFFFFFFFF)))


def told_apart(questions):
    """Questions by conversation and turn. As ``clinic_questions`` numbers them, the ninth turn of a conversation has the number of the next one's first, and stages that join by number would mix them."""
    return questions.select((F.shiftleft(F.col("conv_id").cast("long"), 32) + F.col("turn")).alias("qid"), "query", "scope")


@query(
    "stored_vectors",
    """WITH t AS (SELECT vec_id AS id, label AS space, CASE WHEN vec_id % 50 = 0 THEN list_reverse(embedding) ELSE embedding END AS v FROM embeddings WHERE vec_id % 70 <> 1),
    s AS (SELECT id, space, round(list_dot_product(CAST(v AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 6) AS score FROM t WHERE space IN (3, 7))
    SELECT 'n' || space AS namespace, id, score FROM s QUALIFY row_number() OVER (PARTITION BY space ORDER BY score DESC, id) <= 10""",
)
def stored_vectors(spark, d):
    """The vectors as a stored table: one in fifty is replaced, one in seventy taken out, then two namespaces are searched."""
    from ..operators import vectors
    from ..sources.shared import shared_dir
    from ..sources.vector_store import StoredVectors

    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("n"), F.col("label").cast("string")).alias("namespace"), "embedding")
    store = StoredVectors(spark, shared_dir(spark, "vectors"))
    store.create(rows, {"embedder": "given", "dim": 64})
    store.upsert(rows.where("id % 50 = 0").withColumn("embedding", F.reverse("embedding")))
    store.delete(rows.where("id % 70 = 1").select("id", "namespace"))
    found = vectors.top_k(store.rows(["n3", "n7"]), rows.where("id = 0").select("embedding"), 10, "id", namespace="namespace")
    return found.select("namespace", "id", F.round("score", 6).alias("score"))


_GATED = f"""(SELECT *, {_flag_sql()} AS flag FROM (SELECT *, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS c, coalesce(scope, CASE WHEN ids <> '' THEN split_part(ids, '|', 1) END) AS pick, coalesce(scope IS NOT NULL AND (types <> '' OR regexp_matches(query, '(?i){sql_text(V.PATIENT_REFERENCE)}')), false) AS about FROM {_SIG2}))"""


@query(
    "lifecycle_gates",
    f"""WITH g AS (SELECT *, regexp_matches(c, '(?i){sql_text(V.RECORD_FRAME)}') AND NOT regexp_matches(c, '(?i){sql_text(V.FIRST_PERSON)}') AND NOT regexp_matches(c, '(?i){V.URGENT}') AS framed,
      regexp_matches(query, '(?i){sql_text(V.MEDICAL_HINT)}') OR regexp_matches(query, '(?i)\\b({"|".join(sql_text(n) for n in _NAMES)})\\b') AS clinical, (drugs || labs || conditions || ids || icd || rx) <> '' AS named,
      contains(ids, '|') OR (scope IS NOT NULL AND ids <> '' AND ids <> scope) OR (pick IS NOT NULL AND CAST(substr(pick, 2) AS INTEGER) >= 50) AS off FROM {_GATED}),
    h AS (SELECT *, CASE WHEN NOT off THEN pick END AS subject FROM g)
    SELECT conv_id * 8 + turn AS qid, CASE WHEN flag IS NOT NULL AND NOT framed THEN 'red_flag' WHEN NOT named AND NOT about AND NOT clinical THEN 'out_of_scope' WHEN off THEN 'violation' END AS status, subject,
      CASE WHEN s AND (k OR n) THEN 'HYBRID' WHEN s THEN 'KV' WHEN n THEN 'VECTOR' WHEN k AND patient THEN 'HYBRID' WHEN k OR drugs <> '' OR conditions <> '' THEN 'VECTOR' WHEN patient THEN 'HYBRID' ELSE 'VECTOR' END AS route,
      CASE WHEN subject IS NOT NULL AND notes AND NOT (know OR drugish) THEN 'patient_notes' ELSE array_to_string([CASE WHEN subject IS NULL AND NOT (drugs <> '' OR drugish) THEN 'drug_labels' END, CASE WHEN subject IS NOT NULL THEN 'patient_notes' END,
        CASE WHEN drugs <> '' OR drugish THEN 'drug_labels' END, CASE WHEN conditions <> '' OR drugs = '' OR subject IS NULL THEN 'guidelines' END], '|') END AS spaces FROM h""",
)
def lifecycle_gates(spark, d):
    """What the lifecycle decides before it looks anything up: the questions that end early, and subject, route and namespaces of all."""
    known = clinic_records(spark, d).select(F.split_part("key", F.lit(":"), F.lit(2)).alias("subject"))
    return lifecycle.routed(clinic_questions(spark, d), known, TODAY).select("qid", "status", "subject", "route", F.array_join("spaces", "|").alias("spaces"))
