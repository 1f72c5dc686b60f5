"""Dense, lexical and fused retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.fixed_values import LABS
from ..operators import answers, fusion, lexical, measures, vectors
from .base import query, read, spread
from .language_queries import NUMBERS, WORDS_LIST, sql_text, tokens_sql

DOT = "round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
ROUNDED = 6


def _vectors(spark, d):
    return read(spark, d, "embeddings")


@query("dense_topk", f"SELECT e.vec_id, {DOT} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20")
def dense_topk(spark, d):
    e = _vectors(spark, d)
    return vectors.top_k(e, e.where("vec_id = 0"), 20, "vec_id").select("vec_id", F.round("score", ROUNDED).alias("score"))


@query("dense_topk_filtered", f"SELECT e.vec_id, {DOT} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE label IN (1, 2, 3) AND vec_id >= 50 ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk_filtered(spark, d):
    e = _vectors(spark, d)
    spec = {"$and": [{"label": {"$in": [1, 2, 3]}}, {"vec_id": {"$gte": 50}}]}
    return vectors.top_k(e, e.where("vec_id = 1"), 10, "vec_id", spec).select("vec_id", F.round("score", ROUNDED).alias("score"))


@query("dense_topk_per_namespace", f"SELECT label, vec_id, {DOT} AS score, CAST(row_number() OVER (PARTITION BY label ORDER BY {DOT} DESC, vec_id) AS INTEGER) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 2) q QUALIFY rank <= 5")
def dense_topk_per_namespace(spark, d):
    e = _vectors(spark, d)
    return vectors.top_k(e, e.where("vec_id = 2").select("embedding"), 5, "vec_id", namespace="label").select("label", "vec_id", F.round("score", ROUNDED).alias("score"), "rank")


QUERIES_SQL = "(SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 100 = 0)"


def _queries(spark, d):
    return _vectors(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query("dense_multiquery_topk", f"SELECT q.qid, e.vec_id, {DOT} AS score, CAST(row_number() OVER (PARTITION BY q.qid ORDER BY {DOT} DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, {QUERIES_SQL} q QUALIFY rank <= 10")
def dense_multiquery_topk(spark, d):
    return vectors.many_top_k(_vectors(spark, d), _queries(spark, d), 10, "vec_id").select("qid", "vec_id", F.round("score", ROUNDED).alias("score"), "rank")


@query(
    "retrieval_recall_mrr",
    f"""WITH r AS (SELECT q.qid, q.label AS ql, e.vec_id, e.label, row_number() OVER (PARTITION BY q.qid ORDER BY {DOT} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT vec_id AS qid, embedding, label FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.vec_id <> q.qid QUALIFY rank <= 10),
    n AS (SELECT q.vec_id AS qid, count(*) AS total FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1)
    SELECT qid, round(coalesce(1.0 / min(rank) FILTER (WHERE label = ql), 0.0), 6) AS rr, {", ".join(f"round(count(*) FILTER (WHERE label = ql AND rank <= {k}) / CAST(any_value(total) AS DOUBLE), 6) AS recall_{k}" for k in (1, 3, 5, 10))} FROM n LEFT JOIN r USING (qid) GROUP BY 1""",
)
def retrieval_recall_mrr(spark, d):
    e = _vectors(spark, d)
    top = vectors.many_top_k(e, _queries(spark, d), 11, "vec_id").where("qid <> vec_id")
    top = measures.ranked(top.drop("rank"), ["qid"], [F.desc("score"), F.col("vec_id")]).where("rank <= 10")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    return measures.retrieval_by_label(top, e.select("vec_id", "label"), asked, "qid", "vec_id", "label")


@query("ann_ivf_recall")
def ann_ivf_recall(spark, d):
    """Recall of the cell index against the exact ten nearest."""
    e, q = _vectors(spark, d), _queries(spark, d)
    cells = max(4, int(4 * e.count() ** 0.5) // 4)
    found = vectors.ivf_search(e, q, 10, cells, max(1, cells // 4), key="vec_id")
    return measures.overlap(found, vectors.many_top_k(e, q, 10, "vec_id"), "qid", "vec_id").select(F.round("recall", 6).alias("recall"))


@query("ann_ivf_all_cells", f"SELECT q.qid, e.vec_id, {DOT} AS score, CAST(row_number() OVER (PARTITION BY q.qid ORDER BY {DOT} DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, {QUERIES_SQL} q QUALIFY rank <= 5")
def ann_ivf_all_cells(spark, d):
    """Probing every cell is exact."""
    return vectors.ivf_search(_vectors(spark, d), _queries(spark, d), 5, 8, 8, key="vec_id").select("qid", "vec_id", F.round("score", ROUNDED).alias("score"), "rank")


DOC_TOKENS = tokens_sql("text", "documents", "doc_id")
ASK_TOKENS = tokens_sql("text", "benchmark", "item_id")
BM25 = f"""(WITH t AS (SELECT doc_id, term, count(*) AS tf FROM {DOC_TOKENS} GROUP BY ALL), l AS (SELECT doc_id, CAST(coalesce(sum(tf), 0) AS DOUBLE) AS len FROM documents LEFT JOIN t USING (doc_id) GROUP BY 1),
    s AS (SELECT count(*) AS n, avg(len) AS avgdl FROM l), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1), a AS (SELECT item_id, term, count(*) AS times FROM {ASK_TOKENS} GROUP BY ALL)
    SELECT item_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM a JOIN t USING (term) JOIN df USING (term) JOIN l USING (doc_id), s GROUP BY 1, 2)"""


def _postings(spark, d):
    """(asked terms, postings, number of documents) of the benchmark's items against all documents."""
    docs = spread(read(spark, d, "documents").select("doc_id", "text"), "doc_id")  # dealt by document, counts need no further exchange
    asked = lexical.asked_terms(read(spark, d, "benchmark"), "item_id")
    return asked, lexical.postings(docs, asked, "doc_id"), docs.count()


def _bm25(spark, d, k):
    asked, found, n = _postings(spark, d)
    return lexical.bm25_best(found, n, asked, "doc_id", "item_id", k)


@query("bm25_topk", f"SELECT item_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM {BM25} QUALIFY rank <= 10")
def bm25_topk(spark, d):
    return _bm25(spark, d, 10).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


COVER = f"(SELECT item_id, doc_id, count(*) AS score FROM (SELECT DISTINCT doc_id, term FROM {DOC_TOKENS}) JOIN (SELECT DISTINCT item_id, term FROM {ASK_TOKENS}) USING (term) GROUP BY 1, 2)"


@query(
    "rrf_fusion",
    f"""WITH a AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {BM25} QUALIFY rank <= 24),
    b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM {COVER} QUALIFY rank <= 24),
    f AS (SELECT item_id, doc_id, sum(1.0 / (60 + rank)) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
    SELECT item_id, doc_id, round(fused, 9) AS fused, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(fused, 12) DESC, doc_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""",
)
def rrf_fusion(spark, d):
    # Both lists read the same written postings.
    asked, found, n = _postings(spark, d)
    lists = [lexical.bm25_best(found, n, asked, "doc_id", "item_id", 24), lexical.coverage_best(found, asked, "doc_id", "item_id", 24)]
    f = fusion.rrf(lists, "doc_id", "item_id", 10)
    return f.select("item_id", "doc_id", F.round("fused", 9).alias("fused"), "rank")


@query(
    "lexical_rerank",
    f"""WITH top AS (SELECT item_id, doc_id, score FROM {BM25} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 24),
    q AS (SELECT item_id, list(DISTINCT term) AS q FROM {ASK_TOKENS} GROUP BY 1), b AS (SELECT doc_id, list(term) AS b FROM {tokens_sql("concat_ws(' ', source, text)", "documents", "doc_id")} GROUP BY 1),
    s AS (SELECT doc_id, list(term) AS s FROM {tokens_sql("coalesce(source, '')", "documents", "doc_id")} GROUP BY 1),
    x AS (SELECT item_id, doc_id, score, round(0.5 * score / CASE WHEN max(score) OVER (PARTITION BY item_id) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY item_id) END + 0.5 * (0.6 * len(list_intersect(q, list_distinct(b))) / len(q)
      + 0.25 * least(len(list_filter(b, lambda t: list_contains(q, t))) / sqrt(len(b) + 1.0), 1.0) + CASE WHEN list_has_any(coalesce(s, []), q) THEN 0.15 ELSE 0.0 END), 6) AS rerank_score FROM top JOIN q USING (item_id) JOIN b USING (doc_id) LEFT JOIN s USING (doc_id))
    SELECT item_id, doc_id, rerank_score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM x QUALIFY rank <= 10""",
)
def lexical_rerank(spark, d):
    """The lexical reranker over the first 24 of BM25."""
    top = _bm25(spark, d, 24).drop("rank").join(read(spark, d, "documents").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("section")), "doc_id")
    rows = top.join(read(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    return fusion.rerank(rows, "doc_id", "item_id", 10).select("item_id", "doc_id", "rerank_score", "rank")


@query(
    "lexical_overlap",
    f"""WITH q AS (SELECT item_id, count(DISTINCT term) AS n FROM {ASK_TOKENS} GROUP BY 1), o AS (SELECT item_id, doc_id, score / CAST(n AS DOUBLE) AS o FROM {COVER} JOIN q USING (item_id))
    SELECT item_id, doc_id, round(o, 6) AS overlap FROM o QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(o, 9) DESC, doc_id) <= 20""",
)
def lexical_overlap(spark, d):
    """The twenty documents that hold the largest share of an item's terms."""
    asked, found, _ = _postings(spark, d)
    size = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    most = lexical.coverage_best(found, asked, "doc_id", "item_id", 20)
    return most.join(size, "item_id").select("item_id", "doc_id", F.round(F.col("score") / F.col("n"), 6).alias("overlap"))


@query(
    "diversify_topk",
    f"""WITH r AS (SELECT vec_id, label, row_number() OVER (ORDER BY {DOT} DESC, vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q QUALIFY rank <= 24),
    f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rank) = 1 AS first FROM r), c AS (SELECT * FROM f QUALIFY row_number() OVER (ORDER BY first DESC, rank) <= 8)
    SELECT vec_id, label, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank FROM c""",
)
def diversify_topk(spark, d):
    e = _vectors(spark, d)
    top = measures.ranked(vectors.top_k(e, e.where("vec_id = 3"), 24, "vec_id").withColumn("qid", F.lit(3)), ["qid"], [F.desc("score"), F.col("vec_id")])
    return fusion.diversify(top, "vec_id", "qid", "label", 8).select("vec_id", "label", "rank")


@query("scope_filter", "SELECT count(*) FILTER (WHERE label IS NOT NULL AND label <> 3 AND vec_id % 4 > 0) AS leaks FROM embeddings")
def scope_filter(spark, d):
    rows = _vectors(spark, d).select("vec_id", F.when(F.col("vec_id") % 4 > 0, F.col("label")).alias("owner"))
    return fusion.in_scope(rows, "owner", F.lit(3))[1]


@query(
    "semantic_cache",
    """WITH s AS (SELECT q.vec_id AS qid, c.vec_id AS cached_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id % 10 = 0 AND c.vec_id % 10 > 0)
    SELECT qid, cached_id, round(score, 6) AS score FROM s WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, cached_id) = 1""",
)
def semantic_cache(spark, d):
    from ..operators.writes import semantic_hits

    e = _vectors(spark, d).withColumn("bucket", F.col("label"))
    asked = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), "bucket", "embedding")
    return semantic_hits(asked, e.where("vec_id % 10 > 0").withColumnRenamed("vec_id", "id"), 0.2).select("qid", "cached_id", F.round("score", 6).alias("score"))


@query("write_through", "SELECT 'patient' AS kind, count(*) AS n FROM (SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_custkey % 2 = 0) UNION ALL SELECT 'meta', count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT 'rejected', count(*) FROM (SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_custkey % 2 = 1)")
def write_through(spark, d):
    from ..operators.writes import add_labs

    o = read(spark, d, "orders")
    pid = F.format_string("P%06d", "o_custkey").alias("patient_id")
    labs = o.groupBy(pid, F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).agg(F.min("o_totalprice").alias("value")).withColumn("lab", F.lit("fasting glucose"))
    known = o.where("o_custkey % 2 = 0").select(pid)
    empty = spark.createDataFrame([], "key string, value string, expires_at double")
    table, _, rejected = add_labs(empty, labs, known)
    counts = table.groupBy(F.substring_index("key", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(rejected.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("kind"), "n"))


# --- answers over retrieved evidence ---------------------------------------------------------------
def _qa(spark, d):
    """Every benchmark item asks with its whole text; its evidence are the ten documents that BM25 finds, in full."""
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    top = _bm25(spark, d, 10).select(F.col("item_id").alias("qid"), "doc_id", "rank")
    e = top.join(read(spark, d, "documents").select("doc_id", "text"), "doc_id").select("qid", "doc_id", "rank", "text", F.lit("").alias("title"), F.when(F.col("doc_id") % 3 == 0, "kv").otherwise("vector").alias("origin"))
    e = answers.number_evidence(e, "qid", "origin", "rank")
    return b, e.withColumn("order", F.substr("key", F.lit(2)).cast("int") - 1)


def _words(col: str) -> str:
    return WORDS_LIST.replace("lower(text)", f"lower({col})")


def _composed() -> str:
    """SQL of (qid, answer) and of the evidence e (qid, key, text), for the queries below."""
    noise = ", ".join(f"'{w}'" for w in V.QUESTION_NOISE)
    return rf"""top AS (SELECT item_id AS qid, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {BM25} QUALIFY rank <= 10),
    e AS (SELECT qid, 'S' || row_number() OVER w AS key, row_number() OVER w - 1 AS ord, doc_id % 3 = 0 AS kv, text FROM top JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY qid ORDER BY CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END, rank)),
    q AS (SELECT item_id AS qid, list_filter(list_distinct({_words("text")}), lambda t: t NOT IN ({noise})) AS q FROM benchmark),
    s AS (SELECT qid, key, ord, kv, unnest(list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n+', chr(1), 'g'), '([.!?])[ \t\r\f\v]+([A-Z0-9•*-])', '\1' || chr(1) || '\2', 'g'), chr(1)),
      lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: trim(x, ' -•'))) AS sentence FROM e),
    o AS (SELECT s.*, len(string_split_regex(sentence, '\s+')) AS words, len(list_intersect(q, list_distinct({_words("sentence")}))) / CAST(greatest(len(q), 1) AS DOUBLE) AS o FROM s JOIN q USING (qid)),
    r AS (SELECT qid, key, ord, sentence, -round(o + CASE WHEN kv THEN 0.25 ELSE 0.0 END - 0.01 * ord - 0.001 * words, 9) AS s FROM o WHERE words >= 3 AND o > 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s, ord, key, sentence) AS i FROM r),
    g AS (SELECT item_id AS qid, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(o BIGINT, s DOUBLE, k VARCHAR, t VARCHAR)[]) AS acc FROM benchmark
      UNION ALL SELECT g.qid, n.i, CASE WHEN len(list_filter(acc, lambda y: y.t = sentence)) > 0 OR len(list_filter(acc, lambda y: y.k = key)) >= 2 THEN acc ELSE list_append(acc, {{'o': ord, 's': s, 'k': key, 't': sentence}}) END
      FROM g JOIN n ON g.qid = n.qid AND n.i = g.i + 1 WHERE len(acc) < 6),
    p AS (SELECT qid, list_sort(arg_max(acc, i)) AS acc FROM g GROUP BY 1),
    a AS (SELECT qid, CASE WHEN len(acc) = 0 AND qid NOT IN (SELECT qid FROM n) THEN '{V.INSUFFICIENT}' ELSE '{V.OPENING}' || ' ' || array_to_string(list_transform(acc, lambda x: CASE WHEN right(x.t, 1) IN ('.', '!', '?') THEN left(x.t, length(x.t) - 1) || ' [' || x.k || ']' || right(x.t, 1) ELSE x.t || ' [' || x.k || '].' END), ' ') END AS answer FROM p)"""


_COMPOSED = _composed()


@query("extractive_answer", f"WITH RECURSIVE {_COMPOSED} SELECT qid, answer FROM a")
def extractive_answer(spark, d):
    b, e = _qa(spark, d)
    return answers.compose(b, e, "qid")


@query(
    "answer_and_check",
    rf"""WITH RECURSIVE {_COMPOSED},
    m AS (SELECT qid, regexp_replace(regexp_replace(trim(answer), '([.!?])\s*((?:\[S\d+\]\s*)+)', ' \2' || chr(1) || '\1', 'g'), '\s*' || chr(1), '', 'g') AS t FROM a WHERE answer <> '{V.INSUFFICIENT}'),
    c AS (SELECT qid, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '\n+', chr(1), 'g'), '([.!?])[ \t\r\f\v]+([A-Z0-9•*-])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS sentence FROM m),
    b AS (SELECT qid, sentence, trim(regexp_replace(sentence, '\[S\d+\]', '', 'g')) AS body, list_distinct(regexp_extract_all(sentence, '\[(S\d+)\]', 1)) AS ks, row_number() OVER () AS id FROM c),
    h AS (SELECT id, list_distinct(flatten(list({NUMBERS.format("e.text")}))) AS has FROM (SELECT id, qid, unnest(ks) AS key FROM b) k JOIN e USING (qid, key) GROUP BY id),
    z AS (SELECT b.qid, CASE WHEN len(ks) = 0 THEN CASE WHEN regexp_matches(body, '(?i){sql_text(V.EXEMPT)}') AND len({NUMBERS.format("body")}) = 0 THEN 'exempt' ELSE 'uncited' END WHEN NOT list_has_all(coalesce(has, []), {NUMBERS.format("body")}) THEN 'number' ELSE 'supported' END AS status
      FROM b LEFT JOIN h USING (id) WHERE NOT regexp_matches(body, '^[\W_]*$'))
    SELECT qid, count(*) FILTER (WHERE status <> 'exempt') AS counted, count(*) FILTER (WHERE status = 'supported') AS supported,
      CASE WHEN counted > 0 THEN round(supported / counted, 4) ELSE 0.0 END AS grounding_rate, counted > 0 AND counted = supported AS passed FROM z GROUP BY 1""",
)
def answer_and_check(spark, d):
    """Composed answers quote their sources, so the check supports every sentence but the opening."""
    b, e = _qa(spark, d)
    told = answers.compose(b, e, "qid").where(F.col("answer") != V.INSUFFICIENT)
    return answers.check_answers(told, e.select("qid", "key", "text", "title"), "qid").select("qid", "counted", "supported", "grounding_rate", "passed")
