"""Queries written in SQL only, over the table functions; each must equal its DataFrame form."""

from __future__ import annotations

from .. import sql
from .base import ORACLES, query, read
from .language_queries import CHECKED, _cited_answers


def _session(spark, d):
    sql.register(spark)
    read(spark, d, "documents").createOrReplaceTempView("loom_documents")


@query("sql_doc_freq", ORACLES["doc_freq"])
def sql_doc_freq(spark, d):
    _session(spark, d)
    return spark.sql("SELECT term, count(DISTINCT key) AS df, count(*) AS tf FROM loom_tokens(TABLE(SELECT doc_id, text FROM loom_documents)) GROUP BY term")


@query("sql_chunks", ORACLES["chunk_sections"])
def sql_chunks(spark, d):
    _session(spark, d)
    return spark.sql("SELECT CAST(key AS BIGINT) AS doc_id, chunk_id, section, sha2(text, 256) AS digest FROM loom_chunks(TABLE(SELECT doc_id, text FROM loom_documents))")


@query("sql_citation_check", f"SELECT qid, count(*) FILTER (WHERE status <> 'exempt') AS counted, count(*) FILTER (WHERE status = 'supported') AS supported FROM {CHECKED} GROUP BY 1")
def sql_citation_check(spark, d):
    _session(spark, d)
    told, evidence = _cited_answers(spark, d)
    told.createOrReplaceTempView("loom_answers")
    evidence.createOrReplaceTempView("loom_evidence")
    return spark.sql("""
        WITH known AS (SELECT qid, map_from_entries(collect_list(struct(key, concat_ws(' ', text, title)))) AS known FROM loom_evidence GROUP BY qid),
        asked AS (SELECT a.qid, a.answer, k.known FROM loom_answers a LEFT JOIN known k ON a.qid = k.qid)
        SELECT CAST(key AS BIGINT) AS qid, count_if(status <> 'exempt') AS counted, count_if(status = 'supported') AS supported FROM loom_check(TABLE(asked)) GROUP BY key""")
