"""A batch of questions through the whole lifecycle, as one chain of DataFrames.

Each stage adds columns; a question that ends early has a status and takes no part in what follows. A single question is
a batch of one row. What several stages read (the routed questions, the numbered evidence, the verdicts) is written once to shared storage. Texts of passages stay out of it: evidence
is numbered by id, and the sentences that may be told are taken where an id meets its text, so a passage's text travels once, not with each question that it is found for.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import fuzzy, routing
from ..functions.text import found
from ..sources.shared import saved
from . import answers, gazetteer, lexical, lookup, scoped


#: Questions that meet a passage's sentences together. What is kept of a source's sentences.
GROUP, SCORED = 64, ("qid", "key", "order", "best", "has")


def facts_for(asked: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """asked: qid, subject, q. The k facts of a question's subject that hold most of its terms, with ``nth``; facts without any come last,
    by id. One equi-join on subject and term, so a subject with many facts meets only the questions about it."""
    terms = lexical.token_rows(asked.select("qid", F.col("q").alias("text")), "qid").distinct().join(asked.select("qid", "subject"), "qid")
    words = lexical.token_rows(facts.select(F.struct("subject", "id").alias("fact"), F.concat_ws(" ", "title", "text").alias("text")), "fact").distinct()
    shared = words.select("fact.subject", "fact.id", "term").join(terms, ["subject", "term"]).groupBy("qid", "id").agg(F.count(F.lit(1)).alias("shared"))
    rows = asked.select("qid", "subject").join(facts, "subject").join(shared, ["qid", "id"], "left")
    w = Window.partitionBy("qid").orderBy(F.desc(F.coalesce("shared", F.lit(0))), "id")
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


@dataclass
class Run:
    """The stages of a batch. questions: qid, query, q, status, route, why, subject, spaces and what the question names. report: what was searched for
    it. evidence: qid, key, origin, id, title, text, score. final: as ``run_batch`` returns it."""

    questions: DataFrame
    report: DataFrame
    evidence: DataFrame
    final: DataFrame


def routed(questions: DataFrame, known: DataFrame, today: dt.date, names: DataFrame | None = None) -> DataFrame:
    """Safety, entities, route, scope and namespaces of every question; known: subject; names: a catalogue (kind, surface, canonical) beside the constant lists."""
    q = questions.withColumn("q", routing.normalize(F.col("query")))
    q = q.withColumn("e", routing.entities(F.col("query"), F.col("q"), today)).withColumn("safe", routing.precheck(F.col("query"), F.lit(True)))
    q = saved(q.select("qid", "query", "scope", "q", "e", "safe"), "entities")  # else every use of an entity below would compute it again
    if names is not None:
        q = gazetteer.with_catalogue(q, names)
    q = q.withColumn("r", routing.route(F.col("q"), F.col("e"), F.col("scope")))
    named = F.size("e.drugs") + F.size("e.labs") + F.size("e.conditions") + F.size("e.patient_ids") + F.size("e.icd10_codes") + F.size("e.rxnorm_codes")
    about = F.col("scope").isNotNull() & (routing.has(F.col("query"), f"(?i){V.PATIENT_REFERENCE}") | (F.size("e.record_types") > 0))
    outside = (named == 0) & ~about & ~routing.looks_clinical(F.col("query"))
    q = q.withColumn("pick", F.coalesce("scope", F.get("e.patient_ids", F.lit(0)))).join(known.select(F.col("subject").alias("_known")).distinct(), F.col("pick") == F.col("_known"), "left")
    q = q.withColumn("s", routing.scope_of(F.col("scope"), F.col("e.patient_ids"), F.col("_known").isNotNull()))
    status = F.when(F.col("safe.verdict") == "red_flag", "red_flag").when(outside, "out_of_scope").when(F.col("s.violation").isNotNull(), "violation")
    number = lambda c: F.date_format(c, "yyyyMMdd").cast("long")
    return saved(q.select(
        "qid", "query", "q", status.alias("status"), F.col("r.route").alias("route"), F.coalesce("safe.category", "s.violation").alias("why"), F.col("s.scope").alias("subject"),
        routing.namespaces(F.col("q"), F.col("e"), F.col("s.scope")).alias("spaces"), F.col("e.dosage_intent").alias("dosage"), "e.drugs", "e.labs", "e.conditions", "e.icd10_codes", "e.rxnorm_codes", "e.record_types",
        F.col("e.time_range.start").cast("string").alias("start"), F.col("e.time_range.end").cast("string").alias("stop"), F.coalesce("e.time_range.latest_only", F.lit(False)).alias("latest_only"),
        number("e.time_range.start").alias("from_num"), number("e.time_range.end").alias("to_num"),
        (F.size("e.drugs") + F.size("e.icd10_codes") + F.size("e.rxnorm_codes") + F.size("e.patient_ids") > 0).alias("known"),
    ), "routed")


def run(
    questions: DataFrame, facts: DataFrame | None, passages: DataFrame, today: dt.date = dt.date(2026, 10, 1), k: int = 5, min_score: float = 1.0, min_rate: float = 0.6,
    meds: DataFrame | None = None, notes: DataFrame | None = None, vocabulary: DataFrame | None = None, records: DataFrame | None = None, embed: Callable | None = None, names: DataFrame | None = None,
) -> Run:
    """questions: qid, query, scope. Structured evidence comes from ``records`` (key, value), looked up by what a question names, or, without them, from ``facts`` (subject, id,
    title, text). passages: id, namespace, title, text and, as far as they have them, owner, drug, date_num, embedding; each question searches the namespaces of its plan
    under its own subject, drugs and dates, by words and, with ``embed``, by vectors. With meds (subject, drug, dose) and notes (subject, text) conflicting doses are found,
    with a vocabulary (word) questions about unknown things. ``names`` (kind: drugs, labs or conditions; surface, in lower case; canonical) adds a catalogue of any size to the names known."""
    records = None if records is None else saved(records, "records")
    known = facts.select("subject") if records is None else lookup.with_record(records).where("subject is not null").select("subject")
    q = routed(questions, known, today, names)
    open_ = q.where("status IS NULL")

    kinds = {"owner": "string", "drug": "string", "date_num": "long"}
    for c, kind in kinds.items():
        if c not in passages.columns:
            passages = passages.withColumn(c, F.lit(None).cast(kind))
    # Equal questions under equal filters are retrieved once.
    same = ["q", "subject", "spaces", "drugs", "from_num", "to_num"]
    search = open_.where("route <> 'KV'")
    once = saved(search.groupBy(*same).agg(F.min("qid").alias("lead")), "once")
    asked = once.select(F.col("lead").alias("qid"), F.col("q").alias("text"), F.col("subject").alias("scope"), F.col("spaces").alias("namespaces"), "drugs", F.col("from_num").alias("start"), F.col("to_num").alias("stop"))
    if embed is not None and "embedding" in passages.columns:
        asked = asked.join(embed(asked.select("qid", "text"), "qid", "text"), "qid")
    top, report = scoped.retrieve(asked, passages, k)
    leads = search.join(once, _equal(search, once, same)).select(search["qid"], "lead")
    leads = saved(leads, "leads")
    hits = leads.join(top.withColumnRenamed("qid", "lead"), "lead").select("qid", "id", *[F.lit(None).cast("string").alias(c) for c in ("title", "text")], "score", "namespace", F.lit("vector").alias("origin"), F.col("rank").alias("nth"))
    wants = open_.where("route <> 'VECTOR'")
    if records is None:
        rows = facts_for(wants.select("qid", "subject", "q"), facts, k).select("qid", "id", "title", "text", "nth")
    else:
        found_rows = lookup.records_for(wants.withColumn("scope", F.col("subject")).select("qid", "scope", "icd10_codes", "rxnorm_codes", "drugs", "labs", "conditions", "record_types", "start", "stop", "latest_only"), records)
        rows = found_rows.join(lookup.with_record(records).select("key", "title", "text"), "key").select("qid", F.col("key").alias("id"), "title", "text", F.col("seq").alias("nth"))
    rows = rows.select("qid", "id", "title", "text", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("namespace"), F.lit("kv").alias("origin"), "nth")
    evidence = saved(answers.number_evidence(rows.unionByName(hits), "qid", "origin", "nth").withColumn("order", F.substr("key", F.lit(2)).cast("int") - 1), "evidence")

    strong = F.col("score") >= min_score
    counts = evidence.groupBy("qid").agg(
        F.count_if(F.col("origin") == "kv").alias("records"), F.count_if(strong).alias("strong"), F.count_if(strong & (F.col("namespace") == scoped.LABELS)).alias("labels"),
        F.count_if(F.col("origin") != "kv").alias("chunks"), F.count_if((F.col("origin") == "kv") & F.col("title").startswith("medication")).alias("med_records"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    judged = open_.join(counts, "qid", "left")
    if meds is not None and notes is not None:
        clashes = answers.dose_conflicts(meds, notes, "subject").select(F.col("subject").alias("_s"), F.col("drug").alias("_d")).distinct()
        told_twice = open_.select("qid", "subject", F.explode("drugs").alias("drug")).join(clashes, (F.col("subject") == F.col("_s")) & (F.col("drug") == F.col("_d"))).groupBy("qid").agg(F.count(F.lit(1)).alias("conflicts"))
        judged = judged.join(told_twice, "qid", "left")
    if vocabulary is not None:
        words = open_.where("not known").select("qid", F.explode(F.array_distinct(found(F.col("q"), "[a-z][a-z0-9-]{5,}"))).alias("word"))
        judged = judged.join(fuzzy.unknown_words(words, vocabulary, "qid").groupBy("qid").agg(F.count(F.lit(1)).alias("unknown")), "qid", "left")
    extra = {c: zero(c) if c in judged.columns else F.lit(0) for c in ("conflicts", "unknown")}
    reason = answers.sufficiency(F.col("route"), zero("records"), zero("strong"), zero("chunks"), F.col("dosage"), F.size("drugs"), zero("med_records"), zero("labels"), extra["conflicts"], extra["unknown"])
    judged = saved(judged.select("qid", "q", reason.alias("reason")), "judged")
    able = judged.where("reason = 'ok'").select("qid", F.col("q").alias("question"))
    wanted = evidence.join(answers.question_terms(able, "qid"), "qid")
    stated = answers.scored_sentences(_sources(wanted.where("origin = 'kv'")))
    # The questions that ask for a passage meet it in groups, so its sentences are cut once for a group.
    pair = ("qid", "key", "origin", "order", "_q")
    group = F.floor((F.row_number().over(Window.partitionBy("id").orderBy("qid", "key")) - 1) / GROUP)
    pairs = wanted.where("origin <> 'kv'").select("id", *pair).withColumn("group", group).groupBy("id", "group").agg(F.collect_list(F.struct(*pair)).alias("pairs"))
    met = _sources(pairs.join(passages.select("id", "title", "text"), "id")).select("_title", "_said", "has", F.explode("pairs").alias("p")).select("p.*", "_title", "_said", "has")
    scored = saved(stated.select(*SCORED).unionByName(answers.scored_sentences(met).select(*SCORED)), "scored")
    told = saved(answers.composed(able, scored, "qid"), "told")
    has = scored.groupBy("qid", "key").agg(F.array_distinct(F.flatten(F.collect_list("has"))).alias("has"))
    checked = answers.check_answers(told.where(F.col("answer") != V.INSUFFICIENT), has, "qid")
    good = checked.where((F.col("supported") > 0) & (F.col("grounding_rate") >= min_rate))
    out = q.join(judged.select("qid", "reason"), "qid", "left").join(good, "qid", "left")
    final = F.coalesce("status", F.when(F.col("kept_text").isNotNull(), "answered").otherwise("abstained"))
    told_all = out.select("qid", final.alias("status"), "route", F.coalesce("why", "reason").alias("reason"), F.col("kept_text").alias("answer"), "grounding_rate")
    report = leads.join(report.withColumnRenamed("qid", "lead"), "lead").drop("lead")
    return Run(q, report, with_texts(evidence, passages), told_all)


def _sources(rows: DataFrame) -> DataFrame:
    return answers.source_sentences(rows.withColumn("has", answers.told_numbers(F.col("text"), F.col("title"))))


def with_texts(evidence: DataFrame, passages: DataFrame) -> DataFrame:
    """Evidence with title and text of its passages; records have theirs."""
    chunks = evidence.where("origin <> 'kv'").drop("title", "text").join(passages.select("id", "title", "text"), "id")
    return evidence.where("origin = 'kv'").unionByName(chunks)


def _equal(a: DataFrame, b: DataFrame, columns: list[str]):
    test = F.lit(True)
    for c in columns:
        test = test & a[c].eqNullSafe(b[c])
    return test


def run_batch(questions: DataFrame, facts: DataFrame | None, passages: DataFrame, today: dt.date = dt.date(2026, 10, 1), k: int = 5, **rules) -> DataFrame:
    """qid, status (red_flag, out_of_scope, violation, abstained, answered), route, reason, answer, grounding_rate; parameters as in ``run``."""
    return run(questions, facts, passages, today, k, **rules).final
