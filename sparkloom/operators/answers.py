"""From evidence to checked answers: numbering, sufficiency, extractive answers, citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import collapse, numbers, sentences, tokens

MARKER = r"\[(S\d+(?:\s*,\s*S\d+)*)\]"


def number_evidence(rows: DataFrame, query_key: str, origin: str, order: str, most: int = 10) -> DataFrame:
    """Structured records first, then passages, each in order; keys S1..Sn, ``most`` at most."""
    w = Window.partitionBy(query_key).orderBy(F.when(F.col(origin) == "kv", 0).otherwise(1), order)
    n = F.row_number().over(w)
    return rows.withColumn("n", n).where(F.col("n") <= most).withColumn("key", F.concat(F.lit("S"), F.col("n").cast("string"))).drop("n")


def dose_conflicts(meds: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Active doses (key, drug, dose) that the medication list of a note (key, text) states otherwise. Joined on the subject;
    the drug name in the text is a residual."""
    pattern = F.concat(F.lit(r"(?i)\b"), F.regexp_replace("drug", r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit(r"\s+" + V.DOSE))
    both = meds.join(notes, key).withColumn("_n", F.expr("1"))
    hits = both.select(key, "drug", "dose", F.explode(F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("a"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("u"))).alias("m"))
    told = F.lower(F.concat(F.col("m.a"), F.col("m.u")))
    return hits.where(told != F.lower(F.replace("dose", F.lit(" "), F.lit("")))).select(key, "drug", "dose", F.concat_ws(" ", "m.a", "m.u").alias("noted")).distinct()


def sufficiency(route: Column, records: Column, strong: Column, any_chunk: Column, dosage: Column, drugs: Column, med_record: Column, strong_label: Column, conflicts: Column, unknown: Column) -> Column:
    """The first rule that fails, or ok."""
    return (
        F.when(unknown > 0, "unknown subject")
        .when((records == 0) & (any_chunk == 0), "nothing retrieved")
        .when((route == "KV") & (records == 0) & (strong == 0), "no matching record")
        .when((records == 0) & (strong == 0), "below threshold")
        .when(dosage & (drugs == 0) & (med_record == 0), "dose without drug")
        .when(dosage & (drugs > 0) & (strong_label == 0) & (med_record == 0), "dose without label")
        .when(conflicts > 0, "sources disagree")
        .otherwise("ok")
    )


def attach_markers(text: Column) -> Column:
    """Markers that follow the end of a sentence move inside it."""
    moved = F.regexp_replace(text, r"([.!?])\s*((?:\[S\d+(?:\s*,\s*S\d+)*\]\s*)+)", " $2\u0001$1")
    return F.regexp_replace(moved, r"\s*\u0001", "")


def cited(sentence: Column) -> Column:
    groups = F.regexp_extract_all(sentence, F.lit(MARKER), F.lit(1))
    return F.transform(F.split(F.array_join(groups, ","), r"\s*,\s*"), lambda k: F.trim(k))


def check_sentences(answers: DataFrame, evidence: DataFrame, query_key: str) -> DataFrame:
    """One row per sentence of an answer: pos, sentence, status (supported, exempt, uncited, invalid_key, number). Evidence: query_key, key and text, title or ``has``, the numbers in them."""
    sent = answers.select(query_key, F.posexplode(sentences(attach_markers(F.trim("answer")))).alias("pos", "sentence"))
    body = F.trim(F.regexp_replace("sentence", MARKER, ""))
    sent = (
        sent.withColumn("body", body).where(~F.col("body").rlike(r"^[\W_]*$"))
        .withColumn("keys", F.when(F.col("sentence").rlike(MARKER), cited(F.col("sentence"))).otherwise(F.array().cast("array<string>"))).withColumn("nums", numbers(F.col("body")))
    )
    has = F.col("has") if "has" in evidence.columns else told_numbers(F.col("text"), F.col("title"))
    known = evidence.select(query_key, F.col("key"), has.alias("has"))
    per = known.groupBy(query_key).agg(F.map_from_entries(F.collect_list(F.struct("key", "has"))).alias("known"))
    joined = sent.join(per, query_key, "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,array<string>>")))
    bad = F.array_except("keys", F.map_keys("known"))
    available = F.flatten(F.transform(F.array_intersect("keys", F.map_keys("known")), lambda k: F.element_at("known", k)))
    missing = F.array_except("nums", available)
    status = (
        F.when(F.size("keys") == 0, F.when(F.col("body").rlike(f"(?i){V.EXEMPT}") & (F.size("nums") == 0), "exempt").otherwise("uncited"))
        .when(F.size(bad) > 0, "invalid_key").when(F.size(missing) > 0, "number").otherwise("supported")
    )
    return joined.select(query_key, "pos", "sentence", "keys", status.alias("status"))


def check_answers(answers: DataFrame, evidence: DataFrame, query_key: str) -> DataFrame:
    """Per answer: text that stays, counted and supported sentences, grounding rate, passed."""
    s = check_sentences(answers, evidence, query_key)
    counted, ok = F.count_if(F.col("status") != "exempt"), F.count_if(F.col("status") == "supported")
    kept = F.sort_array(F.collect_list(F.when(F.col("status").isin("exempt", "supported"), F.struct("pos", "sentence"))))
    found = s.groupBy(query_key).agg(counted.alias("counted"), ok.alias("supported"), F.array_join(F.transform(kept, lambda x: x["sentence"]), " ").alias("kept_text"))
    rate = F.when(F.col("counted") > 0, F.round(F.col("supported") / F.col("counted"), 4)).otherwise(0.0)
    return found.select(query_key, "kept_text", "counted", "supported", rate.alias("grounding_rate"), ((F.col("counted") > 0) & (F.col("counted") == F.col("supported"))).alias("passed"))


def citations(answers: DataFrame, evidence: DataFrame, query_key: str, most: int = 280) -> DataFrame:
    """(query_key, nth, key, title, snippet) of the sources that an answer cites, in the order in which they are first named."""
    s = check_sentences(answers, evidence, query_key).select(query_key, "pos", F.posexplode("keys").alias("i", "key"))
    first = s.groupBy(query_key, "key").agg(F.min(F.struct("pos", "i")).alias("at"))
    known = first.join(evidence.select(query_key, "key", "title", F.substring(collapse(F.col("text")), 1, most).alias("snippet")), [query_key, "key"])
    return known.select(query_key, F.row_number().over(Window.partitionBy(query_key).orderBy("at")).alias("nth"), "key", "title", "snippet")


def abstain_text(reason: Column, conflicts: Column) -> Column:
    """What is said instead of an answer; ``conflicts`` is an array of (drug, dose, noted)."""
    told = F.transform(conflicts, lambda c: F.concat(c["drug"], F.lit(": record "), c["dose"], F.lit(", note "), c["noted"]))
    return F.concat_ws(" ", F.lit(V.ABSTAIN), F.concat(F.lit("Reason: "), reason, F.lit(".")), F.when(F.size(told) > 0, F.concat(F.lit("Conflicts: "), F.array_join(told, "; "), F.lit("."))))


def told_numbers(text: Column, title: Column) -> Column:
    return F.array_union(numbers(text), numbers(F.coalesce(title, F.lit(""))))


def question_terms(questions: DataFrame, query_key: str) -> DataFrame:
    """(query_key, _q): the different terms of a question that may choose a sentence. questions: query_key, question."""
    return questions.select(query_key, F.filter(F.array_distinct(tokens(F.col("question"))), lambda t: ~t.isin(*V.QUESTION_NOISE)).alias("_q"))


def source_sentences(rows: DataFrame) -> DataFrame:
    """rows: title, text. In their place ``_title``, its terms, and ``_said``, the different sentences with their number of words and, with those of the title, their terms."""
    rows = rows.withColumn("_title", F.array_distinct(tokens(F.coalesce("title", F.lit("")))))
    trimmed = F.array_distinct(F.transform(sentences(F.col("text")), lambda x: F.btrim(x, F.lit(" -•"))))
    said = F.transform(trimmed, lambda x: F.struct(x.alias("sentence"), F.size(F.split(x, r"\s+")).alias("words"), F.array_union(tokens(x), F.col("_title")).alias("terms")))
    return rows.withColumn("_said", F.filter(said, lambda x: x["words"] >= 3)).drop("title", "text")


def scored_sentences(rows: DataFrame, most: int = 6, per_source: int = 2) -> DataFrame:
    """rows: key, origin, order (from 0), ``_q`` as in ``question_terms``, what ``source_sentences`` adds. ``best`` instead: of a source's different sentences that share a term the first
    ``most + per_source`` by score, negative, so that they sort. No later one is ever told: of these ``most`` at most are told by others, so ``per_source`` are left, or the answer is full."""
    kind = F.lit(False)
    for name, terms in V.RECORD_KIND_TERMS.items():
        kind = kind | (F.array_contains("_title", name) & F.arrays_overlap("_q", F.array(*[F.lit(t) for t in terms.split()])))
    rows = rows.withColumn("_kind", (F.col("origin") == "kv") & kind)
    shared = lambda x: F.size(F.array_intersect("_q", x["terms"])) / F.greatest(F.size("_q"), F.lit(1))
    met = F.transform("_said", lambda x: F.struct(x["sentence"].alias("sentence"), x["words"].alias("words"), shared(x).alias("o")))
    score = lambda x: F.when(x["o"] > 0, x["o"]).otherwise(0.5) + F.when(F.col("origin") == "kv", 0.25).otherwise(0.0) - 0.01 * F.col("order") - 0.001 * x["words"]
    some = F.transform(F.filter(met, lambda x: (x["o"] > 0) | F.col("_kind")), lambda x: F.struct((-F.round(score(x), 9)).alias("s"), x["sentence"].alias("sentence")))
    return rows.withColumn("best", F.slice(F.array_sort(some), 1, most + per_source)).drop("_title", "_kind", "_said", "_q")


def compose(questions: DataFrame, evidence: DataFrame, query_key: str, most: int = 6, per_source: int = 2) -> DataFrame:
    """(query_key, answer) of questions (query_key, question) from evidence: query_key, key, origin, title, text, order."""
    return composed(questions, scored_sentences(source_sentences(evidence.join(question_terms(questions, query_key), query_key)), most, per_source), query_key, most, per_source)


def composed(questions: DataFrame, scored: DataFrame, query_key: str, most: int = 6, per_source: int = 2) -> DataFrame:
    """(query_key, answer) from ``scored_sentences``. Best sentences first, two per source, none twice, six in all, told in source order.

    The greedy choice depends on what was chosen before, so it folds over a query's candidates; evidence is capped
    at ten items a query, which bounds them."""
    c = scored.select(query_key, "key", "order", F.explode("best").alias("b")).select(query_key, "key", "order", "b.s", "b.sentence")
    ranked = c.groupBy(query_key).agg(F.sort_array(F.collect_list(F.struct("s", "order", "key", "sentence"))).alias("xs"))
    none = F.filter("xs", lambda x: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        full = F.size(acc) >= most
        again = F.exists(acc, lambda y: y["sentence"] == x["sentence"])
        many = F.size(F.filter(acc, lambda y: y["key"] == x["key"])) >= per_source
        return F.when(full | again | many, acc).otherwise(F.array_append(acc, x))

    picked = F.aggregate("xs", none, step)
    told = F.transform(F.array_sort(F.transform(picked, lambda x: F.struct(x["order"].alias("order"), x["s"].alias("s"), x["key"].alias("key"), x["sentence"].alias("t")))), lambda x: x)
    end = lambda t: F.when(F.right(t, F.lit(1)).isin(".", "!", "?"), F.right(t, F.lit(1))).otherwise(F.lit("."))
    bare = lambda t: F.when(F.right(t, F.lit(1)).isin(".", "!", "?"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    lines = F.transform(told, lambda x: F.concat(bare(x["t"]), F.lit(" ["), x["key"], F.lit("]"), end(x["t"])))
    answered = ranked.select(query_key, F.concat_ws(" ", F.lit(V.OPENING), F.array_join(lines, " ")).alias("answer"))
    return questions.select(query_key).join(answered, query_key, "left").select(query_key, F.coalesce("answer", F.lit(V.INSUFFICIENT)).alias("answer"))
