"""From recognised entities to records, and from source ids back to what they name.

Tables of keys (key, value), as in ``kv``. Every lookup of a batch of questions is an equi-join on keys or on subjects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from .kv import kind_of
from .records import sentence

MOST = 24


def with_record(kv: DataFrame) -> DataFrame:
    """Rows of a key table with ``subject``, ``kind``, ``data`` (a map), ``title`` and ``text`` (the sentence that states them)."""
    kind = kind_of(F.col("key"))
    parts = F.split("key", ":")
    subject = F.when(parts[0] == "patient", F.get(parts, F.lit(1)))
    rows = kv.withColumn("data", F.from_json("value", "map<string,string>")).withColumn("kind", kind).withColumn("subject", subject)
    title = F.concat_ws(" ", F.col("kind"), F.coalesce(F.element_at("data", "lab"), F.element_at("data", "drug"), F.element_at("data", "name")))
    return rows.withColumn("title", title).withColumn("text", sentence(F.col("kind"), F.col("data"), F.coalesce("subject", F.lit(""))))


def of_subject(kv: DataFrame, subject: str, kinds: list[str] | None = None) -> DataFrame:
    """Rows of one subject and of no longer id that begins like it, of some kinds if given."""
    pre = f"patient:{subject}"
    rows = kv.where((F.col("key") == pre) | F.col("key").startswith(pre + ":"))
    return rows if kinds is None else rows.where(kind_of(F.col("key")).isin(*kinds))


def search_summaries(subjects: DataFrame, needle: str, limit: int) -> DataFrame:
    """subjects: patient_id, name, conditions (array). Those whose id, name or conditions hold the text, first ids first."""
    text = F.lower(F.concat_ws(" ", "patient_id", "name", F.array_join("conditions", " ")))
    return subjects.where(text.contains(needle.lower())).orderBy("patient_id").limit(limit)


def records_for(asked: DataFrame, kv: DataFrame, most: int = MOST) -> DataFrame:
    """asked: qid, scope, icd10_codes, rxnorm_codes, drugs, labs, conditions, record_types (arrays), start, stop (dates as text), latest_only.

    (qid, seq, key): code rows first; without a scope then the named drugs; with one the named labs (the latest, those of a range,
    or the last three), each named drug's own and general row, conditions by name, sections by record type, or, if nothing of these
    is named, an overview. A key counts where it is first met; ``most`` records at most."""
    pos = lambda column, *more: F.posexplode(F.transform(column, lambda x: F.struct(x.alias("x"), *more)))
    rows = with_record(kv).select("key", "subject", "kind", "data")
    plain = lambda df, step, key: df.select("qid", F.lit(step).alias("step"), F.col("pos").alias("a"), F.lit("").alias("b"), key.alias("key"))
    parts = [
        plain(asked.select("qid", pos("icd10_codes")), 1, F.concat(F.lit("icd10:"), F.col("col.x"))),
        plain(asked.select("qid", pos("rxnorm_codes")), 2, F.concat(F.lit("rxcui:"), F.col("col.x"))),
        plain(asked.where("scope is null").select("qid", pos("drugs")), 3, F.concat(F.lit("drug:"), slug(F.col("col.x")))),
        plain(asked.where("scope is not null").select("qid", pos("drugs")), 5, F.concat(F.lit("drug:"), slug(F.col("col.x")))).withColumn("b", F.lit("1")),
        asked.where("scope is not null").select("qid", "scope", pos("drugs")).select("qid", F.lit(5).alias("step"), F.col("pos").alias("a"), F.lit("0").alias("b"), F.concat(F.lit("patient:"), F.col("scope"), F.lit(":med:"), slug(F.col("col.x"))).alias("key")),
    ]
    named = reduce(DataFrame.unionByName, parts).join(kv.select("key"), "key", "left_semi")
    # What belongs to the subject in scope. Places in a series are counted once for each subject; a question meets the kinds that it asks for, of a series no more rows than any question may
    # name by place. Labs of a range are met by subject and lab.
    date = F.coalesce(F.element_at("data", "date"), F.lit(""))
    lab, kind, types = F.element_at("data", "lab"), F.col("kind"), F.col("record_types")
    newest = Window.partitionBy("scope", "kind", F.when(kind == "lab", lab)).orderBy(F.desc("date"), F.desc("key"))
    newest_first = F.concat(F.lpad((F.lit(99999999) - F.coalesce(F.replace("date", F.lit("-"), F.lit("")).try_cast("int"), F.lit(0))).cast("string"), 8, "0"), F.col("key"))
    held = rows.where("subject is not null").withColumnRenamed("subject", "scope").withColumn("date", date).withColumn("nth", F.row_number().over(newest))
    about = asked.where("scope is not null")
    none = (F.size("labs") == 0) & (F.size("drugs") == 0) & (F.size("conditions") == 0) & (F.size("record_types") == 0)
    meets = {
        "demographics": none | F.array_contains(types, "demographics"), "condition": none | (F.size("conditions") > 0) | F.array_contains(types, "conditions"), "allergy": none | F.array_contains(types, "allergies"),
        "medication": none | F.array_contains(types, "medications"), "lab": (F.size("labs") > 0) | F.array_contains(types, "labs"), "encounter": F.array_contains(types, "encounters"),
    }
    kinds = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in meets.items()]))).alias("kind")
    scoped = about.select("*", kinds).join(held.where(~kind.isin("lab", "encounter") | (F.col("nth") <= 5)), ["scope", "kind"])
    name = F.lower(F.concat_ws(" ", F.element_at("data", "key"), F.element_at("data", "name")))
    ranged = ~F.coalesce("latest_only", F.lit(False)) & F.col("start").isNotNull()
    wanted_lab = (kind == "lab") & F.array_contains("labs", lab) & ~ranged & (F.col("nth") <= F.when(F.col("latest_only"), 1).otherwise(3))
    section = (
        (F.array_contains(types, "labs") & (kind == "lab") & (F.col("nth") == 1)) | (F.array_contains(types, "encounters") & (kind == "encounter") & (F.col("nth") <= 5))
        | (F.array_contains(types, "medications") & (kind == "medication")) | (F.array_contains(types, "conditions") & (kind == "condition"))
        | (F.array_contains(types, "allergies") & (kind == "allergy")) | (F.array_contains(types, "demographics") & (kind == "demographics"))
    )
    overview = none & (kind.isin("demographics", "condition", "allergy") | ((kind == "medication") & (F.element_at("data", "status") == "active")))
    order = F.array_position(F.array(*[F.lit(k) for k in ("demographics", "condition", "medication", "allergy", "lab", "encounter")]), kind).cast("int")
    step = lambda test, n, a, b: F.when(test, F.struct(F.lit(n).alias("step"), a.cast("int").alias("a"), b.alias("b")))
    steps = F.array_compact(F.array(
        step(wanted_lab, 4, F.array_position("labs", lab), newest_first),
        step((kind == "condition") & F.exists("conditions", lambda c: name.contains(c)), 6, F.lit(0), F.col("key")),
        step(section, 7, order, newest_first), step(overview, 8, order, F.col("key")),
    ))
    own = scoped.select("qid", "key", F.explode(steps).alias("s")).select("qid", F.col("s.step").alias("step"), F.col("s.a").alias("a"), F.col("s.b").alias("b"), "key")
    spans = about.where(ranged).select("qid", "scope", "start", "stop", pos("labs")).select("qid", "scope", "start", "stop", (F.col("pos") + 1).alias("a"), F.col("col.x").alias("lab"))
    series = held.where(kind == "lab").select("scope", lab.alias("lab"), "date", newest_first.alias("b"), "key")
    within = spans.join(series, ["scope", "lab"]).where(F.col("date").between(F.col("start"), F.col("stop")))
    # Behind the first ``most`` of a lab none is among the first of a question.
    within = within.withColumn("n", F.row_number().over(Window.partitionBy("qid", "a").orderBy("b"))).where(F.col("n") <= most)
    own = own.unionByName(within.select("qid", F.lit(4).alias("step"), "a", "b", "key"))
    first = named.unionByName(own).groupBy("qid", "key").agg(F.min(F.struct("step", "a", "b")).alias("at"))
    seq = F.row_number().over(Window.partitionBy("qid").orderBy("at", "key"))
    return first.select("qid", "key", seq.alias("seq")).where(F.col("seq") <= most)


def namespace_predicate(namespace: Column, drug: Column, date_num: Column, drugs: Column, start: Column, stop: Column) -> Column:
    """Whether a passage may answer: labels must be of a named drug if any is, notes must lie in the asked range (numbers like 20240131)."""
    labels = (F.size(drugs) == 0) | F.array_contains(drugs, drug)
    notes = (start.isNull() | (date_num >= start)) & (stop.isNull() | (date_num <= stop))
    return F.coalesce(F.when(namespace == "drug_labels", labels).when(namespace == "patient_notes", notes).otherwise(F.lit(True)), F.lit(False))


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """A chunk's metadata map overlaid by its own columns, as one flat row."""
    own = F.map_filter(F.create_map(*[x for c in ("doc_id", "section", "title", "patient_id") for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    rest = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(own, k))
    return chunks.select("chunk_id", F.map_concat(rest, own).alias("metadata"))


def resolve_sources(asked: DataFrame, kv: DataFrame, documents: DataFrame) -> DataFrame:
    """asked: source_id. (source_id, kind, namespace, content): ``kv:`` ids name a key, ``vec:`` ids a chunk of a document, whose
    namespace is the first part of its id; unknown ids and all others get a null content."""
    ids = asked.select("source_id").distinct()
    is_kv, is_vec = F.col("source_id").startswith("kv:"), F.col("source_id").startswith("vec:")
    rest = F.when(is_kv, F.substr("source_id", F.lit(4))).when(is_vec, F.split_part(F.substr("source_id", F.lit(5)), F.lit("#"), F.lit(1)))
    known = kv.select(F.lit("kv").alias("kind"), F.col("key").alias("id"), F.col("value").alias("content")).unionByName(documents.select(F.lit("vec").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("content")))
    spaces = F.create_map(*[F.lit(x) for x in ("note", "patient_notes", "label", "drug_labels", "topic", "guidelines")])
    wanted = ids.withColumn("kind", F.when(is_kv, "kv").when(is_vec, "vec").otherwise("unknown")).withColumn("id", rest)
    return wanted.join(known, ["kind", "id"], "left").select("source_id", "kind", F.when(F.col("kind") == "vec", F.element_at(spaces, F.split_part("id", F.lit(":"), F.lit(1)))).alias("namespace"), "content")


def documents_of(documents: DataFrame, subject: str) -> DataFrame:
    """Notes of one subject by their id, ``note:{subject}:...``."""
    return documents.where(F.col("doc_id").startswith(f"note:{subject}:"))
