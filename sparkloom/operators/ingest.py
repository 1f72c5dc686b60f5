"""Loading: reference rows and notes to the key table, passages to the vector table, and the gate that skips unchanged input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import core_name, slug
from .vectors import upsert


def _row(key: Column, value: Column) -> list[Column]:
    return [key.alias("key"), F.to_json(value).alias("value"), F.lit(None).cast("double").alias("expires_at")]


def icd_rows(codes: DataFrame) -> DataFrame:
    """codes: code, name."""
    return codes.select(*_row(F.concat(F.lit("icd10:"), F.col("code")), F.struct("code", "name")))


def label_rows(labels: DataFrame) -> DataFrame:
    """labels: drug, generic_name, rxcui, rxcuis (array). Two rows of a label, by name and by identifier; without its own identifier
    the first listed one counts, and without any there is no second row."""
    rx = F.coalesce(F.nullif("rxcui", F.lit("")), F.get("rxcuis", F.lit(0)))
    x = labels.withColumn("rxcui", rx)
    data = F.struct("generic_name", F.col("drug").alias("name"), "rxcui")
    by_name = x.select(*_row(F.concat(F.lit("drug:"), slug(F.col("drug"))), data))
    return by_name.unionByName(x.where("rxcui is not null").select(*_row(F.concat(F.lit("rxcui:"), F.col("rxcui")), data)))


def note_rows(notes: DataFrame) -> DataFrame:
    """notes: doc_id, patient_id, title, text. A row for each document, and the number of notes of every subject."""
    docs = notes.select(*_row(F.concat(F.lit("doc:note:"), "patient_id", F.lit(":"), F.col("doc_id").cast("string")), F.struct("text", "title")))
    counts = notes.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.unionByName(counts.select(*_row(F.concat(F.lit("meta:notes:"), "patient_id"), F.struct("n"))))


def best_labels(candidates: DataFrame, salts: tuple[str, ...]) -> DataFrame:
    """candidates: drug, generic_name, route_ok, has_rx, has_dose, effective_time, set_id. The label of each drug: of those whose
    name without salt words is the drug, the best by route, identifier, dose section and date."""
    w = Window.partitionBy("drug").orderBy(F.desc("route_ok"), F.desc("has_rx"), F.desc("has_dose"), F.desc("effective_time"), "set_id")
    exact = candidates.where(core_name(F.col("generic_name"), salts) == F.lower("drug"))
    return exact.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_identifier(answer: Column) -> Column:
    """The first id of an identifier service's JSON answer, or null."""
    return F.get(F.from_json(F.get_json_object(answer, "$.idGroup.rxnormId"), "array<string>"), F.lit(0))


#: Hex digits by which digests are put together, level by level: no level joins more than a few hundred, whatever the number of inputs.
FINGERPRINT_LEVELS = (5, 3, 1, 0)


def fingerprint_row(parts: DataFrame, name: str, digest: str, *settings: str) -> DataFrame:
    """(fingerprint): 24 hex digits of all listed inputs and the settings, as a tree of digests: inputs by the first digits of their own, these groups by fewer, up to one. Null
    digests count as empty; no inputs have the fingerprint of an empty list."""
    level = parts.select(F.sha2(F.concat_ws("=", name, digest), 256).alias("h"))
    level = level.withColumn("p", F.col("h"))
    for n in FINGERPRINT_LEVELS:
        joined = F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h")
        level = level.groupBy(F.substring("p", 1, n).alias("p")).agg(joined) if n else level.agg(joined)
    return level.select(F.substring(F.sha2(F.concat_ws("|", "h", *[F.lit(s) for s in settings]), 256), 1, 24).alias("fingerprint"))


def fingerprint(parts: DataFrame, name: str, digest: str, *settings: str) -> str:
    return fingerprint_row(parts, name, digest, *settings).first()[0]


def load_if_changed(spark: SparkSession, path: str, found: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table below ``path`` if it was built from input with this fingerprint, else the table built anew; and whether it was."""
    from ..sources.files import _exists

    done = f"{path}/{found}"
    if _exists(spark, f"{done}/_SUCCESS"):
        return spark.read.parquet(done), False
    build().write.mode("overwrite").parquet(done)
    return spark.read.parquet(done), True


def embed_upsert(table: DataFrame, passages: DataFrame, embed: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """The vector table with the passages' rows put in; ``embed`` maps (key, text) to (key, embedding) batch by batch. The texts
    stay if the table has a column for them."""
    new = (passages if "text" in table.columns else passages.drop("text")).join(embed(passages.select(key, "text")), key).withColumn("seq", F.lit(0))
    return upsert(table, new.select(*table.columns, "seq"), key)
