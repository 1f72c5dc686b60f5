"""Readers and writers: JSON lines, XML topics, fixed-width codes, manifests, audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; a missing file has none, blank lines are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line, keys sorted."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)


def read_topics(spark: SparkSession, path: str, organisation: str | None = None) -> DataFrame:
    """Health topics of an XML file (rowTag health-topic)."""
    schema = "_id long, _title string, _url string, `also-called` array<string>, `full-summary` string, `_language` string, `_organization` string"
    topics = spark.read.format("xml").option("rowTag", "health-topic").schema(schema).load(path)
    if organisation:
        topics = topics.where(F.col("_organization") == organisation)
    from ..functions.text import strip_html

    return topics.select(F.col("_id").alias("topic_id"), F.col("_title").alias("title"), F.col("_url").alias("url"), F.col("also-called").alias("also_called"), strip_html(F.col("full-summary")).alias("summary"))


def icd_dotted(code: Column) -> Column:
    bare = F.trim(code)
    return F.when(F.length(bare) > 3, F.concat_ws(".", F.substring(bare, 1, 3), F.substr(bare, F.lit(4)))).otherwise(bare)


def read_icd(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width file: eight characters of code, then the name."""
    line = F.col("value")
    return spark.read.text(path).where(F.trim(line) != "").select(icd_dotted(F.substring(line, 1, 8)).alias("code"), F.trim(F.substr(line, F.lit(9))).alias("name"))


def compare_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Per listed file (name, sha256, licence) against what is there (name, found): ok, missing, changed, or no_licence."""
    joined = manifest.join(found, "name", "left")
    return joined.select("name", F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed").when(F.coalesce(F.trim("licence"), F.lit("")) == "", "no_licence").otherwise("ok").alias("status"))


def verify_manifest(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest against the files of a folder."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return compare_manifest(manifest, files)


def salted_hash(salt: str, value: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), 1, 16)


def append_audit(rows: DataFrame, path: str, salt: str, hidden: list[str]) -> None:
    rows.withColumns({c: salted_hash(salt, F.col(c)) for c in hidden}).write.mode("append").json(path)


def audit_tail(spark: SparkSession, path: str, schema: str, at: str, n: int) -> DataFrame:
    return spark.read.schema(schema).json(path).orderBy(F.desc(at)).limit(n)
