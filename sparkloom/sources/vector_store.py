"""Vectors as files: a folder for each namespace and bucket of ids, so that an upsert rewrites the buckets that it touches and a search in a namespace
reads no other. Beside them stands the fingerprint of what they were made with."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .files import _exists
from .shared import saved


@dataclass
class StoredVectors:
    """Rows (id, namespace, ...) below ``path``; an id is unique in its namespace."""

    spark: SparkSession
    path: str
    buckets: int = 16

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> None:
        # One task for each bucket: one file each, however many tasks the rows come from.
        dealt = rows.withColumn("bucket", self.bucket(F.col("id"))).repartition("namespace", "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace", "bucket").parquet(f"{self.path}/rows")

    def create(self, rows: DataFrame, fingerprint: dict | None = None) -> None:
        """A new table in place of what is there; the fingerprint is written last, so a table with one is whole."""
        for part in ("rows", "fingerprint"):
            self._remove(part)
        self._write(rows)
        self.spark.createDataFrame([(json.dumps(fingerprint or {}, sort_keys=True), rows.drop("bucket").schema.json())], "fingerprint string, kinds string").coalesce(1).write.mode("overwrite").json(f"{self.path}/fingerprint")

    def fingerprint(self) -> dict | None:
        """What the table was made with, or null if there is none or it is not whole."""
        done = _exists(self.spark, f"{self.path}/fingerprint/_SUCCESS")
        return json.loads(self.spark.read.schema("fingerprint string").json(f"{self.path}/fingerprint").first()[0]) if done else None

    def fits(self, wanted: dict) -> bool:
        """Whether the table holds what this fingerprint describes; else it must be made anew."""
        return self.fingerprint() == json.loads(json.dumps(wanted))

    def _table(self) -> tuple[DataFrame, list[str]]:
        """The files with ``bucket``, and the columns of a row."""
        kinds = StructType.fromJson(json.loads(self.spark.read.schema("kinds string").json(f"{self.path}/fingerprint").first()[0]))
        parted = StructType([*[f for f in kinds if f.name != "namespace"], kinds["namespace"], StructField("bucket", IntegerType())])
        return self.spark.read.schema(parted).parquet(f"{self.path}/rows"), kinds.fieldNames()

    def rows(self, namespaces: list[str] | None = None, ids: list | None = None) -> DataFrame:
        """All rows, or those of some namespaces or ids: the scan reads no other folders."""
        out, columns = self._table()
        if namespaces is not None:
            out = out.where(F.col("namespace").isin(*namespaces))
        if ids is not None:
            wanted = self.spark.createDataFrame([(i,) for i in ids], f"id {dict(out.dtypes)['id']}")
            buckets = [r[0] for r in wanted.select(self.bucket(F.col("id"))).distinct().collect()]
            out = out.where(F.col("bucket").isin(*buckets) & F.col("id").isin(*ids))
        return out.select(*columns)

    def upsert(self, new: DataFrame) -> int:
        """Put rows in; of several with one id and namespace the last by ``seq`` counts, if there is such a column. Returns the number of folders rewritten."""
        if "seq" in new.columns:
            w = Window.partitionBy("namespace", "id").orderBy(F.desc("seq"))
            new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "seq")
        new = saved(new, "new")
        folders = self._folders(new)
        stay = saved(self._in(folders).join(new.select("namespace", "id"), ["namespace", "id"], "left_anti"), "stay")
        self._write(stay.unionByName(new.select(*stay.columns)))
        return len(folders)

    def delete(self, keys: DataFrame) -> int:
        """Take rows (id, namespace) out. Returns the number of folders rewritten; one that is left empty goes."""
        keys = saved(keys.select("namespace", "id").distinct(), "keys")
        folders = self._folders(keys)
        stay = saved(self._in(folders).join(keys, ["namespace", "id"], "left_anti"), "stay")
        left = self._folders(stay)
        self._write(stay)
        for space, bucket in folders - left:
            self._remove(f"rows/namespace={space}/bucket={bucket}")
        return len(folders)

    def _folders(self, keys: DataFrame) -> set[tuple[str, int]]:
        """(namespace, bucket) of keys: as many as there are folders at most."""
        return {(r.namespace, r.bucket) for r in keys.select("namespace", self.bucket(F.col("id")).alias("bucket")).distinct().collect()}

    def _in(self, folders: set[tuple[str, int]]) -> DataFrame:
        table, columns = self._table()
        test = F.lit(False)
        for space in sorted({n for n, _ in folders}):
            test = test | ((F.col("namespace") == space) & F.col("bucket").isin(*sorted(b for n, b in folders if n == space)))
        return table.where(test).select(*columns)

    def _remove(self, part: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
