"""Stored vectors and cached responses as sources."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from sparkloom.sources import cached
from sparkloom.sources.vector_store import StoredVectors

ROWS = "id string, namespace string, embedding array<float>, text string"


def files(path):
    return {os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(f"{path}/rows") for n in names if n.endswith(".parquet")}


def scanned(df):
    """Files and folders that the scan of a plan has read."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        plan.execute().count()
        leaf = plan.collectLeaves().apply(0)
        return leaf.metrics().apply("numFiles").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_upsert_rewrites_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "v")
    store = StoredVectors(spark, path, 4)
    assert store.fingerprint() is None and not store.fits({"dim": 2})
    rows = [(f"d{i}", f"ns{i % 3}", [float(i), 1.0], f"t{i}") for i in range(60)]
    store.create(spark.createDataFrame(rows, ROWS), {"dim": 2, "embedder": "x"})
    assert store.fits({"embedder": "x", "dim": 2}) and not store.fits({"embedder": "y", "dim": 2})
    first = files(path)
    assert len(first) == len({f.rsplit("/", 1)[0] for f in first}) == 12  # one file for each folder
    as_set = lambda df: {(r.id, r.namespace, tuple(r.embedding), r.text) for r in df.collect()}
    exp = {(i, n): (i, n, tuple(e), t) for i, n, e, t in rows}
    assert as_set(store.rows()) == set(exp.values()) and store.rows().columns == ["id", "namespace", "embedding", "text"]

    new = [("d0", "ns0", [9.0, 9.0], "new"), ("fresh", "ns0", [1.0, 2.0], None), ("d0", "ns0", [5.0, 5.0], "old")]
    changed = store.upsert(spark.createDataFrame([(*r, s) for r, s in zip(new, (2, 1, 1), strict=True)], ROWS + ", seq int"))
    exp |= {(r[0], r[1]): (r[0], r[1], tuple(r[2]), r[3]) for r in new[:2]}
    second = files(path)
    assert as_set(store.rows()) == set(exp.values())
    assert {f.rsplit("/", 1)[0] for f in first ^ second} <= {f"rows/namespace=ns0/bucket={b}" for b in range(4)} and len(first - second) == changed <= 2

    gone = store.rows(["ns1"]).select("id", "namespace")
    bucket = gone.select(store.bucket(F.col("id"))).first()[0]
    keys = gone.where(store.bucket(F.col("id")) == bucket)
    names = {r.id for r in keys.collect()}
    assert store.delete(keys) == 1
    exp = {k: v for k, v in exp.items() if not (k[1] == "ns1" and k[0] in names)}
    assert as_set(store.rows()) == set(exp.values()) and not os.path.exists(f"{path}/rows/namespace=ns1/bucket={bucket}")
    assert store.delete(spark.createDataFrame([("nobody", "ns2")], "id string, namespace string")) == 1 and store.rows().count() == len(exp)


def test_a_search_reads_its_folders_only(spark, tmp_path):
    store = StoredVectors(spark, str(tmp_path / "v"), 4)
    store.create(spark.createDataFrame([(f"d{i}", f"ns{i % 3}", [float(i)], "") for i in range(60)], ROWS))
    assert scanned(store.rows()) == 12 and scanned(store.rows(["ns1"])) == 4 and scanned(store.rows(["ns1", "none"], ["d1"])) == 1
    assert [r.id for r in store.rows(ids=["d7", "nobody"]).collect()] == ["d7"]


def body(*results):
    return json.dumps({"results": list(results)})


def label(names, route="ORAL", rx=True, dose=True, time="20240101", set_id="s", **more):
    out = {"openfda": {"generic_name": names, "route": [route], "product_type": ["HUMAN PRESCRIPTION DRUG" if rx else "HUMAN OTC DRUG"], "brand_name": ["ZED", "abc"], "rxcui": ["2", "1", "2"]}, "set_id": set_id, "effective_time": time, "version": "3", "indications_and_usage": ["Used for things."]}
    return out | ({"dosage_and_administration": ["2 DOSAGE AND ADMINISTRATION Take one tablet. Then rest."]} if dose else {}) | more


def test_cached_responses_have_a_status_each(spark, tmp_path):
    (tmp_path / "metformin.json").write_text(body(label(["METFORMIN"])))
    (tmp_path / "warfarin.json").write_text('{"results": [')
    (tmp_path / "latin.json").write_bytes(b'{"a": "\xff"}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "notes.txt").write_text("{}")
    rows = cached.read_cached(spark, str(tmp_path), ["metformin", "apixaban"])
    got = {r.name: (r.status, r.bytes) for r in rows.collect()}
    assert got == {"metformin": ("ok", len(body(label(["METFORMIN"])))), "apixaban": ("missing", None), "warfarin": ("broken", 13), "latin": ("broken", 10), "empty": ("broken", 0)}
    one = rows.where("name = 'warfarin'")
    assert [(r.name, r.status) for r in one.collect()] == [("warfarin", "broken")]
    assert {r.name for r in rows.where(F.col("name").isin("metformin", "latin", "nobody") & (F.col("status") == "ok")).collect()} == {"metformin"}
    for k in range(40):
        (tmp_path / f"x{k}.json").write_text("{}")
    rows = cached.read_cached(spark, str(tmp_path), ["metformin", "apixaban"])
    assert rows.rdd.getNumPartitions() == 3 and rows.where("name = 'x7'").rdd.getNumPartitions() == 1  # no other file is opened
    assert cached.read_cached(spark, str(tmp_path / "nowhere")).count() == 0
    assert cached.read_cached(spark, "file://" + str(tmp_path)).where("status = 'ok'").count() == 41


def test_labels_of_cached_responses(spark, tmp_path):
    long = "Sentence of a long section that goes on. " * 120
    (tmp_path / "metformin.json").write_text(body(
        label(["METFORMIN", "SITAGLIPTIN AND METFORMIN"], route="TOPICAL", time="20260101", set_id="route"), label(["SITAGLIPTIN AND METFORMIN HYDROCHLORIDE"], time="20270101", set_id="other"),
        label(["METFORMIN HYDROCHLORIDE"], dose=False, time="20270101", set_id="no dose"), label(["Metformin Hydrochloride"], time="20230101", set_id="early"), label(["Metformin, hydrochloride"], time="20240101", set_id="best", warnings=[long], contraindications=["x " * 3000], boxed_warning=[]),
        label(["METFORMIN"], rx=False, time="20280101", set_id="otc"), {"set_id": "bare"},
    ))
    (tmp_path / "nothing.json").write_text('{"error": {"code": "NOT_FOUND"}}')
    drugs = spark.createDataFrame([("metformin", "metformin hydrochloride", "oral"), ("nothing", "nothing", None), ("absent", "absent", None)], "name string, generic string, route string")
    rows = cached.labels(cached.read_cached(spark, str(tmp_path)), drugs)
    [r] = rows.collect()
    assert (r.drug, r.set_id, r.generic_name, r.brand_names, r.rxcuis, r.route, r.label_version) == ("metformin", "best", "metformin, hydrochloride", ["Abc", "Zed"], ["1", "2"], ["oral"], "3")
    sections = dict((s.title, s.body) for s in r.sections)
    assert list(sections) == ["Indications and usage", "Dosage and administration", "Contraindications", "Warnings"]
    assert sections["Warnings"].endswith("goes on. [truncated]")
    assert len(sections["Contraindications"]) == 3500 + len(" [truncated]") and 2100 < len(sections["Warnings"]) <= 3500 + len(" [truncated]")
    chunks = cached.label_chunks(rows).orderBy("id").collect()
    dose = next(c for c in chunks if c.section == "Dosage and administration")
    assert dose.id == "label:metformin#dosage-and-administration#0" and dose.text == "Take one tablet. Then rest." and dose.embed == "metformin label | Dosage and administration | Take one tablet. Then rest."
    assert {c.drug for c in chunks} == {"metformin"} and {c.namespace for c in chunks} == {"drug_labels"} and len({c.id for c in chunks}) == len(chunks)
