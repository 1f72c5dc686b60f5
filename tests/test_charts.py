"""Charts: eight kinds of files that parse back to their rows, and a manifest that tells what was written."""

from __future__ import annotations

import glob
import hashlib
import os

from pyspark.sql import functions as F

from sparkloom.sources import charts

SUBJECTS = (
    "patient_id string, name string, sex string, birth_date string, conditions array<struct<name:string,icd10:string,status:string,onset:string>>, medications array<struct<drug:string,dose:string,frequency:string,indication:string,rxcui:string,start:string,status:string,stop:string,stop_reason:string>>, "
    "allergies array<struct<substance:string,reaction:string,severity:string>>, labs array<struct<lab:string,value:double,unit:string,date:string,flag:string>>, encounters array<struct<encounter_id:string,date:string,type:string,reason:string>>"
)
NOTES = "patient_id string, encounter_id string, date string, type string, title string, text string"


def test_charts_parse_back_and_match_their_manifest(spark, tmp_path):
    labs = [("hemoglobin a1c", 5.0 + i / 10, "%", f"20{10 + i // 12:02d}-{i % 12 + 1:02d}-05", "high" if i % 3 else None) for i in range(30)]
    subjects = spark.createDataFrame(
        [("P0001", "Ada  Example", "female", "1960-05-06", [("gerd", "K21.9", "active", "2001-01-01"), ("line\nbreak", None, "resolved", None)], [("aspirin", "75 mg", "daily", "pain", "1191", "2020-01-01", "stopped", "2021-01-01", "bled"), ("metformin", "500 mg", "twice", None, "6809", "2019-01-01", "active", None, None)], [("nuts", "rash", "mild")], labs, [("E1", "2024-03-04", "visit", "cough"), ("E2", "2025-03-04", "visit", "check")]),
         ("P0002", "Bo", "male", "1990-01-01", [], None, [], [], [])],
        SUBJECTS,
    )
    notes = spark.createDataFrame([("P0001", "E1", "2024-03-04", "progress note", "Visit", "First line.\n\nSecond line.  "), ("P0001", "E2", "2025-03-04", "progress note", "Check", "- Diagnosis: not a record\nFine.")], NOTES)
    path = str(tmp_path / "out")
    manifest = charts.write_charts(subjects, notes, path).collect()
    there = {os.path.relpath(f, f"{path}/patients") for f in glob.glob(f"{path}/patients/*/*/part-*")}
    assert len(manifest) == len(there) == 7 + 2 + 7  # seven kinds each, and the notes of one
    by = {(m.patient_id, m.file): m for m in manifest}
    for f in there:
        raw = open(f"{path}/patients/{f}", "rb").read()
        m = by[tuple(p.split("=")[1] for p in f.split("/")[:2])]
        assert (m.bytes, m.sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {r.status for r in charts.verify(spark, path).collect()} == {"ok"}

    text = {(r.patient_id, r.file): r.text for r in charts.texts(spark, path).collect()}
    assert text["P0001", "notes_2024-03-04_E1_progress_note"] == "First line.\n\nSecond line.\n"
    read = charts.texts(spark, path)
    one = lambda file, column: read.where((F.col("file") == file) & (F.col("patient_id") == "P0001")).select(column.alias("x")).first().x
    got = one("conditions", charts.parse_records(F.col("text"), "Diagnosis"))
    assert [(c["Diagnosis"], c["ICD 10 CM"], c["Status"], c["Onset Date"]) for c in got] == [("gerd", "K21.9", "active", "2001-01-01"), ("line break", "N/A", "resolved", "N/A")]
    meds = one("medications", charts.parse_records(F.col("text"), "Drug"))
    assert [(m["Drug"], m["Status"], m["Stop Reason"], m["Indication"]) for m in meds] == [("metformin", "Active", "N/A", "N/A"), ("aspirin", "Discontinued", "bled", "pain")]
    assert [a["Substance"] for a in one("allergies", charts.parse_records(F.col("text"), "Substance"))] == ["nuts"]
    assert [e["Encounter"] for e in one("encounters", charts.parse_records(F.col("text"), "Date"))] == ["E2", "E1"]
    back = one("labs", charts.parse_labs(F.col("text")))
    assert [(r.date, r.lab, float(r.value), r.unit, r.flag) for r in back] == [(d, n, v, u, f or "normal") for n, v, u, d, f in sorted(labs, key=lambda x: x[3], reverse=True)]
    assert "Age: 64\n" in text["P0001", "demographics"] and "Full Name: Ada Example\n" in text["P0001", "demographics"]

    chart = text["P0001", "chart"]
    at = [chart.index(h) for h in charts.HEADINGS.values()]
    assert at == sorted(at) and chart.endswith("[END OF CHART]\n") and "[9 earlier laboratory readings" in chart and chart.count("hemoglobin a1c") == 21
    assert "First line." in chart and text["P0002", "medications"].endswith("None documented.\n") and "No laboratory records" in text["P0002", "chart"]

    os.remove(f"{path}/patients/{min(there)}")
    victim = max(there)
    with open(f"{path}/patients/{victim}", "a") as f:
        f.write("more")
    crc = os.path.join(os.path.dirname(f"{path}/patients/{victim}"), "." + os.path.basename(victim) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert sorted(r.status for r in charts.verify(spark, path).collect() if r.status != "ok") == ["changed", "missing"]
