"""Text charts: a folder for each subject with eight kinds of readable files, written in one pass, and the manifest of what was written.

An artefact is many short rows, ordered by section and place, never one long value: files are written row by row, so a subject with very many results or
notes is a long file but no large group. Files: demographics, conditions, medications, allergies, labs, encounters, one for each note, and the chart of all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..operators.records import age_on
from .files import compare_manifest

#: Results that a chart shows before it refers to the file of all of them.
SHOWN = 21
HEADINGS = {
    "demographics": "PATIENT IDENTIFICATION & DEMOGRAPHICS", "allergies": "ALLERGIES & ADVERSE REACTIONS", "conditions": "DOCUMENTED CONDITIONS & PROBLEM LIST", "medications": "PHARMACOTHERAPY & MEDICATION REGIMEN",
    "labs": "LONGITUDINAL LABORATORY TEST RESULTS", "encounters": "CLINICAL ENCOUNTERS & CONSULTATIONS", "notes": "CLINICAL NARRATIVE PROGRESS NOTES",
}
EMPTY = {
    "conditions": "No chronic medical conditions documented.", "allergies": "No known drug allergies (NKDA) documented.", "labs": "No laboratory records documented.", "encounters": "No encounter records documented.",
    "notes": "No narrative progress notes documented.", "medications": "None documented.",
}
SECTIONS = list(HEADINGS)


def _plain(value: Column) -> Column:
    """A value on one line; what is missing is N/A."""
    return F.coalesce(F.nullif(collapse(value.cast("string")), F.lit("")), F.lit("N/A"))


def _record(**fields: Column) -> Column:
    """``- First: value`` and indented lines for the other fields, as one text of a few lines."""
    lines = [F.concat(F.lit(f"{'- ' if k == 0 else '  '}{name.replace('_', ' ')}: "), _plain(value)) for k, (name, value) in enumerate(fields.items())]
    return F.concat_ws("\n", *lines)


def _rows(df: DataFrame, section: str, order: Column, value: Column) -> DataFrame:
    return df.select("patient_id", F.lit(section).alias("section"), F.lit(1).alias("kind"), order.cast("string").alias("place"), value.alias("value"))


def lines(subjects: DataFrame, notes: DataFrame) -> DataFrame:
    """(patient_id, section, kind, place, value): the rows of all sections. kind 0 is the heading, 1 a record, in the order of ``place``.

    subjects: patient_id, name, sex, birth_date and arrays of structs conditions, medications, allergies, labs, encounters. notes: patient_id, encounter_id, date, type, title, text."""
    each = lambda column: subjects.select("patient_id", F.posexplode(column).alias("i", "x"))
    x = lambda name: F.col(f"x.{name}")
    nth = F.lpad(F.col("i").cast("string"), 9, "0")
    newest_first = F.concat(F.lpad((F.lit(99999999) - F.coalesce(F.replace(x("date"), F.lit("-"), F.lit("")).try_cast("int"), F.lit(0))).cast("string"), 8, "0"), nth)
    last = F.array_max(F.transform("encounters", lambda e: e["date"]))
    age = age_on(F.col("birth_date").cast("date"), F.coalesce(last.cast("date"), F.current_date()))
    person = F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), _plain(v)) for name, v in (("Patient ID", F.col("patient_id")), ("Full Name", F.col("name")), ("Date of Birth", F.col("birth_date")), ("Age", age), ("Biological Sex", F.initcap("sex")), ("Last Encounter", last))])
    stopped = F.when(x("status") == "active", F.lit("0")).otherwise("1")
    cell = lambda value, width: F.rpad(F.replace(_plain(value), F.lit("|"), F.lit("/")), width, " ")
    parts = [
        _rows(subjects, "demographics", F.lit(""), person),
        _rows(each("conditions"), "conditions", nth, _record(Diagnosis=x("name"), ICD_10_CM=x("icd10"), Status=x("status"), Onset_Date=x("onset"))),
        _rows(each("medications"), "medications", F.concat(stopped, nth), _record(Drug=x("drug"), Dose=x("dose"), Frequency=x("frequency"), Indication=x("indication"), RxCUI=x("rxcui"), Start_Date=x("start"), Status=F.when(x("status") == "active", "Active").otherwise("Discontinued"), Stop_Date=x("stop"), Stop_Reason=x("stop_reason"))),
        _rows(each("allergies"), "allergies", nth, _record(Substance=x("substance"), Reaction=x("reaction"), Severity=x("severity"))),
        _rows(each("labs"), "labs", newest_first, F.concat_ws(" | ", cell(x("date"), 12), cell(x("lab"), 28), cell(x("value"), 10), cell(x("unit"), 15), F.rtrim(cell(F.coalesce(x("flag"), F.lit("normal")), 8)))),
        _rows(each("encounters"), "encounters", newest_first, _record(Date=x("date"), Encounter=x("encounter_id"), Type=x("type"), Reason=x("reason"))),
        _rows(notes, "notes", note_file(), F.concat(F.lit("--- "), _plain(F.col("title")), F.lit(" ---\n"), F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")))),
    ]
    body = reduce(DataFrame.unionByName, parts)
    # Each section has a heading and, if nothing stands under it, a line that says so.
    there = body.select("patient_id", "section").distinct().withColumn("some", F.lit(True))
    sections = subjects.select("patient_id", F.explode(F.array(*[F.lit(s) for s in SECTIONS])).alias("section")).join(there, ["patient_id", "section"], "left")
    named = lambda table: reduce(lambda out, kv: F.when(F.col("section") == kv[0], F.lit(kv[1])).otherwise(out), table.items(), F.lit(None).cast("string"))
    title = named(HEADINGS)
    heading = F.concat(title, F.lit("\n"), F.repeat(F.lit("="), F.length(title)), F.when(F.col("section") == "labs", "\n" + "Date         | Test Name                    | Value      | Unit            | Flag").otherwise(""))
    rest = sections.select("patient_id", "section", F.explode(F.array_compact(F.array(
        F.struct(F.lit(0).alias("kind"), F.lit("").alias("place"), heading.alias("value")), F.when(F.col("some").isNull(), F.struct(F.lit(1).alias("kind"), F.lit("").alias("place"), named(EMPTY).alias("value"))),
    ))).alias("h")).select("patient_id", "section", "h.*")
    return body.unionByName(rest)


def note_file() -> Column:
    """The name of a note's file: date, encounter and type."""
    part = lambda c, other: F.btrim(F.regexp_replace(F.coalesce(c, F.lit(other)), r"[^\w-]+", "_"), F.lit("_"))
    return F.concat_ws("_", part(F.col("date"), "undated"), part(F.col("encounter_id"), "E"), part(F.col("type"), "clinical_note"))


def artefacts(subjects: DataFrame, notes: DataFrame) -> DataFrame:
    """(patient_id, file, seq, value): the rows of every file, to be written in the order of ``seq``."""
    rows = lines(subjects, notes)
    own = rows.where("section <> 'notes'").select("patient_id", F.col("section").alias("file"), F.concat(F.col("kind").cast("string"), F.col("place")).alias("seq"), "value")
    single = rows.where("section = 'notes' and kind = 1 and place <> ''").select("patient_id", F.concat(F.lit("notes_"), F.col("place")).alias("file"), F.lit("1").alias("seq"), F.regexp_replace("value", "^--- .*? ---\n", "").alias("value"))
    number = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")).cast("string")
    newest = F.row_number().over(Window.partitionBy("patient_id").orderBy("place"))
    labs = rows.where("section = 'labs' and kind = 1").withColumn("nth", newest)
    more = labs.where(F.col("nth") > SHOWN).groupBy("patient_id", "section").agg(F.count(F.lit(1)).alias("n")).select("patient_id", "section", F.lit(2).alias("kind"), F.lit("").alias("place"), F.format_string("... [%d earlier laboratory readings archived in labs] ...", "n").alias("value"))
    shown = rows.where("not (section = 'labs' and kind = 1)").unionByName(labs.where(F.col("nth") <= SHOWN).drop("nth")).unionByName(more)
    chart = shown.select("patient_id", F.lit("chart").alias("file"), F.concat(number, F.col("kind").cast("string"), F.col("place")).alias("seq"), F.concat(F.when((F.col("kind") == 0) & (F.col("section") != SECTIONS[0]), "\n").otherwise(""), F.col("value")).alias("value"))
    ends = subjects.select("patient_id", F.lit("chart").alias("file"), F.lit("9").alias("seq"), F.lit("\n[END OF CHART]").alias("value"))
    return own.unionByName(single).unionByName(chart).unionByName(ends)


def write_charts(subjects: DataFrame, notes: DataFrame, path: str) -> DataFrame:
    """Writes all files below ``path``/patient_id=.../file=.../ and the manifest of what is there then. Returns the manifest."""
    rows = artefacts(subjects, notes).repartition("patient_id", "file").sortWithinPartitions("patient_id", "file", "seq", "value")
    rows.select("patient_id", "file", "value").write.partitionBy("patient_id", "file").text(f"{path}/patients")
    found = written(subjects.sparkSession, path)
    found.write.json(f"{path}/manifest")
    return subjects.sparkSession.read.schema(found.schema).json(f"{path}/manifest")


def written(spark: SparkSession, path: str) -> DataFrame:
    """(name, patient_id, file, bytes, sha256) of the files that are there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/patients")
    at = F.regexp_extract("path", r"patient_id=([^/]+)/file=([^/]+)/", 1), F.regexp_extract("path", r"patient_id=([^/]+)/file=([^/]+)/", 2)
    return files.select(F.concat_ws("/", *at, F.element_at(F.split("path", "/"), -1)).alias("name"), at[0].alias("patient_id"), at[1].alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(name, status) of every file of the manifest: ok, missing or changed."""
    manifest = spark.read.schema("name string, sha256 string").json(f"{path}/manifest").withColumn("licence", F.lit("own"))
    return compare_manifest(manifest, written(spark, path).select("name", F.col("sha256").alias("found")))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, file, text): the files read back whole."""
    return spark.read.option("basePath", f"{path}/patients").text(f"{path}/patients", wholetext=True).select("patient_id", "file", F.col("value").alias("text"))


def parse_records(text: Column, first: str) -> Column:
    """array of maps from field to value of the records of a section, whose first field is ``first``."""
    blocks = F.filter(F.split(F.concat(F.lit("\n"), text), f"\n(?=- {first}: )", -1), lambda b: b.startswith(f"- {first}: "))
    fields = lambda b: F.filter(F.transform(F.split(b, "\n"), lambda s: F.regexp_extract_all(s, F.lit(r"^(?:- |  )([^:]+): (.*)$"), F.lit(0))), lambda m: F.size(m) > 0)
    pair = lambda m: F.struct(F.regexp_extract(m[0], r"^(?:- |  )([^:]+): (.*)$", 1).alias("k"), F.regexp_extract(m[0], r"^(?:- |  )([^:]+): (.*)$", 2).alias("v"))
    return F.transform(blocks, lambda b: F.map_from_entries(F.transform(fields(b), pair)))


def parse_labs(text: Column) -> Column:
    """array of (date, lab, value, unit, flag) of a table of results."""
    rows = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^\S+ +\| ") & ~s.startswith("Date "))
    cells = lambda s: F.transform(F.split(s, r"\|"), lambda c: F.trim(c))
    return F.transform(rows, lambda s: F.struct(*[F.get(cells(s), F.lit(k)).alias(n) for k, n in enumerate(("date", "lab", "value", "unit", "flag"))]))
