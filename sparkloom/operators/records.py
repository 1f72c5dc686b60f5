"""Records of subjects: sentences, latest values of series, intervals, as-of lookups, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import LABS


def sentence(kind: Column, data: Column, who: Column) -> Column:
    """The plain sentence that states a record; ``data`` is a map of strings."""
    g = lambda k: F.coalesce(F.element_at(data, k), F.lit(""))
    c = F.concat
    value = F.when(g("unit") == "%", c(g("value"), g("unit"))).otherwise(F.trim(F.concat_ws(" ", g("value"), g("unit"))))
    taking = c(who, F.lit(" is taking "), g("drug"), F.lit(" "), g("dose"), F.lit(" "), g("frequency"), F.lit(" for "), g("indication"), F.lit(", started "), g("start"), F.lit("."))
    took = c(who, F.lit(" previously took "), g("drug"), F.lit(" "), g("dose"), F.lit(" "), g("frequency"), F.lit("; it was stopped on "), g("stop"), F.lit(" because of "), g("stop_reason"), F.lit("."))
    return (
        F.when(kind == "demographics", c(who, F.lit(" is "), g("name"), F.lit("; sex: "), g("sex"), F.lit("; date of birth: "), g("birth_date"), F.lit(".")))
        .when(kind == "condition", c(who, F.lit(" has "), g("name"), F.lit(" (ICD-10-CM "), g("icd10"), F.lit("), status "), g("status"), F.lit(", onset "), g("onset"), F.lit(".")))
        .when(kind == "medication", F.when(g("status") == "active", taking).otherwise(took))
        .when(kind == "allergy", c(who, F.lit(" has a documented allergy to "), g("substance"), F.lit(" (reaction: "), g("reaction"), F.lit(", severity: "), g("severity"), F.lit(").")))
        .when(kind == "lab", c(who, F.lit(" "), g("lab"), F.lit(" on "), g("date"), F.lit(": "), value, F.lit(" (flag: "), g("flag"), F.lit(").")))
        .when(kind == "encounter", c(who, F.lit(" had a "), g("type"), F.lit(" on "), g("date"), F.lit(" for "), g("reason"), F.lit(".")))
        .when(kind == "icd10", c(F.lit("ICD-10-CM code "), g("code"), F.lit(" means: "), g("name"), F.lit(".")))
        .otherwise(c(F.initcap(g("name")), F.lit(" has RxNorm ingredient identifier (RxCUI) "), g("rxcui"), F.lit("; label generic name: "), g("generic_name"), F.lit(".")))
    )


def latest(series: DataFrame, keys: list[str], at: str, n: int, tie: str) -> DataFrame:
    """The last n rows of each series. Each task keeps n rows of a key before the exchange."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return series.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def latest_value(series: DataFrame, keys: list[str], at: str, tie: str, *values: str) -> DataFrame:
    """The last row of each series as an aggregate: one row per key leaves each task."""
    last = F.max_by(F.struct(at, tie, *values), F.struct(at, tie)).alias("r")
    return series.groupBy(*keys).agg(last).select(*keys, "r.*")


def lab_flag(lab: Column, value: Column) -> Column:
    """low, normal or high against the inclusive range of the lab; unknown labs are unknown."""
    out = F.lit("unknown")
    for name, (_, low, high, _) in LABS.items():
        out = F.when(lab == name, F.when(value < low, "low").when(value > high, "high").otherwise("normal")).otherwise(out)
    return out


def range_flag(value: Column, low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull(), "unknown").when(value < low, "low").when(value > high, "high").otherwise("normal")


def age_on(birth: Column, day: Column) -> Column:
    """Full years: the year difference, less one before the birthday."""
    early = F.struct(F.month(day), F.dayofmonth(day)) < F.struct(F.month(birth), F.dayofmonth(birth))
    return F.year(day) - F.year(birth) - early.cast("int")


def active_on(visits: DataFrame, spans: DataFrame, key: str, at: str, start: str, stop: str) -> DataFrame:
    """Spans that hold at a visit: start <= at, and no stop or a later one. Equal keys are joined; the interval is a residual."""
    return visits.join(spans, key).where((F.col(start) <= F.col(at)) & (F.col(stop).isNull() | (F.col(stop) > F.col(at))))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, values: list[str]) -> DataFrame:
    """For each left row the latest right row of its key at or before it.

    Both sides go through one exchange and one sort; a running last value replaces the join, so the work is linear
    in both however many rows a key has. Left rows of a moment come after right rows of it."""
    cols = [c for c in left.columns if c not in (key, at)]
    r = right.select(key, at, F.lit(0).alias("_side"), F.struct(F.col(at).alias("_at"), *values).alias("_r"), F.col(tie).alias("_tie"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols])
    x = left.select(key, at, F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), *cols)
    w = Window.partitionBy(key).orderBy(at, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(x).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(key, at, *cols, F.col("_last._at").alias("as_of"), *[F.col(f"_last.{v}").alias(v) for v in values])


def named_in(texts: DataFrame, names: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, name): texts and the names that stand in them as whole words, in any case.

    Texts meet names on the first word of a name, so the work follows the words of the texts, however many names there are;
    names of several words are then looked for in the text itself."""
    word = r"\w+"
    first = names.select(name, F.regexp_extract(F.lower(name), word, 0).alias("_w")).where("_w <> ''")
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0)))).alias("_w"))
    met = words.join(first, "_w").select(key, name)
    single = F.col(name).rlike(r"^\w+$")
    whole = F.concat(F.lit(r"(?i)\b"), F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit(r"\b"))
    longer = met.where(~single).join(texts.select(key, text), key).where(F.regexp_like(text, whole)).select(key, name)
    return met.where(single).unionByName(longer).distinct()


def explode_subject(subjects: DataFrame) -> DataFrame:
    """One key-value row for every nested element of a subject record, its header and its summary."""
    pid = F.col("patient_id")
    slug = lambda c: F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    pre = F.concat(F.lit("patient:"), pid)
    head = subjects.select(pre.alias("key"), F.to_json(F.struct("birth_date", "name", "sex")).alias("value"))

    def nested(column: str, kind: str, tail) -> DataFrame:
        rows = subjects.select(pre.alias("_p"), F.explode(column).alias("x"))
        return rows.select(F.concat_ws(":", "_p", F.lit(kind), *tail(F.col("x"))).alias("key"), F.to_json("x").alias("value"))

    parts = [
        head,
        nested("conditions", "condition", lambda x: [x["icd10"]]),
        nested("medications", "med", lambda x: [slug(x["drug"])]),
        nested("labs", "lab", lambda x: [slug(x["lab"]), x["date"]]),
        nested("encounters", "encounter", lambda x: [x["encounter_id"]]),
        subjects.select(F.concat(pre, F.lit(":summary")).alias("key"), summary(subjects).alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(subjects: DataFrame) -> Column:
    return F.to_json(
        F.struct(
            F.size(F.filter("medications", lambda m: m["status"] == "active")).alias("active_meds"),
            F.transform("conditions", lambda c: c["name"]).alias("conditions"),
            F.array_max(F.transform("encounters", lambda e: e["date"])).alias("last_encounter"),
            F.size("labs").alias("n_labs"),
        )
    )
