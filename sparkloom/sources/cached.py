"""Cached responses of services as a Spark source, and the drug labels in them.

``spark.read.format("cached_responses").load(path)`` has a row for each cached file of a folder, with a status instead of a failure where a file is missing or broken. Files are
read where the rows are made, one partition for a few of them; filters on ``name`` are pushed down, so other files are not opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.fixed_values import SALTS
from ..functions.text import collapse, core_name

RESPONSES = "name string, status string, bytes long, body string"


def _folder(path: str):
    """File system and folder of a path or address, whatever store it is in."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class CachedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.each = options["path"], options.get("suffix", ".json"), int(options.get("filesPerPartition", 16))
        self.listed = [x.strip() for x in options["names"].split(",") if x.strip()] if options.get("names") else None
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("name",) else set(f.value) if isinstance(f, In) and f.attribute == ("name",) else None
            if wanted is None:
                yield f
            else:
                self.only = wanted if self.only is None else self.only & wanted

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, folder = _folder(self.path)
        there = [i.base_name.removesuffix(self.suffix) for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.is_file and i.base_name.endswith(self.suffix)]
        names = sorted({*there, *(self.listed or ())} if self.only is None else self.only & {*there, *(self.listed or ())})
        return [Files(tuple(names[k : k + self.each])) for k in range(0, len(names), self.each)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, folder = _folder(self.path)
        for name in partition.names:
            try:
                with system.open_input_stream(f"{folder}/{name}{self.suffix}") as f:
                    raw = f.read()
            except (FileNotFoundError, OSError):
                yield name, "missing", None, None
                continue
            try:
                body = raw.decode()
                json.loads(body)
                yield name, "ok", len(raw), body
            except ValueError:  # also of a wrong encoding
                yield name, "broken", len(raw), None


class CachedResponses(DataSource):
    """Options: path; suffix (.json); names (a comma-separated list of files that should be there); filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "cached_responses"

    def schema(self) -> str:
        return RESPONSES

    def reader(self, schema) -> CachedReader:
        return CachedReader(self.options)


def read_cached(spark: SparkSession, path: str, names: list[str] | None = None, suffix: str = ".json") -> DataFrame:
    """name, status (ok, missing, broken), bytes, body of the cached files of a folder, and of ``names`` that are not there."""
    spark.dataSource.register(CachedResponses)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("cached_responses").option("suffix", suffix)
    return (reader.option("names", ",".join(names)) if names else reader).load(path)


# --- drug labels ---------------------------------------------------------------------------------------
#: The fields of a label that are kept, with their titles, and the length at which a section is clipped.
SECTIONS = (
    ("boxed_warning", "Boxed warning"), ("indications_and_usage", "Indications and usage"), ("dosage_and_administration", "Dosage and administration"),
    ("dosage_forms_and_strengths", "Dosage forms and strengths"), ("contraindications", "Contraindications"), ("warnings_and_cautions", "Warnings and precautions"), ("warnings", "Warnings"),
    ("adverse_reactions", "Adverse reactions"), ("drug_interactions", "Drug interactions"), ("use_in_specific_populations", "Use in specific populations"),
)
SECTION_CHARS = 3500
_NAMED = "struct<generic_name:array<string>,brand_name:array<string>,rxcui:array<string>,product_type:array<string>,route:array<string>,pharm_class_epc:array<string>>"
LABEL = f"results array<struct<openfda:{_NAMED},set_id:string,version:string,effective_time:string,{','.join(f'{k}:array<string>' for k, _ in SECTIONS)}>>"


def clipped(text: Column, most: int = SECTION_CHARS) -> Column:
    """White space joined; a longer text ends with its last sentence or clause beyond 60 % of ``most``, or at ``most``, and says so."""
    t = collapse(text)
    head = F.substring(t, 1, most)
    last = lambda mark: F.coalesce(F.nullif(F.instr(F.reverse(head), mark[::-1]), F.lit(0)), F.lit(most + 1))
    cut = most - F.least(last(". "), last("; "))  # characters before the blank, the mark included
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.when(cut - 1 > 0.6 * most, F.substr(head, F.lit(1), cut.cast("int"))).otherwise(head), F.lit(" [truncated]")))


def labels(responses: DataFrame, drugs: DataFrame) -> DataFrame:
    """The label of each drug (name, generic, route) from its cached response of that name: of the results whose generic name without salt words is the drug's, the best by route,
    prescription status, dose section and date. drug, generic_name, brand_names, rxcuis, product_type, route, pharm_class, set_id, label_version, effective_time, sections (array of title, body)."""
    asked = drugs.withColumn("drug", core_name(F.col("generic"), SALTS))
    found = responses.where("status = 'ok'").join(asked, "name").select("drug", "generic", F.upper(F.coalesce("route", F.lit("oral"))).alias("_route"), F.posexplode(F.from_json("body", LABEL)["results"]).alias("_i", "r"))
    own = F.coalesce("r.openfda.generic_name", F.array().cast("array<string>"))
    has = lambda field, value: F.coalesce(F.array_contains(f"r.openfda.{field}", value), F.lit(False))
    exact = found.where(F.exists(F.transform(own, lambda n: core_name(n, SALTS)), lambda n: n == F.col("drug")))
    order = (has("route", F.col("_route")), has("product_type", "HUMAN PRESCRIPTION DRUG"), F.col("r.dosage_and_administration").isNotNull(), F.coalesce("r.effective_time", F.lit("")))
    w = Window.partitionBy("drug").orderBy(*[F.desc(c) for c in order], "_i")
    best = exact.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    kept = F.array_compact(F.array(*[F.when(F.size(f"r.{k}") > 0, F.struct(F.lit(t).alias("title"), clipped(F.array_join(f"r.{k}", " ")).alias("body"))) for k, t in SECTIONS]))
    none = F.array().cast("array<string>")
    listed = lambda field: F.coalesce(f"r.openfda.{field}", none)
    return best.select(
        "drug", F.lower(F.coalesce(F.get(own, F.lit(0)), F.col("generic"))).alias("generic_name"), F.array_sort(F.array_distinct(F.transform(listed("brand_name"), F.initcap))).alias("brand_names"), F.array_sort(F.array_distinct(listed("rxcui"))).alias("rxcuis"),
        F.coalesce(F.get(listed("product_type"), F.lit(0)), F.lit("")).alias("product_type"), F.transform(listed("route"), F.lower).alias("route"), F.array_sort(listed("pharm_class_epc")).alias("pharm_class"),
        F.coalesce("r.set_id", F.lit("")).alias("set_id"), F.coalesce("r.version", F.lit("")).alias("label_version"), F.coalesce("r.effective_time", F.lit("")).alias("effective_time"), kept.alias("sections"),
    )


def label_chunks(labelled: DataFrame, most_words: int = 160) -> DataFrame:
    """The passages of labels: id, doc_id, namespace, title, section, text, drug, set_id, effective_time, and ``embed``, the text that is embedded."""
    from ..functions.text import CHUNK_SENTENCE, sentences, slug
    from ..operators.chunking import embed_text, label_body, pack

    doc = F.concat(F.lit("label:"), F.replace("drug", F.lit(" "), F.lit("-")))
    cut = labelled.select("drug", "set_id", "effective_time", doc.alias("doc_id"), F.explode("sections").alias("s"))
    packed = cut.select("drug", "set_id", "effective_time", "doc_id", F.col("s.title").alias("section"), F.posexplode(pack(sentences(label_body(F.col("s.body")), CHUNK_SENTENCE), most_words, 1)).alias("i", "text"))
    return packed.select(
        F.concat_ws("#", "doc_id", slug(F.col("section"), "-"), F.col("i").cast("string")).alias("id"), "doc_id", F.lit("drug_labels").alias("namespace"), F.concat(F.initcap("drug"), F.lit(" — FDA label")).alias("title"), "section", "text",
        "drug", "set_id", "effective_time", embed_text(F.concat("drug", F.lit(" label")), F.col("section"), F.col("text")).alias("embed"),
    )
