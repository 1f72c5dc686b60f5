"""Documents to passages: sections, sentences, greedy packing with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHUNK_SENTENCE, collapse, sentences, slug

HEADER = r"(?m)^([A-Z][A-Z0-9 /&()-]{2,60}):\s*$"


def sections(text: Column) -> Column:
    """array of (title, body). Text before the first header is dropped; without headers the whole is one section, ``note``."""
    mark = "\u0001"
    pieces = F.split(F.regexp_replace(text, HEADER, f"{mark}$1\u0002"), mark, -1)
    cut = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(F.initcap(F.trim(F.split_part(p, F.lit("\u0002"), F.lit(1)))).alias("title"), F.regexp_replace(F.split_part(p, F.lit("\u0002"), F.lit(2)), r"^\s+|\s+$", "").alias("body")))
    whole = F.array(F.struct(F.lit("note").alias("title"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("body")))
    return F.when(F.size(pieces) > 1, F.filter(cut, lambda s: s["body"] != "")).otherwise(whole)


def pack(parts: Column, most_words: int, overlap: int = 1) -> Column:
    """Whole sentences packed greedily up to ``most_words``; the last ``overlap`` sentences of a chunk open the next one.

    One pass of a fold over the sentences; it stays in the JVM."""
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + words(x))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        full = (F.size(acc["open"]) > 0) & (acc["n"] + words(s) > most_words)
        kept = F.slice(acc["open"], F.greatest(F.size(acc["open"]) - overlap + 1, F.lit(1)), overlap) if overlap else empty
        return F.when(
            full, F.struct(F.array_append(acc["done"], F.array_join(acc["open"], " ")).alias("done"), F.array_append(kept, s).alias("open"), (total(kept) + words(s)).alias("n"))
        ).otherwise(F.struct(acc["done"].alias("done"), F.array_append(acc["open"], s).alias("open"), (acc["n"] + words(s)).alias("n")))

    def finish(acc: Column) -> Column:
        tail = F.array_join(acc["open"], " ")
        again = F.coalesce(F.get(acc["done"], F.size(acc["done"]) - 1) == tail, F.lit(False))
        return F.when((F.size(acc["open"]) == 0) | again, acc["done"]).otherwise(F.array_append(acc["done"], tail))

    return F.aggregate(parts, start, step, finish)


def chunks(docs: DataFrame, key: str, text: str, most_words: int = 120, overlap: int = 1) -> DataFrame:
    """(doc key, chunk_id, section, text): no chunk crosses a section."""
    cut = docs.select(F.col(key), F.explode(sections(F.col(text))).alias("s"))
    packed = cut.select(key, F.col("s.title").alias("section"), F.posexplode(pack(sentences(F.col("s.body"), CHUNK_SENTENCE), most_words, overlap)).alias("i", "text"))
    return packed.select(key, F.concat_ws("#", F.col(key).cast("string"), slug(F.col("section"), "-"), F.col("i").cast("string")).alias("chunk_id"), "section", "text")


def label_body(text: Column) -> Column:
    """A label section without its numbered heading."""
    return F.regexp_replace(text, r"^\s*(?:\d+(?:\.\d+)*\s+)?[A-Z][A-Z ,&/()-]{3,}(?=\s+[A-Z][a-z])\s*", "")


def topic_sections(summary: Column) -> Column:
    """Question headings (up to 14 words, ending in ?) open sections; what comes first is ``Summary``."""
    paragraphs = F.filter(F.transform(F.split(summary, "\n"), lambda p: F.trim(p)), lambda p: p != "")
    heading = lambda p: p.endswith("?") & (F.size(F.split(p, r"\s+")) <= 14)
    marked = F.array_join(F.transform(paragraphs, lambda p: F.when(heading(p), F.concat(F.lit("\u0001"), p, F.lit("\u0002"))).otherwise(F.concat(p, F.lit("\n")))), "")
    pieces = F.split(F.when(marked.startswith("\u0001"), F.substr(marked, F.lit(2))).otherwise(F.concat(F.lit("Summary\u0002"), marked)), "\u0001", -1)
    return F.transform(pieces, lambda p: F.struct(F.split_part(p, F.lit("\u0002"), F.lit(1)).alias("title"), F.regexp_replace(F.split_part(p, F.lit("\u0002"), F.lit(2)), r"^\s+|\s+$", "").alias("body")))


def embed_text(title: Column, section: Column, text: Column) -> Column:
    return F.concat_ws(" | ", title, section, collapse(text))
