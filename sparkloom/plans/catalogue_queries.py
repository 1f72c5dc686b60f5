"""Names of a catalogue in texts, and words that nearly spell others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import fuzzy, text
from ..operators import gazetteer
from .base import query, read, spread


def _catalogue(spark, d):
    """Every part's name alone, and with its number for three parts in four."""
    p = read(spark, d, "part")
    short = p.select(F.lit("parts").alias("kind"), F.col("p_name").alias("surface"), F.col("p_name").alias("canonical"))
    numbered = F.concat_ws(" no. ", "p_name", F.col("p_partkey").cast("string"))
    return short.unionByName(p.where("p_partkey % 4 > 0").select(F.lit("parts").alias("kind"), numbered.alias("surface"), F.concat(F.lit("#"), F.col("p_partkey").cast("string")).alias("canonical")))


@query(
    "gazetteer_catalogue",
    """SELECT l_orderkey AS order_id, CASE WHEN l_partkey % 4 > 0 THEN '#' || l_partkey ELSE p_name END AS canonical, CAST(1 + 5 * (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1) AS INTEGER) AS at,
      CASE WHEN l_partkey % 4 > 0 THEN 4 ELSE 2 END AS words FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def gazetteer_catalogue(spark, d):
    """The parts that an order's text names, from a catalogue of all parts: the longest name at each place."""
    lines = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    line = F.struct("l_linenumber", "l_partkey", "l_extendedprice", F.concat(F.lit("(one "), F.col("p_name"), F.lit(" no. "), F.col("l_partkey").cast("string"), F.lit(")")).alias("t"))
    texts = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), ", ").alias("text"))
    # Before the first word stands a bracket, which is an element of its own.
    return gazetteer.matches(texts, _catalogue(spark, d), "l_orderkey").select(F.col("l_orderkey").alias("order_id"), "canonical", (F.col("at") - 1).cast("int").alias("at"), F.col("m").alias("words"))


# --- words that nearly spell others ------------------------------------------------------------------
_LONG = [x for x in V.DRUGS if " " not in x and len(x) >= 9]


@query("fuzzy_drug_match", f"SELECT conv_id, turn, {_LONG}[(conv_id * 8 + turn) % {len(_LONG)} + 1] AS drug, drug AS found FROM conversations WHERE role = 'user'")
def fuzzy_drug_match(spark, d):
    """Whole user turns, each with a drug's name that lacks a letter put before it: the near match finds it again."""
    names = F.array(*[F.lit(x) for x in _LONG])
    i = F.col("conv_id") * 8 + F.col("turn")
    drug = F.get(names, (i % F.size(names)).cast("int"))
    cut = (i % (F.length(drug) - 4)).cast("int") + 3
    typo = F.concat(F.substr(drug, F.lit(1), cut - 1), F.substr(drug, cut + 1))
    talk = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", drug.alias("drug"), F.lower(F.concat(typo, F.lit(" "), F.coalesce("text", F.lit("")))).alias("q"))
    words = talk.select(F.struct("conv_id", "turn").alias("k"), F.explode(F.array_distinct(text.found(F.col("q"), "[a-z]{6,}"))).alias("word"))
    near = fuzzy.near_names(words, spark.createDataFrame([(x,) for x in V.DRUGS], "name string"), "k").groupBy("k").agg(F.array_sort(F.collect_set("name")).alias("found"))
    return talk.join(near, (F.col("k.conv_id") == F.col("conv_id")) & (F.col("k.turn") == F.col("turn")), "left").select("conv_id", "turn", "drug", F.coalesce(F.array_join("found", "|"), F.lit("")).alias("found"))


@query("unknown_subject")
def unknown_subject(spark, d):
    """Words of questions that no document knows, and nearly none spells."""
    asked = read(spark, d, "conversations").where("role = 'user'").select("conv_id", F.explode(F.array_distinct(text.found(F.lower("text"), "[a-z][a-z0-9-]{5,}"))).alias("word"))
    known = spread(read(spark, d, "documents")).select(F.explode(text.word_set(F.col("text"))).alias("word")).distinct()
    return fuzzy.unknown_words(asked, known, "conv_id")


@query("near_brand_pairs", "SELECT a.s AS word, b.s AS other FROM (SELECT DISTINCT p_name || p_type AS s FROM part) a JOIN (SELECT DISTINCT p_name || p_type || 'x' AS s FROM part) b ON a.s || 'x' = b.s")
def near_brand_pairs(spark, d):
    """Names and types of parts against the same with a letter more: each finds its own at a cutoff that nothing else reaches."""
    s = F.concat(F.col("p_name"), F.col("p_type"))
    p = read(spark, d, "part").select(s.alias("word")).distinct()
    pairs = fuzzy.near_pairs(p, p.select(F.concat("word", F.lit("x")).alias("word")), 0.95)
    return pairs.where(F.concat("word", F.lit("x")) == F.col("other")).select("word", "other")
