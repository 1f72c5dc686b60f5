"""From raw documents to token ids: quality rules, line dedup, near-duplicate removal, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet and read again.

Defined results: null, empty and very short texts fail the quality rules and go; texts of any length are read whole in every stage; equal texts of several ids are near
copies, of which the smallest id stays (a null id is the greatest), and of equal rows one; unlike texts of one id all stay; ties of the mix are broken by a digest of the id and
the text, so reruns agree; other columns, whatever their names, pass through to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, line_dedup, mixing, ngram_jaccard, quality_rules
from sparkloom.llm.common import saved, spare, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur across documents go; every document stays."""
    n_lines, n_dropped, kept = (spare(c, docs) for c in line_dedup.ADDED)
    done = line_dedup.dedup(docs, added=(n_lines, n_dropped, kept))
    new = {"text": F.col(kept), "n_chars": F.char_length(kept).cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id."""
    return ngram_jaccard.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, every copy at its own place in training order; a last, partial take counts if it is half the words or more."""
    return mixing.takes(docs, least=0.5, described=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the decoded text."""
    return bpe.apply(docs, bpe.default_vocabulary(), columns=("n_tokens", "ids_sha256", "decoded_sha256", "ids"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near), ("mixing", mixed), ("bpe", tokens)]

#: The compression bands and the automaton have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
