"""Term statistics and BM25 ranking. Statistics cover the whole namespace, whatever is filtered afterwards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import STOP_WORDS, SYNONYMS
from ..functions.fuzzy import among
from ..functions.text import raw_tokens, stem
from ..sources.shared import saved

K1, B = 1.2, 0.75


def _stemmed(w: str) -> str:
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


#: Words that don't stand for themselves: stop words for nothing, synonyms for their words. Two hundred at most.
_SPELLED = {w: [] for w in STOP_WORDS} | {t: [_stemmed(w) for w in words.split(" ") if w not in STOP_WORDS] for t, words in SYNONYMS.items()}


def _spelled(spark) -> DataFrame:
    return spark.createDataFrame(list(_SPELLED.items()), "token string, terms array<string>")


def token_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term): one row for each token, as ``tokens`` makes them. Texts are split once; words are looked up by a join with a
    small constant table and stemmed as plain columns, inside generated code."""
    raw = docs.select(key, F.explode(raw_tokens(F.col(text))).alias("token"))
    looked = raw.join(F.broadcast(_spelled(docs.sparkSession)), "token", "left")
    return looked.select(key, F.explode(F.coalesce("terms", F.array(stem(F.col("token"))))).alias("term"))


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf): one row for each document and term."""
    return token_rows(docs, key, text).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


#: Bytes of texts that are counted together, unless one text has more.
CUT = 1 << 23
_KIND = np.array([1 if chr(i).isascii() and (chr(i).isdigit() or chr(i).islower()) else 2 if chr(i) in "./-" else 0 for i in range(256)], dtype=np.uint8)
#: What stands for no term or for several, joined by spaces.
_SEVERAL = frozenset(" ".join(terms) for terms in _SPELLED.values() if len(terms) != 1)


def _cut(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The tokens of lower-case texts, and which text each is in: letters and digits, and a mark between two of them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    begins, n = offsets[:-1] - offsets[0], int(offsets[-1] - offsets[0])
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    code = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    kind = _KIND[code]
    new = np.zeros(n + 1, bool)
    new[begins] = new[n] = True
    letter = kind == 1
    inside = (kind == 2) & ~new[:n] & ~new[1:]
    inside[1:] &= letter[:-1]
    inside[:-1] &= letter[1:]
    inside |= letter
    opens = inside & new[:n]
    opens[1:] |= inside[1:] & ~inside[:-1]
    starts = np.flatnonzero(opens)
    data = code[inside]
    places = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, len(data))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data)), np.searchsorted(begins, starts, "right") - 1


def _terms(tokens: pa.LargeStringArray, text: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different terms, and for each token's terms the number of the term and the text."""
    coded = tokens.dictionary_encode()
    spelled = [" ".join(_SPELLED[w]) if w in _SPELLED else _stemmed(w) for w in coded.dictionary.to_pylist()]
    named = pa.array(spelled, pa.string()).dictionary_encode()
    names = {x: i for i, x in enumerate(named.dictionary.to_pylist())}
    term = named.indices.to_numpy()[coded.indices.to_numpy()]
    several = _SEVERAL & names.keys()
    plain = ~np.isin(term, [names[x] for x in several])
    parts = [(term[plain], text[plain])]
    for joined in several:
        here = text[term == names[joined]]
        parts += [(np.full(len(here), names.setdefault(t, len(names))), here) for t in joined.split()]
    return list(names), np.concatenate([t for t, _ in parts]).astype(np.int64), np.concatenate([x for _, x in parts])


def _counted(repeated: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """_key, term, df, tf: the counts of a lot of texts, added up; those of a text whose id ``repeated`` is true for stand alone, under its id."""

    def counts(keys: pa.Array, alone: np.ndarray, texts: pa.LargeStringArray) -> Iterator[pa.RecordBatch]:
        names, term, text = _terms(*_cut(texts))
        pairs, tf = np.unique(text * len(names) + term, return_counts=True)
        text, term = pairs // max(len(names), 1), pairs % max(len(names), 1)
        own = alone[text]
        known = keys.is_valid().to_numpy(zero_copy_only=False)[text]
        df = np.bincount(term[~own & known], minlength=len(names))
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, term[~own], tf[~own])
        names = pa.array(names, pa.string())
        some, which = np.flatnonzero(sums), np.flatnonzero(own)
        for key, t, d, n in ((pa.nulls(len(some), keys.type), some, df[some], sums[some]), (keys.take(pa.array(text[which])), term[which], np.ones(len(which), np.int64), tf[which])):
            yield pa.RecordBatch.from_arrays([key, names.take(pa.array(t)), pa.array(d, pa.int64()), pa.array(n, pa.int64())], names=["_key", "term", "df", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = repeated(batch.column(1).to_numpy().view(np.uint64)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            texts = batch.column(2).cast(pa.large_string())
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            begin = 0
            while begin < len(ends):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CUT, "right")))
                yield from counts(batch.column(0).slice(begin, end - begin), alone[begin:end], texts.slice(begin, end - begin))
                begin = end

    return run


def term_frequencies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, df, tf): in how many documents a term is, as ``tokens`` makes it, and how often. Terms are counted where texts are read, so a lot of texts gives a row for each of its
    different terms, not for each of each document. Rows of one id are one document: only those of ids that are there more than once (or share a place of a bitmap with one) meet by id and term. A row without an id only adds to ``tf``."""
    ids = docs.where(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("rest")).agg(F.count(F.lit(1)).alias("n"))
    twice = saved(ids.where("n > 1").select("rest"), "repeated_ids")
    kept = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(key), F.lower(F.make_valid_utf8(F.col(text))))
    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("tf", T.LongType())])
    rows = kept.mapInArrow(_counted(among(twice, twice.count())), schema)
    once = rows.groupBy("_key", "term").agg(F.when(F.col("_key").isNull(), F.sum("df")).otherwise(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    return once.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def asked_terms(queries: DataFrame, query_key: str) -> DataFrame:
    """(query_key, term, times) of queries with ``text``."""
    return term_counts(queries, query_key).withColumnRenamed("tf", "times")


#: Different asked terms that are sent to the tasks, so that only these are kept; with more, all terms are.
SENT = 2_000_000


def _posted(repeated: Callable[[np.ndarray], np.ndarray], sent, keep: int, beside: bool) -> Callable:
    """Rows of key, hash of the key, texts (and titles), columns to keep: key, what is kept, length, found (and titled, size), and whether the key may stand in several rows."""

    def of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        return _terms(*_cut(texts.fill_null("").cast(pa.large_string())))

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, term, text = of(batch.column(2))
        length = np.bincount(text, minlength=batch.num_rows)
        also, size = np.zeros(len(term), np.int64), length
        if beside:
            more, term2, text2 = of(batch.column(3))
            at = {x: i for i, x in enumerate(names)}
            code = np.array([at.setdefault(x, len(at)) for x in more], dtype=np.int64)
            names, size = list(at), length + np.bincount(text2, minlength=batch.num_rows)
            also = np.concatenate([also, np.ones(len(term2), np.int64)])
            term, text = np.concatenate([term, code[term2]]), np.concatenate([text, text2])
        terms = pa.array(names, pa.string())
        order = pc.sort_indices(terms).to_numpy()  # postings of every document in one order, so copies have the same score to the last bit
        terms, place = terms.take(pa.array(order)), np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        term = place[term]
        asked = np.ones(len(names), bool) if sent is None else pc.is_in(terms, value_set=sent.value).to_numpy(zero_copy_only=False)
        kept = asked[term]
        term, text, also = term[kept], text[kept], also[kept]
        pairs, which = np.unique(text * max(len(names), 1) + term, return_inverse=True)
        titled = np.bincount(which, also, len(pairs)).astype(np.int64)
        tf = np.bincount(which, minlength=len(pairs)) - titled
        ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // max(len(names), 1), minlength=batch.num_rows))])
        fields = [terms.take(pa.array(pairs % max(len(names), 1))), pa.array(tf, pa.int64())] + ([pa.array(titled, pa.int64())] if beside else [])
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["term", "tf", "titled"][: len(fields)]))
        alone = repeated(batch.column(1).to_numpy().view(np.uint64)) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
        kept_columns = [batch.column(i) for i in range(3 + beside, 3 + beside + keep)]
        sizes = [pa.array(size, pa.int64())] if beside else []
        return pa.RecordBatch.from_arrays([batch.column(0), *kept_columns, pa.array(length, pa.int64()), found, *sizes, pa.array(alone)], names=[batch.schema.names[0], *batch.schema.names[3 + beside :], "length", "found", *["size"][: len(sizes)], "_again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < len(ends):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CUT, "right")))
                yield counts(batch.slice(begin, end - begin))
                begin = end

    return run


def postings(docs: DataFrame, terms: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = (), beside: str | None = None) -> DataFrame:
    """One row for each document: key, the columns to ``keep``, length, and ``found``, its (term, tf) among the ``terms`` that are asked for, in their order. With ``keep`` each row of ``docs`` is one, else each key.
    ``beside`` names a column of titles: ``found`` then also has its terms, with how often they are there (titled), and ``size`` counts the tokens of both.

    Terms are counted where the texts are read, so no row for each term of a document is ever shuffled, and the rows are written, since statistics and scores read them again. Rows of one key are one
    document: only those of keys that are there more than once (or share a place of a bitmap with one) meet by key. A null text is empty."""
    spark = docs.sparkSession
    twice = saved(docs.where(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("rest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rest"), "repeated_ids")
    n = twice.count()
    asked = terms.select("term").where("term is not null").distinct().limit(SENT + 1).toArrow()["term"].combine_chunks().cast(pa.string())
    sent = spark.sparkContext.broadcast(asked) if len(asked) <= SENT else None
    clean = lambda c: F.lower(F.make_valid_utf8(F.col(c)))
    rows = docs.select(key, F.xxhash64(key).alias("_hash"), clean(text).alias("_text"), *([clean(beside).alias("_beside")] if beside else []), *keep)
    fields = [T.StructField("term", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("tf", "titled")[: 1 + (beside is not None)]]]
    counted = [T.StructField("length", T.LongType()), T.StructField("found", T.ArrayType(T.StructType(fields))), *[T.StructField("size", T.LongType())][: beside is not None], T.StructField("_again", T.BooleanType())]
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in (key, *keep)], *counted])
    posted = saved(rows.mapInArrow(_posted(among(twice, n), sent, len(keep), beside is not None), schema), "postings")
    single = posted.where("not _again").drop("_again")
    if not keep:
        single = single.where("length > 0")
    if not n and docs.where(F.col(key).isNull()).isEmpty():
        return single
    again = posted.where("_again")
    parts = again.select(key, F.inline("found")).groupBy(key, "term").agg(*[F.sum(c).alias(c) for c in ("tf", "titled")[: 1 + (beside is not None)]])
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*parts.columns[1:]))).alias("found"))
    sums = again.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("length", "size")[: 1 + (beside is not None)]])
    same = lambda a, b: a[key].eqNullSafe(b[key])
    none = F.array().cast(posted.schema["found"].dataType)
    if keep:
        whole = again.select(key, *keep).join(sums, key, "left").join(lists, key, "left")
        whole = whole.withColumns({c: F.coalesce(c, F.lit(0)) for c in sums.columns[1:]} | {"found": F.coalesce("found", none)})
    else:
        whole = sums.join(lists, same(sums, lists), "left").select(sums[key], "length", F.coalesce("found", none).alias("found"), *(["size"] if beside else [])).where("length > 0")
    return saved(single.unionByName(whole), "postings_whole")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def part(tf, length, mean):
    """What a term that occurs ``tf`` times adds, before its weight: of columns or of arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def best(scored: DataFrame, key: str, query_key: str, k: int, digits: int = 9) -> DataFrame:
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", digits)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: (query, term) pairs that are broadcast together; cells and products of one block of scores.
LOT, CELLS = 250_000, 1_000_000


class _Asked:
    """The weighted terms of a lot of queries, by term."""

    def __init__(self, rows: pa.Table, query_key: str):
        names = rows[query_key].combine_chunks()
        self.names = names.unique()
        query = pc.index_in(names, value_set=self.names).to_numpy(zero_copy_only=False)
        terms = rows["term"].combine_chunks()
        self.terms = terms.unique()
        term = pc.index_in(terms, value_set=self.terms).to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        self.at = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.query, self.weight = query[order], rows["w"].to_numpy()[order]

    def blocks(self, found: pa.Array, length: np.ndarray, mean: float | None) -> Iterator[tuple[int, np.ndarray]]:
        """Documents by queries, as ``score_blocks``; without ``mean`` every term counts as one."""
        doc = np.repeat(np.arange(len(found)), pc.list_value_length(found).fill_null(0).to_numpy(zero_copy_only=False))
        flat = found.flatten()
        term = pc.index_in(flat.field("term"), value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        tf = flat.field("tf").to_numpy(zero_copy_only=False).astype(np.float64)
        known = term >= 0
        doc, term, tf = doc[known], term[known], tf[known]
        gain = np.ones(len(tf)) if mean is None else part(tf, length[doc], mean)
        return score_blocks(doc, term, gain, len(found), self.at, self.query, self.weight, len(self.names))


def score_blocks(doc: np.ndarray, term: np.ndarray, gain: np.ndarray, docs: int, at: np.ndarray, query: np.ndarray, weight: np.ndarray, queries: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, scores of documents by queries), from postings in the order of documents and, from ``at`` to ``at`` of each term, its queries and their weights. A block has
    about ``CELLS`` cells and products at most, however many queries share a term."""
    many = at[term + 1] - at[term]
    cost = np.cumsum(np.bincount(doc, many, docs) + queries)
    first = 0
    while first < docs:
        last = max(first + 1, int(np.searchsorted(cost, (cost[first - 1] if first else 0) + CELLS, "right")))
        a, b = np.searchsorted(doc, (first, last))
        m = many[a:b]
        ends = np.cumsum(m)
        spot = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - m, m) + np.repeat(at[term[a:b]], m)
        cell = np.repeat(doc[a:b] - first, m) * queries + query[spot]
        yield first, np.bincount(cell, np.repeat(gain[a:b], m) * weight[spot], (last - first) * queries).reshape(last - first, queries).astype(np.float64, copy=False)  # of nothing it counts integers
        first = last


class Best:
    """The k best scores that a task has seen for each query: what is below them, even rounded, is not passed on."""

    def __init__(self, k: int, queries: int, digits: int):
        self.k, self.near, self.held = k, 0.6 * 10.0**-digits, np.zeros((k, queries))

    def of(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries of a block that may be among the best, with all that tie with the last when rounded."""
        self.held = np.partition(np.concatenate([self.held, scores]), len(scores), axis=0)[len(scores) :]
        return np.nonzero((scores >= self.held.min(axis=0) - 2 * self.near) & (scores > 0))


def _best_blocks(sent, mean: float | None, k: int, key: str, query_key: str, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Asked = sent.value
        best_so_far = Best(k, len(asked.names), digits)
        for batch in batches:
            for first, scores in asked.blocks(batch.column(2), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), mean):
                row, query = best_so_far.of(scores)
                yield pa.RecordBatch.from_arrays([asked.names.take(pa.array(query)), batch.column(0).take(pa.array(first + row)), pa.array(scores[row, query])], names=[query_key, key, "score"])

    return run


def best_of(found: DataFrame, weighted: DataFrame, mean: float | None, key: str, query_key: str, k: int, digits: int = 9, lot: int = LOT) -> DataFrame:
    """(query_key, key, score, rank): the k best documents of each query, from ``postings`` and weighted terms (query_key, term, w), block by block: a task
    keeps k rows for each query and block, where a join would make a row for each term that a document shares with a query.
    Queries come in lots of about ``lot`` terms, by a hash."""
    weighted = saved(weighted.select(query_key, "term", F.col("w").cast("double").alias("w")), "weighted")
    lots = max(1, -(-weighted.count() // lot))
    kinds = f"`{query_key}` {weighted.schema[query_key].dataType.simpleString()}, `{key}` {found.schema[key].dataType.simpleString()}, score double"
    out = None
    for i in range(lots):
        rows = weighted.where(F.pmod(F.xxhash64(query_key), F.lit(lots)) == i).toArrow()
        if rows.num_rows:
            sent = found.sparkSession.sparkContext.broadcast(_Asked(rows, query_key))
            part_ = found.select(key, "length", "found").mapInArrow(_best_blocks(sent, mean, k, key, query_key, digits), kinds)
            out = part_ if out is None else out.unionByName(part_)
    return best(found.sparkSession.createDataFrame([], kinds) if out is None else out, key, query_key, k, digits)


def weights(found: DataFrame, n: int, asked: DataFrame, query_key: str) -> DataFrame:
    """(query_key, term, w) of the terms that some document holds."""
    df = found.select(F.inline("found")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return asked.join(df, "term").select(query_key, "term", (F.col("times") * idf(F.lit(float(n)), F.col("df"))).alias("w"))


def bm25_best(found: DataFrame, n: int, asked: DataFrame, key: str, query_key: str, k: int) -> DataFrame:
    """The k best documents of each query with a score above 0, from ``postings`` of ``n`` documents."""
    words = found.agg(F.sum("length").cast("double")).first()[0] or 0.0
    return best_of(found, weights(found, n, asked, query_key), words / n if words else 1.0, key, query_key, k)


def coverage_best(found: DataFrame, asked: DataFrame, key: str, query_key: str, k: int) -> DataFrame:
    """The k documents of each query that hold most of its terms."""
    return best_of(found, asked.select(query_key, "term", F.lit(1.0).alias("w")), None, key, query_key, k)


def bm25(docs: DataFrame, queries: DataFrame, key: str, query_key: str, k: int, text: str = "text") -> DataFrame:
    """The k best documents of each query with a score above 0: (query_key, key, score, rank)."""
    asked = asked_terms(queries, query_key)
    return bm25_best(postings(docs, asked, key, text), docs.count(), asked, key, query_key, k)
