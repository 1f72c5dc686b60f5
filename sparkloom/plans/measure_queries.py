"""Evaluation, telemetry and state queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing
from ..operators import latency, measures
from ..sources import files
from ..streaming import state
from .base import query, read

PCT = ", ".join(f"coalesce(round(quantile_cont(value, {q}), 3), 0.0) AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99))


@query("metrics_percentiles", f"SELECT event_type, count(value) AS n, coalesce(round(avg(value), 3), 0.0) AS mean, {PCT} FROM events GROUP BY 1")
def metrics_percentiles(spark, d):
    return measures.percentiles(read(spark, d, "events"), "value", ["event_type"])


@query("latency_windows", "SELECT event_type, CAST(h AS TIMESTAMP) AS last, count(*) AS n, round(sum(value), 2) AS total, true AS p50_ok, true AS p95_ok, true AS p99_ok FROM (SELECT DISTINCT event_type, date_trunc('hour', ts) AS h FROM events WHERE value IS NOT NULL) JOIN (SELECT event_type, value, date_trunc('hour', ts) AS s FROM events WHERE value IS NOT NULL) USING (event_type) WHERE s BETWEEN h - INTERVAL 23 HOUR AND h GROUP BY ALL")
def latency_windows(spark, d):
    """A day's quantiles at the end of every hour, merged from hourly sketches; each must be within the sketch's rank error of the day's values."""
    e = read(spark, d, "events").select("event_type", "ts", "value").where("value is not null")
    told = latency.windows(latency.slices(e, "ts", "value", ["event_type"], "1 hour"), ["event_type"], 24, 3600)
    hours = F.explode(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.timestamp_seconds(F.unix_timestamp("hour") + i * 3600)))
    # Equal values of an hour count once. The windows are few rows, their values are not and must never be the broadcast side.
    equal = e.groupBy("event_type", "value", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("times"))
    both = equal.select("event_type", "value", "times", hours.alias("last")).join(F.broadcast(told), ["event_type", "last"])
    names = list(zip(latency.QUANTILES, ("p50", "p95", "p99"), strict=True))
    times = lambda test: F.sum(F.when(test, F.col("times")).otherwise(0))
    counts = [times(F.col("value") < F.col(c)).alias(f"{c}_below") for _, c in names] + [times(F.col("value") <= F.col(c)).alias(f"{c}_upto") for _, c in names]
    checked = both.groupBy("event_type", "last", "n", F.round("total", 2).alias("total")).agg(*counts)
    ok = [(latency.off_rank(F.col(f"{c}_below"), F.col(f"{c}_upto"), F.col("n"), q) <= latency.rank_error()).alias(f"{c}_ok") for q, c in names]
    return checked.select("event_type", "last", "n", "total", *ok)


@query("latency_recent", f"SELECT event_type, count(value) AS n, round(avg(value), 3) AS mean, {PCT} FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500) GROUP BY 1")
def latency_recent(spark, d):
    return latency.recent_percentiles(read(spark, d, "events"), "ts", "event_id", "value", ["event_type"], 500)


_LE = "CASE " + " ".join(f"WHEN value <= {b} THEN {b}" for b in measures.BUCKETS) + " ELSE -1 END"


@query("metrics_histogram", f"SELECT CAST(le AS BIGINT) AS le, coalesce(n, 0) AS n FROM (VALUES {', '.join(f'({b})' for b in (*measures.BUCKETS, -1))}) b(le) LEFT JOIN (SELECT {_LE} AS le, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) USING (le)")
def metrics_histogram(spark, d):
    return measures.histogram(read(spark, d, "events"), "value")


@query("metrics_counters", "SELECT 'requests' AS counter, count(*) AS n FROM events UNION ALL SELECT 'event_type:' || event_type, count(*) FROM events GROUP BY 1 UNION ALL SELECT 'hour:' || hour(ts), count(*) FROM events GROUP BY 1")
def metrics_counters(spark, d):
    e = read(spark, d, "events").select("event_type", F.hour("ts").cast("string").alias("hour"))
    return measures.counters(e, ["event_type", "hour"])


@query("cache_hit_rate", "SELECT count(*) AS requests, count(*) FILTER (WHERE event_type <> 'view') AS eligible, round(count(*) FILTER (WHERE event_type = 'click') / CAST(count(*) FILTER (WHERE event_type <> 'view') AS DOUBLE), 6) AS hit_rate FROM events")
def cache_hit_rate(spark, d):
    c = F.when(F.col("event_type") == "view", "bypass").when(F.col("event_type") == "click", "hit").otherwise("miss")
    return measures.hit_rate(read(spark, d, "events").select(c.alias("cache")), "cache")


@query("recent_50", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_50(spark, d):
    return measures.recent(read(spark, d, "events").select("ts", "event_id", "user_id"), "ts", "event_id", 50).select("event_id", "user_id")


def _judged(spark, d):
    """labels with a prediction from the text: symbols and length."""
    docs = read(spark, d, "documents").select("doc_id", "lang", (F.regexp_count("text", F.lit("[#$%&*|!]")) * 20 < F.length("text")).alias("good"))
    return read(spark, d, "labels").join(docs, "doc_id")


JUDGED = "(SELECT doc_id, quality, toxic, lang, len(regexp_extract_all(text, '[#$%&*|!]')) * 20 < length(text) AS good FROM labels JOIN documents USING (doc_id))"


def _named(x):
    return F.when(x, "good").otherwise("bad")


@query(
    "classification_report",
    f"""WITH j AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS t, CASE WHEN good THEN 'good' ELSE 'bad' END AS g FROM {JUDGED}),
    c AS (SELECT l AS label, count(*) FILTER (WHERE t = l) AS support, count(*) FILTER (WHERE g = l) AS guessed, count(*) FILTER (WHERE t = l AND g = l) AS tp FROM j, (VALUES ('good'), ('bad')) v(l) GROUP BY 1),
    r AS (SELECT label, support, CASE WHEN guessed > 0 THEN CAST(tp AS DOUBLE) / guessed ELSE 0.0 END AS p, CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS r FROM c)
    SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r WHERE support > 0""",
)
def classification_report(spark, d):
    j = _judged(spark, d).select(_named(F.col("quality") == 1).alias("t"), _named(F.col("good")).alias("g"))
    return measures.classification_report(j, "t", "g")


@query("confusion_matrix", f"SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN good THEN 'good' WHEN lang <> 'en' THEN 'NONE' ELSE 'bad' END AS guess, count(*) AS n FROM {JUDGED} GROUP BY ALL")
def confusion_matrix(spark, d):
    j = _judged(spark, d).select(_named(F.col("quality") == 1).alias("t"), F.when(F.col("good"), "good").when(F.col("lang") == "en", "bad").alias("g"))
    return measures.confusion(j, "t", "g")


BINARY = """SELECT {by} tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 1.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 1.0 END, 6) AS recall,
    round(CASE WHEN tp + fp + fn + tn > 0 THEN CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) ELSE 1.0 END, 6) AS accuracy FROM (SELECT {by} count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp,
    count(*) FILTER (WHERE t AND NOT g) AS fn, count(*) FILTER (WHERE NOT t AND NOT g) AS tn FROM (SELECT *, quality = 1 AS t, good AS g{half} FROM {src}) {group})"""


@query("binary_metrics", BINARY.format(by="", half="", src=JUDGED, group=""))
def binary_metrics(spark, d):
    return measures.binary(_judged(spark, d), F.col("quality") == 1, F.col("good"))


@query(
    "eval_split_summary",
    BINARY.format(by="half,", half=", CASE WHEN CAST('0x' || right(sha256(CAST(doc_id AS VARCHAR)), 1) AS INTEGER) % 2 = 0 THEN 'analysis' ELSE 'held_out' END AS half", src=JUDGED, group="GROUP BY half"),
)
def eval_split_summary(spark, d):
    return measures.binary(_judged(spark, d).withColumn("half", measures.half_of(F.col("doc_id").cast("string"))), F.col("quality") == 1, F.col("good"), ["half"])


@query("quality_gates", f"""SELECT metric, kind, bound, value, coalesce(CASE WHEN kind = 'min' THEN value >= bound ELSE value <= bound END, false) AS passed FROM
    (VALUES ('precision', 'min', CAST(0.9 AS DOUBLE)), ('recall', 'min', 0.9), ('fp', 'max', 5.0), ('absent', 'min', 0.5)) g(metric, kind, bound) LEFT JOIN (
    UNPIVOT (SELECT precision, recall, CAST(fp AS DOUBLE) AS fp FROM ({BINARY.format(by="", half="", src=JUDGED, group="")})) ON COLUMNS(*) INTO NAME metric VALUE value) USING (metric)""")
def quality_gates(spark, d):
    m = binary_metrics(spark, d).select(F.expr("stack(3, 'precision', precision, 'recall', recall, 'fp', cast(fp as double)) as (metric, value)"))
    return measures.gates(m, {"precision": ("min", 0.9), "recall": ("min", 0.9), "fp": ("max", 5.0), "absent": ("min", 0.5)})


@query(
    "entity_prf",
    """WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) AS e, list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}')) AS f FROM conversations WHERE role = 'user'),
    c AS (SELECT CAST(sum(len(list_intersect(e, f))) AS BIGINT) AS tp, CAST(sum(len(list_filter(f, lambda x: NOT list_contains(e, x)))) AS BIGINT) AS fp, CAST(sum(len(list_filter(e, lambda x: NOT list_contains(f, x)))) AS BIGINT) AS fn FROM w),
    t AS (SELECT 'words' AS type, * FROM c UNION ALL SELECT 'same', tp + fn, 0, 0 FROM c UNION ALL SELECT NULL, 2 * tp + fn, fp, fn FROM c),
    r AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS p, tp / CAST(tp + fn AS DOUBLE) AS r FROM t)
    SELECT type, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM r""",
)
def entity_prf(spark, d):
    words = lambda n: F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{n},}}"), F.lit(0))
    c = read(spark, d, "conversations").where("role = 'user'").select(words(6).alias("e"), words(7).alias("f"))
    return measures.set_scores(c, {"words": "e", "same": "e"}, {"words": "f", "same": "e"})


@query("category_counts", "SELECT lang AS category, count(*) AS n FROM documents GROUP BY 1")
def category_counts(spark, d):
    return read(spark, d, "documents").groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("audit_hash", "SELECT c_custkey, substr(sha256('salt' || c_name), 1, 16) AS who FROM customer")
def audit_hash(spark, d):
    return read(spark, d, "customer").select("c_custkey", files.salted_hash("salt", F.col("c_name")).alias("who"))


@query("manifest_check", "SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' WHEN doc_id % 11 = 0 THEN 'no_licence' ELSE 'ok' END AS status FROM documents")
def manifest_check(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("found"))
    listed = docs.select("name", F.when(F.col("doc_id") % 5 == 0, F.lit("0")).otherwise(F.col("found")).alias("sha256"), F.when(F.col("doc_id") % 11 > 0, "public domain").alias("licence"))
    return files.compare_manifest(listed, docs.where("doc_id % 7 > 0").select("name", "found"))


@query("exact_cache_key", "SELECT conv_id, turn, 'ans:' || CASE WHEN conv_id % 2 = 0 THEN 'P' || lpad(CAST(conv_id AS VARCHAR), 6, '0') ELSE 'global' END || ':' || substr(sha256(concat_ws(chr(1), lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), CASE WHEN conv_id % 2 = 0 THEN 'P' || lpad(CAST(conv_id AS VARCHAR), 6, '0') ELSE '' END, '', 'drug_labels,guidelines', 'k=5', '1000003')), 1, 32) AS key FROM conversations")
def exact_cache_key(spark, d):
    scope = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("P"), F.lpad(F.col("conv_id").cast("string"), 6, "0")))
    key = routing.cache_key(F.col("text"), scope, F.lit(None).cast("string"), F.array(F.lit("guidelines"), F.lit("drug_labels")), F.lit("k=5"), F.lit(1000003))
    return read(spark, d, "conversations").select("conv_id", "turn", key.alias("key"))


def _at(c="ts"):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


@query(
    "singleflight_dedupe",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS a FROM events),
    l AS (SELECT user_id, min(a) AS since, 1 AS flight FROM e GROUP BY 1
      UNION ALL SELECT l.user_id, (SELECT min(a) FROM e WHERE e.user_id = l.user_id AND e.a > l.since + 3600), flight + 1 FROM l WHERE l.since IS NOT NULL),
    f AS (SELECT e.*, l.since, CAST(l.flight AS BIGINT) AS flight FROM e ASOF JOIN (SELECT * FROM l WHERE since IS NOT NULL) l ON e.user_id = l.user_id AND e.a >= l.since)
    SELECT event_id, user_id, flight, row_number() OVER (PARTITION BY user_id, flight ORDER BY a, event_id) = 1 AS leader FROM f""",
)
def singleflight_dedupe(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", _at().alias("at"))
    return state.single_flight(e, "user_id", "at", "event_id", 3600.0)


def _cache_log(spark, d):
    e = read(spark, d, "events")
    op = F.when(F.col("event_type").isin("view", "click"), "get").when(F.col("event_type") == "error", "invalidate_tag").otherwise("set")
    tag = F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string"))
    return e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 16).cast("string")).alias("shard"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("key"), tag.alias("tags"),
        (F.col("value") * 3600).alias("ttl"), _at().alias("at"),
    )


@query("lru_replay")
def lru_replay(spark, d):
    return state.lru_replay(_cache_log(spark, d), 8)


@query("lru_stats")
def lru_stats(spark, d):
    """Hits, misses, expirations and evictions of the replay."""
    out = state.lru_replay(_cache_log(spark, d), 8)
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return out.groupBy("shard").agg(*[count(o) for o in ("hit", "miss", "expired", "evicted")])


@query(
    "token_bucket",
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS user, event_id AS seq, epoch(ts) AS a, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS i FROM events),
    r AS (SELECT user, seq, a, i, CAST(2.0 AS DOUBLE) AS level FROM e WHERE i = 1
      UNION ALL SELECT e.user, e.seq, e.a, e.i, least(2.0, r.level - CASE WHEN r.level >= 1 THEN 1 ELSE 0 END + (e.a - r.a) * 0.05 / 60) FROM r JOIN e ON e.user = r.user AND e.i = r.i + 1)
    SELECT user, seq, level >= 1 AS allowed, CASE WHEN level >= 1 THEN 0.0 ELSE round((1 - level) * 60 / 0.05, 3) END AS wait FROM r""",
)
def token_bucket(spark, d):
    log = read(spark, d, "events").select(F.col("user_id").cast("string").alias("user"), F.col("event_id").alias("seq"), _at().alias("at"))
    return state.token_bucket(log, per_minute=0.05, burst=2).withColumn("wait", F.round("wait", 3))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = state.windowed_counts(e, "ts", "event_type", "1 day", "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(
    "event_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = state.sessions(e, "ts", "user_id", "6 hours", "1 hour")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("stop"), "n")


@query("answer_stream_pieces", r"SELECT conv_id, turn, count(*) AS pieces, max(length(p)) AS longest FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^\s]+\s*')) AS p FROM conversations WHERE role = 'assistant') GROUP BY ALL")
def answer_stream_pieces(spark, d):
    c = read(spark, d, "conversations").where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("k"), F.col("text").alias("answer"))
    p = state.answer_tokens(c, "k")
    return p.groupBy("k").agg(F.count(F.lit(1)).alias("pieces"), F.max(F.length("piece")).cast("long").alias("longest")).select("k.conv_id", "k.turn", "pieces", "longest")


_PLACE = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"


@query(
    "ring_load",
    f"""WITH p AS (SELECT id % 8 AS node, {_PLACE.format("'point:' || id")} AS p FROM range(512) t(id)), k AS (SELECT {_PLACE.format("CAST(o_orderkey AS VARCHAR)")} AS h FROM orders),
    o AS (SELECT coalesce(p.node, (SELECT arg_min(node, p) FROM p)) AS node FROM k ASOF LEFT JOIN p ON k.h <= p.p) SELECT node, count(*) AS n FROM o GROUP BY 1""",
)
def ring_load(spark, d):
    return measures.ring_load(read(spark, d, "orders"), "o_orderkey", 8)


@query("store_sizes", "SELECT 'documents' AS store, lang AS part, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'vectors', CAST(label AS VARCHAR), count(*) FROM embeddings GROUP BY 2")
def store_sizes(spark, d):
    docs = read(spark, d, "documents").groupBy(F.lit("documents").alias("store"), F.col("lang").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return docs.unionByName(read(spark, d, "embeddings").groupBy(F.lit("vectors").alias("store"), F.col("label").cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n")))
