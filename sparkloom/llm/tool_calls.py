"""Chat formatting: tool calls linked with their results, ordered, checked and serialised.

Calls and results are hash-joined by identifier. Calls that name others (``after``) are ordered
topologically by joins of the call table with itself, written to the shared folder, so no conversation is
gathered in one task: chains of calls that wait for one other are shortened by pointer doubling, in rounds that
grow with the logarithm of their length; calls that wait for several get their level when all those have
theirs. Arguments are parsed as JSON and checked against the schema of
their tool. A call is serialised with its result as canonical JSON: keys sorted, no white space.

Defined results: of calls with one id the first by sequence (then by its text) counts, likewise of results; a
null id is an id of its own kind that never matches; calls without result carry null; results without call are left out;
names that no call has do not hold a call back; calls on a cycle, or behind one, have a null level and come last;
arguments that are null or no JSON object are invalid and stay out of the JSON; tools without schema are invalid; further columns are not
read; empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

#: Tool -> argument -> (JSON type, required, least, greatest).
SCHEMAS = {"ask": {"chars": ("integer", True, 1, 400), "conv": ("integer", False, None, None), "turn": ("integer", True, 0, None), "words": ("integer", True, 1, None)}}
_TYPES = {
    "integer": r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)", "string": "^STRING$",
    "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY",
}


def problem(name: Column, parsed: Column, schemas: dict = SCHEMAS) -> Column:
    """The first fault of parsed arguments against the schema of ``name``; null if there is none."""
    out = F.lit("no schema")
    for tool, fields in schemas.items():
        checks = [F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit("arguments are no object"))]
        for field, (kind, required, low, high) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            gone = value.isNull() | F.is_variant_null(value)
            if required:
                checks.append(F.when(gone, F.lit(f"{field} is missing")))
            checks.append(F.when(~gone & ~F.schema_of_variant(value).rlike(_TYPES[kind]), F.lit(f"{field} is not of type {kind}")))
            number = F.try_variant_get(parsed, f"$.{field}", "double")
            if low is not None:
                checks.append(F.when(~gone & (number < low), F.lit(f"{field} is under {low}")))
            if high is not None:
                checks.append(F.when(~gone & (number > high), F.lit(f"{field} is over {high}")))
        known = F.array(*[F.lit(f) for f in fields])
        names = F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))
        checks.append(F.when(F.size(F.array_except(names, known)) > 0, F.lit("unknown argument")))
        out = F.when(name == tool, F.coalesce(*checks)).otherwise(out)
    return out


def _chains(edges: DataFrame, single: DataFrame) -> DataFrame:
    """For calls that wait for one other: the first call up the chain that waits for none or several (``anchor``), and how far up.

    By pointer doubling: every round doubles the stretch that is known, so a chain of n calls takes log n rounds.
    What a round leaves open while it closes nothing new is on a cycle or behind one, and gets no row."""
    up = edges.join(single, "id").select("id", F.col("dep").alias("anchor"), F.lit(1).alias("far"))
    is_single = single.select(F.col("id").alias("anchor"), F.lit(True).alias("open"))
    state = saved(up.join(is_single, "anchor", "left").select("id", "anchor", "far", F.coalesce("open", F.lit(False)).alias("open")), "chains")
    left = None
    while True:
        still = state.where("open").count()
        if still in (0, left):
            return state.where("not open").drop("open")
        left = still
        above = state.select(F.col("id").alias("anchor"), F.col("anchor").alias("a2"), F.col("far").alias("f2"), F.col("open").alias("o2"))
        moved = state.where("open").join(above, "anchor").select("id", F.col("a2").alias("anchor"), (F.col("far") + F.col("f2")).alias("far"), F.col("o2").alias("open"))
        state = saved(state.where("not open").unionByName(moved), "chains")


def levels(calls: DataFrame) -> DataFrame:
    """``id`` and ``level`` (0 for calls that wait for none; null on cycles) of a table with ``id`` and ``after``."""
    wanted = calls.select("id", F.explode("after").alias("dep")).distinct()
    edges = saved(wanted.join(calls.select(F.col("id").alias("dep")), "dep").select("id", "dep"), "edges")
    waits = saved(edges.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "waits")
    single = waits.where("n = 1").select("id")
    roots = calls.select("id").join(waits.select("id"), "id", "left_anti").select("id", F.lit(0).alias("level"))
    hung = _chains(edges, single)
    several = waits.where("n > 1").select("id", "n")
    # What is left is a graph of the calls that wait for several, over chains that count as one step.
    known = roots
    if not several.isEmpty():
        place = hung.unionByName(roots.select("id", F.col("id").alias("anchor"), F.lit(0).alias("far"))).unionByName(several.select("id", F.col("id").alias("anchor"), F.lit(0).alias("far")))
        steps = saved(edges.join(several, "id").join(place.withColumnRenamed("id", "dep"), "dep").select("id", "n", "anchor", "far"), "steps")
        known = saved(roots, "levels")
        while True:  # each round writes only the calls that it gave a level
            ready = (
                steps.join(known.withColumnRenamed("id", "anchor"), "anchor").groupBy("id", "n")
                .agg(F.count(F.lit(1)).alias("have"), F.max(F.col("level") + F.col("far") + 1).alias("level")).where("have = n").select("id", "level")
            )
            fresh = saved(ready.join(known.select("id"), "id", "left_anti"), "fresh")
            if fresh.isEmpty():
                break
            known = known.unionByName(fresh)
    below = hung.join(known.withColumnRenamed("id", "anchor"), "anchor").select("id", (F.col("level") + F.col("far")).alias("level"))
    return calls.select("id").join(known.unionByName(below), "id", "left")


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """``calls``: id, seq, name, arguments (JSON text), after (array of ids). ``results``: id, seq, content.

    Returns id, seq, name, level, problem, json in topological order: by level (none last), then by sequence and id.
    """
    def first(df, tie):
        w = Window.partitionBy("id").orderBy(F.col("seq").asc_nulls_last(), tie)
        return df.where("id is not null").withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")

    called = saved(first(calls.select("id", "seq", "name", "arguments", "after"), "arguments").unionByName(calls.select("id", "seq", "name", "arguments", "after").where("id is null")), "calls")
    answered = first(results.select("id", "seq", "content"), "content").select(F.col("id").alias("_r"), "content")
    # SHUFFLE_HASH: both sides are hashed by id; neither is small enough to broadcast.
    joined = called.join(answered.hint("shuffle_hash"), F.col("id") == F.col("_r"), "left").join(levels(called.where("id is not null")).withColumnRenamed("id", "_l"), F.col("id") == F.col("_l"), "left")
    parsed = F.try_parse_json("arguments")
    told = joined.withColumn("_args", parsed).withColumn("problem", problem(F.col("name"), F.col("_args"), schemas))
    is_object = F.schema_of_variant("_args").startswith("OBJECT")
    message = F.struct(F.when(is_object, F.col("_args")).alias("arguments"), F.col("id"), F.col("name"), F.col("content").alias("result"))
    return told.select("id", "seq", "name", "level", "problem", F.to_json(message, {"ignoreNullFields": "false"}).alias("json")).orderBy(F.col("level").asc_nulls_last(), "seq", "id")


def from_turns(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a plain conversation table: a user turn calls ``ask`` and waits for the user turn two before it;
    the assistant turn that follows is the result."""
    ident = lambda conv, turn: F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit("null")), turn.cast("string"))
    conv, turn = F.col("conv_id"), F.col("turn")
    arguments = F.to_json(F.struct(F.char_length("text").alias("chars"), conv.alias("conv"), turn.alias("turn"), F.regexp_count("text", F.lit(WORD)).alias("words")))
    calls = talks.where((F.col("role") == "user") & turn.isNotNull()).select(
        ident(conv, turn).alias("id"), turn.alias("seq"), F.lit("ask").alias("name"), arguments.alias("arguments"), F.array(ident(conv, turn - 2)).alias("after")
    )
    results = talks.where((F.col("role") == "assistant") & turn.isNotNull()).select(ident(conv, turn - 1).alias("id"), turn.alias("seq"), F.col("text").alias("content"))
    return calls, results


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    calls, results = from_turns(table(spark, sf_dir, "conversations"))
    return link(calls, results).select("id", F.col("seq").alias("turn"), "level", "problem", "json")


ORACLE = r"""
WITH RECURSIVE t AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), 'null') AS c FROM conversations WHERE turn IS NOT NULL),
calls AS (SELECT c || ':' || turn AS id, c, conv_id, turn, length(text) AS chars, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t WHERE role = 'user'),
lv AS (
  SELECT id, c, turn, 0 AS level FROM calls a WHERE NOT EXISTS (SELECT 1 FROM calls b WHERE b.c = a.c AND b.turn = a.turn - 2)
  UNION ALL
  SELECT a.id, a.c, a.turn, lv.level + 1 FROM lv JOIN calls a ON a.c = lv.c AND a.turn = lv.turn + 2)
SELECT calls.id, calls.turn, lv.level,
  CASE WHEN chars < 1 THEN 'chars is under 1' WHEN chars > 400 THEN 'chars is over 400' WHEN calls.turn < 0 THEN 'turn is under 0' WHEN words < 1 THEN 'words is under 1' END AS problem,
  '{"arguments":{"chars":' || chars || ',"conv":' || calls.conv_id || ',"turn":' || calls.turn || ',"words":' || words || '},"id":"' || calls.id || '","name":"ask","result":' ||
    coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS json
FROM calls JOIN lv USING (id) LEFT JOIN t r ON r.c = calls.c AND r.turn = calls.turn + 1 AND r.role = 'assistant'
"""
