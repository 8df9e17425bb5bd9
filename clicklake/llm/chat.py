"""Chat formatting: tool calls linked with their results, in order, checked, as canonical JSON.

All steps are DataFrame expressions; JSON is parsed once, into a variant, whose objects
keep their keys sorted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal_rows, running_sum, stored

PLACES_PER_BUCKET = 1024
# The level of calls that need themselves, by way of others or not: after all others.
IN_A_CIRCLE = 2**62

FIELD_NAMES = ("name", "type", "required", "minimum", "maximum", "choices")
FIELD = "array<struct<name:string,type:string,required:boolean,minimum:double,maximum:double,choices:array<string>>>"


def tool_fields(schema: Mapping) -> list[dict]:
    """The fields of a tool's parameters, given as a JSON schema of an object.

    Read are ``properties`` with ``type``, ``minimum``, ``maximum`` and ``enum`` (of strings),
    and ``required``. Fields that are named in neither are refused.
    """
    required = set(schema.get("required", ()))
    fields = dict.fromkeys(required, {}) | dict(schema.get("properties", {}))
    return [
        dict(zip(FIELD_NAMES, (n, f.get("type"), n in required, f.get("minimum"), f.get("maximum"), f.get("enum")), strict=True))
        for n, f in sorted(fields.items())
    ]


def _kind(value: Column) -> Column:
    """The JSON type of a variant."""
    kind = F.schema_of_variant(value)
    number = kind.rlike(r"^(DECIMAL|DOUBLE|FLOAT)")
    return (
        F.when(kind.isin("BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)"), "integer")
        .when(number, "number")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("null")
    )


def argument_errors(value: Column, fields: Column, known: Column) -> Column:
    """What is wrong with the arguments (a variant), as an array of texts; empty if nothing is."""
    given = F.try_variant_get(value, "$", "map<string,variant>")
    none = F.array().cast("array<string>")

    def check(field: Column) -> Column:
        held = F.try_element_at(given, field["name"])
        kind, number = _kind(held), F.try_variant_get(held, "$", "double")
        fits = (kind == field["type"]) | ((field["type"] == "number") & (kind == "integer")) | field["type"].isNull()
        wrong = lambda text: F.concat(F.lit(f"{text}:"), field["name"])
        return (
            F.when(held.isNull(), F.when(field["required"], wrong("missing")))
            .when(~fits, wrong("type"))
            .when(kind.isin("integer", "number") & ((number < field["minimum"]) | (number > field["maximum"])), wrong("range"))
            .when(
                field["choices"].isNotNull()
                & ~F.coalesce(F.array_contains(field["choices"], F.try_variant_get(held, "$", "string")), F.lit(False)),
                wrong("choice"),
            )
        )

    names = F.transform(fields, lambda field: field["name"])
    more = F.array_except(F.array_sort(F.map_keys(given)), names)
    found = F.concat(F.transform(fields, check), F.transform(more, lambda name: F.concat(F.lit("unexpected:"), name)))
    return (
        F.when(~known, F.array(F.lit("unknown_tool")))
        .when(value.isNull(), F.array(F.lit("invalid_json")))
        .when(given.isNull(), F.array(F.lit("not_an_object")))
        .otherwise(F.coalesce(F.array_compact(found), none))
    )


def ordered(calls: DataFrame) -> DataFrame:
    """Adds the sort key of a topological order to calls: ``_after`` and ``_level``.

    ``calls`` has a row per ``_conv``, ``call_id``, with ``seq`` and ``needs``, the ids of
    calls of the conversation that come first. Sorted by (``_after``, ``_level``, ``seq``,
    ``call_id``), each call stands after all it needs, and calls that are listed in such an
    order already keep their places. ``_after`` is the largest ``seq`` of a call and all it
    needs; ``_level`` counts the calls of the same ``_after`` on the longest way to it.
    Calls in a circle, and those that need one at their place, have the level ``IN_A_CIRCLE``.

    The rounds are as many as there are calls on the longest way of needs that go against
    ``seq``; needs that follow it take none.
    """
    named = ["_conv", "call_id"]
    nodes = stored(calls.select(*named, "seq", "needs"), "chat-calls")
    parents = nodes.select("_conv", F.col("call_id").alias("_need"))
    edges = nodes.select(*named, F.explode(F.array_distinct("needs")).alias("_need")).join(parents, ["_conv", "_need"])
    edges = stored(edges.select(*named, "_need"), "chat-needs")
    at = nodes.select(*named, F.col("seq").alias("_after"))
    while True:
        first = at.select("_conv", F.col("call_id").alias("_need"), F.col("_after").alias("_other"))
        pushed = edges.join(first, ["_conv", "_need"]).groupBy(*named).agg(F.max("_other").alias("_other"))
        moved = at.join(pushed, named, "left").withColumn("_moved", F.coalesce(F.col("_other") > F.col("_after"), F.lit(False)))
        moved = stored(moved.select(*named, F.greatest("_after", "_other").alias("_after"), "_moved"), "chat-after")
        at = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            break
    first = at.select("_conv", F.col("call_id").alias("_need"), F.col("_after").alias("_other"))
    tied = edges.join(at, named).join(first, ["_conv", "_need"]).filter("_after = _other")
    tied = stored(tied.select(*named, "_need"), "chat-tied")
    levels = tied.select(*named).limit(0).withColumn("_level", F.lit(0).cast("long"))
    waiting = tied
    while not waiting.isEmpty():
        blocked = waiting.select(*named).distinct()
        # A need that is not blocked itself has its level: the one found for it, or 0.
        open_ = waiting.join(blocked.withColumnRenamed("call_id", "_need"), ["_conv", "_need"], "left_semi")
        ready = blocked.join(open_.select(*named).distinct(), named, "left_anti")
        before = levels.select("_conv", F.col("call_id").alias("_need"), "_level")
        level = F.max(F.coalesce("_level", F.lit(0))) + 1
        now = stored(waiting.join(ready, named, "left_semi").join(before, ["_conv", "_need"], "left").groupBy(*named).agg(level.cast("long").alias("_level")), "chat-level")
        if now.isEmpty():
            levels = levels.unionByName(blocked.withColumn("_level", F.lit(IN_A_CIRCLE)))
            break
        levels = stored(levels.unionByName(now), "chat-levels")
        waiting = stored(waiting.join(now, named, "left_anti"), "chat-tied")
    return calls.join(at, named).join(levels, named, "left").fillna(0, ["_level"])


def linked(calls: DataFrame, results: DataFrame, tools: Mapping[str, Mapping]) -> DataFrame:
    """Tool calls with their results, a row per identifier of a conversation.

    ``calls`` needs ``conv_id``, ``call_id``, ``seq``, ``name``, ``arguments`` (JSON text) and
    ``needs`` (ids of calls to come first); ``results`` needs ``conv_id``, ``call_id``,
    ``seq`` and ``content``; other columns are left out. ``tools`` has the JSON schema of
    each tool's arguments; it goes to every task.

    Gives ``conv_id``, ``call_id``, ``n_calls``, ``n_results``, ``position`` (from 0 within the
    conversation, in topological order; null without a call), ``status``, ``errors`` and
    ``message``, canonical JSON: sorted keys, no blanks, nulls left out. Of several calls or
    results with one identifier the first by ``seq`` and content counts. Status is
    ``orphan`` without a call, else ``circle``, ``invalid``, ``unanswered`` or ``ok``. Null
    identifiers link nothing and their needs are not checked: all calls of a conversation
    without one are one row, and so are its results without one. Null conversations are one conversation; empty tables
    give an empty result.
    """
    spark = calls.sparkSession
    conv = F.to_json(F.struct(F.col("conv_id")))
    call = F.struct("seq", "name", "arguments", F.array_sort(F.array_distinct(F.array_compact(F.coalesce("needs", F.array())))).alias("needs"))
    # Counted and picked where they are read: one identifier may hold any share of the rows.
    first_calls = (
        calls.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_calls"), F.min(call).alias("_call")).withColumn("_conv", conv)
    )
    first_results = (
        results.groupBy("conv_id", "call_id")
        .agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("seq", "content")).alias("_result"))
        .withColumn("_conv", conv)
    )
    named = first_calls.filter("call_id IS NOT NULL").select("_conv", "call_id", "_call.seq", "_call.needs")
    known = literal_rows(spark, [{"_tool": n, "_fields": tool_fields(s)} for n, s in tools.items()], f"_tool:string,_fields:{FIELD}")
    placed = stored(ordered(named.withColumn("seq", F.coalesce("seq", F.lit(0)).cast("long"))), "chat-ordered")
    bucket = F.call_function("div", F.col("_after"), F.lit(PLACES_PER_BUCKET))
    order = ["_after", "_level", "seq", "call_id"]
    placed = running_sum(placed.withColumn("_bucket", bucket), ["_conv"], "_bucket", order, F.lit(1), "position")
    told = first_calls.join(placed.select("_conv", "call_id", "_level", "position"), ["_conv", "call_id"], "left")
    told = told.withColumnRenamed("conv_id", "_of").join(F.broadcast(known), F.col("_call.name") == F.col("_tool"), "left")
    ids = told.join(first_results, ["_conv", "call_id"], "full").withColumn("conv_id", F.coalesce("_of", "conv_id"))
    ids = ids.withColumn("_parsed", F.try_parse_json("_call.arguments"))
    is_call = F.col("n_calls").isNotNull()
    needs = F.when(F.col("call_id").isNotNull(), F.col("_call.needs")).otherwise(F.array().cast("array<string>"))
    missing = F.array_except(needs, F.coalesce("_there", F.array().cast("array<string>")))
    there = edges_there(named)
    ids = ids.join(there, ["_conv", "call_id"], "left")
    errors = F.concat(
        argument_errors(F.col("_parsed"), F.coalesce("_fields", F.array().cast(FIELD)), F.col("_tool").isNotNull()),
        F.transform(missing, lambda n: F.concat(F.lit("no_call:"), n)),
    )
    errors = F.when(is_call, errors).otherwise(F.array().cast("array<string>"))
    status = (
        F.when(~is_call, "orphan")
        .when(F.col("_level") == IN_A_CIRCLE, "circle")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("n_results").isNull() | F.col("call_id").isNull(), "unanswered")
        .otherwise("ok")
    )
    result = F.when(F.col("call_id").isNotNull() | ~is_call, F.col("_result.content"))
    message = F.struct(
        F.col("_parsed").alias("arguments"),
        F.when(F.col("_parsed").isNull(), F.col("_call.arguments")).alias("arguments_text"),
        "call_id",
        F.col("_call.name").alias("name"),
        F.when(F.size("_call.needs") > 0, F.col("_call.needs")).alias("needs"),
        result.alias("result"),
    )
    return ids.withColumn("errors", errors).select(
        "conv_id",
        "call_id",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "position",
        status.alias("status"),
        "errors",
        F.to_json(message).alias("message"),
    )


def edges_there(named: DataFrame) -> DataFrame:
    """For each call the needed calls that its conversation has, as ``_there``."""
    parents = named.select("_conv", F.col("call_id").alias("_need"))
    edges = named.select("_conv", "call_id", F.explode("needs").alias("_need"))
    return edges.join(parents, ["_conv", "_need"]).groupBy("_conv", "call_id").agg(F.collect_set("_need").alias("_there"))


# The tools that the registered query takes the turns of an assistant for.
TOOLS = {
    "search": {
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 0, "maximum": 15}, "deep": {"type": "boolean"}},
        "required": ["query", "limit"],
    },
    "lookup": {
        "properties": {"query": {"type": "string"}, "limit": {"type": "number"}, "mode": {"type": "string", "enum": ["a", "b"]}},
        "required": ["query"],
    },
    "compute": {"properties": {"limit": {"type": "integer"}}, "required": ["limit", "mode"]},
}


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    held = F.to_json(F.struct(text.alias("v")))
    return F.substr(held, F.lit(6), F.char_length(held) - 6)


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of ``conversations``: each assistant's turn calls, the next one answers.

    A call asks for its turn's whole text, needs the call of two turns before, and every other
    pair of calls is listed the wrong way round. By which tool, and with what else, follows
    from the length of the text. Turns of users and of the system are results of the turn
    before them, or of none.
    """
    size = F.char_length(F.coalesce("text", F.lit("")))
    identifier = lambda turn: F.concat_ws("_", F.lit("call"), "conv_id", turn)
    limit = (size % 20).cast("string")
    arguments = F.concat(
        F.lit('{"query": '),
        _quoted(F.coalesce("text", F.lit(""))),
        F.lit(', "limit": '),
        F.when(size % 7 == 0, F.concat(F.lit('"'), limit, F.lit('"'))).otherwise(limit),
        F.when(size % 3 == 0, F.lit(', "deep":true')).otherwise(F.lit("")),
        F.when(size % 3 == 1, F.lit(', "mode" : "b"')).otherwise(F.lit("")),
        F.when(size % 11 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    calls = turns.filter("role = 'assistant'").select(
        "conv_id",
        identifier(F.col("turn")).alias("call_id"),
        F.col("turn").bitwiseXOR(F.lit(2)).alias("seq"),
        F.get(F.array(*map(F.lit, ("search", "lookup", "compute", "other"))), size % 4).alias("name"),
        arguments.alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(identifier(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = turns.filter("role IN ('user', 'system')").select(
        "conv_id", identifier(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content")
    )
    return calls, results


def op1_chat(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` as linked tool calls, a row per identifier."""
    calls, results = turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return linked(calls, results, TOOLS).withColumn("errors", F.array_join("errors", ","))


OP1_SQL = """
WITH calls AS (
  SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id, len(coalesce(text, '')) AS n,
    to_json(coalesce(text, '')) AS query,
    CASE len(coalesce(text, '')) % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'compute' ELSE 'other' END AS name,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
    CASE WHEN turn >= 2 THEN 'call_' || conv_id || '_' || (turn - 2) END AS need
  FROM conversations WHERE role = 'assistant'),
results AS (
  SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text AS content
  FROM conversations WHERE role IN ('user', 'system')),
checked AS (
  SELECT *, need IS NOT NULL AND need NOT IN (SELECT call_id FROM calls) AS lost,
    CASE WHEN name = 'other' THEN ['unknown_tool'] WHEN n % 11 = 0 THEN ['invalid_json'] ELSE list_filter([
      CASE WHEN n % 7 = 0 THEN 'type:limit' WHEN name = 'search' AND n % 20 > 15 THEN 'range:limit' END,
      CASE WHEN name = 'compute' AND n % 3 <> 1 THEN 'missing:mode' END,
      CASE WHEN name <> 'search' AND n % 3 = 0 THEN 'unexpected:deep' END,
      CASE WHEN name = 'search' AND n % 3 = 1 THEN 'unexpected:mode' END,
      CASE WHEN name = 'compute' THEN 'unexpected:query' END], lambda x: x IS NOT NULL) END AS errors,
    CASE WHEN n % 7 = 0 THEN '"' || (n % 20) || '"' ELSE '' || (n % 20) END AS lim
  FROM calls),
whole AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.*, content,
    r.call_id IS NOT NULL AS answered, c.call_id IS NOT NULL AS called,
    list_concat(errors, CASE WHEN lost THEN ['no_call:' || need] ELSE [] END) AS wrong
  FROM checked c FULL JOIN results r ON c.call_id = r.call_id)
SELECT conv_id, call_id, CAST(called AS BIGINT) AS n_calls, CAST(answered AS BIGINT) AS n_results, position,
  CASE WHEN NOT called THEN 'orphan' WHEN len(wrong) > 0 THEN 'invalid' WHEN NOT answered THEN 'unanswered' ELSE 'ok' END AS status,
  CASE WHEN called THEN array_to_string(wrong, ',') ELSE '' END AS errors,
  '{' || CASE WHEN NOT called THEN ''
    WHEN n % 11 = 0 THEN '"arguments_text":' || to_json('{"query": ' || query || ', "limit": ' || lim
      || CASE n % 3 WHEN 0 THEN ', "deep":true' WHEN 1 THEN ', "mode" : "b"' ELSE '' END) || ','
    ELSE '"arguments":{' || CASE WHEN n % 3 = 0 THEN '"deep":true,' ELSE '' END || '"limit":' || lim
      || CASE WHEN n % 3 = 1 THEN ',"mode":"b"' ELSE '' END || ',"query":' || query || '},' END
  || '"call_id":' || to_json(call_id)
  || CASE WHEN called THEN ',"name":' || to_json(name) ELSE '' END
  || CASE WHEN need IS NOT NULL THEN ',"needs":[' || to_json(need) || ']' ELSE '' END
  || CASE WHEN content IS NOT NULL THEN ',"result":' || to_json(content) ELSE '' END || '}' AS message
FROM (SELECT * EXCLUDE (conv_id_1, call_id_1) FROM whole)
"""
