"""Tool-call linking for chat data, as joins and SQL functions only.

Calls and results are hash-joined by identifier, calls are ordered by their depth below the call whose result they use, their
arguments are validated against schemas, and each linked record is written as canonical JSON (sorted keys, no spaces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.storage import stored

#: Names of JSON types for what schema_of_variant says.
JSON_TYPES = {"STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "DOUBLE": "number", "FLOAT": "number", "VOID": "null"}


def call_depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): 0 for a call that follows none, else one more than the call it follows;
    null for calls on a cycle or behind one. A call that follows an unknown one counts as following none.

    Pointers are doubled: each round every call looks twice as far up, so a chain of n calls takes log2(n) rounds."""
    known = calls.select("conv_id", F.col("call_id").alias("up"))
    state = calls.select("conv_id", "call_id", F.col("after").alias("up")).join(known.withColumn("known", F.lit(1)), ["conv_id", "up"], "left")
    state = stored(state.select("conv_id", "call_id", F.when(F.col("known") == 1, F.col("up")).alias("up")).withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1)))
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = stored(state.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def argument_faults(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with fault: null, or what is wrong with the arguments: "not an object", "no schema", "missing: p", "type: p", "unknown: p".

    schemas: (name, param, type, required); a tool's parameters are gathered in one row, the types are JSON's."""
    spec = schemas.groupBy(F.col("name").alias("tool")).agg(F.sort_array(F.collect_set(F.struct("param", "type", "required"))).alias("spec"))
    joined = calls.join(spec, calls["name"] == F.col("tool"), "left")
    values = F.from_json("arguments", "map<string,variant>")
    kinds = F.create_map(*(F.lit(x) for pair in JSON_TYPES.items() for x in pair))
    kind = F.transform_values(F.col("values"), lambda _, v: F.coalesce(kinds[F.schema_of_variant(v)], F.when(F.schema_of_variant(v).startswith("DECIMAL"), "number"), F.lower(F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1))))
    joined = joined.withColumn("values", F.when(F.trim("arguments").startswith("{") & F.try_parse_json("arguments").isNotNull(), values)).withColumn("kinds", kind)

    def wrong(p):
        found = F.col("kinds")[p["param"]]
        return F.when(found.isNull() & p["required"], F.concat(F.lit("missing: "), p["param"])).when(
            found.isNotNull() & (found != p["type"]) & ~((found == "integer") & (p["type"] == "number")), F.concat(F.lit("type: "), p["param"])
        )

    listed = F.filter(F.transform(F.col("spec"), wrong), lambda x: x.isNotNull())
    unknown = F.array_except(F.map_keys("kinds"), F.transform(F.col("spec"), lambda p: p["param"]))
    fault = (
        F.when(F.col("kinds").isNull(), "not an object")
        .when(F.col("spec").isNull(), "no schema")
        .when(F.size(listed) > 0, F.element_at(listed, 1))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_min(unknown)))
    )
    return joined.withColumn("fault", fault).drop("tool", "spec", "values", "kinds")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call, and for each result without one: conv_id, call_id, depth (its place in topological
    order; ties by call_id), status ("ok", "no result", "no call", "cycle", or the fault of its arguments) and record, canonical JSON.

    calls: (conv_id, call_id, name, arguments: JSON text, after: call_id or null); results: (conv_id, call_id, content).
    Of several calls or results with one identifier the least row counts. Rows whose conv_id or call_id is null link with
    nothing and are left out; null content is JSON null; empty tables give an empty result; further columns are left out.
    """
    key = ["conv_id", "call_id"]
    calls = stored(calls.dropna(subset=key).groupBy(*key).agg(F.min(F.struct("name", "arguments", "after")).alias("c")).select(*key, "c.*"))
    results = results.dropna(subset=key).groupBy(*key).agg(F.min(F.struct("content")).alias("r")).select(*key, F.col("r.content").alias("content"), F.lit(True).alias("answered"))
    checked = argument_faults(calls, schemas).withColumn("called", F.lit(True)).join(call_depths(calls), key)
    linked = checked.join(results.hint("shuffle_hash"), key, "full")
    status = (
        F.when(F.col("called").isNull(), "no call")
        .when(F.col("depth").isNull(), "cycle")
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("answered").isNull(), "no result")
        .otherwise("ok")
    )
    # keys in the alphabet's order; arguments are parsed, so that their keys are sorted as well
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.col("arguments").alias("text"))), F.lit("null"))
    fields = [("after", F.col("after")), ("arguments", None), ("id", F.col("call_id")), ("name", F.col("name")), ("result", F.col("content"))]
    parts = [F.lit("{")]
    for n, (name, value) in enumerate(fields):
        text = arguments if value is None else F.coalesce(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(""))
        text = text if value is None else F.when(text == "", "null").otherwise(text)
        parts += [F.lit(("," if n else "") + f'"{name}":'), text]
    return linked.select(*key, "depth", status.alias("status"), F.concat(*parts, F.lit("}")).alias("record"))


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas from turns: what a user says is a call of the tool "reply", after the user's turn before it (two turns up);
    what the assistant says next is its result. System turns are calls of "instruct", which have no schema."""
    at = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").dropna(subset=["conv_id", "turn"])
    spoken = at.where(F.col("role").isin("user", "system"))
    text = F.coalesce("text", F.lit(""))
    arguments = F.to_json(F.struct(text.alias("text"), F.length(text).alias("n_chars")))
    calls = spoken.select(
        "conv_id", F.concat(F.lit("t"), F.col("turn")).alias("call_id"), F.when(F.col("role") == "user", "reply").otherwise("instruct").alias("name"), arguments.alias("arguments"),
        F.when(F.col("role") == "user", F.concat(F.lit("t"), F.col("turn") - 2)).alias("after"),
    )
    results = at.where("role = 'assistant'").select("conv_id", F.concat(F.lit("t"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = conversations.sparkSession.createDataFrame([("reply", "text", "string", True), ("reply", "n_chars", "integer", True)], "name string, param string, type string, required boolean")
    return calls, results, schemas
