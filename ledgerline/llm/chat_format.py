"""Chat formatting with tool-call linking, in DataFrame functions only.

A message whose text is a JSON object may hold `tool_calls` (assistant: id,
name, arguments), `tool_call_id` with `content` (tool), or `tools` (system:
name and parameters, a JSON schema).  Other texts are plain messages.  Calls and
results are hash-joined by (conversation, id); arguments are held against the
conversation's schema of that name; each event (message, call, result) becomes
canonical JSON: keys in order, no spaces.

Topological order.  The events of a conversation depend on one another so: a
message on the messages of smaller turns, a call on its message and on the calls
before it in the same message, a result on the call it is linked to.  An event's
place (order_turn, order_phase, order_seq, order_own) is a linear extension of
that order: a result takes the turn of its call if its own is smaller, phase 2
comes after calls (1) and messages (0), results stand in the order of their
calls, then of their own turns; what is left alike is sorted by json, and events
alike in that too are the same text.  So no conversation is ever gathered in one
task; sorting by conv_id, these and json gives the formatted chat.

Schemas.  type (one or a list), enum, const, required, properties,
additionalProperties, items, minimum, maximum, exclusiveMinimum,
exclusiveMaximum, minLength, maxLength, minItems, maxItems and pattern are
checked, down to DEPTH levels of nested objects and arrays.  valid is false where
one fails; else null where there is no schema, or where it uses a keyword of
UNCHECKED or goes deeper; else true.  Arguments given as a string of JSON count
as that JSON.

Defined cases: null or empty text: a message with that content; very long texts
are whole contents; malformed JSON: a plain message; a result without a call:
status orphan, at its own turn; a call without a result: status open; ids that
repeat in a conversation: results link to the first call (least turn, then place
in it, then arguments); schemas that repeat: the least by its text; a null
conv_id links nothing; a null turn stands before all others; rows that repeat
are events each, calls and results that repeat exactly are one; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Levels of nested schemas that are checked.
DEPTH = 6
#: Keywords that leave a call's validity open unless another one fails: fixed values.
UNCHECKED = "$ref oneOf anyOf allOf not if then else patternProperties propertyNames dependencies dependentRequired dependentSchemas uniqueItems contains prefixItems multipleOf minProperties maxProperties unevaluatedProperties unevaluatedItems format".split()


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, order_turn, order_phase, order_seq, order_own, kind, turn, call_id, status, valid, json."""
    base = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower("role").alias("role"), "text")
    v = F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text"))
    rows = base.withColumn("v", v).withColumn("tool_id", F.expr("try_variant_get(v, '$.tool_call_id', 'string')")).withColumn("is_result", (F.col("role") == "tool") & F.col("tool_id").isNotNull())

    calls = (
        rows.where((F.col("role") == "assistant") & F.col("v").isNotNull())
        .select("conv_id", "turn", F.posexplode(F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')")).alias("seq", "c"))
        .select("conv_id", "turn", "seq", F.expr("try_variant_get(c, '$.id', 'string')").alias("call_id"), F.expr("try_variant_get(c, '$.name', 'string')").alias("name"), F.to_json(F.expr("coalesce(try_parse_json(if(schema_of_variant(variant_get(c, '$.arguments', 'variant')) = 'STRING', variant_get(c, '$.arguments', 'string'), null)), variant_get(c, '$.arguments', 'variant'))")).alias("arguments"))
        .distinct()
    )
    schemas = (
        rows.where((F.col("role") == "system") & F.col("v").isNotNull())
        .select("conv_id", F.explode(F.expr("try_variant_get(v, '$.tools', 'array<variant>')")).alias("t"))
        .select("conv_id", F.expr("try_variant_get(t, '$.name', 'string')").alias("name"), F.to_json(F.expr("try_variant_get(t, '$.parameters', 'variant')")).alias("schema"))
        .where("conv_id is not null and name is not null")
        .groupBy("conv_id", "name")
        .agg(F.min("schema").alias("schema"))
    )
    checked = validated(calls.join(schemas, ["conv_id", "name"], "left")).select("conv_id", "turn", "seq", "call_id", "name", "arguments", "valid")

    results = rows.where("is_result").select("conv_id", "turn", F.col("tool_id").alias("call_id"), F.expr("coalesce(try_variant_get(v, '$.content', 'string'), to_json(try_variant_get(v, '$.content', 'variant')))").alias("content")).distinct()
    firsts = checked.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "seq", "arguments")).alias("at"))
    answered = results.where("conv_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("answers"))

    call_rows = (
        checked.join(firsts, ["conv_id", "call_id"], "left")
        .join(answered, ["conv_id", "call_id"], "left")
        .withColumn("linked", F.col("answers").isNotNull() & F.coalesce(F.col("at.turn").eqNullSafe(F.col("turn")) & (F.col("at.seq") == F.col("seq")) & F.col("at.arguments").eqNullSafe(F.col("arguments")), F.lit(False)))
        .select(
            "conv_id", F.col("turn").alias("order_turn"), F.lit(1).alias("order_phase"), F.col("seq").cast("long").alias("order_seq"), F.col("turn").alias("order_own"), F.lit("call").alias("kind"), "turn", "call_id",
            F.when(F.col("linked"), "linked").otherwise("open").alias("status"), "valid",
            F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), _json_string("call_id"), F.lit(',"name":'), _json_string("name"), F.lit("}")).alias("json"),
        )
    )
    result_rows = results.join(firsts, ["conv_id", "call_id"], "left").select(
        "conv_id", F.greatest("turn", F.col("at.turn")).alias("order_turn"), F.lit(2).alias("order_phase"), F.coalesce(F.col("at.seq"), F.lit(-1)).cast("long").alias("order_seq"), F.col("turn").alias("order_own"), F.lit("result").alias("kind"), "turn", "call_id",
        F.when(F.col("at").isNotNull(), "linked").otherwise("orphan").alias("status"), F.lit(None).cast("boolean").alias("valid"),
        F.concat(F.lit('{"content":'), _json_string("content"), F.lit(',"tool_call_id":'), _json_string("call_id"), F.lit("}")).alias("json"),
    )
    content = F.when(F.col("v").isNotNull() & (F.col("role") == "assistant") & F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')").isNotNull(), F.expr("try_variant_get(v, '$.content', 'string')")).otherwise(F.col("text"))
    message_rows = rows.where("not coalesce(is_result, false)").withColumn("content", content).select(
        "conv_id", F.col("turn").alias("order_turn"), F.lit(0).alias("order_phase"), F.lit(0).cast("long").alias("order_seq"), F.col("turn").alias("order_own"), F.lit("message").alias("kind"), "turn", F.lit(None).cast("string").alias("call_id"),
        F.lit("plain").alias("status"), F.lit(None).cast("boolean").alias("valid"),
        F.concat(F.lit('{"content":'), _json_string("content"), F.lit(',"role":'), _json_string("role"), F.lit("}")).alias("json"),
    )
    return message_rows.unionByName(call_rows).unionByName(result_rows)


def _node(s: str, v: str) -> tuple[str, str]:
    """SQL: whether a value breaks its schema at this node, and the pairs of nodes below."""
    kind = f"coalesce(schema_of_variant({v}), 'VOID')"
    number = f"try_variant_get({v}, '$', 'double')"
    is_number = f"({kind} in ('BIGINT', 'DOUBLE', 'FLOAT') or {kind} like 'DECIMAL%')"
    is_object, is_array = f"({kind} like 'OBJECT%')", f"({kind} like 'ARRAY%')"
    key = lambda k, t: f"try_variant_get({s}, '$.{k}', '{t}')"
    types = f"coalesce({key('type', 'array<string>')}, array({key('type', 'string')}))"
    one = f"""case t when 'string' then {kind} = 'STRING' when 'integer' then {is_number} and {number} = floor({number}) when 'number' then {is_number}
      when 'boolean' then {kind} = 'BOOLEAN' when 'array' then {is_array} when 'object' then {is_object} when 'null' then {kind} = 'VOID' else true end"""
    given, props = f"try_variant_get({v}, '$', 'map<string, variant>')", key("properties", "map<string, variant>")
    items = f"try_variant_get({v}, '$', 'array<variant>')"
    text = f"try_variant_get({v}, '$', 'string')"
    broken = [
        f"{key('type', 'variant')} is not null and not exists({types}, t -> coalesce({one}, true))",
        f"{key('enum', 'array<variant>')} is not null and not exists({key('enum', 'array<variant>')}, e -> coalesce(to_json(e), 'null') = coalesce(to_json({v}), 'null'))",
        f"{key('const', 'variant')} is not null and to_json({key('const', 'variant')}) <> coalesce(to_json({v}), 'null')",
        f"{is_object} and exists({key('required', 'array<string>')}, r -> not array_contains(map_keys({given}), r))",
        f"{is_object} and {key('additionalProperties', 'boolean')} = false and exists(map_keys({given}), k -> not coalesce(array_contains(map_keys({props}), k), false))",
        *(f"{is_number} and {number} {op} {key(k, 'double')}" for k, op in (("minimum", "<"), ("maximum", ">"), ("exclusiveMinimum", "<="), ("exclusiveMaximum", ">="))),
        *(f"{kind} = 'STRING' and length({text}) {op} {key(k, 'int')}" for k, op in (("minLength", "<"), ("maxLength", ">"))),
        *(f"{is_array} and size({items}) {op} {key(k, 'int')}" for k, op in (("minItems", "<"), ("maxItems", ">"))),
        f"{kind} = 'STRING' and not ({text} rlike {key('pattern', 'string')})",
    ]
    bad = " or ".join(f"coalesce({b}, false)" for b in broken)
    none = "cast(array() as array<struct<s: variant, v: variant>>)"
    named = f"transform(filter(map_entries({props}), p -> array_contains(map_keys({given}), p.key)), p -> named_struct('s', p.value, 'v', {given}[p.key]))"
    other = f"transform(filter(map_entries({given}), p -> not coalesce(array_contains(map_keys({props}), p.key), false)), p -> named_struct('s', {key('additionalProperties', 'variant')}, 'v', p.value))"
    each = f"transform({items}, i -> named_struct('s', {key('items', 'variant')}, 'v', i))"
    schema_like = lambda k: f"coalesce(schema_of_variant({key(k, 'variant')}) like 'OBJECT%', false)"
    below = f"""concat(if({is_object} and {props} is not null, {named}, {none}), if({is_object} and {schema_like('additionalProperties')}, {other}, {none}), if({is_array} and {schema_like('items')}, {each}, {none}))"""
    return bad, below


def validated(calls: DataFrame) -> DataFrame:
    """calls (arguments and schema as JSON, or null) with `valid`."""
    bad, below = _node("x.s", "x.v")
    # Not every keyword's name is a path of its own, so keys are looked up in the object's map.
    odd = f"coalesce(arrays_overlap(map_keys(try_variant_get(x.s, '$', 'map<string, variant>')), array({', '.join(map(repr, UNCHECKED))})), false)"
    out = calls.withColumn("_p0", F.expr("array(named_struct('s', try_parse_json(schema), 'v', try_parse_json(coalesce(arguments, 'null'))))"))
    for i in range(DEPTH):
        out = out.withColumn(f"_p{i + 1}", F.expr(f"flatten(transform(_p{i}, x -> {below}))"))
    broken, open_ = (" or ".join(f"exists(_p{i}, x -> {what})" for i in range(DEPTH)) for what in (bad, odd))
    valid = F.expr(f"case when schema is null then null when {broken} then false when ({open_}) or size(_p{DEPTH}) > 0 then null else true end")
    return out.withColumn("valid", valid).drop(*(f"_p{i}" for i in range(DEPTH + 1)))


def _json_string(column: str) -> Column:
    """A JSON string, or null: the value that to_json writes for one field."""
    whole = F.to_json(F.struct(F.col(column).alias("x")))
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
