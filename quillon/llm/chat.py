"""Chat formatting with linked tool calls, with DataFrame functions only.

Messages become events: plain messages, calls and results.  A result is
joined to its call by (conversation, call identifier); the order puts a
result after its call even where the input has it before; arguments are
checked against the tool's schema; every event is one line of canonical JSON
(keys sorted, no white space).  Events of a conversation are never gathered
into one group: their order is two key columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,content:string>"
MESSAGE, CALL, RESULT = 0, 1, 2


@dataclass(frozen=True)
class Schema:
    """Argument types (string, integer, number, boolean, array, object) and the required ones."""

    properties: dict[str, str]
    required: tuple[str, ...] = ()
    additional: bool = False


@dataclass(frozen=True)
class Tools:
    schemas: dict[str, Schema] = field(default_factory=dict)


#: In an exchange a user turn is a call of the assistant and the next turn its result.
REPLY = "reply"
EXCHANGE = Tools({REPLY: Schema({"prompt": "string"}, ("prompt",))})


def events(messages: DataFrame, exchanges: bool = True) -> DataFrame:
    """One row per event: conv_id, turn, role, kind, place, call_id, name, arguments, content.

    Assistant messages that are a JSON object with ``tool_calls`` give one
    call each; tool messages that are an object with ``tool_call_id`` give a
    result; all other messages are kept as they are.  With ``exchanges``, a
    user message is also the call of ``reply`` with its text as the prompt
    and identifier conversation:turn, and a plain assistant message the result
    of the turn before it.  Null texts are empty; null roles are kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = F.when(F.col("role").isin("assistant", "tool") & F.startswith(F.ltrim(text), F.lit("{")), F.from_json(text, CALLS))
    rows = messages.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text.alias("text"), read.alias("x"))
    own = lambda turn: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), turn.cast("string"))
    void = F.lit(None).cast("string")
    event = lambda kind, place, call_id, name, arguments, content: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"), content.alias("content"))
    calls = F.transform(F.col("x.tool_calls"), lambda c, i: event(CALL, i, c["id"], c["name"], c["arguments"], void))
    result = F.array(event(RESULT, F.lit(0), F.col("x.tool_call_id"), void, void, F.col("x.content")))
    plain = F.array(event(MESSAGE, F.lit(0), void, void, void, F.col("text")))
    made = F.when((F.col("role") == "assistant") & (F.size("x.tool_calls") > 0), calls).when((F.col("role") == "tool") & F.col("x.tool_call_id").isNotNull(), result)
    if exchanges:
        prompt = F.to_json(F.struct(F.col("text").alias("prompt")))
        made = made.when((F.col("role") == "user") & F.col("turn").isNotNull(), F.array(event(CALL, F.lit(0), own(F.col("turn")), F.lit(REPLY), prompt, void)))
        made = made.when((F.col("role") == "assistant") & F.col("turn").isNotNull(), F.array(event(RESULT, F.lit(0), own(F.col("turn") - 1), void, void, F.col("text"))))
    return rows.select("conv_id", "turn", "role", F.explode(made.otherwise(plain)).alias("e")).select("conv_id", "turn", "role", "e.*")


def problems(name: Column, arguments: Column, tools: Tools) -> Column:
    """What is wrong with the arguments of a call, as an array of short texts; empty: nothing."""
    value = F.try_parse_json(arguments)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    fits = {
        "string": lambda k: k == "STRING", "integer": lambda k: k == "BIGINT", "boolean": lambda k: k == "BOOLEAN",
        "number": lambda k: (k == "BIGINT") | (k == "DOUBLE") | F.startswith(k, F.lit("DECIMAL")),
        "array": lambda k: F.startswith(k, F.lit("ARRAY")), "object": lambda k: F.startswith(k, F.lit("OBJECT")),
    }

    def of(schema: Schema) -> Column:
        found = []
        for p, t in schema.properties.items():
            k = kind(f"$['{p}']")
            missing = F.when(F.lit(p in schema.required), F.lit(f"missing {p}"))
            found.append(F.when(k.isNull(), missing).when(~fits[t](k), F.lit(f"type of {p}")))
        wrong = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
        if schema.additional:
            return wrong
        extra = F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*[F.lit(p) for p in schema.properties]).cast("array<string>"))
        return F.concat(wrong, F.transform(F.array_sort(extra), lambda x: F.concat(F.lit("unknown "), x)))

    checked = F.when(value.isNull() | ~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.array(F.lit("not an object")))
    for tool, schema in tools.schemas.items():
        checked = checked.when(name == tool, of(schema))
    return checked.otherwise(F.array(F.lit("unknown tool")))


def link(found: DataFrame, tools: Tools) -> DataFrame:
    """``events`` with status, problems, order_turn and json.

    status: message; called or unanswered (calls); linked or orphan (results);
    repeated (a later call with an identifier already used; results belong
    to the first).  Order within a conversation: order_turn, kind, turn, place,
    a total order in which every result stands behind its call: at its own
    turn or at its call's, whichever is later.  Only a result depends on
    another event, so there are no cycles.  A message row that is there twice
    gives its events twice, with the same status and order.  Texts of any
    length are one row each.  Numbers are written as Spark writes a variant:
    decimals as they are, those with an exponent as doubles.
    """
    keys = ["conv_id", "call_id"]
    calls = found.where(F.col("kind") == CALL)
    first = calls.where("call_id is not null").groupBy(*keys).agg(F.min(F.struct("turn", "place")).alias("first"))
    answered = found.where((F.col("kind") == RESULT) & F.col("call_id").isNotNull()).select(*keys).distinct().withColumn("answered", F.lit(True)).hint("shuffle_hash")
    known = first.join(answered, (first.conv_id.eqNullSafe(answered.conv_id)) & (first.call_id == answered.call_id), "left").select(first.conv_id.alias("_conv"), first.call_id.alias("_call"), "first", "answered")
    # a row for every call: dealt by call, not by conversation, and hashed
    known = known.hint("shuffle_hash")
    rows = found.join(known, found.conv_id.eqNullSafe(F.col("_conv")) & (found.call_id == F.col("_call")), "left").drop("_conv", "_call")
    same = F.col("first").eqNullSafe(F.struct("turn", "place"))
    status = (
        F.when(F.col("kind") == MESSAGE, "message")
        .when((F.col("kind") == RESULT) & F.col("first").isNotNull(), "linked")
        .when(F.col("kind") == RESULT, "orphan")
        .when(F.col("call_id").isNotNull() & ~same, "repeated")
        .when(F.col("answered"), "called")
        .otherwise("unanswered")
    )
    wrong = F.when(F.col("kind") == CALL, problems(F.col("name"), F.col("arguments"), tools)).otherwise(F.array().cast("array<string>"))
    order = F.when((F.col("kind") == RESULT) & F.col("first").isNotNull(), F.greatest("turn", "first.turn")).otherwise(F.col("turn"))
    line = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "content", "conv_id", "name", "role", "turn"))
    return rows.select(*found.columns, status.alias("status"), wrong.alias("problems"), order.alias("order_turn"), line.alias("json"))


def format_chats(messages: DataFrame, tools: Tools = EXCHANGE, exchanges: bool = True) -> DataFrame:
    """Linked, ordered, validated and serialised events of all conversations."""
    return link(events(messages, exchanges), tools)
