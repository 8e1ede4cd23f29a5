"""Operator 7, chat formatting with linked tool calls.  DataFrame functions only.

Messages have ``conv_id, turn, role, text, call_id, tool, arguments, needs``.  A
row with a ``call_id`` is a result if its role is ``tool``, else a call; a call
names its tool, its arguments (JSON text) and the call ids it needs.  Per row:

* calls and results are hash-joined by (conversation, id);
* ``rank`` orders a conversation topologically: sorted by (rank, turn), a call
  comes after all it needs.  rank = max over needs of the needed call's rank,
  plus one where that call stands at the same or a later turn.  Without such
  forward references it is 0 everywhere and the order is that of the turns;
  otherwise chains of references are ranked by pointer doubling (``_ranks``).
  Calls on a cycle, or that need one, have a null rank;
* ``order_rank`` puts all messages in that order, by (order_rank, turn): a
  call's rank, for a result that of its call, 0 for other messages and results
  without a call; null (last) where the call has no rank;
* arguments are checked against the tool's schema;
* the message is serialised as canonical JSON: keys sorted, no white space,
  numbers normalised (Spark's variant type).

``errors`` lists, sorted, what is wrong: ``arguments_not_json``, ``arguments_not_object``,
``cyclic``, ``duplicate_id``, ``missing:<p>``, ``orphan_result``, ``range:<p>``,
``result_not_after_call``, ``type:<p>``, ``unanswered``, ``unknown:<p>``,
``unknown_tool``, ``unresolved:<id>``.

Defined cases: null conversation ids are one conversation; a null turn counts
as after all others; rows without a call id (null) are plain messages; an id
used by several calls belongs to the first (turn, tool, arguments), all of them
are marked; repeated results each link to the call; null and empty texts are
serialised as such; extra columns are dropped.  No step groups a conversation:
all keys are single call ids.  Very long texts and arguments are values of one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmodes.llm.tables import keep

LAST = 2**63 - 1
NULL_KEY = "\u0000null"
#: type name -> the variant types that satisfy it
TYPES = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*)$",
         "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}


def _errors_of(tool: str, schema: dict[str, dict]) -> Column:
    """Schema errors of the variant ``_v`` for one tool; schema: parameter -> type, required, minimum, maximum, enum."""
    found = []
    for name, rule in schema.items():
        path = f"$['{name}']"
        value = F.try_variant_get(F.col("_v"), path, "variant")
        there = F.array_contains("_keys", name)
        if rule.get("required"):
            found.append(F.when(~there, F.lit(f"missing:{name}")))
        right = F.schema_of_variant(value).rlike(TYPES[rule["type"]])
        found.append(F.when(there & ~F.coalesce(right, F.lit(False)), F.lit(f"type:{name}")))
        bad = F.lit(False)
        number = F.try_variant_get(F.col("_v"), path, "double")
        if "minimum" in rule:
            bad = bad | (number < rule["minimum"])
        if "maximum" in rule:
            bad = bad | (number > rule["maximum"])
        if "enum" in rule:
            bad = bad | ~F.try_variant_get(F.col("_v"), path, "string").isin(rule["enum"])
        found.append(F.when(there & right & bad, F.lit(f"range:{name}")))
    known = F.array(*[F.lit(n) for n in schema]).cast("array<string>")
    unknown = F.transform(F.array_except("_keys", known), lambda k: F.concat(F.lit("unknown:"), k))
    return F.concat(F.array(*found).cast("array<string>"), unknown)


def argument_errors(schemas: dict[str, dict[str, dict]]) -> Column:
    """array<string> over the columns ``tool``, ``arguments``, ``_v`` (parsed) and ``_keys``."""
    by_tool = reduce(lambda c, t: c.when(F.col("tool") == t, _errors_of(t, schemas[t])), schemas, F.when(F.lit(False), F.array().cast("array<string>")))
    return (F.when(F.col("_v").isNull(), F.array(F.lit("arguments_not_json")))
            .when(~F.schema_of_variant("_v").startswith("OBJECT<"), F.array(F.lit("arguments_not_object")))
            .otherwise(F.coalesce(by_tool, F.array(F.lit("unknown_tool")))))


def _ranks(edges: DataFrame) -> DataFrame:
    """(conv, id, rank) of the calls that need a known call; null on and behind cycles.  No row: rank 0.

    ``edges``: (conv, id, need, forward) between known calls, kept.  A call with one need points at it:
    pointers are doubled until they reach a call with no need or several, which takes log2 of the longest chain
    rounds.  Calls with several needs then see only each other and calls without needs, and
    are ranked once all they need is, one round per level."""
    if edges.where("forward").isEmpty():
        return edges.limit(0).select("conv", "id", F.lit(0).cast("long").alias("rank"))
    arcs = edges.select("conv", "id", F.col("need").alias("to"), F.col("forward").cast("long").alias("w"))
    fan = keep(arcs.groupBy("conv", "id").agg(F.count("*").alias("n")), "call-fan")
    several, single = fan.where("n > 1").select("conv", "id"), fan.where("n = 1").select("conv", "id")

    def jump(rows: DataFrame, links: DataFrame, columns: list[str]) -> DataFrame:
        """``rows`` with ``to`` moved along ``links``; ``open``: it stands on a link."""
        ahead = links.select("conv", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"), F.col("open").alias("open2"))
        return rows.join(ahead, ["conv", "to"], "left").select(
            *columns, F.coalesce("to2", "to").alias("to"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.coalesce("open2", F.lit(False)).alias("open"))

    ones = arcs.join(single, ["conv", "id"], "left_semi")
    is_link = single.select("conv", F.col("id").alias("to"), F.lit(True).alias("open"))
    links = keep(ones.join(is_link, ["conv", "to"], "left").select("conv", "id", "to", "w", F.coalesce("open", F.lit(False)).alias("open")), "call-jumps")
    longest = single.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    steps = 1
    while steps <= longest and not links.where("open").isEmpty():  # what is open after that many steps has met a cycle
        links = keep(jump(links.where("open"), links, ["conv", "id"]).union(links.where("NOT open").select("conv", "id", "to", "w", "open")), "call-jumps")
        steps *= 2
    links = links.select("conv", "id", F.when(~F.col("open"), F.col("to")).alias("to"), "w", "open")

    # Edges of calls with several needs, ends moved along the pointers; ``below``: rank of the end, once known.
    far = arcs.join(several, ["conv", "id"], "left_semi").join(
        links.select("conv", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"), "open"), ["conv", "to"], "left").select(
        "conv", "id", F.when(F.col("open"), F.lit(None)).otherwise(F.coalesce("to2", "to")).alias("to"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"))
    known = several.select("conv", F.col("id").alias("to"), F.lit(True).alias("later"))
    wait = keep(far.join(known, ["conv", "to"], "left").select(
        "conv", "id", "to", "w", F.when(F.col("to").isNotNull() & F.col("later").isNull(), F.lit(0).cast("long")).alias("below")), "call-waits")
    ranked = None
    while True:
        ready = keep(wait.groupBy("conv", "id").agg(F.count_if(F.col("below").isNull()).alias("open"), F.max(F.col("below") + F.col("w")).alias("rank"))
                     .where("open = 0").select("conv", "id", "rank"), "call-ready")
        if ready.isEmpty():
            break
        ranked = ready if ranked is None else ranked.union(ready)
        told = ready.select("conv", F.col("id").alias("to"), F.col("rank").alias("now"))
        wait = keep(wait.join(ready, ["conv", "id"], "left_anti").join(told, ["conv", "to"], "left")
                    .select("conv", "id", "to", "w", F.coalesce("below", "now").alias("below")), "call-waits")
    cyclic = wait.select("conv", "id").distinct().withColumn("rank", F.lit(None).cast("long"))
    ranked = keep(cyclic if ranked is None else ranked.union(cyclic), "call-ranks")
    ends = ranked.select("conv", F.col("id").alias("to"), F.col("rank").alias("end"), F.lit(True).alias("there"))
    behind = F.col("open") | (F.col("there") & F.col("end").isNull())
    ranks = links.join(ends, ["conv", "to"], "left").select(
        "conv", "id", F.when(~F.coalesce(behind, F.lit(False)), F.coalesce("end", F.lit(0)) + F.col("w")).alias("rank"))
    return ranked.union(ranks)


def format_tool_chat(messages: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """(conv_id, turn, kind, call_id, linked_turn, rank, order_rank, errors, json) for every message."""
    rows = messages.select(
        "conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "call_id", "tool", "arguments", "needs",
        F.coalesce(F.col("conv_id").cast("string"), F.lit(NULL_KEY)).alias("conv"), F.col("call_id").cast("string").alias("id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("at"),
        F.when(F.col("call_id").isNull(), "message").when(F.col("role").eqNullSafe("tool"), "result").otherwise("call").alias("kind"))

    # One row per id: the first call and how many there are; how many results.
    seen = keep(rows.where("id IS NOT NULL").groupBy("conv", "id").agg(
        F.min(F.when(F.col("kind") == "call", F.struct("at", "tool", "arguments", F.col("needs").alias("wants"), "turn"))).alias("first"),
        F.count_if(F.col("kind") == "call").alias("calls"), F.count_if(F.col("kind") == "result").alias("results")), "call-ids")
    edges = seen.where("calls > 0").select("conv", "id", F.col("first.at").alias("at"), F.explode(F.array_distinct("first.wants")).alias("need")).where("need IS NOT NULL")
    known = seen.where("calls > 0").select("conv", F.col("id").alias("need"), F.col("first.at").alias("need_at"))
    edges = keep(edges.join(known, ["conv", "need"], "left")
                 .select("conv", "id", "need", F.col("need_at").isNull().alias("lost"), (F.col("need_at") >= F.col("at")).alias("forward")), "call-edges")
    lost = edges.where("lost").groupBy("conv", "id").agg(F.collect_list(F.concat(F.lit("unresolved:"), "need")).alias("lost"))
    ranks = _ranks(edges.where("NOT lost")).withColumn("ranked", F.lit(True))
    ids = keep(seen.join(lost, ["conv", "id"], "left").join(ranks, ["conv", "id"], "left"), "call-links")

    linked = (rows.where("id IS NOT NULL").join(ids, ["conv", "id"])
              .withColumn("_v", F.when(F.col("kind") == "call", F.try_parse_json(F.col("arguments").cast("string"))))
              .withColumn("_keys", F.coalesce(F.json_object_keys(F.to_json("_v")), F.array().cast("array<string>"))))
    is_call = F.col("kind") == "call"
    after = F.col("at") > F.col("first.at")
    errors = F.array_sort(F.filter(F.concat(
        F.when(is_call, argument_errors(schemas)).otherwise(F.array().cast("array<string>")),
        F.when(is_call, F.coalesce("lost", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
        F.array(F.when(is_call & (F.col("calls") > 1), F.lit("duplicate_id")),
                F.when(is_call & (F.col("results") == 0), F.lit("unanswered")),
                F.when(is_call & F.col("ranked") & F.col("rank").isNull(), F.lit("cyclic")),
                F.when(~is_call & (F.col("calls") == 0), F.lit("orphan_result")),
                F.when(~is_call & (F.col("calls") > 0) & ~after, F.lit("result_not_after_call")))), lambda e: e.isNotNull()))
    call_json = F.when(F.col("_v").isNotNull(), F.to_json(F.to_variant_object(F.struct(
        F.col("_v").alias("arguments"), F.col("call_id").cast("string").alias("call_id"), F.col("text").alias("content"), F.col("tool").alias("name"), "role")))
    ).otherwise(F.to_json(F.to_variant_object(F.struct(
        F.col("arguments").cast("string").alias("arguments"), F.col("call_id").cast("string").alias("call_id"), F.col("text").alias("content"), F.col("tool").alias("name"), "role"))))
    result_json = F.to_json(F.to_variant_object(F.struct(F.col("call_id").cast("string").alias("call_id"), F.col("text").alias("content"), "role")))
    rank = F.when(F.col("ranked").isNull(), F.lit(0).cast("long")).otherwise(F.col("rank"))
    linked = linked.select(
        "conv_id", "turn", "kind", F.col("id").alias("call_id"), F.when(~is_call, F.col("first.turn")).alias("linked_turn"),
        F.when(is_call, rank).alias("rank"), rank.alias("order_rank"), errors.alias("errors"), F.when(is_call, call_json).otherwise(result_json).alias("json"))
    plain = rows.where("id IS NULL").select(
        "conv_id", "turn", "kind", F.col("id").alias("call_id"), F.lit(None).cast(dict(messages.dtypes)["turn"]).alias("linked_turn"),
        F.lit(None).cast("long").alias("rank"), F.lit(0).cast("long").alias("order_rank"), F.array().cast("array<string>").alias("errors"),
        F.to_json(F.to_variant_object(F.struct(F.col("text").alias("content"), "role"))).alias("json"))
    return linked.unionByName(plain)


def tool_turns(conversations: DataFrame) -> DataFrame:
    """Chat turns as tool messages: a user turn is a call, the assistant turn after it its result.

    The tool follows from the text.  Questions are taken in fours: the first three need the one two turns later
    (forward references), the fourth the last of the four before, eight turns earlier."""
    text = F.col("text").cast("string")
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    user, reply = F.col("role").eqNullSafe("user"), F.col("role").eqNullSafe("assistant")
    tool = F.when(F.coalesce(text, F.lit("")).endswith("?"), "search").when(words < 40, "lookup").otherwise("summarise")
    args = (F.when(tool == "search", F.to_json(F.struct(text.alias("query"), words.alias("limit"))))
            .when(tool == "lookup", F.to_json(F.struct(words.alias("words"), text.alias("text"))))
            .otherwise(F.to_json(F.struct(text.alias("text"), F.floor(words / 4).alias("max_words")))))
    name = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    turn = F.col("turn").cast("long")
    return conversations.select(
        "conv_id", "turn", F.when(reply, "tool").otherwise(F.col("role")).alias("role"), F.when(user, F.lit(None).cast("string")).otherwise(text).alias("text"),
        F.when(user, name(turn)).when(reply, name(turn - 1)).alias("call_id"), F.when(user, tool).alias("tool"), F.when(user, args).alias("arguments"),
        F.when(user & (F.floor(turn / 2) % 4 < 3), F.array(name(turn + 2))).when(user & (turn >= 8), F.array(name(turn - 8))).otherwise(F.array().cast("array<string>")).alias("needs"))


SCHEMAS = {
    "search": {"query": {"type": "string", "required": True}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}},
    "lookup": {"text": {"type": "string", "required": True}, "words": {"type": "integer", "required": True, "minimum": 1}},
    "summarise": {"text": {"type": "string", "required": True}, "max_words": {"type": "integer", "required": True, "minimum": 10, "maximum": 1000}},
}
