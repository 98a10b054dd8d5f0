"""Tool-call linking for chat data, with DataFrame operations only.

Calls and results meet in a hash join by conversation and identifier. A call may need the result of one
earlier call; calls are ordered topologically by level, the number of calls they wait for in a chain, found
by doubling: every round a call takes over the ancestor of its ancestor, so a chain of n calls takes about
log2 n rounds, each written to the shared folder. Ordering by (level, turn, call_id) is a topological order
of a conversation. Arguments are parsed, checked against the tool's parameters (known, required, type) and
serialised as canonical JSON: keys in code point order, no white space, null fields left out.

All calls and results of an identifier that is used again are kept. Rows equal in all fields
are one, with a count. A result belongs to the calls of the last turn that isn't after its own; the first such
result goes to the first of these calls (by name, arguments, depends_on), the second to the second and so on, and
one that is left over, has no call before it, or no identifier, is an orphan row. A null turn is before all others
for a call and after them for a result. A needed identifier stands for its last call of an earlier turn, or else
for its first one; of several in that turn, for the first.

Size: equal rows are summed before they meet. Identifiers with one call and one result at most, mostly all, need the
hash joins only. For the others turns are matched in pieces of a global order of ``PIECE`` rows, each
taking over the last turn of the pieces before it from one summary row per piece, so neither a frequent identifier
nor a long conversation is gathered anywhere; no window runs over a conversation.

Defined cases: calls without identifier can't
be linked and are reported, with level 0; a result without call is an orphan row; a needed call that doesn't exist is an error and counts as not needed;
calls in or behind a circle have level -1; arguments that are no JSON object (or repeat a key) are
``not_json`` and are serialised as null; empty tables give no rows; other columns are not read. Of the schemas, rows
without name or parameter are left out, a parameter listed with several types may have any of them and is
required if one row says so, and a type that isn't in ``JSON_TYPES`` allows nothing. Numbers: up to 38 digits are kept exactly and
written without trailing zeros; one without a fractional part is an integer, however it is written, but for an
exponent; others are doubles (1e2 is 100.0), and where that may have cost digits the parameter has the error ``inexact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvgrid.functions.ordinal import global_ordinal
from pvgrid.llm.common import stage

KEY = ["conv_id", "call_id"]
PIECE = 4096

#: Types a parameter may have, and what Spark calls a JSON value of that type.
JSON_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"],
              "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}

#: The kind of every argument. A decimal that is written without a fraction is a whole number.
KINDS = """transform_values(_args, (k, v) -> CASE WHEN schema_of_variant(v) LIKE 'DECIMAL%' AND to_json(v) RLIKE '^-?[0-9]+$' THEN 'BIGINT'
           ELSE regexp_extract(schema_of_variant(v), '^[A-Z]+', 0) END)"""


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls with identifiers; -1 in or behind a circle."""
    parent = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("up"))
    now = stage(calls.join(parent, (F.col("conv_id") == F.col("c")) & (F.col("depends_on") == F.col("up")), "left")
                .select(*KEY, F.col("up").alias("above"), F.col("up").isNotNull().cast("long").alias("level")), "levels")
    total, rounds = now.count(), 0
    while not now.where("above IS NOT NULL").isEmpty() and (1 << rounds) <= 2 * total:
        above = now.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("above").alias("next"),
                           F.col("level").alias("more"))
        now = stage(now.join(above, (F.col("conv_id") == F.col("c")) & (F.col("above") == F.col("i")), "left")
                    .select(*KEY, F.col("next").alias("above"),
                            (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
        rounds += 1
    return now.select(*KEY, F.when(F.col("above").isNotNull(), F.lit(-1)).otherwise(F.col("level")).alias("level"))


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds ``canonical`` and the sorted ``errors`` of (name, arguments) under (name, param, type, required)."""
    allowed = F.create_map(*[x for name, types in JSON_TYPES.items()
                             for x in (F.lit(name), F.array(*[F.lit(t) for t in types]))])
    kinds = F.flatten(F.transform("_named", lambda t: F.coalesce(F.element_at(allowed, t), F.array().cast("array<string>"))))
    params = (schemas.where("name IS NOT NULL AND param IS NOT NULL").groupBy("name", "param")
              .agg(F.collect_set("type").alias("_named"), F.max(F.coalesce("required", F.lit(False))).alias("_must")))
    tools = params.groupBy("name").agg(
        F.collect_list("param").alias("_params"), F.collect_list(F.when(F.col("_must"), F.col("param"))).alias("_required"),
        F.map_from_entries(F.collect_list(F.struct("param", kinds.alias("kinds")))).alias("_types"))
    rows = (calls.join(tools, "name", "left")
            .withColumn("_value", F.expr("try_parse_json(arguments)"))
            .withColumn("_object", F.expr("schema_of_variant(_value) LIKE 'OBJECT<%'"))
            .withColumn("_args", F.expr("from_json(IF(_object, arguments, NULL), 'map<string, variant>')"))
            .withColumn("_kinds", F.expr(KINDS)))
    given = F.map_keys("_args")
    wrong = F.filter(F.array_intersect(given, F.col("_params")), lambda p: ~F.array_contains(
        F.element_at("_types", p), F.element_at("_kinds", p)))
    # a double may stand for a number of more digits than it holds
    inexact = F.filter(given, lambda p: (F.element_at("_kinds", p) == "DOUBLE") & F.col("arguments").rlike("[0-9]{39}"))
    errors = (F.when(F.col("_params").isNull(), F.array(F.lit("unknown_tool")))
              .when(F.col("_args").isNull(), F.array(F.lit("not_json")))
              .otherwise(F.array_sort(F.concat(
                  F.transform(F.array_except("_required", given), lambda p: F.concat(F.lit("missing:"), p)),
                  F.transform(F.array_except(given, F.col("_params")), lambda p: F.concat(F.lit("unknown:"), p)),
                  F.transform(inexact, lambda p: F.concat(F.lit("inexact:"), p)),
                  F.transform(wrong, lambda p: F.concat(F.lit("type:"), p))))))
    return (rows.withColumn("errors", errors).withColumn("_json", F.expr("IF(_object, _value, NULL)"))
            .drop("_params", "_required", "_types", "_value", "_object", "_args", "_kinds"))


def _reported(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """State, errors and JSON of linked rows; ``_needs`` is null if the needed call doesn't exist."""
    state = (F.when(F.col("is_call").isNull(), "orphan_result").when(F.col("level") < 0, "circle")
             .when(F.col("n_results").isNull(), "unanswered").otherwise("answered"))
    rows = checked(rows, schemas).withColumn("state", state)
    lost = F.when(F.col("depends_on").isNotNull() & F.col("_needs").isNull(), F.array(F.lit("missing_call")))
    rows = rows.withColumn("errors", F.when(F.col("is_call"), F.concat("errors", F.coalesce(lost, F.array().cast("array<string>")))))
    # fields in code point order
    text = F.to_json(F.struct(F.col("_json").alias("arguments"), F.col("depends_on"), F.col("call_id").alias("id"),
                              F.col("level"), F.col("name"), F.col("result"), F.col("turn")))
    return rows.select("conv_id", "call_id", "turn", "level", "state", "n_calls", "n_results",
                       (F.size("errors") == 0).alias("valid"), F.array_join("errors", ",").alias("errors"),
                       text.alias("canonical_json"))


def _last_turn(events: DataFrame, piece: int) -> DataFrame:
    """Adds ``since``, the last call's place up to each event, of events in a global ``ordinal``."""
    chunk = [*KEY, "_piece"]
    events = events.withColumns({"_piece": F.floor(F.col("ordinal") / piece), "_call": F.when(F.col("kind") == 1, F.col("place"))})
    before = Window.partitionBy(*KEY).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (events.groupBy(*chunk).agg(F.max("_call").alias("_last"))
              .select(*chunk, F.max("_last").over(before).alias("_carried")))
    inside = Window.partitionBy(*chunk).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return (events.withColumn("_inside", F.max("_call").over(inside)).join(pieces, chunk)
            .withColumn("since", F.greatest("_inside", "_carried")).drop("_piece", "_call", "_inside", "_carried"))


def _linked_once(calls: DataFrame, results: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, _answer) and (node, _needs) by hash joins, of identifiers with one call and one result at most."""
    one = calls.select(*KEY, F.col("node").alias("_call"), F.col("turn").alias("_since"))
    early = F.col("_since").isNull() | F.col("turn").isNull() | (F.col("turn") >= F.col("_since"))
    links = (results.select(*KEY, "turn", F.col("node").alias("_answer")).join(one.hint("shuffle_hash"), KEY).where(early)
             .select(F.col("_call").alias("node"), "_answer"))
    needed = needs.select(*KEY, "node").join(one.hint("shuffle_hash"), KEY).select("node", F.col("_call").alias("_needs"))
    return links, needed


def _linked_by_rank(calls: DataFrame, results: DataFrame, needs: DataFrame, piece: int) -> tuple[DataFrame, DataFrame]:
    """The same of identifiers that are used again, by turns in a global order."""
    def events(rows, kind, place, *ties):
        ties = [F.col(t) for t in ties] + [F.lit(None)] * (3 - len(ties))
        return rows.select(*KEY, F.coalesce(F.col("turn").cast("long"), F.lit(place)).alias("place"), F.lit(kind).alias("kind"),
                           "node", *[t.cast("string").alias(f"_tie{k}") for k, t in enumerate(ties)])
    first, last = -(1 << 63), (1 << 63) - 1
    order = [*KEY, "place", "kind", "_tie0", "_tie1", "_tie2"]
    placed = global_ordinal(events(needs, 0, first).unionByName(events(calls, 1, first, "name", "arguments", "depends_on"))
                            .unionByName(events(results, 2, last, "content")), *[F.col(c) for c in order])
    placed = stage(_last_turn(placed.select(*KEY, "place", "kind", "node", "ordinal"), piece), "placed")
    # calls of one turn follow each other in the order, as do the results that belong to them
    starts = (placed.where("kind > 0 AND since IS NOT NULL").groupBy(*KEY, "since", "kind").agg(F.min("ordinal").alias("_start")))
    ranked = (placed.where("kind > 0").join(starts, [*KEY, "since", "kind"])
              .select(*KEY, "since", "kind", "node", (F.col("ordinal") - F.col("_start")).alias("_rank")))
    ranked = stage(ranked, "ranked")
    links = (ranked.where("kind = 1").select(*KEY, "since", "_rank", "node")
             .join(ranked.where("kind = 2").select(*KEY, "since", "_rank", F.col("node").alias("_answer")), [*KEY, "since", "_rank"])
             .select("node", "_answer"))
    heads = ranked.where("kind = 1 AND _rank = 0").select(*KEY, "since", F.col("node").alias("_needs"))
    earliest = heads.groupBy(*KEY).agg(F.min_by("_needs", "since").alias("_earliest"))
    needed = (placed.where("kind = 0").join(heads, [*KEY, "since"], "left").join(earliest, KEY, "left")
              .select("node", F.coalesce("_needs", "_earliest").alias("_needs")))
    return links, needed


def link_every_call(calls: DataFrame, results: DataFrame, schemas: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per distinct call with the result linked to it, and one per distinct result without call.

    ``calls``: conv_id, call_id, turn, name, arguments, depends_on. ``results``: conv_id, call_id, turn,
    content. ``schemas``: name, param, type, required; one row per parameter, a small table. ``n_calls`` and
    ``n_results`` count equal rows.
    """
    fields, tail = ("turn", "name", "arguments", "depends_on"), ("turn", "content")
    number = F.monotonically_increasing_id()
    calls = stage(calls.groupBy(*KEY, *fields).agg(F.count("*").alias("n_calls")).withColumn("node", number), "calls")
    results = stage(results.groupBy(*KEY, *tail).agg(F.count("*").alias("n_results")).withColumn("node", number), "results")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    needs = calls.where(named & F.col("depends_on").isNotNull()).withColumn("call_id", F.col("depends_on"))
    parts = calls.where(named), results.where(named), needs
    used = (parts[0].select(*KEY, F.lit(1).alias("c"), F.lit(0).alias("r"))
            .unionByName(parts[1].select(*KEY, F.lit(0).alias("c"), F.lit(1).alias("r"))))
    again = stage(used.groupBy(*KEY).agg(F.sum("c").alias("c"), F.sum("r").alias("r")).where("c > 1 OR r > 1").select(*KEY), "used-again")
    if again.isEmpty():
        links, needed = _linked_once(*parts)
    else:
        links, needed = (a.unionByName(b) for a, b in zip(
            _linked_once(*(p.join(again, KEY, "left_anti") for p in parts)),
            _linked_by_rank(*(p.join(again, KEY, "left_semi") for p in parts), piece), strict=True))
    links = stage(links, "links")
    nodes = stage(calls.where(named).join(needed, "node", "left").select("conv_id", "node", "_needs"), "needed")
    depth = levels(nodes.select("conv_id", F.col("node").cast("string").alias("call_id"), F.col("_needs").cast("string").alias("depends_on")))
    depth = depth.select(F.col("call_id").cast("long").alias("node"), "level")
    answers = results.select(F.col("node").alias("_answer"), F.col("turn").alias("result_turn"), F.col("content").alias("result"), "n_results")
    made = (calls.join(nodes.select("node", "_needs"), "node", "left").join(depth, "node", "left").join(links, "node", "left")
            .join(answers, "_answer", "left").withColumns({"level": F.coalesce("level", F.lit(0).cast("long")), "is_call": F.lit(True)}))
    alone = (results.join(links.select("_answer"), F.col("node") == F.col("_answer"), "left_anti")
             .select(*KEY, F.col("turn").alias("result_turn"), F.col("content").alias("result"), "n_results"))
    return _reported(made.unionByName(alone, allowMissingColumns=True), schemas)
