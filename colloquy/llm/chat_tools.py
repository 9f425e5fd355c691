"""Tool calls of chats: linked, ordered, validated and serialised.

DataFrame functions alone. Calls and results are rows (conv_id, turn, call_id,
...); a call may name calls that it depends on.

* Linking: every call and every result has a row. The first call of a
  (conv_id, call_id), by turn and then content, is linked with its earliest
  result by a hash join of one row a side; their row counts both. Further calls
  (``duplicate_id``), further results (``extra_result``), results without a call
  (``orphan_result``) and rows without a conv_id, call_id or turn (``no_id``)
  keep their payload in rows of their own; ``n_calls`` and ``n_results`` are
  null there but for orphans. Rows are told apart by a number that is written
  once, so an identifier that holds a third of all rows is only ever aggregated.
* Order: ``(order_key, order_hop, turn)`` sorts each conversation so that every
  call follows those it depends on and otherwise keeps its turn. The key is the
  latest turn among the call and all it depends on, the hop the number of steps
  to there. Dependencies on earlier turns hold by themselves, so only those on
  later turns take rounds of joins, as many as they chain. Turn numbers of a
  conversation's calls being distinct, a call that is reached from itself shows
  as its own key with a hop: it lies on a cycle, which is cut at that call.
* Validation: the arguments must be one JSON object (nothing after it) whose
  fields fit the tool's schema. An integer is judged by value, as JSON Schema
  does: 1.0 and 1e2 are integers.
* Canonical JSON: keys sorted at every level, no white space, by way of the
  variant type, whose objects are sorted; numbers in their shortest form (1.0
  and 1e2 become 1 and 100).

Defined results: a null name has no schema; null arguments are not JSON; several calls in one
turn are told apart by call_id; dependencies on unknown calls are reported as
``unknown_dependency``, those of further calls are not followed; texts of any
length are parsed whole; other columns are not looked at; empty tables give no
rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, saved

END = "#end"


def json_object(text: Column) -> Column:
    """The one JSON object that ``text`` is, as a variant, else null."""
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]')))
    alone = (F.try_variant_get(whole, "$[1]", "string") == END) & F.try_variant_get(whole, "$[2]", "string").isNull()
    first = F.try_variant_get(whole, "$[0]", "variant")
    return F.when(alone & F.schema_of_variant(first).startswith("OBJECT"), first)


def json_kind(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (F.when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "number")
            .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
            .when(kind == "VOID", "null").otherwise(F.lower(kind)))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``errors``: what of (name, arguments) breaks the schemas
    (name, field, kind, required). Sorted."""
    by_name = schemas.groupBy("name").agg(F.collect_set(F.struct("field", "kind", "required")).alias("_fields"))
    value = json_object(F.col("arguments"))
    parsed = (calls.join(by_name, "name", "left").withColumn("_object", value)
              .withColumn("_map", F.when(F.col("_object").isNotNull(), F.from_json("arguments", "map<string,variant>"))))

    def broken(f: Column) -> Column:
        value = F.col("_map")[f["field"]]
        got = json_kind(value)
        has = F.map_contains_key(F.col("_map"), f["field"])
        whole = F.coalesce(F.try_variant_get(value, "$", "decimal(38,12)") % 1 == 0, F.try_variant_get(value, "$", "double") % 1 == 0)
        fits = (got == f["kind"]) | ((f["kind"] == "number") & (got == "integer")) | ((f["kind"] == "integer") & (got == "number") & whole)
        return F.when(~has, F.when(f["required"], F.concat(F.lit("missing:"), f["field"]))).when(~fits, F.concat(F.lit("type:"), f["field"]))

    known = F.transform(F.col("_fields"), lambda f: f["field"])
    wrong = F.concat(F.transform("_fields", broken),
                     F.transform(F.array_except(F.map_keys("_map"), known), lambda k: F.concat(F.lit("unknown:"), k)))
    one = lambda x: F.array(F.lit(x))
    errors = (F.when(F.col("_map").isNull(), one("not_json_object")).when(F.col("_fields").isNull(), one("no_schema"))
              .otherwise(F.array_sort(F.filter(wrong, lambda x: x.isNotNull()))))
    return parsed.withColumn("errors", errors).drop("_map", "_fields")


def _order(saved: Callable[[DataFrame, str], DataFrame], calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, order_key, order_hop, cyclic) of the calls that a
    dependency on a later call moves; ``needs(conv_id, call_id, turn,
    on_id, on_turn)``, positions as structs (turn, call_id)."""
    needs = saved(needs, "needs")
    start = saved(calls.select("conv_id", "call_id", "at", F.col("at").alias("order_key"), F.lit(0).alias("order_hop"),
                               F.lit(False).alias("cyclic")), "order")
    state, cut = start, None
    while True:
        live = needs if cut is None else needs.join(cut, ["conv_id", "call_id"], "left_anti")
        on = state.select("conv_id", F.col("call_id").alias("on_id"), F.col("order_key").alias("k"), (F.col("order_hop") + 1).alias("h"))
        best = (live.join(on, ["conv_id", "on_id"]).where("k >= at").groupBy("conv_id", "call_id").agg(F.max(F.struct("k", "h")).alias("best")))
        moved = saved(best.join(state, ["conv_id", "call_id"]).where(
            F.col("best") > F.struct(F.col("order_key").alias("k"), F.col("order_hop").alias("h"))).select(
            "conv_id", "call_id", "best", (F.col("best.k") == F.col("at")).alias("own")), "moved")
        if moved.isEmpty():
            return state
        found = moved.where("own").select("conv_id", "call_id")
        if not found.isEmpty():
            # cut the cycles at these calls and start over
            cut = saved(found if cut is None else cut.union(found).distinct(), "cut")
            state = saved(start.drop("cyclic").join(cut.withColumn("cyclic", F.lit(True)), ["conv_id", "call_id"], "left")
                          .withColumn("cyclic", F.coalesce("cyclic", F.lit(False))), "order")
            continue
        state = saved(state.join(moved.drop("own"), ["conv_id", "call_id"], "left").select(
            "conv_id", "call_id", "at", F.coalesce("best.k", "order_key").alias("order_key"),
            F.coalesce("best.h", "order_hop").alias("order_hop"), "cyclic"), "order")


def _message(arguments: Column, content: Column) -> Column:
    """Canonical JSON of a row: keys sorted, a null field left out."""
    sound = F.col("_object").isNotNull()
    body = F.to_json(F.struct(F.when(sound, F.col("_object")).alias("arguments"), F.col("call_id").alias("id"), F.col("name"),
                              F.when(~sound, arguments).alias("raw"), content.alias("result")))
    return F.to_json(F.try_parse_json(body)).alias("message")


def _alone(rows: DataFrame, status: Column, schemas: DataFrame) -> DataFrame:
    """Calls and results that are linked with nothing, as rows of ``link_calls``."""
    checked = validated(rows, schemas)
    errors = F.when(F.col("is_call"), F.array_join("errors", ",")).otherwise("")
    count = F.lit(None).cast("long")
    return checked.select(
        "conv_id", "call_id", F.when(F.col("is_call"), F.col("turn")).alias("turn"), "name", status.alias("status"),
        count.alias("n_calls"), count.alias("n_results"), F.when(~F.col("is_call"), F.col("turn")).alias("result_turn"),
        F.col("turn").alias("order_key"), F.lit(0).alias("order_hop"), errors.alias("errors"), _message(F.col("arguments"), F.col("content")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """The rows of ``calls(conv_id, turn, call_id, name, arguments,
    depends_on)`` and ``results(conv_id, turn, call_id, content)``, linked:
    (conv_id, call_id, turn, name, status, n_calls, n_results, result_turn,
    order_key, order_hop, errors, message)."""
    with Workspace(calls.sparkSession, "chat-tools") as ws:
        return saved(_linked(ws, calls, results, schemas), "linked")


def _linked(ws: Workspace, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    ids = ["conv_id", "call_id"]
    real = " and ".join(f"{c} is not null" for c in (*ids, "turn"))
    said = ["turn", "name", "arguments", "depends_on"]
    calls = ws.saved(calls.select(*ids, *said).withColumn("_row", F.monotonically_increasing_id()), "calls")
    results = ws.saved(results.select(*ids, "turn", "content").withColumn("_row", F.monotonically_increasing_id()), "results")
    asked = (calls.where(real).groupBy(*ids).agg(F.min(F.struct(*said, "_row")).alias("c"), F.count("*").alias("n_calls"))
             .select(*ids, *(f"c.{x}" for x in said), "n_calls", F.struct("c.turn", "call_id").alias("at"), "c._row"))
    asked = ws.saved(asked, "asked")
    given = (results.where(real).groupBy(*ids).agg(F.min(F.struct("turn", "content", "_row")).alias("r"), F.count("*").alias("n_results"))
             .select(*ids, F.col("r.turn").alias("result_turn"), "r.content", "n_results", "r._row"))
    given = ws.saved(given, "given")

    wanted = asked.select(*ids, "at", F.explode(F.array_distinct("depends_on")).alias("on_id")).where("on_id is not null")
    places = asked.select("conv_id", F.col("call_id").alias("on_id"), F.col("at").alias("on_at"))
    needs = ws.saved(wanted.join(places, ["conv_id", "on_id"], "left"), "dependencies")
    dangling = needs.where("on_at is null").select(*ids).distinct().withColumn("dangling", F.lit(True))
    # only conversations with a dependency on a later call need rounds
    twisted = needs.where("on_at >= at").select("conv_id").distinct()
    moved = _order(ws.saved, asked.join(twisted, "conv_id", "left_semi"),
                   needs.where("on_at is not null").join(twisted, "conv_id", "left_semi").drop("on_at"))

    checked = validated(asked.drop("_row"), schemas)
    both = (checked.join(given.drop("_row").hint("shuffle_hash"), ids, "full_outer")
            .join(moved.select(*ids, "order_key", "order_hop", "cyclic"), ids, "left").join(dangling, ids, "left"))
    status = (F.when(F.col("turn").isNull(), "orphan_result")
              .when(F.coalesce("cyclic", F.lit(False)), "cycle").when(F.coalesce("dangling", F.lit(False)), "unknown_dependency")
              .when(F.col("result_turn").isNull(), "no_result").when(F.col("result_turn") <= F.col("turn"), "result_before_call")
              .when(F.size("errors") > 0, "invalid").otherwise("linked"))
    key = F.coalesce(F.col("order_key.turn"), F.col("turn"), F.col("result_turn"))
    linked = both.select(
        *ids, "turn", "name", status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), "result_turn", key.alias("order_key"),
        F.coalesce("order_hop", F.lit(0)).alias("order_hop"), F.array_join(F.coalesce("errors", F.array().cast("array<string>")), ",").alias("errors"),
        _message(F.col("arguments"), F.col("content")))

    # every other row, told by its number from the one that counts
    unnamed = F.expr(f"not ({real})")
    null = F.lit(None).cast("string")
    more = calls.join(asked.select("_row"), "_row", "left_anti").select(
        *ids, "turn", "name", "arguments", null.alias("content"), F.lit(True).alias("is_call"))
    extra = results.join(given.select("_row"), "_row", "left_anti").select(
        *ids, "turn", null.alias("name"), null.alias("arguments"), "content", F.lit(False).alias("is_call"))
    status = F.when(unnamed, "no_id").when(F.col("is_call"), "duplicate_id").otherwise("extra_result")
    return linked.union(_alone(more.union(extra), status, schemas))
