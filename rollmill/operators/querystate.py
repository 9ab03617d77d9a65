"""What a read-only call could see: the part of a database state that its answer depends on, its fingerprint, and the proof of reads.

A state is named by a column (a database digest, say) that events and state tables share, so calls
of many states are projected in one plan: one equi-join for each kind of read. State tables:
users (state, user_id, value), reservations (state, reservation_id, value) with values as JSON, and
flights (state, place, number, origin, destination, departs, arrives, date, status, instance), one
row for each date of a flight, ``place`` being its place in the state and ``instance`` JSON.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions import canon, scalars

# The version of the evidence, its fields, and what never ran.
VERSION = "duplicate-query-v1"
EVIDENCE = ("db_hash_before", "db_hash_after", "query_state_before", "query_state_after", "query_state_scope", "query_state_version")
UNEXECUTED_ERRORS = ("parse_error", "unknown_tool", "schema_invalid", "mixed_content_and_tool_call", "multiple_tool_calls")
UNEXECUTED_STATUSES = ("blocked_by_invalid_sibling", "termination_control")
LEG = ("flight_number", "origin", "destination", "scheduled_departure_time_est", "scheduled_arrival_time_est", "date", "instance")
STATIC_READS = ("list_all_airports", "calculate")
#: The string arguments without which a call sees nothing.
NEEDS = {
    "get_user_details": ("user_id",),
    "get_reservation_details": ("reservation_id",),
    "get_flight_status": ("flight_number", "date"),
    "search_direct_flight": ("origin", "destination", "date"),
    "search_onestop_flight": ("origin", "destination", "date"),
}


def text_argument(arguments: Column, name: str) -> Column:
    """An argument that is a string; null if it is missing or anything else."""
    found = F.try_variant_get(F.try_parse_json(arguments), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def _leg(side: str) -> Column:
    names = ("number", "origin", "destination", "departs", "arrives", "date", "instance")
    return F.struct(*[F.col(f"{side}.{c}").alias(name) for c, name in zip(names, LEG, strict=True)])


def projected(events: DataFrame, users: DataFrame, reservations: DataFrame, flights: DataFrame, state: str = "state", shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """Events (event_id, name, arguments, and the name of their state) of read-only tools with scope and seen, the JSON of what they see.

    Calls of other tools, calls without the string arguments that their tool needs, and calls
    without a state have neither. A record, flight or date that is not there is seen as null.
    Searches see the available dates alone, in the state's order; a search with one stop sees those
    first legs that have a second one, each with its second legs.

    A read (tool, state and the arguments that the tool needs) is answered once, however many events
    make it, and then joined to them. ``shown`` says what is kept of seen, before that join.
    """
    calls = events.select("event_id", "name", "arguments", F.col(state).alias("__s")).where(F.col("name").isin(*scalars.READ_ONLY_TOOLS) & F.col("__s").isNotNull())
    needed = F.array().cast("array<string>")
    for tool, names in NEEDS.items():
        needed = F.when(F.col("name") == tool, F.array(*[text_argument(F.col("arguments"), c) for c in names])).otherwise(needed)
    made = calls.where(F.col("name").isin(*NEEDS)).withColumn("__needs", needed).where(~F.exists("__needs", lambda x: x.isNull()))
    made = made.select("event_id", F.struct("name", "__s", "__needs").alias("__read"))

    def of(tool: str) -> DataFrame:
        reads = made.where(F.col("__read.name") == tool).select("__read").distinct()
        return reads.select("__read", F.col("__read.__s").alias("__s"), *[F.col("__read.__needs")[i].alias(f"__{c}") for i, c in enumerate(NEEDS[tool])]).alias("c")

    def record(tool: str, kind: str, key: str, table: DataFrame) -> DataFrame:
        t = table.select(F.col(state).alias("__s"), F.col(key).alias("__k"), F.col("value").alias("__v")).alias("t")
        joined = of(tool).join(t, (F.col("c.__s") == F.col("t.__s")) & (F.col(f"c.__{key}") == F.col("t.__k")), "left")
        return joined.select("__read", F.concat(F.lit(f"airline:{kind}:"), F.col(f"c.__{key}")).alias("scope"), F.coalesce("__v", F.lit("null")).alias("seen"))

    f = flights.withColumnRenamed(state, "__s")
    status = of("get_flight_status").join(
        f.alias("f"), (F.col("c.__s") == F.col("f.__s")) & (F.col("c.__flight_number") == F.col("f.number")) & (F.col("c.__date") == F.col("f.date")), "left"
    )
    status = status.select("__read", F.concat_ws(":", F.lit("airline:flight-status"), "c.__flight_number", "c.__date").alias("scope"), F.when(F.col("f.number").isNotNull(), F.to_json(F.struct(F.col("f.status").alias("status")), {"ignoreNullFields": "false"})).otherwise("null").alias("seen"))

    open_ = f.where("status = 'available'")
    searched = [F.col(f"c.__{c}") for c in ("origin", "destination", "date")]

    def starts(tool: str) -> tuple[DataFrame, Column]:
        wanted = of(tool)
        on = (F.col("c.__s") == F.col("a.__s")) & (F.col("c.__origin") == F.col("a.origin")) & (F.col("c.__date") == F.col("a.date"))
        return wanted, on

    def listed(joined: DataFrame, tool: str, item: Column, hit: Column) -> DataFrame:
        """One row for each read, with its items in the order of places."""
        items = F.array_sort(F.collect_list(F.when(hit, F.struct(F.col("a.place").alias("p"), item.alias("i")))))
        scope = F.concat_ws(":", F.lit(f"airline:{tool}"), *searched)
        whole = joined.groupBy("__read", scope.alias("scope")).agg(items.alias("items"))
        return whole.select("__read", "scope", F.to_json(F.transform("items", lambda x: x["i"])).alias("seen"))

    wanted, on = starts("search_direct_flight")
    direct = wanted.join(open_.alias("a"), on & (F.col("c.__destination") == F.col("a.destination")), "left")
    direct = listed(direct, "search_direct_flight", _leg("a"), F.col("a.number").isNotNull())

    wanted, on = starts("search_onestop_flight")
    second_day = scalars.leg_day(F.col("a.arrives"), F.col("a.date"))
    first = wanted.join(open_.alias("a"), on).withColumn("__day", second_day)
    reach = (F.col("c.__s") == F.col("b.__s")) & (F.col("a.destination") == F.col("b.origin")) & (F.col("__day") == F.col("b.date")) & (F.col("c.__destination") == F.col("b.destination")) & (F.col("b.departs") >= F.col("a.arrives"))
    legs = first.join(open_.alias("b"), reach)
    by_first = legs.groupBy("__read", F.col("a.place").alias("p"), _leg("a").alias("first")).agg(F.array_sort(F.collect_list(F.struct(F.col("b.place").alias("p"), _leg("b").alias("i")))).alias("second"))
    pairs = by_first.groupBy("__read").agg(F.array_sort(F.collect_list(F.struct("p", F.struct("first", F.transform("second", lambda x: x["i"]).alias("second")).alias("i")))).alias("items"))
    one_stop = wanted.join(pairs.alias("p"), "__read", "left").select(
        "__read", F.concat_ws(":", F.lit("airline:search_onestop_flight"), *searched).alias("scope"), F.coalesce(F.to_json(F.transform("items", lambda x: x["i"])), F.lit("[]")).alias("seen")
    )
    static = calls.where(F.col("name").isin(*STATIC_READS)).select("event_id", F.concat(F.lit("airline:static:"), F.col("name")).alias("scope"), F.lit(f'{{"native_semantics":"{VERSION}"}}').alias("seen"))
    views = reduce(DataFrame.unionByName, [record("get_user_details", "users", "user_id", users), record("get_reservation_details", "reservations", "reservation_id", reservations), status, direct, one_stop])
    show = shown or (lambda seen: seen)
    views = views.select("__read", "scope", show(F.col("seen")).alias("seen"))
    return made.join(views, "__read").select("event_id", "scope", "seen").unionByName(static.withColumn("seen", show(F.col("seen"))))


def _json_string(c: str) -> Column:
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def evidence(events: DataFrame, views: DataFrame) -> DataFrame:
    """event_id, query_state_scope, query_state and query_state_version of events that see something: one instant's fingerprint."""
    whole = events.join(views, "event_id")
    shown = F.concat(F.lit(f'{{"version":"{VERSION}","tool":'), _json_string("name"), F.lit(',"arguments":'), F.col("arguments"), F.lit(',"scope":'), _json_string("scope"), F.lit(',"state":'), F.col("seen"), F.lit("}"))
    return whole.select("event_id", F.col("scope").alias("query_state_scope"), canon.fingerprint(shown).alias("query_state"), F.lit(VERSION).alias("query_state_version"))


def missing_proof() -> Column:
    """What an event (with the fields of EVIDENCE and result) lacks to prove what it read; empty for a proven read."""
    lacks = [F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(c)) for c in EVIDENCE]
    lacks.append(F.when(F.col("result").isNull(), F.lit("result")))
    lacks.append(F.when(~F.col("query_state_version").eqNullSafe(F.lit(VERSION)), F.lit("supported_query_state_version")))
    lacks.append(F.when(~F.col("query_state_before").eqNullSafe(F.col("query_state_after")), F.lit("stable_read_state")))
    return F.array_compact(F.array(*lacks))


def reads() -> Column:
    """Whether an event (name, error_kind, execution_status) is a read that ran."""
    stopped = F.coalesce(F.col("error_kind").isin(*UNEXECUTED_ERRORS), F.lit(False)) | F.coalesce(F.col("execution_status").isin(*UNEXECUTED_STATUSES), F.lit(False))
    return F.col("name").isin(*scalars.READ_ONLY_TOOLS) & ~stopped


def flag_differences(events: DataFrame, decided: DataFrame) -> DataFrame:
    """Events whose saved duplicate flags are not those of the decisions (event_id, query_status, duplicate_of); scoring demands that there are none."""
    d = decided.select("event_id", (F.col("query_status") == "duplicate").alias("__dup"), F.col("duplicate_of").alias("__of"))
    saved = events.select("event_id", F.coalesce("duplicate_query", F.lit(False)).alias("duplicate_query"), "duplicate_of_event_id")
    both = saved.join(d, "event_id", "left")
    same = (F.col("duplicate_query") == F.coalesce("__dup", F.lit(False))) & F.col("duplicate_of_event_id").eqNullSafe(F.col("__of"))
    return both.where(~same).select("event_id", "duplicate_query", "duplicate_of_event_id", F.coalesce("__dup", F.lit(False)).alias("expected_duplicate"), F.col("__of").alias("expected_of"))
