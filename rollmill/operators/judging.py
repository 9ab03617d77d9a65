"""Requests to the judge of turns: for each actor turn its own message, the messages before it, and the policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.functions.canonjson import canonical, object_of, quoted

# Versions, what stands in for a repeated policy, and the keys that lead a request.
REQUEST_VERSION, INDEPENDENT = "simple-turn-target-v2", "simple-turn-v2"
ELIDED = "[See request.policy for the bound policy.]"
LEADING = ("request_version", "policy", "task_guidance", "history")


#: Fields of a message that are not there where they are null, and fields whose numbering the judge is not to see.
OPTIONAL = ("raw_generated_text", "tool_calls")
ACTOR_FIELDS = ("turn_idx", "assistant_turn_id")


def generation_text(m: Column, kind: T.StructType) -> Column:
    """What an actor's message (of type ``kind``) says: its raw text, else its content and its tool calls, else the message as JSON."""
    some = lambda c: F.when(c.rlike(r"(?U)[^\s\x1c-\x1f]"), c)
    calls = F.when(F.size(m["tool_calls"]) > 0, canonical(m["tool_calls"], kind["tool_calls"].dataType, True))
    shown = F.concat_ws("\n", some(m["content"]), calls)
    return F.coalesce(some(m["raw_generated_text"]), F.when(F.length(shown) > 0, shown), canonical(m, kind, True, OPTIONAL))


def target_sha256(current: Column, kind: T.DataType) -> Column:
    """The digest of a target: canonical JSON of its message and place, and of the version."""
    return F.sha2(object_of({"judge_version": quoted(F.lit(REQUEST_VERSION)), "current_generation": canonical(current, kind, absent=OPTIONAL)}), 256)


def turn_requests(rows: DataFrame, decisions: DataFrame | None = None, version: str = INDEPENDENT, by: str = "trajectory_id") -> DataFrame:
    """One row for each actor turn: turn_index, target_message_index, target_text, target_sha256, current, history, previous_refusals.

    rows: by, policy, task_guidance and messages, an array of structs (role, content,
    raw_generated_text, tool_calls, others as they come); actor turns are the assistant's messages. The history is every
    message before the target and none after it, which takes memory by the square of a dialogue's
    length, as the requests themselves do. decisions (by, turn_index, correct_refusal, bad_turn,
    refusal_requests): in versions that are not independent, earlier clean refusals go along.
    """
    message = rows.schema["messages"].dataType.elementType
    hidden = [c for c in ACTOR_FIELDS if c in message.names]
    indexed = F.transform("messages", lambda m, i: F.struct(i.alias("message_index"), (m.dropFields(*hidden) if hidden else m).alias("message")))
    base = rows.select(by, "policy", "task_guidance", indexed.alias("__m"))
    targets = F.filter("__m", lambda x: x["message"]["role"] == "assistant")
    turns = base.withColumn("__t", targets).select("*", F.posexplode("__t").alias("turn_index", "current")).drop("__t")
    at, kind = F.col("current.message_index"), turns.schema["current"].dataType
    out = turns.select(
        by,
        "turn_index",
        at.alias("target_message_index"),
        generation_text(F.col("current.message"), kind["message"].dataType).alias("target_text"),
        target_sha256(F.col("current"), kind).alias("target_sha256"),
        "current",
        F.slice("__m", F.lit(1), at).alias("history"),
        "policy",
        "task_guidance",
    )
    if decisions is None or version == INDEPENDENT:
        return out.withColumn("previous_refusals", F.array().cast("array<struct<turn_index:int,refusal_requests:array<struct<target:string,operation:string>>>>"))
    clean = decisions.where("correct_refusal and not bad_turn").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("turn_index", "refusal_requests"))).alias("__r"))
    joined = out.join(clean, by, "left")
    earlier = F.filter(F.coalesce("__r", F.array()), lambda r: r["turn_index"] < F.col("turn_index"))
    return joined.withColumn("previous_refusals", earlier).drop("__r")


def compacted_history(history: Column, policy: Column) -> Column:
    """The history with the policy's text, where a system message repeats it, replaced by a reference; nothing else changes."""
    elided = lambda m: F.when((m["role"] == "system") & (F.length(policy) > 0), F.replace(m["content"], policy, F.lit(ELIDED))).otherwise(m["content"])
    return F.transform(history, lambda x: x.withField("message", x["message"].withField("content", elided(x["message"]))))


def request_json(requests: DataFrame, version: str = INDEPENDENT) -> DataFrame:
    """Adds request: the request's JSON, in which what turns share (version, policy, guidance, history) leads, the other keys follow by name, and keys are sorted at every depth.

    In the independent version, a rule for the final turn goes along. Guidance that is null is not there.
    """
    kinds = {f.name: f.dataType for f in requests.schema.fields}
    shown = lambda c, kind: canonical(c, kind, True, OPTIONAL)
    fields = {
        "request_version": quoted(F.lit(REQUEST_VERSION)),
        "policy": shown(F.col("policy"), kinds["policy"]),
        "task_guidance": quoted(F.col("task_guidance")),
        "history": shown(compacted_history(F.col("history"), F.col("policy")), kinds["history"]),
        "current_generation": shown(F.col("current"), kinds["current"]),
        "previous_refusals": shown(F.col("previous_refusals"), kinds["previous_refusals"]),
        "target_generation_sha256": quoted(F.col("target_sha256")),
        "target_generation_text": quoted(F.col("target_text")),
        "target_message_index": F.col("target_message_index").cast("string"),
        "turn_index": F.col("turn_index").cast("string"),
    }
    if version == INDEPENDENT:
        fields["final_turn_rule"] = quoted(F.lit(INDEPENDENT))
    order = [*LEADING, *sorted(k for k in fields if k not in LEADING)]
    return requests.withColumn("request", object_of({k: fields[k] for k in order}, spaced=True, sort=False, absent=("task_guidance",)))


def request_rules(requests: DataFrame, version: str = INDEPENDENT) -> dict[str, Column]:
    """Rules of ``requests``, for ``checked``: the target is the actor's and says what its text and digest say, the history is the prefix before it, in order, and independent requests carry no decisions."""
    kind = requests.schema["current"].dataType
    at = F.col("target_message_index")
    return {
        "target": (at >= 0) & (F.col("current.message_index") == at),
        "actor": F.col("current.message.role") == "assistant",
        "history_size": F.size("history") == at,
        "history_order": F.coalesce(F.transform("history", lambda x: x["message_index"]) == F.when(at > 0, F.sequence(F.lit(0), at - 1)).otherwise(F.array().cast("array<int>")), F.lit(False)),
        "text": F.col("target_text").eqNullSafe(generation_text(F.col("current.message"), kind["message"].dataType)),
        "digest": F.col("target_sha256").eqNullSafe(target_sha256(F.col("current"), kind)),
        "independent": F.lit(version != INDEPENDENT) | (F.size("previous_refusals") == 0),
    }
