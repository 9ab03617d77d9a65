"""Failures of rollouts: which may be tried again, from the phase and the errors that a record saved.

A chain is an array from the error that was raised to its deepest cause; each has a kind (the
type's name), and, where it has them, an HTTP status, a system error name, the phase that it
carries and whether it calls itself retryable. An error that has an HTTP status is judged by it,
whatever its kind, as clients raise a kind of their own for most statuses.

Errors that have several beneath them (a cause and a context, the members of a group) are tables of
nodes and edges, with the names of each error's base types; see ``interaction_graph``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.sources.shared import checkpointed

CHAIN = "array<struct<kind:string,status:int,errno:string,phase:string,retryable:boolean>>"

# Phases, statuses and kinds of errors.
RECOVERABLE_PHASES = ("environment_reset", "model_generation", "tau2_tool_step", "tau2_text_step")
JUDGE_PHASES = ("judge", "user_sim_judge", "turn_labels")
RETRYABLE_STATUSES = (408, 429, 500, 502, 503, 504)
RETRYABLE_ERRNOS = ("EAGAIN", "ETIMEDOUT", "ENETUNREACH", "EHOSTUNREACH", "ECONNREFUSED", "ECONNRESET", "ECONNABORTED", "EPIPE")
CONNECTION_KINDS = ("ConnectionError", "ConnectionResetError", "ConnectionAbortedError", "ConnectionRefusedError", "BrokenPipeError", "TimeoutError", "APIConnectionError", "APITimeoutError")
TRANSPORT_KINDS = ("TransportError", "NetworkError", "ConnectError", "ReadError", "WriteError", "CloseError", "TimeoutException", "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout", "ProxyError", "ProtocolError", "RemoteProtocolError")
LOCAL_KINDS = ("UnsupportedProtocol", "LocalProtocolError")
STREAM_ENDS = ("BrokenResourceError", "EndOfStream", "SSLEOFError", "SSLZeroReturnError")
WRAPPERS = ("RuntimeError", "ExceptionGroup", "BaseExceptionGroup", "RayTaskError")
DEADLINES = ("TimeoutError", "TimeoutException", "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout")
CANCEL, INFRASTRUCTURE = "CancelledError", "RolloutInfrastructureError"
EVIDENCE_KINDS = ("PolicyAttributionPending", "JudgeEvidenceError")
JUDGE_FAILURE = "JudgeServiceFailure"


def _isin(value: Column, names: tuple) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False))


def transient(e: Column) -> Column:
    """Whether an error by itself is one of a service that may be back."""
    system = (e["kind"] == "OSError") & _isin(e["errno"], RETRYABLE_ERRNOS)
    name = (e["kind"] == "gaierror") & (e["errno"] == "EAI_AGAIN")
    return F.coalesce(_isin(e["kind"], CONNECTION_KINDS + TRANSPORT_KINDS) | system | name | _isin(e["status"], RETRYABLE_STATUSES), F.lit(False))


def interaction_retryable(phase: Column, chain: Column) -> Column:
    """Every error of the chain is transient, or wraps one that is, in a phase that can be repeated.

    The end of a stream is transient only beneath a transport error, and so is a system error
    without a name; the cancellation right beneath a deadline is the deadline's own. No chain is no
    evidence.
    """
    n = F.size(chain)

    def step(state: Column, e: Column) -> Column:
        last = state["seen"] + 1 == n
        own_cancel = state["deadline"] & (e["kind"] == CANCEL)
        beneath = state["transport"] & (_isin(e["kind"], STREAM_ENDS) | ((e["kind"] == "OSError") & e["errno"].isNull()))
        wraps = _isin(e["kind"], WRAPPERS) | ((e["kind"] == INFRASTRUCTURE) & _isin(e["phase"], RECOVERABLE_PHASES))
        good = own_cancel | transient(e) | beneath | (F.coalesce(wraps, F.lit(False)) & ~last)
        return F.struct(
            (state["seen"] + 1).alias("seen"),
            (state["good"] & F.coalesce(good, F.lit(False))).alias("good"),
            (state["transport"] | _isin(e["kind"], TRANSPORT_KINDS)).alias("transport"),
            _isin(e["kind"], DEADLINES).alias("deadline"),
        )

    start = F.struct(F.lit(0).alias("seen"), F.lit(True).alias("good"), F.lit(False).alias("transport"), F.lit(False).alias("deadline"))
    whole = F.aggregate(chain, start, step, lambda s: s["good"])
    return F.coalesce(_isin(phase, RECOVERABLE_PHASES) & (n > 0) & whole, F.lit(False))


NODE = "record long, node long, bases array<string>, status int, errno string, phase string"
EDGE = "record long, parent long, child long, relation string"
#: What an edge can be: an error's cause, its context, a member of a group, the error that a remote task carries.
RELATIONS = ("cause", "context", "member", "carried")


def _judged(nodes: DataFrame) -> DataFrame:
    """Per node: whether it is transient by itself and beneath a transport error, may wrap others, is a transport error, a deadline, a cancellation."""
    own = F.try_element_at("bases", F.lit(1))
    any_of = lambda *names: F.coalesce(F.arrays_overlap("bases", F.array(*map(F.lit, names))), F.lit(False))
    transport = any_of("TransportError", "NetworkError", "TimeoutException", "RemoteProtocolError")
    service = (
        F.when(any_of("ConnectionError", "TimeoutError"), True)
        .when(any_of("gaierror"), F.col("errno") == "EAI_AGAIN")
        .when(any_of("OSError"), F.col("errno").isin(*RETRYABLE_ERRNOS))
        .when(F.col("status").isNotNull(), F.col("status").isin(*RETRYABLE_STATUSES))
        .when(transport, ~any_of(*LOCAL_KINDS))
        .otherwise(any_of("APIConnectionError"))
    )
    beneath = any_of(*STREAM_ENDS) | ((own == "OSError") & F.col("errno").isNull())
    infrastructure = any_of(INFRASTRUCTURE)
    wraps = any_of("BaseExceptionGroup") | F.when(infrastructure, F.col("phase").isin(*RECOVERABLE_PHASES)).otherwise((own == "RuntimeError") | any_of("RayTaskError"))
    flags = {"service": service, "beneath": beneath, "wraps": wraps, "transport": transport, "deadline": any_of("TimeoutError", "TimeoutException"), "cancelled": any_of(CANCEL)}
    return nodes.select("record", "node", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))


def interaction_graph(records: DataFrame, nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """record, retryable: whether each error beneath the one raised is transient, or wraps others that are, in a phase that can be repeated.

    records: record, phase, root (the node raised, null: none). nodes: record, node, bases (names of
    the type and of its base types, the type's own first), status, errno, phase. edges: record,
    parent, child, relation. A cancellation right beneath a deadline is the deadline's own, and what
    is beneath it stands in its place. An error that comes up again beneath itself is no evidence.

    A fixed point over the tables: each round takes all records one step further down, a node at most
    twice (with and without a transport error above it), and leaves out records that have failed. A
    second one takes away nodes beneath which nothing is left, until what remains are circles.
    """
    judged = checkpointed(_judged(nodes))
    flags = judged.select("record", F.col("node").alias("child"), F.col("cancelled").alias("child_cancelled"))
    from_deadline = judged.select("record", F.col("node").alias("parent"), F.col("deadline").alias("parent_deadline"))
    known = edges.distinct().join(flags, ["record", "child"]).join(from_deadline, ["record", "parent"])
    chained = F.col("relation").isin("cause", "context")
    own_cancel = chained & F.col("parent_deadline") & F.col("child_cancelled")
    nested = edges.where(chained).select("record", F.col("parent").alias("child"), F.col("child").alias("grandchild"))
    passed = known.where(own_cancel).join(nested, ["record", "child"]).select("record", "parent", F.col("grandchild").alias("child"))
    beneath = checkpointed(known.where(~own_cancel).select("record", "parent", "child").unionAll(passed).distinct())
    judged = checkpointed(judged.join(beneath.select("record", F.col("parent").alias("node"), F.lit(True).alias("has")).distinct(), ["record", "node"], "left"))
    good = F.col("service") | (F.col("context") & F.col("beneath")) | (F.col("wraps") & F.coalesce("has", F.lit(False)))
    asked = records.where(F.col("phase").isin(*RECOVERABLE_PHASES) & F.col("root").isNotNull())
    front = asked.select("record", F.col("root").alias("node"), F.lit(False).alias("context"))
    seen = failed = reached = None
    for _ in range(rounds):
        # a node that is not in the table is no evidence
        here = checkpointed(front.join(judged, ["record", "node"], "left").withColumn("good", F.coalesce(good, F.lit(False))))
        bad = here.where(~F.col("good")).select("record").distinct()
        failed = checkpointed(bad if failed is None else failed.unionAll(bad).distinct())
        seen = checkpointed(here.select("record", "node", "context") if seen is None else seen.unionAll(here.select("record", "node", "context")))
        alive = here.join(failed, "record", "left_anti").select("record", F.col("node").alias("parent"), (F.col("context") | F.col("transport")).alias("context"))
        down = alive.join(beneath, ["record", "parent"]).select("record", F.col("child").alias("node"), "context").distinct()
        front = checkpointed(down.join(seen, ["record", "node", "context"], "left_anti"))
        if front.isEmpty():
            break
    else:
        raise RuntimeError("chains of errors are longer than the rounds allow")
    reached = seen.join(failed, "record", "left_anti").select("record", F.col("node").alias("parent")).distinct()
    left = checkpointed(beneath.join(reached, ["record", "parent"]))
    size = left.count()
    while size:
        left = checkpointed(left.join(left.select("record", F.col("parent").alias("child")).distinct(), ["record", "child"], "left_semi").select("record", "parent", "child"))
        before, size = size, left.count()
        if size == before:
            break
    none = failed.unionAll(left.select("record")).distinct().select("record", F.lit(False).alias("__ok"))
    right = asked.select("record", F.lit(True).alias("__asked"))
    return records.select("record").join(right, "record", "left").join(none, "record", "left").select("record", F.coalesce(F.coalesce("__ok", "__asked"), F.lit(False)).alias("retryable"))


def scoring_retryable(phase: Column, chain: Column) -> Column:
    """Whether scoring may ask again on its frozen inputs: for evidence that a judge left open, for a judge's failure that says so, for a transient service error."""
    raised = F.try_element_at(chain, F.lit(1))
    pending = (phase == "reward_scoring") & _isin(raised["kind"], EVIDENCE_KINDS)
    said = F.when(raised["kind"] == JUDGE_FAILURE, F.coalesce(raised["retryable"], F.lit(False))).otherwise(interaction_retryable(F.lit("model_generation"), chain))
    return F.coalesce(pending | (_isin(phase, JUDGE_PHASES) & said), F.lit(False))


def raise_fatal(reports: DataFrame) -> DataFrame:
    """``reports`` (uid, phase, error_type, message) of fatal rollouts as a frame that fails when it has a row."""
    says = F.concat_ws("", F.lit("fatal rollout in group "), F.coalesce("uid", F.lit("none")), F.lit(", phase "), F.coalesce("phase", F.lit("none")), F.lit(": "), F.coalesce("error_type", F.lit("none")), F.lit(": "), F.coalesce("message", F.lit("")))
    return reports.where(F.raise_error(says).cast("boolean"))
