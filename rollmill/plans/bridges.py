"""Bridge views: the generic tables read as rollouts, turns, tool events and messages.

Each has a Spark form (a DataFrame) and a DuckDB form (a common table expression, never
materialised) with the same columns and the same total orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that sorts them by key; more rows are more tasks, whatever number of shuffle partitions is set.
TASK_ROWS = 400_000


def tasks_of(rows: DataFrame) -> int:
    """How many tasks a table's rows are dealt over, by its count."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"),
        F.col("o_orderkey").alias("trajectory_id"),
        (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("slot"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0).alias("reward"),
        F.when(priority == "1-URGENT", "user_stop").when(priority == "2-HIGH", "agent_stop").when(priority == "3-MEDIUM", "human_transfer").when(priority == "4-NOT SPECIFIED", "infrastructure_error").otherwise("hard_turn_limit").alias("termination"),
        F.year("o_orderdate").alias("policy_version"),
        F.col("o_totalprice").alias("tokens"),
    )


ROLLOUTS = """b_rollouts AS NOT MATERIALIZED (SELECT o_custkey AS task_id, o_orderkey AS trajectory_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS slot,
  CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'P' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS reward,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'user_stop' WHEN '2-HIGH' THEN 'agent_stop' WHEN '3-MEDIUM' THEN 'human_transfer'
    WHEN '4-NOT SPECIFIED' THEN 'infrastructure_error' ELSE 'hard_turn_limit' END AS termination,
  year(o_orderdate) AS policy_version, o_totalprice AS tokens FROM orders)"""

_TURN_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    # windows, groups and joins by trajectory then need no other exchange of the turns
    return lines.repartition(tasks_of(lines), "l_orderkey").select(
        F.col("l_orderkey").alias("trajectory_id"),
        (F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_TURN_ORDER)) - 1).alias("turn"),
        (F.col("l_linestatus") == "F").alias("satisfied"),
        (F.col("l_returnflag") == "R").alias("bad"),
        (F.col("l_returnflag") == "A").alias("refusal"),
        F.col("l_tax").alias("cost"),
        F.col("l_quantity").cast("int").alias("tokens"),
    )


TURNS = f"""b_turns AS NOT MATERIALIZED (SELECT l_orderkey AS trajectory_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_TURN_ORDER)}) - 1 AS turn,
  l_linestatus = 'F' AS satisfied, l_returnflag = 'R' AS bad, l_returnflag = 'A' AS refusal, l_tax AS cost,
  CAST(l_quantity AS INTEGER) AS tokens FROM lineitem)"""


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequence = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trajectory_id"),
        "event_id",
        sequence.alias("sequence"),
        (sequence + 1).alias("turn_id"),
        kind.alias("name"),
        F.col("props").alias("args"),
        (kind != "error").alias("success"),
        kind.isin("purchase", "signup").alias("db_effect"),
        F.floor("value").cast("string").alias("result"),
        F.when(kind == "error", "model_caused_execution_error").alias("error_kind"),
    )


TOOL_EVENTS = """b_tool_events AS NOT MATERIALIZED (SELECT user_id AS trajectory_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn_id, event_type AS name, props AS args,
  event_type <> 'error' AS success, event_type IN ('purchase', 'signup') AS db_effect,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS result,
  CASE WHEN event_type = 'error' THEN 'model_caused_execution_error' END AS error_kind FROM events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("dialog_id"), F.col("turn").alias("message_index"), "role", F.col("text").alias("content"))


MESSAGES = "b_messages AS NOT MATERIALIZED (SELECT conv_id AS dialog_id, turn AS message_index, role, text AS content FROM conversations)"


def sft_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels and whether they contain a benchmark passage verbatim."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", "source", "n_chars", "quality", "toxic")


SFT_DOCS = "b_sft_docs AS NOT MATERIALIZED (SELECT doc_id, text, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
