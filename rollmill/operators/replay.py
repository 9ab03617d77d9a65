"""Replays: one kernel over a dimension of configurations, and the invariants between their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions.canonjson import canonical_sha256


def over_configs(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """Each row under each configuration; the dimension has a handful of rows and is stated by the caller."""
    names = configs.columns
    listed = [r.asDict() for r in configs.limit(101).collect()]
    if len(listed) > 100:
        raise ValueError("a configuration dimension has at most 100 rows")
    kinds = dict(configs.dtypes)
    rowset = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in names]) for r in listed])
    return rows.select("*", F.inline(rowset))


def changed(base: DataFrame, other: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Rows whose value differs between two replays, missing ones included."""
    a, b = base.select(*keys, F.col(value).alias("base")), other.select(*keys, F.col(value).alias("other"))
    return a.join(b, keys, "full").where(F.col("base").isNull() | F.col("other").isNull() | (F.abs(F.col("base") - F.col("other")) > tolerance))


def rescored(records: DataFrame, annotations: dict[str, DataFrame], key: str = "task_id") -> DataFrame:
    """Records with their annotations, one left join for each table; the optimiser broadcasts small ones."""
    for name, table in annotations.items():
        records = records.join(table.select(key, F.struct(*[c for c in table.columns if c != key]).alias(name)), key, "left")
    return records


def rescoring_rules(records: DataFrame, prompt_sha256: str, rubric_sha256: Column) -> dict[str, Column]:
    """Rules that a saved record must keep to be scored again offline, for ``checked``; nothing that is missing is made up.

    records: agent_system_prompt_sha256, judge_rubric_sha256, official_scores, judge_result,
    environment_transcript, scoring_inputs (a struct) and the digest saved with it. The prompt and the
    rubric (``rubric_sha256``: the one of today's annotations) are those that the record was made with,
    its inputs are frozen, and their digest is still theirs.
    """
    there = lambda c: F.col(c).isNotNull()
    return {
        "prompt": F.col("agent_system_prompt_sha256").eqNullSafe(F.lit(prompt_sha256)),
        "frozen": there("official_scores") & there("judge_result"),
        "rubric": F.col("judge_rubric_sha256").eqNullSafe(rubric_sha256),
        "transcript": there("environment_transcript"),
        "inputs": there("scoring_inputs") & F.col("scoring_inputs_sha256").eqNullSafe(inputs_sha256(records)),
    }


def inputs_sha256(records: DataFrame) -> Column:
    """The digest of a record's scoring inputs: that of their canonical JSON."""
    return canonical_sha256(F.col("scoring_inputs"), records.schema["scoring_inputs"].dataType)


def with_lineage(records: DataFrame, reward_version: str, project: Column) -> DataFrame:
    """Records as a rescoring saves them: what they came from, the new version, and inputs that name today's configuration.

    records: reward_version, evaluation_manifest_id, scoring_inputs and their digest; project: the
    configuration, which takes the place of ``reward_project_config`` in the inputs. Adds
    rescored_from_reward_version, rescored_from_scoring_inputs_sha256 and
    rescored_from_evaluation_manifest_id; a rescored record belongs to no evaluation any more.
    """
    told = records.withColumns({"rescored_from_reward_version": F.col("reward_version"), "rescored_from_scoring_inputs_sha256": F.col("scoring_inputs_sha256"), "rescored_from_evaluation_manifest_id": F.col("evaluation_manifest_id")})
    new = told.drop("evaluation_manifest_id").withColumns({"reward_version": F.lit(reward_version), "scoring_inputs": F.col("scoring_inputs").withField("reward_project_config", project)})
    return new.withColumn("scoring_inputs_sha256", inputs_sha256(new))


def membership(groups: DataFrame, saved: DataFrame, fields: list[str], by: str = "trajectory_id") -> DataFrame:
    """Group members whose saved record is missing or differs in a field."""
    g, s = groups.alias("g"), saved.alias("s")
    joined = g.join(s, F.col(f"g.{by}") == F.col(f"s.{by}"), "left")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"g.{f}").eqNullSafe(F.col(f"s.{f}")), F.lit(f)) for f in fields]))
    return joined.select(F.col(f"g.{by}"), F.col(f"s.{by}").isNull().alias("missing"), differs.alias("differs")).where(F.col("missing") | (F.size("differs") > 0))


def audit(actual: DataFrame, expected: DataFrame, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows of a hand audit that a result misses by more than the tolerance."""
    return expected.select(key, F.col(value).alias("expected")).join(actual.select(key, F.col(value).alias("actual")), key, "left").where(F.col("actual").isNull() | (F.abs(F.col("actual") - F.col("expected")) > tolerance))
