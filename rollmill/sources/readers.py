"""Readers of trajectories, results, JSON lines, manifests and bundles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill import schemas
from rollmill.operators.common import checked
from rollmill.sources.archives import reachable, read_tar, unsafe


def trajectories(spark: SparkSession, folder: str, on_error: str = "raise") -> DataFrame:
    """One JSON file for each trajectory; ``file_name`` gives the files' order. Rows are checked against the schema's rules."""
    rows = spark.read.schema(schemas.struct(schemas.TRAJECTORY_DDL)).option("multiLine", True).option("mode", "FAILFAST").json(folder).withColumn("file_name", F.col("_metadata.file_name"))
    return checked(rows, schemas.trajectory_rules(), on_error)


def results(spark: SparkSession, folder: str, simulation_ddl: str) -> DataFrame:
    """Simulations of ``results.json``, inline there or as files of ``simulations/``."""
    element = f"array<struct<{', '.join(f'{p.split(" ", 1)[0]}:{p.split(" ", 1)[1]}' for p in schemas._split(simulation_ddl))}>>"
    head = spark.read.schema(f"simulations {element}").option("multiLine", True).json(f"{folder}/results.json")
    inline = head.select(F.inline("simulations"))
    if head.where(F.col("simulations").isNotNull()).take(1):
        return inline
    return spark.read.schema(simulation_ddl).option("multiLine", True).json(f"{folder}/simulations/*.json")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """raw (the line) and record (a variant) of nonblank lines; a line that is no JSON object fails the job."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.col("value").alias("raw"), F.try_parse_json("value").alias("record"))
    return checked(lines, {"json_object": F.schema_of_variant("record").startswith("OBJECT")})


def nonblank_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines without their terminator, which a writer has to give back."""
    return spark.read.text(path, lineSep="\n").where(F.length(F.trim("value")) > 0)


def dialog_ids(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds source_dialog_id from the record's metadata; a missing one fails the job."""
    out = lines.withColumn("source_dialog_id", F.get_json_object(raw, "$.metadata.source_dialog_id"))
    return checked(out, {"source_dialog_id": F.length("source_dialog_id") > 0})


def keyed_list(spark: SparkSession, path: str, ddl: str, key: str, other: str | None = None) -> DataFrame:
    """A JSON list of records under a unique key, which may also be named ``other``; duplicates fail."""
    rows = spark.read.schema(ddl).option("multiLine", True).json(path)
    if other:
        rows = rows.withColumn(key, F.coalesce(key, other)).drop(other)
    doubled = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    if doubled:
        raise ValueError(f"duplicate {key}: {doubled[0][key]}")
    return checked(rows, {key: F.col(key).isNotNull()})


def cleanup_set(spark: SparkSession, manifest: str, name: str) -> DataFrame:
    """The ids of a named set of a manifest (set_name, count, dialog_ids); not empty, unique, and as many as it says."""
    rows = spark.read.schema("set_name string, count long, dialog_ids array<string>").option("multiLine", True).json(manifest).where(F.col("set_name") == name)
    rows = checked(rows, {"nonempty": F.size("dialog_ids") > 0, "unique": F.size("dialog_ids") == F.size(F.array_distinct("dialog_ids")), "count": F.size("dialog_ids") == F.col("count")})
    return rows.select(F.explode("dialog_ids").alias("dialog_id"))


def covers(found: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Keys on one side alone, with the side; empty if the two cover each other."""
    a, b = found.select(key).distinct(), wanted.select(key).distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("found")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("wanted")))


#: Files of a saved run that matter, by their paths below the run's root (fixed values).
RUN_MARK = "base_model_identity.json"
RUN_FILES = r"^(base_model_identity\.json|rl_resume_identity\.json|ppo_audit/step_1\.json|(launches|group_audits|trajectories)/[^/]+\.json)$"


def bundle(spark: SparkSession, source: str, limit: int = 32 << 20, run: bool = False) -> DataFrame:
    """path and text of the JSON members of a folder, or of a tar archive; unsafe paths, links and members over the limit fail.

    run: a saved run. Exactly one folder must hold RUN_MARK; paths are those below it, and only the
    files of a run are given, each once. A plain archive is read by as many tasks as its members
    need (see ``archives``). A compressed one, or one in a store that only Spark opens, is one
    stream without an index, so one task reads it, member by member.
    """
    if source.endswith(".tar") and reachable(source):
        files = read_tar(spark, source, limit)
    elif source.endswith((".tar", ".tar.gz", ".tgz")):

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import io
            import tarfile

            for batch in batches:
                for content in batch.column("content"):
                    with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                        for item in tar:
                            if unsafe(item.name) or item.issym() or item.islnk():
                                raise ValueError(f"unsafe member: {item.name}")
                            if item.isfile() and item.name.endswith(".json"):
                                if item.size > limit:
                                    raise ValueError(f"member too large: {item.name}")
                                yield pa.RecordBatch.from_pydict({"path": [item.name], "text": [tar.extractfile(item).read().decode()]})

        files = spark.read.format("binaryFile").load(source).select("content").mapInArrow(members, "path string, text string")
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(source)
        root = re.sub(r"^[a-z]+:(?=/)|/+$", "", source)
        below = F.element_at(F.split("path", re.escape(f"{root}/"), 2), 2) if run else F.col("path")
        files = checked(found, {"size": F.col("length") <= limit}).select(below.alias("path"), F.col("content").cast("string").alias("text"))
    return run_files(files) if run else files


def run_files(files: DataFrame) -> DataFrame:
    """The files (path, text) of the one run among them, by their paths below its root; none or two runs, or two files of one path, fail."""
    roots = [r["root"] for r in files.where(F.regexp_extract("path", r"([^/]+)$", 1) == RUN_MARK).select(F.regexp_replace("path", r"[^/]+$", "").alias("root")).limit(2).collect()]
    if len(roots) != 1:
        raise ValueError(f"{len(roots) or 'no'} runs in the bundle")
    root = F.lit(roots[0])
    mine = files.where(F.col("path").startswith(root)).withColumn("path", F.substring("path", F.length(root) + 1, F.length("path"))).where(F.col("path").rlike(RUN_FILES))
    doubled = mine.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    if doubled:
        raise ValueError(f"two files: {doubled[0]['path']}")
    return mine


def dependencies(spark: SparkSession, path: str) -> DataFrame:
    """task_id, before, after: the order that tasks ask of their actions; a task named twice fails."""
    rows = keyed_list(spark, path, "task_id string, dependencies array<array<string>>", "task_id")
    pairs = rows.select("task_id", F.explode("dependencies").alias("p"))
    pairs = checked(pairs, {"pair": F.size("p") == 2})
    return pairs.select("task_id", F.col("p")[0].alias("before"), F.col("p")[1].alias("after"))


def judge_guidance(spark: SparkSession, path: str, tasks: DataFrame) -> DataFrame:
    """task_id and guidance, of exactly the configured tasks (task_id) and never blank."""
    rows = keyed_list(spark, path, "task_id string, id string, guidance string", "task_id", "id")
    if gap := covers(rows, tasks, "task_id").take(1):
        raise ValueError(f"guidance and tasks differ: {gap[0].asDict()}")
    return checked(rows, {"guidance": F.length(F.trim("guidance")) > 0})


def exported_context(policy: str, tools: DataFrame, name: str = "name", schema: str = "schema") -> DataFrame:
    """One row: the system prompt, its digest, and the tools' schemas (JSON) in the order of their names."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(schema).alias("s")))), lambda t: t["s"])  # a run's few tools
    return tools.agg(F.lit(policy).alias("system_prompt"), F.sha2(F.lit(policy), 256).alias("system_prompt_sha256"), ordered.alias("tools"))


#: Marks of the policy's block, and sentences that tell the prompts of one and of many tool calls (fixed values).
POLICY_START, POLICY_END = "\n<policy>\n", "\n</policy>"
ONE_CALL, MANY_CALLS = "You should only make one tool call at a time", "one or more tool calls"


def policy_of(prompt: Column) -> Column:
    """The text of a system prompt's one policy block; null if there is none, more than one, or a blank one."""
    once = lambda mark: F.size(F.split(prompt, mark)) == 2
    inside = F.substring_index(F.substring_index(prompt, POLICY_START, -1), POLICY_END, 1)
    return F.when(once(POLICY_START) & once(POLICY_END) & (F.length(F.trim(inside)) > 0), inside)


def system_prompt_rules(pinned_sha256: str, archived: bool = False) -> dict[str, Column]:
    """Rules of a prompt artifact (system_prompt, system_prompt_sha256), for ``checked``."""
    digest = F.sha2("system_prompt", 256)
    rules = {"text": F.length(F.trim("system_prompt")) > 0, "pinned": (digest == pinned_sha256) & (digest == F.col("system_prompt_sha256")), "policy": policy_of(F.col("system_prompt")).isNotNull()}
    return rules if archived else rules | {"one_tool_call": F.contains("system_prompt", F.lit(ONE_CALL)) & ~F.contains("system_prompt", F.lit(MANY_CALLS))}


def tree_digest(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 over the name-sorted digests of a folder's files; one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    one = files.select(F.concat_ws(":", F.regexp_replace("path", r"^.*/", ""), F.sha2("content", 256)).alias("d"))
    return one.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("d"))), 256).alias("digest"))  # one short string a file


def with_default(rows: DataFrame, measured: DataFrame, key: str, column: str, default: str = "not_measured") -> DataFrame:
    return rows.join(measured.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def profile(config: dict, pick: Callable[[dict], bool] = lambda p: bool(p.get("current"))) -> dict:
    """The one profile of a configuration that is marked current."""
    found = [p for p in config.get("profiles", []) if pick(p)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} current profiles")
    return found[0]


def load_yaml(text: str) -> dict:
    """A YAML mapping; anything else at the root fails."""
    import yaml

    out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise ValueError("the root is no mapping")
    return out


def load_config(text: str, environment: dict[str, str]) -> dict:
    """A configuration from YAML: sound by its rules, a switched-off judge without its settings, and every variable filled in."""
    from rollmill.functions.configs import broken_rules

    config = load_yaml(text)
    if broken := broken_rules(config):
        raise ValueError(f"broken rules: {', '.join(broken)}")
    if config.get("judge", {}).get("enabled") is False:
        config["judge"] = {"enabled": False}
    return expand(config, environment)


#: What marks a value that a user has to fill in (fixed value).
PLACEHOLDER = "FIX_EXACT_"


def expand(value, environment: dict[str, str]):
    """``${NAME:-default}`` and ``${NAME}`` in all strings of a configuration; what stays empty, missing or a placeholder fails."""
    if isinstance(value, dict):
        return {k: expand(v, environment) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, environment) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        found = environment.get(m[1], m[2])
        if found is None or (not found and m[0] == value):
            raise KeyError(m[1])
        return found

    out = re.sub(r"\$\{([A-Za-z_]\w*)(?::-([^}]*))?\}", put, value)
    if out.startswith(PLACEHOLDER):
        raise KeyError(out)
    return out
