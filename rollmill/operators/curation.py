"""Dialogue curation: leakage anti-joins, rejection cascades, normalisation, prefix explosion, dedup, caps, splits and samples."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rollmill.functions import scalars
from rollmill.operators.scans import numbered
from rollmill.sources.shared import checkpointed


def leak_filter(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the manifest; the optimiser broadcasts a manifest that is small."""
    return rows.join(manifest.select(key).distinct(), key, "left_anti")


def removed_counts(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows that the manifest removes, by key, in the order of the keys' trailing integers."""
    hit = rows.join(manifest.select(key).distinct(), key, "left_semi")
    return hit.groupBy(key).agg(F.count(F.lit(1)).alias("n_removed"))


def unmatched_manifest(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Manifest ids that match no row; accounting demands that there are none."""
    return manifest.select(key).distinct().join(rows, key, "left_anti")


def residual(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Kept rows that a manifest id still matches; verification demands that there are none."""
    return rows.join(manifest.select(key).distinct(), key, "left_semi")


#: Words of the runs that passages are found by, passages that one scan compares with all documents, hashes (8 bytes each) and bytes of likely pairs that are broadcast.
RUN_WORDS, FEW, MAX_HASHES, MAX_PAIR_BYTES = 4, 64, 1 << 21, 32 << 20


def _bounded(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, of which there are ``n``, to be broadcast if that is few; else the optimiser chooses."""
    return F.broadcast(rows) if n <= MAX_HASHES else rows


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def _runs(words: Column, n: int) -> Column:
    """Hashes of the distinct runs of ``n`` words; null for fewer words."""
    hashed = lambda i: F.xxhash64(F.lit(n), *[F.get(words, i + k) for k in range(n)])
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - n), hashed)))


def postings(docs: DataFrame, wanted: DataFrame, n_wanted: int, key: str, words: Callable[[Column], Column], lengths: list[int], text: str = "text") -> DataFrame:
    """key, __h: which of the ``wanted`` hashes (__h, of which there are ``n_wanted``) each document has, by one scan of the documents.

    Wanted hashes of a bounded number go to the documents, so that only what is found is exchanged.
    """
    # the words are bound once, as the variable of an outer lambda, and not cut again for each run
    each = lambda a: F.concat(*(F.coalesce(_runs(a, n), F.array().cast("array<bigint>")) for n in lengths))
    held = docs.select(key, F.explode(F.flatten(F.transform(F.array(words(F.col(text))), each))).alias("__h"))
    return checkpointed(held.join(_bounded(wanted.select("__h").distinct(), n_wanted), "__h", "left_semi"))


def leaking(docs: DataFrame, benchmark: DataFrame, key: str, text: str = "text", item_text: str = "text", words: int = RUN_WORDS) -> DataFrame:
    """Keys of documents that contain a passage verbatim.

    A passage is found by one of its runs of ``words`` whole words (all but its first and last word
    are whole in any document that shows it), the one that the fewest documents hold; ``contains``
    decides. Shorter passages have shorter runs. One scan finds the runs of all lengths, a second one
    reads the texts of likely documents. Passages without a whole word of their own have to be looked
    for at every place; they are compared with all documents, FEW of them in a scan's one condition.
    """
    items = benchmark.select(F.col(item_text).alias("__p")).where(F.length("__p") > 0).distinct()
    inner = items.withColumn("__w", _words(F.col("__p"))).withColumn("__w", F.slice("__w", F.lit(2), F.greatest(F.size("__w") - 2, F.lit(0)))).withColumn("__n", F.least(F.size("__w"), F.lit(words)))
    own = F.coalesce(*(F.when(F.col("__n") == n, _runs(F.col("__w"), n)) for n in range(1, words + 1)))
    mine = checkpointed(inner.select("__p", "__n", F.explode_outer(own).alias("__h")))
    sizes = {r["__n"]: r["n"] for r in mine.groupBy("__n").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length
    few, found = sizes.pop(0, 0), None
    if sizes:
        runs = mine.where("__n > 0")
        held = postings(docs, runs, sum(sizes.values()), key, _words, sorted(sizes), text)
        counts = held.groupBy("__h").agg(F.count(F.lit(1)).alias("__c"))
        # a run that no document holds says that none holds the passage
        best = runs.join(counts, "__h", "left").groupBy("__p").agg(F.min_by("__h", F.coalesce("__c", F.lit(0))).alias("__h"), F.min(F.coalesce("__c", F.lit(0))).alias("__c")).where("__c > 0")
        likely = checkpointed(held.join(best, "__h").select(key, "__p").distinct())
        # the texts stay where they are as long as the pairs can go to them
        size = likely.agg(F.coalesce(F.sum(F.octet_length("__p") + 32), F.lit(0))).first()[0]
        found = docs.select(key, text).join(F.broadcast(likely) if size <= MAX_PAIR_BYTES else likely, key).where(F.contains(F.col(text), F.col("__p"))).select(key)
    rest = [r["__p"] for r in mine.where("__n = 0").select("__p").toLocalIterator()] if few else []  # texts of two words at most
    for k in range(0, len(rest), FEW):
        some = reduce(lambda a, b: a | b, [F.contains(F.col(text), F.lit(p)) for p in rest[k : k + FEW]])
        hits = docs.where(some).select(key)
        found = hits if found is None else found.union(hits)
    return docs.select(key).limit(0) if found is None else found.distinct()


#: What a template leaves open: dates, times, numbers with their units or signs, codes of letters and digits, addresses (fixed order, first match first).
SLOT = r"(?i)\d{4}-\d\d-\d\d(?:t\d\d:\d\d(?::\d\d)?)?|\d{1,2}:\d\d(?::\d\d)?|[\w.+-]+@[\w-]+\.[\w.]+|\b(?=\w*\d)\w+(?:[.,]\d+)*\b"
SLOT_MARK = "\u25a1"


def skeleton(text: Column) -> Column:
    """Words of a text in lower case, with what fills a template's slots as one mark, and without other punctuation."""
    masked = F.regexp_replace(F.lower(text), SLOT, SLOT_MARK)
    return F.array_remove(F.split(masked, rf"[^\p{{L}}\p{{M}}{SLOT_MARK}]+"), "")


def template_leaks(docs: DataFrame, benchmark: DataFrame, key: str, item: str, share: float = 0.8, words: int = 3, text: str = "text", item_text: str = "text") -> DataFrame:
    """key, item, n_common, n_runs: documents that hold at least ``share`` of the distinct runs of an item's skeleton, whatever fills its slots.

    A containment join by prefix: a document with enough of an item's n runs holds one of its rarest
    n - ceil(share * n) + 1, by the documents that hold each; only these make pairs, and runs that
    half of the documents share make none unless an item has no rarer ones. The documents are read
    once. Items of fewer words than a run have no skeleton.
    """
    runs = _runs(skeleton(F.col(item_text)), words)
    items = checkpointed(benchmark.select(F.col(item).alias("__item"), F.explode(runs).alias("__h")))
    held = postings(docs, items, items.count(), key, skeleton, [words], text)
    counts = held.groupBy("__h").agg(F.count(F.lit(1)).alias("__c"))
    n = W.partitionBy("__item")  # an item's own runs
    ranked = items.join(counts, "__h", "left").withColumns({"__n": F.count(F.lit(1)).over(n), "__k": F.row_number().over(n.orderBy(F.coalesce("__c", F.lit(0)), "__h"))})
    need = F.ceil(F.lit(share) * F.col("__n") - 1e-9)
    prefix = ranked.where((F.col("__k") <= F.col("__n") - need + 1) & F.col("__c").isNotNull()).select("__h", "__item", "__n", need.alias("__need"))
    pairs = checkpointed(held.join(prefix, "__h").select(key, "__item", "__n", "__need").distinct())
    common = pairs.join(items, "__item").join(held, [key, "__h"]).groupBy(key, "__item", "__n", "__need").agg(F.count(F.lit(1)).alias("n_common"))
    return common.where(F.col("n_common") >= F.col("__need")).select(key, F.col("__item").alias(item), "n_common", F.col("__n").alias("n_runs"))


def value_leaks(docs: DataFrame, targets: DataFrame, key: str, item: str, values: str = "values", text: str = "text") -> DataFrame:
    """key, item: documents in which all of an item's values (such as a flight and its day) stand as words.

    targets: item and values, an array of one-word strings. An item is found by its rarest value.
    """
    plain = lambda c: F.split(F.lower(c), r"[^\p{L}\p{M}\p{N}._@-]+")
    trimmed = lambda a: F.array_remove(F.transform(a, lambda w: F.regexp_replace(w, r"^[._@-]+|[._@-]+$", "")), "")
    shaped = targets.select(F.col(item).alias("__item"), F.array_distinct(F.transform(values, F.lower)).alias("__v")).where(F.size("__v") > 0)
    wanted = checkpointed(shaped.select("__item", F.size("__v").alias("__n"), F.explode("__v").alias("__w")).withColumn("__h", F.xxhash64(F.lit(1), "__w")))
    held = postings(docs, wanted, wanted.count(), key, lambda c: trimmed(plain(c)), [1], text)
    counts = held.groupBy("__h").agg(F.count(F.lit(1)).alias("__c"))
    best = wanted.join(counts, "__h", "left").groupBy("__item").agg(F.min_by("__h", F.coalesce("__c", F.lit(0))).alias("__h"), F.min(F.coalesce("__c", F.lit(0))).alias("__c"), F.max("__n").alias("__n")).where("__c > 0")
    pairs = held.join(best, "__h").select(key, "__item", "__n")
    common = pairs.join(wanted.select("__item", "__h"), "__item").join(held, [key, "__h"]).groupBy(key, "__item", "__n").agg(F.count(F.lit(1)).alias("__m"))
    return common.where(F.col("__m") == F.col("__n")).select(key, F.col("__item").alias(item))


def leak_kinds(docs: DataFrame, benchmark: DataFrame, targets: DataFrame, key: str, item: str, share: float = 0.8) -> DataFrame:
    """key, verbatim, values, template: which kinds of leak each leaking document has; documents without any are left out."""
    kinds = {"verbatim": leaking(docs, benchmark, key), "values": value_leaks(docs, targets, key, item).select(key), "template": template_leaks(docs, benchmark, key, item, share).select(key)}
    marked = [rows.distinct().select(key, *(F.lit(k == name).alias(k) for k in kinds)) for name, rows in kinds.items()]
    return reduce(DataFrame.unionByName, marked).groupBy(key).agg(*(F.bool_or(k).alias(k) for k in kinds))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def conversion_reason(reward: Column, termination: Column, messages: Column, reasoning: Column) -> Column:
    """Why a rollout gives no training rows: the first of reward, termination, missing messages, reasoning, tool error."""
    return first_reason(
        [
            ("not_successful", ~scalars.official_success(reward)),
            ("termination", ~F.coalesce(termination.isin(*scalars.NORMAL_STOPS), F.lit(False))),
            ("missing_messages", messages.isNull() | (F.size(messages) == 0)),
            ("reasoning", reasoning),
            ("tool_error", has_tool_error(messages)),
        ]
    )


def has_tool_error(messages: Column) -> Column:
    return F.coalesce(F.exists(messages, lambda m: (m["role"] == "tool") & m["error"].eqNullSafe(F.lit(True))), F.lit(False))


def normalize_messages(messages: Column, keep_name: bool = False, roles: tuple[str, ...] = ("user", "assistant", "tool")) -> Column:
    """role, content (null: empty), name and tool_calls of messages of the listed roles; null if another role occurs."""
    whole = F.forall(messages, lambda m: m["role"].isin(*roles))
    shaped = F.transform(
        messages,
        lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), (m["name"].cast("string") if keep_name else F.lit(None).cast("string")).alias("name"), F.when(F.size(m["tool_calls"]) > 0, m["tool_calls"]).alias("tool_calls")),
    )
    return F.when(whole, shaped)


def normalize_tool_calls(calls: Column) -> Column:
    """name and arguments of calls, wrapped in ``function`` or flat; none becomes null."""
    return F.when(F.size(calls) > 0, F.transform(calls, lambda c: F.struct(F.coalesce(c["function"]["name"], c["name"]).alias("name"), F.coalesce(c["function"]["arguments"], c["arguments"]).alias("arguments"))))


TARGET = "n_history long, history_sha256 string, answer_sha256 string"


def prefix_targets(messages: DataFrame, dialog: str = "dialog_id", index: str = "message_index") -> DataFrame:
    """One row for each assistant message right after a user or tool message, with the history's size and digest.

    The history of a row is all earlier messages as role:content lines. One pass over a dialog's
    sorted messages carries the digest along, so no history is ever built: memory and work are
    those of the messages. Messages whose role or content is null count for the size and show as
    nothing in the history.
    """
    kinds = dict(messages.dtypes)
    rows = messages.select(dialog, index, "role", "content").repartition(dialog).sortWithinPartitions(dialog, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n, before, digest = object(), 0, None, None  # digest: None before the first line
        for batch in batches:
            out: list[tuple] = []
            for d, i, role, content in zip(*(batch.column(c).to_pylist() for c in (dialog, index, "role", "content")), strict=True):
                if d != here:
                    here, n, before, digest = d, 0, None, None
                if role == "assistant" and before in ("user", "tool"):
                    out.append((d, i, n, (digest or hashlib.sha256()).hexdigest(), None if content is None else hashlib.sha256(content.encode()).hexdigest()))
                if role is not None and content is not None:
                    line = f"{role}:{content}"
                    if digest is None:
                        digest = hashlib.sha256(line.encode())
                    else:
                        digest.update(f"\n{line}".encode())
                n, before = n + 1, role
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[dialog, index, "n_history", "history_sha256", "answer_sha256"])

    types = [to_arrow_type(messages.schema[dialog].dataType), to_arrow_type(messages.schema[index].dataType), pa.int64(), pa.string(), pa.string()]
    return rows.mapInArrow(run, f"{dialog} {kinds[dialog]}, {index} {kinds[index]}, {TARGET}")


def first_by_fingerprint(rows: DataFrame, fingerprint: Column, order: list[Column | str]) -> DataFrame:
    """Of rows with equal fingerprints, the first in the order; a tie-free order makes it exact."""
    w = W.partitionBy("__f").orderBy(*order)
    return rows.withColumn("__f", fingerprint).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__f", "__rn")


def capped(rows: DataFrame, group: list[str], order: list[Column | str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group; 0 means all."""
    if cap == 0:
        return rows
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__rn") <= cap).drop("__rn")


def cap_with_dedup(rows: DataFrame, task: str, unit: str, order: str, fingerprint: str, cap: int, rounds: int = 50) -> DataFrame:
    """Accepted rows under per-task caps counted in units that bring something new.

    rows: task, unit, order (a total order of units), fingerprint. A unit takes a place of its
    task's cap only if it has a fingerprint that no accepted unit before it has; units beyond the
    cap leave theirs to later ones. What a unit gets depends on earlier units alone, so passes
    that judge all units by the last pass's verdicts settle from the first unit on, and the fixed
    point is the sequential result. cap 0: no cap.
    """
    base = checkpointed(rows.select(task, unit, order, fingerprint).distinct())
    earlier = W.partitionBy(fingerprint).orderBy(order, unit).rowsBetween(W.unboundedPreceding, -1)
    verdicts = base.select(unit).distinct().withColumn("__out", F.lit(False))
    state = None
    for _ in range(rounds):
        judged = base.join(verdicts, unit)
        fresh = judged.withColumn("__new", ~F.coalesce(F.bool_or(~F.col("__out")).over(earlier), F.lit(False)))
        units = fresh.groupBy(task, unit, order).agg(F.bool_or("__new").alias("__adds"))
        place = F.row_number().over(W.partitionBy(task, "__adds").orderBy(order, unit))
        verdicts = checkpointed(units.select(unit, (~F.col("__adds") | (F.lit(cap > 0) & (place > cap))).alias("__out")))
        now = tuple(verdicts.where("__out").agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(unit))).first())
        if now == state:
            return fresh.join(verdicts.where("not __out").select(unit), unit, "left_semi").where("__new").drop("__new", "__out")
        state = now
    raise RuntimeError("caps did not settle")


def group_split(rows: DataFrame, group: str, ratio: float, seed: int) -> DataFrame:
    """Adds ``split``: whole groups go to validation, the lowest by sha256 of "seed:group"; at least one, and never all."""
    groups = rows.select(group).distinct()
    n = groups.count()
    k = min(max(1, round(n * ratio)), n - 1) if n > 1 else 0  # round() is half to even
    # the k lowest by a bounded top-k, not by a global window
    chosen = groups.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256), group).limit(k).withColumn("split", F.lit("validation"))
    return rows.join(chosen, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def sample_rows(rows: DataFrame, n: int, seed: int, key: list[str], order: list[str] | None = None) -> DataFrame:
    """A uniform sample of n rows without replacement, by a keyed hash, and reproducible; fewer rows fail. With ``order``, in that order."""
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)
    few = drawn.limit(n).agg(F.count(F.lit(1))).scalar() < n
    drawn = drawn.where(F.when(few, F.raise_error(F.lit(f"fewer than {n} rows")).cast("boolean")).otherwise(F.lit(True)))
    return drawn.orderBy(*order) if order else drawn


#: Indices that the driver draws and holds for an exact sample, at some 40 bytes each, and of these how many are broadcast.
MAX_DRAWN, MAX_BROADCAST = 20_000_000, 4_000_000


def seeded_sample(rows: DataFrame, k: int, seed: int, order: list[str]) -> DataFrame:
    """The rows that ``random.Random(seed).sample(range(n), k)`` names, numbered by ``order``; adds ``place``, from 0, by which they come sorted.

    The index stream is one sequence by its definition, so the driver draws it, ``MAX_DRAWN`` at
    most; the rows are numbered in ranges (see ``scans``) and none but the sample leave them. Rows that
    tie in ``order`` are numbered in no certain order. Fewer rows than k are an error.
    """
    if not 0 <= k <= MAX_DRAWN:
        raise ValueError(f"an exact sample has 0 to {MAX_DRAWN} rows; sample_rows draws larger ones by hash")
    numbered_rows = numbered(rows, order, "place").withColumn("place", F.col("place") - 1)
    n = rows.count()
    if n < k:
        raise ValueError(f"{k} of {n} rows can't be drawn without replacement")
    drawn = random.Random(seed).sample(range(n), k)
    spark = rows.sparkSession
    table = pa.table({"place": pa.array(drawn, pa.int64())})
    indices = spark.createDataFrame(table) if k else spark.createDataFrame([], "place long")
    if k <= MAX_BROADCAST:
        indices = F.broadcast(indices)
    return numbered_rows.join(indices, "place", "left_semi").orderBy("place")


def shuffled(rows: DataFrame, seed: int, key: list[str], batch: int | None = None) -> DataFrame:
    """Rows with ``place``, their order under a keyed hash within a hash range; a distributed shuffle.

    batch: rows that do not fill a last batch of so many are dropped, those of the greatest places.
    """
    placed = rows.withColumn("place", F.xxhash64(F.lit(seed), *key))
    if batch:
        over = rows.count() % batch
        last = placed.select("place", *key).orderBy(F.desc("place"), *[F.desc(k) for k in key]).limit(over)  # fewer than a batch
        placed = placed.join(F.broadcast(last), ["place", *key], "left_anti")
    return placed.repartitionByRange("place", *key).sortWithinPartitions("place", *key)


def valid_sft_rows(messages: Column, answer: Column, tools: Column) -> dict[str, Column]:
    """Rules of a training row, for ``checked``."""
    last = F.try_element_at(messages, F.lit(-1))["role"]
    return {
        "messages_empty": F.size(messages) > 0,
        "last_role": last.isin("user", "tool"),
        "answer_role": answer["role"] == "assistant",
        "answer_empty": (F.length(F.coalesce(answer["content"], F.lit(""))) > 0) | (F.size(answer["tool_calls"]) > 0),
        "tools_empty": F.size(tools) > 0,
    }


def system_prompts(messages: DataFrame, dialog: str = "dialog_id", index: str = "message_index") -> DataFrame:
    """Digest and count of each distinct leading system message; sound data has one."""
    lead = messages.where((F.col("role") == "system")).groupBy(dialog).agg(F.count(F.lit(1)).alias("n"), F.min_by("content", index).alias("content"))
    return lead.groupBy(F.sha2("content", 256).alias("prompt_sha256")).agg(F.count(F.lit(1)).alias("n_dialogs"), F.max("n").alias("most_in_a_dialog"))


def cleanup_sets(tagged: DataFrame, names: list[str]) -> DataFrame:
    """The union of named id sets of (set_name, id)."""
    return tagged.where(F.col("set_name").isin(names)).select("id").distinct()


def overlay(base: DataFrame, repairs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the repairs' columns where they have a row for the key."""
    fixed = repairs.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    return base.join(fixed, key, "left").select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def within_budget(rows: DataFrame, length: Column, limit: int) -> DataFrame:
    return rows.where(length <= limit)


def loss_row_counts(targets: DataFrame) -> DataFrame:
    """Target kinds, rows with tools and distinct dialogs."""
    return targets.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("has_tool_call")).alias("tool_targets"), F.count_if(~F.col("has_tool_call")).alias("text_targets"), F.countDistinct("dialog_id").alias("dialogs"))
