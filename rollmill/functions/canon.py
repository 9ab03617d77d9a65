"""Arrow UDFs for what column functions can't express: canonical JSON, recursive predicates, semantic arguments.

Canonical JSON has sorted keys, no spaces and unescaped non-ASCII characters; nulls stay. A null
or malformed input gives null (predicates: false).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.functions import jsonrules, jsonschemas


@F.arrow_udf(T.StringType())
def canonical_json(column: pa.Array) -> pa.Array:
    return jsonrules.each(column, jsonrules.canonical, pa.string())


@F.arrow_udf(T.StringType())
def fingerprint(column: pa.Array) -> pa.Array:
    """SHA-256 of the canonical JSON."""
    return jsonrules.each(column, lambda x: hashlib.sha256(jsonrules.canonical(x).encode()).hexdigest(), pa.string())


@F.arrow_udf(T.BooleanType())
def has_reasoning(column: pa.Array) -> pa.Array:
    """A non-empty value under a reasoning key, or a think tag, anywhere."""
    return jsonrules.each(column, lambda x: jsonrules.reasons(x, False), pa.bool_(), False)


@F.arrow_udf(T.BooleanType())
def contains_reasoning(column: pa.Array) -> pa.Array:
    """A reasoning key, or a think tag, anywhere."""
    return jsonrules.each(column, lambda x: jsonrules.reasons(x, True), pa.bool_(), False)


def arguments_key(unordered: dict[str, set[tuple[str, ...]]] | None = None, fields: dict[str, dict[str, frozenset[str]]] | None = None, without: tuple[str, ...] = ()) -> Callable[[Column, Column], Column]:
    """A UDF (tool, arguments JSON) -> canonical string, so that semantic equality becomes an equi-join key."""
    loose, kept = jsonrules.UNORDERED if unordered is None else unordered, jsonrules.MODEL_INPUTS if fields is None else fields

    @F.arrow_udf(T.StringType())
    def key(tool: pa.Array, arguments: pa.Array) -> pa.Array:
        return pa.array([jsonrules.arguments_string(n, t, loose, kept, without) for n, t in zip(tool.to_pylist(), arguments.to_pylist(), strict=True)], pa.string())

    return key


@F.arrow_udf(T.BooleanType())
def argument_pattern_matches(pattern: pa.Array, arguments: pa.Array) -> pa.Array:
    return pa.array([jsonrules.pattern_holds(p, a) for p, a in zip(pattern.to_pylist(), arguments.to_pylist(), strict=True)], pa.bool_())


@F.arrow_udf(T.BooleanType())
def quote_in_generation(quote: pa.Array, text: pa.Array, has_tools: pa.Array) -> pa.Array:
    """See ``jsonrules.quoted``; a null flag counts as no tool calls."""
    columns = (quote.to_pylist(), text.to_pylist(), has_tools.to_pylist())
    return pa.array([jsonrules.quoted(q, t, bool(h)) for q, t, h in zip(*columns, strict=True)], pa.bool_())


def call_error(schemas: dict[str, dict]) -> Callable[[Column, Column], Column]:
    """A UDF (tool, arguments JSON) -> struct of error_kind and detail, both null for a valid call.

    Arguments that are no JSON object are schema_invalid, whatever the tool; a tool without a
    schema is unknown_tool; the detail names the first fault by its place.
    """
    kind = T.StructType([T.StructField("error_kind", T.StringType()), T.StructField("detail", T.StringType())])
    shape = pa.struct([("error_kind", pa.string()), ("detail", pa.string())])

    @F.arrow_udf(kind)
    def check(tool: pa.Array, arguments: pa.Array) -> pa.Array:
        found = [jsonschemas.call_error(n, t, schemas) for n, t in zip(tool.to_pylist(), arguments.to_pylist(), strict=True)]
        return pa.array([{"error_kind": k, "detail": d} for k, d in found], shape)

    return check
