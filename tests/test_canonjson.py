"""Canonical JSON as column expressions, byte for byte what Python writes."""

import hashlib
import json
import math
import random
import struct

from pyspark.sql import functions as F

from rollmill.functions import canonjson

SCHEMA = "role string, n long, x double, ok boolean, tags array<string>, more map<string,struct<b:int,a:array<double>>>, deep struct<z:string,y:struct<q:string,p:array<struct<k:string,v:boolean>>>>"


def value(rng, depth=0):
    text = lambda: rng.choice([None, "", "plain", 'q"\\/', "line\nend\r\t\b\f", "\x00\x1f\x7f", "é ü 中 😀  ", " sp "])
    number = lambda: rng.choice([None, 0.0, -0.0, 1.0, 0.1, 1e16, 1e-5, 123456.789, rng.uniform(-1e3, 1e3)])
    flag = lambda: rng.choice([None, True, False])
    many = lambda make: None if rng.random() < 0.2 else [make() for _ in range(rng.randrange(4))]
    return {
        "role": text(), "n": rng.choice([None, 0, -7, 2**62]), "x": number(), "ok": flag(), "tags": many(text),
        "more": None if rng.random() < 0.2 else {k: rng.choice([None, {"b": rng.choice([None, 5]), "a": many(number)}]) for k in rng.sample(["b", "a", "Z", "é", "a\nb", ""], rng.randrange(4))},
        "deep": None if rng.random() < 0.2 else {"z": text(), "y": rng.choice([None, {"q": text(), "p": many(lambda: {"k": text(), "v": flag()})}])},
    }


def test_nested_rows(spark):
    rng = random.Random(1)
    rows = [value(rng) for _ in range(300)]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v struct<" + ",".join(f"{a}:{b}" for a, b in (p.split(" ", 1) for p in SCHEMA.split(", "))) + ">")
    kind = frame.schema["v"].dataType
    got = {r["k"]: r for r in frame.select("k", canonjson.canonical(F.col("v"), kind).alias("tight"), canonjson.canonical(F.col("v"), kind, spaced=True).alias("loose"), canonjson.canonical_sha256(F.col("v"), kind).alias("sha"), canonjson.canonical(F.col("v"), kind, absent=("x", "z")).alias("fewer")).collect()}

    def without(x):
        if isinstance(x, dict):
            return {k: without(y) for k, y in x.items() if not (k in ("x", "z") and y is None)}
        return [without(y) for y in x] if isinstance(x, list) else x

    for k, row in enumerate(rows):
        tight = json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert got[k]["tight"] == tight
        assert got[k]["loose"] == json.dumps(row, ensure_ascii=False, sort_keys=True)
        assert got[k]["sha"] == hashlib.sha256(tight.encode()).hexdigest()
        assert got[k]["fewer"] == json.dumps(without(row), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_doubles(spark):
    rng = random.Random(2)
    some = [0.0, -0.0, 1.0, -1.5, 1e15, 1e16, 123456789012345680.0, 1e22, 1e23, 1e-4, 1e-5, 9.999e-5, 2.0**-44, 5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, 0.1, 1 / 3, 2e-3, 100.0, 4.35, 9007199254740993.0, math.pi * 1e100]
    some += [rng.uniform(-1, 1) * 10 ** rng.randrange(-30, 30) for _ in range(2000)] + [round(rng.uniform(-1e4, 1e4), rng.randrange(6)) for _ in range(2000)]
    some += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2000)) if math.isfinite(x)]
    got = [r["t"] for r in spark.createDataFrame([(k, x) for k, x in enumerate(some)], "k int, x double").select("k", canonjson.double(F.col("x")).alias("t")).orderBy("k").collect()]
    wrong = [(repr(x), t) for x, t in zip(some, got, strict=True) if repr(x) != t]
    far = [(a, b) for a, b in wrong if (abs(float(a)) >= 9.2e18 or abs(float(a)) < 1e-15) and float(a) == float(b) and len(a) == len(b)]
    assert wrong == far and len(far) < 5
