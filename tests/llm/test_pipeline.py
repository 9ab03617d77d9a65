"""Every stage on its own input, held against the operator's brute force, and the whole run."""

import re
from pathlib import Path

import pytest

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = []
    for _, stage in C.STAGES:
        out = stage(spark, docs, SF).cache()
        tables.append((docs, out))
        docs = out
    for before, after in tables[:-1]:
        assert after.columns == before.columns and after.count() > 0
        assert not after.join(before, "doc_id", "left_anti").take(1)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in tables[0][1].collect()}
    known = [(i, q) for i, q in quality.items() if q is not None]
    assert sum((i in kept) == bool(q) for i, q in known) / len(known) > 0.9
    texts = {r.doc_id: grams(r.text) for r in tables[1][0].collect() if WORD.search(r.text or "")}
    alive = {r.doc_id for r in tables[1][1].collect()}
    close = {i: {j for j in texts if len(texts[i] & texts[j]) >= 0.8 * len(texts[i] | texts[j])} for i in texts}
    assert all(len(close[i] & alive) <= 1 for i in alive if i in texts)
    todo = set(texts)
    while todo:  # one of each connected class
        group, edge = set(), {todo.pop()}
        while edge:
            group |= edge
            edge = {j for i in edge for j in close[i]} - group
        todo -= group
        assert alive & group == {min(group)}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in tables[2])
    leaks = {i for i, t in before.items() if any(x in t for x in items)}
    assert leaks and not leaks & set(after)
    assert len(before) - len(after) <= len(leaks) + 2
    assert tables[4][1].count() == tables[4][0].count()


def test_run(spark):
    out = C.run(spark, SF)
    assert out.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
