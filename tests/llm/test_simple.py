"""Sharding, mixing, licences and token files."""

import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollmill.llm import licence_texts, licences, mixing, sharding, tokenfiles

P = pytest.importorskip("public_tokenizers")


@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
@settings(max_examples=40, deadline=None)
def test_feistel_permutes_and_inverts(n, seed):
    f = sharding.Feistel(n, seed)
    rows = np.arange(n)
    places = f.place(rows)
    assert sorted(places) == list(rows)
    assert (f.row(places) == rows).all()


def check_shards(got, rows, n):
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(n)) and (len(rows) < n or max(counts.values()) - min(counts[s] for s in range(n)) <= 1)
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_shards(spark, make, odd):
    rows = odd + [(100 + i, f"text {i}") for i in range(150)]
    got = sharding.assign_shards(make(rows), 16).collect()
    check_shards(got, rows, 16)
    again = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.assign_shards(make(rows, 7), 16).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in got}  # whatever the partitions
    by_place = {(r.shard, r.slot): r.row_number for r in got}
    assert all(sharding.row_at(len(rows), s, t) == n for (s, t), n in by_place.items())


def test_shards_of_nothing(make):
    assert sharding.assign_shards(make([])).collect() == []


def test_written_shards_keep_their_slots(spark, make, tmp_path):
    out = sharding.assign_shards(make([(i, f"t{i}") for i in range(40)]), 4, payload=("text",))
    sharding.write_shards(out, str(tmp_path / "s"), slots_per_file=5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40 and back.where("shard = 2 and slot = 7").count() == 1


def naive_alpha(tokens, budget, share, limit):
    from math import log

    def stats(a):
        w = {s: n**a for s, n in tokens.items() if n}
        z = sum(w.values())
        p = {s: x / z for s, x in w.items()}
        return -sum(x * log(x) for x in p.values()), max(x * budget / tokens[s] for s, x in p.items())

    def search(good):
        if good(stats(0)):
            return 0.0
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if good(stats(mid)) else (mid, hi)
        return hi

    n = sum(1 for x in tokens.values() if x)
    return max(search(lambda m: m[0] <= share * log(n)) if share is not None and n > 1 else 0.0, search(lambda m: m[1] <= limit) if limit is not None else 0.0)


@pytest.mark.parametrize(("share", "limit"), [(0.8, None), (None, 1.5), (0.9, 2.0)])
def test_mixing_meets_its_targets(make, words, share, limit):
    rows = [(i, words(i, 20 + i % 7), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(400)] + [(1000 + i, None, "en", None) for i in range(3)] + [(2000, "of null source", "en", None)]
    got = mixing.draw(make(rows), entropy_share=share, max_repetition=limit).collect()
    assert len(got) == len(rows)
    tokens, drawn, size = Counter(), Counter(), {}
    for r in got:
        tokens[r.source] += r.n_tokens
        drawn[r.source] += r.n_tokens * r.copies
        size[r.source] = max(size.get(r.source, 0), r.n_tokens)
    budget = sum(tokens.values())
    alpha = naive_alpha(tokens, budget, share, limit)
    assert all(abs(r.alpha - alpha) < 1e-6 for r in got)
    z = sum(n**alpha for n in tokens.values())
    for s, n in tokens.items():
        quota = n**alpha / z * budget
        assert quota - size[s] - 2 <= drawn[s] <= quota + 1
    for s in tokens:
        copies = {r.copies for r in got if r.source == s and r.n_tokens}
        assert max(copies) - min(copies) <= 1
    again = {(r.doc_id, r.copies) for r in mixing.draw(make(rows, 6), entropy_share=share, max_repetition=limit).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_exponents_beyond_one_and_targets_out_of_reach(make, words):
    rows = [(i, words(i, 10 + i % 3), "en", "abcd"[min(3, i % 5)]) for i in range(300)]
    sharp = mixing.draw(make(rows), entropy_share=0.7, max_repetition=None, budget_share=1.5).collect()
    assert sharp[0].alpha > 1 and all(r.on_target and abs(r.entropy_share - 0.7) < 1e-4 for r in sharp)
    assert {r.copies for r in sharp} >= {0, 1, 3}
    held = mixing.draw(make(rows), entropy_share=0.7, max_repetition=2.0, budget_share=1.5).collect()
    assert 1 < held[0].alpha < sharp[0].alpha and abs(held[0].repetition - 2) < 1e-3 and not held[0].on_target
    never = mixing.draw(make(rows), entropy_share=0.9, max_repetition=2.0, budget_share=2.5).collect()
    assert never[0].alpha == 1 and not never[0].on_target
    even = mixing.draw(make([(i, "two words", "en", "ab"[i % 2]) for i in range(10)]), entropy_share=0.5).collect()
    assert even[0].alpha == 1 and even[0].entropy_share == 1 and not even[0].on_target


def test_exponents_by_jobs_are_those_of_the_driver(spark):
    counts = [5, 70, 300, 4100]
    table = spark.createDataFrame([(n,) for n in counts], "n_tokens long")
    for share, limit in [(0.9, None), (0.3, 4.0), (None, 1.5)]:
        a = mixing.temperature(mixing.measured(np.array(counts, float), 4475.0), 4, share, limit)
        b = mixing.temperature(mixing.measured_by_job(table, 4475.0), 4, share, limit, mixing.CUTS)
        assert a[3] == b[3] and np.allclose(a[:3], b[:3], atol=1e-5)


def test_blocks_are_permuted(spark):
    for turn in ("7|1|a", "7|2|a"):
        places = [r[0] for r in spark.range(mixing.BLOCKS).select(mixing.block_place(mixing.F.col("id"), mixing.F.lit(turn))).collect()]
        assert sorted(places) == list(range(mixing.BLOCKS)) and places != sorted(places)


def test_mixed_rows_are_the_drawn_ones(make, odd):
    docs = make(odd)
    drawn = mixing.draw(docs, max_repetition=2.0)
    out = mixing.mix(docs, max_repetition=2.0)
    assert out.columns == docs.columns
    want = Counter()
    for r in drawn.collect():
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +want
    assert mixing.mix(make([])).count() == 0


def test_licences_in_disguise(make):
    mit = licence_texts.TEXTS["MIT"]
    british = "Copyright (c) 2024 Somebody\n\nAll rights reserved.\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENSE").replace('"', "“").replace("\n", "\n   ")
    rows = [(1, mit), (2, british), (3, mit + " and more"), (4, None), (5, ""), (6, licence_texts.TEXTS["ISC"]), (6, licence_texts.TEXTS["ISC"]), (7, "Copyright 2020 X\n" * 3)]
    got = sorted(((r.doc_id, r.licence_id) for r in licences.scan_licences(make(rows)).collect()), key=repr)
    assert got == sorted([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "ISC"), (6, "ISC"), (7, None)], key=repr)
    assert licences.scan_licences(make([])).count() == 0


def test_licences_with_title_and_copyright_lines(make):
    heads = {
        "MIT": ["MIT License\n\nCopyright (c) 2020 X\n\n", "The MIT License (MIT)\r\nCopyright The Authors\r\n\r\n", "# The MIT License\n\nCopyright by X\nCopyright Joyent, Inc. and other Node contributors.\n"],
        "MIT-0": ["MIT No Attribution\n\nCopyright 2020 X\n\n"],
        "BSD-2-Clause": ["BSD 2-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n", 'BSD 2-Clause "Simplified" License\n'],
        "BSD-3-Clause": ["BSD 3-Clause License\n\nCopyright (c) 2020, X\n\n", 'BSD 3-Clause "New" or "Revised" License\n'],
        "ISC": ["ISC License\n\nCopyright (c) X\n\n", "The ISC License\n"],
        "0BSD": ["BSD Zero Clause License\n\nCopyright (c) 2020 X\n\n", "Zero-Clause BSD\n=============\n"],
        "Zlib": ["zlib License\n\n(C) 2020 X\n\n"],
    }
    rows = [(f"{k}", h + licence_texts.TEXTS[k]) for k, hs in heads.items() for h in hs]
    rows += [(None, "MIT License\n\nCopyright (c) 2020 X\n"), (None, "MIT License applies here\n" + licence_texts.TEXTS["MIT"]), (None, "The MIT License (MIT)\n" + licence_texts.TEXTS["MIT"] + "more")]
    got = {r.doc_id: r.licence_id for r in licences.scan_licences(make([(i, t) for i, (_, t) in enumerate(rows)])).collect()}
    assert [got[i] for i in range(len(rows))] == [k for k, _ in rows]


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no published texts here")
def test_published_licences(make):
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    texts = [open(f"/usr/share/common-licenses/{v}", encoding="utf-8").read() for v in files.values()]
    texts.append(texts[0].replace("[yyyy] [name of copyright owner]", "2020 X"))
    got = {r.doc_id: r.licence_id for r in licences.scan_licences(make(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == [*files, "Apache-2.0"]


def test_licence_sql_agrees(spark, make, odd, tmp_path):
    import duckdb

    rows = [(i, r[1]) for i, r in enumerate(odd)] + [(50, licence_texts.TEXTS["Zlib"]), (51, "Licence © 2020 — “Organisation”\n(c) 1999 me\nend")]
    heads = ["MIT License\n\nCopyright (c) 2020 X\n\n", "The MIT License (MIT)\r\nCopyright The Authors\r\n\r\n", "# The MIT License\n\nCopyright by X\n", "MIT License applies here\n", "\x0b\n/* Copyright 2020 */\n"]
    rows += [(60 + i, h + licence_texts.TEXTS["MIT"]) for i, h in enumerate(heads)] + [(70, "Copyright 2020 X\n" * 3), (80, "Plain “text”, 12\n"), (81, "the mit licence\nPLAIN text 12")]
    make(rows).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted(con.sql(licences.scan_sql()).fetchall(), key=repr)
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert sorted(map(tuple, licences.scan_licences(docs).collect()), key=repr) == want
    assert [r[2] for r in want if 60 <= (r[0] or 0) < 70].count("MIT") == 4
    want = sorted(con.sql(licences.disguised_sql()).fetchall(), key=repr)
    assert sorted(map(tuple, licences.scan_licences(docs, licences.disguised(docs)).collect()), key=repr) == want
    assert {r[0]: r[2] for r in want}[81] == "80"


def test_token_files_round_trip(spark, make, odd, tmp_path):
    path = P.path("word_bpe_49k.json")
    rows = odd + [(20, "A b\x0bc <|endoftext|> d"), (21, "\x01 DON'T Don't ΑΣ é́"), (22, "x" * 5000)]
    folder = str(tmp_path / "t")
    manifest = tokenfiles.write_token_files(make(rows), folder, path, length=64)
    got = sorted(tokenfiles.read_documents(manifest, folder).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    encoded = sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in rows)
    at = 0
    for r, (doc_id, text) in zip(got, sorted(encoded), strict=True):
        assert (-1 if r.doc_id is None else r.doc_id) == doc_id
        assert r.start == at
        at += r.n_tokens
    want = Counter()
    for doc_id, text in encoded:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    shard = max(manifest.collect(), key=lambda r: r.n_sequences)
    ids, mask = tokenfiles.sequence(folder, shard.ids_file, shard.n_sequences - 1)
    assert len(ids) == len(mask) == 64 and mask.sum() == shard.n_tokens - 64 * (shard.n_sequences - 1) and not ids[~mask].any()
    reader = pa.ipc.open_file(pa.memory_map(f"{folder}/{shard.ids_file}"))
    assert pa.types.is_fixed_size_list(reader.schema.field("ids").type)


def test_token_files_of_nothing(make, tmp_path):
    assert tokenfiles.token_table(make([]), P.path("word_bpe_49k.json"), lambda: str(tmp_path / "e")).count() == 0


def test_many_sources_are_drawn_alike(make, words, monkeypatch):
    rows = [(i, words(i, 10 + i % 5), "en", f"s{i % 6}") for i in range(120)] + [(500, "x", "en", None)]
    few = {(r.doc_id, r.copies) for r in mixing.draw(make(rows), max_repetition=1.2).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert {(r.doc_id, r.copies) for r in mixing.draw(make(rows), max_repetition=1.2).collect()} == few
