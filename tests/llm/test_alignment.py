"""Alignment of two tokenizers against brute force over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rollmill.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    code = alignment.Aligner(A, B)
    linked, out = [], []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text, num_threads=1) if text else []
        if b"".join(code.bytes_a[i] for i in x) != whole or b"".join(code.bytes_b[i] for i in y) != whole:
            x = y = []
        ends = [np.cumsum([0] + [len(t[i]) for i in ids]).tolist() for t, ids in ((code.bytes_a, x), (code.bytes_b, y))]
        pairs, j = [], 0
        for i in range(len(x)):
            while j and ends[1][j] > ends[0][i]:
                j -= 1
            while j < len(y) and ends[1][j] < ends[0][i + 1]:
                if ends[1][j + 1] > ends[0][i]:
                    pairs.append((x[i], y[j]))
                j += 1
        groups = []
        both = sorted(set(ends[0][1:]) & set(ends[1][1:]))
        for low, high in zip([0, *both], both, strict=False):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, at[1:], strict=True) if low < e <= high) for ids, at in ((x, ends[0]), (y, ends[1]))))
        linked.append(pairs)
        out.append([len(x), len(y), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""])
    counts = Counter(p for pairs in linked for p in pairs)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((i, *o[:4], sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), o[4]) for (i, _), o, pairs in zip(rows, out, linked, strict=True)), key=str)


ODD = ["", None, " ", "  ", "a  b", " lead", "tail ", "tail \n", "x\t\ty", "<|endoftext|> mid <|endoftext|>", "<s>hi</s> <unk> <0x41>", "a▁b stays out", "é é", "　z 　 q", "a\r\nb \x00 c", "it's we'll I'M 'tis", "n b   x", "\x1c \x1f a", "中文没有空格的句子", "😀 👩‍👩‍👧 ok", "9 99 999 3.14", "\u0085 a", "end  next"]


@pytest.mark.parametrize("partitions", [1, 3])
def test_rows(spark, make, words, odd, partitions):
    rng = random.Random(5)
    pool = ["the", "of", "Thtionoues", "erreoror", "naïve", "straße,", "don't", "x=1;", "\n", "\t", "", "été.", "übermäßig", "a-b", " ", "(the)", "THE", " "]
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 80)))) for k in range(60)] + [(r[0], r[1]) for r in odd] + [(300 + k, "hot text the of the") for k in range(50)]
    got = alignment.align(make(rows, partitions), A, B, slot_postings=50, chunk_rows=16)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_blocks_and_hot_ids(spark, make, monkeypatch):
    """A text of many blocks of links, and an id that stands in most postings, dealt over several slots."""
    rng = random.Random(6)
    rows = [(1, " ".join(rng.choice(["the", "then", "there", "q"]) for _ in range(3000)))] + [(k, "the the the " + rng.choice(["a", "b", "cc"])) for k in range(2, 200)]
    code = alignment.Aligner(A, B)
    assert code.cuts
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 50)
    small = alignment.align_chunk(code, 7, [r[0] for r in rows], [r[1] for r in rows])
    monkeypatch.undo()
    assert small.equals(alignment.align_chunk(code, 7, [r[0] for r in rows], [r[1] for r in rows]))
    got = alignment.align(make(rows), A, B, slot_postings=10, chunk_rows=8)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_no_rows(spark, make):
    assert alignment.align(make([]), A, B).collect() == []
    assert [tuple(r) for r in alignment.align(make([(None, None), (3, "")]), A, B).orderBy("doc_id").collect()] == [(None, 0, 0, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, 0, 0, "")]
