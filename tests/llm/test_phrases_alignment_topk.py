"""Collocations, token alignment and top-k search against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from odd_docs import make_docs, odd_rows  # noqa: F401
from pyspark.sql import types as T
from tokenizers import Tokenizer

from veritrace.llm import alignment, collocations, topk
from veritrace.llm.tokens import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, least, top, share):
    freq, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            freq[lang].update(tuple(words[i:i + m]) for i in range(len(words)) for m in range(1, 6) if i + m <= len(words))
    out = []
    for lang, counts in freq.items():
        often = {p: f for p, f in counts.items() if f >= least}
        inside = defaultdict(int)
        for p, f in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], f)
        scored = []
        for p, a in often.items():
            if len(p) > 1 and not (p in inside and 100 * inside[p] >= share * a):
                score, _, left, right = min((1000 * a * n[lang] // (often[p[:k]] * often[p[k:]]), k, often[p[:k]], often[p[k:]])
                                            for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("share", [100, 60])
def test_collocations_equal_plain_counts(spark, monkeypatch, share):
    monkeypatch.setattr(collocations, "FLUSH_BYTES", 3000)  # many summaries, and texts cut into several
    monkeypatch.setattr(collocations, "COUNTERS", 64)
    rng = random.Random(3)
    words = ["New", "york", "Straße", "ÉÀ", "x", "日本", "city", "of", "the", "\U0001f600"] + [f"rare{i}" for i in range(3000)]
    rows = []
    for i in range(120):
        body = [rng.choice(words[:10]) if rng.random() < 0.5 else rng.choice(words) for _ in range(120)]
        rows.append((rng.choice(["en", "de", None]), re.sub("city ", "city. ", " ".join(body)) + "\tnew  york\x0cNEW york city of the"))
    rows += [("en", None), (None, ""), ("en", " \t\n"), ("de", "!!..,"), *[("hot", "same words again and again here")] * 300]
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("text", T.StringType()), T.StructField("phrase", T.IntegerType())])
    docs = spark.createDataFrame([(*r, 1) for r in rows], schema).repartition(5)
    got = collocations.collocations(docs, min_count=12, top=40, share=share)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 12, 40, share)
    assert collocations.collocations(docs.limit(0), min_count=12).count() == 0


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(0)
    keys = np.concatenate([rng.integers(0, 2**63, 60_000), np.repeat(rng.integers(0, 2**63, 30), 60)]).astype(np.uint64)
    rng.shuffle(keys)
    summary = collocations.Summary(len(keys) // 60 + 1)
    for part in np.array_split(keys, 40):
        summary.add(*np.unique(part, return_counts=True))
        summary.merge()
    values, counts = np.unique(keys, return_counts=True)
    assert summary.cut > 0 and len(summary.keys) <= summary.capacity
    assert set(values[counts >= 60]) <= set(summary.survivors(60))


def plain_alignment(rows):
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    alphabet = byte_alphabet()
    per_row, counts = [], Counter()
    for i, text in rows:
        links, groups, n_a, n_b = [], "", 0, 0
        if text:
            a = [(k, bytes(alphabet[c] for c in a_lib.id_to_token(k))) for k in a_lib.encode(" " + text, add_special_tokens=False).ids]
            b = [(k, bytes([int(b_lib.id_to_piece(k)[3:5], 16)]) if b_lib.is_byte(k) else b_lib.id_to_piece(k).replace("▁", " ").encode())
                 for k in b_lib.encode(text)]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                n_a, n_b = len(a), len(b)
                spans = []
                for side in (a, b):
                    at, out = 0, []
                    for k, x in side:
                        out.append((at, at + len(x), k))
                        at += len(x)
                    spans.append(out)
                links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
                cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
                parts = []
                for lo, hi in zip([0, *cuts], cuts):
                    parts.append("|".join(",".join(str(x[2]) for x in side if lo <= x[0] < hi) for side in spans))
                groups = ";".join(parts)
        counts.update(links)
        per_row.append((i, n_a, n_b, groups.count(";") + 1 if groups else 0, links, groups))
    best = Counter()
    for (_, b_id), n in counts.items():
        best[b_id] = max(best[b_id], n)
    return sorted((str(i), n_a, n_b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                   hashlib.sha256(t.encode()).hexdigest() if t else "") for i, n_a, n_b, g, links, t in per_row)


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_alignment_equals_all_pairs_of_spans(make_docs, odd_rows, monkeypatch, size):
    monkeypatch.setattr(alignment, "SLICE_BYTES", size)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 4 * size)
    rows = [r for r in odd_rows if len(r[1] or "") < 5000] + [
        (50, "a▁b"), (51, "<s> </s> <unk> <0x0A> <|endoftext|>"), (52, "tab\there\r\nnul\x00end"), (53, "  two  blanks  "),
        (54, "é ﬁ ½ ​﻿"), *[(60 + i, f"the cat sat on the mat number {i} unbelievably") for i in range(40)]]
    got = alignment.align(make_docs(rows).repartition(3), A, B).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_alignment(rows)
    assert alignment.align(make_docs([]), A, B).count() == 0


VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("score", T.StringType()), T.StructField("id", T.IntegerType())])


def plain_top(rows, every, k):
    rows = list(dict.fromkeys((i, tuple(int(np.floor(1024 * x)) for x in v)) for i, v in rows
                              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)))
    best = defaultdict(list)
    for i, v in rows:
        if i % every == 0:
            for j, w in rows:
                if j != i and len(v) == len(w):
                    best[i].append((-sum(a * b for a, b in zip(v, w)), j))
    return sorted((i, rank, j, -s) for i, found in best.items() for rank, (s, j) in enumerate(sorted(found)[:k], 1))


@pytest.mark.parametrize("tiles", [(16_384, 1 << 20), (7, 90)])
def test_top_k_equals_all_products(spark, monkeypatch, tiles):
    monkeypatch.setattr(topk, "TILE_QUERIES", tiles[0])
    monkeypatch.setattr(topk, "TILE_ROWS", tiles[1])
    monkeypatch.setattr(topk, "CHUNK", 64)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 20))
    rows = [(i, (centers[i % 6] + 0.2 * rng.normal(size=20)).tolist()) for i in range(500)]
    rows += [(1000 + i, [0.5] * 20) for i in range(150)] + [rows[0]] * 3 + [(10, [0.25] * 20)]  # ties, repeats, an id with two vectors
    rows += [(None, [1.0] * 20), (2000, None), (2010, [1.0, None]), (2020, [float("nan")] * 20), (2030, [float("inf")] * 20)]
    rows += [(3000, []), (3001, []), (3010, [1.0, 2.0]), (3011, [-1.0, 1e6]), (3020, [3e5, 4e5, 5.0]), (3021, [2e5, 1e5, 1.0])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], VECTORS).repartition(4)
    got = topk.top_k(df, every=10, k=5).collect()
    assert sorted(tuple(r) for r in got) == plain_top(rows, 10, 5)
    assert topk.top_k(df.limit(0), every=10, k=5).count() == 0


def test_scores_beyond_floats_and_longs_are_exact():
    for peak in (2**24, 2**28, 2**45):
        rng = np.random.default_rng(5)
        vectors, ids = rng.integers(-peak, peak, (80, 6)), np.arange(80)
        search = topk.Search(ids[:9], vectors[:9], 4)
        for at in range(0, 80, 16):
            search.feed(ids[at:at + 16], vectors[at:at + 16])
        want = []
        for i in range(9):
            found = sorted((-sum(int(x) * int(y) for x, y in zip(vectors[i], vectors[j])), j) for j in range(80) if j != i)
            want += [(i, j, min(max(-s, -2**63), 2**63 - 1)) for s, j in found[:4]]
        assert list(search.best()) == want
