"""Packing, counts and BPE against the tokenizers library."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from odd_docs import make_docs, odd_rows  # noqa: F401
from tokenizers import Tokenizer

from veritrace.llm import bpe, packing, token_counts
from veritrace.llm.tokens import NOT_SAFE, encoder
from veritrace.session import new_folder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def test_fast_encoder_takes_only_characters_that_both_split_alike(library):
    enc = encoder(BYTE)
    assert enc.fast is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not NOT_SAFE.search(chr(c))][::7]
    texts = [f"a{chr(c)}b1{chr(c)}2!{chr(c)} {chr(c)}  {chr(c)}" for c in points]
    assert [enc.ids(t).tolist() for t in texts] == [e.ids for e in library[BYTE].encode_batch(texts, add_special_tokens=False)]


def test_packing_keeps_every_id_once_and_pads_nothing(make_docs, odd_rows, library):
    pieces = packing.pack(make_docs(odd_rows).repartition(3), BYTE).collect()
    want = Counter()
    ids = defaultdict(list)
    for i, t in odd_rows:
        ids[i].append(np.array([*library[BYTE].encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
        want[i] += len(ids[i][-1])
    got, sequences = Counter(), defaultdict(list)
    for p in pieces:
        got[p.doc_id] += p.length
        assert any(len(a) == p.doc_tokens and a[p.start:p.start + p.length].tobytes() == bytes(p.ids) for a in ids[p.doc_id])
        sequences[p.sequence_id].append((p.offset, p.length))
    assert got == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024 and end & (end - 1) == 0


def test_tiers_fill_gaps_from_shorter_ones():
    packer = packing.TierPacker((1024, 512, 256, 128))
    for number, length in enumerate((1000, 600, 24, 300, 124, 500, 12)):
        packer.add((number, 0, length))
    windows = list(packer.pack()) + list(packer.flush())
    assert [sum(p[2] for p in pieces) for _, pieces in windows] == [size for size, _ in windows]
    assert sum(size for size, _ in windows) == 2560


def test_counts_come_from_the_cache_the_second_time(spark, make_docs, odd_rows, library):
    cache = new_folder(spark, "cache")
    want = sorted((str(i), len((t or "").encode()), len(library[BYTE].encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows)
    for _ in range(2):
        got = token_counts.token_counts(make_docs(odd_rows), BYTE, cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in odd_rows}) == stored.select("digest").distinct().count()
    assert token_counts.token_counts(make_docs([]), BYTE, cache).count() == 0


def test_bpe_equals_the_library(make_docs, odd_rows, library):
    texts = odd_rows + [(100 + i, w) for i, w in enumerate(("aaaa aaaaa", "It's we'll I'D", "x  y\u00a0z", "İstanbul ﬁ e\u0301", "hello<|endoftext|>"))]
    rows = bpe.decode(bpe.encode(make_docs(texts), WORD), WORD).collect()
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in rows)
    assert got == sorted((str(i), e := library[WORD].encode(t or "", add_special_tokens=False).ids,
                          library[WORD].decode(e, skip_special_tokens=False)) for i, t in texts)
    assert bpe.encode(make_docs([]), WORD).count() == 0
