"""SimHash against brute force, shards, winnowing."""

import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from odd_docs import make_docs, odd_rows  # noqa: F401

from veritrace.llm import sharding, simhash, winnowing


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    values = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(keys, linked):
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(keys))]


def test_trie_join_finds_the_components_of_all_pairs():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(40)})
    want = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    clusters = simhash.Clusters(len(values))
    for i, j in simhash.block_links(np.array(values, dtype=np.uint64), 3):
        assert (values[i] ^ values[j]).bit_count() <= 3 and clusters.join(i, j)
    assert [clusters.root(i) for i in range(len(values))] == want


def test_components_of_rows(spark, make_docs, odd_rows, monkeypatch):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    rows = odd_rows + [(1000 + 10 * i + k, t if k < 3 else t.replace("v1 ", "v2 ", 1)) for i, t in enumerate(base) for k in range(6)]
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    members = defaultdict(list)
    for r, (i, _) in zip(roots, rows):
        members[r].append(i)
    want = Counter((str(i), p, str(min(members[r], key=lambda x: (x is not None, x)))) for (i, _), p, r in zip(rows, prints, roots))
    for limit in (8192, 3):  # the second splits blocks again and again
        monkeypatch.setattr(simhash, "BLOCK_ROWS", limit)
        found = simhash.near_components(simhash.fingerprints(make_docs(rows), size=3), budget=3).collect()
        assert Counter((str(r._id), r.fp % 2**64, str(r.first._id)) for r in found) == want


def test_one_of_each_near_group_stays(spark, make_docs, odd_rows):
    rng = random.Random(2)
    words = [f"u{i}" for i in range(2000)]
    base = [rng.choices(words, k=900) for _ in range(10)]
    rows = odd_rows + [(100 + i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(150 + 10 * i + k, " ".join(w[:300 * k] + ["changed"] + w[300 * k:])) for i, w in enumerate(base) for k in range(4)]
    prints = [plain_fingerprint(t) for _, t in rows]
    members = defaultdict(list)
    for root, row in zip(plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3), rows):
        members[root].append(row[0])
    want = sorted((min(m, key=lambda x: (x is not None, x)) for m in members.values()), key=str)
    assert len(want) < len(rows) - 20
    own = ["_sig", "_row", "_kept_id", "_kept_sig", "_key", "_whole", "sig", "fp", "node", "first", "root", "key"]  # names used inside
    docs = make_docs(rows).select("*", *[simhash.F.lit(c).alias(c) for c in own])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.doc_id for r in got), key=str) == want and all(r[c] == c for r in got for c in own)
    assert simhash.keep_one(make_docs([])).count() == 0


def test_a_family_of_near_copies_is_dealt_in_pairs_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 64)
    rng = random.Random(4)
    base = rng.getrandbits(63)
    rows = [(i, base ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60))) for i in range(640)]  # ten blocks full
    keys = [simhash.F.lit(k).cast("long") for k in range(4)]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    found = simhash.dealt(nodes, keys)
    assert found.count() == 640 * 4 * 19
    together = found.select("key", "node").distinct().groupBy("key").agg(simhash.F.collect_list("node").alias("n")).collect()
    assert {(a, b) for r in together for a in r.n for b in r.n if a < b} == {(a, b) for a in range(640) for b in range(a + 1, 640)}
    links = simhash.near_links(nodes, 4).collect()
    assert len({x for r in links for x in (r.a, r.b)}) == 640


def test_many_equal_fingerprints_are_compared_in_small_leaves():
    values = np.zeros(1000, dtype=np.uint64)
    ranges = list(simhash.node_pairs(values, 3))
    assert max((b - a) * (d - c) for a, b, c, d in ranges) <= simhash.LEAF_PAIRS
    assert sum((b - a) * (b - a - 1) // 2 if a == c else (b - a) * (d - c) for a, b, c, d in ranges) == 1000 * 999 // 2


def test_shards_keep_groups_and_are_as_even_as_can_be(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, f"text {i} " * (i % 7 + 1)) for i in range(300)] + [(1000 + i, "copy of a common text") for i in range(900)]
    found = sharding.shard(make_docs(rows), 10).collect()
    assert len(found) == len(rows)
    slots, sizes, groups = defaultdict(list), Counter(), defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        groups[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    giants = [s for s in sizes.values() if s > 30_000]
    assert len(giants) >= 1 and max(slots) <= 9
    assert sharding.shard(make_docs([]), 10).count() == 0


def test_capacity_is_the_smallest(spark):
    rng = random.Random(3)
    sizes = [rng.randrange(1, 50) for _ in range(60)]
    plan = sharding.minimax_cuts(spark.createDataFrame(list(enumerate(sizes)), "bucket int, size long"), 7).collect()
    totals = Counter()
    for r in plan:
        totals[r.shard] += sizes[r.bucket]

    def shards(capacity):
        n, fill = 1, 0
        for s in sizes:
            n, fill = (n + 1, s) if fill + s > capacity else (n, fill + s)
        return n
    assert max(totals.values()) == next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= 7)


def plain_picks(hashes):
    w = winnowing.WINDOW
    if len(hashes) <= w:
        windows = [range(len(hashes))] if hashes else []
    else:
        windows = [range(i, i + w) for i in range(len(hashes) - w + 1)]
    return list(dict.fromkeys(min(r, key=lambda p: (hashes[p], -p)) for r in windows))


def test_picks_are_the_rightmost_least_of_each_window(spark, make_docs):
    text = "a b c d e " * 12 + "f g h i j k l m n o p q r s t u v w x y z"
    row = winnowing.with_picks(make_docs([(1, text)]).select("text"), "text", "picks")
    grams = spark.createDataFrame([(" ".join(text.split()[i:i + 5]),) for i in range(len(text.split()) - 4)], "g string")
    hashed = [r[0] for r in grams.selectExpr(
        "shiftrightunsigned(xxhash64(transform(split(g, ' '), w -> xxhash64(w))), 33)").collect()]
    picks = row.first().picks
    assert [2**31 - 1 - (p & 2**31 - 1) - 1 for p in picks] == plain_picks(hashed)
    assert [p >> 31 for p in picks] == [hashed[i] for i in plain_picks(hashed)]


def test_edited_texts_follow_the_next_document(make_docs, odd_rows):
    rows = [(i, t) for i, t in dict(odd_rows).items() if i is not None] + [(50 + i, f"word{i} " * 30) for i in range(400)]
    found = {r.doc_id: r for r in winnowing.edited_likeness(make_docs(rows).repartition(5)).collect()}
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts)
    for i, after in zip(ids, ids[1:] + ids[:1]):
        half = len(texts[i]) // 2
        assert found[i].edited == texts[i][:len(texts[i]) - half] + texts[after][:half]
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
    assert winnowing.edited_likeness(make_docs([])).count() == 0
    assert winnowing.edited_likeness(make_docs([(None, "a b"), (None, "c")])).count() == 2
