import itertools
import random

import numpy as np
import pytest
import xxhash
from papyra.llm import components as C
from papyra.llm import simhash as S
from papyra.llm.queries import op3_simhash
from pyspark.sql import functions as F


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_components(prints):
    """The smallest id reachable over links of at most 4 bits; prints: id -> number."""
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_every_pattern_of_four_bits_shares_a_key():
    rng, keys = np.random.default_rng(3), S.GolayKeys()
    a = rng.integers(-(2**63), 2**63 - 1, 20_000)
    flips = np.zeros(len(a), np.uint64)
    for i in range(len(a)):
        for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            flips[i] |= np.uint64(1 << int(bit))
    b = (a.view(np.uint64) ^ flips).view(np.int64)
    shared = set(zip(*map(np.ndarray.tolist, keys(a)))) & set(zip(*map(np.ndarray.tolist, keys(b))))
    assert {row for _, row in shared} == set(range(len(a)))


def test_golay_keys_are_one_or_six():
    table, count = S._patterns()
    assert sorted(np.unique(count)) == [1, 6] and (np.bitwise_count(table) <= 4).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_like_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    prints = {i: slow_print(t) for i, t in texts.items()}
    want = slow_components(prints)
    rows = op3_simhash(spark, path).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        i: (f"{p:016x}", want[i]) for i, p in prints.items()
    }
    assert len(rows) == len(texts)


def test_split_keys_lose_no_link(spark):
    """A dense cloud of fingerprints, in blocks so small that every key is split."""
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    prints = {centre}
    while len(prints) < 400:
        p = centre
        for b in rnd.sample(range(64), rnd.randint(1, 6)):
            p ^= 1 << b
        prints.add(p)
    prints |= {rnd.getrandbits(64) for _ in range(200)}
    numbers = dict(enumerate(sorted(prints)))
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in numbers.items()}
    df = spark.createDataFrame([(p,) for p in signed.values()], "print long")
    links = S.links_between(df, block=16)
    roots = {r["node"]: r["root"] for r in C.components(links).collect()}
    want = slow_components(numbers)
    groups = {}
    for i, p in signed.items():
        groups.setdefault(roots.get(p, p), set()).add(i)
    expected = {}
    for i, c in want.items():
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_keys_are_not_broadcast(spark):
    """Spark estimates about one key a fingerprint; by that all keys would pass through the driver."""
    links = S.links_between(spark.range(2000).select(F.xxhash64("id").alias("print")))
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("limit", [10**6, 0])
def test_components_both_ways(spark, limit):
    rnd = random.Random(limit)
    links = [(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, 1000 + i) for i in range(1, 80)]
    links += [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(150)]
    rnd.shuffle(links)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links + links[:20], "a long, b long").repartition(7)
    got = [(r["node"], r["root"]) for r in C.components(df, one_task_links=limit).collect()]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert len(got) == len(set(got)) and dict(got) == {x: find(x) for x in nodes}


def test_odd_rows(odd, none):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    assert by[1]["print"] == by[2]["print"] == by[3]["print"] == 0
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[4]["component_id"] == by[5]["component_id"] == 4
    assert by[None]["component_id"] is None
    assert S.near_duplicates(none).count() == 0
