import itertools
import random

import corpus_pipeline
import numpy as np
from papyra.llm import components as C
from papyra.llm import overlap as O
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def slow_set(text):
    w = O.space_words((text or "").encode())
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def slow_kept(texts):
    """The ids that stay: the smallest of each component over pairs of similarity 0.8; texts: id -> text."""
    sets = {i: slow_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        one, two = sets[a], sets[b]
        if one == two or min(len(one), len(two)) >= 0.8 * max(len(one), len(two)) and (
            len(one & two) >= 0.8 * len(one | two) - 1e-9
        ):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_near_dedup_stage_leaves_no_pair_of_similarity_08(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert got == slow_kept(texts)


def test_copies_with_few_changed_words_are_one_group_in_any_blocks(spark):
    words = [f"w{k}" for k in range(300)]
    texts = {i: " ".join(w if (k + 7 * i) % 97 else f"x{i}" for k, w in enumerate(words)) for i in range(40)}
    texts |= {100 + i: " ".join(f"u{i}v{k}" for k in range(50)) for i in range(20)} | {200: "", 201: " ", 202: "one", 203: "One"}
    want = slow_kept(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in O.one_of_each(docs).collect()} == want
    described = {i: [x[0] for x in O._describe(5)([t.encode()])] for i, t in texts.items()}
    rows = [tuple(d) for d in {d[0]: d for d in described.values()}.values()]
    frame = spark.createDataFrame(rows, "node long, print long, bands array<long>, n long")
    held = [(described[i][0], np.unique(O.shingle_hashes(t.encode())).tobytes()) for i, t in texts.items()]
    held = spark.createDataFrame(list(dict(held).items()), "node long, set binary")
    for block in (4 * 300 * 8, O.BLOCK_BYTES):
        links = O.links_by_overlap(frame, lambda wanted: held.join(wanted, "node"), block=block)
        roots = {r["node"]: r["root"] for r in C.components(links).collect()}
        assert len({roots.get(r[0], r[0]) for r in rows}) == len(want)


def test_chains_are_found_through_blocks(spark):
    """A chain of texts, each near the next one only, among many that share its words: no link may be lost."""
    rnd = random.Random(1)
    texts, words = {}, [f"w{k}" for k in range(200)]
    for i in range(60):
        texts[i] = " ".join(words)
        for k in rnd.sample(range(200), 1 if i % 3 else 6):
            words[k] = f"n{i}x{k}"
    want = slow_kept(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in O.one_of_each(docs).collect()} == want and 1 < len(want) < 60


def test_similar_compares_asking_nodes_only():
    sets = [np.array(x, np.uint64).tobytes() for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4], [9])]
    nodes = [10, 11, 12, 13]
    assert O.similar(nodes, sets, [1, 2, 3, 4], [True, False, False, False], 0.8) == [(10, 11), (10, 12)]
    assert O.similar(nodes, sets, [1, 1, 3, 4], [False, False, False, True], 0.8) == []
    assert O.similar(nodes, sets, [1, 1, 3, 4], [False, False, True, False], 0.8) == [(12, 10)]


def test_odd_rows_stay_or_go_by_their_texts(spark, odd, none):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [
        (2, text, "a"), (4, text, "b"), (4, "a text of its own", "c"), (None, "no id and no copy", "d"), (None, "no id and no copy", "d"),
        (None, text, "e"), (None, "another one without id", "f"), (7, "twice the same", "g"), (7, "twice the same", "g"), (7, "twice the same", "h"),
        (9, None, "i"), (8, "", "j"), (None, " ", "k"),
    ]
    want = [(2, text), (4, "a text of its own"), (7, "twice the same"), (8, ""), (None, "another one without id"), (None, "no id and no copy")]
    for order in (rows, rows[5:][::-1] + rows[:5]):
        docs = spark.createDataFrame(order, "doc_id long, text string, k1 string").withColumn("first", F.lit(1)).repartition(3)
        kept = O.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])) == want
    stay = O.one_of_each(odd)
    assert stay.columns == odd.columns
    assert sorted((r["doc_id"] for r in stay.collect()), key=lambda i: (i is None, i)) == [1, 4, 6, 7, 8, None]
    assert O.one_of_each(none).count() == 0
    maps = spark.createDataFrame([(1, "x", {"a": 1}), (2, "x", None)], "doc_id long, text string, m map<string,int>")
    assert [r["doc_id"] for r in O.one_of_each(maps).collect()] == [1]


def test_hot_and_cold_first_nodes_are_cut_into_blocks(spark):
    """More nodes than a hot key has rows, and fewer, in blocks of a few sets: every node is linked to its first one."""
    rows, sets = [], []
    for first, n in ((0, O.LEAST_HOT + 60), (10_000, 40)):
        for i in range(n):
            own = np.unique(np.append(np.arange(first, first + 60), 1_000_000 + first + i)).astype(np.uint64)
            rows.append((first, first, first + i, len(own)))
            sets.append((first + i, bytearray(own.tobytes())))
    met = spark.createDataFrame(rows, "key long, first long, node long, n long")
    held = spark.createDataFrame(sets, "node long, set binary")
    for block in (61 * 8 * 4, O.BLOCK_BYTES):
        links = {tuple(sorted((r["a"], r["b"]))) for r in O._with_first(met, held, 0.8, block).collect()}
        assert links == {(first, node) for _, first, node, _ in rows if node != first}


def test_keys_are_not_broadcast(spark, monkeypatch):
    """Spark's estimate of the keys does not count those of a node; by it they would all pass through the driver."""
    plans = {}

    def noted(df, checkpoint=O.checkpoint):
        made = checkpoint(df)
        plans[tuple(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return made

    monkeypatch.setattr(O, "checkpoint", noted)
    corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).count()
    plan = plans["key", "node", "n", "m", "first"].split("Initial Plan")[0]
    top = plan[: plan.index("Union")]  # the join of the keys; below are those that make them
    assert "SortMergeJoin" in top and "BroadcastExchange" not in top and "BroadcastHashJoin" not in top
