"""Near copies by exact Jaccard similarity of word shingles, for the pipeline.

A text counts as the set of its five-word shingles (64-bit hashes; a shorter text is one shingle).
Texts with equal sets are one node. Candidates come from SimHash fingerprints of these shingles, which
meet through the fuzzy Golay keys of ``simhash``, and from MinHash bands: texts of similarity 0.8 mostly
differ in more fingerprint bits than the fuzzy keys can hold, while they share a band with probability
1 - (1 - 0.8^4)^20, all but about 3 in 100,000. Every candidate pair is verified by the exact similarity
of its sets; only 0.8 or more makes a link. Groups are the components over links.

What is kept of every text is small: hashes, fingerprint and bands. Sets are made only for nodes that
share a key. They are compared in two rounds, so that a large group of copies costs one comparison each:

1. every node with the smallest node of its key;
2. where the nodes of a key are not in one component by now: the nodes outside the component of the
   smallest one with all nodes of the key.

Groups of a round are cut into blocks of about ``BLOCK_BYTES`` of sets, and every pair of blocks that has
to meet is a group of its own, so a task holds little. Equal groups are compared once.

Defined results: null and empty texts, and texts of blanks only, are copies of each other. Rows that
repeat an id are judged by their texts like any other rows: different texts stay. A row without id comes
after those with one. Of one group the row with the smallest id stays, ties: with the smallest hash of
its text, then of all its columns; of rows that are equal in every column one stays. Texts of any
length are taken whole; other columns are kept, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import HOT_SHARE, LEAST_HOT, join_hot, map_rows, row_hash, space_words, text_bytes
from papyra.llm.components import components
from papyra.llm.simhash import SEED, links_between
from papyra.session import checkpoint, prepare

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Bytes of sets in one block.
BLOCK_BYTES = 8 << 20
#: Parts of the nodes of one first node where these are counted and looked up.
SALTS = 16
_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_TURN = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingle_hashes(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle in order, repeated ones as well; none for a text without words."""
    from xxhash import xxh64_intdigest as digest

    w = space_words(raw)
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < shingle:
        return np.array([digest(b" ".join(w), SEED)], np.uint64)
    join = b" ".join
    return np.array([digest(join(s), SEED) for s in zip(*[w[k:] for k in range(shingle)])], np.uint64)


def _print(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h)).view(np.int64)[0])


def _bands(h: np.ndarray) -> list[int]:
    """The key of every band; a text without words has no near copies but equal ones."""
    if not len(h):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 4096):  # bounded memory for texts of any length
        least = np.minimum(least, ((h[None, at : at + 4096] ^ _FLIP) * _TURN).min(axis=1))
    least ^= least >> np.uint64(32)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def _describe(shingle: int):
    from xxhash import xxh64_intdigest as digest

    def run(texts):
        nodes, prints, bands, sizes = [], [], [], []
        for t in texts:
            h = shingle_hashes(t, shingle)
            own = np.unique(h)
            nodes.append(int(np.uint64(digest(own.tobytes(), SEED)).view(np.int64)))
            prints.append(_print(h))
            bands.append(_bands(own))
            sizes.append(len(own))
        return nodes, prints, bands, sizes

    return run


_SKETCH = (
    T.StructType().add("node", T.LongType()).add("print", T.LongType()).add("bands", T.ArrayType(T.LongType())).add("n", T.LongType())
)


def _set_maker(shingle: int):
    return lambda texts: ([np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts],)


# --- comparing --------------------------------------------------------------------------------


def similar(nodes: list[int], sets: list[bytes], groups: list[int], asking: list[bool], similarity: float) -> list[tuple[int, int]]:
    """Links between every asking node and the nodes of other groups; groups that a link joins become one."""
    parts = [np.frombuffer(s, np.uint64) for s in sets]
    sizes = np.array([len(p) for p in parts])
    words, flat = np.unique(np.concatenate(parts), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    group = np.unique(np.array(groups), return_inverse=True)[1]
    links = []
    for at in np.flatnonzero(asking).tolist():
        if (group == group[at]).all():
            continue
        held = np.zeros(len(words), bool)
        held[flat[starts[at] : starts[at + 1]]] = True
        both = np.add.reduceat(held[flat].astype(np.int64), starts[:-1])
        near = (both >= similarity * (sizes + sizes[at] - both) - 1e-9) & (group != group[at])
        for other in np.flatnonzero(near).tolist():
            if group[other] != group[at]:
                links.append((nodes[at], nodes[other]))
                group[group == group[other]] = group[at]
    return links


def _compare(similarity: float):
    def run(batches):
        for b in batches:
            links = []
            for members in b.column(0).to_pylist():
                one = {m["node"]: m for m in members}  # a node may be there for two reasons
                for m in members:
                    one[m["node"]]["asks"] |= m["asks"]
                m = list(one.values())
                if len(m) > 1:
                    columns = ([x[c] for x in m] for c in ("node", "set", "comp", "asks"))
                    links += similar(*columns, similarity)
            a, c = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(c.copy())], names=["a", "b"])

    return run


def _compared(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links within groups (``gid, node, comp, asks``)."""
    full = groups.join(sets, "node").groupBy("gid").agg(F.collect_list(F.struct("node", "set", "comp", "asks")).alias("members"))
    return full.select("members").mapInArrow(_compare(similarity), "a long, b long").distinct()


def _blocks(size: Column, block: int) -> Column:
    return F.greatest(F.ceil(8 * size / block), F.lit(1)).cast("int")


def _own(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def _with_first(met: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links between the smallest node of a key and the others of the key."""
    pairs = checkpoint(met.filter("node <> first").select("first", "node", "n").distinct())
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    parts = pairs.groupBy("first", salt.alias("salt")).agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    sizes = parts.groupBy("first").agg(F.sum("m").alias("m"), _blocks(F.sum("n"), block).alias("blocks"))
    # Only a first node of several blocks has to be looked up. Hot ones, few as in ``join_hot``, go to every task; the others
    # meet their nodes by salts, so that not even some of them make a task long.
    cut = checkpoint(sizes.filter("blocks > 1"))
    salts = F.array(*[F.lit(i).cast("long") for i in range(SALTS)])
    least = max(pairs.count() // HOT_SHARE, LEAST_HOT)
    hot = cut.filter(F.col("m") > least).select("first", F.col("blocks").alias("hot"))
    cold = cut.filter(F.col("m") <= least).select("first", "blocks", F.explode(salts).alias("salt"))
    dealt = pairs.join(F.broadcast(hot), "first", "left").withColumn("salt", F.when(F.col("hot").isNull(), salt).otherwise(F.xxhash64("node")))
    own = _own(F.coalesce("hot", "blocks", F.lit(1))).alias("p")
    cut = dealt.join(cold, ["first", "salt"], "left").select("first", "node", own)
    hubs = cut.select("first", F.col("first").alias("node"), "p").distinct()
    groups = cut.withColumn("asks", F.lit(False)).unionByName(hubs.withColumn("asks", F.lit(True)))
    gid = F.xxhash64("first", "p").alias("gid")
    return _compared(groups.select(gid, "node", F.col("node").alias("comp"), "asks"), sets, similarity)


def _with_rest(met: DataFrame, found: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links between the nodes of a key that are in another component than its smallest one, and all of the key."""
    comps = components(found)
    met = met.filter("m > 2").join(comps, met["node"] == comps["node"], "left").select(
        "key", "first", met["node"], "n", F.coalesce("root", met["node"]).alias("comp")
    )
    met = checkpoint(met)
    main = F.max(F.when(F.col("node") == F.col("first"), F.col("comp"))).alias("main")
    keys = met.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"), main)
    open_keys = keys.filter("low <> high").select("key", "m", "main")
    left = checkpoint(join_hot(met, open_keys, "key", "m", met.count()).withColumn("asks", F.col("comp") != F.col("main")))
    size = lambda asks: F.coalesce(F.sum(F.when(F.col("asks") == asks, F.col("n"))), F.lit(0))
    cuts = left.groupBy("key").agg(
        F.count("*").alias("m"), _blocks(size(False), block).alias("plain"), _blocks(size(True), block).alias("asking")
    )
    cut = join_hot(left, cuts, "key", "m", left.count())
    # Block numbers: first those of the nodes that do not ask, then the asking ones. A plain block meets every asking one,
    # an asking block meets every block.
    cut = cut.withColumn("own", F.when(F.col("asks"), F.col("plain") + _own(F.col("asking"))).otherwise(_own(F.col("plain"))))
    asking = F.sequence(F.col("plain"), F.col("plain") + F.col("asking") - 1)
    other = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("plain") + F.col("asking") - 1)).otherwise(asking)
    cut = cut.select("key", "node", "comp", "asks", "own", F.explode(other).alias("other"))
    nodes = cut.groupBy("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).agg(
        F.array_sort(F.collect_set(F.struct("node", "comp", "asks"))).alias("nodes")
    )
    once = nodes.filter(F.size("nodes") > 1).select(F.xxhash64("nodes").alias("gid"), "nodes").dropDuplicates(["gid"])
    return _compared(once.select("gid", F.inline("nodes")), sets, similarity)


def candidate_keys(nodes: DataFrame) -> DataFrame:
    """``key, node, n``: a node for every band, its fingerprint, and every link of its fingerprint; of ``node, print, bands, n``.

    Nodes of one fingerprint share a key, so for links the smallest of them stands for all.
    """
    nodes = nodes.filter("n > 0").select("node", "n", "print", "bands")
    prints = nodes.groupBy("print").agg(F.min(F.struct("node", "n")).alias("x")).select("print", "x.node", "x.n")
    prints = checkpoint(prints)
    links = checkpoint(links_between(prints))

    def end(name: str) -> DataFrame:
        key = F.xxhash64(F.lit("link"), "a", "b").alias("key")
        return links.select(key, F.col(name).alias("print")).join(prints, "print").select("key", "node", "n")

    same = nodes.select(F.xxhash64(F.lit("print"), "print").alias("key"), "node", "n")
    bands = nodes.select(F.explode("bands").alias("key"), "node", "n")
    return bands.unionByName(end("a")).unionByName(end("b")).unionByName(same)


def links_by_overlap(nodes: DataFrame, make_sets, similarity: float = SIMILARITY, block: int = BLOCK_BYTES) -> DataFrame:
    """``a, b``: links that hold the near nodes of ``nodes`` (``node, print, bands, n``) together.

    ``make_sets`` gives the table ``node, set`` for a table of nodes.
    """
    prepare(nodes.sparkSession)
    keys = candidate_keys(nodes)
    sizes = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("first")).filter("m > 1")
    # Spark estimates the keys too low to broadcast them safely; the adaptive merge join splits hot keys.
    met = checkpoint(keys.hint("merge").join(sizes, "key"))
    sets = checkpoint(make_sets(met.select("node").distinct()))
    found = checkpoint(_with_first(met, sets, similarity, block))
    return found.unionByName(_with_rest(met, found, sets, similarity, block))


# --- documents --------------------------------------------------------------------------------


def one_of_each(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row, with all its columns, of each group of near copies: the one with the smallest id."""
    named = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    rows = rows.withColumn("k1", F.xxhash64(named[text_col])).withColumn("k2", row_hash(rows))  # a row, in 128 bits
    text, row = text_bytes(named[text_col]), ("k1", "k2")
    own = F.col(named[id_col])
    slim = rows.select(*row, own.alias("id"), text.alias("text"))
    sketch = map_rows(slim, [F.col("text")], _SKETCH, _describe, (shingle,), keep=[*row, "id"])
    sketch = checkpoint(sketch)
    first = F.min(F.struct(F.isnull("id").alias("none"), "id", *row)).alias("first")
    same = [F.min(c).alias(c) for c in ("print", "bands", "n")]
    nodes = checkpoint(sketch.groupBy("node").agg(first, *same))

    def make_sets(wanted: DataFrame) -> DataFrame:
        which = wanted.join(nodes, "node").select("node", "first.k1", "first.k2")
        texts = slim.select(*row, "text").join(which, [*row]).dropDuplicates([*row])
        out = T.StructType([T.StructField("set", T.BinaryType())])
        return map_rows(texts, [F.col("text")], out, _set_maker, (shingle,), keep=["node"])

    roots = components(links_by_overlap(nodes, make_sets, similarity))
    rooted = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.k1", "first.k2")
    # Texts are shuffled once, by the hashes of their rows; dropping equal rows uses the same partitions.
    stay = rows.join(kept, [*row], "left_semi").dropDuplicates([*row])
    return stay.select(*[F.col(n).alias(c) for c, n in named.items()])
