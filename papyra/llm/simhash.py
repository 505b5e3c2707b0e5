"""SimHash near-duplicates through fuzzy keys of a Golay code.

A fingerprint has 64 bits, cut into segments of 22, 21 and 21. Each segment, filled up to 23 bits,
is decoded with the perfect (23, 12) Golay code: its fuzzy keys are the 12-bit indices of all codewords
at distance 4 or less, which are one (the nearest at 2 or less) or six (the nearest at 3). Two segments
that differ in at most two bits have a word between them at distance 1 or less from both, whose
nearest codeword, at 3 or less from it, is a key of both: they share a fuzzy key.

At most 4 differing bits lie in the three segments in one of two ways:

* some segment has none. The other two share at most 4, so one of them has at most two: the first
  segment as it is (21 bits or more) and a fuzzy key of the other (12 bits) agree;
* every segment has one or more. Then two have exactly one, and one half of each of these agrees
  (10 bits or more each), while the third has at most two: its fuzzy key (12 bits) agrees.

So every linked pair shares a key of at least 32 bits, of about 96 for each fingerprint.
Fingerprints that share a key are compared; only 4 or fewer differing bits make a link. Chance
meetings stay rare up to billions of fingerprints.

Only distinct fingerprints are keyed, so exact copies cost nothing here. Keys that only one
fingerprint has are dropped before anything is gathered. A key with more than ``BLOCK`` fingerprints
is split into blocks, and every pair of its blocks is a group of its own, so no task holds more than
two blocks. A group gives links enough to hold its linked fingerprints together (at most one fewer
than there are fingerprints), not all pairs. Components are then found over these links.

Defined results: null and empty texts, and texts of blanks only, have fingerprint zero, which is
linked like any other. Repeated rows are given each; a row without id gets the component of the
others with its fingerprint or links, and null where nobody there has an id. Texts of any length are
hashed whole. Other columns are ignored, whatever their names; an empty table gives an empty result.

Fingerprints with many texts and components with many fingerprints are hot keys: labels come to them
by broadcast (see ``join_hot``), and only the others meet their labels in a shuffle.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import join_hot, map_rows, space_words, spread, text_bytes
from papyra.llm.components import components
from papyra.session import checkpoint, prepare

SEED = 42
SHINGLE = 4
#: Most differing bits of a link; the keys are built for this many.
DISTANCE = 4
#: Fingerprints of one key that are compared in one group.
BLOCK = 2048
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Bits of the lower half of a segment.
HALF = 11


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed number; zero for a text without words."""
    from xxhash import xxh64_intdigest as digest

    w = space_words(raw)
    if not w:
        return 0
    if len(w) < shingle:
        hashes = [digest(b" ".join(w), SEED)]
    else:
        join = b" ".join
        hashes = [digest(join(s), SEED) for s in zip(*[w[k:] for k in range(shingle)])]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):  # bounded memory for texts of any length
        part = h[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h)).view(np.int64)[0])


def _printer(shingle: int):
    return lambda texts: ([fingerprint(t, shingle) for t in texts],)


# --- Golay code -------------------------------------------------------------------------------

_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _syndrome(x: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator."""
    x = x.astype(np.uint32)
    for bit in range(22, 10, -1):
        x = np.where(x >> np.uint32(bit) & np.uint32(1), x ^ np.uint32(_GENERATOR << (bit - 11)), x)
    return x


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight 4 or less (six columns), and how many there are."""
    single = [1 << i for i in range(23)]
    words = [0]
    level = [0]
    for _ in range(4):
        level = [w | s for w in level for s in single if s > w]
        words += level
    words = np.array(words, dtype=np.uint32)
    syn = _syndrome(words)
    weight = np.bitwise_count(words)
    table, count = np.zeros((2048, 6), dtype=np.uint32), np.zeros(2048, dtype=np.int64)
    for w, s in zip(words[weight <= 3].tolist(), syn[weight <= 3].tolist(), strict=True):
        table[s, 0], count[s] = w, 1  # the code is perfect: exactly one for each syndrome
    for w, s in zip(words[weight == 4].tolist(), syn[weight == 4].tolist(), strict=True):
        table[s, count[s]] = w
        count[s] += 1
    return table, count


class GolayKeys:
    """Keys of fingerprints: one segment fuzzily, others or their halves as they are."""

    def __init__(self):
        self.table, self.count = _patterns()

    def segment(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Six columns of codeword indices and which of them are there."""
        words = words.astype(np.uint32)
        syn = _syndrome(words)
        keys = (words[:, None] ^ self.table[syn]) >> np.uint32(11)
        return keys, np.arange(6)[None, :] < self.count[syn][:, None]

    def __call__(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (key, number of the fingerprint); the kind of a key is in its upper bits."""
        u = prints.view(np.uint64)
        plain = [(u >> np.uint64(s)) & np.uint64((1 << n) - 1) for s, n in SEGMENTS]
        fuzzy = [self.segment(w) for w in plain]
        low = np.uint64((1 << HALF) - 1)
        halves = [(w & low, w >> np.uint64(HALF)) for w in plain]
        fixed: list[tuple[int, np.ndarray]] = []  # the fuzzy segment, and what has to agree as it is
        for i, j in itertools.permutations(range(3), 2):
            fixed.append((j, plain[i]))
        for k in range(3):
            i, j = (x for x in range(3) if x != k)
            fixed += [(k, a << np.uint64(HALF) | b) for a in halves[i] for b in halves[j]]
        keys, rows = [], []
        for kind, (k, same) in enumerate(fixed):
            codes, there = fuzzy[k]
            whole = (np.uint64(kind) << np.uint64(22) | same)[:, None] << np.uint64(12) | codes
            keys.append(whole[there])
            rows.append(np.nonzero(there)[0])
        return np.concatenate(keys).view(np.int64), np.concatenate(rows)


def _emit_keys(batches):
    golay = GolayKeys()
    for b in batches:
        prints = b.column(0).to_numpy()
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            keys, rows = golay(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "print"])


# --- Links ------------------------------------------------------------------------------------


def forest(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that hold together what is linked among the fingerprints: a search tree per component."""
    u = prints.view(np.uint64)
    left = np.arange(len(u))
    links: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        near = np.bitwise_count(u[left] ^ u[at]) <= distance
        if near.any():
            found = left[near]
            left = left[~near]
            links += [(int(prints[at]), int(prints[x])) for x in found]
            queue += found.tolist()
    return links


def _link_groups(distance: int):
    def run(batches):
        for b in batches:
            groups = b.column(0)
            sizes = np.diff(groups.offsets.to_numpy())
            flat, starts = groups.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])[:-1]
            left, right = [], []
            for n in np.unique(sizes[sizes > 1]):
                at = starts[sizes == n]
                if n <= 8:  # all small groups of one size at once
                    rows = flat[at[:, None] + np.arange(n)]
                    u = rows.view(np.uint64)
                    for i in range(n - 1):
                        for j in range(i + 1, n):
                            near = np.bitwise_count(u[:, i] ^ u[:, j]) <= distance
                            left.append(rows[near, i])
                            right.append(rows[near, j])
                else:
                    for s in at:
                        links = forest(flat[s : s + n], distance)
                        if links:
                            a, c = np.array(links, dtype=np.int64).T
                            left.append(a)
                            right.append(c)
            a = np.concatenate(left) if left else np.empty(0, np.int64)
            c = np.concatenate(right) if right else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])

    return run


def links_between(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``a, b``: links that hold the near fingerprints of ``prints`` (distinct, column ``print``) together."""
    if distance > DISTANCE:
        raise ValueError(f"the keys find fingerprints with at most {DISTANCE} differing bits")
    prepare(prints.sparkSession)
    # About 96 keys a fingerprint: dealt evenly first, so that many tasks make them. Both uses of the keys share the deal.
    keys = spread(prints.select("print"), prints.count()).mapInArrow(_emit_keys, "key long, print long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # Spark takes the keys for little more than their fingerprints, and would broadcast them all through the driver.
    shared = keys.hint("merge").join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    shared = shared.select("key", "print", "blocks", own.alias("own"))
    # A block meets every block of its key, and itself where there is only one.
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own"))
    ))
    met = shared.select("key", "print", "own", other.alias("other"))
    groups = met.groupBy("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).agg(
        F.collect_list("print").alias("prints")
    )
    return groups.select("prints").mapInArrow(_link_groups(distance), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, print, component_id`` of every text.

    ``print`` is the fingerprint as a signed number. Texts whose fingerprints differ in at most
    ``distance`` bits are linked; the component is the smallest id reachable over links.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), text_bytes(text_col).alias("__text"))
    out = T.StructType([T.StructField("print", T.LongType())])
    prints = checkpoint(map_rows(rows, [F.col("__text")], out, _printer, (shingle,), keep=["__id"]))
    classes = checkpoint(prints.groupBy("print").agg(F.min("__id").alias("first"), F.count("*").alias("rows")))
    roots = components(links_between(classes, distance))
    rooted = checkpoint(
        classes.join(roots, classes["print"] == roots["node"], "left").select(
            "print", "first", "rows", F.coalesce("root", "print").alias("root")
        )
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    labelled = join_hot(rooted.drop("first"), least, "root", "n", classes.count()).select("print", "rows", "component_id")
    found = join_hot(prints, labelled, "print", "rows", prints.count())
    return found.select(F.col("__id").alias(id_col), "print", "component_id")
