"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.session import checkpoint, prepare

#: Link tables of at most this many rows are finished by one task; larger ones by star rounds.
ONE_TASK_LINKS = 500_000
_LINK = "a long, b long"


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component, by label halving over arrays."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches):
    """The links of a task, as few as hold the same nodes together: each node with its root."""
    held: list[np.ndarray] = []
    rows = 0
    links = np.empty((2, 0), dtype=np.int64)

    def fold(links, held):
        both = np.concatenate([links, *held], axis=1)
        if not both.shape[1]:
            return both
        nodes, roots = roots_of(both[0], both[1])
        keep = nodes != roots
        return np.stack([nodes[keep], roots[keep]])

    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
        rows += b.num_rows
        if rows >= 1_000_000:
            links, held, rows = fold(links, held), [], 0
    links = fold(links, held)
    for a, b in [links] if links.shape[1] else []:
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _finish(batches):
    """Every node of the links of a task, roots as well, with its root."""
    for b in _contract(batches):
        yield pa.RecordBatch.from_arrays(b.columns, names=["node", "root"])
        roots = pa.array(np.unique(b.column(1).to_numpy()))
        yield pa.RecordBatch.from_arrays([roots, roots], names=["node", "root"])


def components(links: DataFrame, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``: long); root: the smallest node reachable.

    Every task first contracts its own links to stars. If few links are left, one task joins the
    stars; else large-star and small-star rounds go on, each checkpointed, until nothing changes.
    The hub of a large star is a hot key of the joins, whose skew the adaptive join splits; the
    minimum of a hub is aggregated before it is shuffled.
    """
    prepare(links.sparkSession)
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    links = checkpoint(links.mapInArrow(_contract, _LINK))
    if links.count() <= one_task_links:
        return links.coalesce(1).mapInArrow(_finish, "node long, root long")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("b < a").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpoint(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        new = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        state = new

