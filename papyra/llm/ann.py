"""Approximate nearest neighbours by cross-polytope hashing.

A vector's direction is turned by a pseudo-rotation (three rounds of random signs and a fast
Hadamard transform, after filling up to a power of two) and assigned to the nearest of the
2d signed axes. Each of ``TABLES`` rotations makes one table, which holds every row once. A query
looks into the ``PROBES`` nearest axes of every table. All rows found are ranked by the exact
inner product of the original vectors in double precision.

Buckets are cut into blocks of at most about ``ROW_BLOCK`` rows and queries into blocks of
``QUERY_BLOCK``; one group is a block of each, so a bucket of any size needs bounded memory. A
group hands on, for each of its queries, only rows that can be among the ``k`` nearest. Of equal
vectors only the ``k + 1`` with the smallest ids can ever be in a result (ties go to smaller ids,
one more for a query that is itself a copy): only these are put into the tables, which is exact.

A query whose tables hold fewer than ``k`` rows for it is searched against all rows, in blocks.

Where norms differ, rows get one more coordinate, ``sqrt(1 - |x|^2 / max^2)``, and queries a zero
one, so that the nearest direction is the largest inner product.

Vectors that are null, zero, or that hold null or non-finite components take no part, neither do rows
without id. Vectors of different lengths have no inner product: every length is searched by itself, so an
odd row costs only itself. Rows that repeat both id and vector are one row. Rows that share an id but not
the vector are rows of their own: each is a candidate, the other one's as well, and as a query each has
its own list. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.session import checkpoint, prepare

TABLES = 12
PROBES = 12
ROW_BLOCK = 8192
QUERY_BLOCK = 1024
SEED = 7
#: Slack for products that one group computes in another order than the next.
SLACK = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Hadamard transform of every row; the width is a power of two."""
    n = x.shape[1]
    h = 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


class Rotations:
    """The pseudo-rotations of all tables; the same on every executor."""

    def __init__(self, dim: int, tables: int = TABLES, seed: int = SEED):
        self.width = 1 << max(1, (dim - 1).bit_length())
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0]), size=(tables, 3, self.width))

    def scores(self, x: np.ndarray, table: int) -> np.ndarray:
        """How near every signed axis is: first the positive axes, then the negative ones."""
        r = np.zeros((len(x), self.width))
        r[:, : x.shape[1]] = x
        for signs in self.signs[table]:
            r = hadamard(r * signs)
        return np.concatenate([r, -r], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed doubles to rows."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _pack(batches):
    """Usable vectors as packed doubles, so that later steps need no lists."""
    for b in batches:
        ids, packed, norms, dims = [], [], [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if i is None or not v or any(c is None for c in v):
                continue
            a = np.array(v, dtype=np.float64)
            n = float(np.dot(a, a))
            if n > 0 and np.isfinite(a).all():
                ids.append(i)
                packed.append(a.tobytes())
                norms.append(n**0.5)
                dims.append(len(a))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(norms, pa.float64()), pa.array(dims, pa.int32())],
            names=["id", "vec", "norm", "dim"],
        )


def _hash(tables: int, probes: int, query: bool):
    """Rows to (dim, table, bucket, id, mark, vec): one bucket a table, or the nearest ``probes`` of them."""

    def some(b, dim, top, turn):
        x = _matrix(b.column("vec"))
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        if top is None or query:
            d = x / norm
        else:
            d = np.concatenate([x / top, np.sqrt(np.maximum(0, 1 - (norm / top) ** 2))], axis=1)
        wanted = min(probes if query else 1, 2 * turn.width)
        at = np.repeat(np.arange(len(x)), wanted)
        rows = b.select(["id", "mark", "vec"]).take(pa.array(at))
        for t in range(tables):
            s = turn.scores(d, t)
            axes = np.argsort(-s, axis=1, kind="stable")[:, :wanted] if wanted > 1 else s.argmax(axis=1)[:, None]
            own = [np.full(len(at), dim, np.int32), np.full(len(at), t, np.int32), axes.ravel().astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, own), *rows.columns], names=["dim", "table", "bucket", "id", "mark", "vec"]
            )

    def run(batches):
        turns: dict[tuple, Rotations] = {}
        for whole in batches:
            dims, tops = whole.column("dim").to_numpy(), whole.column("top").to_pylist()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                top = tops[rows[0]]
                key = dim + (top is not None)
                if key not in turns:
                    turns.clear()  # one length at a time is held
                    turns[key] = Rotations(key, tables)
                step = max(1, min(256, (1 << 22) // key))
                for start in range(0, len(rows), step):
                    yield from some(whole.take(pa.array(rows[start : start + step])), dim, top, turns[key])

    return run


_PAIR = "query_id long, query_mark long, vec_id long, vec_mark long, score double"
#: Rows of one group that are compared with one slice of queries at a time.
_CELLS = 1 << 21


def _rank_group(k: int):
    """The rows of one block that can be among the ``k`` nearest of each query of the other."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if rows.num_rows and queries.num_rows:
            x, ids, marks = _matrix(rows.column("vec").combine_chunks()), rows.column("id").to_numpy(), rows.column("mark").to_numpy()
            q_ids, q_marks = queries.column("id").to_numpy(), queries.column("mark").to_numpy()
            step = max(1, _CELLS // len(ids))
            for start in range(0, len(q_ids), step):
                part = queries.slice(start, step)
                q = _matrix(part.column("vec").combine_chunks())
                own, mark = q_ids[start : start + step], q_marks[start : start + step]
                near = q @ x.T
                near[(own[:, None] == ids[None, :]) & (mark[:, None] == marks[None, :])] = -np.inf
                if len(ids) > k:
                    least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
                else:
                    least = np.full(len(own), -np.inf)
                slack = SLACK * np.maximum(1.0, np.abs(least))
                qi, vi = np.nonzero((near >= (least - slack)[:, None]) & np.isfinite(near))
                # The score itself: one row's products summed in one order wherever they are computed.
                made = own[qi], mark[qi], ids[vi], marks[vi], (q[qi] * x[vi]).sum(axis=1)
                for column, values in zip(out, made, strict=True):
                    column.append(values)
        names = ["query_id", "query_mark", "vec_id", "vec_mark", "score"]
        kinds = [np.int64] * 4 + [np.float64]
        return pa.table({n: np.concatenate(c) if c else np.empty(0, t) for n, c, t in zip(names, out, kinds, strict=True)})

    return run


def _in_blocks(rows: DataFrame, queries: DataFrame, keys: list[str], sizes: DataFrame, k: int) -> DataFrame:
    """Compare what shares ``keys``, by blocks. ``sizes``: keys, ``row_blocks``, ``query_blocks``."""

    def split(df: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        df = df.join(F.broadcast(sizes), keys)
        df = df.withColumn(own, F.pmod(F.xxhash64("id", "mark"), F.col(own_blocks)).cast("int"))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)))
        # New columns for each side: both may come from the same table.
        return df.select(*[F.col(c).alias(c) for c in (*keys, "row_block", "query_block", "id", "mark", "vec")])

    left = split(rows, "row_block", "row_blocks", "query_block", "query_blocks")
    right = split(queries, "query_block", "query_blocks", "row_block", "row_blocks")
    by = [*keys, "row_block", "query_block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_rank_group(k), _PAIR)


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, ranked; a row that several tables found counts once."""
    best = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id", "vec_mark")
    pairs = pairs.repartition("query_id", "query_mark").dropDuplicates(["query_id", "query_mark", "vec_id", "vec_mark"])
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _sizes(rows: DataFrame, queries: DataFrame, keys: list[str], row_block: int, query_block: int) -> DataFrame:
    """Blocks of every key that both sides have: at most tables x 2d rows for each length d of vectors."""
    counts = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = counts(rows, "r").join(counts(queries, "q"), keys)
    blocks = lambda name, size: F.ceil(F.col(name) / size).cast("int")
    return checkpoint(both.select(*keys, blocks("r", row_block).alias("row_blocks"), blocks("q", query_block).alias("query_blocks")))


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES,
    row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row for which ``is_query`` holds.

    ``is_query`` is an expression over the column ``id``.
    """
    spark = vectors.sparkSession
    prepare(spark)
    packed = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec")
    ).mapInArrow(_pack, "id long, vec binary, norm double, dim int")
    # Repeated rows are combined before they are shuffled; the mark tells rows of one id apart.
    packed = checkpoint(packed.distinct().withColumn("mark", F.xxhash64("vec")))
    # One row for each length that occurs. Where norms differ, the largest one of the length is the scale.
    shape = packed.groupBy("dim").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    top = F.when(F.col("high") > F.col("low") * 1.001, F.col("high")).alias("top")
    usable = packed.join(F.broadcast(checkpoint(shape.select("dim", top))), "dim").select("dim", "top", "id", "mark", "vec")
    # A limit on ranks goes before the shuffle as well, so a vector with many copies stays small.
    copies = Window.partitionBy("vec").orderBy("id")
    kept = usable.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    queries = usable.filter(is_query)
    shape_of = "dim int, table int, bucket int, id long, mark long, vec binary"
    rows_in = checkpoint(kept.mapInArrow(_hash(tables, probes, False), shape_of))
    asked = queries.mapInArrow(_hash(tables, probes, True), shape_of)
    keys = ["dim", "table", "bucket"]
    found = _in_blocks(rows_in, asked, keys, _sizes(rows_in, asked, keys, row_block, query_block), k)
    found = checkpoint(_nearest(found, k))
    of_query = [F.col("query_id").alias("id"), F.col("query_mark").alias("mark")]
    full = found.filter(F.col("rank") == k).select(*of_query)
    short = checkpoint(queries.join(full, ["id", "mark"], "left_anti").select("dim", "id", "mark", "vec"))
    if not short.isEmpty():
        sizes = _sizes(kept, short, ["dim"], row_block, query_block)
        again = _nearest(_in_blocks(kept, short, ["dim"], sizes, k), k)
        rest = found.join(short.select(F.col("id").alias("query_id"), F.col("mark").alias("query_mark")), ["query_id", "query_mark"], "left_anti")
        found = rest.unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
