"""What the corpus operators share: batch mapping over Arrow, words, bounded caches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from papyra.session import prepare

#: Rows of one call of a batch function are cut to about this many bytes of input.
SLICE_BYTES = 16 << 20

#: Bytes to blanks for words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
#: On UTF-8 bytes that is: keep digits, a-z and every byte from 0x80 on.
_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words of ASCII letters, digits and every non-ASCII character."""
    return raw.translate(_WORDS).split()


def space_words(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words between the ASCII blanks 0x20 and 0x09-0x0D."""
    return raw.lower().split()


class Memo(dict):
    """A bounded memo: ``memo[key]`` computes what is missing.

    Once it holds ``limit`` keys it starts anew, while what it held before stays at hand: keys that
    come again move over, the others go. So it never holds more than twice the limit.
    """

    def __init__(self, fn: Callable, limit: int):
        super().__init__()
        self.fn, self.limit, self.old = fn, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        self[key] = value
        return value


#: What ``make`` gave to earlier tasks of this worker, by token; only the newest, as it may be large.
_MADE: dict[str, Callable] = {}


def _give_back() -> None:
    """Return freed memory to the system: memos hold their model in a cycle, and malloc keeps what they leave."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def _made(token: str, make: Callable[..., Callable], args: tuple) -> Callable:
    if token not in _MADE:
        if _MADE:
            _MADE.clear()
            _give_back()  # else a worker holds what an earlier stage needed through all that follow
        _MADE[token] = make(*args)
    return _MADE[token]


def _slices(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def map_rows(
    df: DataFrame,
    inputs: Sequence[Column],
    out: T.StructType,
    make: Callable[..., Callable],
    args: tuple = (),
    keep: Sequence[str] = (),
    token: str | None = None,
) -> DataFrame:
    """Apply a Python batch function to every row, without a shuffle.

    ``make(*args)`` runs once a worker, whose later tasks use what it gave; it returns
    ``fn(*columns) -> columns``, which gets each input as a list and returns one list (or Arrow
    array) for each field of ``out``. Equal ``token``s mean equal results of ``make``; without
    one, only tasks of this call share. Columns named in ``keep`` pass through; one that is also
    in ``out`` is replaced by the result.
    """
    token = token or uuid.uuid4().hex
    prepare(df.sparkSession)
    new = {f.name for f in out}
    keep = [k for k in keep if k not in new]
    chosen = df.select(*[F.col(f"`{k}`") for k in keep], *[c.alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([chosen.schema[k] for k in keep] + list(out))
    n_keep = len(keep)

    def run(batches):
        fn = _made(token, make, args)
        arrow = to_arrow_schema(schema)
        for whole in batches:
            for b in _slices(whole):
                made = fn(*[b.column(i).to_pylist() for i in range(n_keep, b.num_columns)])
                columns = [b.column(i).cast(arrow.field(i).type) for i in range(n_keep)]
                columns += [
                    m if isinstance(m, pa.Array) else pa.array(m, type=arrow.field(n_keep + i).type)
                    for i, m in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return chosen.mapInArrow(run, schema)


def text_bytes(name: str = "text") -> Column:
    """The column's text as UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary")


#: A key with more than one in so many rows is joined apart, by broadcast: there are fewer than so many of these.
HOT_SHARE = 1000
#: Keys with so few rows are never hot.
LEAST_HOT = 256


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and the number of left rows of that key in ``weight``.

    Weights sum up to ``total`` at most, so fewer than ``HOT_SHARE`` keys have more than that share of it.
    These go to every task; no key of the shuffled join has more rows.
    """
    least = max(total // HOT_SHARE, LEAST_HOT)
    hot = F.broadcast(right.filter(F.col(weight) > least).drop(weight))
    cold = right.filter(F.col(weight) <= least).drop(weight)
    rest = left.join(hot.select(key), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(cold, key))


def spread(df: DataFrame, rows: int, in_task: int = 131_072) -> DataFrame:
    """A small table (``rows`` long) dealt over enough tasks for work that makes many rows of each."""
    wanted = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // in_task))
    return df.repartition(max(1, min(wanted, -(-rows // 512))))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; a null differs from every value."""

    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        return F.map_entries(c) if kind == "map" else F.to_json(c) if kind == "variant" else c

    return F.xxhash64(*[x for f in df.schema for x in (plain(f), F.isnull(F.col(f"`{f.name}`")))])
