"""Benchmark decontamination by word windows.

Items of the benchmark give windows of ``width`` consecutive words (an item of fewer words, but
not none, is one window). Their hashes form a set that every worker holds; each training text is
scanned with one window of ids per place, a place whose hash is in the set is verified word by
word, and all words under verified windows are hit. Texts stay where they are: there is no shuffle.

The set is held by workers only while the benchmark has at most ``max_windows`` windows and its words
at most ``MAX_WORD_BYTES``, both counted first: sorted hashes, one buffer of word numbers for verification
and the vocabulary, about 150 bytes a window. It is built once a worker. A larger benchmark goes another
way: windows of both sides meet in a join on their words (skew is split by the adaptive join), and hits
come together by document. Both ways give the same rows.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters.

Defined results: null and empty texts have no words and no hits, and an item without words has
no window. Repeated documents are scanned each, repeated items count once for each distinct id.
A null item id is no item. Texts of any length are scanned whole, in linear time. Other columns are ignored, whatever their names; empty tables give no hits.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import alnum_words, map_rows, text_bytes
from papyra.session import checkpoint

#: Words of a window.
WIDTH = 10
#: Most windows that every worker holds, and most bytes of their words.
MAX_WINDOWS = 1_000_000
MAX_WORD_BYTES = 64 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class _Ids(dict):
    def __missing__(self, word):
        return 0


class WindowSet:
    """The windows of all items: sorted hashes by width, and where the words of each stand in one buffer."""

    def __init__(self, items: list[tuple[object, bytes]], width: int = WIDTH):
        """``items``: ids and their words, joined by blanks."""
        self.ids = _Ids()
        self.items: list[object] = []
        buffer, begins, widths, owners, at = [], [], [], [], 0
        for item, text in items:
            words = text.split()
            if not words:
                continue
            buffer.append(np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], dtype=np.uint32))
            n = min(width, len(words))
            places = len(words) - n + 1
            begins.append(np.arange(at, at + places))
            widths.append(np.full(places, n, dtype=np.int32))
            owners.append(np.full(places, len(self.items), dtype=np.int32))
            self.items.append(item)
            at += len(words)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.words = join(buffer, np.uint32)
        begins, widths, owners = join(begins, np.int64), join(widths, np.int32), join(owners, np.int32)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(widths).tolist():
            own = begins[widths == n]
            h = self._hash([self.words[own + k] for k in range(n)])
            order = np.argsort(h, kind="stable")
            self.tables[n] = h[order], own[order], owners[widths == n][order]
        self.least = min(self.tables, default=0)

    @staticmethod
    def _hash(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
        return h

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit spans (first word, after the last word) and the items of verified windows."""
        if not self.tables or len(words) < self.least:
            return [], set()
        ids = np.fromiter(map(self.ids.__getitem__, words), dtype=np.uint32, count=len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]  # runs of words that the benchmark has at all
        spans, items = [], set()
        for n, (table, begins, owners) in self.tables.items():
            for r in np.flatnonzero(ends - starts >= n):
                run = ids[starts[r] : ends[r]]
                places = len(run) - n + 1
                h = self._hash([run[k : k + places] for k in range(n)])
                low = np.searchsorted(table, h, side="left")
                found = np.flatnonzero(table[np.minimum(low, len(table) - 1)] == h)
                high = np.searchsorted(table, h[found], side="right")
                for i, a, b in zip(found.tolist(), low[found].tolist(), high.tolist(), strict=True):
                    same = (self.words[begins[a:b, None] + np.arange(n)] == run[i : i + n]).all(axis=1)
                    if same.any():  # the words themselves agree
                        items.update(self.items[o] for o in owners[a:b][same].tolist())
                        spans.append((int(starts[r]) + i, int(starts[r]) + i + n))
        spans.sort()
        merged: list[tuple[int, int]] = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def _scanner(items, width):
    windows = WindowSet(items.value, width)

    def fn(texts: list[bytes]):
        n_words, spans, found = [], [], []
        for t in texts:
            words = alnum_words(t)
            s, i = windows.scan(words)
            n_words.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in s])
            found.append(sorted(map(str, i)))
        return n_words, spans, found

    return fn


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _item_words():
    def fn(texts: list[bytes]):
        words = [alnum_words(t) for t in texts]
        return [b" ".join(w) for w in words], [len(w) for w in words]

    return fn


def _held_items(benchmark: DataFrame, item_col: str, text_col: str, width: int, max_windows: int):
    """The items with words (``item``, ``raw``: the words), and a broadcast of them if their windows may be held."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), text_bytes(text_col).alias("text")).filter("item IS NOT NULL")
    out = T.StructType([T.StructField("raw", T.BinaryType()), T.StructField("n", T.LongType())])
    items = map_rows(items, [F.col("text")], out, _item_words, keep=["item"]).filter("n > 0")
    windows = F.sum(F.greatest(F.col("n") - (width - 1), F.lit(1)))
    size = items.agg(F.coalesce(windows, F.lit(0)).alias("n"), F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("b")).first()
    if size["n"] > max_windows or size["b"] > MAX_WORD_BYTES:
        return items.select("item", "raw"), None
    held = [(r["item"], bytes(r["raw"])) for r in items.collect()]
    return items.select("item", "raw"), benchmark.sparkSession.sparkContext.broadcast(held)


def _cutter(items, width, drop):
    windows = WindowSet(items.value, width)

    def fn(texts: list[bytes]):
        found = [windows.scan(alnum_words(t))[0] for t in texts]
        cut = texts if drop else [cut_spans(t, s) for t, s in zip(texts, found, strict=True)]
        return [bool(s) for s in found], [None] * len(texts) if drop else [t.decode("utf-8", "replace") for t in cut]

    return fn


def _span_cutter():
    def fn(texts: list[bytes], spans: list[list[dict]]):
        cut = [cut_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)]
        return [bool(s) for s in spans], [t.decode("utf-8", "replace") for t in cut]

    return fn


def _without_hits(docs, benchmark, drop, width, max_windows, text_col, item_col, item_text_col) -> DataFrame:
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    text = names[text_col]
    _, held = _held_items(benchmark, item_col, item_text_col, width, max_windows)
    out = T.StructType([T.StructField("__hit", T.BooleanType()), T.StructField("__cut", T.StringType())])
    if held is not None:
        done = map_rows(rows, [text_bytes(text)], out, _cutter, (held, width, drop), keep=list(names.values()))
    else:
        # A row number made here would change on a retry, so it is fixed by a checkpoint first.
        rows = checkpoint(rows.withColumn("__row", F.monotonically_increasing_id()))
        spans = find_contamination(rows, benchmark, width, max_windows, "__row", text, item_col, item_text_col)
        joined = rows.join(spans.select("__row", "spans"), "__row")
        if drop:
            done = joined.withColumn("__hit", F.size("spans") > 0)
        else:
            done = map_rows(joined, [text_bytes(text), F.col("spans")], out, _span_cutter, keep=list(names.values()))
    if drop:
        done = done.filter(~F.col("__hit"))
    else:
        done = done.withColumn(text, F.when(F.col("__hit"), F.col("__cut")).otherwise(F.col(text)))
    return done.select(*[F.col(n).alias(c) for c, n in names.items()])


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows without any verified window, with all their columns."""
    return _without_hits(docs, benchmark, True, width, max_windows, text_col, item_col, item_text_col)


def cut_out(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """All rows, their texts without the words under verified windows and what stands between these."""
    return _without_hits(docs, benchmark, False, width, max_windows, text_col, item_col, item_text_col)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``id, n_words, spans, items``: hit spans in words and the ids (as sorted texts) of items found."""
    items, held = _held_items(benchmark, item_col, item_text_col, width, max_windows)
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), text_bytes(text_col).alias("__text"))
    if held is None:
        return _by_join(rows, items, width, id_col)
    out = T.StructType(
        [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS),
         T.StructField("items", T.ArrayType(T.StringType()))]
    )
    done = map_rows(rows, [F.col("__text")], out, _scanner, (held, width), keep=["__id"])
    return done.withColumnRenamed("__id", id_col)


def _by_join(rows: DataFrame, items: DataFrame, width: int, id_col: str) -> DataFrame:
    """The same result for a benchmark of any size: windows meet in a join on their words."""

    def words(c):
        low = F.translate(c.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))

    def windows(w, n):
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - n),
            lambda i: F.struct(i.alias("start"), F.array_join(F.slice(w, i + 1, n), " ").alias("key")),
        )

    w_items = items.select("item", words(F.col("raw")).alias("w")).filter(F.size("w") > 0)
    w_items = w_items.withColumn("n", F.least(F.size("w"), F.lit(width)))
    keys = w_items.select("item", "n", F.explode(windows(F.col("w"), F.col("n"))).alias("x"))
    keys = keys.select("item", "n", F.col("x.key").alias("key")).distinct()
    lengths = [r["n"] for r in keys.select("n").distinct().collect()]  # at most ``width`` numbers
    # Row numbers would change if a lost task read its rows in another order, so they are written first.
    numbered = checkpoint(rows.withColumn("__text_no", F.monotonically_increasing_id()))
    doc_words = numbered.select("__text_no", "__id", words(F.col("__text")).alias("w"))
    places = None
    for n in lengths:
        part = doc_words.filter(F.size("w") >= n).select(
            "__text_no", F.lit(n).alias("n"), F.explode(windows(F.col("w"), F.lit(n))).alias("x")
        )
        part = part.select("__text_no", "n", F.col("x.start").alias("start"), F.col("x.key").alias("key"))
        places = part if places is None else places.unionByName(part)
    counts = doc_words.select("__text_no", F.col("__id").alias(id_col), F.size("w").cast("long").alias("n_words"))
    none = F.array().cast(_SPANS)
    if places is None:
        return counts.select(id_col, "n_words", none.alias("spans"), F.array().cast("array<string>").alias("items"))
    hits = places.join(keys, ["n", "key"])
    found = hits.groupBy("__text_no").agg(
        F.array_sort(F.collect_set(F.struct(
            F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n")).cast("long").alias("end")
        ))).alias("s"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )
    merged = F.aggregate(
        "s", none,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return counts.join(found.select("__text_no", merged.alias("spans"), "items"), "__text_no", "left").select(
        id_col, "n_words", F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (and what stands between them)."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])
