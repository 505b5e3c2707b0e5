"""Secret scans with built-in column functions only.

Pattern kinds (``assign``, ``access``, ``hex``) are regular expressions. The kind ``entropy`` is found
by a sliding window over candidate strings (runs of at least ``WINDOW`` signs of base64 or hex): for its character class, the counts of the signs in the window are kept,
each step adds the sign that enters and takes away the one that leaves, and the window's Shannon
entropy is ``log2(w) - sum(c log2 c) / w``. The sum is kept in whole billionths, so steps do not drift.
Parts on the allow-list (documented examples, UUIDs, digests with their algorithm's name, signs in order,
words between separators) are taken out of a candidate; it is a secret if any window of any other part
reaches the threshold of that part's class. Candidates that a pattern span covers are suppressed.

Positions are in code points, the end exclusive. They come from the lengths of the matches and of
the parts between them, so each kind costs one split and one extraction, and only in texts that have
a match at all. Lengths are summed up in blocks (see ``running``), and texts are put together again from
byte places, so the work is linear in the text and in its matches. There is no shuffle and no Python.

Defined results: null and empty texts have no spans; texts of any length are scanned whole; repeated rows are scanned each; other columns
are kept by ``redact`` and ignored by ``find_secrets``; an empty table gives an empty result. Spans of
different kinds may overlap; for equal starts they are in the order of ``KINDS``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
#: Java patterns; case is ignored for ASCII letters only.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: At least 24 signs: a run of fewer has no match, a longer run is one match.
HEX = r"[0-9a-f]{24,}"

WINDOW = 20
#: Windows that are judged in one go.
CUT = 256
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: A candidate may be a whole text of one run, so these patterns take linear time: each is anchored at the
#: start or at the start of a word, and gives nothing back.
#: The class of a part by the signs it uses, and the entropy that one window must reach. Letters without digits reach 3.58
#: at most in the words of the given documents (sf0.1), so their threshold is above that.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", 2.9), ("letters", r"^[A-Za-z]+={0,2}$", 3.7), ("alnum", r"^[A-Za-z0-9]+={0,2}$", 3.5),
    ("base64", r".", 3.7),
)
#: What is no secret: placeholders, signs in order, one documented key, digests after their algorithm's name, UUIDs, and
#: words and CamelCase names that stand alone between separators. Only the matched part is let off; the rest of the candidate is judged.
ALLOWED = (
    r"(?i:example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh)"
    r"|^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$"
    r"|^(?i:sha(?:1|224|256|384|512)|md5|blake[23]b?)[-_][A-Za-z0-9+/]++={0,2}"
    r"|(?<![A-Za-z0-9])(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9+])[A-Za-z][a-z]{2,19}(?:[A-Z][a-z]{1,19}){1,15}(?![A-Za-z0-9+])[-_/]*"
    r"|(?<![A-Za-z0-9+])(?:[A-Z]?[a-z]{2,19}|[A-Z]{2,19})(?![A-Za-z0-9+])[-_/]*"
)
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_SCALE = 10**9
#: ``first`` and ``last`` are the same span in bytes of UTF-8.
SPAN = "array<struct<start:int,kind:int,end:int,first:int,last:int>>"
#: Values that are summed up one by one; a power of two.
STEP = 1 << 7


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where it is used within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, of, zero: Column) -> Column:
    """What ``of`` (associative) makes of the values up to each place, itself included, in two levels of ``STEP``."""
    fold = lambda a: F.aggregate(a, zero, of)

    def by_block(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(STEP))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda at: fold(F.slice(v, at + 1, F.lit(STEP)))), lambda sums: up_to(v, sums))

    def up_to(v: Column, sums: Column) -> Column:
        before = F.transform(sums, lambda _, i: fold(F.slice(sums, F.lit(1), i)))
        block = lambda i: F.shiftright(i, STEP.bit_length() - 1)
        within = lambda i: fold(F.slice(v, i - i % STEP + 1, i % STEP + 1))
        return let(before, lambda b: F.transform(v, lambda _, i: of(F.get(b, block(i)), within(i))))

    return let(values, by_block)


def _matches(text: Column, pattern: str) -> Column:
    """Every match with its place: ``array<struct<start, end, first, last, match>>``, leftmost and not overlapping."""
    # The text is matched as a whole and what lies between matches gives the places. A match is never empty.
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pairs = let(found, lambda m: F.arrays_zip(F.slice(between, F.lit(1), F.size(m)).alias("gap"), m.alias("match")))
    length = lambda x, size: size(x["gap"]) + size(x["match"])
    ends = lambda p, size: running(F.transform(p, lambda x: length(x, size)), lambda a, b: a + b, F.lit(0))

    def place(x: Column, end: Column, last: Column) -> Column:
        return F.struct(
            (end - F.length(x["match"])).alias("start"), end.alias("end"),
            (last - F.octet_length(x["match"])).alias("first"), last.alias("last"), x["match"].alias("match"),
        )

    every = let(
        pairs,
        lambda p: F.transform(
            F.arrays_zip(p.alias("x"), ends(p, F.length).alias("end"), ends(p, F.octet_length).alias("last")),
            lambda y: place(y["x"], y["end"], y["last"]),
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int,first:int,last:int,match:string>>")
    return F.when(text.rlike(pattern), every).otherwise(none)


def _spans(found: Column, kind: str) -> Column:
    number = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), number, m["end"].alias("end"), m["first"].alias("first"), m["last"].alias("last"))
    )


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy of any ``window`` signs of a candidate (0 if it is shorter)."""
    table = F.array(*[F.lit(round(_SCALE * c * math.log2(c)) if c else 0).cast("long") for c in range(window + 1)])
    signs = F.transform(F.split(candidate, ""), lambda c: F.call_function("locate", c, F.lit(_SIGNS)))
    zero = F.array_repeat(F.lit(0), len(_SIGNS) + 1)
    state = F.struct(
        zero.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("least"), signs.alias("signs")
    )

    def step(acc, i):
        come = F.get(acc["signs"], i)
        go = F.when(i >= window, F.get(acc["signs"], i - window)).otherwise(F.lit(-1))
        c_in, c_out = F.get(acc["counts"], come), F.get(acc["counts"], go)
        changed = F.when(
            come == go, acc["sum"]
        ).otherwise(
            acc["sum"] + F.get(table, c_in + 1) - F.get(table, c_in)
            + F.when(go >= 0, F.get(table, c_out - 1) - F.get(table, c_out)).otherwise(F.lit(0).cast("long"))
        )
        counts = F.when(come == go, acc["counts"]).otherwise(
            F.transform(
                acc["counts"],
                lambda c, k: c + F.when(k == come, 1).otherwise(0) - F.when(k == go, 1).otherwise(0),
            )
        )
        least = F.when(i >= window - 1, F.least(acc["least"], changed)).otherwise(acc["least"])
        return F.struct(counts.alias("counts"), changed.alias("sum"), least.alias("least"), acc["signs"].alias("signs"))

    last = F.aggregate(
        F.sequence(F.lit(0), F.length(candidate) - 1), state, step,
        lambda acc: F.lit(math.log2(window)) - acc["least"].cast("double") / (_SCALE * window),
    )
    return F.when(F.length(candidate) >= window, F.coalesce(last, F.lit(0.0))).otherwise(F.lit(0.0))


def _is_secret(match: Column, window: int) -> Column:
    def judged(part: Column) -> Column:
        threshold = F.lit(CLASSES[-1][2])
        for _, pattern, bits in reversed(CLASSES[:-1]):
            threshold = F.when(part.rlike(pattern), F.lit(bits)).otherwise(threshold)
        return F.struct(part.alias("part"), (threshold - F.lit(1e-9)).alias("bits"))

    def reaches(x: Column) -> Column:
        # Cuts that overlap by a window less one: every window is in one cut, and a long run takes linear time.
        starts = F.sequence(F.lit(1), F.greatest(F.length(x["part"]) - window + 1, F.lit(1)), F.lit(CUT))
        cut = lambda at: F.substring(x["part"], at, F.lit(CUT + window - 1))
        return F.exists(starts, lambda at: window_entropy(cut(at), window) >= x["bits"])

    long_enough = F.filter(F.split(match, ALLOWED, -1), lambda part: F.length(part) >= window)
    return F.exists(F.transform(long_enough, judged), reaches)


def secret_spans(text: Column, window: int = WINDOW) -> tuple[Column, Column]:
    """The pattern spans and the entropy spans; the kind is its place in ``KINDS``."""
    long_enough = lambda n: lambda m: F.length(m["match"]) >= n
    assign = F.filter(
        _matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= 6
    )
    access = F.filter(_matches(text, ACCESS), long_enough(20))
    base = F.concat(_spans(assign, "assign"), _spans(access, "access"), _spans(_matches(text, HEX), "hex"))
    candidates = F.filter(_matches(text, CANDIDATE), lambda m: _is_secret(m["match"], window))
    return base, _spans(candidates, "entropy")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id, base, spans`` of every text: the pattern spans, and all spans, both sorted by start and kind."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text")
    )
    done = _with_spans(rows, "__text", window)
    return done.select(F.col("__id").alias(id_col), F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def _with_spans(rows: DataFrame, text_col: str, window: int) -> DataFrame:
    base, extra = secret_spans(F.col(f"`{text_col}`"), window)
    # Sorted by start and kind, so that every pattern span that could cover a candidate stands before it.
    every = F.array_sort(F.concat(base.cast(SPAN), extra.cast(SPAN)))
    pattern_end = lambda s: F.when(s["kind"] < KINDS.index("entropy"), s["end"]).otherwise(F.lit(0))

    def uncovered(spans: Column) -> Column:
        ends = running(F.transform(spans, pattern_end), lambda a, b: F.greatest(a, b), F.lit(0))
        return let(ends, lambda e: F.filter(spans, lambda s, i: (s["kind"] < KINDS.index("entropy")) | (F.get(e, i) < s["end"])))

    found = rows.withColumn("__every", every)
    patterns = F.filter("__every", lambda s: s["kind"] < KINDS.index("entropy"))
    kept = F.when(F.size(patterns) == F.size("__every"), F.col("__every")).otherwise(let(F.col("__every"), uncovered))
    return found.withColumns({"__base": patterns, "__spans": kept}).drop("__every")


def redact(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The same rows and columns; every span of a text is replaced by ``[SECRET]``, overlapping spans by one."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = _with_spans(docs.withColumn("__text", text), "__text", window)

    def cut(x: Column) -> Column:
        """The parts that stay, from byte places; ``e``: the largest end up to each span."""
        raw, spans = x["raw"], x["spans"]
        before = lambda e, i: F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1))
        part = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")

        def pieces(e: Column) -> Column:
            kept = F.transform(
                spans, lambda s, i: F.when(s["first"] >= before(e, i), F.concat(part(before(e, i), s["first"]), F.lit("[SECRET]"))).otherwise(F.lit(""))
            )
            return F.concat(F.array_join(kept, ""), part(F.element_at(e, -1), F.octet_length(raw)))

        ends = running(F.transform(spans, lambda s: s["last"]), lambda a, b: F.greatest(a, b), F.lit(0))
        return let(ends, pieces)

    clean = let(F.struct(F.col("__text").cast("binary").alias("raw"), F.col("__spans").alias("spans")), cut)
    new = F.when(F.size("__spans") > 0, clean).otherwise(F.col(f"`{text_col}`"))
    return found.withColumn(text_col, new).select(*[F.col(f"`{c}`") for c in docs.columns])


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
