"""Token counts by byte-pair merging over a heap and a linked list.

A text is cut at added tokens, then into words by the byte-level pattern. Each word starts
as its UTF-8 bytes in a doubly linked list; a heap holds the adjacent pairs that may merge.
The lowest rank is popped (ties: the leftmost), stale pairs are skipped, a merge links its
neighbours anew and pushes two pairs. The count is the initial symbols minus the merges, so
no identifiers are built or emitted. Counts of words are kept in a bounded memo.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
each; other columns of the input are ignored, whatever their names; an empty table gives an
empty result. A word of any length takes n log n steps.
"""

from __future__ import annotations

import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import Memo, map_rows, text_bytes
from papyra.llm.pairmerge import BITS, merge

#: Words whose count one worker remembers.
MEMO_WORDS = 500_000

#: Code points that newer Unicode tables call letters or numbers, while the vocabulary's
#: library, built on older tables, does not: ranges in hexadecimal, found by encoding every code point between
#: two letters with both (a word that is cut there is one more token) and comparing.
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 "
    "1b168-1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 "
    "1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)


def _word_pattern() -> regex.Pattern:
    new = "".join(
        f"\\U{int(a, 16):08x}-\\U{int(b or a, 16):08x}" for a, _, b in (r.partition("-") for r in NEWER.split())
    )
    letter, number = f"[\\p{{L}}--[{new}]]", f"[\\p{{N}}--[{new}]]"
    other = f"[[^\\s\\p{{L}}\\p{{N}}]||[{new}]]"
    return regex.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\\s+(?!\\S)|\\s+", regex.V1
    )


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class PairMerger:
    """Counts the tokens of texts for one byte-level pair vocabulary file."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, pre, model = spec["model"]["type"], spec["pre_tokenizer"] or {}, spec["model"]
        if kind != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level pair vocabularies without a normaliser are supported")
        if pre.get("add_prefix_space") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("prefix blanks, ignored merges and dropout are not supported")
        numbers = {s: b for b, s in enumerate(_byte_symbols())}  # a byte is its own symbol
        number = lambda s: numbers.setdefault(s, len(numbers))
        self.pairs: dict[int, int] = {}
        for rank, merged in enumerate(model["merges"]):
            a, b = merged if isinstance(merged, list) else merged.split(" ")
            self.pairs.setdefault(number(a) << BITS | number(b), rank << BITS | number(a + b))
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take in blanks are not supported")
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.words = _word_pattern()
        self.memo = Memo(self.count_word, memo_words)

    def count_word(self, word: str) -> int:
        """Tokens of one word: its bytes minus the merges that the heap yields."""
        raw = word.encode("utf-8", "surrogatepass")
        n = len(raw)
        if n < 2:
            return n
        return n - merge(list(raw), self.pairs)[0]

    def count(self, text: str) -> int:
        parts = self.added.split(text) if self.added else [text]
        look, find = self.memo.__getitem__, self.words.findall
        return len(parts) - 1 + sum(sum(map(look, find(p))) for p in parts)


def _counter(path: str):
    merger = PairMerger(path)

    def fn(texts: list[bytes]):
        return [len(t) for t in texts], [merger.count(t.decode("utf-8", "replace")) for t in texts]

    return fn


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every text; ``vocabulary`` is a path on each executor."""
    out = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = map_rows(
        docs.select(F.col(f"`{id_col}`").alias("__id"), text_bytes(text_col).alias("__text")),
        [F.col("__text")], out, _counter, (vocabulary,), keep=["__id"],
        token=f"pair counts {vocabulary}",
    )
    return counted.select(
        F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
