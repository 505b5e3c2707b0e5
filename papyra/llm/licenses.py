"""License scans as an exact set-similarity join of text blocks with license templates.

A template is a set of words with a containment threshold ``t``: a block meets it if it holds
at least ``o = ceil(t * |template|)`` of the template's distinct words. Words are put in one
global order, rarest first, by how many documents of the whole corpus hold them. Three filters
leave few pairs to count, and lose none:

* prefix: a block that meets the template holds one of the template's first ``|T| - o + 1`` words;
* length: it has at least ``o`` distinct words of the template vocabulary;
* position: once a shared word is found at place ``i`` of the template and ``j`` of the block, the
  overlap is at most one more than what is left after ``i`` and after ``j``.

Only words of the template vocabulary can add to an overlap, so blocks are cut down to these.
Phrases are templates of containment 1 over whole texts; a candidate is verified by looking for
its words at consecutive places. The templates are a bounded list, checked against
``MAX_TEMPLATE_WORDS``, so their index goes to every executor and the corpus is never shuffled:
one pass counts words (partial counts, at most one row per template word and task), one joins.

Blocks are lines and paragraphs (parts between empty lines), so notices that wrap over several
lines are found as well; for templates of several paragraphs also every run of as many paragraphs.
Short notices have to stand in their order: what meets the threshold is verified word by word.

Templates are an argument: a list, or a table (``templates_of``).

Defined results: null and empty texts have no words, no labels and score 0; texts of any length are
scanned whole; repeated rows are judged each; other columns are ignored, whatever their names; an empty table gives an empty
result. Where two templates tie, both labels are given.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import alnum_words, map_rows, text_bytes
from papyra.llm.license_texts import NOTICES, SENTENCES, TEXTS

#: Most distinct words of all templates together; they are held by every worker.
MAX_TEMPLATE_WORDS = 100_000

#: Phrases that must stand consecutively: words and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    containment: float = 0.8
    in_order: bool = False

    @property
    def words(self) -> frozenset[bytes]:
        return frozenset(alnum_words(self.text.encode()))

    @property
    def paragraphs(self) -> int:
        return len(_BLANK_LINE.split(self.text.encode()))


_BLANK_LINE = re.compile(rb"\n[ \t\r]*\n")

TEMPLATES = (
    *(Template(label, text, 1.0, True) for label, text in NOTICES),
    *(Template(label, text) for label, text in SENTENCES),
    *(Template(label, text) for label, text in TEXTS),
)


def templates_of(table: DataFrame) -> tuple[Template, ...]:
    """The templates in a table ``label, text, containment``; at most ``MAX_TEMPLATE_WORDS`` rows."""
    rows = table.select("label", "text", F.col("containment").cast("double")).limit(MAX_TEMPLATE_WORDS + 1).collect()
    if len(rows) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"at most {MAX_TEMPLATE_WORDS} templates are supported")
    return tuple(sorted((Template(r[0], r[1], r[2]) for r in rows if alnum_words((r[1] or "").encode())), key=lambda t: (t.label, t.text)))


def _stands(words: list[bytes], phrase: list[bytes]) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i, w in enumerate(words) if w == phrase[0])


def _word_counter(vocabulary: frozenset[bytes]):
    def fn(texts: list[bytes]):
        found: Counter[bytes] = Counter()
        for t in texts:
            found.update(vocabulary.intersection(alnum_words(t)))
        rows = [[{"word": w.decode(), "n": n} for w, n in found.items()]] + [[]] * (len(texts) - 1)
        return (rows,)

    return fn


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many documents hold each word of a bounded vocabulary."""
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{len(vocabulary)} template words; at most {MAX_TEMPLATE_WORDS} are supported")
    kind = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))
    partial = map_rows(
        docs, [text_bytes(text_col)], T.StructType([T.StructField("found", kind)]), _word_counter, (vocabulary,)
    )
    rows = partial.select(F.explode("found").alias("f")).groupBy("f.word").agg(F.sum("f.n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


class TemplateIndex:
    """Prefixes of the templates in the global order."""

    def __init__(self, templates, phrases, frequency: dict[bytes, int]):
        every = set().union(*[t.words for t in templates], *[alnum_words(p.encode()) for p, _ in phrases])
        order = {w: i for i, w in enumerate(sorted(every, key=lambda w: (frequency.get(w, 0), w)))}
        self.order, self.vocabulary = order, frozenset(every)
        self.templates = []
        self.by_word: dict[bytes, list[tuple[int, int]]] = {}  # prefix word -> (template, place)
        for n, t in enumerate(templates):
            words = sorted(t.words, key=order.__getitem__)
            need = max(1, math.ceil(t.containment * len(words) - 1e-9))
            order_of = alnum_words(t.text.encode()) if t.in_order else None
            self.templates.append((t.label, words, need, order_of, t.paragraphs))
            for place, w in enumerate(words[: len(words) - need + 1]):
                self.by_word.setdefault(w, []).append((n, place))
        self.phrases = []
        self.phrase_words: dict[bytes, list[int]] = {}  # containment 1: the prefix is the rarest word
        for n, (p, label) in enumerate(phrases):
            words = alnum_words(p.encode())
            self.phrases.append((label, words))
            self.phrase_words.setdefault(min(words, key=order.__getitem__), []).append(n)
        self.first = frozenset(self.by_word) | frozenset(self.phrase_words)
        #: The lengths in paragraphs of templates that have several.
        self.runs = sorted({t.paragraphs for t in templates} - {1})

    def block(self, words: list[bytes], paragraphs: int = 1) -> dict[int, float]:
        """The templates that a block meets, with the containment; a run of several paragraphs: templates as long."""
        held = sorted(self.vocabulary.intersection(words), key=self.order.__getitem__)
        own, tried, met = frozenset(held), set(), {}
        for j, w in enumerate(held):
            for n, i in self.by_word.get(w, ()):
                if n in tried:
                    continue
                _, template, need, order_of, long = self.templates[n]
                if paragraphs > 1 and paragraphs != long:
                    continue
                if len(held) < need or min(len(template) - i, len(held) - j) < need:
                    # Rarer words of both sides came first and did not match: nothing before i and j is shared.
                    tried.add(n)
                    continue
                tried.add(n)
                shared = sum(x in own for x in template)
                if shared >= need and (order_of is None or _stands(words, order_of)):
                    met[n] = shared / len(template)
        return met

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(place of the first word, phrase) wherever a phrase's words stand consecutively."""
        held, out = set(words), []
        for w, numbers in self.phrase_words.items():
            if w not in held:
                continue
            for n in numbers:
                phrase = self.phrases[n][1]
                if not held.issuperset(phrase):
                    continue
                at, first = -1, phrase[0]
                while True:
                    try:
                        at = words.index(first, at + 1)
                    except ValueError:
                        break
                    if words[at : at + len(phrase)] == phrase:
                        out.append((at, n))
        return sorted(out)


def _blocks(text: bytes, runs: list[int]):
    """Every block of a text and how many paragraphs it is."""
    paragraphs = _BLANK_LINE.split(text)
    for b in text.split(b"\n"):
        yield b, 1
    for b in paragraphs:
        yield b, 1
    for n in runs:
        for i in range(len(paragraphs) - n + 1):
            yield b"\n".join(paragraphs[i : i + n]), n


def _scanner(templates, phrases, frequency):
    index = TemplateIndex(templates, phrases, frequency)
    first = index.first

    def fn(texts: list[bytes]):
        n_words, places, found, scores = [], [], [], []
        for t in texts:
            words = alnum_words(t)
            n_words.append(len(words))
            if first.isdisjoint(words):
                places.append([])
                found.append([])
                scores.append(0.0)
                continue
            hits = index.places(words)
            places.append([{"word": at, "label": index.phrases[n][0]} for at, n in hits])
            met: dict[int, float] = {}
            for b, paragraphs in _blocks(t, index.runs):
                w = alnum_words(b)
                if not first.isdisjoint(w):
                    for n, c in index.block(w, paragraphs).items():
                        met[n] = max(c, met.get(n, 0.0))
            found.append([{"label": index.templates[n][0], "containment": c} for n, c in sorted(met.items())])
            scores.append(max([1.0] * bool(hits) + list(met.values()), default=0.0))
        return n_words, places, found, scores

    return fn


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_words, places, templates, score`` of every text.

    ``places`` are the phrase hits in order (``word``: place of the first word, from 0; ``label``);
    ``templates`` are the met templates with their best containment over the blocks.
    """
    vocabulary = frozenset().union(*[t.words for t in templates], *[alnum_words(p.encode()) for p, _ in phrases])
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), text_bytes(text_col).alias("__text"))
    frequency = word_frequencies(rows, vocabulary, "__text")
    place = T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())])
    met = T.StructType([T.StructField("label", T.StringType()), T.StructField("containment", T.DoubleType())])
    out = T.StructType(
        [
            T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place)),
            T.StructField("templates", T.ArrayType(met)), T.StructField("score", T.DoubleType()),
        ]
    )
    done = map_rows(rows, [F.col("__text")], out, _scanner, (templates, phrases, frequency), keep=["__id"])
    return done.withColumnRenamed("__id", id_col)
