"""Piece encoding and decoding that keep track of original byte spans.

A model file is read as it is: pieces, scores and the compiled character map (a double-array
trie over UTF-8 keys and a block of replacements). Normalising takes the longest key of the
map at each place, records for every normalised byte the original byte it came from, and
writes blanks as U+2581. Merging repeatedly joins the adjacent pair whose joined piece has the
best score (ties: the leftmost); symbols without a piece fall back to byte pieces. Every piece
is projected back through the alignment to a span of original bytes.

No merge can join two characters that stand side by side in no piece. Texts are cut at blanks
and words at such places, and what is merged once is kept in bounded memos. Where a vocabulary
has a piece with an inner blank, texts are not cut at blanks.

Defined results: null and empty texts give only the begin and end ids and decode to the empty
text; repeated rows are encoded each; other columns of the input are ignored, whatever their
names; an empty table gives an empty result. A text of any length is encoded whole: a part between two
places that no merge joins takes n log n steps.
"""

from __future__ import annotations

import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import Memo, map_rows, text_bytes
from papyra.llm.pairmerge import BITS, merge

BLANK = "▁"
#: Words that one worker remembers.
MEMO_WORDS = 200_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """The (number, value) pairs of one protocol-buffer message."""
    i, n = 0, len(raw)

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            c = raw[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            value = raw[i : i + size]
            i += size
        yield key >> 3, value


class CharMap:
    """Longest-prefix replacement through a compiled character map; empty: the identity."""

    def __init__(self, blob: bytes = b""):
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]
        else:
            self.units, self.texts = (), b""
        first = [b for b in range(1, 256) if self._step(0, b) is not None] if self.units else []
        self.first = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in first) + b"]") if first else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        at = node ^ self._offset(self.units[node]) ^ byte
        return at if at < len(self.units) and self.units[at] & (1 << 31 | 0xFF) == byte else None

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest key at ``at`` and its replacement."""
        node, found = 0, None
        for i in range(at, len(raw)):
            node = self._step(node, raw[i])
            if node is None:
                break
            if self.units[node] >> 8 & 1:
                value = self.units[node ^ self._offset(self.units[node])] & 0x7FFFFFFF
                found = i + 1 - at, value
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    def apply(self, raw: bytes) -> tuple[bytes, np.ndarray | None]:
        """The replaced bytes and, for each of them and the end, the original offset (None: unchanged)."""
        if self.first is None or not self.first.search(raw):
            return raw, None
        out, align, at = bytearray(), [], 0

        def plain(to: int):
            out.extend(raw[at:to])
            align.append(np.arange(at, to))

        for m in self.first.finditer(raw):
            if m.start() < at:
                continue
            hit = self.longest(raw, m.start())
            if hit:
                plain(m.start())
                out.extend(hit[1])
                align.append(np.full(len(hit[1]), m.start()))
                at = m.start() + hit[0]
        plain(len(raw))
        return bytes(out), np.concatenate([*align, [len(raw)]])


class PieceModel:
    """Encodes and decodes with one piece model of merge type."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.pieces: list[tuple[str, float, int]] = []
        norm: dict[int, object] = {}
        trainer: dict[int, object] = {}
        for number, value in model:
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("only merge-type models with blanks before words are supported")
        if any(k in (USER_DEFINED, UNUSED) for _, _, k in self.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.map = CharMap(norm.get(2, b""))
        self.prefix, self.trim, self.escape = norm.get(3, 1), norm.get(4, 1), norm.get(5, 1)
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = next(i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN)
        control = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == CONTROL}
        self.begin, self.end = control.get("<s>", -1), control.get("</s>", -1)
        longer = [p for p in self.ids if len(p) > 1]
        joined = set().union(*map(set, longer)) if longer else set()
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in longer)
        #: A symbol is a number for each piece and each character within one; 0: any other character.
        self.symbol = {s: n for n, s in enumerate(dict.fromkeys([*self.ids, *joined]), 1)}
        scores = {x: r for r, x in enumerate(sorted({self.pieces[i][1] for i in self.ids.values()}, reverse=True))}
        self.pairs: dict[int, int] = {}
        for p in longer:
            for at in range(1, len(p)):
                a, b = self.symbol.get(p[:at]), self.symbol.get(p[at:])
                if a and b:
                    self.pairs[a << BITS | b] = scores[self.pieces[self.ids[p]][1]] << BITS | self.symbol[p]
        #: No merge joins two characters that stand side by side in no piece: texts are cut there.
        self.joins = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        self.packed = {p: struct.pack("<I", i) for p, i in self.ids.items()}
        sizes = [1 if k == BYTE else len(p.encode()) for p, _, k in self.pieces]
        blanks = [0 if k == BYTE else p.count(BLANK) for p, _, k in self.pieces]
        #: Bytes of a piece in normalised text, with blanks of three bytes, or of one as they are before.
        self.sizes = np.array(sizes, dtype=np.int64)
        self.plain_sizes = self.sizes - 2 * np.array(blanks, dtype=np.int64)
        self.words = Memo(self._word, memo_words)
        self.parts = Memo(self._merge, memo_words)

    def _merge(self, text: str) -> bytes:
        """The packed ids of the pieces of one part."""
        get, n = self.symbol.get, len(text)
        after = merge([get(c, 0) for c in text], self.pairs)[1]
        at, found = 0, []
        while at < n:
            end = after[at]
            found.append(text[at:end])
            at = end
        packed = self.packed
        try:
            return b"".join([packed[s] for s in found])
        except KeyError:  # some symbol has no piece
            pass
        ids = []
        for s in found:
            known = self.ids.get(s)
            if known is not None:
                ids.append(known)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in s.encode())
            else:
                raise ValueError("models without byte pieces are not supported")
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, text: str) -> bytes:
        joins = self.joins
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joins]
        if not cuts:
            return self._merge(text)
        return b"".join([self.parts[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])

    def _joined(self, ids: list[int]) -> str:
        out: list[str] = []
        held = bytearray()

        def flush():
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()

        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            flush()
            piece, _, kind = self.pieces[i]
            out.append("" if kind == CONTROL else " ⁇ " if kind == UNKNOWN else piece.replace(BLANK, " "))
        flush()
        return "".join(out)

    def normalise(self, raw: bytes) -> tuple[str, np.ndarray | None]:
        """The normalised text and the original offset of each of its bytes (None: see ``encode``)."""
        done, align = self.map.apply(raw)
        if self.trim:
            align = np.arange(len(done) + 1) if align is None else align
            keep = [i for m in re.finditer(rb"[^ ]+", done) for i in ([m.start() - 1] if m.start() else []) + list(range(*m.span()))]
            keep = keep[1:] if keep and done[keep[0]] == 0x20 else keep
            done, align = bytes(done[i] for i in keep), np.append(align[keep], align[-1:])
        return done.decode("utf-8", "replace"), align

    def encode(self, raw: bytes, spans: bool = True):
        """``(ids, starts, ends, decoded)``: packed 32-bit ids with begin and end, and byte spans.

        The spans are of original bytes, for each id but the begin and end ids. Bytes that the
        map takes away belong to the piece before them; the blank that is put before the text has
        no bytes of its own.
        """
        text, align = self.normalise(raw)
        head, tail = (struct.pack("<I", i) if i >= 0 else b"" for i in (self.begin, self.end))
        if not text:
            return head + tail, b"", b"", ""
        look = self.words.__getitem__
        # Pieces, and byte pieces of symbols without one, give back what they were made from: only blanks differ.
        if not self.by_word or not self.escape:
            full = (BLANK if self.prefix else "") + (text.replace(" ", BLANK) if self.escape else text)
            ids, decoded = self._word(full), full.replace(BLANK, " ")
        elif self.prefix and "  " not in text and BLANK not in text and text[0] != " " and text[-1] != " ":
            ids, decoded = b"".join([look(BLANK + w) for w in text.split(" ")]), " " + text
        else:
            full = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
            ids = b"".join([look(w) for w in re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", full)])
            decoded = full.replace(BLANK, " ")
        if self.prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        if not spans:
            return head + ids + tail, b"", b"", decoded
        numbers = np.frombuffer(ids, np.uint32)
        if not self.escape:
            ends = np.cumsum(self.sizes[numbers])
        elif BLANK not in text:
            ends = np.cumsum(self.plain_sizes[numbers])
            if self.prefix:
                ends = np.maximum(ends - 1, 0)  # the blank put before the text has no bytes
        else:
            # Some of the three-byte blanks are the text's own: count them back one by one.
            ends = np.cumsum(self.sizes[numbers])
            if self.prefix:
                ends = np.maximum(ends - 3, 0)
            blanks = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 0x20)
            if blanks.size:
                grown = blanks + 2 * np.arange(1, blanks.size + 1)  # where each written blank's last byte is
                ends = ends - 2 * np.searchsorted(grown, ends - 1, side="right")
        if align is not None:
            ends = align[np.minimum(ends, len(align) - 1)]
        ends = ends.astype("<u4")
        starts = np.empty_like(ends)
        starts[0], starts[1:] = (0 if align is None else align[0]), ends[:-1]
        return head + ids + tail, starts.tobytes(), ends.tobytes(), decoded

    def decode(self, ids: list[int]) -> str:
        out = self._joined(ids)
        return out[1:] if self.prefix and out.startswith(" ") else out


def _encoder(path: str):
    model = PieceModel(path)

    def fn(texts: list[bytes]):
        made = [model.encode(t) for t in texts]
        return (
            [len(m[0]) // 4 for m in made], [m[0] for m in made], [m[1] for m in made], [m[2] for m in made],
            [m[3] for m in made],
        )

    return fn


def encode_pieces(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_tokens, ids, starts, ends, decoded`` of every text.

    ``ids``, ``starts`` and ``ends`` are packed little-endian unsigned 32-bit integers; the spans
    are original byte offsets, for each id but the begin and end ids. ``model`` is a path that is
    valid on each executor.
    """
    out = T.StructType(
        [
            T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
            T.StructField("starts", T.BinaryType()), T.StructField("ends", T.BinaryType()),
            T.StructField("decoded", T.StringType()),
        ]
    )
    made = map_rows(
        docs.select(F.col(f"`{id_col}`").alias("__id"), text_bytes(text_col).alias("__text")),
        [F.col("__text")], out, _encoder, (model,), keep=["__id"],
        token=f"pieces {model}",
    )
    return made.withColumnRenamed("__id", id_col)
