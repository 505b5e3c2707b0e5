import struct

import public_tokenizers
import pytest
import sentencepiece
from papyra.llm import pieces, tokencount
from papyra.llm.pieces import CharMap, PieceModel
from papyra.llm.queries import op1_token_counts, op8_piece_encoding
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
STRANGE = [
    "", " ", "  a ", "▁a", "a▁", "a  b   c", "\n\n a\n", "<s></s><0x0A>", "\x00a\tb", "it's 'S don't",
    "<|endoftext|>a <|endoftext|>", "՘a՘", "\U000323b0b", "日本語\U0001f600　x", "x" * 3000,
    "café\r\nnaïve", "ﬁ ① Å", "a" * 500 + " " * 500,
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_like_the_library(reference):
    merger = tokencount.PairMerger(VOCABULARY)
    assert [merger.count(t) for t in STRANGE] == [len(reference.encode(t, add_special_tokens=False).ids) for t in STRANGE]


def test_count_query_on_whole_texts(spark, documents, reference):
    got = {r["doc_id"]: r for r in op1_token_counts(spark, SF).collect()}
    for r in documents.collect():
        n = len(reference.encode(r["text"], add_special_tokens=False).ids)
        assert got[r["doc_id"]][1:] == (len(r["text"].encode()), n, n > 512)


def test_counts_of_odd_rows(odd, none, reference):
    rows = tokencount.count_tokens(odd, VOCABULARY).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows:
        assert r["n_tokens"] == len(reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
    assert tokencount.count_tokens(none, VOCABULARY).count() == 0


def test_pieces_like_the_library(library):
    model = PieceModel(MODEL)
    for t in STRANGE:
        ids, starts, ends, decoded = model.encode(t.encode())
        want = library.encode(t, add_bos=True, add_eos=True)
        assert ids == struct.pack(f"<{len(want)}I", *want), t
        assert decoded == library.decode(want) == model.decode(want), t
        starts, ends = (struct.unpack(f"<{len(b) // 4}I", b) for b in (starts, ends))
        assert len(starts) == len(want) - 2
        if starts:  # the spans cover the original bytes without a gap
            assert starts[0] == 0 and ends[-1] == len(t.encode()) and starts[1:] == ends[:-1]


def test_spans_hold_the_pieces(library):
    text = "The café at\nthe  corner, open."
    raw, model = text.encode(), PieceModel(MODEL)
    ids, starts, ends, _ = model.encode(raw)
    ids, starts, ends = (struct.unpack(f"<{len(b) // 4}I", b) for b in (ids, starts, ends))
    for i, a, b in zip(ids[1:-1], starts, ends, strict=True):
        if i not in model.byte_of:
            piece = model.pieces[i][0].replace("▁", " ").encode()
            assert raw[a:b] in (piece, piece[1:])


def test_small_vocabulary_limit_gives_the_same():
    small, large = PieceModel(MODEL, memo_words=3), PieceModel(MODEL)
    for t in STRANGE:
        assert small.encode(t.encode()) == large.encode(t.encode())


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
def test_compiled_character_map(rule):
    """Longest-prefix replacement through a real compiled map, and the way back to original bytes."""
    other = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False
    )
    spec = dict(pieces._fields(next(v for n, v in pieces._fields(other.serialized_model_proto()) if n == 3)))
    chars = CharMap(spec[2])
    for t in [*STRANGE, "ﬃ ＡＢＣ ẛ̣", "ガ é ½"]:
        done, align = chars.apply(t.encode())
        if "\x00" not in t:
            assert done.decode() == other.normalize(t), t
        if align is not None:
            assert len(align) == len(done) + 1 and align[-1] == len(t.encode())
            assert (align[1:] >= align[:-1]).all()


def test_piece_query_on_whole_texts(spark, documents, library):
    import hashlib

    got = {r["doc_id"]: r for r in op8_piece_encoding(spark, SF).collect()}
    for r in documents.collect():
        ids = library.encode(r["text"], add_bos=True, add_eos=True)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want = (len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(library.decode(ids).encode()))
        assert got[r["doc_id"]][1:] == want


def test_pieces_of_odd_rows(odd, none, library):
    rows = pieces.encode_pieces(odd, MODEL).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(rows) == len(odd.collect())
    for r in rows:
        want = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(want) and r["decoded"] == library.decode(want)
    assert pieces.encode_pieces(none, MODEL).count() == 0
    assert pieces.encode_pieces(odd.withColumn("ids", F.lit(1)), MODEL).columns[0] == "doc_id"
