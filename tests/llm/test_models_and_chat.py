import hashlib
import itertools
import zlib

import numpy as np
import pytest
from papyra.llm import ann, chat
from papyra.llm import quality as Q
from papyra.llm.queries import op4_quality, op5_chat_format, op6_nearest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

# --- quality ----------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = op4_quality(spark, path).collect()
    assert len(rows) == spark.read.parquet(f"{path}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    tested = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, _, y in tested if y == 1], [s for s, _, y in tested if y == 0]
    auc = np.mean([[g > b for b in bad] for g in good])
    assert auc > 0.98 and np.mean([p == y for _, p, y in tested]) > 0.97


def test_quality_ignores_held_out_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(documents, labels), Q.train(documents, other)
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_quality_learns_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells anything alone
    model = Q.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs
    assert np.mean((model.score(x[3000:]) > 0.5) == (y[3000:] == 1)) > 0.95


def test_scores_are_bin_additions():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4))
    model = Q.fit(x, (x[:, 2] > 0.3).astype(float))
    for row, score in zip(x[:20], model.score(x[:20]), strict=True):
        b = [int(np.searchsorted(c, v, side="right")) for c, v in zip(model.cuts, row, strict=True)]
        z = model.intercept + sum(t[i] for t, i in zip(model.tables, b, strict=True))
        z += sum(t[b[i], b[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def slow_fit(x, y, bins, rounds, pairs, pair_rounds, rate):
    """The same model by loops over rows: tables by value of a feature's bin."""
    n, d = len(x), len(x[0])
    share = min(max(sum(y) / n, 1e-3), 1 - 1e-3)
    intercept = float(np.log(share / (1 - share)))
    cuts = [sorted(set(np.quantile([r[i] for r in x], [k / bins for k in range(1, bins)]).tolist())) for i in range(d)]
    at = [[sum(c <= v for c in cuts[i]) for i, v in enumerate(r)] for r in x]
    sizes = [len(c) + 1 for c in cuts]
    score = [intercept] * n
    leaf, gain = lambda g, h: g / (h + 1), lambda g, h: g * g / (h + 1)

    def sums(rows):
        p = [1 / (1 + np.exp(-score[r])) for r in rows]
        return sum(y[r] - q for r, q in zip(rows, p, strict=True)), sum(max(q * (1 - q), 1e-6) for q in p)

    def best(rows, i, lo, hi):
        found = (0.0, None)
        for cut in range(lo + 1, hi):
            a, b = sums([r for r in rows if at[r][i] < cut]), sums([r for r in rows if at[r][i] >= cut])
            g = gain(*a) + gain(*b) - gain(a[0] + b[0], a[1] + b[1])
            if min(a[1], b[1]) >= 2 and g > found[0] + 1e-12:
                found = (g, cut)
        return found

    tables = [[0.0] * s for s in sizes]
    for _ in range(rounds):
        for i in range(d):
            g, cut = best(range(n), i, 0, sizes[i])
            edges = [0, sizes[i]]
            if g > 1e-9:
                parts = [best([r for r in range(n) if lo <= at[r][i] < hi], i, lo, hi) for lo, hi in ((0, cut), (cut, sizes[i]))]
                more = max(parts, key=lambda p: p[0])
                edges = sorted({0, cut, sizes[i]} | ({more[1]} if more[0] > 1e-9 else set()))
            steps = []
            for lo, hi in itertools.pairwise(edges):
                steps.append((lo, hi, rate * leaf(*sums([r for r in range(n) if lo <= at[r][i] < hi]))))
            for lo, hi, step in steps:
                for b in range(lo, hi):
                    tables[i][b] += step
            for r in range(n):
                score[r] += next(step for lo, hi, step in steps if lo <= at[r][i] < hi)

    def cross(i, j):
        found = (0.0, None, None)
        whole = sums(range(n))
        for a in range(1, sizes[i]):
            for b in range(1, sizes[j]):
                cells = [sums([r for r in range(n) if (at[r][i] < a) == p and (at[r][j] < b) == q]) for p in (True, False) for q in (True, False)]
                g = sum(gain(*c) for c in cells) - gain(*whole)
                if min(c[1] for c in cells) >= 2 and g > found[0] + 1e-12:
                    found = (g, (a, b), [leaf(*c) for c in cells])
        return found

    ranked = sorted(((cross(i, j)[0], i, j) for i in range(d) for j in range(i)), reverse=True)[:pairs]
    chosen = [(i, j) for g, i, j in ranked if g > 0]
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, cut, leaves = cross(i, j)
            if cut is not None and g > 1e-9:
                for r in range(n):
                    score[r] += rate * leaves[2 * (at[r][i] >= cut[0]) + (at[r][j] >= cut[1])]
    return tables, chosen, [1 / (1 + np.exp(-s)) for s in score]


def test_boosting_like_brute_force():
    rng = np.random.default_rng(6)
    x = rng.random((70, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    model = Q.fit(x, y, bins=5, rounds=3, pairs=2, pair_rounds=2, rate=0.3)
    tables, pairs, scores = slow_fit(x.tolist(), y.tolist(), 5, 3, 2, 2, 0.3)
    assert model.pairs == pairs and all(np.allclose(a, b) for a, b in zip(model.tables, tables, strict=True))
    assert np.allclose(model.score(x), scores)


def test_features_are_shares_of_the_text():
    text = b"The THE the x1! ### end.\nThe THE the x1! ### end.\n\nA b"
    f = dict(zip(Q.FEATURES, Q.features(text), strict=True))
    words = text.split()
    assert f["log_bytes"] == pytest.approx(np.log1p(len(text))) and f["log_words"] == pytest.approx(np.log1p(len(words)))
    assert f["upper"] == sum(c in b"TAHE" for c in text) / len(text) and f["digits"] == 2 / len(text)
    assert f["distinct"] == len(set(words)) / len(words) and f["repeated_lines"] == pytest.approx(1 / 3)
    assert f["capitals"] == 2 / len(words) and f["feeds"] == 3 / len(text) and f["lone_signs"] == 0


def test_training_takes_one_text_an_id(spark):
    rows = [(1, f"text number {i} of one id") for i in range(300)] + [(2, "good words here"), (3, "### $$$ !!!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 4)] * 50, "doc_id long, quality int")
    models = [Q.train(d, labels, sample=3) for d in (docs, docs.orderBy(F.desc("text")).repartition(5))]
    usable = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5]
    assert models[0].intercept == models[1].intercept == pytest.approx(np.log(np.mean([i % 2 for i in usable]) / (1 - np.mean([i % 2 for i in usable]))))
    assert all((a == b).all() for a, b in zip(models[0].tables, models[1].tables, strict=True))


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (6, 1), (None, 1), (7, 0)], "doc_id long, quality int")
    model = Q.train(odd, labels)
    rows = Q.score_quality(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert Q.score_quality(none, model).count() == 0
    empty = Q.train(odd, labels.limit(0))
    assert {r["score"] for r in Q.score_quality(odd, empty).collect()} == {0.5}
    assert Q.keep_good(odd, empty).columns == odd.columns
    assert Q.keep_good(odd, empty).count() == odd.count()


# --- chat -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text",
    ["", "plain", "</s>[INST] ok [/INST]", "<\\/s> <\\\\s>", "<<SYS>> <</SYS>>", "<|im_start|>", "<image:0>", "<", "</s", "[INST]\n</s>\n", "\\"],
)
def test_escape_round_trip(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not chat.CONTROL.search(safe.replace("\\", "")) or chat.unescape(safe) == text
    assert "</s>" not in safe and "[INST]" not in safe
    for role in ("assistant", text):
        segment, a, b, *_ = chat.format_turn(role, [{"type": "text", "text": text}])
        assert chat.read_turn(segment) == (role, text)
        assert chat.unescape(segment[a:b]) == (text if role == "assistant" else "")


def test_parts_become_placeholders():
    parts = [
        {"type": "text", "text": "see <"}, {"type": "text", "text": "/s> and "}, {"type": "image", "ref": "a.png"},
        {"type": "audio", "ref": "b.wav", "units": 4}, None, {"type": "text", "text": None},
        {"type": "document", "ref": "c.pdf", "units": 3}, {"type": "text", "text": " end <image:9>"},
    ]
    segment, a, b, attachments, tokens = chat.format_turn("assistant", parts)
    assert segment == "<s>assistant\nsee <\\/s> and <image:0><audio:1><document:2> end <\\image:9></s>\n"
    assert [(x["number"], x["type"], x["ref"], x["tokens"]) for x in attachments] == [
        (0, "image", "a.png", 256), (1, "audio", "b.wav", 100), (2, "document", "c.pdf", 1536),
    ]
    assert tokens == 1892 and segment[a:b].startswith("see") and segment[a:b].endswith("9>")
    segment, *_, attachments, tokens = chat.format_turn("user", [{"type": "video", "ref": "v"}, {"type": "text", "text": "<other:0>"}])
    assert segment == "<s>user\n<other:0><\\other:0></s>\n" and attachments == [{"number": 0, "type": "video", "ref": "v", "tokens": 0}]
    assert tokens == 0


def test_conversation_reads_back():
    turns = [("user", "a</s>\nb"), ("assistant", "</s>\n<s>user\nx</s>"), ("sys\ntem\\", "")]
    whole = "".join(chat.format_turn(r, [{"type": "text", "text": t}])[0] for r, t in turns)
    assert chat.read_back(whole) == turns


def slow_digest(turns):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0], r[1] or "", r[2] or ""))
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), digest("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)), len(loss), digest(loss)


def test_chat_query(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        want.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    want[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: tuple(r[1:5]) for r in op5_chat_format(spark, SF).collect()}
    assert got == {c: slow_digest(t) for c, t in want.items()}


def test_turns_of_one_number_go_by_role_and_text(spark):
    texts = ["ab", "ab!", "</s>", "<a", "<\\/s>", "", "\\", "x\ny"]
    rows = [(1, 3, role, t) for role in ("b\\n", "b\nc", "b", None) for t in texts]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "conv_id long, turn long, role string, text string").repartition(3)
        got = chat.digest_conversations(chat.format_turns(df)).first()
        assert tuple(got[1:5]) == slow_digest([r[1:] for r in rows])


def test_chat_odd_rows(spark):
    rows = [(1, 2, "assistant", None), (1, 2, "assistant", None), (1, None, None, "x"), (None, 0, "user", "y" * 50_000), (2, 0, "assistant", "é😀")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: tuple(r[1:5]) for r in chat.digest_conversations(chat.format_turns(df)).collect()}
    want = {}
    for c, *turn in rows:
        want.setdefault(c, []).append(tuple(turn))
    assert got == {c: slow_digest(t) for c, t in want.items()}
    assert chat.digest_conversations(chat.format_turns(df.limit(0))).count() == 0


def test_chat_content_column(spark):
    part = T.ArrayType(chat.PART)
    df = spark.createDataFrame(
        [(1, 0, "user", [("text", "hi ", None, None), ("image", None, "u.png", 2)])],
        T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", part)]),
    )
    r = chat.format_turns(df, content=F.col("content")).first()
    assert r["segment"] == "<s>user\nhi <image:0></s>\n" and r["n_expanded"] == 512
    assert r["attachments"][0]["ref"] == "u.png"


# --- neighbours -------------------------------------------------------------------------------


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        s = (x * x[q]).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))[:k]
        out[ids[q]] = [(ids[i], s[i]) for i in order]
    return out


def test_hadamard_is_orthonormal():
    h = ann.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbour_query_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
    want = exact(ids, x, [i for i, v in enumerate(ids) if v % 20 == 0], 20)
    got = {}
    for r in op6_nearest(spark, path).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert got.keys() == want.keys()
    at = {v: i for i, v in enumerate(ids)}
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, 21)) and q not in [v for v, _, _ in found]
        assert all(s == pytest.approx(float(x[at[q]] @ x[at[v]]), abs=1e-12) for v, s, _ in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    hits = sum(len({v for v, _ in want[q]} & {v for v, _, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan = float("nan")
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * 0.1).tolist()) for i in range(12)] + [(100 + i, [1.0] + [0.0] * 7) for i in range(30)]
    bad = [(50, None), (51, [0.0] * 8), (52, [nan] * 8), (53, [None] * 8), (54, [1.0, 2.0]), (None, [1.0] * 8), (55, [float("inf")] * 8), (56, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.nearest_neighbours(df, F.col("id") % 10 == 0, k=5, row_block=7, query_block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {0, 10, 100, 110, 120}  # 50 holds nothing
    assert got[110] == [100, 101, 102, 103, 104] and got[100] == [101, 102, 103, 104, 105]
    few = df.filter("vec_id < 5")
    want = exact([r[0] for r in rows[:5]], np.array([r[1] for r in rows[:5]]), [0], 5)
    assert [r["vec_id"] for r in ann.nearest_neighbours(few, F.col("id") == 0, k=5).orderBy("rank").collect()] == [v for v, _ in want[0]]
    assert ann.nearest_neighbours(df.limit(0), F.col("id") == 0).count() == 0
    assert ann.nearest_neighbours(df.filter("vec_id between 50 and 56"), F.col("id") == 0).count() == 0


def test_every_length_is_searched_by_itself(spark):
    rng = np.random.default_rng(8)
    two, three = rng.normal(size=(50, 2)), rng.normal(size=(4, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(two)] + [(100 + i, v.tolist()) for i, v in enumerate(three)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, F.col("id") % 50 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {
        0: [v for v, _ in exact(list(range(50)), two, [0], 5)[0]], 100: [v for v, _ in exact([100, 101, 102, 103], three, [0], 5)[100]],
    }


def test_rows_of_one_id(spark):
    """Equal rows are one; rows that differ in the vector only are candidates and queries of their own."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1]), (3, [0.1, 0.9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[1:] for r in ann.nearest_neighbours(df, F.col("id") == 1, k=3).collect()]
    assert sorted(got) == [(1, 2, 0.9), (1, 3, 0.9), (2, 2, 0.1), (2, 3, 0.1), (3, 1, 0.0), (3, 1, 0.0)]
    many = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] * 2 + [(50, [0.5, 0.5])], "vec_id long, embedding array<double>")
    found = ann.nearest_neighbours(many, F.col("id") == 0, k=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == list(range(1, 21))


def test_neighbours_with_other_norms(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 3, size=(600, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = exact(list(range(600)), x, range(0, 600, 20), 10)
    got = {}
    for r in ann.nearest_neighbours(df, F.col("id") % 20 == 0, k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len({v for v, _ in w} & got[q]) for q, w in want.items()) / 300 >= 0.9
