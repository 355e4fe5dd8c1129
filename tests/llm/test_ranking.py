"""Hard negatives, quality ranking, lexical search."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylane.llm import hard_negatives, lexical, quality, queries

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------ lexical search
def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _search(docs, items, k):
    """By the contract's formulas, document by document."""
    words = [(d, _terms(t)) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(x for _, w in words for x in set(w))
    out = []
    for item, text in items:
        hits = []
        for d, w in words:
            tf, score = Counter(w), 0
            for t in set(_terms(text)) & tf.keys():
                m = 100 - 50 + (50 * len(w) * n_docs) // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                hits.append((-score, d is not None, d or 0, d))
        out += [(item, i + 1, h[3], -h[0]) for i, h in enumerate(sorted(hits)[:k])]
    return sorted(out, key=str)


def _random_docs(n, seed=1):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)] + ["Äß", "日本", "x-y", "A1", "a1"]
    p = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(r.choice(words, int(r.integers(0, 30)), p=p / p.sum())) for _ in range(n)]
    texts[3], texts[4], texts[5], texts[6] = None, "", "!!! \n\t", texts[7]
    texts[8] = "w1 w2, " * 20_000
    return [(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (1, texts[1])]


@pytest.mark.parametrize("k", [3, 50])
def test_search_equals_the_formulas(spark, monkeypatch, k):
    docs = _random_docs(200)
    items = [(1, "w1 W3 a1; w3"), (2, "日本 Äß w39 w38"), (3, None), (4, ""), (5, "never seen"), (6, "w0 w0"), (1, "w5"), (None, "w7 x")]
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("score"), F.lit("z").alias("item_id"), F.lit(0).alias("n"))
    i = spark.createDataFrame(items, "item_id int, text string").withColumn("rank", F.lit(7))
    for block in (1 << 20, 8):
        monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
        got = sorted((tuple(r) for r in lexical.search(d.repartition(5), i, k).collect()), key=str)
        assert got == _search(docs, items, k)
    assert lexical.search(d, i, k).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(d.limit(0), i).count() == 0 and lexical.search(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("first", [1, 7, 1000])
def test_nra_finds_members_ties_and_scores(monkeypatch, first):
    monkeypatch.setattr(lexical, "FIRST_READ", first)
    r = np.random.default_rng(first)
    for _ in range(150):
        docs, k = int(r.integers(1, 60)), int(r.integers(1, 12))
        total, lists = np.zeros(docs, np.int64), []
        for _ in range(int(r.integers(0, 7))):
            ids = np.flatnonzero(r.random(docs) < r.random())
            gain = r.integers(1, 6, len(ids)).astype(np.int64)
            total[ids] += gain
            order = np.lexsort((ids, -gain))
            lists.append((ids[order], gain[order]))
        floor = int(r.integers(1, 8))
        want = [d for d in np.lexsort((np.arange(docs), -total)) if total[d] >= floor][:k]
        ids, scores = lexical.nra(lists, docs, k, floor)
        assert ids.tolist() == want and scores.tolist() == total[want].tolist()


def test_shards_of_a_task_agree_with_one(monkeypatch):
    r = np.random.default_rng(0)
    rows = [(i, [int(t) for t in sorted(r.choice(6, 3, replace=False))], [1, 2, 3]) for i in range(500)]
    batch = lexical.pa.RecordBatch.from_arrays([lexical.pa.array([x[0] for x in rows]), lexical.pa.array([10 + x[0] % 3 for x in rows], lexical.pa.int64()),
                                                lexical.pa.array([x[1] for x in rows], lexical.pa.list_(lexical.pa.int32())),
                                                lexical.pa.array([x[2] for x in rows], lexical.pa.list_(lexical.pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    class Model:
        value = ([[0, 1], [5], [2, 3, 4]], np.array([3, 1, 4, 1, 5, 9]), 500, 5500)
    out = []
    for docs in (1 << 15, 64):
        monkeypatch.setattr(lexical, "SHARD_DOCS", docs)
        out.append([b.to_pylist() for b in lexical._search(Model, 20)([batch])])
    assert out[0] == out[1] and [len(x) for x in out[0]] == [20, 20, 20]


# ------------------------------------------------------------ hard negatives
def _mine(rows, k=5):
    """rows: id, label, integer vector."""
    out = []
    for a, la, qa in rows:
        if a % 100:
            continue
        score = {x: sum(p * q for p, q in zip(qa, qx)) for x, _, qx in rows if x != a}
        label = {x: lx for x, lx, _ in rows}
        best = sorted(score, key=lambda x: (-score[x], x))
        for p in [x for x in best if label[x] == la][:k]:
            fit = [x for x in best if label[x] != la and 80 * score[p] <= 100 * score[x] <= 100 * score[p]][:k]
            out += [(a, p, i + 1, x, score[p], score[x]) for i, x in enumerate(fit)]
    return sorted(out)


def _vectors(n, dims, seed, big=False):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, dims))
    v = centre[r.integers(0, 6, n)] + r.normal(size=(n, dims)) * r.choice([0.05, 0.5], (n, 1))
    v *= r.choice([0.1, 1.0, 7.0] + [1e6] * big, (n, 1))
    v[n // 2: n // 2 + n // 5] = v[1]                      # a large group of equal vectors
    v[7] = 0
    return [(int(i), [float(x) for x in row], int(r.integers(0, 3))) for i, row in enumerate(v)]


@pytest.mark.parametrize("seed, dims, block, references", [(1, 8, 1 << 24, 4), (2, 3, 64, 16), (3, 1, 1 << 24, 2), (4, 5, 200, 0)])
def test_mining_equals_brute_force(spark, seed, dims, block, references):
    rows = _vectors(450, dims, seed, big=seed == 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("x")).withColumn("q", F.lit(1))
    got = hard_negatives.mine(df.repartition(7), F.col("vec_id") % 100 == 0, references=references, block_bytes=block)
    want = _mine([(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows])
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20


def test_mining_leaves_out_what_has_no_vector_or_label(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, nan], 1), (2, [inf, 1.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [1.0, 1.0], None), (6, [0.9, 0.5], 1),
            (7, [0.8, 0.5], 2), (None, [1.0, 0.5], 1), (8, [0.95], 2), (9, [], 2), (6, [0.9, 0.5], 1), (10, [0.8, 0.5], 2), (100, [], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())
    q = lambda v: [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (2 - len(v))
    assert got == _mine([(i, y, q(v)) for i, v, y in [rows[0], rows[6], rows[7], rows[9], rows[10], rows[12], rows[13]]])
    assert [(r[1], r[3]) for r in got] == [(6, 7), (6, 10), (6, 8)]
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("vec_id") == 77).count() == 0


def test_bounds_hold_every_score():
    r = np.random.default_rng(5)
    for dims in (1, 2, 16):
        q = r.integers(-300, 300, (80, dims)) * r.choice([1, 1000], (80, 1))
        q[0], q[1], q[2] = 0, q[3], -q[3]
        norm = hard_negatives._norms(q)
        a = hard_negatives.angles(q, norm, hard_negatives.choose_references(q, 5))
        least, most = hard_negatives.angle_interval(a, a, a)
        down, up = hard_negatives.score_bounds(norm, least, most, norm, norm)
        s = q @ q.T
        assert (down <= s).all() and (s <= up).all()
        for at in range(0, 80, 20):                         # a whole tile of rows
            t = slice(at, at + 20)
            least, most = hard_negatives.angle_interval(a, a[t].min(axis=0)[None], a[t].max(axis=0)[None])
            down, up = hard_negatives.score_bounds(norm, least, most, norm[t].min(), norm[t].max())
            assert (down <= s[:, t]).all() and (s[:, t] <= up).all()


def test_references_leave_rows_out():
    """Where rows lie in clusters, most pairs are never scored."""
    r = np.random.default_rng(6)
    v = np.repeat(r.normal(size=(10, 64)) * 300, 30, axis=0) + r.normal(size=(300, 64)) * 10
    q = v.round().astype(int)
    norm = hard_negatives._norms(q)
    a = hard_negatives.angles(q, norm, hard_negatives.choose_references(q, 16))
    _, up = hard_negatives.score_bounds(norm, *hard_negatives.angle_interval(a, a, a), norm, norm)
    need = np.sort(q @ q.T, axis=1)[:, -5]
    assert (up >= need[:, None]).mean() < 0.2


# ---------------------------------------------------------- quality ranking
def test_quality_on_held_out_rows(spark):
    got = queries.op12_quality_rank(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    crc = {r.doc_id: r.c for r in docs.select("doc_id", F.crc32(F.col("doc_id").cast("string")).alias("c")).collect()}
    assert (got.held_out == got.doc_id.map(lambda i: crc[i] % 4 == 2)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    area = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    assert area > 0.97 and (held.predicted == held.quality).mean() > 0.93


def test_quality_edges(spark):
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    docs = [(i, " ".join(word() for _ in range(30)) + "." if i % 2 else "buy!!! " * 20 + str(i)) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "hello there"), (102, "x" * 300_000), (1, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("a")).withColumn("quality", F.lit(9)).withColumn("x", F.lit(0))
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (5, 7), (None, 1), (999, 0), (1, 1)], "doc_id long, quality int")
    got = quality.rank_quality(df, marks).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 for x in got)
    assert {x.predicted for x in got if x.doc_id is not None and x.doc_id < 60 and x.doc_id % 2} == {1}
    assert {x.predicted for x in got if x.doc_id is not None and x.doc_id < 60 and x.doc_id % 2 == 0} == {0}
    assert len({x.score for x in got if x.doc_id == 1}) == 1 and [x.held_out for x in got if x.doc_id is None] == [True]
    assert {x.score for x in quality.rank_quality(df, marks.where("quality = 1")).collect()} == {0.5}
    assert {x.score for x in quality.rank_quality(df, marks.limit(0)).collect()} == {0.5}
    assert quality.rank_quality(df.limit(0), marks).count() == 0
    scored = spark.range(200).selectExpr("id", "least(id, 180) / 200.0D AS score")
    assert sorted(r.id for r in quality.best_share(scored, 0.25).collect()) in ([*range(149, 200)], [*range(150, 200)])
    assert quality.best_share(scored, 0.01).count() == 20 and quality.best_share(scored.limit(0), 0.5).count() == 0      # ties all stay


def test_pairs_prefer_good_over_bad(spark):
    rows = [(1, i, [float(i), 1.0]) for i in range(7)] + [(0, i, [float(-i), 0.0]) for i in range(3)]
    sample = spark.createDataFrame(rows, "quality int, place long, x array<double>")
    pairs = quality.preference_pairs(sample, 4).collect()
    assert len(pairs) == 28 and {(p.label, p.x[1]) for p in pairs} == {(1.0, 1.0), (0.0, -1.0)}
    assert {abs(p.x[0]) for p in pairs} >= {0.0, 6.0}


def test_cut_is_a_quantile_by_label_weight():
    raw, marks = np.array([0.0, 1, 2, 3, 4, 5, 6, 7]), np.array([0, 0, 0, 0, 1, 1, 1, 1])
    assert quality._cut(raw, marks, 0.5) == 3.5 and quality._cut(raw, marks, 0.1) == 3.5
    assert quality._cut(raw[::-1], marks, 0.5) == 3.5
    m = quality.Model(np.array([1.0]), 2.0)
    assert m.score(np.array([2.0])) == pytest.approx(quality.PASS_SCORE) and m.score(np.array([-1e6])) == 0.0 and m.score(np.array([1e6])) == 1.0


def test_fit_uses_every_labelled_document(spark):
    r = np.random.default_rng(5)
    n = 4400            # of each label
    sizes = [*r.integers(1, 40, n), *r.integers(10, 60, n)]
    docs = [(i, " ".join("".join(r.choice(list("abcd-E. "), 4)) for _ in range(k))) for i, k in enumerate(sizes)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    m = quality.fit(df, spark.createDataFrame([(i, int(i >= n)) for i in range(2 * n)], "doc_id long, quality int"))
    raw = np.array([quality.features(t) @ m.weights for _, t in docs])
    assert (raw < m.cut).sum() == n
    one = quality.fit(df, spark.createDataFrame([(i, int(i >= n)) for i in range(2 * n)], "doc_id long, quality int"), sample_docs=50)
    assert not np.allclose(one.weights, m.weights)


@pytest.mark.parametrize("n_bad, share", [(30, 0.3), (1, 0.01), (99, 0.9), (50, 0.2)])
def test_whole_cut_equals_the_plain_one(spark, n_bad, share):
    r = np.random.default_rng(n_bad)
    texts = ["ab. " * int(k) + "x" * int(j) for k, j in zip(r.integers(0, 9, 100), r.integers(0, 5, 100))]      # many share a score
    w, marks = r.normal(size=265), np.array([0] * n_bad + [1] * (100 - n_bad))
    sample = spark.createDataFrame([(int(q), bytearray(quality.packed(t))) for q, t in zip(marks, texts)], "quality int, x binary").repartition(3)
    raw = np.array([quality.features(t) @ w for t in texts])
    assert quality._whole_cut(sample, w, share) == pytest.approx(quality._cut(raw, marks, share), abs=1e-9)


def test_places_run_through_the_whole_order(spark):
    got = quality._placed(spark.range(1000).selectExpr("id * 7 % 1000 AS v").repartition(6), "v").collect()
    assert [x.place for x in sorted(got, key=lambda x: x.v)] == [*range(1000)]
    assert quality._placed(spark.range(0).selectExpr("id AS v"), "v").count() == 0


def test_features_read_the_whole_text():
    a, b = "word " * 50_000, "word " * 50_000 + "|"
    assert (quality.features(a) != quality.features(b)).any() and quality.features(None).tolist() == quality.features("").tolist()
