"""Small tests of the text operators: edge cases, brute force, round trips, held-out accuracy."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from skylane.llm import chat, decontam, exact_dedup, html_extract, jaccard, langid, license_scan, packing, pii, token_cache
from skylane.llm.common import new_folder
from skylane.llm.graph import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def long_text(seed, n=400):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(r.integers(50)) for i in r.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns with names the operators use."""
    a = long_text(1)
    near = a.replace(a.split()[200], "changed", 1)
    rows = [(1, a), (2, a.replace(" ", "  \n")), (3, near), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (7, "one two"), (8, "1234 !!"),
            (9, long_text(2, 60_000)), (None, a), (None, None), (10, "é" * 9000), (11, "one\x0btwo"), (12, "x")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    return df.selectExpr("*", "1 AS kept", "'z' AS h", "2.0 AS pos", "true AS node", "'q' AS digest", "0 AS words", "0 AS piece", "'k' AS key").cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r[0]].append(r)
    return out


def test_exact_dedup_brute_force(spark, odd, docs):
    for df in (odd, docs):
        rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in df.select("doc_id", "text").collect()]
        group = defaultdict(list)
        for i, t in rows:
            group[t].append(i)
        want = sorted(((str(i), str(min((x for x in group[t] if x is not None), default=None)), len(group[t]),
                        hashlib.sha256(t.encode()).hexdigest()) for i, t in rows))
        got = exact_dedup.exact_dedup(df).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(group)
        assert df.columns == exact_dedup.keep_first(df).columns and exact_dedup.keep_first(df).count() == len(group)


def test_chunks_rejoin_and_follow_content(spark):
    text = ". ".join(long_text(i, 200) for i in range(20))
    df = spark.createDataFrame([(0, text), (1, "A new beginning of some words. " + text)], "doc_id long, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", exact_dedup.chunks_of(exact_dedup.normalised(df.text)).alias("c")).collect()}
    assert "".join(got[0]) == text
    assert len(set(got[0]) & set(got[1])) >= len(got[0]) // 2       # cuts fall into step again


def test_token_counts_and_cache(spark, odd, docs):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, cache = sentencepiece.SentencePieceProcessor(model_file=path), new_folder(spark, "cache")
    for df in (odd, docs):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in df.select("doc_id", "text").collect())
        got = token_cache.token_counts(df, path, cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    stored = spark.read.parquet(cache).count()
    token_cache.add_misses(docs, path, cache)                       # a second run finds all texts stored
    assert spark.read.parquet(cache).count() == stored


def test_token_counts_of_other_kinds_and_long_parts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    text = "word  and\nline " * 20_000 + "end "
    assert len(token_cache._exact_parts(text)) > 1
    import sentencepiece
    assert token_cache.counter(path)([text]) == [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))]
    assert token_cache.counter(public_tokenizers.path("byte_bpe_50k.json"))(["a b", ""]) == [2, 0]


def test_word_wise_encoding_is_the_library_s(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = packing._tokenizer(path)
    r = np.random.default_rng(3)
    signs = list("ab'sStTdD.,!<|>endoftext \n\té́Σİ12%&*()")
    texts = ["".join(r.choice(signs, 60)) for _ in range(1500)] + ["<|ENDOFTEXT|> x<|endoftext|>.y", "don't 's.'s", "", " \n"]
    texts += [x.text for x in docs.select("text").collect() if x.text]
    want = [np.array([*e.ids, 0], dtype="<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert packing.encode_bytes(texts, path) == want


def test_packing_places_every_piece_once(spark, odd, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (odd, docs):
        got = packing.pack_documents(df, path, group_pieces=100).toPandas()
        seqs = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
        assert all((g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048 for _, g in seqs)
        n = {}
        for r in df.select("doc_id", "text").collect():
            raw = packing.encode_bytes([r.text or ""], path)[0]
            n.setdefault(str(r.doc_id), []).append([zlib.crc32(raw[i:i + 8192]) for i in range(0, len(raw), 8192)])
        assert len(got) == sum(len(c) for cs in n.values() for c in cs)
        ids = got.doc_id.map(lambda x: "None" if x != x or x is None else str(int(x)))
        for i, cs in n.items():
            assert sorted(got[ids == i].ids_crc32) == sorted(c for x in cs for c in x)
        whole = got.groupby([ids, "piece"]).length.sum()
        assert (whole <= 2048 * 3).all()
    assert seqs.ngroups <= 1.1 * got.length.sum() / 2048 + 1
    with_ids = packing.pieces(docs, path, with_ids=True).first()
    assert zlib.crc32(np.array(with_ids.ids, dtype="<u4").tobytes()) == with_ids.ids_crc32


def test_sum_of_squares_rule_by_brute_force():
    lengths = np.random.default_rng(0).integers(1, 11, 300)
    seq, off = packing.place_sum_of_squares(lengths, 10)
    fill = {}
    for w, s, o in zip(lengths, seq, off):
        gaps = lambda f: sum(x * x for x in np.bincount([10 - v for v in f.values() if v < 10], minlength=11)) if f else 0
        options = {gaps(fill | {k: v + w}) for k, v in fill.items() if v + w <= 10} | {gaps(fill | {-1: w})}
        assert o == fill.get(s, 0)
        fill[s] = fill.get(s, 0) + w
        assert gaps(fill) == min(options) and fill[s] <= 10


def test_language_held_out_accuracy(spark, odd):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(df).toPandas().merge(df.select("doc_id", "lang").toPandas(), on="doc_id")
    test = got[got.held_out & (got.lang_pred != "und")]
    assert (test.lang_pred == test.lang).mean() > 0.98
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    rows = by_id(langid.identify(odd, df))
    assert [rows[i][0].lang_pred for i in (4, 5, 6, 8)] == ["und"] * 4 and len(rows[7]) == 2
    assert langid.identify(odd.where("doc_id < 0")).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, df.where("lang is null")).collect()} == {"und"}


def test_language_mixture(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 2000")
    langs, logp = langid.train(df.where(~langid.held_out()))
    one = {x: df.where((df.lang == x) & langid.held_out()).first().text[:2000] for x in ("en", "de")}
    share, _ = langid.infer(langid.trigrams(one["en"] + " " + one["de"]), logp)
    assert abs(share[langs.index("en")] - 0.5) < 0.12 and abs(share[langs.index("de")] - 0.5) < 0.12
    assert langid.infer(langid.trigrams("ћџљњ ђћ љџњ " * 40), logp)[1] > langid.MAX_OTHER


def brute_components(df, k, num, den):
    sets = {}
    for r in df.select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            a, b = sets[i], sets[j]
            if a and b and den * min(len(a), len(b)) >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_brute_force(spark, docs, k, num, den):
    r = np.random.default_rng(5)
    base = long_text(9, 300).split()
    chain, rows = list(base), []
    for i in range(12):                         # a chain: neighbours alike, the ends not
        rows.append((10_000 + i, " ".join(chain)))
        for at in r.integers(0, 300, 4):
            chain[at] = f"w{i}x{at}"
    for i in range(12):                         # tiny sets
        rows.append((20_000 + i, " ".join(WORDS[:1 + i // 2])))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(df, k, num, den).collect()}
    assert got == brute_components(df, k, num, den)


def test_jaccard_odd_rows(spark, odd):
    got = by_id(jaccard.jaccard_components(odd))
    assert got[3][0].component_id == got[2][0].component_id == 1
    assert [got[i][0].component_id for i in (4, 5, 6)] == [4, 5, 6] and [got[i][0].n_shingles for i in (4, 5, 6)] == [0, 0, 0]
    assert [x.component_id for x in got[7]] == [7, 7] and got[11][0].component_id == 7
    assert [x.component_id for x in got[None]] == [None, None]
    assert jaccard.jaccard_components(odd.where("doc_id < 0")).count() == 0


def test_tiles_meet_for_all_similar_sets():
    r = np.random.default_rng(2)
    for num, den in ((9, 10), (4, 5)):
        s = jaccard.Scheme(num, den)
        for n in (1, 2, 5, 9, 10, 19, 20, 40, 100, 700, 5000):
            for _ in range(12):
                a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
                cut = int(len(a) * (den - num) / (den + num))
                b = np.unique(np.concatenate((a[r.permutation(len(a))][cut:], r.integers(0, 2**63, cut, dtype=np.uint64))))
                common = len(np.intersect1d(a, b))
                assert s.may_link(len(a), len(b), jaccard.differing_bits(s.bitmap(a), s.bitmap(b))) or not s.links(len(a), len(b), common)
                if s.links(len(a), len(b), common):
                    assert len(np.intersect1d(s.keys(a), s.keys(b)))


def test_components(spark):
    r = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    want = {x: top(x) for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog, and then it runs away into the deep forest again."),
                                   (2, None), (3, "!!"), (4, "short one"), (5, long_text(77, 60))], "item_id long, text string")
    text = items.collect()[0].text
    edited = text.replace("lazy", "lazzy").replace("deep", "dep")
    rows = [(1, "Intro. " + text.upper().replace(" ", "  \n") + " outro"), (2, "x " + edited + " y"), (3, text[:60]), (4, None), (5, ""),
            (6, "a short, ONE here"), (7, "ashort one"), (8, long_text(77, 60)[5:]), (8, long_text(77, 60)[5:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.contaminated_spans(df, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1), (6, 4), (8, 5), (8, 5)]
    texts = dict(rows)
    assert {texts[r.doc_id][r.start:r.stop].split()[0].lower() for r in got if r.item_id == 1} == {"the"}
    assert next(r.distance for r in got if r.doc_id == 2) == 2
    blocks = decontam.contaminated_spans(df, items, block_chars=50).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))
    assert sorted(r.doc_id for r in df.where(~decontam.is_contaminated(df, items)).collect()) == [3, 4, 5, 7]
    assert decontam.contaminated_spans(odd, items.where("item_id > 9")).count() == 0
    assert decontam.contaminated_spans(df.where("doc_id > 99"), items).count() == 0


def test_myers_against_dynamic_programming():
    r = np.random.default_rng(4)
    for _ in range(60):
        p, t = ("".join(r.choice(list("abc"), n)) for n in (int(r.integers(1, 90)), 60))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            before, row = row, [i]
            for j, y in enumerate(t, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
        assert decontam.Pattern(p).find(t)[0] == min(row)


def test_pii(spark, odd):
    text = "a.b@c.de f@@g.h 1.2.3.4 256.1.1.1 1.2.3.4.5 +1 (555) 123-4567 or 4111 1111 1111 1111, x@y.z@w.v.u"
    base = pii.base_spans(text)

    def plain(kind, pattern, ok):
        return [(kind, *m.span()) for m in re.finditer(pattern, text) if ok(m.group())]
    digits = lambda s: re.sub(r"\D", "", s)
    want = (plain("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)
            + plain("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) < 256 for x in s.split(".")))
            + plain("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)))
            + plain("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15))
    assert sorted(base) == sorted(want) and len(base) == 6
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.train(sample)
    key = "the words 24be64439e3e49cf46b2d7c90f3602a3d0b907ff stand here and password=f2f5acd241f026fd29 too"
    assert [s[0] for s in pii.find_spans(key, field)[1]] == ["secret", "secret"]
    assert pii.find_spans("chapter 12 of section2 in 2024-05-06 is clean", field)[1] == []
    got = by_id(pii.pii_spans(odd, field))
    assert got[4][0].spans == "" and got[4][0].base_sha256 == hashlib.sha256(b"").hexdigest() and len(got[7]) == 2
    assert pii.pii_spans(odd.where("doc_id < 0")).count() == 0


def test_pii_base_patterns_on_random_strings():
    r = np.random.default_rng(8)
    for _ in range(400):
        text = "".join(r.choice(list("12345. -+@a()x0"), 70))
        mail = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m.group().split("."))]
        got = pii.base_spans(text)
        assert [s[1:] for s in got if s[0] == "email"] == mail and [s[1:] for s in got if s[0] == "ip"] == ip


def test_semi_markov_gradient():
    text = "token=abc12345def67890 1.2.3.4 zz 99887766aa"
    chain = pii.neighbourhoods(text)[0]
    x = np.array([pii.features(text, a, b) for a, b, _ in chain])
    f = pii.Field(np.random.default_rng(0).normal(0, .1, (len(pii.TYPES), pii.N_FEATURES)), np.random.default_rng(1).normal(0, .1, (len(pii.TYPES) + 1, len(pii.TYPES))))
    gold = [(0, 4)]
    like = lambda: float(f.w[4] @ x[0] + f.v[-1, 4] - f.log_partition(chain, x)[1])
    gw, gv = f.gradient(chain, x, gold)
    for a, g in ((f.w, gw), (f.v, gv)):
        for at in [(0, 0), (4, 3), (1, 2)]:
            a[at] += 1e-5
            up = like()
            a[at] -= 2e-5
            down = like()
            a[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_semi_markov_decoding_by_exhaustive_search():
    rng, kinds = np.random.default_rng(1), len(pii.TYPES)
    for _ in range(30):
        n = int(rng.integers(1, 5))
        starts, sizes = rng.integers(0, 30, n).tolist(), rng.integers(1, 12, n).tolist()
        chain = sorted(((a, a + size, -1) for a, size in zip(starts, sizes)), key=lambda s: (s[1], s[0]))
        x = rng.normal(size=(n, pii.N_FEATURES))
        field = pii.Field(rng.normal(size=(kinds, pii.N_FEATURES)) * 0.3, rng.normal(size=(kinds + 1, kinds)))
        score, best, want = x @ field.w.T, 0.0, []
        for r in range(1, n + 1):
            for sub in itertools.combinations(range(n), r):
                if all(chain[p][1] <= chain[q][0] for p, q in zip(sub, sub[1:])):
                    for ts in itertools.product(range(kinds), repeat=r):
                        v = sum(score[i, t] for i, t in zip(sub, ts)) + field.v[-1, ts[0]] + sum(field.v[a, b] for a, b in zip(ts, ts[1:]))
                        if v > best:
                            best, want = v, list(zip(sub, ts))
        assert field.decode(chain, x) == want


def test_semi_markov_long_chain():
    n, rng = 5_000, np.random.default_rng(2)
    chain = [(10 * i, 10 * i + 9, -1) for i in range(n)]
    field = pii.Field(rng.normal(size=(len(pii.TYPES), pii.N_FEATURES)))
    x = np.abs(rng.normal(size=(n, pii.N_FEATURES)))
    want = [(i, int(s.argmax())) for i, s in enumerate(x @ field.w.T) if s.max() > 0]
    assert field.decode(chain, x) == want


def test_license_scan(spark, odd, docs):
    full = dict(license_scan.TEMPLATES)["text:mit"]
    rows = [(1, "Released under the MIT License. The mit-license!"), (2, "General  Public\nLicense and general public"), (3, None), (4, ""),
            (5, full.upper().replace("charge", "any charge")), (6, "The Apache License, Version 2.0; Licensed under the Apache License, Version 2.0."),
            (7, "MİT license"), (8, "smit license"), (8, "smit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(license_scan.license_report(df))
    r = got[1][0]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (8, 2, 3, 6, "mit", "mit,notice:mit", 1.0)
    assert (got[2][0].n_base, got[2][0].base_labels) == (1, "gpl") and got[5][0].labels == "text:mit"
    assert (got[6][0].n_base, got[6][0].first_word, got[6][0].last_word) == (2, 1, 9)
    assert all(got[i][0].labels == "" and got[i][0].first_word is None for i in (3, 4, 7, 8)) and len(got[8]) == 2
    assert len(by_id(license_scan.license_report(odd))[7]) == 2
    for r in license_scan.license_report(docs).join(docs, "doc_id").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate({i: i + 32 for i in range(65, 91)}))
        at = sorted(i for _, p in license_scan.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), *((at[0], at[-1]) if at else (None, None)))


def test_html(spark):
    page = """<html><head><title>T</title><script>var a="</p><p>";</script></head><body class=ad><nav><ul><li><a href=x>Menu</a></ul></nav>
      <div class="cookie-banner">We use cookies and many words to say so, so that this block is long.</div><article><h1>Head &amp; more</h1>
      <p>First   para with a <a href="u>v">link</a> inside.<br>Second line.<p>Next one &eacute;</p><aside>Aside text</aside>
      <div class=comments><p>Reader says something long enough to count as text.</div></article><footer>&copy; us</footer></body></html>"""
    assert html_extract.extract(page) == "Head & more\n\nFirst para with a link inside. Second line.\n\nNext one é"
    bare = "<body><div id=menu><a href=a>One</a><a href=b>Two</a></div><div><p>" + "</p><p>".join(["Some long sentence of the story, told in many words."] * 4) + "</div></body>"
    assert html_extract.extract(bare).count("Some long sentence") == 4 and "One" not in html_extract.extract(bare)
    for p in (None, "", "   ", "<", "<!-- open", "<p", "text only", "<div><div></div>", "</p></div>x"):
        html_extract.extract(p)
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html_extract.main_text(df).collect()
    assert [r.n_chars for r in got if r.page_id] == [len(html_extract.extract(page))] * 2 and [r.text for r in got if r.page_id is None] == [""]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    from html import unescape
    for r, p in zip(html_extract.main_text(pages).collect(), pages.collect()):
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert r.text == "\n\n".join(x for x in parts if x)


def test_chat(spark):
    rows = [(1, 0, "user", "How do I cook rice?\n\nAnd pasta?"), (1, 1, "assistant", "Boil it."), (1, 2, "user", "Thanks"),
            (1, 3, "assistant", "> and   PASTA?\nTen minutes."), (1, 4, "user", ">> And pasta?\n> Ten minutes.\nSure?"), (1, 5, "user", "> never said\nHm"),
            (2, 0, None, None), (2, 1, "user", "> How do I cook rice?\nx"), (None, 0, "user", "> q"), (3, None, "user", "n"), (3, 1, "user", "n"), (3, 1, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS position", "2 AS own", "3 AS path")
    got = chat.format_chat(df).collect()
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert (one[3].reply_to, one[3].text, one[3].depth) == (0, "Ten minutes.", 1)
    assert (one[4].reply_to, one[4].text, one[4].depth, one[4].n_quotes, one[4].n_linked) == (3, "Sure?", 2, 2, 2)
    assert (one[5].reply_to, one[5].text) == (None, "Hm")
    assert [r.turn for r in sorted(one.values(), key=lambda r: r.position)] == [0, 3, 4, 1, 2, 5]
    assert next(r for r in got if r.conv_id == 2 and r.turn == 1).reply_to is None
    assert sorted(r.position for r in got if r.conv_id == 3) == [0, 1, 2] and len(got) == len(rows)
    blocks = {(r.conv_id, r.block): r.text for r in chat.conversation_blocks(chat.format_chat(df), 4).collect()}
    assert blocks[1, 0].startswith("<|user|>\nHow do I cook rice?") and (1, 1) in blocks
    assert chat.format_chat(df.where("turn > 99")).count() == 0
    plain = spark.read.parquet(f"{SF}/conversations.parquet")
    out = chat.format_chat(plain)
    assert out.count() == plain.count() and out.where("position != turn or reply_to is not null").count() == 0


def test_pipeline(spark, odd, tmp_path):
    got = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept, seen = {}, set()
    langs, logp = langid.train(docs.where(~langid.held_out()))
    for i in sorted(rows):                      # stage by stage, by brute force
        t = rows[i].text
        g = langid.trigrams(t)
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if g is not None and langid.infer(g, logp)[1] < 0.5 and norm not in seen:
            seen.add(norm)
            kept[i] = rows[i]
    left = spark.createDataFrame(list(kept.values()), docs.schema)
    classes = brute_components(left, 5, 4, 5)
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i in kept if classes[i][1] == i and not any(x in decontam.normal(kept[i].text) for x in items)}
    assert set(got.doc_id) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "Jaccard join", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and stage(spark, odd.where("doc_id < 0"), SF).count() == 0
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() > 0


def test_html_furniture_words_only_where_nothing_else_says_text():
    story = "<p>" + "</p><p>".join(["Some long sentence of the story, told in many words."] * 4) + "</p>"
    want = ["Some long sentence of the story, told in many words."] * 4
    get = lambda page: html_extract.extract(page).split("\n\n")
    for c in ("layout has-sidebar", "no-sidebar", "with-header", "social-policy", "search-page", "form", "related", "sidebar"):
        assert get(f"<body><div class='{c}'><main>{story}</main></div></body>") == want
        assert get(f"<body><div class='{c}'>{story}</div><div class='menu'><a href=a>One</a></div></body>") == want
    assert get(f"<body><form id=aspnet><nav><a href=x>Menu</a></nav><div>{story}</div></form></body>") == want
    assert get(f"<body><article><div class='entry-header'><h1>Title</h1></div>{story}</article></body>") == ["Title", *want]
    assert get(f"<body><article>{story}<div class='related'><article>Teaser</article></div></article><aside><article>Other</article></aside></body>") == want
    assert get(f"<body><div class='sidebar'>Short words here</div><div>{story}</div></body>") == want
    post = "<div class='comment'><p>A post of the forum, long enough to be read as text.</p></div>"
    assert html_extract.extract(f"<body><div class='comments'>{post * 5}</div></body>").count("A post of the forum") == 5


def test_html_text_directly_in_ancestors():
    quote = "<blockquote><p>" + "</p><p>".join(["Quoted words of some length, said by somebody else."] * 3) + "</p></blockquote>"
    got = html_extract.extract(f"<body><div>First para with <b>bold</b> words.<br><br>Second para.{quote}Third para.</div></body>")
    assert got.startswith("First para with bold words. Second para.\n\nQuoted") and got.endswith("somebody else.\n\nThird para.")


def test_chat_keeps_quotes_that_link_to_nothing(spark):
    three = "First one here\nis long.\n\nSecond para\nalso long.\n\nThird."
    rows = [(1, 0, "user", "How?\n>>> x = 1\n>>> print(x)\nWhy?"), (1, 1, "assistant", three),
            (1, 2, "user", "> First one\n> here is long.\n>\n> Second para also\n> long.\nSo?"),
            (1, 3, "user", "> Third.\n> [never said]\nHm"), (1, 4, "user", "> >>> print(x)\nOne."), (1, 5, "user", ">>> x = 1\nMine"),
            (2, 0, "user", "> a Markdown quote\n\nSeen"), (2, 1, "user", ">> a Markdown quote\n> Seen"), (None, 0, "user", "> q\nz")]
    got = {(r.conv_id, r.turn): r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    body = lambda c, t: got[c, t].formatted.split("|>\n", 1)[1].removesuffix("\n<|end|>\n")
    assert (got[1, 0].text, got[1, 0].unlinked, body(1, 0)) == ("How?\nWhy?", ">>> x = 1\n>>> print(x)", rows[0][3])
    assert (got[1, 2].reply_to, got[1, 2].unlinked, body(1, 2)) == (1, None, "So?")     # two re-wrapped paragraphs of three
    assert (got[1, 3].reply_to, got[1, 3].unlinked, body(1, 3)) == (1, "> [never said]", "> [never said]\nHm")
    assert (got[1, 4].reply_to, body(1, 4)) == (0, "One.")
    assert (got[1, 5].reply_to, body(1, 5), got[1, 5].text) == (None, rows[5][3], "Mine")
    assert body(2, 0) == rows[6][3] and (got[2, 1].reply_to, body(2, 1), got[2, 1].n_linked) == (0, "", 2)
    assert body(None, 0) == "> q\nz"


def test_jaccard_join_counts_every_link(spark, odd, monkeypatch):
    base, r = long_text(9, 300).split(), np.random.default_rng(6)
    rows = [(i, " ".join(base[:at] + [f"w{i}"] + base[at + 1:])) for i, at in enumerate(r.integers(0, 300, 40).tolist())]      # all alike, all different
    rows += [(100 + i, rows[3][1].upper()) for i in range(3)] + [(200 + i, " ".join(base[:300 - 9 * i])) for i in range(8)]     # copies; a chain
    rows += [(300, "one two three four"), (301, None), (302, "one two three four five six")]
    shingles = {i: {tuple(w[j:j + 3]) for j in range(len(w) - 2)} for i, t in rows for w in [(t or "").lower().split()]}
    alike = lambda a, b: bool(a) and bool(b) and 10 * len(a & b) >= 9 * len(a | b)
    want = {i: (sum(a != b and alike(a, b) for b in shingles.values()), sum(a == b for j, b in shingles.items() if a and j != i)) for i, a in shingles.items()}
    assert want[0][0] >= 42 and want[100][1] == 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shingles_a_block in (1 << 20, 1_000):   # one block; many pairs of blocks
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles_a_block)
        got = jaccard.jaccard_join(df).collect()
        assert {x.doc_id: (x.n_links, x.n_equal) for x in got} == want and len(got) == len(rows)
    got = by_id(jaccard.jaccard_join(odd))
    assert (got[1][0].n_links, got[1][0].n_equal, got[3][0].n_links, got[3][0].n_equal) == (1, 1, 2, 0)
    assert [(x.n_links, x.n_equal) for x in got[None] + got[4]] == [(0, 0)] * 3 and len(got[7]) == 2
    assert jaccard.jaccard_join(odd.where("doc_id < 0")).count() == 0


def test_token_counts_of_odd_signs_at_small_cuts(monkeypatch):
    """Literal white-space marks, kinds of white space and combining marks beside the places where long texts are cut."""
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = np.random.default_rng(11)
    signs = list("ab1.,") + ["\u2581", "\u2581\u2581", "\u3000", "\u00a0", "\u200b", "\u0301", "\t", "\n", "é", "日", "\u2028"]
    signs += [" "] * len(signs)
    texts = ["".join(r.choice(signs, int(r.integers(1, 60)))) for _ in range(6000)]
    want = [len(sp.encode(t)) for t in texts]
    monkeypatch.setattr(token_cache, "LONG_TEXT", 8)
    assert any(len(token_cache._exact_parts(t)) > 1 for t in texts)
    assert token_cache.counter(path)(texts) == want


def test_a_language_with_many_letters_is_at_home(spark):
    """3,500 letters and few labelled rows: most trigrams of a clean text are new, yet it stays; another script goes."""
    r = np.random.default_rng(4)
    p = 1 / np.arange(1, 3501)
    text = lambda base: " ".join("".join(chr(base + int(x)) for x in r.choice(3500, 4, p=p / p.sum())) for _ in range(300))
    rows = [(i, text(0x4E00), "zh") for i in range(75)] + [(i, text(0x4E00), None) for i in range(100, 140)]
    rows += [(i, text(0xAC00), None) for i in range(200, 220)] + [(300, "123 !", "zh"), (301, None, None), (302, "", "zh")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", langid.F.lit(1))
    kept = {x.doc_id for x in langid.without_foreign(df, df).collect()}
    assert kept == {i for i, _, _ in rows if i < 200}
    assert langid.without_foreign(df, df).columns == df.columns
    # nothing learned: every text with a letter stays
    none = langid.without_foreign(df, df.where("lang = 'xx'"))
    assert {x.doc_id for x in none.collect()} == {i for i, _, _ in rows if i < 300}


def test_rows_without_items_block_by_block(spark):
    items = spark.createDataFrame([(i, long_text(100 + i, 12)) for i in range(4)] + [(9, None)], "item_id long, text string")
    held = [r.text for r in items.orderBy("item_id").collect()]
    docs = [(i, f"{long_text(i, 30)} {held[i % 5] if i % 3 == 0 and held[i % 5] else ''} {long_text(50 + i, 20)}") for i in range(30)] + [(99, None), (98, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("distance", decontam.F.lit("x"))
    want = {i for i, t in docs if not t or not any(x and x in t for x in held)}
    for chars in (1 << 20, 40):
        got = decontam.without_items(df, items, block_chars=chars)
        assert {r.doc_id for r in got.collect()} == want and got.columns == df.columns
    assert decontam.without_items(df, items.limit(0)).count() == len(docs)


def test_license_passages_keep_apart(spark):
    """Every passage gets its own label, whole or with a word added; names are not confused with longer ones."""
    names = [n for n, _ in license_scan.TEMPLATES]
    assert len(set(names)) == len(names)
    rows = [(i, f"Intro words {t.upper()} outro") for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    rows += [(100 + i, f"x {' '.join(t.split()[:5])} INSERTED {' '.join(t.split()[5:])}") for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    got = by_id(license_scan.license_report(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, (name, t) in enumerate(license_scan.TEMPLATES):
        assert name in got[i][0].labels.split(",") and got[i][0].score == 1.0
        if len(t.split()) >= 12 and name not in license_scan.KEYS:
            assert name in got[100 + i][0].labels.split(",")
    at = {n: got[i][0].labels.split(",") for i, n in enumerate(names)}
    assert "notice:gpl" not in at["notice:lgpl"] and "text:gpl" not in at["text:agpl"] and "notice:cc-by-4.0" not in at["notice:cc-by-sa-4.0"]
    assert "notice:mit" not in at["text:mit"] and at["text:mpl-2.0"] == ["text:mpl-2.0"]


def test_html_time_grows_with_the_page():
    """Deep nesting, stray end tags and elements that would close far ones: no search is repeated."""
    import time
    n = 100_000
    pages = ["<div>" * n + "text", "<b>" * (n // 2) + "</i>" * n + "text", "<p>" + "<b>" * (n // 2) + "<div></div>" * (n // 2) + "text",
             "<table>" + "<b>" * (n // 2) + "<td></td>" * (n // 2) + "text", "<ul>" * 50 + "<b>" * (n // 2) + "<li></li>" * (n // 2) + "text"]
    for page in pages:
        start = time.process_time()
        assert "text" in html_extract.extract(page)
        assert time.process_time() - start < 12           # some 2 s on an idle machine; minutes if it were quadratic


def test_reply_order_against_a_walk(spark):
    """Random trees, a long chain and a message that thousands answer, by a plain walk."""
    r = np.random.default_rng(9)
    up = {(c, t): (None if t == 0 or r.random() < 0.3 else int(r.integers(0, t))) for c in range(6) for t in range(int(r.integers(1, 40)))}
    up |= {(50, t): t - 1 if t else None for t in range(700)} | {(51, t): 0 if t else None for t in range(900)}
    turns = spark.createDataFrame(list(up), "conv_id long, turn int")
    links = spark.createDataFrame([(c, t, 0, u, 1) for (c, t), u in up.items() if u is not None], "conv_id long, turn int, mid long, reply_to int, n_linked long")
    got = {(x.conv_id, x.turn): (x.seq, x.depth) for x in chat.reply_order(turns, links).collect()}
    want = {}
    for c in {c for c, _ in up}:
        kids = defaultdict(list)
        for (c2, t), u in sorted(up.items(), key=lambda x: x[0]):
            if c2 == c:
                kids[u].append(t)
        stack = [(t, 0) for t in reversed(kids[None])]
        while stack:
            t, depth = stack.pop()
            want[c, t] = (sum(k[0] == c for k in want), depth)
            stack += [(k, depth + 1) for k in reversed(kids[t])]
    assert len(got) == len(want) and all(got[k][1] == want[k][1] for k in want)
    for c in {c for c, _ in up}:
        order = sorted((k for k in got if k[0] == c), key=lambda k: got[k][0])
        assert order == sorted((k for k in want if k[0] == c), key=lambda k: want[k][0])


def test_chain_of_quotes(spark):
    """Each message quotes the last one's words: depth grows by one, rows stay small."""
    rows = [(1, t, "user", (f"> answer {t - 1}\n" if t else "") + f"answer {t}") for t in range(300)]
    got = sorted(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect(), key=lambda x: x.position)
    assert [(x.turn, x.depth, x.text, x.reply_to) for x in got] == [(t, t, f"answer {t}", t - 1 if t else None) for t in range(300)]


def test_language_counts_of_many_languages(spark):
    """More languages than a task adds up itself: the same counts; more than the model holds: refused before they are collected."""
    rows = [(i, f"wort{i % 40} und text {i}", f"l{i % 40:02d}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    langs, logp = langid.train(df)
    assert langs == sorted({x for _, _, x in rows})
    for i in (0, 39):
        n = np.zeros(langid.BUCKETS)
        for _, t, x in rows:
            if x == langs[i]:
                np.add.at(n, langid.trigrams(t), 1)
        n += langid.SMOOTHING
        assert np.allclose(logp[i], np.log(n / n.sum()), atol=1e-5)
    with pytest.raises(ValueError):
        langid.train(spark.range(2000).selectExpr("id AS doc_id", "'some text' AS text", "concat('x', id) AS lang"))


def test_mixture_shares_maximise_the_likelihood():
    """The shares found against a fine search over two languages and the flat source."""
    r = np.random.default_rng(7)
    p = np.vstack([r.dirichlet(np.ones(50) * 0.2, 2), np.full((1, 50), 1 / 50)]).astype(np.float32)
    count = r.multinomial(400, 0.7 * p[0] + 0.3 * p[1]).astype(np.float32)
    share = langid._em(p, count)
    like = lambda s: float(count @ np.log(s @ p + 1e-30))
    grid = [(a / 100, b / 100, 1 - (a + b) / 100) for a in range(101) for b in range(101 - a)]
    assert like(share) >= max(like(np.array(s)) for s in grid) - 0.05 and abs(share.sum() - 1) < 1e-3
