import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from lattiq.llm import html_text, katz, toxicity
from lattiq.llm.common import written


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def corpus():
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, "Új SZÓ új"), (502, "Új SZÓ új"), (503, " \x0b\t")]


def brute(rows):
    toks = [(i, [w for w in (t or "").encode().lower().split()] + [0]) for i, t in rows]
    uni, bi = Counter(), Counter()
    for i, ts in toks:
        if not held(i):
            uni.update(ts)
            bi.update(zip([0] + ts, ts, strict=False))
    n, v = sum(uni.values()), len(uni)
    ns = lambda c: [sum(x == k for x in c.values()) for k in range(1, katz.TOP + 2)]
    du, db = katz.discounts(ns(uni)), katz.discounts(ns(bi))
    cut = lambda d, c: (d[c] if c <= katz.TOP else 1.0) * c
    unk = 1 - sum(cut(du, c) for c in uni.values()) / n
    p1 = lambda w: cut(du, uni[w]) / n if w in uni else unk
    after = defaultdict(list)
    for (a, b), c in bi.items():
        after[a].append((b, c))
    weights = {}
    for a, ws in after.items():
        mass, seen = sum(cut(db, c) for _, c in ws), sum(p1(w) for w, _ in ws)
        total = uni[a] if uni[a] - mass > 1e-9 else uni[a] + 1
        weights[a] = total, (1 - mass / total) / (1 - seen)
    out = []
    for i, ts in toks:
        s = base = 0.0
        for a, b in zip([0] + ts, ts, strict=False):
            s += math.log10(cut(db, bi[a, b]) / weights[a][0] if (a, b) in bi else (weights[a][1] if a in weights else 1) * p1(b))
            base += math.log10((uni[b] + 1) / (n + v + 1))
        out.append((i, held(i), len(ts), sum(w in uni for w in ts), n, base, s))
    for a, ws in after.items():  # each context's probabilities sum to one
        total, alpha = weights[a]
        assert sum(cut(db, c) for _, c in ws) / total + alpha * (1 - sum(p1(w) for w, _ in ws)) == pytest.approx(1)
    return out


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 500)  # several chunks
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = sorted(katz.score(docs).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    want = sorted(brute(rows), key=lambda r: (r[0], r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert (g.base_score, g.score) == pytest.approx(w[5:])


def test_levels_of_merges_equal_brute_force_and_grow_in_proportion(spark, monkeypatch):
    sent = []

    def kept(df, name):
        out = written(df, name)
        if name == "sent":
            sent.append(out.count())
        return out

    monkeypatch.setattr(katz, "CHUNK", 200)
    monkeypatch.setattr(katz, "written", kept)
    rows = corpus()
    for times in (1, 2):
        own = [(i + 1000 * k, t) for k in range(times) for i, t in rows]
        docs = spark.createDataFrame(own, "doc_id long, text string").coalesce(1)
        sent.clear()
        got = sorted(katz.score(docs, fan=4).collect(), key=lambda r: (r.doc_id, r.n_tokens))
        n = katz.chunks_of(docs).count()
        # a level's arrays are ``fan`` for each chunk, whatever their number; all at once they would be n * n
        assert n > 8 and len(sent) == 3 * times
        assert max(sent) <= 4 * (n + 4)  # groups are rounded up
        if times == 1:
            want = sorted(brute(rows), key=lambda r: (r[0], r[2]))
            for g, w in zip(got, want, strict=True):
                assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
                assert (g.base_score, g.score) == pytest.approx(w[5:])


def test_no_documents_to_learn_from(spark):
    out = next(i for i in range(100) if held(i))
    row = katz.score(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_known, row.train_tokens) == (True, 0, 0)
    assert row.score == 0
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert katz.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first().doc_id is None


def test_packed_keys():
    rng = random.Random(4)
    for n in (0, 1, 2, 1000):
        keys = np.array(sorted({rng.getrandbits(64) for _ in range(n)}), np.uint64)
        assert katz.unpacked(katz.packed(keys)).tolist() == keys.tolist()
    assert len(katz.packed(np.arange(5, 1005, dtype=np.uint64))) == 9 + 999


def test_discounts():
    d = katz.discounts([1000, 400, 200, 110, 70, 50])
    assert ((d[1:] > 0) & (d[1:] < 1)).all()
    assert (katz.discounts([5, 0, 0, 0, 0, 0])[1:] < 1).all()
    bumpy = katz.discounts([193655, 25105, 6496, 2179, 2497, 618])
    assert ((bumpy[1:] > 0) & (bumpy[1:] < 1)).all()


def labelled(n, seed):
    rng = random.Random(seed)
    vocab = {"en": "the of and to in is", "fr": "le la les de des que"}
    rows = []
    for i in range(n):
        lang = ("en", "fr")[i % 2]
        ws = [rng.choice(vocab[lang].split() + [f"w{rng.randint(0, 5000)}"] * 6) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.3
        if bad:
            ws.insert(rng.randrange(len(ws)), {"en": rng.choice(["vilething", "nastyword"]), "fr": "mechan" + rng.choice("abcdefgh") + rng.choice("abcdefgh")}[lang])
        rows.append((i, " ".join(ws), int(bad)))
    return rows


def test_classifier_on_held_out_rows(spark):
    rows = labelled(900, 5)
    docs = spark.createDataFrame([(i, t, "zz", 1) for i, t, _ in rows] + [(5000, None, None, 1), (5001, "", None, 1), (5001, "", None, 1)], "doc_id long, text string, lang string, predicted int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.classify(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 903
    truth = {i: y for i, _, y in rows}
    own = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(own) > 100
    assert sum(a == b for a, b in own) / len(own) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_thresholds_against_brute_force():
    rng = np.random.default_rng(5)
    counts = np.zeros((2, 2, toxicity.BINS), np.int64)
    s = np.concatenate((rng.beta(2, 6, 300), rng.beta(6, 3, 90)))
    y = np.repeat([0, 1], [300, 90])
    np.add.at(counts[0], (y, (s * toxicity.BINS).astype(int)), 1)
    counts[1, 1, 10] = toxicity.LEAST - 1  # too few of the second language
    got = toxicity.thresholds(counts, 0.2)
    total = counts.sum((0, 2))
    weigh = lambda c: (0.8 * counts[0, 0, c:].sum() / total[0]) + (0.2 * counts[0, 1, :c].sum() / total[1])
    errors = {c: weigh(c) for c in range(50, 951)}
    best = [c for c, e in errors.items() if e <= min(errors.values()) + 1e-12]
    assert round(got[0] * 1000) in best and got[1] == 0.5
    assert abs(got[0] - 0.5) == pytest.approx(min(abs(c / 1000 - 0.5) for c in best))


def test_thresholds_come_from_all_rows_not_fitted_on(spark):
    rows = [(i, f"{'vile' if i % 3 == 0 else 'kind'} the word {i}", int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, raw double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model, known = toxicity.learn(docs, labels, sample=20)
    counts = known.counts(toxicity.rate(docs, model))
    fold = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5]
    assert counts.sum((0, 2)).tolist() == [fold.count(0) - 20, fold.count(1) - 20]
    judged = {r.doc_id: r for r in toxicity.judge(docs, labels, sample=20).collect()}
    model.thresholds = toxicity.thresholds(counts, known.share)
    words = toxicity.Words()
    for i, t, _ in rows[::20]:
        assert judged[i].score == pytest.approx(float(model.scores(words.batch([t]))[0]), abs=1e-4)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.classify(docs, toxicity.train(docs, none)).first().score == 0


def test_windows_stay_inside_texts():
    model, words = toxicity.Cnn.fresh(), toxicity.Words()
    texts = ["a b c", "", "d", "e f"]
    together = model.raw(words.batch(texts))
    assert np.allclose(together, [model.raw(words.batch([t]))[0] for t in texts], atol=1e-6)
    assert words.batch(["the of and", "der die und", "qq", ""]).languages().tolist() == [0, 2, 4, 4]


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="x">
<header><a href="/">Site</a></header><nav><ul><li><a>One</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<{tag} {attr}><h1>Title {n}</h1><p>First &amp; <b>bold</b>er {n}.<p>Second&nbsp;part <a href="x">link</a>, {words}<br>end</p><form><input><button>Send</button></form></{tag}>
<aside>Side {n}</aside><section id="comments"><p>Nice article {n}!</p></section><!-- c --><div class="ad banner">Buy</div><footer>(c) Site</footer></body></html>"""


@pytest.mark.parametrize(("tag", "attr"), [("article", ""), ("main", 'class="has-sidebar"'), ("div", 'class="content"')])
def test_main_text(spark, tag, attr):
    want = lambda n: f"Title {n} First & bolder {n}. Second part link, {'lorem ' * (n + 5)}end"
    rows = [(n, "http://h.example/a", PAGE.format(tag=tag, attr=attr, n=n, words="lorem " * (n + 5))) for n in range(6)]
    rows += [(90, None, "<p>alone &lt;b&gt;"), (91, "http://x.example", None), (92, "http://x.example", ""), (92, "http://x.example", "")]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert {n: got[n].text for n in range(6)} == {n: want(n) for n in range(6)}
    assert (got[90].text, got[91].text, got[92].n_chars) == ("alone <b>", "", 0)
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(pages).count() == len(rows)


def brute_template(pages, share):
    """Keys of valid classes of the distinct pages of one host, by whole occurrence vectors."""
    lines = [html_text.Parser().parse(p).line().tolist() for p in sorted(set(pages))]
    vectors = {k: tuple(line.count(k) for line in lines) for line in lines for k in line}
    groups = defaultdict(set)
    for k, v in vectors.items():
        if sum(map(bool, v)) >= max(html_text.LEAST_PAGES, share * len(lines)):
            groups[v].add(k)
    large = {v: ks for v, ks in groups.items() if len(ks) >= html_text.LEAST_TOKENS}
    on = lambda v: sum(map(bool, v))
    ranked = sorted(large, key=lambda v: (-on(v), sum(v), -len(large[v]), sorted(large[v])))
    frame = next((large[v] for v in ranked if on(v) == sum(v)), set())
    found = set()
    for v, ks in large.items():
        orders, nests = set(), set()
        for line in lines:
            at = [i for i, k in enumerate(line) if k in ks]
            for j in range(0, len(at), len(ks)):
                turn = at[j : j + len(ks)]
                orders.add(tuple(line[i] for i in turn))
                if any(k in frame for k in line):
                    nests.add(tuple(sum(k in frame for k in line[turn[0] : i + 1]) - (line[turn[0]] in frame) for i in turn))
        if len(orders) == 1 and len(next(iter(orders))) == len(set(next(iter(orders)))) == len(ks) and len(nests) <= 1:
            found |= ks
    return found


def page_tables(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return pages.select(html_text.host_of(pages.url).alias("host"), F.xxhash64("html").alias("page"), "html")


def test_classes_against_brute_force(spark):
    rng, rows = random.Random(31), []
    for host in range(4):
        for i in range(14):
            items = "".join(f"<li><i>Item</i><b>{rng.randint(0, 99)}</b><s>end</s></li>" for _ in range(rng.randint(0, 4)))
            parts = ["<h2>Menu</h2>", f"<ul>{items}</ul>", f"<p>{rng.random()}</p>", "<div><em>Foot</em><q>Note</q></div>", "<p>Same</p>" * rng.randint(0, 2)]
            if host == 2:
                rng.shuffle(parts)
            rows.append((len(rows), f"http://h{host}.example/{i}", "<html><body>" + "".join(parts) + "</body></html>"))
    rows += rows[:5]
    parsed = html_text.tokens_of(page_tables(spark, rows))
    got = {r.host: {k % (1 << 64) for k in r.known} for r in html_text.template(parsed).collect()}
    ids = {r.url: r.host for r in spark.createDataFrame([(u,) for _, u, _ in rows], "url string").select("url", html_text.host_of(F.col("url")).alias("host")).collect()}
    for host in range(4):
        mine = [(u, p) for _, u, p in rows if u.startswith(f"http://h{host}.")]
        want = {k % (1 << 64) for k in brute_template([p for _, p in mine], html_text.SHARE)}
        assert got.get(ids[mine[0][0]], set()) == want
        assert want


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_template_decides_inside_the_article(spark, tag):
    rows = [(n, "http://h.example/a", f"<html><body><{tag}><h1>Title {n}</h1><p>Read our other stories too.</p><p>Body {n} {'word ' * n}</p></{tag}></body></html>") for n in range(10)]
    rows += [(n + 100, "http://other.example/", r) for n, (_, _, r) in enumerate(rows[:2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert all(got[n] == f"Title {n} Body {n} {'word ' * n}".strip() for n in range(10))
    assert got[101] == "Title 1 Read our other stories too. Body 1 word"  # two pages are no template


def test_very_deep_pages_and_empty_tables(spark):
    deep = "<div>" * 100_000 + "deep" + "<b>x</i></p>" * 50_000
    pages = spark.createDataFrame([(1, "http://h.example/", deep, "t")], "page_id long, url string, html string, text string")
    row = html_text.extract(pages).first()
    assert row.text.startswith("deep") and row.n_chars == len(row.text)
    assert html_text.extract(pages.limit(0)).count() == 0

