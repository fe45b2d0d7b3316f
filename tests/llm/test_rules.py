import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lattiq.llm import decontaminate, quality, secrets

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(text, items):
    ws, hit, ids = WORD.findall(lowered(text)), set(), set()
    for item, t in items:
        iw = WORD.findall(lowered(t))
        k = min(13, len(iw))
        wins = {tuple(iw[i : i + k]) for i in range(max(1, len(iw) - k + 1))} if k else set()
        for i in range(len(ws) - k + 1):
            if wins and tuple(ws[i : i + k]) in wins:
                hit.update(range(i, i + k))
                ids.add(str(item))
    return len(ws), len(hit), sorted(ids)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["the", "Of", "und", "É", "é", "X1", "long", "ok", "Kk", "ſ", "İx"] + [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, say(20)), (2, say(13)), (3, "one Two"), (4, "solo"), (5, ""), (6, None), (7, say(5)), (10, say(30)), (1, say(14))]
    docs = [(i, say(40) + "... " + (items[rng.randrange(len(items))][1] or "").upper() + "; " + say(rng.randint(0, 60))) for i in range(40)]
    docs += [(100, ""), (101, None), (102, "solo"), (102, "solo"), (103, "!!!"), (None, "one two")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(d, b).collect()
    key = lambda r: (r[0] is None, r)
    want = []
    for i, t in docs:
        n, h, ids = brute_hits(t, items)
        want.append((i, n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0 and 20 * h >= n))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=key) == sorted(want, key=key)


def test_decontamination_of_letters_that_depend_on_neighbours(spark):
    rng = random.Random(12)
    greek = ["ΟΔΟΣ", "ΝΕΑ", "οδος", "οδοσ", "Σ", "ΑΣ", "ας", "İΣ", "x", "Ω"]
    items = [(1, "ΟΔΟΣ ΝΕΑ"), (2, " ".join(rng.choice(greek) for _ in range(15))), (3, "ΟΔΟΣ" + " ΝΕΑ" * 12)]
    docs = [(0, "a ΟΔΟΣ.ΝΕΑ b"), (1, "ΟΔΟΣ." + ".".join(["ΝΕΑ"] * 12)), (2, items[1][1].replace(" ", "'"))]
    docs += [(i, "".join(rng.choice(greek) + rng.choice([" ", ".", "’", "'", "-ΟΔΟΣ-ΝΕΑ "]) for _ in range(40))) for i in range(3, 40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(d, b).collect()}
    want = {i: brute_hits(t, items) for i, t in docs}
    assert got == {i: (n, h, len(ids)) for i, (n, h, ids) in want.items()}
    assert got[0][1] == 2 and got[1][1] == 13


def test_decontamination_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(d, none).first().n_hit == 0
    assert decontaminate.decontaminate(d.limit(0), none).count() == 0


def test_no_python_in_native_plans(spark):
    docs = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for df in (decontaminate.decontaminate(docs, items), quality.features(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def brute_quality(text):
    text = text or ""
    ws = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcde") for _ in range(n)) for n in (0, 1, 2, 3, 4, 10, 60, 200)] + ["\n".join(["x y z", "x y z", " ", "#*|<>&%$ é日"] * 3), None, " \t\n", "a b c " * 60, " ".join(f"{i % 50} {i % 7}" for i in range(300))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.features(docs).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("k", "n", "p"), [(0, 100, 0.01), (3, 500, 0.01), (12, 1000, 0.02), (0, 0, 0.01)])
def test_binomial_tail(spark, k, n, p):
    got = spark.range(1).select(quality.tail_probability(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    assert got == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_thresholds_reject_junk_and_keep_good(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(80))
    docs, labels = [], []
    for i in range(2600):
        junk = i % 10 == 0
        docs.append((i, " ".join(w + "***" for w in good().split()) if junk else good(), "en"))
        labels.append((i, 0 if junk else 1))
    docs += [(9000, good(), None), (9001, None, "xx"), (9002, "few words", "en")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert sum(kept[i] for i in range(2600) if i % 10) >= 0.99 * 2340
    assert sum(kept[i] for i in range(0, 2600, 10)) == 0
    assert kept[9000] and not kept[9001] and not kept[9002]
    bare = quality.judge(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert bare.where("kept = base_failed").count() == 0


def test_thresholds_against_brute_force(spark):
    """The published counts, chances and verdicts are those of a recount, and the bound holds on what is kept."""
    rng = random.Random(16)
    rows = []
    for i in range(3000):
        bad = i % 8 == 0
        noisy = 30 if bad else min(11, int(rng.expovariate(0.6)))
        rows.append((i, "en" if i % 5 else "de", [noisy + rng.randint(0, 3) * bad, rng.randint(0, 150), rng.randint(0, 9)], 0 if bad else 1))
    labelled = spark.createDataFrame(rows, "doc_id long, stratum string, bins array<int>, quality int")
    got = {r.stratum: r for r in quality.thresholds(labelled).collect()}
    assert set(got) == {"en"}  # 262 good documents of the other are too few
    r = got["en"]
    test = [b for i, s, b, q in rows if s == "en" and q == 1 and zlib.crc32(str(i).encode()) % 2]
    k = sum(any(x >= c for x, c in zip(b, r.cutoffs, strict=True)) for b in test)
    chance = sum(math.comb(len(test), i) * 0.01**i * 0.99 ** (len(test) - i) for i in range(k + 1))
    assert (r.n, r.k) == (len(test), k) and r.chance == pytest.approx(chance) and chance <= 0.05 / 2
    assert r.cutoffs[1:] == [quality.BINS] * 2 and 11 < r.cutoffs[0] <= 30
    bad = [b for i, s, b, q in rows if s == "en" and not q]
    assert all(b[0] >= r.cutoffs[0] for b in bad)


def test_thresholds_refuse_what_the_bound_does_not_allow(spark):
    rng = random.Random(17)
    rows = [(i, "en", [rng.randint(0, 40)], int(i % 2 == 0)) for i in range(2000)]
    labelled = spark.createDataFrame(rows, "doc_id long, stratum string, bins array<int>, quality int")
    got = quality.thresholds(labelled).collect()
    test = [b[0] for i, _, b, q in rows if q and zlib.crc32(str(i).encode()) % 2]
    assert all(sum(x >= r.cutoffs[0] for x in test) <= 0.01 * len(test) for r in got)
    assert quality.thresholds(labelled.limit(0)).count() == 0


def test_quality_of_empty_table_and_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 100_000, "en", 3, True), (1, "x", "en", 3, True)], "doc_id int, text string, lang string, n_words int, kept boolean")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    got = sorted((r.n_words, r.kept) for r in quality.judge(docs, labels).collect())
    assert got == [(1, False), (200_000, False)]
    assert quality.judge(docs.limit(0), labels).count() == 0


BASE = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]+", 0))


def brute_secrets(text):
    found = []
    for k, (kind, pattern, flags) in enumerate(BASE):
        for m in re.finditer(pattern, text, flags):
            if (len(m.group(2)) >= 6) if kind == "assign" else len(m.group()) >= (20 if kind == "access" else 24):
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def test_secret_patterns():
    rng = random.Random(8)
    pieces = ["password=", "PassWord\" : '", "api_key:", "apikey = ", "token", "secret=abcdef", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "abc", "é ", " ", "\n", "ſecret=abcdefg", "toKen=abcdefg", "xyz123"]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        base = sorted(secrets.base_spans(text), key=lambda s: (s[0], secrets.KINDS.index(s[2])))
        assert secrets.joined(base) == brute_secrets(text)


def test_models_add_and_keep(spark):
    rng = random.Random(3)
    run = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    plain = "the_very_long_identifier_of_something_ordinary andAnotherCamelCaseNameThatIsLong"
    rows = [(1, f"x {run} y password=abcdef1"), (2, plain), (3, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert got[1].spans == "markov:2:42,assign:45:61"
    assert got[1].base_sha256 == hashlib.sha256(b"assign:45:61").hexdigest()
    assert (got[2].spans, got[3].spans, got[3].base_sha256) == ("", "", hashlib.sha256(b"").hexdigest())
    assert secrets.redacted(secrets.train(docs), rows[0][1]) == "x [SECRET] y [SECRET]"


def test_models_tell_held_out_runs():
    model = secrets.Markov.train(secrets.samples_of(secrets.COMMON.split()))
    fresh = secrets.samples_of(["reader", "writer", "orbit", "merge", "planet", "simple"], 500, seed=99)
    right = [(model.score(r) > model.threshold) == bool(label) for r, label in fresh if len(r) >= 20]
    assert sum(right) / len(right) > 0.9


def test_words_of_all_documents(spark):
    rows = [(1, "One two ONE Größe password=abcdef1 x"), (2, "two words-here " + "ab" * 12), (None, "two"), (3, None), (4, ""), (5, "f" * 30 + " last")]
    docs = spark.createDataFrame([(i, t, "w", 0) for i, t in rows], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in secrets.words_of(docs).collect()}
    assert got == {"one": 1, "two": 3, "words": 1, "here": 1, "last": 1}
    assert secrets.train(docs.limit(0)).random("q9Zx7KpW2vLt8RbY")


def test_short_runs_and_what_base_spans_leave():
    model = secrets.Markov.train(secrets.samples_of(secrets.COMMON.split()))
    spans = lambda t: secrets.joined(secrets.all_spans(model, t)[1])
    assert spans("q9Zx7KpW2vLt8RbY") == "markov:0:16"
    assert spans("value_of_counter connection-string 4845168114407329 2024-05-17/2024-06-01") == ""
    hexes, rest = "0a1b2c3d4e5f60718293a4b5", "ZqX9Kp7WvL2tRbY8QxZ"
    assert spans(hexes + rest) == f"hex:0:24,markov:24:{24 + len(rest)}"
    assert spans(rest + hexes) == f"markov:0:{len(rest)},hex:{len(rest)}:{len(rest) + 24}"
    assert spans("value_of_counter_" + hexes) == "hex:17:41"
    assert secrets.redacted(model, f"a {hexes}{rest} b") == "a [SECRET][SECRET] b"


def test_short_random_runs_held_out():
    model = secrets.Markov.train(secrets.samples_of(secrets.COMMON.split()))
    fresh = [(r, y) for r, y in secrets.samples_of(["reader", "writer", "orbit", "merge", "planet", "simple"], 2000, seed=99) if 16 <= len(r) < 20]
    right = lambda label: [model.random(r) == bool(label) for r, y in fresh if y == label]
    assert len(right(1)) > 50 and sum(right(1)) / len(right(1)) > 0.9
    assert len(right(0)) > 50 and sum(right(0)) / len(right(0)) > 0.9
