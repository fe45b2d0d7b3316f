import random

import numpy as np
import pytest

from lattiq.llm import near_dedup, shingles, substring_dedup
from lattiq.llm.common import Memo

SCHEMA = "doc_id long, text string, component_id int"


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


def edited(ws, k, seed):
    rng, ws = random.Random(seed), list(ws)
    for i in rng.sample(range(len(ws)), k):
        ws[i] = f"e{rng.randint(0, 10**6)}"
    return ws


def sets_of(text):
    ws = text.encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute(rows):
    ids = sorted({i for i, _ in rows})
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, sets_of(t or "")) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            if s and r and 100 * len(s & r) >= 75 * len(s | r) and top(i) != top(j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in ids}


def corpus():
    rows, n = [], 0
    for family in range(6):
        base = words(80, family)
        for k in range(8):
            rows.append((n, " ".join(edited(base, k % 5, 100 * family + k))))
            n += 1
    common = words(60, 77)
    for k in range(40):  # one passage makes much of many texts that aren't similar
        rows.append((n, " ".join(common + words(10 + 3 * k, 1000 + k))))
        n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "only four words here"), (n + 3, "Only FOUR words here"), (n + 4, " \n"), (3, rows[3][1]), (n + 5, rows[5][1])]
    return rows


def test_components_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA).repartition(3)
    got = near_dedup.near_duplicates(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sizes = {i: len(sets_of(t or "")) for i, t in rows}
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def test_empty_table_and_null_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 0)], SCHEMA)
    row = near_dedup.near_duplicates(docs).first()
    assert (row.component_id, row.kept, row.n_shingles) == (None, True, 2)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_bins_all_fill_and_estimate():
    base = words(400, 1)
    texts = [" ".join(base), " ".join(edited(base, 20, 2)), "a b c d e", ""]
    sets = shingles.shingle_sets(texts)
    sk = shingles.sketches(sets, 128)
    assert (sk[:3] != np.iinfo(np.uint64).max).all()
    a, b = set(sets.of(0).tolist()), set(sets.of(1).tolist())
    assert abs((sk[0] == sk[1]).mean() - len(a & b) / len(a | b)) < 0.15
    assert sets.sizes.tolist() == [len(a), len(b), 1, 0]


def test_memo_is_bounded():
    m = Memo(lambda k: -k, 3)
    assert [m[i] for i in (1, 2, 3, 4, 1)] == [-1, -2, -3, -4, -1]
    assert len(m) + len(m.old) <= 7


@pytest.mark.parametrize("similarity", [0.5, 0.75, 0.9])
def test_bands_reach_recall(similarity):
    n = substring_dedup.bands_for(similarity)
    assert 1 - (1 - similarity**substring_dedup.ROWS) ** n >= substring_dedup.RECALL


def test_passages(spark):
    passage = words(60, 5)
    near = edited(passage, 1, 9)
    rows = [(1, "intro\n" + " ".join(passage)), (2, " ".join(near) + "\n" + " ".join(words(60, 6))), (3, " ".join(words(70, 7)) + "\nshort line"), (4, "short line"), (5, None), (6, " ".join(passage) + "\n" + " ".join(passage)), (None, " ".join(passage))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)
    got = substring_dedup.repeated_passages(docs)
    rows_ = got.collect()
    assert {(r.doc_id, r.paragraph, r.removed) for r in rows_} == {(1, 1, False), (2, 0, True), (6, 0, True), (6, 1, True)}
    assert all((r.first_doc_id, r.first_paragraph, r.n_occurrences) == (1, 1, 4) for r in rows_)
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.end] == texts[r.doc_id].split("\n")[r.paragraph] for r in rows_)
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs.where("doc_id is not null"), got).collect()}
    assert left[2] == texts[2].split("\n")[1]
    assert left[1] == texts[1]
    assert left[6] == ""
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_passages_inside_longer_lines_and_over_short_ones(spark):
    p = words(60, 5)
    short = "\n".join(" ".join(p[i : i + 10]) for i in range(0, 60, 10))
    other = words(500, 8)
    rows = [(1, "é intro\n" + " ".join(other[:150] + p + other[150:300])), (2, "x\n" + short), (3, " ".join(words(200, 9) + p[:51])), (4, " ".join(other[300:]))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)
    got = substring_dedup.repeated_passages(docs)
    rows_, texts = got.collect(), dict(rows)
    assert {r.doc_id for r in rows_} == {1, 2, 3}
    assert all(r.removed == (r.doc_id != 1) and (r.first_doc_id, r.first_paragraph) == (1, 1) for r in rows_)
    assert all(" ".join(texts[r.doc_id][r.start : r.end].split()) in " ".join(p) and len(texts[r.doc_id][r.start : r.end].split()) >= 32 for r in rows_)
    assert all(texts[r.doc_id][: r.start].count("\n") == r.paragraph for r in rows_)
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs, got).collect()}
    assert (left[1], left[4]) == (texts[1], texts[4])
    assert len(left[2].split()) <= 1 + 60 - 32 and left[3].startswith(" ".join(words(200, 9)))


def runs_of(rows, n):
    """Documents with n equal words in a row in another document, by comparing all of them."""
    seen = {}
    for i, t in rows:
        ws = (t or "").lower().split()
        for k in range(len(ws) - n + 1):
            seen.setdefault(tuple(ws[k : k + n]), set()).add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def test_passages_at_any_offset_against_brute_force(spark):
    rng, rows = random.Random(21), []
    planted = [words(rng.randint(51, 90), 900 + k) for k in range(20)]
    for i in range(160):
        ws = words(rng.randint(40, 400), 5000 + i)
        if i < 80:
            at = rng.randint(0, len(ws))
            ws[at:at] = planted[i % 20]
        elif i < 100:  # repeats of fewer words than a window, and within one document
            ws = words(20, 3) + ws + ws[:60]
        rows.append((i, "".join(w + rng.choice([" "] * 12 + ["\n"]) for w in ws)))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == runs_of(rows, 51) == set(range(80))
    texts = dict(rows)
    for r in got:
        inner = " ".join(texts[r.doc_id][r.start : r.end].split())
        assert any(inner in " ".join(p) for p in planted)
    for i in range(80):  # all but STEP - 1 words at either end
        spans = [(r.start, r.end) for r in got if r.doc_id == i]
        covered = " ".join(texts[i][min(a for a, _ in spans) : max(b for _, b in spans)].split()).split()
        assert len(covered) >= len(planted[i % 20]) - 2 * (substring_dedup.STEP - 1)
    inside = substring_dedup.repeated_passages(docs, within=True).select("doc_id").distinct().collect()
    assert {r.doc_id for r in inside} == set(range(100))


def test_words_against_splitting():
    texts = ["É  Été\tx\x0by", "", " \n", "ABC abc " + "L" * 60 + " " + "l" * 60, "\x1c a\x1cb 日本"]
    got = shingles.words_of(texts)
    split = [(i, w) for i, t in enumerate(texts) for w in t.encode().lower().split()]
    assert got.item.tolist() == [i for i, _ in split]
    pairs = list(zip(got.hashes.tolist(), [w for _, w in split], strict=True))
    assert len(dict(pairs)) == len({w for _, w in pairs}) == len(set(pairs))


def test_each_run_of_51_words_has_a_window():
    for seed in range(100):
        p = words(51, seed)
        a, b = words(90, 200 + seed) + p + words(70, 400 + seed), words(seed, 600 + seed) + p
        found = [set(substring_dedup.Places.of([" ".join(t)]).windows(32)["node"].tolist()) for t in (a, b)]
        assert found[0] & found[1]


def test_equal_windows_of_a_text_do_not_overlap():
    got = substring_dedup.Places.of(["other " * 3, "a " * 200]).windows(32)
    at = sorted(got["start"].tolist())
    assert at and all(y - x >= 64 for x, y in zip(at, at[1:], strict=False))
    assert set(got["text"].tolist()) == {1}


def test_clusters_send_the_lowest_document_once(spark):
    from lattiq.llm.substring_dedup import clusters_of

    places = spark.createDataFrame([(1, 0, 0, 7), (2, 5, 1, 7), (3, 0, 0, 8), (3, 9, 1, 8), (4, 0, 0, 9)], "doc_id long, start long, paragraph long, node long")
    made = {w: clusters_of(places, "node", w) for w in (False, True)}
    assert [(r.node, tuple(r["first"]), r.n_occurrences) for r in made[False].collect()] == [(7, (1, 0, 0), 2)]
    assert sorted((r.node, tuple(r["first"]), r.n_occurrences) for r in made[True].collect()) == [(7, (1, 0, 0), 2), (8, (3, 0, 0), 2)]
    assert "min(doc_id" not in made[False]._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_a_key_are_sent_once(spark, monkeypatch, tmp_path):
    from lattiq.llm import common, links

    rng = random.Random(4)
    rows = [(rng.randint(0, 40), 0, 0, 9 * k, 9 * k + 5, rng.randint(0, 300)) for k in range(600)]
    rows += [(k, 1, 1, 7, 12, 1000) for k in range(700)] + [(3, 2, 2, 10 * k, 10 * k + 5, 1001) for k in range(700)]  # keys of many rows
    spark.createDataFrame(rows, "doc_id long, paragraph long, last long, start long, end long, node long").write.parquet(f"{tmp_path}/places")
    places = spark.read.parquet(f"{tmp_path}/places")
    of = {}
    for r in rows:
        of.setdefault(r[5], []).append((r[0], r[3], r[1]))
    for within in (False, True):
        clusters = {n for n, p in of.items() if len(set(p) if within else {x[0] for x in p}) > 1}
        want = sorted((*r[:5], min(of[r[5]])[0], min(of[r[5]])[2], len(of[r[5]]), (r[0], r[3], r[1]) != min(of[r[5]]), r[5]) for r in rows if r[5] in clusters)
        for least, hot in ((512, {1000, 1001}), (10**6, set())):  # both ways give the same
            monkeypatch.setattr(substring_dedup, "hot_and_cold", lambda x, key, least=least: common.hot_and_cold(x, key, least))
            some = common.hot_and_cold(places, "node", least)[0]
            assert hot <= ({r.node for r in some.select("node").distinct().collect()} if some else set())
            assert bool(some) == bool(hot)
            got = substring_dedup.judged(places, "node", within)
            assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert "struct(" not in plan[plan.index("Exchange hashpartitioning") :]  # what a window needs besides is not sent

    pairs = sorted({(r[5], r[0]) for r in rows})
    keyed = places.select(places["node"].alias("key"), places["doc_id"].alias("node"))
    lows = {k: min(n for x, n in pairs if x == k) for k, _ in pairs}
    want = sorted((k, n, lows[k]) for k, n in pairs if any(x == k and m != n for x, m in pairs))
    for least in (512, 10**6):
        monkeypatch.setattr(links, "hot_and_cold", lambda x, key, least=least: common.hot_and_cold(x, key, least))
        got = links.members_of(keyed)
        assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_prefixes_carry_the_component(spark):
    from lattiq.llm import links

    sets = {7: (np.arange(10), 3), 8: (np.arange(5, 17), 8)}
    rows = [(n, bytearray(s.astype(np.uint64).tobytes()), c) for n, (s, c) in sets.items()]
    got = links.prefixes(spark.createDataFrame(rows, "node long, set binary, comp long"), 75).collect()
    assert {(r.node, r.n, r.comp) for r in got} == {(7, 10, 3), (8, 12, 8)}
    assert all(r.key in sets[r.node][0] for r in got) and len(got) == 3 + 4
