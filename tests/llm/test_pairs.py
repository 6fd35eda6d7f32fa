"""Jaccard join and substring dedup against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from plumbline.llm import jaccard_join as jj
from plumbline.llm import substring_dedup as sd


def shingles(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    return sorted(((i, len(shingles(t, k)), None if i is None else find(i)) for i, t in rows), key=str)


def families(seed=1, n=40):
    g = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [g.choice(vocabulary) for _ in range(60)]
    rows = []
    for f in range(n):
        base = [g.choice(vocabulary) for _ in range(g.choice([3, 6, 9, 40, 120, 300]))] + (passage if f % 3 == 0 else [])
        for _ in range(g.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(g.choice([0, 0, 1, 2, 4])):
                w[g.randrange(len(w))] = g.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "num", "den", "limit"), [(4, 85, 100, jj.GROUP_TOKENS), (5, 80, 100, 600)])
def test_classes_equal_brute_force(spark, k, num, den, limit):
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jj.jaccard_classes(df, k, num, den, group_tokens=limit).collect()
    assert sorted(map(tuple, got), key=str) == classes(rows, k, num, den)


def test_common_signatures(spark, monkeypatch):
    rows = families(2, 25)
    plain = jj.coarse_links
    monkeypatch.setattr(jj, "coarse_links", lambda shared: plain(shared, common=1))
    got = jj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100, group_tokens=600).collect()
    assert sorted(map(tuple, got), key=str) == classes(rows, 4, 85, 100)


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_a_coarse_group_in_parts_shuffles_its_own_tokens_alone(spark, monkeypatch, k, num):
    """One family that no task holds, among many small ones: what its parts exchange is less than a quarter of all tokens."""
    g = random.Random(7)

    def changed(words, n):
        return [g.randrange(10**6) if i in at else w for at in [g.sample(range(len(words)), n)] for i, w in enumerate(words)]

    base = g.sample(range(10**6), 300)
    texts = [changed(base, 4) for _ in range(10)]
    for _ in range(300):
        pair = g.sample(range(10**6), 90)
        texts += [pair, changed(pair, 1)]
    rows = [(i, " ".join(map(str, t))) for i, t in enumerate(texts)]
    store, across, found = spark.sparkContext._jsc.sc().statusStore(), jj._across, []

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        seen = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {seen.apply(i).stageId(): seen.apply(i).shuffleWriteBytes() for i in range(seen.size())}

    def measured(tokens, *more):
        before, out = stages(), across(tokens, *more)
        found.append((sum(n for i, n in stages().items() if i not in before), sum(len(r["tokens"]) for r in tokens.collect())))
        return out

    monkeypatch.setattr(jj, "_across", measured)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), k, num, 100, group_tokens=1000).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sorted(map(tuple, got), key=str) == classes(rows, k, num, 100)
    (shuffled, whole), = found
    assert shuffled < whole / 4


def test_odd_documents(odd, none):
    got = sorted(map(tuple, jj.jaccard_classes(odd, 4, 85, 100).collect()), key=str)
    want = classes([(r["doc_id"], r["text"]) for r in odd.collect()], 4, 85, 100)
    assert got == want
    assert jj.jaccard_classes(none).count() == 0


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100)])
def test_linked_sets_share_what_they_must(num, den):
    """Linked sets, changed as much as they may be, larger ones included, agree on as many signatures of some one number of ranges as either needs there."""
    g = np.random.default_rng(3)

    def random(n):
        return np.unique(g.integers(0, 2**64, n, dtype=np.uint64))

    def linked(a, b):
        both = len(np.intersect1d(a, b))
        return den * both >= num * (len(a) + len(b) - both)

    for n in (5, 6, 7, 20, 41, 45, 46, 90, 118, 120, 400, 2000):
        for kind in ("swap", "add", "drop") * 4:
            a = b = random(n)
            while True:
                c = b if kind == "add" else np.delete(b, g.integers(len(b)))
                c = np.union1d(c, random(1)) if kind != "drop" else c
                if not len(c) or not linked(a, c):
                    break
                b = c
            if len(np.intersect1d(a, b)) == len(a) == len(b):
                continue
            values, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            doc, found, need = jj.signatures(values, at, np.arange(2), num, den)
            of = [dict(zip(found[doc == d].tolist(), need[doc == d].tolist(), strict=True)) for d in (0, 1)]
            shared = of[0].keys() & of[1].keys()
            assert shared and len(shared) >= min(max(of[0][x], of[1][x]) for x in shared)


def test_ranges_by_size():
    sizes = np.arange(1, 5000)
    found = jj.ranges_of(sizes, 85, 100)
    assert (np.diff(found) >= 0).all() and (found[:5] == 0).all()
    for ranges in np.unique(found[found > 0]).tolist()[:-1]:
        assert jj.largest_of(ranges, 85, 100) == sizes[found <= ranges].max()


def test_a_less_similar_member_keeps_no_link_out(spark):
    rows = [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 1, 5), (1, 2, 3), (2, 2, 3), (3, 2, 3), (4, 2, 3)]  # signature 4 of a member of group 1 that isn't the linked one
    links = jj.coarse_links(spark.createDataFrame(rows, "sig long, node long, need int")).collect()
    assert [tuple(r) for r in links] == [(1, 2, False)]


def test_three_sets_of_which_two_meet_first(spark):
    base = "t141142 t574751 t956165 t756184 t947488 t177202 t682955 t517719 t155172 t20218 t812514 t611441 t35384 t502424 t153388 t197764 t794164 t823852"
    rows = [(1, base), (2, base + " x976616 x451409 x255378"), (3, base + " x976616 x475295 x685332")]
    got = jj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85, 100).collect()
    assert sorted(map(tuple, got), key=str) == classes(rows, 1, 85, 100) and {r["component_id"] for r in got} == {1}


def without_repeats(rows, width):
    first = {}
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - width + 1):
            if i is not None:
                first[tuple(w[p : p + width])] = min(i, first.get(tuple(w[p : p + width]), i))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p : p + width])] < i:
                gone |= set(range(p, p + width))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [sd.HOT, 1])
def test_repeats_equal_brute_force(spark, hot):
    g = random.Random(4)
    pool = [" ".join(f"v{g.randrange(300)}" for _ in range(70)) for _ in range(6)]
    rows = [(i, " \n".join(" ".join(f"u{g.randrange(10**6)}" for _ in range(g.randrange(60))) + " " + g.choice(pool) for _ in range(g.randrange(4)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sd.remove_repeats(df, hot=hot).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == without_repeats(rows, 50)
    assert all(r["n_removed"] == 0 or len(r["text"].split()) == r["n_words"] - r["n_removed"] for r in got)


def test_odd_repeats(odd, none):
    got = sorted(map(tuple, sd.remove_repeats(odd, with_text=False).collect()), key=str)
    assert got == without_repeats([(r["doc_id"], r["text"]) for r in odd.collect()], 50)
    assert sd.remove_repeats(none).count() == 0


def test_sliding_min():
    g = np.random.default_rng(5)
    x = g.integers(0, 50, 200, dtype=np.uint64)
    for w in (1, 2, 7, 50, 199, 200):
        assert sd.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(200 - w + 1)]
