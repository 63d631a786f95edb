"""Signatures, classes and kept rows against brute force."""

import random
from collections import Counter

import numpy as np

from quillrec.llm import near_dedup as nd
from quillrec.llm.common import as_set, components, overlap, shingles


def grams(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    total = sum((a | b).values())
    return both / total if total else 1.0


def brute(docs):
    """doc -> smallest doc of its component, over all pairs."""
    sets = {d: grams(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if similarity(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_shingles_and_overlap():
    texts = ["a b c d e f", "a b c d e f", "", "a b", "a  b", "x " * 30, "x " * 20, "é\x0bü\tc d e\nf"]
    sets = [as_set(s) for s in shingles([t.encode() for t in texts])]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(overlap(sets[i], sets[j]) - similarity(grams(a), grams(b))) < 1e-12


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    for shared, own, times in ((200, 100, 1), (60, 5, 3), (10, 2, 40), (3, 1, 500)):
        a = np.sort(np.concatenate((np.repeat(pool[:shared], times), pool[shared : shared + own])))
        b = np.sort(np.concatenate((np.repeat(pool[:shared], times), np.repeat(pool[shared + own : shared + 2 * own], times))))
        ca, cb = Counter(a.tolist()), Counter(b.tolist())
        want = sum((ca & cb).values()) / sum((ca | cb).values())
        s = nd.signatures([a, b], size=6000)
        assert abs((s[0] == s[1]).mean() - want) < 0.03
    s = nd.signatures([a, np.zeros(0, np.uint64), a[:1]])
    assert (s[1] == 0).all() and s.shape == (3, nd.BANDS * nd.ROWS)
    assert (nd.signatures([a])[0] == nd.signatures([b, a])[1]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {x: r for x, r in root.items() if any(x in e for e in edges if e[0] != e[1])}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs = []
    for _ in range(60):
        docs.append(say(rng.choice((0, 1, 3, 5, 30, 200))))
    for size in (2, 3, 40, 160):
        base = say(150)
        for _ in range(size):
            text = base[:]
            for _ in range(rng.randrange(6)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            docs.append(text)
    docs += [docs[5]] * 4 + [["x"] * 700, ["x"] * 800, ["x"] * 2000, []]
    rng.shuffle(docs)
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


def test_classes_equal_brute_force(spark):
    docs = corpus()
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for budget in (1 << 20, 1 << 13):
        rows = nd.duplicate_classes(df, budget=budget).collect()
        assert {r.d: r.k.d for r in rows} == want
    rows = nd.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in rows} == want
    assert sorted(r.doc_id for r in rows if r.is_kept) == sorted(set(want.values()))
    assert sorted(r.doc_id for r in nd.keep_one_of_each(df).collect()) == sorted(set(want.values()))


def by_matrix(docs):
    """As ``brute``, with all shared windows counted in one matrix product; for texts without repeated windows."""
    sets = [set(grams(t)) for _, t in docs]
    place = {w: i for i, w in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(place)), dtype=np.float32)
    for i, s in enumerate(sets):
        has[i, [place[w] for w in s]] = 1
    shared, size = has @ has.T, has.sum(1)
    linked = shared >= 0.8 * (size[:, None] + size[None, :] - shared) - 1e-6
    label, before = np.arange(len(sets)), None
    while before is None or (label != before).any():
        before, label = label, np.where(linked, label[None, :], len(sets)).min(1)
    return {d: docs[label[i]][0] for i, (d, _) in enumerate(docs)}


def test_similar_pairs_equal_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(12):
        base, sets = rng.integers(0, 1 << 62, 60).astype(np.uint64), []
        for _ in range(int(rng.integers(1, 70))):
            kind = rng.random()
            if kind < 0.7:
                own = base[rng.random(60) < rng.choice((0.8, 0.9, 0.97))]
                own = np.concatenate((own, rng.integers(0, 1 << 62, int(rng.integers(0, 9))).astype(np.uint64)))
            elif kind < 0.9:
                own = rng.choice(base, 4 + trial, replace=False)
            else:
                own = rng.integers(0, 1 << 62, 1 + trial * 7).astype(np.uint64)
            sets.append(np.unique(own))
        got = nd.similar_pairs(sets)
        want = np.array([[overlap(a, b) >= 0.8 - 1e-9 for b in sets] for a in sets])
        assert (got == want).all()


def test_blocks_cover_every_pair_of_components_once_enough(spark):
    """All pairs across components meet, no block is over its share, and rows stay in proportion to a large component."""
    rng = random.Random(4)
    # a bucket of one large component of 2,000 nodes and 30 others; one of small components only; one with one component
    rows = [(1, n, 7 if n < 2000 else n, rng.randrange(100, 700)) for n in range(2030)]
    rows += [(2, 10_000 + n, 10_000 + n // 2, 40) for n in range(50)] + [(3, 20_000 + n, 1, 40) for n in range(20)]
    placed = spark.createDataFrame(rows, "bucket long, node long, comp long, size long")
    comp = {(b, n): c for b, n, c, _ in rows}
    for budget in (1 << 20, 1 << 16):
        got = nd._blocks(placed, budget).collect()
        groups = {}
        for r in got:
            groups.setdefault((r.bucket, r.i, r.j), []).append(r.node)
        met = {(b, x, y) for (b, _, _), g in groups.items() for x in g for y in g if comp[b, x] != comp[b, y] and x < y}
        assert met == {(b, x, y) for b, x, cx, _ in rows for b2, y, cy, _ in rows if b == b2 and x < y and cx != cy}
        assert len(got) <= 2 * len(rows)
        assert max(map(len, groups.values())) <= 2.5 * budget / 512


def test_a_large_group_of_near_copies_makes_rows_in_proportion(spark, monkeypatch):
    """2,000 near copies, many of them less than 0.8 alike: no step makes more than some rows for each node and bucket."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(60)]
    docs = []
    for i in range(2000):
        text = base[:]
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            text[rng.randrange(60)] = rng.choice(vocab)
        docs.append((i, " ".join(text)))
    made = {}
    write = nd.stored

    def counted(df, name):
        out = write(df, name)
        made[name] = out.count()
        return out

    inputs = []
    spanning = nd._spanning
    monkeypatch.setattr(nd, "stored", counted)
    monkeypatch.setattr(nd, "_spanning", lambda m: spanning(inputs.append(m.count()) or m))
    rows = nd.duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.d: r.k.d for r in rows} == by_matrix(docs)
    assert max(made.values()) <= made["members"] <= 24 * len(docs) and inputs[0] <= made["members"]


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(20000))
    rows = [(3, "a b c d e f", 1), (3, "a b c d e f", 1), (3, "other words in this one here", 2), (None, "a b c d e f", 3), (None, None, 4), (8, "", 5), (9, " \n", 6), (10, long, 7), (11, long + " x", 8), (None, "alone by itself it is now", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = sorted(((r.doc_id, r.class_id) for r in nd.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (3, 3), (None, 3), (None, 8), (8, 8), (9, 8), (10, 10), (11, 10), (None, None)], key=str)
    kept = nd.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.class_id for r in kept.collect())) == [1, 2, 5, 7, 9]
    assert nd.near_duplicates(df.limit(0)).count() == 0 and nd.keep_one_of_each(df.limit(0)).count() == 0
