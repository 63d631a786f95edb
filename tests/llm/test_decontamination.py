"""Decontamination against brute force."""

import random

import numpy as np

from quillrec.llm import decontamination as dc

SF = "/root/testdata/sf0.01"


def windows(ids, width):
    k = min(width, len(ids))
    return {tuple(ids[j : j + k]) for j in range(len(ids) - k + 1)} if k else set()


def brute(docs, items, overlap=0.8):
    out = set()
    for d, text in docs:
        doc = dc.words(text or "")
        for i, item in items:
            if item is None or not dc.words(item):
                continue
            q, a = dc.question_and_answer(item)
            share = [len(windows(p, 5) & windows(doc, min(5, len(p)))) / len(windows(p, 5)) for p in (q, a)]
            if min(share) >= overlap:
                out.add((d, i))
    return out


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_whole_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = dc.contaminated(docs, items)
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert pairs(got) == want and want
    kept = {r.doc_id for r in dc.drop_contaminated(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}
    assert pairs(dc.contaminated(docs, items, block_chars=1000)) == want


def test_planted_leaks_with_edits(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice((1, 2, 4, 5, 9, 20, 40, 120)))) + rng.choice(("", ".\nYes it is " + " ".join(say(6))))) for i in range(60)]
    docs = []
    for d in range(250):
        text = say(rng.randrange(200))
        if d % 2:
            leak = rng.choice(items)[1].split(" ")
            for _ in range(rng.randrange(4)):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = leak
        docs.append((d, " ".join(text)))
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert pairs(got) == want and len(want) > 40


def test_parts_far_apart():
    say = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    items = [(1, f"{say('q', 10)}\n{say('a', 12)}"), (2, say("s", 24)), (3, f"{say('t', 9)}\nyes"), (4, f"{say('u', 3)}\n{say('v', 2)}")]
    gap, (q, a), s = say("x", 300), items[0][1].split("\n"), items[1][1].split()
    texts = [f"{q} {gap} {a}", f"{a} {gap} {q}", q, " ".join(s[:12]) + f" {gap} " + " ".join(s[12:]), f"{say('t', 9)} {gap} Yes", f"{say('v', 2)} {gap} {say('u', 3)}", gap, ""]
    docs = list(enumerate(texts))
    got = {(d, m[0]) for d, own in enumerate(dc.Index(items).matches(texts)) for m in own if min(m[2:]) >= 0.8}
    assert got == brute(docs, items) == {(0, 1), (1, 1), (3, 2), (4, 3), (5, 4)}


def test_scattered_runs_and_repeated_words():
    """Runs of an item's words stand in any order and far apart, or its words repeat: windows find what no passage holds."""
    rng = random.Random(9)
    items, texts = [], []
    for i in range(40):
        q = [rng.choice((f"q{i}", f"r{i}", "the")) if i % 3 == 0 else f"{i}n{k}" for k in range(rng.randrange(8, 90))]
        a = [f"{i}a{k}" for k in range(rng.randrange(1, 12))]
        items.append((i if i % 9 else None, " ".join(q) + "\n" + " ".join(a)))
        cuts = sorted(rng.sample(range(1, len(q)), min(rng.randrange(4), len(q) - 1)))
        runs = [q[x:y] for x, y in zip([0, *cuts], [*cuts, len(q)], strict=True)] + [a]
        rng.shuffle(runs)
        texts.append(f" {'gap ' * 70}".join(" ".join(r) for r in runs))
    got = {(d, m[0]) for d, own in enumerate(dc.Index(items).matches(texts)) for m in own if min(m[2:]) >= 0.8}
    assert got == brute(list(enumerate(texts)), items) and len(got) > 15


def test_search_equals_sums_over_all_postings():
    rng = random.Random(5)
    vocab = [f"w{int(rng.paretovariate(0.8))}" for _ in range(3000)]
    index = dc.Index([(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60)))) for i in range(700)])
    starts = index.start
    found = 0
    for _ in range(300):
        terms = np.unique([index.term[w] for w in rng.sample(sorted(index.term), 20)] + [index.term[w] for w in rng.choices(vocab, k=30) if w in index.term])
        if rng.random() < 0.5:  # most of an entry
            e = rng.randrange(len(index.item_of))
            own = np.flatnonzero([e in index.entry[a:b] for a, b in zip(starts, starts[1:], strict=False)])
            terms = np.unique(np.concatenate((terms, own[: len(own) - rng.randrange(3)])))
        total = np.zeros(len(index.item_of))
        for t in terms.tolist():
            total[index.entry[starts[t] : starts[t + 1]]] += index.impact[starts[t] : starts[t + 1]]
        want = set(np.flatnonzero(total >= 1 - 1e-9).tolist())
        hits = dict(index.search(terms.tolist()))
        assert set(hits) == want and all(abs(hits[e] - total[e]) < 1e-9 for e in want)
        assert index.promising(terms) or not want
        found += len(want)
    assert found > 50


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, item, "x"), (1, item, "y"), (None, f"A {item.upper()}!", None), (3, None, ""), (4, "", ""), (5, "z " * 60000 + item, "")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (10, ""), (11, " ,. "), (None, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, 1, None, 5) for i in (7, 8, None)], key=str)
    nameless = dc.contaminated(docs, items.where("item_id is null"))
    assert sorted((str(r.doc_id), r.item_id) for r in nameless.collect()) == [("1", None), ("1", None), ("5", None), ("None", None)]
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]
    assert dc.contaminated(docs.limit(0), items).count() == 0 and dc.contaminated(docs, items.limit(0)).count() == 0
