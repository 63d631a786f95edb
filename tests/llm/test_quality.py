"""Quality classifier and quality rules."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrec.llm import quality_classifier as qc
from quillrec.llm import quality_rules as qr

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"w{i % 700}" for i in range(70_000))
ODD = [None, "", " \n\t", "a b c a b c", "x " * 60, "#a\n#a\n \n#a", "é 　 ß\x0bü", "a b c d", LONG, "one\ntwo\none\n\n", "a b a b a b a"]


# ---------------------------------------------------------------- classifier


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = qc.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert model.feature.shape == model.threshold.shape == model.left.shape == (60, 31)
    # by hand, one row at a time
    for row in x[:5]:
        total = model.prior
        for t in range(60):
            at = 0
            while model.left[t, at] != at:
                at = model.left[t, at] if row[model.feature[t, at]] <= model.threshold[t, at] else model.right[t, at]
            total += model.value[t, at]
        assert abs(1 / (1 + np.exp(-total)) - model.score(row[None])[0]) < 1e-12


def test_fit_without_both_labels():
    assert qc.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (qc.fit(np.ones((4, 3)), np.ones(4)).score(np.ones((2, 3))) > 0.9).all()
    assert np.isfinite(qc.fit(np.ones((9, 3)), np.arange(9) % 2.0).score(np.ones((2, 3)))).all()


def brute_tree(x, y, margin, depth, bins, rate, least, l2):
    """The margins that one tree adds, from every split of every node tried in turn: (gain, feature, cut), the first best wins."""
    p = 1 / (1 + np.exp(-margin))
    g, h = y - p, p * (1 - p)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    out = np.zeros(len(y))

    def grow(rows, level):
        best = (1e-6, None, None)
        for f in range(x.shape[1]) if level < depth else ():
            for cut in cuts[f]:
                low = rows[x[rows, f] <= cut]
                high = rows[x[rows, f] > cut]
                if h[low].sum() < least or h[high].sum() < least:
                    continue
                part = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                gain = part(low) + part(high) - part(rows)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, f, cut)
        if best[1] is None:
            out[rows] = rate * g[rows].sum() / (h[rows].sum() + l2)
            return
        _, f, cut = best
        grow(rows[x[rows, f] <= cut], level + 1)
        grow(rows[x[rows, f] > cut], level + 1)

    grow(np.arange(len(y)), 0)
    return out


def test_trees_equal_a_search_of_all_splits():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(160, 3)), rng.integers(3, size=160), np.ones(160)])
    y = (x[:, 0] + (x[:, 3] == 1) + 0.3 * rng.normal(size=160) > 0.5).astype(float)
    options = {"depth": 3, "bins": 8, "rate": 0.3, "least": 2.0, "l2": 1.0}
    model = qc.fit(x, y, rounds=4, **options)
    margin = np.full(len(y), model.prior)
    for _ in range(4):
        margin = margin + brute_tree(x, y, margin, **options)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-margin)), atol=1e-12)


def test_statistics_by_hand():
    text = "The cat\nthe CAT! 12\n\nThe cat\né"
    data = text.encode()
    x = qc.statistics([text, "", text])
    assert (x[1] == 0).all() and (x[0] == x[2]).all()
    share = [sum(b in c for b in data) / len(data) for c in qc._CLASSES]
    words, lines = data.split(), [b"The cat", b"the CAT! 12", b"The cat", "é".encode()]
    size = [len(w) for w in words]
    mean = sum(size) / 8
    want = [
        *share, math.log(1 + len(data)), math.log(9), mean, max(size), (sum((s - mean) ** 2 for s in size) / 8) ** 0.5, 6 / 8, 6 / 7,
        1 / 8, math.log(5), 3 / 4, 8 / 4, 1 / 8, 3 / 6,
    ]
    assert len(words) == 8 and np.allclose(x[0], want)


def test_sample_bounds_repeated_doc_ids(spark):
    """A doc_id that holds most rows gives one row to the fit, in whatever order its texts come."""
    rows = [(7, f"word {i}") for i in range(300)] + [(i, f"text number {i}") for i in range(8, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7, 40)], "doc_id long, quality int")
    seen = []
    real = qc.fit
    qc.fit = lambda x, y: seen.append((x.tolist(), y.tolist())) or real(x, y)
    try:
        for some in (rows, rows[::-1]):
            qc.train(spark.createDataFrame(some, "doc_id long, text string").repartition(3), labels)
    finally:
        qc.fit = real
    assert seen[0] == seen[1] and len(seen[0][1]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(7, 40))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in qc.classify(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(held) > 300 and np.mean([p == q for p, q in held]) > 0.97
    kept = {r.doc_id for r in qc.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {d for d, r in rows.items() if r.predicted}


def test_classifier_on_odd_rows(spark):
    docs = spark.createDataFrame([(i if i else None, t, 0.5) for i, t in enumerate(ODD)] + [(3, "again", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(2, 1, None), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = qc.classify(docs, labels).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert qc.classify(docs, labels.limit(0)).count() == len(ODD) + 1 and qc.classify(docs.limit(0), labels).count() == 0
    assert qc.keep_good(docs, labels).columns == docs.columns


# ---------------------------------------------------------------- rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^ \x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {p + o for p in range(len(words) - 2) if windows[tuple(words[p : p + 3])] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^ \x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def counts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("words", F.array_remove(F.split("text", qr.SPACE), ""))
    return [tuple(r)[1:] for r in df.select("i", *(c.alias(n) for n, c in qr.text_counts(F.col("text"), F.col("words")).items())).orderBy("i").collect()]


def test_counts(spark):
    assert counts(spark, ODD) == [brute(t) for t in ODD]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#\t\x0bé|", max_size=60), min_size=30, max_size=60))
def test_counts_of_any_text(spark, texts):
    assert counts(spark, texts) == [brute(t) for t in texts]


def host_docs():
    """Twelve documents with a shared footer, which is most of one of them; copies of one text; another host."""
    body = lambda i, n: " ".join(f"d{i}w{k}" for k in range(n))
    footer = "All  Rights reserved " + " ".join(f"f{k}" for k in range(60))
    rows = [(i, f"{body(i, 200)}\n{footer.upper() if i % 2 else footer}", "h") for i in range(12)]
    rows.append((50, f"{body(50, 20)}\n{footer}", "h"))
    rows.append((51, f"{body(51, 20)}\n{footer}", "other"))
    rows.append((52, f"{body(52, 20)}\n{footer}", None))
    rows += [(100 + i, f"{body(100, 80)}\n{body(101, 80)}", "h") for i in range(40)]
    return rows


def test_lines_that_documents_of_a_host_share(spark):
    df = spark.createDataFrame(host_docs(), "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in qr.quality_rules(df).collect()}
    assert [d for d, r in rows.items() if r.depleted] == [50]
    assert not rows[50].kept and all(r.kept for d, r in rows.items() if d != 50)
    clean = {r.doc_id: r.text for r in qr.cleaned(df).collect()}
    assert "\n" not in clean[0] and clean[51] == host_docs()[13][1] and clean[100] == host_docs()[15][1]


def test_documents_that_share_several_lines_are_distinct(spark):
    """Both lines stand in the same documents, so each document's smallest line is one of the two in most of them."""
    shared = [" ".join(f"{c}{k}" for k in range(60)) for c in "st"]
    rows = [(i, "\n".join([*shared, f"own line {i}"]), "h") for i in range(11)] + [(100 + i, "\n".join([*shared, f"own line {i}"]), "few") for i in range(10)]
    rows += [(200 + i, "\n".join([*shared, "own line 0"]), "few") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in qr.quality_rules(df).collect() if r.depleted} == set(range(11))
    clean = {r.doc_id: r.text for r in qr.cleaned(df).collect()}
    assert clean[3] == "own line 3" and clean[103] == rows[14][1] and clean[200] == rows[21][1]


def verdicts(rows, limit=10):
    """doc_id -> (kept, depleted) by brute force; doc_ids are distinct."""
    lines_of = lambda t: [" ".join(w) for x in (t or "").split("\n") if (w := re.findall(r"[^ \x09-\x0d]+", x.lower()))]
    holders = {}
    for _, text, host in rows:
        for line in lines_of(text):
            holders.setdefault((host or "", line), set()).add(text or "")
    out = {}
    for d, text, host in rows:
        sizes = [(len(x.split(" ")), len(holders[host or "", x]) > limit) for x in lines_of(text)]
        n, _, _, _, again = brute(text)
        depleted = sum(k for k, over in sizes if over) > 0.5 * sum(k for k, _ in sizes)
        out[d] = (n >= 50 and 100 * again <= 50 * n and not depleted, depleted)
    return out


def test_verdicts_equal_brute_force(spark):
    """Any footer counts alike, whatever its hash: 40 hosts, each with its own; and documents dealt at random."""
    rng = random.Random(6)
    rows = []
    for host in range(40):
        footer = " ".join(f"h{host}f{k}" for k in range(66))
        rows += [(len(rows) + i, "\n".join([*(f"d{host} {i} {j} a b c" for j in range(6)), footer]), f"h{host}") for i in range(9 + host % 5)]
    pool = ["\t ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    for i in range(600):
        text = "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randrange(7)))
        rows.append((10_000 + i, text if i % 97 else None, rng.choice(("x", "y", None))))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = verdicts(rows)
    assert {r.doc_id: (r.kept, r.depleted) for r in qr.quality_rules(df).collect()} == want
    assert 100 < sum(d for _, d in want.values()) < len(rows) - 100


def test_rules_on_odd_rows(spark):
    rows = [(i if i else None, t, "s") for i, t in enumerate(ODD)] + [(3, ODD[3], "s"), (3, ODD[3], "s"), (3, "other", "s")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, source string, kept boolean")
    got = sorted(((r.doc_id, *tuple(r)[1:6]) for r in qr.quality_rules(df).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t, _ in rows), key=str)
    assert qr.quality_rules(df.limit(0)).count() == 0
    assert qr.cleaned(df).count() == len(rows)
