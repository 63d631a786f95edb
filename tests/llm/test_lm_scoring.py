"""LM scores: base by brute force, the model as a distribution, clusters."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillrec.llm import lm_scoring as lm
from quillrec.llm.common import word_hashes

SF = "/root/testdata/sf0.001"
END = " "  # no word has a space


def words(text):
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()] + [END]


def hash_of(word):
    return lm.END if word == END else word_hashes([word.encode("utf-8", "surrogatepass")])[0][0]


def shape_of(word):
    b = word.encode("utf-8", "surrogatepass")
    if any(48 <= x <= 57 for x in b):
        return 0
    if chr(b[-1]) in ".!?":
        return 2
    if b[-1] < 128 and not chr(b[-1]).isalpha() and chr(b[-1]) != "'":
        return 1
    return 3 if len(b) < 8 else 4


def held_out(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1


def brute_base(docs):
    toks = {i: words(t) for i, (_, t) in enumerate(docs)}
    counts = Counter(w for i, (d, _) in enumerate(docs) if not held_out(d) for w in toks[i])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, (d, _) in enumerate(docs):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks[i])
        out.append((d, held_out(d), len(toks[i]), sum(counts[w] > 0 for w in toks[i]), n, base))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)


@pytest.mark.parametrize("head", [40, 120_000])
def test_base_scores(spark, head):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lm.score_documents(df, clustered=30, head=head, classes=6).collect()
    want = brute_base([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    same([tuple(r)[:6] for r in rows], want)
    assert all(r.score < 0 for r in rows)


def trained(df, **options):
    tokens = lm.tokenised(lm.named(df)).where("train")
    return lm.train(lm.word_counts(tokens), tokens, **options)


def class_of(model, word):
    at = int(model.place(np.array([hash_of(word)]))[0])
    return int(model.cls[at]) if at >= 0 else len(model.log_next) - len(lm.SHAPES) + shape_of(word)


def brute_scores(docs, model):
    """doc -> log10 P of its text, from the classes of the model's words alone."""
    texts = {d: words(t) for d, t in docs}
    cls = {w: class_of(model, w) for w in {w for t in texts.values() for w in t}}
    train = [t for d, t in texts.items() if not held_out(d)]
    width, shapes = len(model.log_next), len(model.log_next) - len(lm.SHAPES)
    count = Counter(w for t in train for w in t)
    inside, kinds = Counter(), Counter(range(shapes, width))  # a slot for unseen words in each shape class
    for w, n in count.items():
        inside[cls[w]] += n
        kinds[cls[w]] += 1
    steps = Counter((cls[a], cls[b]) for t in train for a, b in zip([END, *t], t, strict=False))
    after = Counter()
    for (a, _), n in steps.items():
        after[a] += n
    filled = sum(kinds[c] > 0 for c in range(width))
    p_next = lambda a, b: (steps[a, b] + 0.5) / (after[a] + 0.5 * filled)
    p_word = lambda w: (count[w] + 0.5) / (inside[cls[w]] + 0.5 * kinds[cls[w]])
    for a in range(width):  # both are distributions
        assert sum(p_next(a, b) for b in range(width) if kinds[b]) == pytest.approx(1)
        mass = sum(p_word(w) for w in count if cls[w] == a) + (0.5 / (inside[a] + 0.5 * kinds[a]) if a >= shapes else 0)
        assert mass == pytest.approx(1) or not kinds[a]
    return {d: sum(math.log10(p_next(cls[a], cls[b]) * p_word(b)) for a, b in zip([END, *t], t, strict=False)) for d, t in texts.items()}


@pytest.mark.parametrize(("clustered", "head", "classes"), [(40, 60, 7), (40, 5000, 7), (400, 1_000_000, 300)])
def test_scores_equal_brute_force(spark, clustered, head, classes):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    options = {"clustered": clustered, "head": head, "classes": classes}
    want = brute_scores([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], trained(df, **options))
    got = {r.doc_id: r.score for r in lm.score_documents(df, **options).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-6) for d in want)


def test_every_word_beside_a_clustered_one_gets_the_best_class(spark):
    """The distributed exchange step against the same sums word by word."""
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = [words(r.text) for r in df.select("doc_id", "text").collect() if not held_out(r.doc_id)]
    model = trained(df, clustered=25, classes=5)
    core = sorted(Counter(w for t in docs for w in t).items(), key=lambda x: (x[0] != END, -x[1], int(hash_of(x[0]))))[:25]
    core = {w: class_of(model, w) for w, _ in core}
    table, near = np.full((5, 5), 0.5), {}
    for t in docs:
        for a, b in zip([END, *t], t, strict=False):
            if a in core and b in core:
                table[core[a], core[b]] += 1
            elif a in core:
                near.setdefault(b, Counter())["before", core[a]] += 1
            elif b in core:
                near.setdefault(a, Counter())["after", core[b]] += 1
    before, after = np.log(table / table.sum(0)), np.log(table / table.sum(1, keepdims=True))
    assert len(near) > 100
    for w, seen in near.items():
        gain = [sum(n * (before[d, c] if side == "before" else after[c, d]) for (side, d), n in seen.items()) for c in range(5)]
        assert gain[class_of(model, w)] == pytest.approx(max(gain))
    assert all(class_of(model, w) >= 5 for t in docs for w in t if w not in core and w not in near)


def test_context_helps(spark):
    rng = np.random.default_rng(1)
    groups = [[f"n{c}" for c in "abcdefgh"], [f"v{c}" for c in "abcdefgh"], [f"d{c}" for c in "abcdefgh"]]
    docs = [(i, " ".join(groups[k % 3][rng.integers(8)] for k in range(90))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lm.score_documents(df, clustered=30, head=100, classes=4).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)
    for clustered in (25, 14):  # with 14, the step beside the clustered words finds the classes of the others
        model = trained(df, clustered=clustered, classes=4)
        kinds = [{class_of(model, w) for w in g} for g in groups]
        assert sum(map(len, kinds)) == len(set.union(*kinds))  # no class has words of two kinds


def test_odd_rows(spark):
    rows = [(1, None, 0), (1, "a b", 0), (1, "a b", 0), (None, "A\x0bb \x1c é", 0), (None, None, 0), (6, "zz " * 5000, 0), (7, "q", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    same([tuple(r)[:6] for r in lm.score_documents(df, clustered=3, head=4, classes=2).collect()], brute_base([r[:2] for r in rows]))
    assert lm.score_documents(df.limit(0)).count() == 0
    only = lm.score_documents(df.where("doc_id = 1"))
    assert all(r.train_tokens in (0, 7) for r in only.collect())


def test_least_count(spark):
    df = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([1] * 50 + [2] * 10 + [8] * 5 + [1000])], "h string, n long")
    assert [df.where(f"n >= {lm._least_count(df, m)}").count() for m in (0, 1, 5, 6, 16, 70)] == [0, 1, 1, 6, 16, 66]
