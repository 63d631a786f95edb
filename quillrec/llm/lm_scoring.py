"""Class-based n-gram scores: exchange clustering of words, class transitions and word emissions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, fold_of, hashes_of, slices, stored, text_of, word_places

#: The hash that stands for the end of a text; a word's is any of 2**64.
END = np.uint64(0)
#: Classes of the words that no context has put into a class, by their shape (fixed values).
SHAPES = ("digit", "other", "stop", "short", "long")
#: Words that a task gathers before it counts them.
GATHERED = 500_000
#: Words that are clustered on the driver, and classes, each for the eighth root of the training tokens.
CLUSTERED, CLASSES = 180, 6.6


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of the texts' words (A-Z lower-cased), and where each text's words start.

    A word's shape: it has a digit; or its last byte is a full stop, question or exclamation mark; or another ASCII character that
    is no letter and no apostrophe; else whether it has fewer than eight bytes.
    """
    buf, starts, ends, at = word_places([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    digits = np.concatenate(([0], np.cumsum((buf >= 48) & (buf <= 57))))
    last = buf[ends - 1]
    shape = np.where(ends - starts < 8, 3, 4).astype(np.uint8)
    shape[((last < 97) & (last != 39)) | ((last > 122) & (last < 128))] = 1
    shape[(last == 46) | (last == 33) | (last == 63)] = 2
    shape[digits[ends] > digits[starts]] = 0
    return hashes_of(buf, starts, ends), shape, at


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int, fixed: int, classes: int, sweeps: int = 4) -> np.ndarray:
    """Exchange clustering of symbols 0..size-1 from their bigram counts (a[i] before b[i], n[i] times).

    The last ``fixed`` symbols keep classes of their own, after the ``classes`` free ones. In each sweep every other
    symbol moves to the class that raises the bigram class likelihood most. Deterministic; stops early when none moves.
    """
    free, total = size - fixed, classes + fixed
    cls = np.concatenate((np.arange(free) % classes, classes + np.arange(fixed))).astype(np.int64)
    table = np.zeros((total, total))
    np.add.at(table, (cls[a], cls[b]), n)
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    at_a, at_b = np.searchsorted(a[order_a], np.arange(size + 1)), np.searchsorted(b[order_b], np.arange(size + 1))
    for _ in range(sweeps):
        moved = 0
        for w in range(free):
            out, into = order_a[at_a[w] : at_a[w + 1]], order_b[at_b[w] : at_b[w + 1]]
            if not len(out) and not len(into):
                continue
            own = float(n[out][b[out] == w].sum())
            right = np.bincount(cls[b[out]], n[out] * (b[out] != w), minlength=total)
            left = np.bincount(cls[a[into]], n[into] * (a[into] != w), minlength=total)
            old = cls[w]
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            rows, cols = table.sum(1), table.sum(0)
            # the likelihood's change if w joins class c: the cells of row c, of column c, the cell (c, c) and the totals
            f = _xlogx(table)
            gain = (_xlogx(table + right[None, :]) - f).sum(1) + (_xlogx(table + left[:, None]) - f).sum(0)
            d = np.diagonal(table)
            gain += _xlogx(d + right + left + own) + _xlogx(d) - _xlogx(d + right) - _xlogx(d + left)
            gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(cols + left.sum() + own) - _xlogx(cols)
            best = int(np.argmax(gain[:classes]))
            if gain[best] <= gain[old] + 1e-9:
                best = int(old)
            cls[w] = best
            table[best] += right
            table[:, best] += left
            table[best, best] += own
            moved += best != old
        if not moved:
            break
    return cls


@dataclass
class Model:
    """What the tasks need: 18 bytes for each word of the head, and a table of classes."""

    keys: np.ndarray  # the head words' hashes, ascending
    count: np.ndarray  # training count of each
    cls: np.ndarray  # class of each; the shapes' classes come last
    log_next: np.ndarray  # log10 P(class | class before)
    log_emit: np.ndarray  # log10 P(word | class) of each head word
    log_tail: np.ndarray  # log10 of the denominator of each shape class
    total: int  # N
    vocabulary: int  # V
    least: int  # words with a smaller count are outside the head

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The head's position of each hash, -1 outside it."""
        return place_in(self.keys, hashes)


def place_in(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, hashes)
    np.minimum(at, len(keys) - 1, out=at)
    at[keys[at] != hashes] = -1
    return at


def tokenised(rows: DataFrame) -> DataFrame:
    """d, th, absent, train as in ``rows``, and of its text h and s: the hashes (8 bytes each) and shapes (a byte each) of its
    words and of the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slices(texts, 500_000):
                h, s, at = hashed_words(texts[a:b])
                at = at.tolist()
                end = END.tobytes()
                out = pdf.iloc[a:b].drop(columns="text")
                yield out.assign(h=[h[x:y].tobytes() + end for x, y in zip(at, at[1:], strict=False)], s=[s[x:y].tobytes() + b"\0" for x, y in zip(at, at[1:], strict=False)])

    return rows.mapInPandas(run, "d long, th long, absent boolean, train boolean, h binary, s binary")


def _gathered(batches: Iterator[pd.DataFrame], most: int = GATHERED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and shapes of about ``most`` tokens at a time, whole texts one after the other; the end of each text opens the next."""
    h: list[bytes] = []
    s: list[bytes] = []
    size = 0
    for pdf in batches:
        for one, two in zip(pdf["h"], pdf["s"], strict=True):
            h.append(one)
            s.append(two)
            size += len(two)
            if size >= most:
                yield np.frombuffer(b"".join(h), np.uint64), np.frombuffer(b"".join(s), np.uint8)
                h, s, size = [], [], 0
    if size:
        yield np.frombuffer(b"".join(h), np.uint64), np.frombuffer(b"".join(s), np.uint8)


def word_counts(tokens: DataFrame) -> DataFrame:
    """h (the hash as a long), s (the shape) and n of every word of ``tokenised`` texts, the end included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for h, s in _gathered(batches):
            key, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pd.DataFrame({"h": key.view(np.int64), "s": s[first].astype(np.int32), "n": n})

    return tokens.select("h", "s").mapInPandas(run, "h long, s int, n long").groupBy("h").agg(F.max("s").alias("s"), F.sum("n").alias("n"))


def bigram_counts(tokens: DataFrame, keys: np.ndarray, symbol: np.ndarray, known: int) -> DataFrame:
    """Counts (a, b, n) of adjacent symbols: ``symbol`` of a word in ``keys``, ``known`` plus its shape of any other. The end opens
    and closes every text. A task counts about ``GATHERED`` tokens at a time, so its memory does not grow with the symbols."""
    size = known + len(SHAPES)
    shared = tokens.sparkSession.sparkContext.broadcast((keys, symbol.astype(np.int32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, symbol = shared.value
        end = symbol[place_in(keys, np.array([END]))]
        for h, s in _gathered(batches):
            at = place_in(keys, h)
            x = np.concatenate((end, np.where(at >= 0, symbol[at], s.astype(np.int64) + known)))
            pair, n = np.unique(x[:-1] * size + x[1:], return_counts=True)
            yield pd.DataFrame({"a": (pair // size).astype(np.int32), "b": (pair % size).astype(np.int32), "n": n})

    return tokens.select("h", "s").mapInPandas(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _table(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = pairs.toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    return tuple(got.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))


def exchanged(tokens: DataFrame, keys: np.ndarray, cls: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An exchange step for the words of ``keys`` without a class (-1 in ``cls``): their positions, and the class of each.

    A word joins the class that raises the bigram class likelihood most, given ``table`` (class bigrams of the words that have
    one) and the word's neighbours of these classes over the whole corpus. Words without such a neighbour are left out. The counts of
    a word's neighbours by class and side are summed per task, then per word (at most twice the number of classes).
    """
    classes = len(table)
    smooth = table + 0.5
    # log P(class before | class) and log P(class after | class), for rows (side, neighbour's class)
    weight = np.concatenate((np.log(smooth / smooth.sum(0, keepdims=True)), np.log(smooth / smooth.sum(1, keepdims=True)).T))
    shared = tokens.sparkSession.sparkContext.broadcast((keys, cls.astype(np.int16)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, cls = shared.value
        end = cls[place_in(keys, np.array([END]))]
        for h, _ in _gathered(batches):
            at = place_in(keys, h)
            own = np.where(at >= 0, cls[at], -2)  # -2: not in the head
            near = np.concatenate((end, own, end))
            free = np.flatnonzero(own == -1)
            before, after = near[free], near[free + 2]
            key = at[free].astype(np.int64) * (2 * classes)
            found, n = np.unique(np.concatenate(((key + before)[before >= 0], (key + classes + after)[after >= 0])), return_counts=True)
            yield pd.DataFrame({"i": (found // (2 * classes)).astype(np.int32), "side": (found % (2 * classes)).astype(np.int32), "n": n})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gain = np.zeros((len(pdf), classes))
            for r, (side, n) in enumerate(zip(pdf["sides"], pdf["ns"], strict=True)):
                gain[r] = np.asarray(n, dtype=float) @ weight[np.asarray(side)]
            yield pd.DataFrame({"i": pdf["i"], "c": gain.argmax(axis=1).astype(np.int32)})

    seen = tokens.select("h", "s").mapInPandas(run, "i int, side int, n long").groupBy("i", "side").agg(F.sum("n").alias("n"))
    words = seen.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("side", "n"))).alias("l")).select("i", F.col("l.side").alias("sides"), F.col("l.n").alias("ns"))
    got = words.mapInPandas(best, "i int, c int").toArrow()
    return got.column("i").to_numpy(), got.column("c").to_numpy()


def _least_count(counts: DataFrame, most: int) -> int:
    """The lowest of a row of bounds (about an eighth of a power of two apart) that at most ``most`` words reach."""
    step = F.floor(F.log2("n") * 8 + 1e-9)
    found = {int(r.s): r.c for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()}
    least, seen = 2**62, 0
    for s in sorted(found, reverse=True):
        seen += found[s]
        if seen > most:
            break
        least = math.ceil(2 ** (s / 8) - 1e-6)
    return least


def train(counts: DataFrame, tokens: DataFrame, clustered: int | None = None, head: int = 1_000_000, classes: int | None = None) -> Model:
    """Fits the model from the training texts (``tokens``, as ``tokenised`` gives them) and their ``word_counts``.

    1. The ``clustered`` most frequent words are put into classes by exchange on the driver, over bigram counts of the whole
       training part (at most (clustered + 5) squared pairs reach it, which grows with the fourth root of the tokens).
    2. All other words of the head go through a distributed exchange step against these classes (``exchanged``).
    3. Class bigrams of all tokens are counted with the classes of all words.

    The head is the ``head`` most frequent words, found by a bound on their counts, so that nothing is ordered in one task; the
    model keeps 18 bytes for each. Words outside it, and those that never stand beside a clustered word, belong to one of five
    classes by their shape. ``head`` is the bound of what is broadcast. Unless given, the numbers of clustered words and of classes grow with
    the eighth root of the number of training tokens, without a bound: ``CLUSTERED`` and ``CLASSES`` times that root.
    """
    row = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, vocabulary = int(row.n or 0), int(row.v or 0)
    root = max(total, 1) ** 0.125
    clustered, classes = clustered or round(CLUSTERED * root), classes or max(2, round(CLASSES * root))
    least = _least_count(counts, head)
    top = counts.where((F.col("n") >= least) | (F.col("h") == int(END))).toArrow()
    keys, shape, number = top.column("h").to_numpy().view(np.uint64), top.column("s").to_numpy(), top.column("n").to_numpy().astype(np.int64)
    if END not in keys:  # no training text
        keys, shape, number = np.append(keys, END), np.append(shape, 0), np.append(number, 0)
    order = np.argsort(keys, kind="stable")
    keys, shape, number = keys[order], shape[order], number[order]
    at_end = int(np.searchsorted(keys, END))
    rank = np.lexsort((keys, -number, np.arange(len(keys)) != at_end))  # the end comes first: it must be clustered
    core = np.sort(rank[:clustered])
    size = len(core) + len(SHAPES)
    a, b, n = _table(bigram_counts(tokens, keys[core], np.arange(len(core)), len(core)))
    # the most frequent words start in different classes
    by_count = np.concatenate((np.argsort(np.lexsort((keys[core], -number[core]))), len(core) + np.arange(len(SHAPES))))
    found = exchange(by_count[a], by_count[b], n.astype(float), size, len(SHAPES), classes)[by_count]
    table = np.zeros((classes + len(SHAPES),) * 2)
    np.add.at(table, (found[a], found[b]), n)
    cls = np.full(len(keys), -1, dtype=np.int64)
    cls[core] = found[: len(core)]
    if len(core) < len(keys):
        i, c = exchanged(tokens, keys, cls, table[:classes, :classes])
        cls[i] = c
    shaped = cls < 0
    cls[shaped] = classes + shape[shaped]
    width = classes + len(SHAPES)
    a, b, n = _table(bigram_counts(tokens, keys, cls, classes))
    # a class holds its words; a shape class also those outside the head, and one slot for every unseen word
    in_class = np.zeros(width)
    np.add.at(in_class, b, n)
    kinds = np.bincount(cls, minlength=width).astype(float)
    outside = counts.where((F.col("n") < least) & (F.col("h") != int(END))).groupBy("s").count().collect()
    for r in outside:
        kinds[classes + r.s] += r["count"]
    kinds[classes:] += 1
    step = np.full((width, width), 0.5)
    step[:, kinds == 0] = 0  # no word is in such a class
    np.add.at(step, (a, b), n)
    with np.errstate(divide="ignore"):
        log_next = np.log10(step / step.sum(1, keepdims=True))
    denominator = in_class + 0.5 * np.maximum(kinds, 1)
    log_emit = np.log10(number + 0.5) - np.log10(denominator[cls])
    return Model(keys, number, cls.astype(np.int16), log_next, log_emit, np.log10(denominator[classes:]), total, vocabulary, least)


def partial_scores(tokens: DataFrame, model: Model) -> DataFrame:
    """One row of sums for each row of ``tokens`` (h null), and one for each distinct word of it outside the model's head.

    Columns: d, th, h, n, n_tokens, n_known, base (without the counts of the words outside the head), score (likewise).
    """
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        log_count, known = np.log10(m.count + 0.5), m.count > 0
        first_shape = len(m.log_next) - len(SHAPES)
        start = m.cls[m.place(np.array([END]))]
        for pdf in batches:
            for a, b in slices(pdf["s"].tolist(), 300_000):
                part = pdf.iloc[a:b]
                yield from scored(m, part, log_count, known, first_shape, start)

    def scored(m, part, log_count, known, first_shape, start):
        h, s = np.frombuffer(b"".join(part["h"]), np.uint64), np.frombuffer(b"".join(part["s"]), np.uint8)
        size = part["s"].map(len).to_numpy()
        first = np.cumsum(size) - size
        at = m.place(h)
        cls = np.where(at >= 0, m.cls[at], s.astype(np.int64) + first_shape)
        score = m.log_next[np.concatenate((start, cls[:-1])), cls]
        inside = at >= 0
        score = score + np.where(inside, m.log_emit[at], -m.log_tail[np.maximum(cls - first_shape, 0)])
        base = np.where(inside, log_count[at], 0.0)
        seen = inside & known[at]
        d, th = part["d"].to_numpy(), part["th"].to_numpy()
        sums = {"n_tokens": size, "n_known": np.add.reduceat(seen.astype(np.int64), first), "base": np.add.reduceat(base, first), "score": np.add.reduceat(score, first)}
        yield pd.DataFrame({"d": d, "th": th, "h": pd.array([None] * len(d), dtype="Int64"), "n": 0, **sums})
        rare = np.flatnonzero(~inside)
        if len(rare):
            owner = np.repeat(np.arange(len(d)), size)[rare]
            order = np.lexsort((h[rare], owner))
            owner, word = owner[order], h[rare][order]
            new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1]))))
            times, owner = np.diff(np.append(new, len(owner))), owner[new]
            yield pd.DataFrame({"d": d[owner], "th": th[owner], "h": pd.array(word[new].view(np.int64), dtype="Int64"), "n": times, "n_tokens": 0, "n_known": 0, "base": 0.0, "score": 0.0})

    schema = "d long, th long, h long, n long, n_tokens long, n_known long, base double, score double"
    return tokens.select("d", "th", "h", "s").mapInPandas(run, schema)


def named(docs: DataFrame, held_out_fold: int = 1) -> DataFrame:
    """d (doc_id, null as 0), th (hash of the text and of whether doc_id is null), absent, train, text for each row."""
    rows, absent = docs.select(F.col("doc_id"), text_of().alias("text")), F.col("doc_id").isNull()
    return rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("text", absent).alias("th"), absent.alias("absent"),
        (fold_of(F.col("doc_id")) != held_out_fold).alias("train"), "text",
    )


def score_documents(docs: DataFrame, held_out_fold: int = 1, clustered: int | None = None, head: int = 1_000_000, classes: int | None = None) -> DataFrame:
    """Scores every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learned from the rows whose fold (crc32 of the doc_id as text, mod 5) is not ``held_out_fold``. Null texts count as
    empty: their only token is the end. Rows that repeat doc_id and text are returned as often as they occur. Without
    training rows N and V are 0 and every token is unknown.

    P(text) = product over tokens of P(class | class before) P(word | class), both with 0.5 added to every count, all unseen words
    of a shape being one word: for each class the probabilities of what can follow add up to 1. Texts are split once; words are
    64-bit hashes from then on. The words that are not in the bounded head are joined with the counts of the whole corpus,
    pre-aggregated by document.
    """
    tokens = stored(tokenised(named(docs, held_out_fold)), "tokens")
    nulls = stored(tokens.where("absent").select("d", "th").distinct(), "nulls")
    training = tokens.where("train")
    counts = stored(word_counts(training), "counts")
    model = train(counts, training, clustered, head, classes)
    parts = stored(partial_scores(tokens, model), "parts")
    discard(tokens)
    total, vocabulary = model.total, model.vocabulary
    scale = float(np.log10(total + 0.5 * (vocabulary + 1)))
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = counts.where(F.col("n") < model.least).select("h", F.col("n").alias("c"))
    tail = parts.where("h is not null").select("d", "th", "h", "n").join(rare, "h", "left")
    tail = tail.select("d", "th", F.when(c > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10(c + 0.5)).alias("logs"))
    whole = parts.where("h is null")
    # one sum over both kinds of rows; a document that occurs k times has every row k times
    sums = (
        tail.select("d", "th", F.lit(0).cast("long").alias("times"), F.lit(0).cast("long").alias("n_tokens"), "known", F.lit(0.0).alias("base"), F.lit(0.0).alias("own"), "logs")
        .union(whole.select("d", "th", F.lit(1).cast("long"), "n_tokens", "n_known", "base", "score", F.lit(0.0)))
        .groupBy("d", "th")
        .agg(*(F.sum(x).alias(x) for x in ("times", "n_tokens", "known", "base", "own", "logs")))
    )
    each = lambda name: F.col(name) / F.col("times")
    sums = sums.select(
        "d", "th", "times",
        each("n_tokens").cast("long").alias("n_tokens"), each("known").cast("long").alias("n_known"),
        ((F.col("base") + F.col("logs")) / F.col("times") - each("n_tokens") * scale).alias("base_score"),
        ((F.col("own") + F.col("logs")) / F.col("times")).alias("score"),
    )
    ids = sums.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    ids = ids.join(nulls.withColumn("absent", F.lit(True)), ["d", "th"], "left")
    doc_id = F.when(F.col("absent").isNull(), F.col("d")).cast(docs.schema["doc_id"].dataType)
    return ids.withColumn("doc_id", doc_id).select(
        "doc_id", (fold_of(F.col("doc_id")) == held_out_fold).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
