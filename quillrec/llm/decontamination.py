"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, text_of

#: ASCII punctuation and control characters separate words; A-Z is lower-cased; other bytes stay.
_TABLE = bytes(32 if i < 48 or 58 <= i < 65 or 91 <= i < 97 or 123 <= i < 128 else i + 32 if 65 <= i < 91 else i for i in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and of its answer: the last line, else the last sentence, else the whole item twice."""
    body = text.rstrip()
    for mark in ("\n", ". ", "? ", "! "):
        head, found, tail = body.rpartition(mark)
        if found and words(head) and words(tail):
            return words(head), words(tail)
    return words(body), words(body)


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of word ids (uint64)."""
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for x in columns:
        out = (out ^ (x + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Index:
    """Postings of entries, in blocks with their largest impacts, all in flat arrays.

    Verification wants ``overlap`` of the windows of an item's question and of its answer, so it suffices to look for the longer
    of the two: entries are pieces of at most ``piece`` words of that part. The impact of a term in an entry is its
    BM25 weight over the entry's threshold, so that every threshold is 1 and block maxima hold for entries of any length. A
    text that holds the share of the part's windows lacks at most ``missing`` of its words, so one of its entries lacks
    at most that over the number of entries; what the entry scores without its heaviest such terms is the threshold.
    That finds every part that stands together. A part may also be spread over a text, wider than a passage: the windows
    of the longer parts are indexed too, and a text that holds enough of them anywhere has the item as a candidate. So nothing
    that the verification would accept is missed. Words are numbers here, windows 64-bit hashes of them.
    """

    K1, B, BLOCK, RANGES = 1.2, 0.75, 64, 128

    def __init__(self, items: list[tuple[int | None, str]], overlap: float = 0.8, piece: int = 24, chunk: int = 32, width: int = 5):
        self.width, self.chunk, self.overlap = width, chunk, overlap
        parts = [(item_id, *question_and_answer(text)) for item_id, text in items if words(text or "")]
        self.ids = [item_id for item_id, _, _ in parts]
        self.term = {w: i for i, w in enumerate(sorted({w for _, q, a in parts for w in {*q, *a}}))}
        # the hashed windows of question and answer, and their widths
        self.widths = [(min(width, len(q)), min(width, len(a))) for _, q, a in parts]
        number = [tuple(np.array([self.term[w] for w in x], dtype=np.int64) for x in (q, a)) for _, q, a in parts]
        self.windows = [tuple(np.unique(self._runs(x, k)) for x, k in zip(n, ks, strict=True)) for n, ks in zip(number, self.widths, strict=True)]
        longer = [max((0, 1), key=lambda j: (ks[j], len(w[j]))) for ks, w in zip(self.widths, self.windows, strict=True)]
        self.whole = np.array([len(w[j]) for w, j in zip(self.windows, longer, strict=True)], dtype=np.int64)
        self._index_entries([n[j] for n, j in zip(number, longer, strict=True)], piece)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, width + 1):
            some = [i for i, j in enumerate(longer) if self.widths[i][j] == k]
            if some:
                key = np.concatenate([self.windows[i][longer[i]] for i in some])
                order = np.argsort(key, kind="stable")
                self.held[k] = key[order], np.repeat(some, self.whole[some])[order]

    @staticmethod
    def _runs(ids: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k words."""
        n = max(len(ids) - k + 1, 0) if k else 0
        return _hashed([ids[j : j + n].astype(np.uint64) for j in range(k)]) if n else np.zeros(0, np.uint64)

    def _index_entries(self, longest: list[np.ndarray], piece: int) -> None:
        terms, entries, weights = [], [], []
        cut: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.first = np.zeros(len(longest) + 1, dtype=np.int64)  # the entries of each item
        for i, part in enumerate(longest):
            # k windows cover at least k + width - 1 words, each of a repeated window's places being one more
            missing = int((1 - self.overlap) * max(len(part) - self.width + 1, 0) + 1e-9)
            count = max(1, math.ceil(len(part) / piece))
            size = math.ceil(len(part) / count)
            pieces = [np.unique(part[at : at + size], return_counts=True) for at in range(0, len(part), size)]
            cut += [(t, tf, missing // len(pieces)) for t, tf in pieces]
            self.first[i + 1] = len(cut)
        self.item_of = np.repeat(np.arange(len(longest)), np.diff(self.first))
        df = np.bincount(np.concatenate([t for t, _, _ in cut]), minlength=len(self.term)) if cut else np.zeros(len(self.term), np.int64)
        mean = sum(int(tf.sum()) for _, tf, _ in cut) / max(len(cut), 1)
        for e, (t, tf, lost) in enumerate(cut):
            idf = np.log(1 + (len(cut) - df[t] + 0.5) / (df[t] + 0.5))
            x = idf * tf * (self.K1 + 1) / (tf + self.K1 * (1 - self.B + self.B * tf.sum() / mean))
            heavy = np.sort(x)[::-1]
            # an entry that may lack all its words has no score to ask for: its windows are what finds it
            own = heavy[lost:].sum() if lost < len(heavy) else heavy.sum()
            terms.append(t)
            entries.append(np.full(len(t), e, dtype=np.int64))
            weights.append(x / (own * (1 - 1e-6)))
        term, entry, impact = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((terms, np.int64), (entries, np.int64), (weights, float)))
        order = np.lexsort((entry, term))
        term, self.entry, self.impact = term[order], entry[order].astype(np.int32), impact[order]
        self.start = np.searchsorted(term, np.arange(len(self.term) + 2))  # the last but one stands for unknown words
        size = np.diff(self.start)
        self.block = np.concatenate(([0], np.cumsum(-(-size // self.BLOCK))))  # where each list's blocks are
        firsts = np.repeat(self.start[:-1] - self.BLOCK * self.block[:-1], np.diff(self.block)) + self.BLOCK * np.arange(self.block[-1])
        self.block_max = np.maximum.reduceat(self.impact, firsts) if len(firsts) else np.zeros(0)
        some = np.flatnonzero(size)
        self.best = np.zeros(len(self.term) + 1)
        if len(some):
            self.best[some] = np.maximum.reduceat(self.impact, self.start[some])
        # upper bounds by range of entries, for whole passages at a time: 4 M cells at most
        ranges = max(1, min(self.RANGES, len(cut), (4 << 20) // (len(self.term) + 1)))
        self.span = max(4, math.ceil(len(cut) / ranges))
        self.bound = np.zeros((len(self.term) + 1, max(1, math.ceil(len(cut) / self.span))), dtype=np.float32)
        np.maximum.at(self.bound, (term, self.entry // self.span), self.impact.astype(np.float32))

    def holders(self, ids: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) where a text holds ``overlap`` of the windows of the item's longer part, wherever they stand."""
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids))  # words from here to the text's end
        text, out = np.repeat(np.arange(len(lengths)), lengths), []
        for k, (keys, owners) in self.held.items():
            starts = np.flatnonzero(left >= k)
            key = _hashed([ids[starts + j].astype(np.uint64) for j in range(k)])
            low = np.searchsorted(keys, key)
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == key)
            # every window of a text once
            hit = hit[np.unique(np.stack((text[starts[hit]], low[hit])), axis=1, return_index=True)[1]] if len(hit) else hit
            low, where = low[hit], text[starts[hit]]
            n = np.searchsorted(keys, key[hit], side="right") - low
            posting = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            pair, count = np.unique(np.repeat(where, n) * len(self.ids) + owners[posting], return_counts=True)
            enough = pair[count / self.whole[pair % len(self.ids)] >= self.overlap]
            out += zip((enough // len(self.ids)).tolist(), (enough % len(self.ids)).tolist(), strict=True)
        return out

    def score(self, item: int, terms: np.ndarray) -> float:
        """The best summed impact of these distinct terms in an entry of the item."""
        low, high = int(self.first[item]), int(self.first[item + 1])
        total = np.zeros(high - low)
        for t in terms.tolist():
            a, b = self.start[t], self.start[t + 1]
            x, y = a + self.entry[a:b].searchsorted((low, high))
            total[self.entry[x:y] - low] += self.impact[x:y]
        return float(total.max())

    def promising(self, terms: np.ndarray, light: float = 0.9) -> bool:
        """Whether some entry reaches 1 with these distinct terms.

        The lists of the terms of the lowest best impacts, which are the long ones, are left aside as long as these impacts add up to
        less than ``light``. Over the other lists the entries' impacts are summed; in the lists left aside only the entries are
        looked up that can still reach 1, the heaviest list first.
        """
        best = self.best[terms]
        order = np.argsort(best, kind="stable")
        total = np.cumsum(best[order])
        kept = int(np.searchsorted(total, light))
        if not len(terms) or total[-1] < 1 - 1e-6:
            return False
        start, size = self.start[terms[order[kept:]]], np.diff(self.start)[terms[order[kept:]]]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        sums = np.bincount(self.entry[at], self.impact[at])
        spare = float(total[kept - 1]) if kept else 0.0
        entries = np.flatnonzero(sums + spare >= 1 - 1e-6)
        for i in range(kept - 1, -1, -1):
            if not len(entries):
                return False
            t = int(terms[order[i]])
            a, b = int(self.start[t]), int(self.start[t + 1])
            place = np.minimum(self.entry[a:b].searchsorted(entries.astype(np.int32)), b - a - 1) + a
            sums[entries] += np.where(self.entry[place] == entries, self.impact[place], 0.0)
            entries = entries[sums[entries] + (total[i - 1] if i else 0.0) >= 1 - 1e-6]
        return len(entries) > 0

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All entries whose summed impact over these distinct terms is at least 1, by block-max WAND."""
        found, size = [], self.BLOCK
        lists = {t: (self.entry[self.start[t] : self.start[t + 1]], self.impact[self.start[t] : self.start[t + 1]], self.block_max[self.block[t] : self.block[t + 1]]) for t in terms}
        cursors = [[int(es[0]), t, 0] for t, (es, _, _) in lists.items() if len(es)]  # entry, term, place
        over = 1 - 1e-9
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, t, _p) in enumerate(cursors):
                bound += self.best[t]
                if bound >= over:
                    pivot = i
                    break
            if pivot < 0:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            shallow, ends = 0.0, []
            for _e, t, p in cursors[: pivot + 1]:
                es, _, most = lists[t]
                block = p // size
                while (block + 1) * size < len(es) and es[(block + 1) * size - 1] < target:
                    block += 1
                shallow += most[block]
                ends.append(int(es[min((block + 1) * size, len(es)) - 1]))
            if shallow >= over:
                to = target
                if cursors[0][0] == target:
                    score = sum(float(lists[t][1][p]) for _, t, p in cursors[: pivot + 1])
                    if score >= over:
                        found.append((target, score))
                    to = target + 1
            else:  # nothing up to the nearest end of these blocks, or before the next list's entry, can pass
                to = max(min(ends), target) + 1
                if pivot + 1 < len(cursors):
                    to = max(min(to, cursors[pivot + 1][0]), target + 1)
            kept = []
            for _e, t, p in cursors[: pivot + 1]:
                es = lists[t][0]
                p += int(es[p:].searchsorted(to))
                if p < len(es):
                    kept.append([int(es[p]), t, p])
            cursors = kept + cursors[pivot + 1 :]
        return found

    def candidates(self, docs: list[list[bytes]]) -> tuple[list[dict[int, float]], np.ndarray]:
        """For each text the items of which a passage scores above the threshold, with the best such score, and those of
        whose longer part it holds enough windows, with the best score of a passage; and the texts' words as numbers.

        Passages are two neighbouring chunks of ``chunk`` words: any run of chunk + 1 words lies in one. Every passage is a query:
        it is searched if the summed bounds of its terms reach the threshold in some range of entries, and then in some entry.
        """
        out: list[dict[int, float]] = [{} for _ in docs]
        get, unknown = self.term.get, len(self.term)
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        ids = np.fromiter((get(w, unknown) for d in docs for w in d), np.int64, int(lengths.sum()))
        if not self.ids:
            return out, ids
        chunks = np.maximum(-(-lengths // self.chunk), 1)
        first = np.concatenate(([0], np.cumsum(chunks)))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        key = (np.repeat(first[:-1], lengths) + place // self.chunk) * (unknown + 1) + ids
        key = np.unique(key[ids != unknown])
        chunk, term = key // (unknown + 1), key % (unknown + 1)
        at = np.searchsorted(chunk, np.arange(first[-1] + 1))
        sums = np.zeros((first[-1] + 1, self.bound.shape[1]), dtype=np.float32)
        filled = np.flatnonzero(at[1:] > at[:-1])
        if len(filled):
            sums[filled] = np.add.reduceat(self.bound[term], at[filled], axis=0)
        owner = np.repeat(np.arange(len(docs)), chunks)
        together = np.append(owner[1:] == owner[:-1], False)
        pair = sums[:-1] + sums[1:] * together[:, None]
        for c in np.flatnonzero(pair.max(axis=1) >= 1 - 1e-3).tolist():
            terms = np.unique(term[at[c] : at[c + 2 if together[c] else c + 1]])
            if not self.promising(terms):
                continue
            found = out[owner[c]]
            for e, score in self.search(terms.tolist()):
                item = int(self.item_of[e])
                found[item] = max(found.get(item, 0.0), score)
        for d, item in self.holders(ids, lengths):
            if item not in out[d]:
                passages = ((c, min(c + 2, first[d + 1])) for c in range(first[d], first[d + 1]))
                out[d][item] = max(self.score(item, np.unique(term[at[c] : at[last]])) for c, last in passages)
        return out, ids

    def matches(self, texts: list[str]) -> list[list[tuple[int | None, float, float, float]]]:
        """For each text (item_id, score, question overlap, answer overlap) of its candidates: shares of the item's word windows in the text."""
        out: list[list[tuple[int | None, float, float, float]]] = []
        for a, b in slices(texts, 300_000):
            docs = [words(t) for t in texts[a:b]]
            candidates, ids = self.candidates(docs)
            at = 0
            for doc, found in zip(docs, candidates, strict=True):
                own = ids[at : at + len(doc)]
                at += len(doc)
                have = {k: np.unique(self._runs(own, k)) for k in {k for i in found for k in self.widths[i]}}
                share = lambda i, j: float(np.isin(self.windows[i][j], have[self.widths[i][j]]).mean())  # noqa: B023, E731
                out.append([(self.ids[i], score, share(i, 0), share(i, 1)) for i, score in sorted(found.items())])
        return out


def _indexes(spark, items: DataFrame, overlap: float, block_chars: int) -> Iterator:
    """Broadcast indexes of the items in blocks of about ``block_chars`` characters, so that none grows with the benchmark."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, math.ceil(total / block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        rows = (items if blocks == 1 else items.where(part == b)).collect()
        rows = sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield spark.sparkContext.broadcast(Index(rows, overlap))


def contaminated(docs: DataFrame, items: DataFrame, overlap: float = 0.8, block_chars: int = 16_000_000) -> DataFrame:
    """Pairs of a document and a test item that it contains: doc_id, item_id, score, question_overlap, answer_overlap.

    Every passage of every whole text is a BM25 query; hits are verified: at least ``overlap`` of the question's and of
    the answer's 5-word windows occur in the text, wherever they stand. Items without words have no match; a null or empty text
    has none; equal items are all reported, and an item with a null item_id as null; rows with repeated doc_ids are searched each
    on its own. The items are taken in blocks of about ``block_chars`` characters, each collected and broadcast by itself.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select("doc_id", text_of().alias("text"))
    for index in _indexes(spark, items, overlap, block_chars):
        part = _search(rows, index, overlap)
        out = part if out is None else out.unionByName(part)
    return out


def _search(rows: DataFrame, shared, overlap: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = shared.value
        for pdf in batches:
            out = []
            for has, key, own in zip(pdf["has"], pdf["doc_id"], found.matches(pdf["text"].tolist()), strict=True):
                out += [(int(key) if has else None, *m) for m in own if min(m[2:]) >= overlap]
            if out:
                frame = pd.DataFrame(out, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
                yield frame.assign(**{c: pd.array([r[i] for r in out], dtype="Int64") for i, c in enumerate(("doc_id", "item_id"))})

    typed = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has"), "text")
    return typed.mapInPandas(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def drop_contaminated(docs: DataFrame, items: DataFrame, overlap: float = 0.8, block_chars: int = 16_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no test item (``contaminated``). A row is judged by its text alone."""
    kept = docs
    for index in _indexes(docs.sparkSession, items, overlap, block_chars):
        kept = kept.where(_clean(index, overlap)(text_of()))
    return kept


def _clean(shared, overlap: float):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not any(min(m[2:]) >= overlap for m in own) for own in shared.value.matches(texts.tolist())], dtype=bool)

    return clean


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
