"""Near-duplicate documents by BagMinHash signatures, banding and verified multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _G, as_set, components, discard, documents, mix, overlap, shingles, slices, stored, text_of

#: 24 bands of 5: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**5)**24 > 0.9999.
BANDS, ROWS = 24, 5
WIDTH, SIMILARITY = 5, 0.8
_ALL = (1 << 64) - 1


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures, one row of ``size`` uint64 values for each sorted multiset of window hashes.

    A window of weight w takes part in the levels 1..w. The levels are cut into the blocks 1, 2, 3-4, 5-8, ...; each
    block of a window owns a Poisson process, seeded by both, at a rate of ``size`` a level, whose points fall on a
    component and a level at random. Points at levels above w are thinned out, so each component sees rate w, and its
    earliest point decides it: two components are equal with the probability of the weighted Jaccard similarity. A
    process stops once its next point is later than every component of its text. Empty multisets keep the value 0.
    """
    docs, seeds, low, span, weight = [], [], [], [], []
    for d, s in enumerate(sets):
        if not len(s):
            continue
        new = np.concatenate(([True], s[1:] != s[:-1]))
        at = np.flatnonzero(new)
        w = np.diff(np.append(at, len(s)))
        element, block = s[at], 0
        while len(w):
            first = 0 if block == 0 else 1 << (block - 1)
            inside = w > first
            element, w = element[inside], w[inside]
            docs.append(np.full(len(w), d))
            seeds.append(mix(element + np.uint64((block + 1) * int(_G) & _ALL)))
            low.append(np.full(len(w), first))
            span.append(np.full(len(w), max(first, 1)))
            weight.append(w)
            block += 1
    best = np.full(len(sets) * size, np.inf)
    if docs:
        doc, seed, lo, sp, wt = (np.concatenate(x) for x in (docs, seeds, low, span, weight))
        time = np.zeros(len(doc))
        latest = np.full(len(sets), np.inf)
        turn = 0
        while len(doc):
            turn += 1
            r = mix(seed + np.uint64(turn * int(_G) & _ALL))
            time = time - np.log((r >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / (size * sp)
            live = time <= latest[doc]
            doc, seed, lo, sp, wt, time, r = (x[live] for x in (doc, seed, lo, sp, wt, time, r))
            r = mix(r)
            component = (r % np.uint64(size)).astype(np.int64)
            level = lo + ((r >> np.uint64(32)) % sp.astype(np.uint64)).astype(np.int64)
            inside = level < wt
            np.minimum.at(best, (doc * size + component)[inside], time[inside])
            if turn < 8 or turn % 8 == 0:
                latest = best.reshape(-1, size).max(axis=1)
    best[np.isinf(best)] = 0
    return best.view(np.uint64).reshape(-1, size)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One long for each band of each signature; the band's number is mixed in."""
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _G
    parts = signature.reshape(len(signature), bands, rows)
    for j in range(rows):
        key = mix(key ^ parts[:, :, j])
    return key.view(np.int64)


def _print_of(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two longs that name a multiset of windows."""
    one = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
    two = [int(mix(s ^ _G).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
    return one, two


def _sketches(docs: DataFrame) -> DataFrame:
    """d (null as 0), absent, th, f1, f2, bands for each row; texts themselves stay behind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slices(texts, 2_000_000):
                sets = shingles([t.encode("utf-8", "surrogatepass") for t in texts[a:b]], WIDTH)
                keys = band_keys(signatures(sets))
                one, two = _print_of(sets)
                bands = [list(k) if len(s) else None for k, s in zip(keys, sets, strict=True)]
                yield pd.DataFrame({"d": pdf["d"].iloc[a:b].to_numpy(), "absent": pdf["absent"].iloc[a:b].to_numpy(), "th": pdf["th"].iloc[a:b].to_numpy(), "f1": one, "f2": two, "bands": bands})

    return _named(docs).mapInPandas(run, "d long, absent boolean, th long, f1 long, f2 long, bands array<long>")


def _named(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("absent"), F.xxhash64(text).alias("th"), text.alias("text"))


def _windows(texts: DataFrame) -> DataFrame:
    """node, size and w (the sorted hashes of the text's windows as a set, 8 bytes each) for rows of node and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = pdf["text"].tolist()
            for a, b in slices(names, 2_000_000):
                sets = list(map(as_set, shingles([t.encode("utf-8", "surrogatepass") for t in names[a:b]], WIDTH)))
                yield pd.DataFrame({"node": pdf["node"].iloc[a:b].to_numpy(), "size": [len(s) for s in sets], "w": [s.tobytes() for s in sets]})

    return texts.mapInPandas(run, "node long, size long, w binary")


def _verified(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts overlap by ``SIMILARITY``; ``windows`` is a table of ``_windows``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = [overlap(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= SIMILARITY for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pdf.loc[good, ["u", "v"]]

    right = windows.select(F.col("node").alias("v"), F.col("size").alias("m"), F.col("w").alias("b"))
    left = windows.select(F.col("node").alias("u"), F.col("size").alias("n"), F.col("w").alias("a"))
    sized = pairs.join(right, "v").join(left, "u").where(F.least("n", "m") >= SIMILARITY * F.greatest("n", "m"))
    return sized.select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def similar_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Whether sets (sorted arrays) i and j are similar, as a boolean matrix.

    Turning the membership of an element round in every set changes no symmetric difference. So elements that over half of
    the sets have are turned round, which makes near copies of one text short lists of differences; sets are similar
    exactly if their symmetric difference is at most a ninth (at 0.8) of their sizes together. Elements of few sets are
    counted by neighbours in sorted order, the others by a matrix product.
    """
    count = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(count), size)
    values = np.concatenate(sets) if count else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    df = np.diff(np.append(start, len(values)))
    own = np.bincount(owner, minlength=count)  # sizes after the turn
    shared = np.zeros((count, count), dtype=np.float32)
    often = np.flatnonzero(df > count / 2)
    many = np.flatnonzero((df > 24) & (df <= count / 2))
    for group, turned in ((many, False), (often, True)):
        for k in range(0, len(group), 2048):
            some = group[k : k + 2048]
            has = np.zeros((count, len(some)), dtype=np.float32)
            at = np.repeat(start[some] - np.cumsum(df[some]) + df[some], df[some]) + np.arange(int(df[some].sum()))
            has[owner[at], np.repeat(np.arange(len(some)), df[some])] = 1
            if turned:
                has = 1 - has
                own = own + (2 * has.sum(1) - len(some)).astype(np.int64)
            shared += has @ has.T
    few = np.repeat((df > 1) & (df <= 24) & (df <= count / 2), df)
    values, owner = values[few], owner[few]
    step = 1
    while step < len(values) and step < 24:
        same = np.flatnonzero(values[step:] == values[:-step])
        if not len(same):
            break
        np.add.at(shared, (owner[same], owner[same + step]), 1)
        np.add.at(shared, (owner[same + step], owner[same]), 1)
        step += 1
    apart = own[:, None] + own[None, :] - 2 * shared  # symmetric differences
    np.fill_diagonal(apart, 0)
    return apart * (1 + SIMILARITY) <= (1 - SIMILARITY) * (size[:, None] + size[None, :]) + 1e-6


def _spanning(members: DataFrame) -> DataFrame:
    """Edges that join the components within each pair of blocks: ``members`` has bucket, i, j (the blocks), node, comp, w.

    All pairs of the blocks whose components differ are compared; of the similar ones only those that join two components
    are returned, at most one fewer than the blocks have rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        comp, node = pdf["comp"].tolist(), pdf["node"].tolist()
        similar = similar_pairs([np.frombuffer(w, np.uint64) for w in pdf["w"]])
        name = np.unique(pdf["comp"].to_numpy(), return_inverse=True)[1]
        similar &= name[:, None] < name[None, :]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(similar), strict=True):
            a, b = find(comp[x]), find(comp[y])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((node[x], node[y]))
        return pd.DataFrame(out, columns=["u", "v"])

    return members.groupBy("bucket", "i", "j").applyInPandas(run, "u long, v long")


def _blocks(placed: DataFrame, budget: int) -> DataFrame:
    """The rows of ``placed`` (bucket, node, comp, size) by pairs of blocks, as bucket, i, j, node, comp.

    The largest component of a bucket is cut into blocks of its own, the other nodes into further ones, each of about
    ``budget`` windows (a node counts as 512 at least). Blocks of the largest component meet those of the others, and those meet
    each other; no two nodes of the largest component do.
    """
    weight = F.greatest("size", F.lit(512))
    sizes = placed.groupBy("bucket", "comp").agg(F.sum(weight).alias("x"))
    whole = sizes.groupBy("bucket").agg(F.max(F.struct("x", "comp")).alias("m"), F.sum("x").alias("x"), F.count("*").alias("comps"))
    whole = whole.where("comps > 1").select("bucket", F.col("m.comp").alias("main"), F.col("m.x").alias("xm"), (F.col("x") - F.col("m.x")).alias("xo"))
    one = F.col("xm") + F.col("xo") <= budget
    blocks = lambda x: F.ceil(x / budget).cast("int")
    whole = whole.select("bucket", "main", F.when(one, 0).otherwise(blocks(F.col("xm"))).alias("mains"), F.when(one, 1).otherwise(blocks(F.col("xo"))).alias("others"))
    rows = placed.join(stored(whole, "blocks"), "bucket")
    # blocks 0..others-1 are of the others, the rest of the largest component; with one block both are in it
    in_main = (F.col("comp") == F.col("main")) & (F.col("mains") > 0)
    own = F.when(in_main, F.col("others") + F.pmod(F.xxhash64("node"), F.greatest("mains", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("others")))
    last = F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    rows = rows.select("bucket", "node", "comp", own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp")


def duplicate_classes(docs: DataFrame, budget: int = 1 << 20) -> DataFrame:
    """Classes of near-duplicate documents.

    Returns d (doc_id, null as 0), absent (whether it is null), th (hash of the text) and k, for each row of ``docs``;
    k has the d, absent and th of the row that stands for the class.

    Two documents are linked if the multisets of their 5-word windows overlap by at least 0.8 (weighted Jaccard);
    the classes are the connected components. Texts of one to four words have one window, texts without words are copies of
    each other. Copies (equal multisets) are one node from the start. For candidates, nodes that share a band meet:

    1. in each bucket every node is verified against one leader, the node with the largest buckets in all: one row a node,
    2. in buckets where more than one component is left, every pair of nodes in different components is compared within
       pairs of blocks (``_blocks``). A block holds windows for ``budget`` bytes times 8 and at most ``budget`` / 512 nodes, so that a
       bucket of fewer nodes has one row a node here too; a larger one is split, and its rows repeat once for each block of nodes
       outside its largest component.

    So every pair that shares a band is verified or already connected, and no task holds more than two blocks. Windows travel
    as 64-bit hashes, computed once for each node. Nodes are named by 64 of the 128 bits of their multisets' prints.
    """
    sketch = stored(_sketches(docs), "sketches")
    # one node for each multiset: its smallest named row
    row = F.struct("absent", "d", "th")
    groups = stored(
        sketch.groupBy("f1", "f2").agg(F.min(row).alias("r"), F.first("bands").alias("bands")).select(
            "f1", "f2", F.col("r.d").alias("d"), F.col("r.absent").alias("absent"), F.col("r.th").alias("th"), F.xxhash64("f1", "f2").alias("node"), "bands"
        ),
        "groups",
    )
    # what is counted for a bucket is stored before it is joined, so that a join can split the rows of a large bucket
    member = groups.select("node", F.explode("bands").alias("bucket"))
    shared = stored(member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    member = stored(member.join(shared, "bucket"), "members")
    weight = member.groupBy("node").agg(F.sum("n").alias("weight"))
    leader = stored(member.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("m")).select("bucket", F.col("m.node").alias("v")), "leaders")
    pairs = member.join(leader, "bucket").where("node <> v").select(F.col("node").alias("u"), "v").repartition("u", "v").distinct()
    pairs = stored(pairs, "pairs")
    involved = groups.join(member.select("node").distinct(), "node", "left_semi").select("node", "d", "absent", "th")
    texts = _named(docs).join(involved, ["d", "absent", "th"]).select("node", "text")
    if not sketch.groupBy("d", "absent", "th").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])  # repeated rows
    windows = stored(_windows(texts), "windows")
    star = stored(_verified(pairs, windows), "star")
    comp = components(star)
    named = windows.select("node", "size").join(comp, "node", "left").select("node", "size", F.coalesce("root", "node").alias("comp"))
    placed = stored(member.join(named, "node").select("bucket", "node", "comp", "size"), "placed")
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"))
    # buckets of the same nodes are looked at once
    open_ = stored(open_.where("lo <> hi").groupBy("n", "s").agg(F.min("bucket").alias("bucket")).select("bucket"), "open")
    left = stored(placed.join(open_, "bucket"), "left")
    more = stored(_spanning(_blocks(left, budget).join(windows.select("node", "w"), "node")), "more")
    if more.isEmpty():
        final = comp
    else:
        final = components(star.unionByName(more))
    named = groups.join(final, "node", "left").select("f1", "f2", "node", "d", "absent", "th", F.coalesce("root", "node").alias("root"))
    named = stored(named, "named")
    first = stored(named.groupBy("root").agg(F.min(F.struct("absent", "d", "th")).alias("k")), "first")
    classes = named.select("f1", "f2", "root").join(first, "root")
    out = sketch.select("d", "absent", "th", "f1", "f2").join(classes, ["f1", "f2"])
    for table in (groups, shared, member, leader, pairs, windows, star, placed, open_, left, more):
        discard(table)
    return out.select("d", "absent", "th", "k")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id for every row of ``docs``; see ``duplicate_classes``.

    class_id is the smallest doc_id of the class, null only if no row of the class has a doc_id. is_kept marks the
    rows that stay when one document of each class is kept (repeated rows of that document share the mark).
    """
    rows = duplicate_classes(docs)
    kept = (F.col("k.absent") == F.col("absent")) & (F.col("k.d") == F.col("d")) & (F.col("k.th") == F.col("th"))
    return rows.select(
        F.when(~F.col("absent"), F.col("d")).alias("doc_id"),
        F.when(~F.col("k.absent"), F.col("k.d")).alias("class_id"),
        kept.alias("is_kept"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one for each class, the one with the smallest doc_id.

    Of rows that repeat both doc_id and text one stays, whichever comes first.
    """
    rows = duplicate_classes(docs)
    kept = rows.where((F.col("k.absent") == F.col("absent")) & (F.col("k.d") == F.col("d")) & (F.col("k.th") == F.col("th")))
    kept = stored(kept.groupBy("d", "absent", "th").agg(F.count("*").alias("times")), "kept")
    text = text_of()
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(0)) == kept["d"]) & (docs["doc_id"].isNull() == kept["absent"]) & (F.xxhash64(text) == kept["th"])
    repeated = not kept.where("times > 1").isEmpty()
    if not repeated:
        return docs.join(kept, same, "left_semi")
    names = docs.columns
    once = docs.join(kept.where("times = 1"), same, "left_semi")
    again = docs.join(kept.where("times > 1"), same, "left_semi").groupBy(docs["doc_id"], F.xxhash64(text)).agg(F.first(F.struct(*[docs[n] for n in names])).alias("r"))
    return once.unionByName(again.select("r.*"))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
