"""Helpers that the training-data operators share: storage, components, tokenizers, word hashes."""

from __future__ import annotations

import atexit
import json
import os
import re
import tempfile
import unicodedata
import uuid
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and \x09-\x0D, in every operator.
SPACE_CLASS = r"\x20\x09-\x0D"


#: Rows in a batch that goes to Python: whole texts are long, and a task holds a few batches.
ARROW_ROWS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null doc_id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


# ---------------------------------------------------------------- shared storage

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillrec-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quillrec-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rsplit("/", 1)[0]))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` into the shared folder and returns a reader of those files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillrec_path = path.rsplit("/", 1)[0]
    return out


def discard(df: DataFrame) -> None:
    """Deletes a stored table that no later plan reads."""
    path = getattr(df, "_quillrec_path", None)
    if path:
        _delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star.

    ``edges`` has two long columns, u and v; self-loops and repeats are harmless, nulls are dropped.
    Returns (node, root) for every node with an edge to another node; root is the smallest node of its component.
    Each round needs only a minimum per node and equi-joins, so no neighbour list is ever gathered.
    """
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        new = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = _mark(new)
        discard(e)
        e, done = new, now == mark
        mark = now
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return (row[0], row[1])


# ---------------------------------------------------------------- tokenizers


def tokenizer_file(name_or_path: str) -> str:
    """A path stays; a bare file name is looked up among the installed public vocabularies."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


#: White space other than space and line feed (fixed values).
_RARE_SPACE = tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


#: Letters of the Latin blocks, then ASCII punctuation but the apostrophe; the byte-level alphabet: bytes that do not
#: print stand as characters from U+0100 on.
_PLAIN = re.compile("([A-Za-z\xaa-\u024f]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _is_latin(text: str) -> bool:
    """Whether all characters are Latin-1: lower() then does what the tokenizer's normaliser would do."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class CachedTokenizer:
    """``tokenizers`` ids of whole texts, with the ids of frequent chunks remembered.

    Both vocabularies never merge across certain spaces, so a text is cut there and each distinct chunk
    is encoded once per worker; beyond ``limit`` remembered chunks the memory starts afresh. New chunks are encoded many
    at a time, with a separator between them whose id no chunk can have. A text in which such a cut could change an id
    is encoded in one piece.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit; its threads would only spin
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(path))
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # it would only see chunks that are new
        self.cache: dict[str, bytes] = {}
        self.limit = limit
        spec = json.loads(self.tokenizer.to_str())
        self.keeps_space = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32
        self.code = "H" if self.dtype is np.uint16 else "I"
        # a cut before each space and line feed is safe, but within longer runs of white space
        self.whole = re.compile(r"\s{3}|\s{2}\Z|<\||\0") if self.keeps_space else re.compile(r"<\|")
        self.tails: dict[str, bytes] = {}
        self.between = "\n" if self.keeps_space else " | "
        mark = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _quick(self, chunks: list[str]) -> list[str]:
        """Encodes plain words, and plain words before punctuation, straight by the merge model; returns the other chunks.

        Both splitters part a run of letters from the ASCII punctuation after it (an apostrophe could open a contraction, so it
        is left to them). What their byte step would do to the letters is done here; letters beyond Latin are left too.
        """
        cache, pack, space, rest = self.cache, self._pack, chr(_BYTE_CHARS[32]) if self.keeps_space else "", []
        tokenize, tails, of_byte = self.tokenizer.model.tokenize, self.tails, _BYTE_CHARS
        for c in chunks:
            m = _PLAIN(c)
            word = m and m[1]
            if not word or not word.isalpha():
                rest.append(c)
                continue
            if not self.keeps_space:
                if word.isascii():
                    word = word.lower()
                elif not word.islower() or not unicodedata.is_normalized("NFC", word):
                    rest.append(c)
                    continue
            tail = m[2]
            base = cache.get(word) if tail else None
            if base is None:
                text = space + (word if word.isascii() else word.encode().decode("latin-1").translate(of_byte))
                base = pack([t.id for t in tokenize(text)])
                cache[word] = base
            if tail:
                end = tails.get(tail)
                if end is None:
                    if len(tails) > 50_000:
                        tails.clear()
                    end = tails[tail] = pack([t.id for t in tokenize(tail)])
                cache[c] = base + end
            elif word != c:
                cache[c] = base
        return rest

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, chunks: list[str], group: int = 64) -> None:
        chunks = self._quick(chunks)
        cache, mark = self.cache, "\n" if self.keeps_space else "|"
        alone = [c for c in chunks if self.mark is None or not c or mark in c or c[0] == "\0" or c[-1].isspace()]
        if alone:
            skip = set(alone)
            chunks = [c for c in chunks if c not in skip]
            for c, ids in zip(alone, self._ids(list(map(self._text, alone))), strict=True):
                cache[c] = ids.tobytes()
        size = np.dtype(self.dtype).itemsize
        between = self.between + " " if self.keeps_space else self.between
        first = " " if self.keeps_space else ""
        groups = [chunks[i : i + group] for i in range(0, len(chunks), group)]
        for some, ids in zip(groups, self._ids([first + between.join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some) - 1:
                for c, own in zip(some, self._ids(list(map(self._text, some))), strict=True):
                    cache[c] = own.tobytes()
                continue
            data, at = ids.tobytes(), 0
            for c, cut in zip(some, (cuts * size).tolist(), strict=False):
                cache[c] = data[at:cut]
                at = cut + size
            cache[some[-1]] = data[at:]

    def _text(self, chunk: str) -> str:
        """What a chunk stands for: most have lost the space before them."""
        if not self.keeps_space or chunk[:1] == "\n":
            return chunk
        return chunk[1:] if chunk[:1] == "\0" else " " + chunk

    def _odd(self, text: str) -> bool:
        """Whether the text must be encoded in one piece; the quick tests spare most texts the pattern."""
        if self.keeps_space:
            runs = "  " in text or "\n " in text or " \n" in text or "\n\n" in text or "\0" in text
            if not (runs or "<|" in text or any(map(text.__contains__, _RARE_SPACE))):
                return False
        elif "<|" not in text:
            return False
        return self.whole.search(text) is not None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cache = self.cache
        if len(cache) > self.limit:
            cache.clear()
        pieces: list[list[str] | None] = []
        seen: set[str] = set()
        for text in texts:
            if self._odd(text):
                pieces.append(None)
                continue
            if self.keeps_space:
                parts = text.replace("\n", " \n").split(" ")
                parts[0] = "\0" + parts[0]  # it has no space before it
            elif any(map(text.__contains__, "\x1c\x1d\x1e\x1f")):  # white space to split(), not to the tokenizer
                parts = text.replace("\n", " ").split(" ")
            else:
                parts = (text.lower() if _is_latin(text) else text).split()
            pieces.append(parts)
            seen.update(parts)
        self._learn(list(seen.difference(cache)))
        get = cache.__getitem__
        out = []
        for text, parts in zip(texts, pieces, strict=True):
            if parts is None:
                out.append(self._ids([text])[0].astype(np.uint32))
            else:
                out.append(np.frombuffer(b"".join(map(get, parts)), dtype=self.dtype).astype(np.uint32))
        return out


@lru_cache(maxsize=4)
def cached_tokenizer(path: str, limit: int = 600_000) -> CachedTokenizer:
    """One per Python worker and vocabulary. About 250 bytes for each of ``limit`` chunks."""
    return CachedTokenizer(path, limit)


def slices(texts: list[str], most: int = 2_000_000) -> list[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters; one longer text is a range of its own."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((start, i))
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        out.append((start, len(texts)))
    return out


# ---------------------------------------------------------------- word and shingle hashes

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _G)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes in one array, where its words start and end, and where each text's words start (len(texts) + 1 offsets)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _IS_SPACE[buf]
    before = np.empty(len(buf), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return buf, starts, ends, np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


def hashes_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places."""
    n = len(buf)
    up = np.full(n + 1, _P, dtype=np.uint64)
    up[0] = 1
    np.multiply.accumulate(up, out=up)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[:-1], out=total[1:])
    # p to the power of -start: the inverse's powers, only up to the last start
    down = np.full(n + 1, _P_INV, dtype=np.uint64)
    down[0] = 1
    np.multiply.accumulate(down, out=down)
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of UTF-8 texts, and where each text's words start (len(texts) + 1 offsets)."""
    buf, starts, ends, at = word_places(texts)
    return hashes_of(buf, starts, ends), at


def shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Each text's word windows as a sorted uint64 array of hashes, repeats kept.

    A text of fewer words than ``width`` has one window of all its words; one without words has none.
    """
    words, at = word_hashes(texts)
    k = np.uint64(0xD6E8FEB86659FD93)
    count = len(words)
    full = np.zeros(max(count - width + 1, 0), dtype=np.uint64)
    for j in range(width):
        full = mix(full * k + words[j : j + len(full)]) if j == width - 1 else full * k + words[j : j + len(full)]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.sort(full[a : b - width + 1]))
        elif b > a:
            h = np.zeros(1, dtype=np.uint64)
            for w in words[a:b]:
                h = h * k + w
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def as_set(sorted_hashes: np.ndarray) -> np.ndarray:
    """A multiset as a set: the n-th occurrence of a window becomes an element of its own."""
    h = sorted_hashes
    if len(h) < 2 or not (h[1:] == h[:-1]).any():
        return h
    first = np.concatenate(([True], h[1:] != h[:-1]))
    at = np.flatnonzero(first)
    nth = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    return np.sort(np.where(nth > 0, mix(h + nth.astype(np.uint64) * _G), h))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Multiset Jaccard similarity of two ``as_set`` arrays; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)
