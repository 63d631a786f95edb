"""Token output, packing and token counts against brute force."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillrec.llm import packing, token_counts, token_output
from quillrec.llm.common import CachedTokenizer

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a", "a b", " a", "a ", "a  b", "a   b", "\n", "a\n\n b", "a \n", "a \n b", "\t a\t", "x  y", "é́ é ñ",
    "A'll it's 12 345", "<|endoftext|> a", "b<|endoftext|>", "the\x1cend \x85 of", "word " * 3000, "　 　", "日本語 テスト",
]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "shadow", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_ids_equal_the_library(name):
    tok = CachedTokenizer(name, limit=50)
    plain = CachedTokenizer(name).tokenizer
    texts = [t or "" for t in ODD]
    for _ in range(2):
        got = tok.encode(texts)
        for t, g in zip(texts, got, strict=True):
            assert g.tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


_TOKS = {}


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0b ab'1.É́<|>ß", max_size=24), st.sampled_from(["word_bpe_49k.json", "byte_bpe_50k.json"]))
def test_cached_ids_equal_the_library_on_any_spacing(text, name):
    tok = _TOKS.setdefault(name, CachedTokenizer(name))
    assert tok.encode([text])[0].tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=600), st.sampled_from([0.0, 50.0, 90.0, 100.0]))
def test_block_round_trip(ids, percentile):
    ids = np.array(ids, dtype=np.uint32)
    data = token_output.pack_block(ids, percentile)
    back, at = token_output.unpack_block(data)
    assert at == len(data) and back.tolist() == ids.tolist()


def test_shard_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 5000, 511, 513, 0, 2)]
    names = [5, None, -3, 7, 7, 9, 2**40]
    image = token_output.encode_shard(names, arrays)
    got_names, got = token_output.decode_shard(image)
    assert got_names == names and [g.tolist() for g in got] == [a.tolist() for a in arrays]
    for i, a in enumerate(arrays):
        assert token_output.decode_document(image, i).tolist() == a.tolist()
    assert token_output.decode_shard(token_output.encode_shard([], []))[0] == []


def test_output_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(df.select("doc_id", "text").collect())
    tok = CachedTokenizer("word_bpe_49k.json").tokenizer
    want, start = [], 0
    for r in rows:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, token_output.token_output(df, shard_ids=3000).collect())) == want


def test_output_of_odd_rows(spark):
    ids = [3, None, 3, 3, *range(10, 10 + len(ODD) - 4)]
    got = sorted(map(tuple, token_output.token_output(docs(spark, ODD, ids), shard_ids=5).collect()), key=lambda r: r[1])
    assert len(got) == len(ODD) and got[0][0] is None
    assert [r[0] for r in got[1:]] == sorted(i for i in ids if i is not None)
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    assert token_output.token_output(docs(spark, [])).count() == 0


def check_packed(rows, texts, capacity=1024):
    tok = CachedTokenizer("byte_bpe_50k.json").tokenizer
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(texts)
    for d, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [p.length for p in pieces] == packing.piece_lengths(len(ids), capacity)
        at = 0
        for p in pieces:
            assert (p.start, p.ids_crc32) == (at, crc(ids[at : at + p.length]))
            at += p.length
    used = 0
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        used += at
    return len(by_seq), used


def test_packing_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    n, used = check_packed(packing.pack(df).collect(), texts)
    assert n <= 1.02 * -(-used // 1024) + 1


def test_packing_of_odd_rows(spark):
    n, _ = check_packed(packing.pack(docs(spark, ODD)).collect(), dict(enumerate(ODD)))
    assert n >= 1
    assert packing.pack(docs(spark, [])).count() == 0
    same = packing.pack(docs(spark, ["a b", "a b", "c"], [1, 1, None]), with_ids=True).collect()
    assert len(same) == 3 and all(len(r.ids) == r.length for r in same)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=80), st.integers(1, 5))
def test_bins_are_never_over_full(lengths, open_bins):
    bins, fill = packing.BestFit(16, open_bins), {}
    for n in lengths:
        b, offset = bins.add(n)
        assert offset == fill.get(b, 0)
        fill[b] = offset + n
        assert fill[b] <= 16 and bins.count <= open_bins


def test_histogram(spark):
    texts = ODD + ["a b c"] * 5
    tok = CachedTokenizer("byte_bpe_50k.json").tokenizer
    sizes = np.array([len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts])
    rows = token_counts.length_histogram(docs(spark, texts), width=4).orderBy("n_tokens").collect()
    assert [r.n_tokens for r in rows] == sorted(set(sizes.tolist()))
    for r in rows:
        n = r.n_tokens
        assert r.n_docs == (sizes == n).sum() and r.docs_upto == (sizes <= n).sum() and r.docs_longer == (sizes > n).sum()
        assert r.tokens_upto == sizes[sizes <= n].sum() and r.tokens_longer == sizes[sizes > n].sum()
        assert r.truncated_tokens == np.minimum(sizes, n).sum() and r["quantile"] == pytest.approx((sizes <= n).mean())
    got = token_counts.answers(token_counts.length_histogram(docs(spark, texts)), [2, 5000]).orderBy("context_limit").collect()
    assert [g.truncated_tokens for g in got] == [np.minimum(sizes, 2).sum(), np.minimum(sizes, 5000).sum()]
    assert token_counts.length_histogram(docs(spark, [])).count() == 0
