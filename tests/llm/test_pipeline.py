"""The corpus pipeline, stage by stage, against the operators' own brute-force versions."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm import test_decontamination, test_near_dedup, test_pii, test_tokens

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, bench = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "personal_data", "packing"]
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, after = texts(docs), stage(spark, docs, SF)
        if name == "packing":
            test_tokens.check_packed(after.collect(), before)
            break
        assert after.columns == columns
        docs = after.cache()
        now = texts(docs)
        assert docs.count() == len(now) and set(now) <= set(before)
        if name != "personal_data":
            assert all(before[d] == t for d, t in now.items())
        if name == "quality":
            assert 0.5 * len(before) < len(now) < len(before)
        if name == "near_dedup":
            assert set(now) == set(test_near_dedup.brute(list(before.items())).values())
        if name == "decontamination":
            assert set(before) - set(now) == {d for d, _ in test_decontamination.brute(list(before.items()), bench)}
        if name == "personal_data":
            assert set(now) == set(before) and not any(test_pii.brute(t) for t in now.values())
            assert all(now[d] == t for d, t in before.items() if not test_pii.brute(t))
    want = {tuple(r)[:5] for r in after.collect()}
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and columns named like the operators' own: every stage keeps whole rows."""
    long = " ".join(f"w{i % 900} a{i}@b.com" for i in range(4000))
    rows = [(None, None), (None, ""), (None, "a b"), (1, None), (1, None), (2, " \n"), (3, long), (4, long), (5, "call +1 (974) 555-3436"), (5, "call +1 (974) 555-3436")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("d", "th", "k", "node", "__cuts", "__d", "__absent", "__th", "score", "length", "piece", "sequence_id", "item_id", "bucket", "y", "id", "x", "h", "times", "absent"):
        docs = docs.withColumn(name, F.lit("own"))
    kept = {"quality": None, "near_dedup": 4, "decontamination": 10, "personal_data": 10}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert all(r["__d"] == r["th"] == r["score"] == "own" for r in got)
        assert kept[name] is None or len(got) == kept[name], name
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "personal_data":
            assert sorted(str(r.text) for r in got if r.doc_id == 5) == ["call <phone>"] * 2 and sum(r.text is None for r in got) == 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {None, 1, 2, 3, 4, 5} and all(0 < r.length <= 1024 for r in pieces)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
