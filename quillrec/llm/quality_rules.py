"""Quality rules: counts of a text, and lines that many documents of a host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, documents, stored, text_of

SPACE, WORD = f"[{SPACE_CLASS}]+", f"[^{SPACE_CLASS}]"
SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for use inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def _covered(sorted_starts: Column) -> Column:
    """How many words windows of three cover that start at these ascending positions."""
    step = lambda q: F.transform(q, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(q, k + 1), p + 3) - p))
    return _let(sorted_starts, lambda q: F.aggregate(step(q), F.lit(0), lambda a, x: a + x))


def _repeated(sorted_windows: Column) -> Column:
    """Ascending places of the windows (h, i) whose hash a neighbour in sorted order shares."""

    def starts(s: Column) -> Column:
        near = lambda v, k: (F.get(s, k - 1)["h"] == v["h"]) | (F.get(s, k + 1)["h"] == v["h"])
        marked = F.transform(s, lambda v, k: F.when(F.coalesce(near(v, k), F.lit(False)), v["i"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    return _let(sorted_windows, starts)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, the first one included.

    Windows are 64-bit hashes. Only texts with a repeated window are sorted, as (hash, place) structs. Time is n log n in
    the words of a text.
    """

    def count(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(_covered(_repeated(pairs)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(
        hashes,
        lambda h: F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)),
        ),
    )
    return _let(windows, count).cast("long")


def text_counts(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeat_words(words),
    }


def normalised(line: Column) -> Column:
    """Lower case, one space between words, none around them."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _lines(text: Column) -> Column:
    """The normalised lines of a text that have a word: array of (h: hash, w: words)."""
    found = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    count = lambda y: F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1
    return F.transform(found, lambda x: _let(normalised(x), lambda y: F.struct(F.xxhash64(y).alias("h"), count(y).alias("w"))))


def _over_limit(lines: DataFrame, max_documents: int) -> DataFrame:
    """(host, h) of the lines that more than ``max_documents`` distinct documents of a host have; ``lines`` has host, h, th.

    Documents with the same whole text (hash th) are one document, near copies are distinct ones. Distinct rows are
    counted with partial sums, so a very common line is never in one place.
    """
    return lines.select("host", "h", "th").distinct().groupBy("host", "h").count().where(F.col("count") > max_documents).select("host", "h")


def depleted_documents(texts: DataFrame, max_documents: int = 10, max_removed: float = 0.5) -> DataFrame:
    """Keys (doc_id, host, th: hash of the text) of documents that lose more than ``max_removed`` of their words.

    ``texts`` has the key and lines (``_lines``). A normalised line is removed if more than ``max_documents`` distinct
    documents of its host have it (``_over_limit``).
    """
    rows = texts.select("doc_id", "host", "th", F.explode("lines").alias("p")).select("doc_id", "host", "th", "p.h", "p.w")
    over = _over_limit(rows, max_documents).withColumn("over", F.lit(1))
    marked = rows.join(over, ["host", "h"], "left")
    sums = marked.groupBy("doc_id", "host", "th").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("over") == 1, F.col("w"))).alias("removed"))
    return sums.where(F.coalesce(F.col("removed"), F.lit(0)) > max_removed * F.col("all")).select("doc_id", "host", "th")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, host (a null source is the host of the empty name), th and text of every row."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text_of().alias("text"))
    return rows.select("doc_id", "host", F.xxhash64("text").alias("th"), "text")


def quality_rules(docs: DataFrame, max_documents: int = 10, max_removed: float = 0.5) -> DataFrame:
    """Counts of each whole text and the verdict: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, depleted.

    base_failed: under 50 words, or more than half of the words in repeated 3-word windows. kept: neither that nor
    depleted by the removal of lines over the limit (``depleted_documents``). A null text has no words and fails.
    Repeated rows are judged each on its own and get the same verdict; a null doc_id is a value like any other. Texts are
    read and split once: their counts and line hashes are stored.
    """
    rows = _keyed(docs).withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    counts = [c.alias(n) for n, c in text_counts(F.col("text"), F.col("words")).items()]
    rows = stored(rows.select("doc_id", "host", "th", *counts, _lines(F.col("text")).alias("lines")), "counts")
    bad = depleted_documents(rows, max_documents, max_removed)
    bad = bad.select(F.col("doc_id").alias("b_id"), F.col("host").alias("b_host"), F.col("th").alias("b_th"))
    same = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("host") == F.col("b_host")) & (F.col("th") == F.col("b_th"))
    out = rows.drop("lines").join(bad, same, "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("b_th").isNotNull()
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), depleted.alias("depleted"),
    )


def cleaned(docs: DataFrame, max_documents: int = 10) -> DataFrame:
    """doc_id and the text without the lines over the limit (``_over_limit``), for every row of ``docs``."""
    rows = _keyed(docs)
    parts = rows.dropDuplicates(["doc_id", "host", "th"]).select("doc_id", "host", "th", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    norm = F.when(F.col("line").rlike(WORD), normalised(F.col("line")))
    parts = parts.withColumn("h", F.when(norm.isNotNull(), F.xxhash64(norm)))
    kept = parts.join(_over_limit(parts.where("h is not null"), max_documents), ["host", "h"], "left_anti")
    lines = kept.groupBy("doc_id", "host", "th").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("l"))
    lines = lines.select(F.col("doc_id").alias("d"), F.col("host").alias("o"), F.col("th").alias("t"), F.array_join("l.line", "\n").alias("clean"))
    return rows.join(lines, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("host") == F.col("o")) & (F.col("th") == F.col("t")), "left").select(
        "doc_id", F.coalesce("clean", F.lit("")).alias("text")
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


_SPLIT = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ORACLE = (
    r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, """
    + _SPLIT.replace("{t}", "text")
    + r""" AS words FROM d),
win AS (SELECT i, unnest(generate_series(1, len(words) - 2)) AS p, words FROM w),
key AS (SELECT i, p, words[p] || ' ' || words[p+1] || ' ' || words[p+2] AS k FROM win),
twice AS (SELECT i, k FROM key GROUP BY i, k HAVING count(*) > 1),
cov AS (SELECT i, count(DISTINCT p + o) AS n FROM key JOIN twice USING (i, k), (VALUES (0), (1), (2)) AS v(o) GROUP BY i),
l AS (SELECT i, host, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT i, host, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT i, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY i),
body AS (SELECT i, md5(text) AS body FROM d),
freq AS (SELECT host, norm FROM lw JOIN body USING (i) GROUP BY host, norm HAVING count(DISTINCT body) > 10),
r AS (SELECT i, sum(len(string_split(norm, ' '))) AS a, sum(CASE WHEN freq.norm IS NOT NULL THEN len(string_split(lw.norm, ' ')) ELSE 0 END) AS rem
  FROM lw LEFT JOIN freq USING (host, norm) GROUP BY i),
f AS (SELECT d.i, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, coalesce(rem > 0.5 * a, false) AS depleted
  FROM d JOIN w ON w.i = d.i LEFT JOIN dup ON dup.i = d.i LEFT JOIN cov ON cov.i = d.i LEFT JOIN r ON r.i = d.i)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT depleted AS kept, depleted FROM f
"""
)
