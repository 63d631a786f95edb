"""Personal data by patterns and by bootstrapped contexts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, documents, stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Nothing after a loop could make it give back what it took, so loops are possessive: groups then repeat
#: without recursion, whatever the text's length. A look-behind lets a run of characters be tried only from its start, or where the last match ended.
_MAIL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to be searched for a kind at all.
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words with a digit or an at sign, as candidates for contexts.
_CANDIDATE = rf"(?<![^{SPACE_CLASS}])[^{SPACE_CLASS}0-9@]*+[0-9@][^{SPACE_CLASS}]*+"
_EDGE = r"[^A-Za-z0-9+]+"
CONTEXT = "context"
KEY = ["d", "absent", "th"]


def named(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("absent"), F.xxhash64(text).alias("th"), text.alias("text"))


def _last_words(gap: Column) -> Column:
    """The last two words, the last one first; fewer if there are no more. Time is linear in the gap's length."""
    parts = F.filter(F.split(F.reverse(gap), f"[{SPACE_CLASS}]+", 4), lambda x: x != "")
    return F.transform(F.slice(parts, 1, 2), F.reverse)


def _found(pattern: str, hint: str | None) -> Column:
    """Matches with the text between them: array of (gap length, match length, the gap's last words for candidates, match)."""
    cut = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("hit"))
    rows = F.transform(
        F.filter(cut, lambda x: x["hit"].isNotNull()),
        lambda x: F.struct(F.length(x["gap"]).alias("g"), F.length(x["hit"]).alias("m"), (_last_words(x["gap"]) if pattern == _CANDIDATE else F.array().cast("array<string>")).alias("tail"), x["hit"].alias("hit")),
    )
    # a candidate is a word, so that with the two candidates before it, the gaps hold the two words before any candidate
    words = lambda r, i: F.when(i < 0, F.array().cast("array<string>")).otherwise(F.concat(F.get(r, i)["tail"], F.when(i > 0, F.array(F.get(r, i - 1)["hit"])).otherwise(F.array().cast("array<string>"))))
    near = lambda r, i: F.slice(F.concat(words(r, i), F.when(i > 0, words(r, i - 1)).otherwise(F.array().cast("array<string>"))), 1, 2)
    rows = F.transform(
        F.array(rows),
        lambda r: F.transform(r, lambda x, i: F.struct(x["g"].alias("g"), x["m"].alias("m"), ((i > 0) & (F.size(x["tail"]) == 0)).alias("next"), near(r, i).alias("before"), x["hit"].alias("hit"))),
    )[0]
    return rows if hint is None else F.when(F.contains(F.col("text"), F.lit(hint)), rows)


def matches(rows: DataFrame) -> DataFrame:
    """All matches of the base patterns and all candidate words, with their places.

    ``rows`` is ``named(docs)``. Returns the key, kind, start, end, next (whether a candidate directly follows
    another), before (a candidate's two words before it, the nearest first; empty for other kinds) and hit. Gap and match lengths are summed over each text's matches, so
    time is linear in a text's matches; rows that repeat doc_id and text are told apart nowhere and count once.
    """
    parts = [F.struct(F.lit(k).alias("kind"), _found(p, _HINT[k]).alias("found")) for k, p in PATTERNS.items()]
    parts.append(F.struct(F.lit("candidate").alias("kind"), _found(_CANDIDATE, None).alias("found")))
    out = rows.where(F.col("text").rlike("[0-9@]")).select(*KEY, F.explode(F.array(*parts)).alias("p"))
    out = out.select(*KEY, "p.kind", F.posexplode("p.found").alias("i", "f")).select(*KEY, "kind", "i", "f.*")
    out = out.repartition(*KEY).distinct()
    so_far = Window.partitionBy(*KEY, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("g") + F.col("m")).over(so_far)
    return out.withColumn("end", end).select(*KEY, "kind", (F.col("end") - F.col("m")).alias("start"), "end", "next", "before", "hit")


def valid(kind: Column, hit: Column) -> Column:
    """Whether a base match holds: address parts up to 255, 12 to 19 digits and Luhn, 9 to 15 digits."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    size = F.length(digits)
    # digits from the last: those at odd places are doubled, with 9 taken off above 9
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(2 * x.cast("int") - F.when(x > "4", 9).otherwise(0)))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", F.when((size >= 12) & (size <= 19), total % 10 == 0).otherwise(False))
        .when(kind == "phone", (size >= 9) & (size <= 15))
        .otherwise(False)
    )


def _shape(word: Column) -> Column:
    return F.when(word.contains("@"), "at").when(word.rlike("^[0-9+().:/-]+$"), "number").otherwise("mixed")


def discovered(found: DataFrame, rounds: int = 3, least: float = 0.9, support: int = 5) -> DataFrame:
    """Spans that the contexts of known entities give away: the key, start, end.

    Candidates are words with an at sign or at least four digits, trimmed of punctuation. Those that touch a base span are
    seeds with score 1. A pattern is the one or two words before the whole entity of a candidate (the base span, or the run
    of neighbouring candidate words that touch none) and the candidate's shape; patterns without a word are left out. Its score is the mean score of its
    distinct instances, damped by one more instance of score 0, and 0 with fewer than ``support`` instances. An
    instance's score is 1 minus the product of (1 - score) over its patterns. After ``rounds`` of this on the
    graph of patterns and instances, candidates of instances that score at least ``least`` are returned. The graph is
    pre-aggregated to distinct (pattern, instance) edges, scored by joins and sums.
    """
    base = found.where(F.col("kind") != "candidate").where(valid(F.col("kind"), F.col("hit")))
    word = F.regexp_replace(F.regexp_replace("hit", rf"^{_EDGE}", ""), rf"{_EDGE}$", "")
    cand = found.where("kind = 'candidate'").withColumn("word", word).withColumn("at", F.col("start"))
    cand = cand.withColumn("start", F.col("start") + F.length(F.regexp_extract("hit", rf"^(?:{_EDGE})?", 0))).withColumn("end", F.col("start") + F.length("word"))
    both = cand.select(*KEY, "at", "start", "end", "next", "before", "word").unionByName(base.select(*KEY, F.col("start").alias("at"), "start", "end"), allowMissingColumns=True)
    by = Window.partitionBy(*KEY).orderBy("start", F.col("word").isNotNull())
    is_base = F.col("word").isNull()
    earlier = F.max(F.when(is_base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    # from the last row on: a frame that ends at the current row only grows, so each row costs the same
    back = Window.partitionBy(*KEY).orderBy(F.desc("start"), F.col("word").isNotNull().desc())
    later = F.min(F.when(is_base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    # a base span that starts before a candidate word and ends in or after it
    words = Window.partitionBy(*KEY).orderBy("at", is_base)
    crossed = F.max(F.when(is_base, F.col("end"))).over(words.rowsBetween(Window.unboundedPreceding, -1)) > F.col("at")
    both = both.withColumn("seed", F.coalesce(earlier > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("end"), F.lit(False)))
    both = both.withColumn("crossed", F.coalesce(crossed, F.lit(False))).where("word is not null")
    follows = Window.partitionBy(*KEY).orderBy("at")
    joined = F.col("crossed") | F.col("next") & ~F.col("seed") & ~F.lag("seed", 1, False).over(follows)
    both = both.withColumn("joined", joined)
    both = both.withColumn("before", F.last(F.when(~F.col("joined"), F.col("before")), ignorenulls=True).over(follows.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.where(F.col("word").contains("@") | (F.length(F.regexp_replace("word", "[^0-9]", "")) >= 4))
    one = F.lower(F.get("before", F.lit(0)))
    two = F.lower(F.concat(F.get("before", F.lit(1)), F.lit(" "), F.get("before", F.lit(0))))
    shape = _shape(F.col("word"))
    inst = F.xxhash64(F.lower("word"))
    pats = F.array(F.when(one.isNotNull(), F.xxhash64(F.lit(1), one, shape)), F.when(two.isNotNull(), F.xxhash64(F.lit(2), two, shape)))
    # without a word before it, an entity is in no shared pattern: its instance's own one keeps the seed and never has support
    pats = F.when(F.size("before") == 0, F.array(F.xxhash64(F.lit(0), inst))).otherwise(F.array_compact(pats))
    both = stored(both.select(*KEY, "start", "end", "seed", inst.alias("inst"), pats.alias("pats")), "candidates")
    edges = stored(both.select("inst", "seed", F.explode("pats").alias("pat")).groupBy("pat", "inst").agg(F.max("seed").alias("seed")), "edges")
    scores = edges.groupBy("inst").agg(F.max("seed").cast("double").alias("s"))
    for _ in range(rounds):
        scored = edges.join(scores, "inst").groupBy("pat").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
        scored = scored.select("pat", F.when(F.col("n") >= support, F.col("s") / (F.col("n") + 1)).otherwise(0.0).alias("p"))
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))
        scores = edges.join(scored, "pat").groupBy("inst").agg(F.when(F.max("seed"), F.lit(1.0)).otherwise(1 - miss).alias("s"))
        scores = stored(scores, "scores")
    good = scores.where(F.col("s") >= least).select("inst")
    return both.where("not seed").join(good, "inst", "left_semi").select(*KEY, "start", "end")


def spans_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``named(docs)`` without texts, and all spans: the key, kind, start, end."""
    rows = named(docs)
    found = stored(matches(rows), "matches")
    base = found.where(F.col("kind") != "candidate").where(valid(F.col("kind"), F.col("hit"))).select(*KEY, "kind", "start", "end")
    more = discovered(found).select(*KEY, F.lit(CONTEXT).alias("kind"), "start", "end")
    return rows.select(*KEY), base.unionByName(more)


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text: doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans.

    Base matches are leftmost and non-overlapping per kind; those that fail their test are dropped. Spans that contexts
    give away (``discovered``) come on top and touch no base span. A null text is empty; rows with repeated or null
    doc_ids are each returned.
    """
    rows, spans = spans_of(docs)
    order = F.array_position(F.array(*map(F.lit, (*KINDS, CONTEXT))), F.col("kind"))
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    spans = spans.select(*KEY, "kind", F.struct("start", order.alias("o"), name.alias("name")).alias("span"))
    count = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}")
    listed = spans.groupBy(*KEY).agg(*(count(k) for k in (*KINDS, CONTEXT)), F.sort_array(F.collect_list("span")).alias("l"))
    joined = lambda a: F.array_join(F.coalesce(a, F.array().cast("array<string>")), ",")
    base = F.transform(F.filter("l", lambda s: s["o"] <= len(KINDS)), lambda s: s["name"])
    zero = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}")
    return rows.join(listed, KEY, "left").select(
        F.when(~F.col("absent"), F.col("d")).alias("doc_id"), *(zero(k) for k in (*KINDS, CONTEXT)),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("l.name")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with every span of personal data replaced by its kind in angle brackets.

    Spans that touch each other become one, named after the first. n_chars, where there is such a column, is counted anew.
    Other columns may have any names.
    """
    taken = {n.lower() for n in docs.columns}
    cut_d, cut_absent, cut_th, cuts_of = ("_" * max(map(len, taken)) + n for n in ("d", "absent", "th", "cuts"))  # longer than any name
    _, spans = spans_of(docs)
    order = F.array_position(F.array(*map(F.lit, (*KINDS, CONTEXT))), F.col("kind"))
    by = Window.partitionBy(*KEY).orderBy("start", order)
    spans = spans.withColumn("new", F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True)))
    spans = spans.withColumn("island", F.sum(F.col("new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    islands = spans.groupBy(*KEY, "island").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.min_by("kind", F.struct("start", order)).alias("kind"))
    cuts = islands.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("a", "b", "kind"))).alias(cuts_of))
    cuts = cuts.select(F.col("d").alias(cut_d), F.col("absent").alias(cut_absent), F.col("th").alias(cut_th), cuts_of)
    text = text_of()
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == F.col(cut_d)) & (F.col("doc_id").isNull() == F.col(cut_absent)) & (F.xxhash64(text) == F.col(cut_th))
    c = F.col(cuts_of)
    piece = F.transform(c, lambda x, i: F.concat(_slice(text, F.coalesce(F.get(c, i - 1)["b"], F.lit(0)), x["a"]), F.lit("<"), x["kind"], F.lit(">")))
    clean = F.concat(F.array_join(piece, ""), _slice(text, F.get(c, F.size(c) - 1)["b"], F.length(text)))
    out = docs.join(cuts, same, "left").withColumn("text", F.when(c.isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(c.isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _slice(text: Column, a: Column, b: Column) -> Column:
    return F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
