"""Quality rules with adaptive thresholds; DataFrame functions only.

Each document gets integer metrics.  Every (lang, source) keeps a quantile sketch of each metric:
counts of documents by bin, where a bin holds the values that agree in their five leading binary
digits after the first, so a quantile is found to within one part in 32.  Sketches merge by adding counts: those of a
language are the sums of its sources', and those of the corpus the sums of the languages'.
A group takes the thresholds of the smallest of (lang, source), lang, corpus that has at least
``LEAST`` documents.  The thresholds are far fences: a value is out if it lies more than
``REACH`` interquartile ranges (and at least a floor) beyond the quartiles, so a homogeneous
group rejects nothing.  They are joined to the documents, which are then filtered.

Skew: counts are pre-aggregated before the shuffle, so a hot source sends one row for each task and
bin.  The join's thresholds side has one row for each (lang, source); it is broadcast where it has
at most ``BROADCAST_GROUPS`` rows, else Spark joins by the group (AQE splits skewed partitions).

Defined results: null or empty text has no words and is base_failed; null lang or source is a group
of its own; repeated rows are judged one by one; with an empty table the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomap.llm._spark import col, written

#: What judge() adds.
MADE = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
LEAST = 200
REACH = 6
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
BROADCAST_GROUPS = 10_000
#: metric: (expression over the base counts, width in its own unit that the fence has at least, lower fence too)
METRICS = {
    "word_len": ("100 * word_chars div nullif(n_words, 0)", 150, True),
    "symbols": ("1000 * n_symbols div nullif(word_chars, 0)", 50, False),
    "dup_lines": ("1000 * n_dup_lines div nullif(n_lines, 0)", 100, False),
    "repeats": ("1000 * n_repeat_words div nullif(n_words, 0)", 100, False),
}


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) to docs."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.regexp_replace(t, r"^[ \t-\r]+|[ \t-\r]+$", "")
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    out = docs.withColumns({"_words": words, "_lines": lines})
    w = F.col("_words")
    # the 3-word windows in order of their words, each with its place: equal ones are neighbours
    windows = F.sort_array(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("i"))))
    out = out.withColumn("_windows", windows)
    s = F.col("_windows")
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["w"] == x["w"]) | (F.get(s, i + 1)["w"] == x["w"]))
    places = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return out.select(
        *docs.columns,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(places).cast("long").alias("n_repeat_words"),
    )


def floor_of_bin(x: Column) -> Column:
    """The least value of the bin of x >= 0."""
    drop = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bin, n: one mergeable sketch for each lang, source and metric."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(e).alias("value")) for m, (e, _, _) in METRICS.items()]))
    rows = measured.where("not base_failed").select("lang", "source", pairs.alias("p")).where("p.value is not null")
    return rows.groupBy("lang", "source", F.col("p.metric").alias("metric"), floor_of_bin(F.col("p.value")).alias("bin")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, size, q1, q3 of the merged sketches; a quartile is the bin that holds the ceil(q * size)-th value."""
    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "size": F.sum("n").over(by)})
    return ranked.groupBy(*keys, "metric").agg(
        F.first("size").alias("size"),
        F.min(F.when(4 * F.col("upto") >= F.col("size"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("size"), F.col("bin"))).alias("q3"),
    )


def thresholds(sketch: DataFrame, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """One row for each lang and source: lo_<metric>, hi_<metric> (long; null: none)."""
    groups = sketch.select("lang", "source").distinct()
    level = {"a": ["lang", "source"], "b": ["lang"], "c": []}
    wide = groups
    for k, keys in level.items():
        q = quartiles(sketch, keys).withColumn("width", F.greatest(reach * (F.col("q3") - F.col("q1")), _floors()))
        row = q.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.struct("size", (F.col("q1") - F.col("width")).alias("lo"), (F.col("q3") + F.col("width")).alias("hi")))).alias(f"{k}_{m}") for m in METRICS])
        row = row.withColumnsRenamed({x: f"_{x}" for x in keys})
        on = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in keys]
        wide = wide.join(row, on, "left").drop(*[f"_{x}" for x in keys]) if keys else wide.join(F.broadcast(row), how="left")
    out = []
    for m, (_, _, lower) in METRICS.items():
        best = F.coalesce(*[F.when(F.col(f"{k}_{m}.size") >= least, F.col(f"{k}_{m}")) for k in "ab"], F.col(f"c_{m}"))
        out += [(best["lo"] if lower else F.lit(None).cast("long")).alias(f"lo_{m}"), best["hi"].alias(f"hi_{m}")]
    return wide.select("lang", "source", *out)


def _floors() -> Column:
    return F.create_map(*[x for m, (_, floor, _) in METRICS.items() for x in (F.lit(m), F.lit(floor))])[F.col("metric")].cast("long")


def judge(docs: DataFrame, carry: list[str] | None = None, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """The columns to carry (default: all of docs), the base counts, base_failed and kept; docs needs lang, source and text.

    Columns of docs that have a name of these results are replaced.  The counts are written once
    with what is carried, as the sketches and the verdict both need them.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in MADE]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    # what is carried goes along in one struct, so that it clashes with no name used here
    needed = docs.select(F.struct(*[col(c) for c in carry]).alias("_row"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    counted = base_counts(needed).drop("text")
    measured = written(counted).withColumn("base_failed", failed)
    bounds = thresholds(sketches(measured), least, reach).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    few = measured.select("lang", "source").distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = measured.join(F.broadcast(bounds) if few else bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m, (e, _, lower) in METRICS.items():
        inside &= F.coalesce(F.expr(e) <= F.col(f"hi_{m}"), F.lit(True))
        if lower:
            inside &= F.coalesce(F.expr(e) >= F.col(f"lo_{m}"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).select("_row.*", *MADE)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of docs."""
    whole = docs.select("text", "lang", "source", F.struct(*[col(c) for c in docs.columns]).alias("_whole"))
    return judge(whole, carry=["_whole"]).where("kept").select("_whole.*")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls
  FROM documents
), places AS (
  SELECT doc_id, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) > 2
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM places
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE c > 1) GROUP BY doc_id
), base AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS word_len,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars END AS symbols,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END AS dup_lines,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END AS repeats
  FROM base
), long AS (
  SELECT lang, source, metric, value FROM (SELECT lang, source, word_len, symbols, dup_lines, repeats FROM judged WHERE NOT base_failed)
  UNPIVOT (value FOR metric IN (word_len, symbols, dup_lines, repeats))
), sketch AS (
  SELECT lang, source, metric, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bin, count(*) AS n
  FROM long GROUP BY ALL
), levels AS (
  SELECT 'a' AS level, lang, source, metric, bin, n FROM sketch
  UNION ALL SELECT 'b', lang, NULL, metric, bin, sum(n) FROM sketch GROUP BY lang, metric, bin
  UNION ALL SELECT 'c', NULL, NULL, metric, bin, sum(n) FROM sketch GROUP BY metric, bin
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS size FROM levels
), quart AS (
  SELECT level, lang, source, metric, any_value(size) AS size, min(bin) FILTER (4 * upto >= size) AS q1, min(bin) FILTER (4 * upto >= 3 * size) AS q3
  FROM ranked GROUP BY ALL
), fence AS (
  SELECT *, q1 - greatest(6 * (q3 - q1), CASE metric WHEN 'word_len' THEN 150 WHEN 'symbols' THEN 50 ELSE 100 END) AS lo,
    q3 + greatest(6 * (q3 - q1), CASE metric WHEN 'word_len' THEN 150 WHEN 'symbols' THEN 50 ELSE 100 END) AS hi FROM quart
), pairs AS (
  SELECT doc_id, lang, source, metric, value FROM judged UNPIVOT (value FOR metric IN (word_len, symbols, dup_lines, repeats)) WHERE NOT base_failed
), out_of AS (
  SELECT DISTINCT p.doc_id FROM pairs p
  LEFT JOIN fence a ON a.level = 'a' AND a.metric = p.metric AND a.lang IS NOT DISTINCT FROM p.lang AND a.source IS NOT DISTINCT FROM p.source AND a.size >= 200
  LEFT JOIN fence b ON b.level = 'b' AND b.metric = p.metric AND b.lang IS NOT DISTINCT FROM p.lang AND b.size >= 200
  LEFT JOIN fence c ON c.level = 'c' AND c.metric = p.metric
  WHERE p.value > coalesce(a.hi, b.hi, c.hi) OR (p.metric = 'word_len' AND p.value < coalesce(a.lo, b.lo, c.lo))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM out_of) AS kept
FROM judged
"""
