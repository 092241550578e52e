"""Quality rules whose limits come from quantile sketches of each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwave.llm.common import WORD, broadcast_if_small, cut, let

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_DOCS = 100

#: measure -> (numerator, denominator, scale, smallest spread, fences' width in spreads, is there a lower fence)
RULES = {
    "symbols": ("n_symbols", "n_words", 1000, 40, 6, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 90, 6, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 60, 6, False),
    "word_length": ("word_chars", "n_words", 100, 60, 6, True),
}


def repeated_words(words: Column) -> Column:
    """Words inside a run of three words that the array holds twice or more, the first one included.

    The runs' hashes (64 bits) are sorted with their places; a run is repeated if a neighbour has its hash. Each array is
    computed once a row, so a text of n words takes n log n steps.
    """
    n = F.size(words)
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(n - (WINDOW - 1), F.lit(0)))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(by_hash: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = F.filter(by_hash, lambda x, i: same(x, F.get(by_hash, i + 1)) | same(x, F.get(by_hash, i - 1)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(hs: Column) -> Column:
        tagged = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(tagged, repeated))

    return let(hashes, count)


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` of whole texts (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    counted = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words")),
    )
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        "doc_id",
        "lang",
        "source",
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        counted.alias("c"),
        lined.alias("l"),
    ).select("doc_id", "lang", "source", "c.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "c.n_repeat_words", "l.n_lines")


def bin_of(value: Column) -> Column:
    """Log-linear bin of a whole number: exact below 64, then 32 bins to each doubling (off by 1/32 at most)."""
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(32 * shift + F.call_function("shiftright", value, shift)).cast("int")


def bin_start(b: Column) -> Column:
    """Smallest value of a bin."""
    shift = F.floor(b / 32).cast("int") - 1
    return F.when(b < 64, b.cast("long")).otherwise(F.call_function("shiftleft", (b - 32 * shift).cast("long"), shift))


def sketches(measured: DataFrame) -> DataFrame:
    """Counts by bin of each measure for each language and source. Sketches merge by adding counts, in any order."""
    ratio = [
        F.struct(F.lit(name).alias("measure"), F.floor(F.try_divide(F.col(num) * scale, F.col(den))).cast("long").alias("value"))
        for name, (num, den, scale, *_) in RULES.items()
    ]
    each = measured.select("lang", "source", F.explode(F.array(*ratio)).alias("m")).select("lang", "source", "m.*").filter(F.col("value").isNotNull())
    return each.groupBy("lang", "source", "measure", bin_of(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``n, q25, q50, q75`` of each key and measure of a sketch."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    at = lambda k: bin_start(F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bin"))))
    return ranked.groupBy(*keys, "measure").agg(F.max("all").alias("n"), at(1).alias("q25"), at(2).alias("q50"), at(3).alias("q75"))


def limits(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Fences ``<measure>_low, <measure>_high`` of each language and source.

    With fewer than ``min_docs`` documents a group takes the merged sketch of its language, and with fewer there too that of
    all. Fences stand ``width`` spreads outside the quartiles; a spread is the distance between them, or the rule's least.
    """
    fine = quartiles(sketch, ["lang", "source"])
    mid = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.struct("n", "q25", "q75").alias("mid"))
    top = quartiles(sketch, []).select(F.col("measure").alias("t"), F.struct("n", "q25", "q75").alias("top"))
    both = fine.join(F.broadcast(top), F.col("measure") == F.col("t")).join(mid, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m")))
    own = F.struct("n", "q25", "q75")
    q = F.when(F.col("n") >= min_docs, own).when(F.col("mid.n") >= min_docs, F.col("mid")).otherwise(F.col("top"))
    spread = lambda s: F.greatest(F.col("q.q75") - F.col("q.q25"), F.lit(s))
    fences = []
    for name, (*_, least, width, lower) in RULES.items():
        mine = F.col("measure") == name
        fences.append(F.max(F.when(mine, F.col("q.q75") + width * spread(least))).alias(f"{name}_high"))
        if lower:
            fences.append(F.max(F.when(mine, F.col("q.q25") - width * spread(least))).alias(f"{name}_low"))
    return both.select("lang", "source", "measure", q.alias("q")).groupBy("lang", "source").agg(*fences)


def judge(measured: DataFrame, min_docs: int = MIN_DOCS, least_words: int = 50, most_repeated: float = 0.5) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to the columns of ``measures``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeated`` of them in repeated runs. ``kept``: not that, and
    each measure within the fences of its language and source. Null languages and sources are values of their own. A text
    without words has no measures and fails. Every row gets one row back; extra columns are dropped by ``measures``.
    """
    rows = cut(measured)
    fences = cut(limits(sketches(rows), min_docs)).withColumnRenamed("lang", "f_lang").withColumnRenamed("source", "f_source")
    # a struct key joins null with null by hash
    key = lambda a, b: F.concat_ws("|", F.coalesce(F.concat(F.lit("="), a), F.lit("-")), F.coalesce(F.concat(F.lit("="), b), F.lit("-")))
    joined = rows.withColumn("k", key("lang", "source")).join(broadcast_if_small(fences.withColumn("k", key("f_lang", "f_source"))), "k", "left")
    inside = F.lit(True)
    for name, (num, den, scale, _, _, lower) in RULES.items():
        value = F.floor(F.try_divide(F.col(num) * scale, F.col(den)))
        inside &= F.coalesce(value <= F.col(f"{name}_high"), F.lit(True))
        if lower:
            inside &= F.coalesce(value >= F.col(f"{name}_low"), F.lit(True))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside).select(*measured.columns, "base_failed", "kept")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
  g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
  p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM g) WHERE n > 1),
  r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM p) GROUP BY doc_id),
  m AS (SELECT t.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM t LEFT JOIN r ON t.doc_id = r.doc_id),
  v AS (SELECT lang, source, 'symbols' AS measure, n_symbols * 1000 // n_words AS v FROM m WHERE n_words > 0
    UNION ALL SELECT lang, source, 'dup_lines', n_dup_lines * 1000 // n_lines FROM m WHERE n_lines > 0
    UNION ALL SELECT lang, source, 'repeats', n_repeat_words * 1000 // n_words FROM m WHERE n_words > 0
    UNION ALL SELECT lang, source, 'word_length', word_chars * 100 // n_words FROM m WHERE n_words > 0),
  b AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS v FROM v),
  q AS (SELECT lang, source, measure, count(*) AS n, quantile_disc(v, 0.25) AS q25, quantile_disc(v, 0.75) AS q75,
      GROUPING(source) AS no_source, GROUPING(lang) AS no_lang FROM b GROUP BY GROUPING SETS ((lang, source, measure), (lang, measure), (measure))),
  c AS (SELECT f.lang, f.source, f.measure,
      CASE WHEN f.n >= 100 THEN f.q25 WHEN l.n >= 100 THEN l.q25 ELSE a.q25 END AS q25, CASE WHEN f.n >= 100 THEN f.q75 WHEN l.n >= 100 THEN l.q75 ELSE a.q75 END AS q75
    FROM q f JOIN q l ON l.no_source = 1 AND l.no_lang = 0 AND f.lang IS NOT DISTINCT FROM l.lang AND f.measure = l.measure
      JOIN q a ON a.no_lang = 1 AND a.measure = f.measure WHERE f.no_source = 0),
  h AS (SELECT lang, source, measure, q25 - 6 * s AS low, q75 + 6 * s AS high
    FROM (SELECT *, greatest(q75 - q25, CASE measure WHEN 'symbols' THEN 40 WHEN 'dup_lines' THEN 90 ELSE 60 END) AS s FROM c)),
  w AS (SELECT lang, source, max(high) FILTER (measure = 'symbols') AS s, max(high) FILTER (measure = 'dup_lines') AS d, max(high) FILTER (measure = 'repeats') AS r,
      max(high) FILTER (measure = 'word_length') AS wh, max(low) FILTER (measure = 'word_length') AS wl FROM h GROUP BY lang, source),
  j AS (SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, w.s, w.d, w.r, w.wh, w.wl
    FROM m LEFT JOIN w ON m.lang IS NOT DISTINCT FROM w.lang AND m.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(n_symbols * 1000 // n_words <= s, true) AND coalesce(n_dup_lines * 1000 // n_lines <= d, true)
    AND coalesce(n_repeat_words * 1000 // n_words <= r, true) AND coalesce(word_chars * 100 // n_words BETWEEN wl AND wh, true) AS kept
FROM j
"""
