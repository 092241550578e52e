"""Blocked evaluation equals a single pass."""

from pyspark.sql import functions as F

from barwave.operators import indicators as ind
from barwave.operators import pivots as pv
from barwave.operators.joins import asof_join, first_hit, range_join
from barwave.operators.series import fold_series, framed, running_sum, with_bar_index
from tests.conftest import make_bars, rows, walk


def zigzag_by_hand(highs, lows, dev):
    up, ext, at, out = False, None, None, []
    for i, (h, l) in enumerate(zip(highs, lows)):
        if ext is None:
            ext, at = (l if up else h), i
        elif up and h >= ext:
            ext, at = h, i
        elif up and l <= ext * (1 - dev * 0.01):
            out.append((at, ext, True))
            up, ext, at = False, l, i
        elif not up and l <= ext:
            ext, at = l, i
        elif not up and h >= ext * (1 + dev * 0.01):
            out.append((at, ext, False))
            up, ext, at = True, h, i
    return out + [(at, ext, up)]


def test_zigzag_blocks_equal_single_pass(spark):
    bars = make_bars(spark, walk(900))
    pdf = bars.orderBy("bar_index").toPandas()
    want = sorted(zigzag_by_hand(pdf.high, pdf.low, 0.4))
    for block in (50, 128, 4096):
        got = pv.zigzag_pct(bars, 0.4, block=block)
        assert rows(got, "bar_index", "value", "is_high") == want


def test_fold_repairs_wrong_guesses(spark):
    # a flat tail longer than any warm-up keeps the state of the far past
    closes = [1000.0, 1100.0] + [1098.0] * 700
    bars = make_bars(spark, closes, spread=0.1)
    pdf = bars.orderBy("bar_index").toPandas()
    got = pv.zigzag_pct(bars, 5.0, block=40)
    assert rows(got, "bar_index", "value", "is_high") == sorted(zigzag_by_hand(pdf.high, pdf.low, 5.0))


def test_recurrences_do_not_depend_on_blocks(spark):
    bars = ind.atr(make_bars(spark, walk(700, seed=3)), 10)
    for fold in (ind.ema_fold(14), ind.rsi_fold(14), ind.supertrend_fold()):
        one, _ = fold_series(bars, fold, block=4096)
        many, _ = fold_series(bars, fold, block=100)
        cols = [c for c in one.columns if c not in ("symbol", "tf")]
        a = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(one, *cols)]
        b = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(many, *cols)]
        assert a == b


def test_framed_windows_do_not_depend_on_blocks(spark):
    bars = make_bars(spark, walk(500))
    one = framed(bars, 21, 0, *ind.bollinger_stages(20))
    many = framed(bars, 21, 0, *ind.bollinger_stages(20), block=64)
    assert rows(one, "bar_index", "bb_top") == rows(many, "bar_index", "bb_top")


def test_fractals_match_a_plain_scan(spark):
    bars = make_bars(spark, walk(300, seed=11))
    pdf = bars.orderBy("bar_index").toPandas()
    p, last, want = 4, 0, []
    for last_bar in range(2 * p, len(pdf)):
        i = last_bar - p
        span = [j for j in range(max(i - p, last), i + p) if j != i]
        hi = all(pdf.high[j] <= pdf.high[i] for j in span)
        lo = all(pdf.low[j] >= pdf.low[i] for j in span)
        if hi or lo:
            want.append((i, hi, lo))
            last = i
    assert rows(pv.fractal_pivots(bars, p), "bar_index", "is_high", "is_low") == want


def test_running_sum_and_dense_index(spark):
    bars = make_bars(spark, walk(200))
    total = running_sum(bars.withColumn("one", F.lit(1)), "one", "n", block=16)
    assert rows(total, "bar_index", "n") == [(i, i + 1) for i in range(200)]
    again = with_bar_index(bars.drop("bar_index"))
    assert rows(again, "bar_index", "close") == rows(bars, "bar_index", "close")


def test_range_join_and_first_hit_match_brute_force(spark):
    bars = make_bars(spark, walk(400, seed=5))
    pdf = bars.orderBy("bar_index").toPandas()
    iv = spark.createDataFrame([("T", "h1", 3, 290), ("T", "h1", 255, 257), ("T", "h1", 9, 8)], "symbol string, tf string, start_bar long, end_bar long")
    got = range_join(iv, bars.select("symbol", "tf", "bar_index", "high"), block=32).groupBy("start_bar").agg(F.count("*"), F.max("high"))
    assert rows(got, *got.columns) == [(3, 288, max(pdf.high[3:291])), (255, 3, max(pdf.high[255:258]))]
    cand = bars.select("symbol", "tf", F.col("bar_index").alias("i"), (F.col("close") + 4).alias("lv"))
    hit = first_hit(cand, bars.select("symbol", "tf", "bar_index", "high"), ["symbol", "tf", "i"], "i", [F.min(F.when(F.col("high") >= F.col("lv"), F.col("bar_index"))).alias("at")], F.col("at").isNotNull(), horizons=(8, 64))
    want = [(i, next((j for j in range(i + 1, 400) if pdf.high[j] >= pdf.close[i] + 4), -1)) for i in range(400)]
    assert rows(hit.withColumn("at", F.coalesce("at", F.lit(-1))), "i", "at") == want


def test_asof_join_across_buckets(spark):
    bars = make_bars(spark, walk(100))
    q = bars.where("bar_index % 30 = 7").select("symbol", F.col("open_time").alias("t"), F.col("bar_index").alias("src"))
    got = asof_join(bars.select("symbol", "bar_index", "open_time"), q, ["symbol"], "open_time", ["src"], right_on="t", bucket_seconds=7200)
    want = [(i, max([j for j in range(7, i + 1, 30)], default=-1)) for i in range(100)]
    assert rows(got.withColumn("src", F.coalesce("src", F.lit(-1))), "bar_index", "src") == want
    nxt = asof_join(bars.select("symbol", "bar_index", "open_time"), q, ["symbol"], "open_time", ["src"], direction="forward", right_on="t", bucket_seconds=7200, strict=True)
    want = [(i, min([j for j in range(7, 100, 30) if j > i], default=-1)) for i in range(100)]
    assert rows(nxt.withColumn("src", F.coalesce("src", F.lit(-1))), "bar_index", "src") == want
