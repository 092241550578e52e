"""Elliott-wave rules, scores and set-based candidate search.

A candidate with n waves has points p0..pn (prices) and b0..bn (bars), lengths w1..wn and direction
s = +1/-1.  Rules are SQL predicates that name the *fatal* condition at the wave where it can first
be seen, so a search can drop a prefix as soon as it fails.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwave.functions.fib import fib_range, weight_text
from barwave.functions.wave_tables import COEFFICIENT, GRAMMAR, POSITION_PROBABILITY, RATIOS, START_MODELS
from barwave.operators.joins import first_hit, range_join
from barwave.operators.pivots import with_pivot_seq
from barwave.operators.series import KEY, Fold, fold_series, framed
from barwave.session import cut

MODELS = tuple(GRAMMAR)
MAX_SPAN = 17
WAVES = {m: len(g) for m, g in GRAMMAR.items()}
FIVE = tuple(m for m in MODELS if WAVES[m] == 5)
THREE = tuple(m for m in MODELS if WAVES[m] == 3)
DIAGONALS = ("DIAGONAL_CONTRACTING_INITIAL", "DIAGONAL_CONTRACTING_ENDING")
TRIANGLES = ("TRIANGLE_CONTRACTING", "TRIANGLE_RUNNING")

_DIAG = {
    2: "s * (p2 - p0) < 0",
    3: "s * (p3 - p1) < 0.05 * w1 OR w3 >= w1",
    4: "w4 >= w2",
    5: "w5 >= w3",
}
_ZZ = {2: "s * (p2 - p0) < 0", 3: "s * (p3 - p1) < 0"}
# fatal price conditions per model and wave
PRICE_RULES: dict[str, dict[int, str]] = {
    "IMPULSE": {
        2: "s * (p2 - p0) < 0",
        3: "s * (p3 - p1) < 0",
        4: "s * (p4 - p0) < 0 OR s * (p4 - p1) < 0",
        5: "(w3 < w1 AND w3 < w5) OR s * (p5 - p4) < 0 OR s * (p5 - p3) < 0",
    },
    "DIAGONAL_CONTRACTING_INITIAL": {**_DIAG, 5: "w5 >= w3 OR s * (p5 - p3) < 0.05 * w3"},
    "DIAGONAL_CONTRACTING_ENDING": _DIAG,
    "ZIGZAG": _ZZ,
    "DOUBLE_ZIGZAG": _ZZ,
    "TRIPLE_ZIGZAG": _ZZ,
    "FLAT_EXTENDED": {2: "s * (p2 - p0) > 0", 3: "s * (p3 - p1) < 0 OR s * (p3 - p0) < 0"},
    "FLAT_RUNNING": {2: "s * (p2 - p0) > 0", 3: "s * (p0 - p3) < 0.382 * w1 OR s * (p3 - p0) < 0"},
    "FLAT_REGULAR": {2: "s * (p2 - p0) < 0 OR w2 < 0.9 * w1", 3: "s * (p3 - p0) < 0"},
    "TRIANGLE_CONTRACTING": {
        2: "s * (p2 - p0) < 0",
        3: "w3 >= w1 OR s * (p3 - p1) > 0",
        4: "w4 >= w2 OR s * (p4 - p2) < 0",
        5: "w5 >= w3 OR s * (p5 - p3) > 0 OR s * (p5 - p0) < 0",
    },
    "TRIANGLE_RUNNING": {
        2: "s * (p2 - p0) > 0",
        3: "s * (p3 - p1) > 0",
        4: "w4 >= w2 OR s * (p4 - p2) < 0",
        5: "w5 >= w3 OR s * (p5 - p3) > 0 OR s * (p5 - p0) < 0",
    },
}
_W31 = "(b3 - b2) < 0.3 * (b1 - b0) OR (b3 - b2) > 3.0 * (b1 - b0)"
# fatal time conditions per model and wave
TIME_RULES: dict[str, dict[int, str]] = {
    "IMPULSE": {4: "(b4 - b3) < 0.3 * (b2 - b1) OR (b4 - b3) > 3.0 * (b2 - b1)"},
    "ZIGZAG": {3: _W31},
    "DOUBLE_ZIGZAG": {3: _W31},
    "TRIPLE_ZIGZAG": {3: _W31},
}


def ratio_rule(model: str) -> str:
    """Fatal when any leg ratio leaves its map."""
    out = ["w1 <= 0"]
    for name, leg, ref in RATIOS[model]:
        lo, hi = fib_range(name)
        out.append(f"w{leg} / w{ref} < CAST({lo!r} AS DOUBLE) OR w{leg} / w{ref} > CAST({hi!r} AS DOUBLE)")
    return " OR ".join(out)


def stage_reason(model: str, wave: int) -> str:
    """SQL text: why a prefix of ``wave`` waves dies, else NULL (price, then ratio when complete, then time)."""
    parts = []
    if wave in PRICE_RULES[model]:
        parts.append(f"WHEN {PRICE_RULES[model][wave]} THEN 'PRICE_BREACH'")
    if wave == WAVES[model]:
        parts.append(f"WHEN {ratio_rule(model)} THEN 'RATIO_OUT_OF_RANGE'")
    if wave in TIME_RULES.get(model, {}):
        parts.append(f"WHEN {TIME_RULES[model][wave]} THEN 'TIME_WINDOW'")
    return f"CASE {' '.join(parts)} END" if parts else "CAST(NULL AS STRING)"


def reason_text(model: str) -> str:
    """First reason over all waves, as met when waves are added one by one."""
    return "coalesce(" + ", ".join(stage_reason(model, w) for w in range(2, WAVES[model] + 1)) + ")"


def model_case(pick, models=MODELS) -> Column:
    return F.expr("CASE model " + " ".join(f"WHEN '{m}' THEN {pick(m)}" for m in models) + " END")


# ---- scores ------------------------------------------------------------------------------------


def _len(i: int) -> Column:
    return F.col(f"w{i}")


def _span(i: int) -> Column:
    return F.col(f"b{i}") - F.col(f"b{i - 1}")


def _geo(parts: list[Column]) -> Column:
    if not parts:
        return F.lit(1.0)
    product = parts[0]
    for p in parts[1:]:
        product = product * p
    return F.pow(product, F.lit(1.0 / len(parts)))


def _per_model(fn, models=MODELS) -> Column:
    out = None
    for m in models:
        v = fn(m)
        out = F.when(F.col("model") == m, v) if out is None else out.when(F.col("model") == m, v)
    return out


def fib_score(models=MODELS) -> Column:
    """Geometric mean of the weights of the model's leg ratios."""
    return _per_model(lambda m: _geo([F.expr(weight_text(n, f"(w{a} / w{b})")) for n, a, b in RATIOS[m]]), models)


def overshoot_penalty(models=MODELS) -> Column:
    """1 up to a retracement of 0.9, falling to 0.7 at 1.3; geometric mean over the counter-waves."""

    def factor(r: Column) -> Column:
        return F.when(r <= 0.9, 1.0).when(r >= 1.3, 0.7).otherwise(1.0 - 0.3 * ((r - 0.9) / (1.3 - 0.9)))

    def of(m):
        skip_b = m.startswith("FLAT") or m == "TRIANGLE_RUNNING"
        waves = [i for i in range(2, WAVES[m] + 1, 2) if not (skip_b and i == 2)]
        return _geo([factor(_len(i) / _len(i - 1)) for i in waves])

    return _per_model(of, models)


PAIRS = {"IMPULSE": ((1, 2), (3, 4)), "ZIGZAG": ((1, 2),), "DOUBLE_ZIGZAG": ((1, 2),), "TRIPLE_ZIGZAG": ((1, 2), (3, 4))}


def time_penalty(models=MODELS) -> Column:
    """1 while the correction lasts as long as its impulse, falling to 0.6 at 0.3 of it."""

    def factor(r: Column) -> Column:
        t = F.greatest(F.least((r - 0.3) / 0.7, F.lit(1.0)), F.lit(0.0))
        return F.when(r >= 1.0, 1.0).otherwise(0.6 + 0.4 * t)

    return _per_model(lambda m: _geo([factor(_span(c) / _span(i)) for i, c in PAIRS.get(m, ())]), models)


def trendline_penalty(models=MODELS) -> Column:
    """1 while the last wave ends between the two extrapolated lines, down to 0.7 one channel width outside."""

    def line(i: int, j: int) -> Column:
        slope = (F.col(f"p{j}") - F.col(f"p{i}")) / (F.col(f"b{j}") - F.col(f"b{i}"))
        return F.col(f"p{j}") + slope * (F.col("b5") - F.col(f"b{j}"))

    def of(m):
        if m not in DIAGONALS + TRIANGLES:
            return F.lit(1.0)
        a, b = line(1, 3), line(2, 4)
        hi, lo = F.greatest(a, b), F.least(a, b)
        width = hi - lo
        out = F.greatest(lo - F.col("p5"), F.col("p5") - hi)
        return F.when((width <= 0) | (out <= 0), 1.0).otherwise(0.7 + 0.3 * (1.0 - F.least(out / F.nullif(width, F.lit(0.0)), F.lit(1.0))))

    return _per_model(of, models)


def structural_score(models=MODELS) -> Column:
    return fib_score(models) * overshoot_penalty(models) * time_penalty(models) * trendline_penalty(models)


# detection coefficients of the older scoring
V1_COEF = {**COEFFICIENT, "DIAGONAL_CONTRACTING_INITIAL": 1.3, "DIAGONAL_CONTRACTING_ENDING": 1.3, "TRIANGLE_CONTRACTING": 2.0, "TRIANGLE_RUNNING": 2.0}
_CORRECTIVE = {"IMPULSE": (2, 4), **{m: (2, 4) for m in DIAGONALS}, **{m: (2, 3, 4, 5) for m in TRIANGLES}, "TRIPLE_ZIGZAG": ()}


def duration_penalty_v1() -> Column:
    """W4 over 1.5 x W2, or W2 over 1.1 x W4 bars: 1 - half the excess, at least 0.1 each."""
    w2, w4 = _span(2), _span(4)

    def cost(r: Column, limit: float) -> Column:
        return F.when(r > limit, F.greatest(F.lit(0.1), 1.0 - (r / limit - 1.0) * 0.5)).otherwise(1.0)

    return cost(w4 / w2, 1.5) * cost(w2 / w4, 1.1)


def bar_count_bonus_v1(models=MODELS) -> Column:
    def of(m):
        idx = _CORRECTIVE.get(m, (2,))
        if not idx:
            return F.lit(1.0)
        total = F.greatest(F.col(f"b{WAVES[m]}") - F.col("b0"), F.lit(1))
        share = sum((F.greatest(_span(i), F.lit(1)) / total for i in idx[1:]), F.greatest(_span(idx[0]), F.lit(1)) / total)
        return 1.0 + 0.3 * (share / len(idx))

    return _per_model(of, models)


def fib_score_v1(models=MODELS) -> Column:
    """Coefficient x geometric mean x (1 + 0.15 log2(n + 1)) x bar bonus; 0.3 for a truncated fifth wave."""
    log2 = {2: 1.584962500721156, 3: 2.0, 4: 2.321928094887362, 5: 2.584962500721156}

    def of(m):
        parts = [F.expr(weight_text(n, f"(w{a} / w{b})")) for n, a, b in RATIOS[m]]
        product = parts[0]
        for p in parts[1:]:
            product = product * p
        n = len(parts)
        plain = F.pow(product, F.lit(1.0 / n)) * (1.0 + log2[n] * 0.15)
        if m == "IMPULSE" or m in DIAGONALS:
            pen = duration_penalty_v1()
            late = F.pow(product * pen, F.lit(1.0 / (n + 1))) * (1.0 + log2[n + 1] * 0.15)
            plain = F.when(pen < 1.0, late).otherwise(plain)
        out = F.lit(V1_COEF[m]) * plain
        if m == "IMPULSE":
            out = out * F.when(F.col("s") * (F.col("p5") - F.col("p3")) < 0, 0.3).otherwise(1.0)
        return out

    return _per_model(of, models) * bar_count_bonus_v1(models)


# ---- candidates of single legs ------------------------------------------------------------------


def _lengths(n: int) -> dict[str, Column]:
    return {f"w{i}": F.abs(F.col(f"p{i}") - F.col(f"p{i - 1}")) for i in range(1, n + 1)}


def leg_windows(pivots: DataFrame, n: int) -> DataFrame:
    """Every n consecutive legs as p0..pn, b0..bn with lengths and direction."""

    def stage(w):
        out = {}
        for i in range(n + 1):
            out[f"p{i}"] = F.lead("value", i).over(w) if i else F.col("value")
            out[f"b{i}"] = F.lead("bar_index", i).over(w) if i else F.col("bar_index")
        return out

    p = framed(with_pivot_seq(pivots), 0, n, stage, order="seq").where(F.col(f"b{n}").isNotNull())
    p = p.select(*KEY, "seq", *[f"p{i}" for i in range(n + 1)], *[f"b{i}" for i in range(n + 1)])
    return p.withColumns(_lengths(n)).withColumn("s", F.when(F.col("p1") > F.col("p0"), 1.0).otherwise(-1.0))


def flat_candidates(pivots: DataFrame, n: int) -> DataFrame:
    """Every n-wave model on every n consecutive legs, with the first reason it dies (null = it stands)."""
    models = FIVE if n == 5 else THREE
    c = leg_windows(pivots, n).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return c.withColumn("reason", model_case(reason_text, models))


def death_funnel(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy(*KEY, "model", F.coalesce("reason", F.lit("NONE")).alias("reason")).agg(F.count("*").alias("n"))


BEAM_WIDTH, PER_MODEL = 20, 3
READING = 1000  # a reading's code: rank of the model times this, plus its rank among the model's readings


def beam_topk(cands: DataFrame, by: list[str], width: int = BEAM_WIDTH, per_model: int = PER_MODEL, by_score: tuple[str, ...] = ()) -> DataFrame:
    """At least ``per_model`` of each model, the rest of ``width`` by score; ties by model, start, end. ``by_score`` names other sort columns."""
    order = list(by_score) or [F.col("score").desc(), "model_rank", "start_seq", "end_seq"]
    ranked = cands.withColumn("_m", F.row_number().over(Window.partitionBy(*by, "model").orderBy(*order)))
    ranked = ranked.withColumn("_first", F.col("_m") <= per_model)
    kept = F.sum(F.col("_first").cast("int")).over(Window.partitionBy(*by))
    ranked = ranked.withColumn("_kept", kept)
    rest = F.row_number().over(Window.partitionBy(*by, "_first").orderBy(*order))
    return ranked.withColumn("_r", rest).where(F.col("_first") | (F.col("_r") <= width - F.col("_kept"))).drop("_m", "_first", "_kept", "_r")


# fixed values: models in the order that decides ties
MODEL_ORDER = (
    "IMPULSE", "DIAGONAL_CONTRACTING_INITIAL", "DIAGONAL_CONTRACTING_ENDING", "DIAGONAL_EXPANDING_INITIAL", "DIAGONAL_EXPANDING_ENDING",
    "TRIANGLE_CONTRACTING", "TRIANGLE_EXPANDING", "TRIANGLE_RUNNING", "ZIGZAG", "DOUBLE_ZIGZAG", "TRIPLE_ZIGZAG", "FLAT_REGULAR",
    "FLAT_EXTENDED", "FLAT_RUNNING", "COMBINATION", "SIMPLE_IMPULSE",
)


def model_rank() -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model")).cast("int")


def flat_wave_c(pivots: DataFrame) -> DataFrame:
    """Four-pivot extended and running flats."""
    c = leg_windows(pivots, 3)
    ba, ca = F.col("w2") / F.col("w1"), F.col("w3") / F.col("w1")
    s, p = F.col("s"), [F.col(f"p{i}") for i in range(4)]
    over = (s * (p[2] - p[0]) < 0) & (F.least("w1", "w2", "w3") > 0)
    b_ok = (ba >= 0.786 * 0.9) & (ba <= 1.618 * 1.1)
    strict = F.lit(False)
    for r in (0.618, 1.0, 1.618, 2.618):
        strict = strict | ((ca >= r / 1.1) & (ca <= r * 1.1))
    ext = over & (s * (p[3] - p[1]) > 0) & strict & b_ok
    run = over & (s * (p[0] - p[3]) >= 0.382 * F.col("w1") - 1e-9) & (s * (p[3] - p[0]) < 0) & b_ok & (ca <= 1.618 * 1.1)
    kinds = F.filter(F.array(F.when(ext, "FLAT_EXTENDED"), F.when(run, "FLAT_RUNNING")), lambda k: k.isNotNull())
    return c.select(*KEY, "seq", F.explode(kinds).alias("model"), ba.alias("b_to_a"), ca.alias("c_to_a"))


# ---- candidates over spans of 1..17 legs ---------------------------------------------------------


def wave_candidates(pivots: DataFrame, max_span: int = MAX_SPAN) -> DataFrame:
    """Every way to split up to ``max_span`` legs into waves of odd length that passes all rules.

    Each pivot carries the next ``max_span`` pivots in an array (one window, materialised); waves are then added by
    exploding their possible ends, and the rules of that wave drop prefixes at once.  No join and no
    shuffle follows the window.
    """
    reach = range(max_span + 1)

    def stage(w):
        nth = lambda c, i: F.lead(c, i).over(w) if i else F.col(c)
        return {
            "_v": F.array(*[nth("value", i) for i in reach]),
            "_b": F.array(*[nth("bar_index", i) for i in reach]),
        }

    p = cut(framed(with_pivot_seq(pivots), 0, max_span, stage, order="seq").select(*KEY, "seq", "_v", "_b"))
    return reduce(DataFrame.unionByName, [_splits(p, m, max_span) for m in MODELS])


def _splits(p: DataFrame, model: str, max_span: int) -> DataFrame:
    """Candidates of one model: a narrow chain whose generated code holds this model's rules only."""
    n = WAVES[model]
    at = lambda arr, e: F.element_at(F.col(arr), (e + 1).cast("int"))
    c = p.withColumns({"e0": F.lit(0), "p0": at("_v", F.lit(0)), "b0": at("_b", F.lit(0)), "model": F.lit(model)})
    for k in range(1, n + 1):
        # ends at odd distances while the array has pivots; wave k-1 has left room for one more step
        ends = F.sequence(F.col(f"e{k - 1}") + 1, F.lit(max_span - (n - k)), F.lit(2))
        c = c.select("*", F.explode(ends).alias(f"e{k}"))
        c = c.select("*", at("_v", F.col(f"e{k}")).alias(f"p{k}"), at("_b", F.col(f"e{k}")).alias(f"b{k}"))
        new = [F.abs(F.col(f"p{k}") - F.col(f"p{k - 1}")).alias(f"w{k}")]
        if k == 1:
            new.append(F.when(F.col("p1") > F.col("p0"), 1.0).otherwise(-1.0).alias("s"))
        alive = F.col(f"b{k}").isNotNull() if k == 1 else F.col(f"b{k}").isNotNull() & F.expr(stage_reason(model, k)).isNull()
        c = c.select("*", *new).where(alive)
    if model in ("ZIGZAG", "DOUBLE_ZIGZAG", "TRIPLE_ZIGZAG"):
        # the last wave must pass the extreme of the corrective wave before it
        a, b = F.col(f"e{n - 2}"), F.col(f"e{n - 1}")
        span = F.slice(F.col("_v"), (a + 1).cast("int"), (b - a + 1).cast("int"))
        extreme = F.when(F.col("s") > 0, F.array_max(span)).otherwise(F.array_min(span))
        c = c.where(F.col("s") * (F.col(f"p{n}") - extreme) >= 0)
    return c.select(
        *KEY, "model", F.col("seq").alias("start_seq"), (F.col("seq") + F.col(f"e{n}")).alias("end_seq"),
        F.array(*[(F.col("seq") + F.col(f"e{k}")).cast("long") for k in range(n + 1)]).alias("ends"),
        F.array(*[F.col(f"p{k}") for k in range(n + 1)]).alias("points"),
        F.array(*[F.col(f"b{k}").cast("long") for k in range(n + 1)]).alias("bars"), structural_score((model,)).alias("structural"),
    )


def position_table(spark) -> DataFrame:
    """(parent, pos, child, probability): calibrated, else the child's own coefficient."""
    rows = []
    for parent, waves in GRAMMAR.items():
        for i, (key, kids) in enumerate(waves.items(), 1):
            for child in (*kids, "SIMPLE_IMPULSE"):
                rows.append((parent, i, child, POSITION_PROBABILITY.get((parent, key, child), COEFFICIENT[child])))
    return spark.createDataFrame(rows, "model string, pos int, child string, prob double")


def _slots(spark) -> tuple[DataFrame, DataFrame, int]:
    """(model, pos, kind, probs): waves that take the same sub-models share a kind; (kind, child); the number of kinds. Fixed, about 50 and 60 rows."""
    kinds: dict[tuple[str, ...], int] = {}
    slots = []
    rank = {m: i for i, m in enumerate(MODEL_ORDER, 1)}
    for parent, waves in GRAMMAR.items():
        for i, (key, subs) in enumerate(waves.items(), 1):
            children = (*sorted(subs), "SIMPLE_IMPULSE")
            kind = kinds.setdefault(children, len(kinds))
            slots.append((parent, i, kind, {rank[c]: POSITION_PROBABILITY.get((parent, key, c), COEFFICIENT[c]) for c in children}))
    pairs = [(kind, c) for children, kind in kinds.items() for c in children]
    return spark.createDataFrame(slots, "model string, pos int, kind int, probs map<int,double>"), spark.createDataFrame(pairs, "kind int, child string"), len(kinds)


def relative_order(score: Column) -> Column:
    """Sort key, best first: scores that differ by less than a billionth part are tied."""
    return -F.round(F.ln(score), 9)


def nested_candidates(pivots: DataFrame, cands: DataFrame, max_span: int = MAX_SPAN, width: int = BEAM_WIDTH, per_model: int = PER_MODEL) -> DataFrame:
    """The best ``width`` ways to read every span as every model, each wave filled by any of the ranked ways to read it.

    A wave is offered the beam (``beam_topk``) of all its sub-models over its legs; the score of a reading is its structural
    score times score x position probability of each wave's reading. Every rule that a sub-model decides looks at one wave: the wave x of a
    double zigzag lasts at least 0.9 of the b inside a zigzag w. So such options go before waves are merged, and keeping ``width`` products after
    each wave loses none of the best. Scores within a billionth part are ties, ordered by where waves end and then by sub-model and rank.

    One pass per span length, shortest first: waves are shorter than their span, so a pass is one equi-join with the options
    found so far, one aggregate per split (three or five rows) and one ranking per span; every pass is written.
    """
    spark = pivots.sparkSession
    slots, takes, kinds = _slots(spark)
    slots, takes = F.broadcast(slots), F.broadcast(takes)
    legs = with_pivot_seq(pivots).select(*KEY, F.col("seq").alias("from_seq"), (F.col("seq") + 1).alias("to_seq"))
    last = legs.groupBy(*KEY).agg(F.max("from_seq").alias("_last"))
    leaf = F.array(F.struct(F.lit(READING * len(MODEL_ORDER) + 1).cast("int").alias("code"), F.lit(1.0).alias("score"), F.lit(None).cast("long").alias("b_bars")))
    single = legs.join(last, list(KEY)).where(F.col("from_seq") < F.col("_last")).drop("_last")
    options = cut(single.withColumns({"kind": F.explode(F.sequence(F.lit(0), F.lit(kinds - 1))), "options": leaf}))

    splits = cands.withColumn("span", F.col("end_seq") - F.col("start_seq"))
    found = None
    for span in range(3, max_span + 1, 2):
        here = splits.where(F.col("span") == span).drop("span")
        x_bars = F.when(F.col("model") == "DOUBLE_ZIGZAG", F.element_at("bars", 3) - F.element_at("bars", 2))
        waves = here.select(*KEY, "model", "ends", x_bars.alias("x_bars"), F.posexplode(F.slice("ends", F.lit(1), F.size("ends") - 1)).alias("_i", "from_seq"))
        waves = waves.withColumns({"pos": F.col("_i") + 1, "to_seq": F.element_at("ends", F.col("_i") + 2)}).join(slots, ["model", "pos"])
        filled = waves.join(options, [*KEY, "kind", "from_seq", "to_seq"])
        lasts = lambda o: F.col("x_bars").isNull() | (F.col("pos") != 1) | o["b_bars"].isNull() | (F.col("x_bars") >= 0.9 * o["b_bars"])
        offered = F.transform(
            F.filter("options", lasts), lambda o: F.struct(o["code"].alias("code"), (o["score"] * F.element_at(F.col("probs"), (o["code"] / READING).cast("int"))).alias("score"))
        )
        filled = filled.groupBy(*KEY, "model", "ends").agg(F.sort_array(F.collect_list(F.struct("pos", offered.alias("offered")))).alias("waves"))  # three or five
        full = here.join(filled, [*KEY, "model", "ends"]).where(F.size("waves") == F.size("ends") - 1)
        start = F.array(F.struct(F.lit(0.0).alias("order"), F.array().cast("array<int>").alias("path"), F.col("structural").alias("score")))

        def longer(held: Column, wave: Column) -> Column:
            def with_(a: Column, o: Column) -> Column:
                return F.struct(relative_order(a["score"] * o["score"]).alias("order"), F.concat(a["path"], F.array(o["code"])).alias("path"), (a["score"] * o["score"]).alias("score"))

            each = F.flatten(F.transform(held, lambda a: F.transform(wave["offered"], lambda o: with_(a, o))))
            return F.slice(F.array_sort(each), 1, width)

        ways = full.withColumn("way", F.explode(F.aggregate("waves", start, longer)))
        ways = ways.withColumn("ends_text", F.concat_ws("-", F.col("ends").cast("array<string>")))
        best = Window.partitionBy(*KEY, "model", "start_seq", "end_seq").orderBy("way.order", "ends_text", "way.path")
        ranked = ways.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= width)
        named = F.array(*[F.lit(m) for m in MODEL_ORDER])
        children = F.transform(
            "way.path", lambda c, i: F.struct((i + 1).cast("int").alias("pos"), F.element_at(named, (c / READING).cast("int")).alias("child"), (c % READING).alias("child_rank"))
        )
        ranked = cut(ranked.select(*KEY, "model", "start_seq", "end_seq", "rank", F.col("way.score").alias("score"), "ends", "bars", "points", children.alias("children")))
        found = ranked if found is None else found.unionByName(ranked)
        if span + 2 <= max_span:
            b_bars = F.when(F.col("model") == "ZIGZAG", F.element_at("bars", 3) - F.element_at("bars", 2))
            offers = ranked.join(takes, ranked["model"] == takes["child"]).select(*KEY, "kind", "start_seq", "end_seq", "model", "rank", "score", b_bars.alias("b_bars"), model_rank().alias("model_rank"))
            kept = beam_topk(offers.withColumn("order", relative_order(F.col("score"))), [*KEY, "kind", "start_seq", "end_seq"], width, per_model, by_score=("order", "model_rank", "rank"))
            code = (F.col("model_rank") * READING + F.col("rank")).cast("int")
            kept = kept.groupBy(*KEY, "kind", F.col("start_seq").alias("from_seq"), F.col("end_seq").alias("to_seq"))
            options = cut(options.unionByName(kept.agg(F.sort_array(F.collect_list(F.struct(code.alias("code"), "score", "b_bars"))).alias("options"))))
    return found


def reading_tree(nested: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes of the readings in ``roots`` (rows of ``nested``): ``root_start, root_end, root_model, path, depth, model, start_seq, end_seq, score``.

    ``path`` holds the wave positions from the root. One equi-join per level; a span of n legs has (n - 1) / 2 levels below it at most.
    """
    level = roots.select(
        *KEY, F.col("start_seq").alias("root_start"), F.col("end_seq").alias("root_end"), F.col("model").alias("root_model"),
        F.array().cast("array<int>").alias("path"), "model", "rank", "start_seq", "end_seq",
    )
    out, known = None, nested.select(*KEY, "model", "rank", "start_seq", "end_seq", "score", "ends", "children")
    while True:
        full = level.join(known, [*KEY, "model", "rank", "start_seq", "end_seq"], "left")
        full = cut(full.withColumn("score", F.coalesce("score", F.lit(1.0))))
        nodes = full.select(*KEY, "root_start", "root_end", "root_model", "path", F.size("path").alias("depth"), "model", "start_seq", "end_seq", "score")
        out = nodes if out is None else out.unionByName(nodes)
        below = full.where(F.col("children").isNotNull())
        if below.isEmpty():
            return out
        level = below.select(*KEY, "root_start", "root_end", "root_model", "path", "ends", F.explode("children").alias("c")).select(
            *KEY, "root_start", "root_end", "root_model", F.concat("path", F.array("c.pos")).alias("path"), F.col("c.child").alias("model"), F.col("c.child_rank").alias("rank"),
            F.element_at("ends", F.col("c.pos")).alias("start_seq"), F.element_at("ends", F.col("c.pos") + 1).alias("end_seq"),
        )


def markup_roots(nested: DataFrame, width: int = BEAM_WIDTH, per_model: int = PER_MODEL) -> DataFrame:
    """Per range the beam of all readings as a start model, score times the model's coefficient; ``place`` from 1."""
    coef = model_case(lambda m: repr(COEFFICIENT[m]) + "D", START_MODELS)
    roots = nested.where(F.col("model").isin(*START_MODELS)).withColumns({"score": F.col("score") * coef, "model_rank": model_rank()})
    roots = roots.withColumn("order", relative_order(F.col("score")))
    kept = beam_topk(roots, [*KEY, "start_seq", "end_seq"], width, per_model, by_score=("order", "model_rank", "rank"))
    place = F.row_number().over(Window.partitionBy(*KEY, "start_seq", "end_seq").orderBy("order", "model_rank", "rank"))
    return kept.withColumn("place", place).drop("order", "model_rank")


def markup_ranges(nested: DataFrame) -> DataFrame:
    """Best root per range among the start models, score times the model's coefficient."""
    coef = model_case(lambda m: repr(COEFFICIENT[m]) + "D", START_MODELS)
    roots = nested.where((F.col("rank") == 1) & F.col("model").isin(*START_MODELS)).withColumn("score", F.col("score") * coef)
    best = F.min_by(F.struct("model", "score"), F.struct(relative_order(F.col("score")), model_rank()))
    return roots.groupBy(*KEY, "start_seq", "end_seq").agg(best.alias("_b")).select(*KEY, "start_seq", "end_seq", "_b.*")


def _tile_fold() -> Fold:
    def step(state, i, end_seq):
        (cursor,) = state
        if i < cursor:
            return state, None
        end = i + 1 if end_seq is None or end_seq != end_seq else int(end_seq)
        return (end,), (end, end_seq is None or end_seq != end_seq)

    return Fold(("end_seq",), "next long", "tile_end long, is_filler boolean", (0,), step, warmup=512)


def tile_series(ranges: DataFrame, pivots: DataFrame) -> DataFrame:
    """Left to right: the longest span that holds a pattern, else one leg as filler."""
    longest = ranges.groupBy(*KEY, "start_seq").agg(F.max_by(F.struct("end_seq", "model", "score"), "end_seq").alias("_b")).select(*KEY, "start_seq", "_b.*")
    legs = with_pivot_seq(pivots).select(*KEY, F.col("seq").alias("start_seq"))
    last = legs.groupBy(*KEY).agg(F.max("start_seq").alias("_last"))
    starts = legs.join(last, list(KEY)).where(F.col("start_seq") < F.col("_last")).join(longest, [*KEY, "start_seq"], "left")
    tiles, _ = fold_series(starts.select(*KEY, "start_seq", "end_seq"), _tile_fold(), KEY, "start_seq")
    return tiles.join(longest.drop("end_seq"), [*KEY, "start_seq"], "left").select(
        *KEY, "start_seq", F.col("tile_end").alias("end_seq"), "is_filler",
        F.when(F.col("is_filler"), "SIMPLE_IMPULSE").otherwise(F.col("model")).alias("model"),
        F.when(F.col("is_filler"), COEFFICIENT["SIMPLE_IMPULSE"]).otherwise(F.col("score")).alias("score"),
    )


def coverage(tiles: DataFrame) -> DataFrame:
    legs = F.col("end_seq") - F.col("start_seq")
    return tiles.groupBy(*KEY).agg(
        F.count("*").alias("tiles"), (F.sum(F.when(~F.col("is_filler"), legs)) / F.sum(legs)).alias("coverage"), F.sum(F.col("is_filler").cast("int")).alias("fillers")
    )


def position_calibration(nested: DataFrame) -> DataFrame:
    """Parent-child edge counts of the best candidates, as shares per (parent, position) and share x slot budget."""
    e = nested.where("rank = 1").select("model", F.explode("children").alias("_c")).select(F.col("model").alias("parent"), "_c.pos", "_c.child")
    n = e.groupBy("parent", "pos", "child").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("parent", "pos"))
    slots = F.create_map(*[x for (m, g) in GRAMMAR.items() for i, (_, kids) in enumerate(g.items(), 1) for x in (F.lit(f"{m}|{i}"), F.lit(float(sum(COEFFICIENT[c] for c in kids) + COEFFICIENT["SIMPLE_IMPULSE"])))])
    slot = slots[F.concat_ws("|", "parent", F.col("pos").cast("string"))]
    return n.select("parent", "pos", "child", "n", (F.col("n") / total).alias("share"), (F.col("n") / total * slot).alias("probability"))


def bonuses_v1(nested: DataFrame) -> DataFrame:
    """Older bonuses: half the share of waves that have a model of their own, and double for a triangle as b or x."""
    named = F.size(F.filter("children", lambda c: c["child"] != "SIMPLE_IMPULSE"))
    share = named / F.size("children")
    middle = F.filter("children", lambda c: (c["pos"] == 2) & c["child"].isin(*TRIANGLES))
    holds = F.col("model").isin("ZIGZAG", "DOUBLE_ZIGZAG", "TRIPLE_ZIGZAG", "FLAT_EXTENDED", "FLAT_RUNNING", "FLAT_REGULAR")
    coverage, triangle = 1.0 + 0.5 * share, F.when(holds & (F.size(middle) > 0), 2.0).otherwise(1.0)
    return nested.withColumns({"coverage_bonus": coverage, "triangle_bonus": triangle, "score": F.col("score") * coverage * triangle})


# ---- unfinished models and projections -----------------------------------------------------------

FIB_CHOICE = {  # wave -> weight map used to project it
    "IMPULSE": {2: "deep_correction", 3: "impulse_3_to_1", 4: "impulse_4_to_3", 5: "impulse_5_to_1"},
    **{m: {2: "diagonal_correction", 3: "diagonal_3_to_1", 4: "diagonal_correction", 5: "diagonal_5_to_3"} for m in DIAGONALS},
    "ZIGZAG": {2: "deep_correction", 3: "zigzag_c_to_a"},
    "DOUBLE_ZIGZAG": {2: "deep_correction", 3: "zigzag_c_to_a"},
    "FLAT_EXTENDED": {2: "flat_extended_b_to_a", 3: "flat_extended_c_to_a"},
    "FLAT_RUNNING": {2: "flat_running_b_to_a", 3: "flat_running_c_to_a"},
    "FLAT_REGULAR": {2: "flat_regular_b_to_a", 3: "flat_regular_c_to_a"},
    **{m: {i: "triangle_next_to_prev" for i in range(2, 6)} for m in TRIANGLES},
}


def partial_candidates(pivots: DataFrame, all_ends: bool = False) -> DataFrame:
    """Models with one or two waves missing whose confirmed waves are the last single legs of the series.

    ``all_ends`` keeps prefixes ending anywhere.  Score = coefficient x completeness.
    """
    p = with_pivot_seq(pivots)
    last = p.groupBy(*KEY).agg(F.max("seq").alias("_last"))
    out = None
    for done in (1, 2, 3, 4):
        models = tuple(m for m in MODELS if 1 <= WAVES[m] - done <= 2 and m in FIB_CHOICE)
        if not models:
            continue
        c = leg_windows(pivots, done).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
        stages = lambda m: "coalesce(" + ", ".join([stage_reason(m, w) for w in range(2, done + 1)] + ["CAST(NULL AS STRING)"]) + ")"
        c = c.where(model_case(stages, models).isNull()).join(last, list(KEY))
        if not all_ends:
            c = c.where(F.col("seq") + done == F.col("_last"))
        total = model_case(lambda m: str(WAVES[m]), models)
        c = c.withColumn("score", model_case(lambda m: repr(COEFFICIENT[m]) + "D", models) * F.lit(done) / total)
        for i in range(done + 1, 6):
            c = c.withColumns({f"p{i}": F.lit(None).cast("double"), f"b{i}": F.lit(None).cast("long"), f"w{i}": F.lit(None).cast("double")})
        cols = [*KEY, "model", "seq", "s", "score", *[f"p{i}" for i in range(6)], *[f"b{i}" for i in range(6)], *[f"w{i}" for i in range(1, 6)]]
        c = c.select(*cols, F.lit(done).alias("confirmed"), total.cast("int").alias("waves"))
        out = c if out is None else out.unionByName(c)
    return out


def _best_ratio(name: str) -> tuple[float, float]:
    from barwave.functions.fib import FIB_MAPS

    weight, ratio = max(FIB_MAPS[name], key=lambda e: e[0])
    return ratio, weight / 100.0


def project_waves(partials: DataFrame) -> DataFrame:
    """Price, bar and weight of the waves still missing, one row each, with the price that cancels the projection.

    Lines through wave ends where the model has them and they point the right way, else the heaviest
    ratio of a reference wave; chained for at most two waves.
    """
    df = partials.withColumns(
        {
            "_price": F.coalesce(*[F.when(F.col("confirmed") == n, F.col(f"p{n}")) for n in (1, 2, 3, 4)]),
            "_bar": F.coalesce(*[F.when(F.col("confirmed") == n, F.col(f"b{n}")) for n in (1, 2, 3, 4)]),
        }
    )
    df = df.withColumn("_start", F.col("_price"))
    done = F.col("confirmed")
    count = lambda i: F.col(f"b{i}") - F.col(f"b{i - 1}") + 1
    total = F.col("_bar") - F.col("b0") + done
    avg = F.greatest(F.floor(total / done), F.lit(1))
    rows = []
    price, bar = F.col("_price"), F.col("_bar")
    for step in (1, 2):
        wave = done + step
        up = F.when((done + step) % 2 == 1, F.col("s")).otherwise(-F.col("s"))

        def by_wave(fn):
            out = None
            for m in FIB_CHOICE:
                for k in range(2, WAVES[m] + 1):
                    cond = (F.col("model") == m) & (wave == k)
                    v = fn(m, k)
                    out = F.when(cond, v) if out is None else out.when(cond, v)
            return out

        ratio = by_wave(lambda m, k: F.lit(_best_ratio(FIB_CHOICE[m][k])[0]))
        weight = by_wave(lambda m, k: F.lit(_best_ratio(FIB_CHOICE[m][k])[1]))

        def reference(m, k):
            if m == "IMPULSE" and k == 4 or m in DIAGONALS and k in (4, 5):
                return F.coalesce(F.col("w3"), F.col("w1"))
            if m in TRIANGLES:
                return F.when(F.lit(k - 1) <= done, F.col(f"w{k - 1}")).otherwise(
                    F.coalesce(*[F.when(done == n, F.col(f"w{n}")) for n in (1, 2, 3, 4)])
                )
            return F.col("w1")

        def length(m, k):
            if m == "IMPULSE" and k == 4:
                return F.when(done > 1, F.greatest(count(2), F.lit(1))).otherwise(avg)
            if m == "IMPULSE" and k == 5:
                return F.greatest(count(1), F.lit(1))
            if m in TRIANGLES:
                return F.when(F.lit(k - 1) <= done, F.greatest(F.floor(count(k - 1) * 0.786), F.lit(1))).otherwise(avg)
            return avg

        plain_price = price + up * by_wave(reference) * ratio
        plain_bar = bar + by_wave(length)

        def line(m, k):
            i, j = (1, 3) if k % 2 == 1 else (2, 4)
            if m not in DIAGONALS + TRIANGLES:
                return F.lit(None)
            span = F.col(f"b{j}") - F.col(f"b{i}")
            at = bar + F.greatest(F.floor(span / 2), F.lit(1))
            y = F.col(f"p{j}") + (F.col(f"p{j}") - F.col(f"p{i}")) / span * (at - F.col(f"b{j}"))
            ok = (done >= j) & F.when(up > 0, y > price).otherwise(y < price)
            return F.when(ok, F.struct(y.alias("price"), at.alias("bar")))

        drawn = by_wave(lambda m, k: line(m, k).cast("struct<price: double, bar: bigint>"))
        missing = wave <= F.col("waves")
        df = df.withColumn(f"_l{step}", drawn)
        df = df.withColumns(
            {
                f"_p{step}": F.coalesce(F.col(f"_l{step}.price"), plain_price),
                f"_b{step}": F.coalesce(F.col(f"_l{step}.bar"), plain_bar.cast("long")),
            }
        )
        rows.append(
            F.when(
                missing,
                F.struct(
                    wave.alias("wave"), F.col(f"_p{step}").alias("price"), F.col(f"_b{step}").alias("bar"),
                    F.when(F.col(f"_l{step}").isNotNull(), "trendline").otherwise(F.format_string("%.3f", ratio)).alias("label"),
                    F.when(F.col(f"_l{step}").isNotNull(), 0.8).otherwise(weight).alias("weight"),
                ),
            )
        )
        price, bar = F.col(f"_p{step}"), F.col(f"_b{step}")
    out = df.withColumn("_r", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())))
    return out.select(*KEY, "model", "seq", "confirmed", "waves", "score", "_r.*", F.col("_start").alias("cancel_price"), F.col("_b1").alias("cancel_bar"))


def cluster_zones(df: DataFrame, points: str, tolerance: float = 0.05) -> DataFrame:
    """Pairs of one row's projections (array of struct price, bar, weight, label) within 5 % of their mean.

    A markup has a handful of projections, so pairs are formed inside its array.
    """
    idx = F.sequence(F.lit(1), F.size(points))
    pairs = F.flatten(
        F.transform(idx, lambda i: F.transform(F.filter(idx, lambda j: j > i), lambda j: F.struct(F.element_at(points, i).alias("a"), F.element_at(points, j).alias("b"))))
    )
    j = df.withColumn("_p", F.explode(pairs))
    a, b = F.col("_p.a"), F.col("_p.b")
    near = F.abs(a["price"] - b["price"]) / ((a["price"] + b["price"]) / 2.0) <= tolerance
    keep = [c for c in df.columns if c != points]
    return j.where(near).select(
        *keep, F.least(a["price"], b["price"]).alias("zone_low"), F.greatest(a["price"], b["price"]).alias("zone_high"),
        (a["weight"] * b["weight"]).alias("weight"), F.least(a["bar"], b["bar"]).alias("bar_from"), F.greatest(a["bar"], b["bar"]).alias("bar_to"),
        a["label"].alias("label_a"), b["label"].alias("label_b"),
    )


# ---- bar checks and comparisons ------------------------------------------------------------------


def candle_breach(spans: DataFrame, bars: DataFrame, ident: list[str]) -> DataFrame:
    """Whether a bar inside goes beyond the start or end price, and whether the end price is a high or low of its bar.

    ``spans``: ident, symbol, tf, start_bar, start_value, end_bar, end_value.
    """
    lo, hi = F.least("start_value", "end_value"), F.greatest("start_value", "end_value")
    j = range_join(spans, bars.select(*KEY, "bar_index", "high", "low"))
    inner = (F.col("bar_index") > F.col("start_bar")) & (F.col("bar_index") < F.col("end_bar"))
    at_end = F.col("bar_index") == F.col("end_bar")
    on = (F.col("high") == F.col("end_value")) | (F.col("low") == F.col("end_value"))
    return j.groupBy(*KEY, *ident).agg(
        F.max((inner & ((F.col("high") > hi) | (F.col("low") < lo))).cast("int")).cast("boolean").alias("breached"),
        F.max((at_end & on).cast("int")).cast("boolean").alias("on_bar"),
    )


def peak_scores(bars: DataFrame, high: bool = True, skip: int = 5) -> DataFrame:
    """Per bar how far price stayed inside on both sides (the nearer side), leaving out ``skip`` bars next to it."""
    v = F.col("high") if high else -F.col("low")
    base = bars.select(*KEY, F.col("bar_index").alias("i"), v.alias("peak"))
    n = bars.groupBy(*KEY).agg(F.max("bar_index").alias("last_bar"))
    base = base.join(n, list(KEY)).withColumns({"_fs": F.col("i") + skip - 1, "_bs": -F.col("i") + skip - 1})
    ahead = bars.select(*KEY, "bar_index", v.alias("_x"))
    behind = ahead.withColumn("bar_index", -F.col("bar_index"))
    hit = F.min(F.when(F.col("_x") > F.col("peak"), F.col("bar_index")))
    f = first_hit(base, ahead, [*KEY, "i"], "_fs", [hit.alias("_fa")], F.col("_fa").isNotNull())
    b = first_hit(f, behind, [*KEY, "i"], "_bs", [hit.alias("_ba")], F.col("_ba").isNotNull())
    fwd = F.greatest(F.coalesce(F.col("_fa"), F.col("last_bar") + 1) - (F.col("i") + skip), F.lit(0))
    back = F.greatest(F.col("i") - skip - F.coalesce(-F.col("_ba"), F.lit(-1)), F.lit(0))
    return b.select(*KEY, F.col("i").alias("bar_index"), "peak", F.least(fwd, back).cast("long").alias("score")).where(F.col("score") > 0)


def top_peaks(scores: DataFrame) -> DataFrame:
    """The two best peaks of each series that reach 85 % of the best score."""
    best = scores.groupBy(*KEY).agg(F.max("score").alias("_best"))
    tops = scores.join(best, list(KEY)).where(F.col("score") >= F.col("_best") * 0.85)
    order = F.struct("score", "peak", -F.col("bar_index"))
    # two maxima without ranking the whole series in one task
    first = tops.groupBy(*KEY).agg(F.max_by("bar_index", order).alias("first_bar"))
    rest = tops.join(first, list(KEY)).where(F.col("bar_index") != F.col("first_bar"))
    second = rest.groupBy(*KEY).agg(F.max_by("bar_index", order).alias("second_bar"))
    return first.join(second, list(KEY), "left")


def markup_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Node by node: BORN, DIED, COMPLETED (was projected), PROJECTED (was complete) or SAME."""
    o = old.select(*KEY, "node_id", F.col("is_projected").alias("_o"))
    n = new.select(*KEY, "node_id", F.col("is_projected").alias("_n"))
    j = o.join(n, [*KEY, "node_id"], "full_outer")
    change = (
        F.when(F.col("_o").isNull(), "BORN").when(F.col("_n").isNull(), "DIED")
        .when(F.col("_o") & ~F.col("_n"), "COMPLETED").when(~F.col("_o") & F.col("_n"), "PROJECTED").otherwise("SAME")
    )
    return j.select(*KEY, "node_id", change.alias("change"))
