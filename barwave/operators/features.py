"""Model inputs from legs, and scoring with a user-supplied function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwave.operators.movement import LEG, leg_bars

FEATURES = ("o", "c", "h", "l")


def group_of(pos: Column, count: Column, n: int) -> Column:
    """Group 0..n-1 of a bar: equal groups, the remainder spread over the groups around the centre."""
    base = F.floor(count / n)
    extra = count - base * n
    first = F.lit(n // 2) - F.floor(extra / 2)
    wide = first * base
    after = wide + extra * (base + 1)
    g = (
        F.when(pos < wide, F.floor(pos / base))
        .when(pos < after, first + F.floor((pos - wide) / (base + 1)))
        .otherwise(first + extra + F.floor((pos - after) / base))
    )
    return g.cast("int")


def segment_features(legs: DataFrame, bars: DataFrame, n: int = 10) -> DataFrame:
    """o, c, h, l of n merged bars per leg, scaled to the leg's ends; legs under n bars are dropped."""
    lb = leg_bars(legs, bars)
    count = F.col("end_bar") - F.col("start_bar") + 1
    lb = lb.where((count >= n) & (F.col("length") > 0)).withColumn("g", group_of(F.col("pos"), count, n))
    lo = F.least("start_value", "end_value")
    scale = lambda c: (c - lo) / F.col("length")
    return lb.groupBy(*LEG, "g").agg(
        F.min_by(scale(F.col("open")), "bar_index").alias("o"),
        F.max_by(scale(F.col("close")), "bar_index").alias("c"),
        F.max(scale(F.col("high"))).alias("h"),
        F.min(scale(F.col("low"))).alias("l"),
    )


def feature_vectors(features: DataFrame, keys: list[str] = LEG) -> DataFrame:
    """One array (o1, c1, h1, l1, o2, ...) per leg; its length is fixed by the number of groups."""
    row = F.struct("g", F.array(*FEATURES).alias("v"))
    return features.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"])).alias("features"))


def feature_dataset(labels: DataFrame, vectors: DataFrame, keys: list[str] = LEG) -> DataFrame:
    """Label, class name and wide feature columns."""
    j = labels.join(vectors, keys)
    return j.select("label", "class", *keys, "features")


def wide(dataset: DataFrame, n: int) -> DataFrame:
    cols = [F.element_at("features", 4 * i + k + 1).alias(f"{f}{i + 1}") for i in range(n) for k, f in enumerate(FEATURES)]
    return dataset.select("label", "class", *cols)


def score_segments(vectors: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], classes: list[str], keys: list[str] = LEG) -> DataFrame:
    """Class probabilities (softmax of the scorer's logits) and the best class, by Arrow batch.

    ``scorer`` maps an (m, 4n) matrix to (m, classes) logits; it is shipped with the tasks.
    """
    fields = ", ".join(f"{k} {t}" for k, t in vectors.select(*keys).dtypes)
    schema = f"{fields}, best string, " + ", ".join(f"p_{c} double" for c in classes)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            logits = np.asarray(scorer(np.stack(pdf["features"].to_numpy())), dtype="float64")
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            out = pdf[keys].copy()
            out["best"] = [classes[i] for i in p.argmax(axis=1)]
            for i, c in enumerate(classes):
                out[f"p_{c}"] = p[:, i]
            yield out

    return vectors.mapInPandas(run, schema)
