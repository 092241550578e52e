"""Quality of whole texts from a linear-chain conditional random field over their lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the line features count.
SYMBOLS = b"#*$%&|<>{}[]=+~^_\\@/"
DIGITS = b"0123456789"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
MARKS = b"!?"
STOPS = b".,;:"
N_OWN = 15


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with those of its neighbours, and line lengths. A null or empty text is one empty line."""
    lines = (text or "").encode("utf-8", "replace").split(b"\n")
    own = np.zeros((len(lines) + 2, N_OWN), np.float32)
    seen: set[bytes] = set()
    before = None
    for i, line in enumerate(lines, 1):
        n = len(line)
        words = line.split()
        k = len(words)
        d, w = max(n, 1), max(k, 1)
        own[i] = (
            1.0,
            np.log1p(n) / 5,
            np.log1p(k) / 4,
            n - len(line.translate(None, SYMBOLS)) and (n - len(line.translate(None, SYMBOLS))) / w,
            (n - len(line.translate(None, DIGITS))) / d * 5,
            (n - len(line.translate(None, CAPITALS))) / d * 3,
            (n - len(line.translate(None, LOWER))) / d,
            (n - len(line.translate(None, MARKS))) / w,
            (n - len(line.translate(None, STOPS))) / w,
            len(set(words)) / w,
            min(d / w / 10, 3),
            float(line.endswith((b".", b"!", b"?"))),
            float(line in seen and k > 0),
            float(line == before and k > 0),
            float(n == 0),
        )
        seen.add(line)
        before = line
    return np.minimum(np.concatenate([own[1:-1], own[:-2], own[2:]], axis=1), 5), np.array([max(len(x), 1) for x in lines], np.float64)


def runs(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Sequence numbers in groups of like length, so that little is padded."""
    order = np.argsort(sizes, kind="stable")
    grade = np.ceil(np.log2(np.maximum(sizes[order], 1)))
    for g in np.unique(grade):
        yield order[grade == g]


class LineCrf:
    """Two labels (0 bad, 1 good); a line's score for good is linear in its features, neighbours' scores add a transition."""

    def __init__(self, dim: int = 3 * N_OWN):
        self.w, self.trans = np.zeros(dim), np.zeros((2, 2))
        self.mean, self.spread = np.zeros(dim), np.ones(dim)
        self.scale, self.shift = 1.0, 0.0

    def marginals(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected number of each transition (2 x 2); ``x`` holds the sequences end to end."""
        emit = np.zeros((len(x), 2))
        emit[:, 1] = np.clip(((x - self.mean) / self.spread) @ self.w, -30, 30)
        starts = np.cumsum(sizes) - sizes
        good, pairs = np.zeros(len(x)), np.zeros((2, 2))
        step = np.exp(self.trans)
        for group in runs(sizes):
            n, long = sizes[group], int(sizes[group].max())
            place = np.minimum(starts[group][:, None] + np.arange(long), len(x) - 1)
            inside = np.arange(long) < n[:, None]
            e = np.exp(np.where(inside[:, :, None], emit[place], 0.0))
            fwd, back = np.zeros((len(group), long, 2)), np.ones((len(group), long, 2))
            a = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            fwd[:, 0] = a
            for t in range(1, long):
                nxt = (a @ step) * e[:, t]
                nxt /= nxt.sum(1, keepdims=True)
                a = np.where(inside[:, t, None], nxt, a)
                fwd[:, t] = a
            b = np.ones((len(group), 2))
            for t in range(long - 2, -1, -1):
                nxt = (b * e[:, t + 1]) @ step.T
                nxt /= nxt.sum(1, keepdims=True)
                b = np.where(inside[:, t + 1, None], nxt, 1.0)
                back[:, t] = b
            both = fwd * back
            both /= both.sum(2, keepdims=True)
            good[place[inside]] = both[:, :, 1][inside]
            if long > 1:
                pair = fwd[:, :-1, :, None] * step * (e[:, 1:] * back[:, 1:])[:, :, None, :]
                pair /= pair.sum((2, 3), keepdims=True)
                pairs += pair[inside[:, 1:]].sum(0)
        return good, pairs

    def quality(self, x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Mean of the lines' marginals by length, before calibration."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        good = self.marginals(x, sizes)[0]
        return np.bincount(owner, good * lengths, len(sizes)) / np.bincount(owner, lengths, len(sizes))

    def calibrated(self, quality: np.ndarray) -> np.ndarray:
        q = np.clip(quality, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.scale * np.log(q / (1 - q)) + self.shift)))

    def fit(self, x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.1, l2: float = 1e-3) -> LineCrf:
        """Adam on the chain's log likelihood with each line labelled as its document; a document's lines weigh 1 in all."""
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        self.mean[0], self.spread[0] = 0, 1  # the constant
        z = (x - self.mean) / self.spread
        owner = np.repeat(np.arange(len(sizes)), sizes)
        share = (1 / sizes)[owner]
        p = np.concatenate([self.w, self.trans.ravel()])
        m, v = np.zeros_like(p), np.zeros_like(p)
        line_y = y[owner]
        same = np.zeros((2, 2))
        for k in (0, 1):
            same[k, k] = (sizes[y == k] - 1).sum()
        for t in range(1, steps + 1):
            self.w, self.trans = p[: len(self.w)], p[len(self.w) :].reshape(2, 2)
            good, pairs = self.marginals(x, sizes)
            g = np.concatenate([z.T @ (share * (line_y - good)) / len(sizes) - l2 * self.w, ((same - pairs) / max(1, sizes.sum()) - l2 * self.trans).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.w, self.trans = p[: len(self.w)], p[len(self.w) :].reshape(2, 2)
        q = np.clip(self.quality(x, lengths, sizes), 1e-4, 1 - 1e-4)
        logit, c = np.log(q / (1 - q)), np.array([1.0, 0.0])
        for _ in range(50):  # Newton on the two calibration values
            prob = 1 / (1 + np.exp(-np.clip(c[0] * logit + c[1], -30, 30)))
            design = np.stack([logit, np.ones_like(logit)], 1)
            hess = (design * (prob * (1 - prob))[:, None]).T @ design + np.eye(2)
            c = c + np.linalg.solve(hess, design.T @ (y - prob) - (c - np.array([1.0, 0.0])))
        self.scale, self.shift = c
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        parts = [line_features(t) for t in texts]
        sizes = np.array([len(b) for _, b in parts])
        return self.calibrated(self.quality(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]), sizes))


def learn(labelled: DataFrame, most_docs: int = 3000, most_lines: int = 400, seed: int = 3) -> LineCrf:
    """A field from ``labelled`` (``key, text, quality``).

    It is fitted on at most ``most_docs`` labelled texts, chosen by the hash of ``key``; of a longer one the chain of its
    first ``most_lines`` lines is learnt from (scores always use every line). Rows without a label are not used; other
    labels than 0 count as 1. Without labelled rows every text scores 0.5.
    """
    rows = labelled.select("key", "text", "quality").filter(F.col("quality").isNotNull())
    n = rows.count()
    if not n:
        return LineCrf()
    chance = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1_000_000)) / 1_000_000.0
    pdf = rows.filter(chance < min(1.0, 1.2 * most_docs / n)).limit(most_docs).toPandas().sort_values("key", kind="stable")
    if pdf.empty:
        return LineCrf()
    parts = [line_features("\n".join((t or "").split("\n", most_lines)[:most_lines])) for t in pdf["text"]]
    sizes = np.array([len(b) for _, b in parts])
    y = (pdf["quality"].to_numpy() != 0).astype(float)
    return LineCrf().fit(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]), sizes, y)


def text_quality(text: Column, crf: LineCrf) -> Column:
    """Score (0 to 1, higher is better) of a text column. Null and empty texts are one empty line; equal texts score alike."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.concatenate([np.zeros(0), *(crf.score(s.iloc[at : at + 1000].tolist()) for at in range(0, len(s), 1000))]))

    return score(text)
