"""Language of whole texts by a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
EMBED = 6
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
BLOCK = 96  # windows in one matrix product


class ByteConvNet:
    """Byte embedding, filters of several widths, the maximum over a window, softmax over languages."""

    def __init__(self, langs: list[str], window: int = WINDOW, widths=WIDTHS, filters: int = FILTERS, embed: int = EMBED, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs, self.window, self.reach, self.embed_dim = langs, window, max(widths), embed
        wide, n = self.reach * embed, filters * len(widths)
        # a filter of width w looks at the first w bytes of a place: its other weights stay 0
        self.mask = np.concatenate([np.repeat((np.arange(wide) < w * embed)[:, None], filters, 1) for w in widths], 1).astype(np.float32)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, embed)),
            "conv": rng.normal(0, 0.3, (wide, n)) * self.mask,
            "bias": np.zeros(n),
            "out": rng.normal(0, 0.3, (n, len(langs))),
            "out_bias": np.zeros(len(langs)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def patches(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x]
        b, n, d = e.shape
        places = n - self.reach + 1
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (b, places, self.reach * d), (s[0], s[1], s[2])).reshape(b * places, self.reach * d)

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responses of each place (b, places, n) and the pooled maxima."""
        r = (self.patches(x) @ self.p["conv"]).reshape(len(x), -1, self.p["conv"].shape[1])
        return r, np.maximum(r.max(axis=1) + self.p["bias"], 0)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log softmax of each window (rows of ``window`` bytes)."""
        out = []
        for at in range(0, len(x), BLOCK):
            z = self.hidden(x[at : at + BLOCK])[1] @ self.p["out"] + self.p["out_bias"]
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 5) -> ByteConvNet:
        """Adam on the cross entropy; ``x`` windows of bytes, ``y`` language numbers."""
        rng = np.random.default_rng(seed)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        places = self.window - self.reach + 1
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                i = order[at : at + batch]
                xb, b = x[i], len(i)
                patch = self.patches(xb)
                r = (patch @ self.p["conv"]).reshape(b, places, -1)
                top = r.argmax(axis=1)  # (b, n)
                h = np.maximum(np.take_along_axis(r, top[:, None], 1)[:, 0] + self.p["bias"], 0)
                z = h @ self.p["out"] + self.p["out_bias"]
                q = np.exp(z - z.max(axis=1, keepdims=True))
                q /= q.sum(axis=1, keepdims=True)
                q[np.arange(b), y[i]] -= 1
                q /= b
                dh = (q @ self.p["out"].T) * (h > 0)
                at_top = patch.reshape(b, places, -1)[np.arange(b)[:, None], top]  # (b, n, wide)
                g = {"out": h.T @ q, "out_bias": q.sum(0), "bias": dh.sum(0), "conv": np.einsum("bnw,bn->wn", at_top, dh) * self.mask}
                dp = (dh[:, :, None] * self.p["conv"].T[None]).reshape(b, -1, self.reach, self.embed_dim)
                g["embed"] = np.zeros_like(self.p["embed"])
                np.add.at(g["embed"], xb[np.arange(b)[:, None, None], top[:, :, None] + np.arange(self.reach)], dp)
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: mean log probability of its windows, each by its letters, made to sum to 1."""
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        held: list[tuple[int, bytes]] = [(i, t.encode("utf-8", "replace")) for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not held or not self.langs:
            return lang, score
        padded = [raw + bytes(-len(raw) % self.window) for _, raw in held]
        x = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, self.window)
        weight = WEIGHT[x].sum(axis=1, dtype=np.float64)
        owner = np.repeat(np.arange(len(held)), [len(p) // self.window for p in padded])
        lp = self.log_probs(x) * weight[:, None]
        total = np.bincount(owner, weight, len(held))
        z = np.stack([np.bincount(owner, lp[:, k], len(held)) for k in range(len(self.langs))], 1) / total[:, None]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        best = q.argmax(axis=1)
        for (i, _), k, p in zip(held, best, q.max(axis=1), strict=True):
            lang[i], score[i] = self.langs[k], p
        return lang, score


#: 1 for bytes that are letters or parts of them
WEIGHT = np.array([1 if 65 <= (b & 0xDF) <= 90 or b >= 128 else 0 for b in range(256)], np.uint8)


def learn(labelled: DataFrame, per_lang: int = 1500, window: int = WINDOW, seed: int = 5) -> ByteConvNet:
    """A network from ``labelled`` (``key, text, lang``).

    It is fitted on at most about ``per_lang`` windows of each language (one from each of so many texts, chosen by the hash
    of ``key``, at a hash-chosen place), at most twice as many in all. Rows without language or letters are not used. The
    number of languages is that of the labels. Without labelled rows the network knows no language.
    """
    rows = labelled.select("key", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return ByteConvNet([], window)
    langs = sorted(counts)
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, 1.3 * per_lang / n)) for k, n in counts.items()], "lang string, share double")
    chance = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1_000_000)) / 1_000_000.0
    # the number of places at which a whole window fits, or 1
    place = F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.greatest(F.length("text") - window + 1, F.lit(1)).cast("long")).cast("int")
    sample = rows.join(F.broadcast(shares), "lang").filter(chance < F.col("share")).select("key", "lang", F.substr("text", place + 1, F.lit(window)).alias("text"))
    pdf = sample.limit(2 * per_lang * len(langs)).toPandas().sort_values(["key", "text"], kind="stable")
    x = np.stack([np.frombuffer(t.encode("utf-8", "replace")[:window].ljust(window, b"\0"), np.uint8) for t in pdf["text"]])
    y = pdf["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    return ByteConvNet(langs, window).fit(x, y)


def identify(text: Column, net: ByteConvNet) -> Column:
    """Struct (lang_pred, score) of a text column.

    The whole text is cut into windows of fixed length, the last one padded. Null, empty and letterless texts give
    ``und`` with score 0, as does a network that knows no language. Equal texts give equal results.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            lang, score = [], []
            for at in range(0, len(s), 250):
                a, b = net.predict(s.iloc[at : at + 250].tolist())
                lang += a
                score += b.tolist()
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return predict(text)
