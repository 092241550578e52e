"""Class bigrams with words beyond the head: each has a class of its own, and scores equal a plain walk over the tokens."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from barwave.llm import brown_lm


@pytest.fixture(scope="module")
def learnt(spark):
    """Two kinds of words with one ending, each kind with neighbours of its own; more filler than the head holds, so that kinds are outside."""
    rng = random.Random(5)
    texts = [f"the a{i}zzz is" for i in range(400)] + [f"m{i % 40} b{i}zzz m{i % 37}" for i in range(400)]
    texts += [" ".join(rng.choice([f"the n{i % 40} is", "m{} m{} m{}".format(*rng.choices(range(40), k=3))]) for _ in range(20)) for i in range(600)]
    filler = [f"f{i}" for i in range(brown_lm.HEAD + 300)] * 2
    rng.shuffle(filler)
    texts += [" ".join(filler[i : i + 100]) for i in range(0, len(filler), 100)]
    texts += [" ".join(f"{rng.choice('ab')}{rng.randrange(400)}q{rng.randrange(300)}" for _ in range(6)) for _ in range(50)] + ["", None]
    asked = ["the a7zzz is", "the b7zzz is", "m1 a7zzz m2", "m1 b7zzz m2", "never seenzzz a1zzz b1zzz", "a2zzz a2zzz f1 f2 unseen unseen", "", None, *texts[:3], *texts[-60:], " ".join(texts[500:900])]
    training = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(2)
    kept, plain = [], brown_lm.class_pairs

    def keep(encoded, classes, code_class, k):
        kept.extend([{bytes(r["word"]): r for r in classes.collect()}, code_class.copy(), k, plain(encoded, classes, code_class, k)])
        return kept[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(brown_lm, "class_pairs", keep)
        got = {r["doc_id"]: r for r in brown_lm.score(docs, training).collect()}
    return texts, asked, got, kept


def test_words_of_one_ending_part(learnt):
    _, _, got, (classes, *_) = learnt
    assert classes[b"a7zzz"]["code"] is None and classes[b"b7zzz"]["code"] is None
    assert got[0]["base_score"] == pytest.approx(got[1]["base_score"])
    assert got[0]["score"] > got[1]["score"] + 0.5 and got[3]["score"] > got[2]["score"] + 0.5


def test_scores_equal_a_walk(learnt):
    texts, asked, got, (classes, code_class, k, pairs) = learnt
    counts = Counter(w for t in texts for w in brown_lm.tokens(t))
    assert {w: r["c"] for w, r in classes.items()} == counts

    def walk(text):
        cls = [classes[w]["cls"] if w in classes else int(code_class[brown_lm.HEAD + brown_lm.HEAD_UNITS + zlib.crc32(w.rstrip(b".,;:!?")[-3:]) % brown_lm.ENDING_UNITS]) for w in brown_lm.tokens(text)]
        return [k - 1, *cls, k - 1]

    want = np.zeros((k, k))
    for t in texts:
        c = walk(t)
        np.add.at(want, (c[:-1], c[1:]), 1)
    assert (want == pairs).all()
    n, v = np.zeros(k), np.zeros(k)
    for r in classes.values():
        n[r["cls"]] += r["c"]
        v[r["cls"]] += 1
    n[k - 1] += len(texts)
    v[k - 1] += 1
    prior = (n + 0.5) / (n.sum() + 0.5 * k)
    trans = np.log10((want + prior) / (want.sum(1, keepdims=True) + 1))
    for i, t in enumerate(asked):
        c = walk(t)
        count = [counts[w] for w in brown_lm.tokens(t)] + [len(texts)]
        score = sum(trans[a, b] for a, b in zip(c[:-1], c[1:], strict=True)) + sum(math.log10((m + 0.5) / (n[x] + 0.5 * (v[x] + 1))) for m, x in zip(count, c[1:], strict=True))
        assert got[i]["score"] == pytest.approx(score) and got[i]["n_tokens"] == len(count) and got[i]["n_known"] == sum(m > 0 for m in count)


def test_best_classes_raise_likelihood():
    rng = np.random.default_rng(1)
    k, words = 5, 60
    b = rng.poisson(np.where((np.arange(words)[:, None] + 1) % 4 == np.arange(words)[None] % 4, 3, 0.2)).astype(float)
    np.fill_diagonal(b, 0)
    cls = rng.integers(0, k - 1, words)

    def likelihood(c):
        one = np.eye(k)[c]
        n = one.T @ b @ one
        return brown_lm.h(n).sum() - brown_lm.h(n.sum(0)).sum() - brown_lm.h(n.sum(1)).sum()

    for _ in range(3):
        for u in range(words):
            one = np.eye(k)[cls]
            near = np.concatenate([b[:, u] @ one, b[u] @ one]).astype(int)[None]
            to = brown_lm.best_classes(near, cls[[u]], one.T @ b @ one)
            assert to[0] < k - 1
            moved = cls.copy()
            moved[u] = to[0]
            if to[0] != cls[u]:
                gain = likelihood(moved) - likelihood(cls)
                assert gain > -3
            cls = moved
    assert likelihood(cls) > likelihood(rng.integers(0, k - 1, words))


def test_condition_equals_table(spark):
    rows = [(i if i % 7 else None, None if i % 11 == 0 else " ".join(f"w{(i * j) % 23}" for j in range(i % 9))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    some = docs["doc_id"] % 3 != 1  # null for a null id, which then teaches nothing

    def shown(df):
        return sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect())

    got = shown(brown_lm.score(docs, some))
    assert len(got) == len(rows) and got == shown(brown_lm.score(docs, docs.filter(some)))
