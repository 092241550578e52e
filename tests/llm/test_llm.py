"""Text operators against brute force, and on odd tables: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barwave.llm import adaptive_rules, brown_lm, edit_fingerprints, jaccard_join, language_id, line_crf, packing, secret_forest, source_mix, wavelet_tokens
from barwave.llm.queries import shared_folder
from barwave.llm.word_tokenizer import WordTokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, row int, size string, component string"
VOCABULARY = {"en": "the of and to in that it is was for with as on be at by this from or an".split(), "fr": "le la les de des et un une que qui dans pour sur par au avec est ne pas du".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", ".", "x", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [sentence(rng, rng.choice(["en", "fr"]), rng.randint(3, 120)) for _ in range(60)]
    base = out[0] = sentence(rng, "en", 150)
    out += [base, base.upper(), base.replace(" ", "\n", 3), base + " tail", " ".join(base.split()[3:]), "", " \n ", "short text", "short  TEXT"]
    out += ["word " * 3000, "x" * 5000, sentence(rng, "fr", 6000), "line one is here\n" * 40, "123 456 ---", "naïve café ₤ 中文 😀 <|endoftext|>"]
    out += [sentence(rng, "en", 20) + " password=a1b2c3d4e5f6a7b8c9 " + sentence(rng, "en", 20), sentence(rng, "en", 20) + ' token = "0123456789abcdef0123" 10.20.30.40 a.b@mail1.example.com']
    return out


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Texts with null ids, languages and sources, rows repeated, and columns whose names the operators use inside."""
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "b", "a", ""][i % 4], len(t), 1.0, "k", 7, "s", "c") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (500, None, "en", "a", 0, 1.0, "k", 7, "s", "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return (frozenset([tuple(w)]) if w else frozenset()) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    low = {}
    for (doc_id, _), k in zip(rows, label, strict=True):
        if doc_id is not None:
            low[k] = min(low.get(k, doc_id), doc_id)
    return sorted(((i, len(s), low.get(k)) for (i, _), s, k in zip(rows, sets, label, strict=True)), key=str)


@pytest.mark.parametrize("small", [12, 1])
def test_jaccard_join(odd, none, small):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_documents(odd, small=small).collect()), key=str)
    assert got == brute_components(pairs_of(odd))
    assert jaccard_join.link_documents(none).count() == 0


def test_jaccard_recursion_on_a_family(spark):
    """A long chain of versions: few are near the pivot, all are connected."""
    rng, words, rows = random.Random(2), [f"w{i}" for i in range(120)], []
    for i in range(80):
        words = words[:]
        words[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for levels in (0, 1, 3):
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_documents(df, small=2, levels=levels).collect()), key=str)
        assert got == brute_components(rows)


def test_keep_first(odd, none):
    got = jaccard_join.keep_first(odd)
    assert got.columns == odd.columns and jaccard_join.keep_first(none).count() == 0
    rows = pairs_of(odd)
    groups = {c for _, n, c in brute_components(rows) if n}
    assert got.filter(F.col("text").rlike(r"\S")).count() == len(groups)
    assert got.filter(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).count() == sum(not shingle_set(t) for _, t in rows)


def test_language_id(odd, none):
    net = language_id.learn(odd)
    got = odd.select("text", "lang", language_id.identify(F.col("text"), net).alias("p")).select("text", "lang", "p.*").collect()
    for r in got:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"]))
    learned = {r["lang_pred"] for r in got}
    assert learned <= {"en", "fr", "und"}
    assert language_id.learn(none).langs == []


def test_language_id_tells_languages(spark):
    rng = random.Random(1)
    rows = [(str(i), sentence(rng, lang, 60), lang) for i in range(300) for lang in ("en", "fr")]
    net = language_id.learn(spark.createDataFrame(rows, "key string, text string, lang string"))
    fresh = [(sentence(rng, lang, 40), lang) for _ in range(50) for lang in ("en", "fr")]
    assert np.mean([a == b for a, b in zip(net.predict([t for t, _ in fresh])[0], [x for _, x in fresh], strict=True)]) > 0.95


def test_source_mix_brute_force(odd, none):
    sized = odd.select("doc_id", "source", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "")).alias("size"))
    got = source_mix.mix_sources(sized).collect()
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while True:
        fair = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if fair[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    target |= fair
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(got, key=str) == sorted(source_mix.mix_sources(sized.repartition(5)).collect(), key=str)
    assert source_mix.mix_sources(none.withColumn("size", F.lit(1))).count() == 0


def test_mix_documents(odd, none):
    mixed = source_mix.mix_documents(odd)
    assert mixed.columns == odd.columns and source_mix.mix_documents(none).count() == 0
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    total = mixed.select(F.sum(words)).first()[0]
    assert abs(total - odd.select(F.sum(words)).first()[0]) <= 4
    assert mixed.filter(words == 0).count() == 0


def test_secrets(odd, none, texts):
    found = secret_forest.scan(odd).collect()
    values = {r["value"]: r["is_secret"] for r in found}
    assert values["a1b2c3d4e5f6a7b8c9"] and values["0123456789abcdef0123"] and not values["a.b@mail1.example.com"]
    clean = secret_forest.redact(odd, secret_forest.scan(odd))
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert clean.filter("text like '%a1b2c3%' or text like '%0123456789abcdef0123%'").count() == 0
    assert clean.filter("text like '%[SECRET]%'").count() == 2 and clean.filter("text like '%10.20.30.40%'").count() == 1
    assert secret_forest.scan(none).count() == 0 and secret_forest.redact(none, secret_forest.scan(none)).count() == 0


def test_secrets_after_a_separate_sign(spark):
    said = {'password = "Tr0ub4dor&3" here': "Tr0ub4dor&3", "the pwd: hunter22 goes": "hunter22", 'set token = "qwertyuiopasdfgh" now': "qwertyuiopasdfgh", "my secret =wxyzabcd too": "wxyzabcd"}
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert {r["doc_id"]: r["value"] for r in secret_forest.candidates(docs).collect()} == dict(enumerate(said.values()))
    masked = {r["doc_id"]: r["text"] for r in secret_forest.redact(docs, secret_forest.scan(docs)).collect()}
    assert all(v not in masked[i] and secret_forest.MARK in masked[i] for i, v in enumerate(said.values()))


def test_secrets_leave_clean_tables_alone(spark):
    clean = ["call +49-170-1234567890 now", "write to jane.doe42@mail.example.com or", "host 192.168.100.200:8080 is up", "order 2024-01-02T10:20:30 sent"]
    docs = spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string")
    assert secret_forest.candidates(docs).count() == 4
    assert sorted(r["text"] for r in secret_forest.redact(docs, secret_forest.scan(docs)).collect()) == sorted(clean)


def test_secret_dictionary_counts_texts(spark):
    rows = ["copied words"] * 50 + [f"common words {'alpha beta'[i % 2 :]}" for i in range(6)] + [f"n {i} password = qwertyuiopasdfgh" for i in range(30)]
    docs = spark.createDataFrame([(t,) for t in rows], "text string").repartition(4)
    got = {r["word"]: r["n"] for r in secret_forest.dictionary(docs).collect()}
    assert got == {"password": 30, "words": 3}  # copies count once, and the value is a candidate however often it stands


def test_edit_fingerprints(odd, none):
    got = sorted(edit_fingerprints.edited_likeness(odd).collect(), key=str)
    assert len(got) == odd.count() and edit_fingerprints.edited_likeness(none).count() == 0
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(((i, t or "") for i, t in pairs_of(unique)), reverse=True)
    want = {}
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        want[i] = hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest()
    for buckets_of in (1, 7):
        odd.sparkSession.conf.set("spark.sql.shuffle.partitions", str(buckets_of))
        assert {r["doc_id"]: r["edited_sha256"] for r in edit_fingerprints.edited_likeness(unique).collect()} == want
    odd.sparkSession.conf.set("spark.sql.shuffle.partitions", "4")
    prints = {}
    for r in edit_fingerprints.fingerprint_documents(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert prints.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]
    bits = edit_fingerprints.fingerprints([rows[5][1] * 3, rows[5][1] * 3 + "!", rows[9][1] * 3])
    assert edit_fingerprints.likeness(bits[0], bits[1]) > 0.9 > edit_fingerprints.likeness(bits[0], bits[2])


def test_edit_fingerprints_of_copies_agree():
    rng = random.Random(8)
    copies = ["a short text", "xyz", "some words that are copied " * 30]
    batch = [t for _ in range(1500) for t in ("".join(chr(rng.randint(33, 9000)) for _ in range(rng.randint(1, 9))), rng.choice(copies))]
    shown = edit_fingerprints.to_hex(edit_fingerprints.fingerprints(batch))
    for t in copies:
        assert {h for x, h in zip(batch, shown, strict=True) if x == t} == set(edit_fingerprints.to_hex(edit_fingerprints.fingerprints([t])))


def test_near_fingerprints(odd):
    prints = edit_fingerprints.fingerprint_documents(odd)
    bits = {r["fingerprint"]: np.unpackbits(np.frombuffer(bytes.fromhex(r["fingerprint"]), np.uint8)) for r in prints.collect()}
    for r in edit_fingerprints.near_fingerprints(prints).collect():
        assert r["likeness"] == pytest.approx(float(edit_fingerprints.likeness(bits[r["a"]], bits[r["b"]]))) and r["a"] < r["b"]


@pytest.mark.parametrize("size", [512, 40])
def test_near_fingerprints_finds_every_pair_of_a_bucket(spark, monkeypatch, size):
    monkeypatch.setattr(edit_fingerprints, "SLICE", size)
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, 256)[None] ^ (rng.random((240, 256)) < 0.11)
    bits = np.concatenate([bits, rng.integers(0, 2, (60, 256))]).astype(np.uint8)
    shown, keys = edit_fingerprints.to_hex(bits), edit_fingerprints.bands(bits)
    prints = spark.createDataFrame([(h, k.tolist()) for h, k in zip(shown, keys, strict=True)], "fingerprint string, bands array<long>")
    pairs = [(i, j) for i in range(300) for j in range(i) if (keys[i] == keys[j]).any() and edit_fingerprints.likeness(bits[i], bits[j]) >= 0.8]
    got = [(r["a"], r["b"]) for r in edit_fingerprints.near_fingerprints(prints).collect()]
    assert len(pairs) > 500 and sorted(got) == sorted(tuple(sorted((shown[i], shown[j]))) for i, j in pairs)


def test_brown_lm_base(odd, none):
    got = brown_lm.score(odd, odd).collect()
    counts = Counter()
    rows = pairs_of(odd)
    for _, t in rows:
        counts.update(brown_lm.tokens(t) + [brown_lm.END_WORD])
    n, v = sum(counts.values()), len(counts)
    want = sorted(round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in brown_lm.tokens(t) + [brown_lm.END_WORD]), 6) for _, t in rows)
    assert sorted(round(r["base_score"], 6) for r in got) == pytest.approx(want, abs=1e-5)
    assert all(r["train_tokens"] == n and r["n_known"] == r["n_tokens"] for r in got) and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert all(r["n_known"] == 0 and r["base_score"] == pytest.approx(0) for r in brown_lm.score(odd, none).collect())
    assert brown_lm.score(none, none).count() == 0


def test_exchange_never_lowers_likelihood():
    rng = np.random.default_rng(0)
    kind = np.arange(30) % 3
    b = rng.poisson(np.where((kind[:, None] + 1) % 3 == kind[None], 20, 1)).astype(float)

    def likelihood(cls):
        one = np.eye(cls.max() + 1)[cls]
        n = one.T @ b @ one
        h = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return h(n) - h(n.sum(0)) - h(n.sum(1))

    start = np.zeros(30, np.int64)
    start[np.argsort(-(b.sum(0) + b.sum(1)), kind="stable")] = np.arange(30) % 4
    assert likelihood(brown_lm.exchange(b, classes=5)) > likelihood(start)


@pytest.mark.parametrize("name,byte_level", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_tokenizer(texts, name, byte_level):
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(9, 14), *range(28, 127), 133, 160, 0x130, 0x301, 0x3000, 0x4E2D, 0x1F600, 233, 0xAA, 0xB2, 0x17F]] + [" "] * 60
    some = texts + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    tok = WordTokenizer(public_tokenizers.path(name), byte_level)
    for t, e in zip(some, plain.encode_batch(some, add_special_tokens=False), strict=True):
        assert np.frombuffer(tok.encode(t), "<u4").tolist() == e.ids


def test_packing(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(packing.token_pieces(odd, path, end_id=1, with_ids=True), group_pieces=20).collect()
    tok = WordTokenizer(path, True)
    want = Counter()
    for i, t in pairs_of(odd):
        want[i, tuple(np.frombuffer(tok.encode(t), "<u4").tolist()) + (1,)] += 1
    for (i, ids), _n in want.items():
        assert any(r["doc_id"] == i and r["start"] == 0 and r["doc_tokens"] == len(ids) for r in got)
    assert sum(r["length"] for r in got) == sum(n * len(ids) for (_, ids), n in want.items())
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(packing.token_pieces(none, path, end_id=1)).count() == 0
    assert sum(packing.cuts(5000)) == 5000 and packing.cuts(2048) == [2048]


def test_adaptive_rules(odd, none):
    got = {(r["doc_id"], r["n_words"]): r for r in adaptive_rules.judge(adaptive_rules.measures(odd)).collect()}
    for i, t in pairs_of(odd):
        w = [x.decode() for x in (t or "").encode().split()]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        r = got[i, len(w)]
        assert (r["n_repeat_words"], r["word_chars"], r["n_dup_lines"]) == (len(covered), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert adaptive_rules.judge(adaptive_rules.measures(odd)).count() == odd.count() and adaptive_rules.judge(adaptive_rules.measures(none)).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (700, 49_408), (5000, 70_000), (1000, 2)):
        ids = rng.integers(0, top, n)
        m = wavelet_tokens.WaveletMatrix.from_bytes(wavelet_tokens.WaveletMatrix.build(ids).to_bytes())
        assert m.decode().tolist() == ids.tolist()
        for i in range(0, n, 97):
            v = int(ids[i])
            at = np.flatnonzero(ids == v)
            assert m.access(i) == v and m.count(v) == len(at) and m.positions(v).tolist() == at.tolist()
            assert m.count(v, i, n) == int((ids[i:] == v).sum()) and m.select(v, 0) == at[0] and m.select(v, len(at)) == -1
        assert m.count(1 << 20) == 0


def test_wavelet_files(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = shared_folder(spark) + "/tokens"
    wavelet_tokens.write_tokens(odd, out, path, end_id=2, shard_tokens=500)
    got = sorted(wavelet_tokens.read_tokens(spark, out).collect(), key=lambda r: r["start"])
    tok = WordTokenizer(path, False)
    want = Counter((i, zlib.crc32(tok.encode(t) + np.array([2], "<u4").tobytes())) for i, t in pairs_of(odd))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert wavelet_tokens.occurrences(spark, out, 2).count() == odd.count()
    empty = shared_folder(spark) + "/tokens"
    wavelet_tokens.write_tokens(none, empty, path, end_id=2)
    assert wavelet_tokens.read_tokens(spark, empty).count() == 0


def test_line_crf(spark, odd, none):
    rng = random.Random(6)
    good = ["\n".join(sentence(rng, "en", 12) + "." for _ in range(5)) for _ in range(80)]
    bad = ["\n".join("### " + sentence(rng, "en", 6).upper() + " $$$" for _ in range(5)) for _ in range(80)]
    rows = [(i, t, int(i < 80)) for i, t in enumerate(good + bad)]
    crf = line_crf.learn(spark.createDataFrame(rows, "key long, text string, quality int").filter("key % 2 = 0"))
    s = crf.score([t for _, t, _ in rows[1::2]])
    assert s[:40].min() > 0.5 > s[40:].max()
    scores = [r[0] for r in odd.select(line_crf.text_quality(F.col("text"), crf)).collect()]
    assert len(scores) == odd.count() and all(0 <= x <= 1 for x in scores)
    assert line_crf.learn(none.withColumn("quality", F.lit(1))).score(["a", None]).tolist() == [0.5, 0.5]


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    crf = line_crf.LineCrf(4)
    crf.w, crf.trans = rng.normal(size=4), rng.normal(size=(2, 2))
    sizes = np.array([3, 1, 4])
    x = rng.normal(size=(8, 4))
    got = crf.marginals(x, sizes)[0]
    at = 0
    for n in sizes:
        total, good = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            p = math.exp(sum(x[at + k] @ crf.w * y[k] for k in range(n)) + sum(crf.trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            good += p * np.array(y)
        assert got[at : at + n] == pytest.approx(good / total)
        at += n


def test_pipeline_stages(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "packing":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            path = f"{shared_folder(spark)}/{name}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
