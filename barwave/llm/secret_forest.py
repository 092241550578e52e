"""Secret scan: a random forest takes the false positives out of what looks like a secret."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwave.llm.common import WORD, broadcast_if_small, cut, let

SECRET_NAMES = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|cred)"
SAMPLE_NAMES = r"(?i)(example|sample|dummy|test|fixture|placeholder|template)"
ASSIGNED = r"(?i)(pass|pwd|secret|token|key|auth|cred)[\w.\-]*[\"']?[:=]+[\"']?[^\s\"']{6,}"
NAME = r"(?i)(pass|pwd|secret|token|key|auth|cred)[\w.\-]*[\"']?"
SIGN = r"^[:=]+>?$"
MARK = "[SECRET]"
NEIGHBOUR_BUCKETS = 64
MOST_TRAINING = 20_000
WORD_SHARE, LEAST_TEXTS = 1e-4, 3  # a dictionary word is in that share of the distinct texts, and in at least so many
NUMBERS = ("length", "transitions", "distinct", "digits", "capitals", "bigrams", "coverage", "path_depth", "path_secret", "path_sample", "slashes", "near_secret")


def may_hold_secret(text: Column) -> Column:
    """False only for texts that give no candidate."""
    return F.coalesce(text.rlike(r"(?i)[0-9]|pass|pwd|secret|token|key|auth|cred"), F.lit(False))


def looks(ws: Column, w: Column, i: Column) -> Column:
    """Is the word ``w`` at place ``i`` of ``ws`` a candidate: by itself, or as what a name and a sign before it assign."""
    one, two = (F.coalesce(F.get(ws, i - k), F.lit("")) for k in (1, 2))
    alone = (F.length(w) >= 10) & ((w.rlike(r"[0-9]") & w.rlike(r"[A-Za-z0-9+/_\-.@]{12,}")) | w.rlike(ASSIGNED))
    given = (one.rlike(SIGN) & two.rlike(NAME + "$")) | one.rlike(NAME + "[:=]+>?$") | (w.rlike(r"^[:=]+>?[\"']?[^:=\"']") & one.rlike(NAME + "$"))
    return alone | (w.rlike(r"[^\s\"':=]{6,}") & given)


def candidates(docs: DataFrame) -> DataFrame:
    """Words that may be secrets: ``cid, doc_id, text_key, word_no, value, path, near``.

    A candidate word has a digit and twelve joined letters, digits or one of ``+/_-``, or assigns a value to a name such as
    ``password``, or follows such a name and a sign (``password = value``, ``pwd: value``, ``token =value``) with six characters or more. ``value`` is the word without quotes and marks and without the name it is assigned to, ``path`` that name
    (also where a sign stands between), ``near`` the three words before and two after. ``word_no`` counts from 0. Null and
    empty texts have none. Whole texts are read; rows equal in all columns give candidates each.
    """

    def found(ws: Column) -> Column:
        near = lambda i: F.array(*[F.coalesce(F.get(ws, i + k), F.lit("")) for k in (-3, -2, -1, 1, 2)])
        return F.filter(F.transform(ws, lambda w, i: F.when(looks(ws, w, i), F.struct(i.alias("word_no"), w.alias("word"), near(i).alias("near")))), lambda x: x.isNotNull())

    bare = F.regexp_replace("c.word", r"^[\"'`(<\[{:=>]+|[\"'`)>\]},.;:!?#*$%&]+$", "")
    named = r"^([\w.\-/\[\]]{1,64}?)[\"']?[:=]+[\"']?([^=:].{5,})$"
    sign = F.element_at("near", 3).rlike(SIGN)
    return cut(
        docs.select("doc_id", "text")
        .filter(may_hold_secret(F.col("text")))
        .withColumn("found", let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), found))
        .filter(F.size("found") > 0)
        .select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"), F.explode("found").alias("c"))
        .select("doc_id", "text_key", "c.word_no", "c.near", bare.alias("bare"), F.col("c.word").rlike("^[:=]").alias("with_sign"))
        .select(
            "doc_id",
            "text_key",
            "word_no",
            F.when(F.col("bare").rlike(named), F.regexp_extract("bare", named, 2)).otherwise(F.col("bare")).alias("value"),
            F.when(F.col("bare").rlike(named), F.regexp_extract("bare", named, 1))
            .when(sign, F.element_at("near", 2))
            .when(F.element_at("near", 3).rlike(r"[:=]>?$") | F.col("with_sign"), F.element_at("near", 3))
            .otherwise(F.lit(""))
            .alias("path"),
            F.transform("near", lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}]", "")).alias("near"),
        )
    ).withColumn("cid", F.monotonically_increasing_id())


def dictionary(docs: DataFrame, share: float = WORD_SHARE, least: int = LEAST_TEXTS) -> DataFrame:
    """Lower-case words of 3 to 20 letters and the number ``n`` of distinct texts that hold them outside candidates.

    Kept where ``n`` is at least ``share`` of all distinct texts, and ``least``. Each of m equal texts counts 1 / m.
    """
    keyed = docs.filter(F.col("text").isNotNull()).select("text", F.md5(F.col("text").cast("binary")).alias("h"))
    equal = cut(keyed.groupBy("h").agg(F.count("*").alias("m")).groupBy(F.when(F.col("m") > 1, F.col("h")).alias("copied")).agg(F.max("m").alias("m"), F.count("*").alias("texts")))
    distinct = equal.agg(F.sum("texts")).first()[0] or 0
    copied = equal.filter("copied is not null").select("copied", "m")
    outside = let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda ws: F.array_join(F.filter(ws, lambda w, i: ~looks(ws, w, i)), " "))
    rest = F.lower(F.when(may_hold_secret(F.col("text")), outside).otherwise(F.col("text")))
    each = keyed.join(broadcast_if_small(copied), F.col("h") == F.col("copied"), "left").select(rest.alias("text"), (1 / F.coalesce("m", F.lit(1))).alias("part"))
    words = each.select("part", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}{3,20}"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.round(F.sum("part")).cast("long").alias("n")).filter(F.col("n") >= max(least, share * distinct))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the numbers of ``NUMBERS`` to each candidate.

    ``bigrams``: mean log probability of the value's character pairs under those of the dictionary (letters as they are, all
    digits alike, all else alike: at most 28 x 28 pairs, so that table is broadcast). ``coverage``: share of the value's characters
    in runs of letters that are dictionary words; runs meet the dictionary in a shuffled join.
    """
    words = cut(words)
    runs = found.select("cid", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"\p{L}{3,20}"), F.lit(0))).alias("word"))
    covered = runs.join(words, "word").groupBy("cid").agg(F.sum(F.length("word")).alias("covered"))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[0-9]", "0"), r"[^a-z0]", ".")
    pairs = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))
    seen = words.select(plain(F.col("word")).alias("w"), "n").select("n", pairs(F.col("w")).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    first = seen.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("first_n"))
    odds = cut(
        seen.withColumn("first", F.substring("pair", 1, 1)).join(first, "first").select("pair", F.log10((F.col("n") + 0.5) / (F.col("first_n") + 14)).alias("odds"))
    )
    scored = (
        found.select("cid", plain(F.col("value")).alias("w")).filter(F.length("w") > 1).select("cid", pairs(F.col("w")).alias("pair"))
        .join(F.broadcast(odds), "pair", "left").groupBy("cid").agg(F.avg(F.coalesce("odds", F.lit(-4.0))).alias("bigrams"))
    )
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1))
    only = lambda p: F.length(F.regexp_replace(v, p, ""))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.join(covered, "cid", "left").join(scored, "cid", "left").select(
        "cid", "doc_id", "text_key", "word_no", "value", "path", "near",
        F.length(v).cast("double").alias("length"),
        (F.regexp_count(v, F.lit(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")) / n).alias("transitions"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("distinct"),
        (only("[^0-9]") / n).alias("digits"),
        (only("[^A-Z]") / n).alias("capitals"),
        F.coalesce("bigrams", F.lit(-4.0)).alias("bigrams"),
        (F.coalesce("covered", F.lit(0)) / n).alias("coverage"),
        F.size(F.filter(F.split("path", r"[./_\-]"), lambda x: x != "")).cast("double").alias("path_depth"),
        flag(F.col("path").rlike(SECRET_NAMES)).alias("path_secret"),
        flag(F.col("path").rlike(SAMPLE_NAMES)).alias("path_sample"),
        F.regexp_count(v, F.lit("[/@.]")).cast("double").alias("slashes"),
        flag(F.exists("near", lambda w: w.rlike(SECRET_NAMES))).alias("near_secret"),
    )


def rule_labels(found: DataFrame) -> DataFrame:
    """Adds ``label`` where a finding's kind is beyond doubt: 1 for key formats and random values given to a secret's name,
    0 for addresses, numbers, dates and words; null for all else. Stands in for a table of reviewed findings."""
    v = F.col("value")
    yes = v.rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,})$") | (
        F.col("path").rlike(SECRET_NAMES) & v.rlike(r"^[A-Za-z0-9+/_=\-]{12,}$") & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.col("coverage") < 0.5)
    )
    no = v.rlike(r"^[0-9.,:/()+\-]+$") | v.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$") | v.rlike(r"(?i)^(https?:)?//|^www\.") | (F.col("coverage") >= 0.8)
    return found.withColumn("label", F.when(yes, F.lit(1.0)).when(no, F.lit(0.0)))


def vectors(found: DataFrame) -> DataFrame:
    hashed = HashingTF(inputCol="near", outputCol="near_vector", numFeatures=NEIGHBOUR_BUCKETS, binary=True).transform(found)
    return VectorAssembler(inputCols=[*NUMBERS, "near_vector"], outputCol="features").transform(hashed)


def fit_forest(labelled: DataFrame, most: int = MOST_TRAINING, trees: int = 24, depth: int = 7, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest from ``labelled`` (features of ``features`` and ``label`` 0 or 1).

    Fitted on at most about ``most`` findings of each label, chosen by the hash of their number. None if a label is missing.
    """
    rows = labelled.filter(F.col("label").isNotNull())
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    chance = F.pmod(F.xxhash64(F.lit(seed), "cid"), F.lit(1_000_000)) / 1_000_000.0
    share = F.when(F.col("label") == 1, min(1.0, most / counts[1.0])).otherwise(min(1.0, most / counts[0.0]))
    balance = F.when(F.col("label") == 1, 0.5 / counts[1.0]).otherwise(0.5 / counts[0.0]) * sum(counts.values())
    sample = cut(vectors(rows.filter(chance < share).withColumn("weight", balance)).select("features", "label", "weight"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", subsamplingRate=0.8).fit(sample)


def rule_verdict() -> Column:
    """Score 1 or 0 without a forest: the label of ``rule_labels``, and where that is null 1 for what a secret's name is given,
    or random values beside such a name; 0 for samples and all else."""
    named = (F.col("path_secret") == 1) | ((F.col("near_secret") == 1) & (F.col("digits") > 0) & (F.col("length") >= 12) & (F.col("coverage") < 0.5))
    return F.coalesce(F.col("label"), (named & (F.col("path_sample") == 0)).cast("double"))


def scan(docs: DataFrame, labels=rule_labels, threshold: float = 0.5) -> DataFrame:
    """Findings of ``docs``: ``doc_id, text_key, word_no, value, path, score, held_out, label, is_secret``.

    ``labels`` adds the labels the forest learns from (a join with reviewed findings, or ``rule_labels``); findings whose value's crc32
    modulo 5 is 0 are held out. Where a label is missing the forest can't be fitted: then the score is the verdict of ``rule_verdict``.
    """
    found = cut(features(candidates(docs), dictionary(docs)))
    labelled = labels(found).withColumn("held_out", F.crc32(F.col("value").cast("binary")) % 5 == 0)
    forest = fit_forest(labelled.filter(~F.col("held_out")))
    if forest is None:
        scored = labelled.withColumn("score", rule_verdict())
    else:
        scored = forest.transform(vectors(labelled)).withColumn("score", vector_to_array("probability")[1])
    out = scored.select("doc_id", "text_key", "word_no", "value", "path", "score", "held_out", F.col("label").cast("int").alias("label"))
    return out.withColumn("is_secret", F.col("score") >= threshold)


def redact(docs: DataFrame, findings: DataFrame, mark: str = MARK, length_column: str = "n_chars") -> DataFrame:
    """``docs`` with each secret's value replaced by ``mark``; the same rows and columns.

    Texts meet their secrets by md5, so equal texts are treated alike and ids may be null or repeat. Only texts that may hold a
    secret are shuffled; a text without findings is unchanged. ``length_column``, where there is one, follows a changed text.
    """
    secrets = findings.filter("is_secret").groupBy("text_key").agg(F.collect_set("value").alias("secret_values")).withColumnRenamed("text_key", "secret_key")
    columns = docs.columns
    clear = docs.filter(~may_hold_secret(docs["text"]))
    touched = docs.filter(may_hold_secret(docs["text"]))
    joined = touched.join(secrets, F.md5(touched["text"].cast("binary")) == secrets["secret_key"], "left")
    longest_first = F.reverse(F.sort_array(F.transform(secrets["secret_values"], lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
    marked = F.aggregate(longest_first, touched["text"], lambda t, s: F.replace(t, s["v"], F.lit(mark)))
    hit = secrets["secret_key"].isNotNull()
    new = {"text": F.when(hit, marked).otherwise(touched["text"])}
    if length_column in columns:
        kind = docs.schema[length_column].dataType
        new[length_column] = F.when(hit, F.length(marked).cast(kind)).otherwise(touched[length_column])
    return joined.select(*[new[c].alias(c) if c in new else touched[c] for c in columns]).unionByName(clear)
