"""What has no letter has no language: superscripts, fractions and circled digits are none."""

import random

from pyspark.sql import functions as F

from barwave.llm import language_id
from tests.llm.test_llm import sentence


def test_only_letters_count(spark):
    rng = random.Random(3)
    rows = [(str(i), sentence(rng, lang, 60), lang) for i in range(40) for lang in ("en", "fr")]
    net = language_id.learn(spark.createDataFrame(rows, "key string, text string, lang string"))
    texts = ["²³ ½ ①②", "123 ___ ---", "ª", "²³ x", "中", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r["p"]["lang_pred"] for r in df.select("i", language_id.identify(F.col("text"), net).alias("p")).orderBy("i").collect()]
    assert [g == language_id.UNKNOWN for g in got] == [True, True, False, False, False, True]
