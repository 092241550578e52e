"""Exact duplicates against brute force: odd rows, white space, ties, large groups, and filters so small that all keys share bits."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barwave.llm import exact_dedup
from tests.llm.test_llm import none, odd, pairs_of, texts  # noqa: F401


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("bits", [exact_dedup.ROW_BITS, exact_dedup.FILTER_BITS])
def test_against_brute_force(odd, none, bits):  # noqa: F811
    got = exact_dedup.exact_groups(odd, digest_all=True, filter_bits=bits).cache()
    assert found(got) == brute(pairs_of(odd))
    kept = got.filter("kept").groupBy("text_sha256").count()
    assert kept.filter("count > 1").isEmpty() and kept.count() == got.select("text_sha256").distinct().count()
    assert exact_dedup.exact_groups(none).count() == 0


def test_whole_texts_are_read_only_where_length_and_start_repeat(spark):
    same = "x" * 64
    rows = [(1, same + "one"), (2, same + "two"), (3, same + "one"), (4, "alone"), (5, "y" * 67), (6, same + "longer"), (7, same + "one\t"), (8, same + "one ")]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [d for d in sorted(got) if got[d]["text_sha256"]] == [1, 2, 3, 7, 8]
    assert [got[d]["keep_id"] for d in range(1, 9)] == [1, 2, 1, 4, 5, 6, 7, 7]
    assert [d for d in sorted(got) if got[d]["kept"]] == [1, 2, 4, 5, 6, 7]


def test_a_group_of_a_third_of_the_rows(spark):
    df = spark.range(6000).select((5999 - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same  text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    assert found(exact_dedup.exact_groups(df, digest_all=True)) == brute(pairs_of(df))
