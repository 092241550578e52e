"""Stages on whole texts pass them on in small batches, however long they are."""

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from barwave.llm.word_tokenizer import WordTokenizer


def test_batches_are_small(spark):
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    docs = spark.createDataFrame([(i, chr(97 + i) * 1_000_000, "en") for i in range(20)], "doc_id long, text string, lang string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    try:
        for stage in (corpus_pipeline.keep_known_language, corpus_pipeline.keep_one_of_near_duplicates):
            spark.conf.set(conf, before)
            stage(spark, docs.limit(0), "")
            got = [r["n"] for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
            assert sum(got) >= 20_000_000 and max(got) < 6_000_000
    finally:
        spark.conf.set(conf, before)


def test_few_words_are_kept():
    """Ids don't depend on how many words a worker remembers."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}word and more" for i in range(600))
    few, many = WordTokenizer(path, True, keep=20), WordTokenizer(path, True)
    assert few.encode(text) == many.encode(text)
    assert max(len(w) for w in (few.words, few.words.old, few.pieces, few.pieces.old)) <= 20 < len(many.words)
    assert corpus_pipeline.KEEP_WORDS <= 100_000
