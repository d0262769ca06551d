import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return tokens.load_ranks()


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=tokens.WORDS, mergeable_ranks=ranks, special_tokens={})


def samples():
    rng = random.Random(4)
    alphabet = ["a", "b", " ", "th", "e", "\n", "\t", "1", "é", "漢", "🙏", "=", "'s", "́", "​", "<|endoftext|>"]
    yield from ("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400))
    yield from ["", " ", "   x", "a" * 3000, "=" * 2000, "漢" * 700, " \n \n", "it's they'LL"]


def test_words_are_merged_as_by_the_reference(ranks, reference):
    import regex

    for text in samples():
        assert [i for w in regex.findall(tokens.WORDS, text) for i in tokens.merge_word(w.encode(), ranks)] == reference.encode_ordinary(text)


def test_every_single_byte_and_pair(ranks):
    for a in range(256):
        assert tokens.merge_word(bytes([a]), ranks) == [ranks[bytes([a])]]
        for b in range(0, 256, 17):
            pair = bytes([a, b])
            assert tokens.merge_word(pair, ranks) == ([ranks[pair]] if pair in ranks else [ranks[bytes([a])], ranks[bytes([b])]])


def test_long_words_take_no_quadratic_time(ranks):
    import time

    took = []
    for n in (20_000, 160_000):
        word = bytes(random.Random(1).choice(b"abcdefghij") for _ in range(n))
        began = time.process_time()
        out = tokens.merge_word(word, ranks)
        took.append(time.process_time() - began)
        inverse = {v: k for k, v in ranks.items()}
        assert b"".join(inverse[i] for i in out) == word
    assert took[1] < 24 * took[0] + 0.5


def test_texts_of_a_table(spark, reference):
    rows = [(i, x, "clash", [1]) for i, x in enumerate(samples())] + [(-1, None, None, None), (0, "", None, None), (-2, "x" * 300_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k0 string, ids array<int>").repartition(3)
    got = sorted((r.doc_id, tuple(r.ids)) for r in tokens.encode_texts(df, ["doc_id"], "text").collect())
    assert got == sorted((i, tuple(reference.encode_ordinary(x or ""))) for i, x, *_ in rows)
    assert tokens.encode_texts(df.limit(0), ["doc_id"], "text").count() == 0


def test_texts_of_the_data(spark, sf, reference):
    from tidemark.llm.queries import p6_ids

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = p6_ids(spark, sf).collect()
    assert len(got) == len(texts) and all(r.ids == reference.encode_ordinary(texts[r.doc_id] or "") for r in got)
    assert p6_ids(spark, sf).filter(F.col("ids").isNull()).count() == 0
