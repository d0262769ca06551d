import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import truncation

SUBJECTS = ["the keeper", "our warehouse", "every auditor", "the night shift", "a second pack", "the old ledger"]
VERBS = ["counted", "stored", "released", "compared", "rejected", "restored"]
OBJECTS = ["seventeen parcels", "the whole archive", "forty green boxes", "all invoices", "its own manifest", "the paper trail"]
ENDS = ["before sunrise", "without any warning", "on the same afternoon", "for the third time", "while nobody watched", "after the long meeting"]


def sentence(rng):
    return f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(VERBS)} {rng.choice(OBJECTS)} {rng.choice(ENDS)}{rng.choice('..!?')}"


def name(rng):
    return "".join(rng.choice(["ka", "lo", "mi", "ru", "ven", "tor"]) for _ in range(4))


def world(n=1200, limit=180):
    """Texts of three sources; `mail` is cut at a limit, `wiki` in transfer, `log` never; and the ids of cut ones."""
    rng = random.Random(6)
    rows, cut = [], set()
    for i in range(n):
        source = ["mail", "wiki", "log"][i % 3]
        text = rng.choice([" ", "\n\n"]).join(sentence(rng) for _ in range(rng.randint(2, 7)))
        text += rng.choice(["", "", "\n\nOwner: " + name(rng), "\n- check the seals\n- close the drill", ' (They said "yes.")'])
        whole = text
        if source == "mail" and len(text) > limit:
            text = text[:limit]
        elif source == "wiki" and rng.random() < 0.06:
            text = text[: rng.randint(20, len(text) - 12)]
        stripped = text.rstrip()
        inside = len(text) < len(whole) and stripped[-1] not in '.!?")' and not whole[len(stripped) :].startswith("\n") and "Owner:" not in stripped[-24:] and "\n- " not in stripped[-20:]
        if len(text) < len(whole) and not inside:
            text = whole if source == "wiki" else sentence(rng)
        elif inside:
            cut.add(i)
            text += rng.choice(["", "", "…", " [message truncated]", "\n\n"])
        rows.append((i, text, rng.choice([source, source.upper()])))
    return rows, cut


def test_cut_texts_are_found(spark):
    rows, cut = world()
    df = spark.createDataFrame([*rows, (9001, None, "mail"), (9002, "", "mail"), (9003, " \n\t", None)], "doc_id long, text string, source string").withColumns({"open": F.lit(1), "keys": F.lit(2), "tail": F.lit(3)})
    found = truncation.cut_texts(df)
    got = {r.doc for r in found.filter("cut").collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 0.02 * len(cut) + 1
    assert found.filter("doc > 9000").count() == 0
    assert {r.source for r in found.select("source").distinct().collect()} == {"mail", "wiki", "log"}


def test_limits_are_significant_and_others_are_not(spark):
    rng = random.Random(2)
    rows = [("a", 0, rng.randint(50, 400)) for _ in range(4000)] + [("a", 0, 255)] * 120 + [("b", 0, rng.randint(50, 400)) for _ in range(4000)]
    found = truncation.significant_lengths(spark.createDataFrame(rows, "source string, measure int, length int"))
    assert [tuple(r) for r in found.collect()] == [("a", 0, 255)]
    assert truncation.significant_lengths(spark.createDataFrame([], "source string, measure int, length int")).count() == 0


@pytest.mark.parametrize(
    ("text", "body", "mark"),
    [("abc…", "abc", "…"), ("abc [Message 12 truncated]\n", "abc", "[message 0 truncated]"), ("abc...", "abc", "..."), ("abc....", "abc.", "..."), ('"Done."', '"Done."', None), ("abc. ", "abc.", None), ("a [clipped] b", "a [clipped] b", None), ("abc (end)", "abc", "(end)")],
)
def test_what_may_be_a_mark(text, body, mark):
    assert truncation.parted(text) == (body, mark)


def test_closers_go():
    assert truncation.closed('He said "Done." \n') == 'He said "Done.'
    assert truncation.closed("a (b)") == "a (b)"


def test_marks_are_learnt_from_the_lengths_before_them(spark):
    rng = random.Random(11)
    texts = [" ".join(sentence(rng) for _ in range(rng.randint(2, 7))) for _ in range(900)]
    cut = [(i, t[:150].rstrip() + " <more>", "mail") for i, t in enumerate(texts) if len(t) > 150 and t[149].isalnum() and t[150].isalnum()]
    whole = [(5000 + i, t + " (end)", "mail") for i, t in enumerate(texts)]
    df = spark.createDataFrame(cut + whole, "doc_id long, text string, source string")
    found = truncation.cut_texts(df)
    assert found.filter("doc < 5000 AND cut").count() == len(cut) and found.filter("mark").count() == len(cut)
    assert found.filter("doc >= 5000 AND cut").count() == 0


def test_last_units_of_unusual_length_are_significant(spark):
    rows = [("a", 1, 12, 400, 3000), ("a", 1, 14, 300, 2500), ("a", 2, 3, 30, 0), ("a", 2, 12, 2, 0), ("b", 1, 12, 300, 3000), ("b", 2, 3, 2, 0), (None, 2, 3, 40, 0), (None, 1, 3, 60, 900)]
    found = truncation.significant_units(spark.createDataFrame(rows, "source string, kind long, tokens long, last long, inner long"))
    assert {tuple(r) for r in found.collect()} == {("a", 2, 3), ("a", 2, 12), (None, 2, 3)}
    assert truncation.significant_units(spark.createDataFrame([], "source string, kind long, tokens long, last long, inner long")).count() == 0


def test_every_cut_text_has_a_significant_length(spark):
    rows, _ = world()
    found = truncation.cut_texts(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert found.filter("cut AND NOT (limit OR unit OR mark)").count() == 0 and found.filter("cut AND unit AND NOT limit").count() > 0


def test_copies_of_a_cut_text_do_not_make_it_complete(spark):
    rows, _ = world(600)
    again = [(5000 + k, "The keeper counted seventeen par", "wiki") for k in range(200)]
    df = spark.createDataFrame([*rows, *again], "doc_id long, text string, source string")
    assert truncation.cut_texts(df).filter("doc >= 5000 AND cut").count() == 200


def test_small_and_empty_corpora(spark):
    df = spark.createDataFrame([(1, "x" * 200_000, "a"), (2, "One line.", None)], "doc_id long, text string, source string")
    assert truncation.cut_texts(df).count() == 2
    assert truncation.cut_texts(df.limit(0)).count() == 0


def test_a_token_stream_is_read_alike_from_its_end():
    tokens = truncation.Tokens(frozenset({"the", "keeper"}))
    text = "the keeper of 12 boxes, id 9f3a2b. " * 60 + "the keeper"
    assert truncation._tail(tokens, text) == tokens.read(text)[-4:]


def test_shares_per_source(spark, sf):
    from tidemark.llm.queries import p8_by_source, p8_found

    by = p8_by_source(spark, sf).collect()
    assert sum(r.cut_documents for r in by) == p8_found(spark, sf).count()
    assert all(0 <= r.share <= 1 for r in by)
