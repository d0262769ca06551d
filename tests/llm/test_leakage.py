import random

import pytest

from tidemark.llm import leakage

WORDS = [f"{a}{b}{c}" for a in ("br", "st", "k", "qu") for b in "aeiou" for c in ("n", "lt", "rm")]


def brute(documents, items, n=12):
    at = {}
    for i, x in items:
        w = leakage.normal_words(x)
        for k in range(len(w) - n + 1):
            at.setdefault(tuple(w[k : k + n]), set()).add(i)
    found = set()
    for d, x in documents:
        w = leakage.normal_words(x)
        for k in range(len(w) - n + 1):
            found |= {(d, i) for i in at.get(tuple(w[k : k + n]), ())}
    return found


def world(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 40)))) for i in range(20)] + [(90, None), (91, ""), (92, "too short"), (0, "repeated id " + " ".join(WORDS[:14]))]
    documents = []
    for d in range(120):
        words = [rng.choice(WORDS) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.5:
            source = rng.choice(items[:20])[1].split()
            k = rng.randint(0, max(0, len(source) - 11))
            piece = source[k : k + rng.choice([10, 11, 12, 13, 20])]
            if rng.random() < 0.3 and piece:
                piece[rng.randrange(len(piece))] += "x"
            words[len(words) // 2 : len(words) // 2] = piece
        text = rng.choice([" ", "\n", ", "]).join(words)
        if rng.random() < 0.3:
            text = text.upper().replace("A", "Ａ").replace("N", "N​")
        documents.append((d, text))
    return documents + [(500, None), (501, ""), (502, " \n")], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_passages_match_brute_force(spark, seed):
    documents, items = world(seed)
    d = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS doc", "2 AS item", "3 AS edits")
    i = spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_passages(d, i, "doc_id", "item_id").filter("edits = 0").collect()}
    assert got == brute(documents, items) and got


def test_edited_passages_are_found_with_their_edits(spark):
    item = "the harbour keeper counted every grey lantern twice before closing the northern archive gate again"
    edited = item.replace("grey", "gray").replace("lantern", "lanten")
    d = spark.createDataFrame([(1, f"prefix words {item} suffix"), (2, f"so {edited} indeed"), (3, "nothing of the kind"), (4, item.replace("every", "nearly all of the"))], "doc_id long, text string")
    got = {r.doc_id: r.edits for r in leakage.leaked_passages(d, spark.createDataFrame([(7, item)], "item_id long, text string"), "doc_id", "item_id").collect()}
    assert got == {1: 0, 2: 2}


def test_edits_match_a_full_table():
    def full(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(row[j - 1] if c == x else 1 + min(row[j], row[j - 1], new[j - 1]))
            row = new
        return min(row)

    rng = random.Random(8)
    for _ in range(300):
        p, t = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(2))
        assert leakage.least_edits(p, t, 3) == min(full(p, t), 4)


def test_forms_that_do_not_matter():
    assert leakage.normal_words("Ｆｕｌｌ WIDTH, soft­hyphen zero​width ﬁne\n\tStraße ①") == leakage.normal_words("full-width softhyphen zerowidth fine STRASSE 1")
    assert leakage.normal_words(None) == leakage.normal_words("…!") == []


def test_many_items_go_in_blocks_and_budgets_are_checked(spark, monkeypatch):
    documents, items = world(4)
    d, i = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in leakage.leaked_passages(d, i, "doc_id", "item_id").collect()}
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    assert {tuple(r) for r in leakage.leaked_passages(d, i, "doc_id", "item_id").collect()} == whole
    monkeypatch.setattr(leakage, "PART_CHARS", 40)
    assert {tuple(r) for r in leakage.leaked_passages(d, i, "doc_id", "item_id").collect()} == whole
    with pytest.raises(ValueError):
        leakage.leaked_passages(d, i, "doc_id", "item_id", edits=25)
    assert leakage.leaked_passages(d.limit(0), i, "doc_id", "item_id").count() == 0
    assert leakage.leaked_passages(d, i.limit(0), "doc_id", "item_id").count() == 0


def test_a_hundred_blocks_take_one_scan_of_the_corpus(spark, monkeypatch):
    documents, items = world(5)
    more = items[:20] * 1 + [(1000 + k, " ".join(random.Random(k).choices(WORDS, k=30))) for k in range(130)]
    d, i = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(more, "item_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 120)
    monkeypatch.setattr(leakage, "SLICE_CHARS", 2_000)
    assert len(list(leakage._blocks(iter(more), 12, 0))) >= 100
    found = leakage.leaked_passages(d, i, "doc_id", "item_id", edits=0)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(documents, more)


def test_short_passages_do_not_stop_others(spark):
    letters = "a b c d e f g h i j k l m n"
    d = spark.createDataFrame([(1, f"x y {letters} z"), (2, f"so {' '.join(WORDS[:15])} on"), (3, "b c d e f g h q j k l m"), (4, "a b c")], "doc_id long, text string")
    i = spark.createDataFrame([(7, letters), (8, " ".join(WORDS[:20]))], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked_passages(d, i, "doc_id", "item_id", edits=0).collect()} == {(1, 7, 0), (2, 8, 0)}
    assert {tuple(r) for r in leakage.leaked_passages(d, i, "doc_id", "item_id").collect()} == {(1, 7, 0), (2, 8, 0), (3, 7, 1)}


def test_texts_that_repeat_themselves(monkeypatch):
    monkeypatch.setattr(leakage, "HITS", 1_000)
    long = leakage.joined(["a"] * 3_000)
    index = leakage.ItemIndex([(1, ["a"] * 40), (2, ["b"] + ["a"] * 20), (3, ["a"] * 6 + ["c"] * 7)], 8, 12, 2)
    assert sorted(index.matches([leakage.joined(["x"] * 12), long])) == [(1, 0, 0), (1, 1, 0)]
    near = leakage.joined(["a"] * 300 + ["ab"] + ["a"] * 3)
    assert sorted(index.matches([near, leakage.joined(["b", "a"] * 9)])) == [(0, 0, 0), (0, 1, 0)]


def test_a_very_long_text(spark):
    item = " ".join(WORDS[:20])
    text = "filler words here " * 60_000 + item + " and more" * 1000
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert leakage.leaked_passages(d, spark.createDataFrame([(7, item)], "item_id long, text string"), "doc_id", "item_id").collect()[0].edits == 0


def test_the_data(spark, sf):
    from tidemark.llm.queries import p7_found

    read = lambda n, k: [(r[k], r.text) for r in spark.read.parquet(f"{sf}/{n}.parquet").collect()]
    assert {tuple(r) for r in p7_found(spark, sf).collect()} == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_what_is_broadcast_needs_no_import_of_this_package():
    import pickle

    index = leakage.ItemIndex([(1, WORDS[:20])], 12, leakage.WORDS, 1)
    state = pickle.dumps(vars(index))
    assert b"tidemark" not in state
    again = leakage.ItemIndex.restored(pickle.loads(state))
    assert list(again.matches([leakage.joined(WORDS[:20])])) == [(0, 0, 0)]  # the first text, the first item, no edits
