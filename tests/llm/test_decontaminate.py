import re

from trawl.llm.decontaminate import contaminated
from trawl.session import table

ITEM = "If Alice buys 12 apples for 3 dollars and Bob sells 12 pears, how many coins does Alice keep in total?"


def found(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.covered_words, r.reparameterised) for r in contaminated(docs, bench).collect()}


def test_copies_parameters_and_consistency(spark):
    texts = [
        "Some text before. " + ITEM + " And after.",
        ITEM.upper(),
        ITEM.replace("12", "7").replace("Alice", "Carol").replace("Bob", "Dan").replace("3 dollars", "9 euros"),
        ITEM.replace("12 apples", "7 apples").replace("12 pears", "8 pears").replace("Alice keep", "Eve keep"),
        "Completely unrelated words about the weather and the sea with 12 boats and 3 gulls near Alice today.",
        None, "", "short tale",
    ]
    got = found(spark, texts, [ITEM, None, "", "short tale"])
    assert got[(0, 0)] == (21, False) and got[(1, 0)] == (21, False)
    assert got[(2, 0)][1] is True
    assert (3, 0) not in got  # one number became two, one name another
    assert (4, 0) not in got
    assert got[(7, 3)] == (2, False)
    assert set(got) == {(0, 0), (1, 0), (2, 0), (7, 3)}


def test_names_that_open_sentences(spark):
    item = "Tom has 12 apples. Ann takes 5. How many are left?"
    texts = [
        "Eve has 7 apples. Sue takes 3. How many are left?",
        "We read: eve said that Eve has 7 apples. Sue takes 3. how many are left?",
        "Eve has 7 apples. Eve takes 3. How many are left?",
        "Eve has 7 apples. Sue takes 7. How many are left?",
        item,
    ]
    got = found(spark, texts, [item])
    assert {k: v[1] for k, v in got.items()} == {(0, 0): True, (1, 0): True, (4, 0): False}
    assert got[(0, 0)][0] == got[(4, 0)][0] == 11


def test_an_opening_word_that_is_no_name_breaks_nothing(spark):
    item = ITEM + " The rest of the fruit is given to the poor. The end."
    text = ITEM.replace("12", "7").replace("Alice", "Carol").replace("Bob", "Dan") + " This rest of the fruit is given to the poor. The end."
    assert found(spark, [text], [item])[(0, 0)][0] >= 21


def test_short_and_dense_items(spark):
    items = [
        "What is 12 plus 7 times 3 in total?",
        "Mix 3 g, 5 ml, 7 kg and 9 cm for Ann, Bob, Eve, then stir 4 minutes until done.",
        "Add 11 12 13 14 15 16 17 18 19 20 21 22 23 24 11 now please my dear old friend.",
    ]
    texts = [
        "Well. What is 9 plus 8 times 2 in total? Say.",
        "Mix 2 g, 6 ml, 8 kg and 1 cm for Tim, Dan, Sue, then stir 5 minutes until done.",
        "Add 31 32 33 34 35 36 37 38 39 40 41 42 43 44 31 now please my dear old friend.",
        "Add 31 32 33 34 35 36 37 38 39 40 41 42 43 44 45 now please my dear old friend.",
        "What is 12 plus 7 times 3 in total?",
        "51 52 53 54 55 56 57 58 59 60 61 62 63 64 65 66 67 68 69 70 and 3 g for Ann, Bob",
    ]
    got = found(spark, texts, items)
    assert {k: v[1] for k, v in got.items()} == {(0, 0): True, (1, 1): True, (2, 2): True, (4, 0): False}
    assert got[(0, 0)][0] == 9 and got[(1, 1)][0] == 20 and got[(2, 2)][0] == 22


def test_empty_tables(spark):
    assert found(spark, [], [ITEM]) == {}
    assert found(spark, [ITEM], []) == {}


def test_repeated_rows_give_one_pair(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, ITEM), (5, ITEM)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in contaminated(docs, bench).collect()) == [(0, 5), (1, 5)]


def test_documents_by_brute_force(spark):
    from trawl.llm.q_decontaminate import query

    sf = "/root/testdata/sf0.01"
    core = lambda w: re.sub(r"^[^\wÀ-ÿ]+|[^\wÀ-ÿ]+$", "", w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) or w
    words = lambda t: [core(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    grams = {}
    for r in table(spark, sf, "benchmark").collect():
        w = words(r.text)
        for i in range(len(w) - 7):
            grams.setdefault(tuple(w[i : i + 8]), set()).add(r.item_id)
    want = set()
    for r in table(spark, sf, "documents").collect():
        w = words(r.text)
        for i in range(len(w) - 7):
            want |= {(r.doc_id, k) for k in grams.get(tuple(w[i : i + 8]), ())}
    got = {(r.doc_id, r.item_id) for r in query(spark, sf).collect()}
    assert want and got == want


def test_changed_values_beside_unchanged_words(spark):
    item = "A train leaves the old station of Boston at 60 miles an hour and arrives after 3 hours of quiet travel, so how far did it go in total?"
    texts = [
        item.replace("Boston", "Denver").replace("60", "70").replace("3 hours", "5 hours"),  # literal windows agree, values don't
        item.replace("Boston", "New York").replace("60", "70"),  # a name of two words is one value
        item,
        "He says so how far did it go in total? Nobody knows.",  # a literal window alone
    ]
    got = found(spark, texts, [item])
    assert {k: v[1] for k, v in got.items()} == {(0, 0): True, (1, 0): True, (2, 0): False, (3, 0): False}
    assert got[(0, 0)][0] == got[(1, 0)][0] == got[(2, 0)][0] == 29 and got[(3, 0)][0] == 8


def test_other_languages_and_capitals(spark):
    items = [
        "Am Montag läuft Élodie sieben Kilometer in zwei Stunden und danach noch drei weitere bis nach Hause.",
        "Ayer compró doce litros de leche para Óscar y gastó nueve euros en total durante dos días seguidos.",
    ]
    texts = [
        "Am Dienstag läuft Àgnes neun Meilen in vier Tagen und danach noch fünf weitere bis nach Hause.".replace("Meilen", "km"),
        "Ayer compró diez kilómetros de leche para Álvaro y gastó siete euros en total durante tres semanas seguidos.",
    ]
    assert {k: v[1] for k, v in found(spark, texts, items).items()} == {(0, 0): True, (1, 1): True}
