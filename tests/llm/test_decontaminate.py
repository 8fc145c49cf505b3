import random

from tamarack.llm import decontaminate

from . import brute

ITEM = "A train leaves the station with 120 people and travels 45 km before it stops, where Alice gets off with 3 bags of corn."
FILL = "nothing of note was said about the weather in that part of the land for many years and so on"


def found(spark, documents, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.hits(documents(rows, extra=True), bench).collect()}


def test_same_passage_and_other_values_are_met(spark, documents):
    other = ITEM.replace("120", "87").replace("45 km", "12 miles").replace("Alice", "Bob").replace("3", "9")
    rows = [(1, f"{FILL}. {ITEM} {FILL}"), (2, f"{FILL}. {other}"), (3, FILL), (4, None), (5, ""), (6, ITEM.replace(" ", "\n")), (None, ITEM)]
    assert found(spark, documents, rows, [(1, ITEM), (1, ITEM), (2, None), (3, "")]) == {(1, 1), (2, 1), (6, 1), (None, 1)}


def test_slots_must_agree(spark, documents):
    item = "take 5 of the red ones and 5 of the blue ones then add 7 more of the green ones to these"
    good, bad = item.replace("5", "8").replace("7", "2"), item.replace("5 of the red", "8 of the red").replace("7", "2")
    assert found(spark, documents, [(1, good), (2, bad)], [(1, item)]) == {(1, 1)}


def test_short_items_and_clean_documents(spark, documents):
    rows = [(1, "who wrote this"), (2, "someone asked who wrote this yesterday"), (3, "who read this"), (4, FILL)]
    assert found(spark, documents, rows, [(1, "Who wrote this?")]) == {(1, 1), (2, 1)}


def test_blocks_give_the_same(spark, documents):
    bench = spark.createDataFrame([(i, f"{ITEM} {FILL} number {w}") for i, w in enumerate("abc")], "item_id long, text string")
    docs = documents([(1, f"{ITEM} {FILL} number b"), (2, FILL)])
    one = sorted(map(tuple, decontaminate.hits(docs, bench).collect()))
    assert one and one == sorted(map(tuple, decontaminate.hits(docs, bench, block=7).collect()))


def test_empty_tables(spark, documents):
    assert found(spark, documents, [], [(1, ITEM)]) == set()
    docs = documents([(1, ITEM)])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(docs, none).count() == 0
    assert decontaminate.without_leaks(docs, none).count() == 1


def test_filter_keeps_columns(spark, documents):
    docs = documents([(1, ITEM), (2, FILL), (None, None)], extra=True)
    out = decontaminate.without_leaks(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {2, None}


def test_copies_in_other_letter_case(spark, documents):
    german = "Im Jahr 1905 fand Einstein in Bern die Gleichung für die Energie und maß danach 12 Meter Draht in der Werkstatt."
    rows = [(1, f"{FILL} {ITEM.upper()}"), (2, ITEM.lower()), (3, ITEM.title()), (4, german), (5, german.replace("1905", "1931").replace("12", "40")), (6, german.lower()), (7, FILL)]
    assert found(spark, documents, rows, [(1, ITEM), (2, german)]) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2)}


def test_all_windows_against_all(spark, documents):
    """Texts made of parts of items with other values, other case and gaps."""
    rng = random.Random(12)
    words = ["the", "red", "of", "and", "box", "in", "Tom", "Anna", "Paris", "7", "12", "3.5", "km", "metre", "dollars", "holds", "was", "Über", "straße"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 4, 5, 9, 20]))) + rng.choice(["", ".", "?"])) for i in range(25)]
    items += [(100, None), (101, ""), (102, items[3][1])]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 3)):
            item = rng.choice(items)[1] or ""
            part = item.split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = rng.choice(words)
            if rng.random() < 0.3:
                part = [{"7": "12", "12": "7", "Tom": "Anna", "Anna": "Tom"}.get(w, w) for w in part]
            parts += rng.choice([str, str, str.upper, str.lower])(" ".join(part)).split(" ") + [rng.choice(words)]
        rows.append((i, " ".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.hits(documents(rows), bench).collect()}
    want = brute.leaks(rows, items)
    assert len(want) > 30 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_windows_that_many_items_share(spark, documents):
    """Items that differ in their last words only: each is found in its own copies."""
    items = [(i, f"which of these people did the work in the town before the year was over and who was item{chr(97 + i)} then") for i in range(20)]
    rows = [(i, f"{FILL} {t}") for i, t in items] + [(100, "which of these people did the work in the town")]
    got = found(spark, documents, rows, items)
    assert {(i, i) for i in range(20)} <= got and {(i, j) for i, j in got} == set(brute.leaks(rows, items))
