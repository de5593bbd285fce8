import random

import pytest

from tablewright.llm.decontaminate import Benchmark, Settings, contamination, keep_clean, tile, tokens


def brute_tiles(item, doc, least):
    """The length of greedy tiles, by trying every pair of places again for each tile."""
    item_marked, doc_marked, total = [0] * len(item), [0] * len(doc), 0
    while True:
        most, places = least, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not item_marked[i + n] and not doc_marked[j + n]:
                    n += 1
                if n > most:
                    most, places = n, [(i, j)]
                elif n == most:
                    places.append((i, j))
        if not places:
            return total
        for i, j in places:
            if not any(item_marked[i : i + most]) and not any(doc_marked[j : j + most]):
                item_marked[i : i + most] = doc_marked[j : j + most] = [1] * most
                total += most


def test_tiles_equal_brute_force():
    draw = random.Random(3)
    for _ in range(1500):
        least = draw.choice([2, 3, 5])
        item = [draw.randint(1, draw.choice([2, 4, 30])) for _ in range(draw.randint(1, 30))]
        doc = []
        for _ in range(draw.randint(1, 4)):
            at = draw.randint(0, len(item))
            doc += item[at : at + draw.randint(0, 14)] + [draw.randint(1, 30) for _ in range(draw.randint(0, 3))]
        found = tile(item, doc, least)
        assert all(n >= least and item[i : i + n] == doc[j : j + n] for i, j, n in found)
        assert sum(n for *_, n in found) == brute_tiles(item, doc, least), (item, doc, least)


def test_long_runs_restart_the_search():
    item = list(range(100, 200))
    assert tile(item, [1, 2, *item, 3], 5) == [(0, 2, 100)]


SENTENCES = ["Alpha beta gamma delta epsilon zeta eta.", "Un deux trois quatre cinq six sept huit.", "One two three four five six, seven eight nine ten."]
ITEMS = [(1, " ".join(SENTENCES)), (2, "quite another benchmark question that nobody ever asked before today"), (3, "tiny item"), (4, None), (5, ""), (6, " ".join(SENTENCES))]
DOCS = [
    (10, f"before {SENTENCES[2]} middle {SENTENCES[0]}\n{SENTENCES[1]} after", [1, 6]),  # moved about
    (11, f"before {SENTENCES[0].upper()} {SENTENCES[1].replace(' ', ' - ')} and no more", []),  # 15 of 25 tokens
    (12, "a TINY\titem, whole", [3]),
    (13, "a tiny little item", []),
    (14, None, []),
    (15, "", []),
    (16, "filler " * 60_000 + ITEMS[1][1] + " filler" * 60_000, [2]),
    (16, "filler", []),
    (None, ITEMS[1][1], [2]),
    (17, f"{SENTENCES[0]} {SENTENCES[1]} One two three four five", [1, 6]),  # 20 of 25
    (18, f"{SENTENCES[0]} {SENTENCES[1]} One two three four", []),  # 15 and a run too short
]


@pytest.mark.parametrize("settings", [Settings(), Settings(block_bytes=60)])
def test_documents(spark, settings):
    docs = spark.createDataFrame([(d, t, "key", "items") for d, t, _ in DOCS], "doc_id long, text string, key string, items string").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    found = contamination(docs, bench, settings).collect()
    got = sorted(str((r["doc_id"], [i["item_id"] for i in r["items"]])) for r in found)
    assert got == sorted(str((d, items)) for d, _, items in DOCS)
    clean = keep_clean(docs, bench, settings)
    assert clean.columns == docs.columns
    assert sorted(str(tuple(r)[:2]) for r in clean.collect()) == sorted(str((d, t)) for d, t, items in DOCS if not items)


def test_seeds_miss_no_tile():
    """Coverage through seeds equals tiling the whole document."""
    draw = random.Random(4)
    for _ in range(300):
        item = [draw.choice("abcdefgh") for _ in range(draw.randint(5, 25))]
        doc = []
        for _ in range(draw.randint(0, 4)):
            at = draw.randint(0, len(item))
            doc += item[at : at + draw.randint(3, 14)] + [draw.choice("abcxyz") for _ in range(draw.randint(0, 3))]
        from tablewright.llm.words import WordHashes

        share = brute_tiles(item, doc, 5) / len(item)
        found = Benchmark([(1, " ".join(item))], 5).covered(WordHashes().of(tokens(" ".join(doc))), 0.5)
        assert found == ([(1, pytest.approx(share))] if share >= 0.5 else []), (item, doc)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [list(r["items"]) for r in contamination(docs, none).collect()] == [[]]
    assert contamination(docs.limit(0), none).count() == 0
    assert keep_clean(docs, none).count() == 1


def test_items_without_an_identifier_count(spark):
    from tablewright.llm.decontaminate import contamination, keep_clean

    items = [f"first{i} second{i} third{i} fourth{i} fifth{i} sixth{i}" for i in range(3)]
    benchmark = spark.createDataFrame([(None, items[0]), (None, items[1]), (7, items[1]), (8, None), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {items[0]} b"), (2, f"{items[1]} {items[0]}"), (3, items[2]), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: [i["item_id"] for i in r["items"]] for r in contamination(docs, benchmark).collect()}
    assert found == {1: [None], 2: [None, None, 7], 3: [], 4: []}
    assert {r["doc_id"] for r in keep_clean(docs, benchmark).collect()} == {3, 4}
