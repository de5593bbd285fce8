import random
from itertools import combinations

import numpy as np
import pytest

from tablewright.llm import near_dedup
from tablewright.llm.near_dedup import NearDedup, Settings, _edge_pairs, _Order, _order_pairs
from tablewright.llm.words import WordHashes, lowered_words, shingles


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def shingle_set(text, n):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, percent=80):
    """(n_shingles, component) by doc_id; rows have distinct identifiers."""
    sets = {d: shingle_set(t, n) for d, t in rows}
    component = {d: d for d in sets}
    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
            low, high = sorted((component[a], component[b]))
            component = {d: low if c == high else c for d, c in component.items()}
    return {d: (len(sets[d]), component[d]) for d in sets}


def corpus():
    """Families of edited copies, boundary cases of similarity, exact copies and loners."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=4))
    rows, texts = [], []
    for size in (2, 3, 60):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randrange(4)):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for cut in range(15, 30):
        base = [word() for _ in range(100)]
        texts += [" ".join(base), " ".join(base[:-cut])]
    texts += [" ".join(word() for _ in range(50)) for _ in range(30)]
    texts += [texts[0], texts[0].upper(), texts[0].replace(" ", "\n "), "", None, "one", "one", "one two", "ONE  two", " \t", "a b c d", "a b c d e" * 20_000]
    draw.shuffle(texts)
    for i, t in enumerate(texts):
        rows.append((i + 1, t))
    return rows


@pytest.mark.parametrize("n", [4, 5])
def test_groups_equal_brute_force(spark, n):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], "doc_id long, text string, digest string, node int, a int").repartition(4)
    found = NearDedup(docs, Settings(words=n))
    groups = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.groups().collect()}
    assert groups == brute(rows, n)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.groups().collect())
    kept = found.survivors()
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in groups.items() if d == c)


def test_a_dense_region_keeps_copies_with_one_link(spark):
    """A large family where most copies are close to the original alone."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    base = [word() for _ in range(300)]
    rows = [(1000, " ".join(base))]
    for i in range(250):
        copy = list(base)
        for at in draw.sample(range(300), 7):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    expected = brute(rows, 4)
    found = NearDedup(spark.createDataFrame(rows, "doc_id long, text string"), Settings(words=4)).groups().collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected


def test_repeated_and_missing_identifiers(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "p q r s t u"), (7, "p q r s t u"), (None, "p q r s t u"), (None, None), (3, "")]
    found = NearDedup(spark.createDataFrame(rows, "doc_id long, text string")).groups().collect()
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found)))
    assert got == sorted(map(str, [(None, 2, None, True)] * 2 + [(7, 2, 7, True)] * 2 + [(None, 2, 7, False), (None, 0, None, True), (3, 0, 3, True)]))


def test_empty(spark):
    found = NearDedup(spark.createDataFrame([], "doc_id long, text string"))
    assert found.groups().count() == found.survivors().count() == 0


def test_cuts_between_partitions_lose_no_pair(spark):
    """Whatever the partitions, small regions give all their pairs."""
    draw = random.Random(8)
    rows = [(draw.randrange(2), bytes([0, draw.randrange(3)] * 4 + [draw.randrange(256) for _ in range(8)]), i) for i in range(60)]
    settings = Settings(min_depth=4, dense=100)
    expected = {tuple(sorted((a[2], b[2]))) for a, b in combinations(rows, 2) if (a[0], a[1][:8]) == (b[0], b[1][:8])}
    for parts in (1, 7, 40):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(rows, "tree int, key binary, node long")
        ordered = frame.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
        found = _order_pairs(ordered.select("*", F.spark_partition_id().cast("long").alias("part")), settings).cache()
        inside = {tuple(sorted((r["a"], r["b"]))) for r in found.filter("a is not null").collect()}
        edges = found.filter("edge is not null")
        across = {tuple(sorted((r["a"], r["b"]))) for r in _edge_pairs(edges, settings).collect()}
        if parts == 40:
            # Regions over more than two partitions join through those between.
            linked = near_components(inside | across)
            assert linked == near_components(expected)
        else:
            assert parts > 1 or inside == expected
            assert near_components(inside | across) == near_components(expected)
        found.unpersist()


def test_a_small_region_over_many_partitions_gives_every_pair(spark):
    from pyspark.sql import functions as F

    rows = [(0, bytes([0, 1] * 4 + [i] * 8), i) for i in range(24)]
    expected = set(combinations(range(24), 2))
    ordered = spark.createDataFrame(rows, "tree int, key binary, node long").repartitionByRange(8, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = _order_pairs(ordered.select("*", F.spark_partition_id().cast("long").alias("part")), Settings()).cache()
    assert found.filter("edge is not null").select("edge").distinct().count() > 2
    pairs = found.filter("a is not null").select("a", "b").union(_edge_pairs(found.filter("edge is not null"), Settings()))
    assert {tuple(sorted((r["a"], r["b"]))) for r in pairs.collect()} == expected
    found.unpersist()


def near_components(pairs):
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in parent}


def test_dense_regions_meet_few_neighbours():
    order = _Order(Settings(dense=4, near=2))
    pairs = [order.step(0, b"x" * 16, i) for i in range(100)]
    assert list(map(len, pairs[:6])) == [0, 1, 2, 3, 2, 2]
    assert pairs[50] == [(48, 50), (49, 50)]


def test_shingles_are_of_whole_words():
    draw = random.Random(9)
    for n in (4, 5):
        for _ in range(300):
            text = "".join(draw.choices("aAbé \t\n\x1f ", k=draw.randint(0, 60)))
            assert len(shingles(WordHashes().of(lowered_words(text.encode())), n)) == len(shingle_set(text, n)), repr(text)


def test_similarity_is_exact_at_the_threshold():
    a = np.arange(80, dtype=np.uint64)
    assert near_dedup.linked(a, np.arange(100, dtype=np.uint64), 80)
    assert not near_dedup.linked(a[:79], np.arange(100, dtype=np.uint64), 80)


def near(text, at):
    words = text.split()
    words[at] = "edited"
    return " ".join(words)


def test_texts_that_share_an_identifier_are_separate_documents(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(100)) for c in "xy")
    found = NearDedup(spark.createDataFrame([(1, x), (1, y), (2, near(x, 3)), (3, near(y, 90)), (4, "other words of no one else")], "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in found.groups().collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted(r["doc_id"] for r in found.survivors().collect()) == [1, 1, 4]


def test_documents_without_an_identifier_link_others(spark):
    words = [f"w{i}" for i in range(200)]
    step = lambda n: " ".join(f"z{i}" if i < 14 * n else w for i, w in enumerate(words))
    lone = [(None, " ".join(f"q{i}" for i in range(50))), (None, " ".join([*(f"q{i}" for i in range(49)), "end"]))]
    found = NearDedup(spark.createDataFrame([(1, step(0)), (None, step(1)), (3, step(2)), *lone], "doc_id long, text string"))
    assert brute([(0, step(0)), (1, step(2))], 5)[1][1] == 1  # too far from each other
    groups = sorted(((r["doc_id"], r["component_id"]) for r in found.groups().collect()), key=str)
    assert groups == sorted([(1, 1), (3, 1), (None, 1), (None, None), (None, None)], key=str)
    kept = [r["text"] for r in found.survivors().collect()]
    assert len(kept) == 2 and step(0) in kept


def test_families_that_share_a_region(spark, monkeypatch):
    """Hubs reach one family each; the rest is found by the split join, in many blocks and runs."""
    monkeypatch.setattr(near_dedup, "HELD", 8)
    monkeypatch.setattr(near_dedup, "PASSING", 16)
    draw = random.Random(12)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    base, rows = [word() for _ in range(200)], []
    for family in range(4):
        words = list(base)
        words[family * 40 : family * 40 + 26] = [word() for _ in range(26)]
        for _ in range(30):
            copy = list(words)
            for at in draw.sample(range(160, 200), 3):
                copy[at] = word()
            rows.append((len(rows), " ".join(copy)))
    draw.shuffle(rows)
    found = NearDedup(spark.createDataFrame(rows, "doc_id long, text string"), Settings(words=4)).groups().collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 4)


def test_depth_adapts_to_the_region():
    """Of a dense region, every small region inside gives all its pairs."""
    order, rows = _Order(Settings(dense=4, near=1)), sorted(bytes([0, 1] * 4 + [0, i] + [0, j] * 3) for i in range(20) for j in range(3))
    pairs = {p for n, key in enumerate(rows) for p in order.step(0, key, n)}
    assert {(a, b) for a, b in combinations(range(60), 2) if a // 3 == b // 3} <= pairs
    assert len(pairs) < 60 * 4
