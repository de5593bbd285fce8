import re

import pytest

from tablewright.llm.mixing import MixPlan, apply_mix, mix

DOCS = "doc_id long, text string, source string, size string, taken string, mix_key string"


def doc(i, n, source, text=None):
    return (i, " ".join([f"w{i}"] * n) if text is None else text, source, "x", "y", "z")


def targets(sizes, plan):
    """The rule itself: share by weight, stop at the cap, share again what is left over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: plan.weights[i % len(plan.weights)] for i, s in enumerate(names)}
    cap = {s: plan.max_epochs * sizes[s] for s in names}
    fixed, goal = {}, plan.share * sum(sizes.values())
    while True:
        left, open_ = goal - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap[s] for s in over}


@pytest.mark.parametrize("plan", [MixPlan(rows_per_bucket=7), MixPlan(weights=(1.0,), share=0.25, rows_per_bucket=5), MixPlan(weights=(5.0, 1.0), share=2.5, max_epochs=3.0)])
def test_budgets_are_met_exactly(spark, plan):
    rows = [doc(i, (i * 37) % 23, ["a", "b", "é", None, "Z"][i % 5 if i % 3 else 0]) for i in range(200)]
    found = mix(spark.createDataFrame(rows, DOCS), plan).collect()
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(r[1].split())
    wanted = targets(sizes, plan)
    assert len(found) == len(rows)
    for source, size in sizes.items():
        mine = [r for r in found if r["source"] == source]
        assert {r["source_size"] for r in mine} == {size}
        assert mine[0]["target"] == pytest.approx(wanted[source])
        assert sum(r["taken"] for r in mine) == pytest.approx(wanted[source], abs=0.51)
        # Whole epochs first, then a cut along the order: at most one document is taken in part.
        epochs = int(round(wanted[source]) // size)
        extra = [r["taken"] - epochs * r["size"] for r in sorted(mine, key=lambda r: r["mix_key"])]
        full = [e == r["size"] for e, r in zip(extra, sorted(mine, key=lambda r: r["mix_key"]), strict=True) if r["size"]]
        assert full == sorted(full, reverse=True)
        assert all(r["taken"] <= plan.max_epochs * r["size"] for r in mine)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = [doc(i, i % 9, f"s{i % 4}") for i in range(120)]
    a, b = (sorted((r["doc_id"], r["taken"]) for r in mix(spark.createDataFrame(rows, DOCS).repartition(n), MixPlan(rows_per_bucket=10)).collect()) for n in (1, 5))
    assert a == b


def test_copies_carry_what_is_taken(spark):
    rows = [doc(i, 1 + i % 9, f"s{i % 4}") for i in range(80)] + [doc(500, 3, None), (None, None, "s1", "", "", ""), doc(1, 2, "s1"), doc(1, 2, "s1")]
    docs = spark.createDataFrame(rows, DOCS)
    found = apply_mix(docs)
    assert found.columns == [*docs.columns, "mix_epoch", "mix_words"]
    copies = {}
    for r in found.collect():
        assert tuple(r)[:6] in rows
        assert r["mix_words"] <= len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["mix_words"]
    taken = {}
    for r in mix(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    assert {k: v for k, v in taken.items() if v} == pytest.approx(copies, abs=1)


def test_nothing_to_take(spark):
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    assert apply_mix(spark.createDataFrame([], DOCS)).count() == 0
    found = mix(spark.createDataFrame([doc(1, 0, "a"), doc(2, 0, None, "\t \n")], DOCS)).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in found] == [(0, 0, 0.0)] * 2


def test_words_are_split_at_ascii_space_only(spark):
    found = mix(spark.createDataFrame([doc(1, 0, "a", " a b\tc\x0bd\x1fe \r\n")], DOCS)).first()
    assert found["size"] == 3


def test_equal_documents_of_two_sources_keep_their_targets(spark):
    rows = [(1, "a b c d e f g h i j", "s1", "", "", "")] * 3 + [(1, "a b c d e f g h i j", "s2", "", "", "")] * 2 + [(1, "a b c d e f g h i j", None, "", "", "")]
    found = apply_mix(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    got = {}
    for r in found:
        got[r["source"]] = got.get(r["source"], 0) + r["mix_words"]
    wanted = targets({"s1": 30, "s2": 20, None: 10}, MixPlan())
    assert got == {s: pytest.approx(t, abs=0.51) for s, t in wanted.items()}


def test_many_equal_rows_share_to_the_word(spark):
    rows = [(None, "a b c", "s1", "", "", "")] * 501 + [doc(i, 5, "s2") for i in range(40)]
    found = apply_mix(spark.createDataFrame(rows, DOCS).repartition(5), MixPlan(weights=(1.0, 1.0), share=0.6)).collect()
    taken = [r["mix_words"] for r in found if r["source"] == "s1"]
    assert sum(taken) == round(targets({"s1": 1503, "s2": 200}, MixPlan(weights=(1.0, 1.0), share=0.6))["s1"])
    assert len(taken) == 501 and max(taken) - min(taken) <= 1


def test_columns_of_the_result_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, 8)], "doc_id long, text string, source string, mix_epoch long, mix_words long")
    assert [tuple(r) for r in apply_mix(docs).collect()] == [(1, "a b", "s", 0, 2), (1, "a b", "s", 1, 1)]
