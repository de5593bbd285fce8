import random
import re

from tablewright.llm.line_dedup import LineDedup
from tablewright.llm.passage_dedup import PassageDedup, removed_spans, without

ROWS = "doc_id long, text string, key string, first int, pick string"


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "k", 1, "d") for r in rows], ROWS).repartition(3)
    return sorted(((r["doc_id"], [tuple(s) for s in r["removed"]], r["clean_text"]) for r in PassageDedup(docs, **options).result().collect()), key=lambda r: (r[0] is None, r[0], str(r)))


def brute(rows, n):
    """doc_id, spans and text by comparing every window; rows are in order of distinct identifiers."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        gone = []
        for i in range(len(words) - n + 1):
            window = tuple(words[i : i + n])
            gone += [(i, i + n)] if window in seen else []
            seen.add(window)
        spans = removed_spans(text, gone)
        out.append((doc_id, spans, without(text, spans)))
    return out


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_passage_inside_a_longer_line(spark):
    passage = words("p", 55)
    rows = [(1, f"{words('a', 30)} {passage} {words('b', 30)}\nend"), (2, f"\U0001f600é {words('c', 20)} {passage.upper()}  {words('d', 40)}\nend")]
    found = run(spark, rows)
    (start, end), = found[1][1]
    assert found[0][1:] == ([], rows[0][1])
    assert rows[1][1][start:end] == f"{passage.upper()}  "
    assert found[1][2] == f"\U0001f600é {words('c', 20)} {words('d', 40)}\nend"
    # Lines alone do not see it.
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not any(r["removed"] for r in LineDedup(docs, min_words=1).result().filter("doc_id = 1").collect())


def test_equals_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for i in range(150):
        text = [draw.choice("xyz ") + str(draw.randrange(40)) for _ in range(draw.randrange(60))]
        for _ in range(draw.randrange(4)):
            if rows:
                other = rows[draw.randrange(len(rows))][1].split()
                at = draw.randrange(len(other) + 1)
                text[(cut := draw.randrange(len(text) + 1)):cut] = other[at : at + draw.randrange(30)]
        if draw.random() < 0.2:
            text += ["again"] * draw.randrange(25)
        rows.append((i, "".join(w + draw.choice([" ", "\n", "  ", "\t"]) for w in text)))
    for n in (8, 11):
        expected = brute(rows, n)
        assert sum(map(bool, (s for _, s, _ in expected))) > 30
        assert run(spark, rows, words=n) == expected


def test_edges(spark):
    passage = words("p", 50)
    rows = [(1, None), (2, ""), (3, words("p", 49)), (5, passage), (5, passage), (None, f"x {passage}"), (None, f"y {passage} z")]
    found = run(spark, rows)
    assert found[:5] == [(1, [], None), (2, [], ""), (3, [], rows[2][1]), (5, [], passage), (5, [], passage)]
    assert sorted(r[2] for r in found[5:]) == ["x ", "y z"]
    assert run(spark, rows[:0]) == []


def test_one_passage_in_very_many_documents(spark):
    passage = words("p", 60)
    found = run(spark, [(i, f"{words(f'own{i}x', 12)} {passage} {words(f'own{i}y', 12)}") for i in range(400)])
    assert [r[2] for r in found[1:]] == [f"{words(f'own{i}x', 12)} {words(f'own{i}y', 12)}" for i in range(1, 400)]
    assert found[0][1] == []
