import random

from tablewright.llm.token_counts import LongestMatch, count_tokens


def brute(vocabulary, word):
    n = at = 0
    longest = max(map(len, vocabulary))
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), None)
        if size is None:
            return 1
        at, n = at + size, n + 1
    return n


def test_random_vocabularies():
    draw = random.Random(7)
    for _ in range(5000):
        vocabulary = {bytes(draw.choices(b"abc ", k=draw.randint(1, 5))) for _ in range(draw.randint(1, 12))}
        word = bytes(draw.choices(b"abc ", k=draw.randint(0, 14)))
        assert LongestMatch(vocabulary).count(word) == brute(vocabulary, word), (vocabulary, word)


def test_documents(spark):
    vocabulary = [bytes([b]) for b in range(256)] + [b" a", b" ab", b"bc", b"cd", b"abc", b" \xc3\xa9"]
    long = "abc" * 50_000
    rows = [(1, "ab abcd", "x"), (2, None, "x"), (3, " \t\n", "x"), (4, "é éa", "x"), (5, long, "x"), (1, "ab abcd", "x"), (None, "a", "x")]
    found = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), vocabulary).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in found)
    expected = sorted((str(i), len((t or "").split()), sum(brute(set(vocabulary), b" " + w.encode()) for w in (t or "").split())) for i, t, _ in rows)
    assert got == expected


def test_unknown_bytes_make_one_piece():
    automaton = LongestMatch([b"a", b"ab", b" "])
    assert automaton.count(b"axb") == 1
    assert automaton.count(b"") == 0


def test_empty(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), [b"a"]).count() == 0
