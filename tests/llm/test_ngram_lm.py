import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import ngram_lm
from tablewright.llm.ngram_lm import discounts, held_out, score, train

TEXTS = ["the cat sat on the mat", "The cat ran", "a dog sat on a log", "", None, "the the the the", "mat\ton\nthe\x0bcat", "x " * 30_000, "unseen words here", "the cat sat on the mat"] * 3


class Brute:
    """The model from its definition, with dictionaries."""

    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            w = self.tokens(t)
            self.c.update(w[1:])
            self.pairs.update(zip(w, w[1:], strict=False))
        self.n, self.v = self.c.total(), len(self.c)
        self.ends = Counter(w for _, w in self.pairs)
        of = lambda values: discounts([sum(v == i for v in values) for i in range(1, 5)])
        self.d_pair, self.d_word = of(self.pairs.values()), of(self.ends.values())
        self.after, self.kinds = Counter(), defaultdict(list)
        for (u, _), n in self.pairs.items():
            self.after[u] += n
            self.kinds[u].append(min(n, 3))

    @staticmethod
    def tokens(text):
        return ["<s>", *(w.decode() for w in (text or "").encode().lower().split()), "</s>"]

    def share(self, w):
        total = self.ends.total()
        rest = sum(self.d_word[min(n, 3)] for n in self.ends.values()) / total if total else 1
        own = max(self.ends[w] - self.d_word[min(self.ends[w], 3)], 0) / total if self.ends[w] else 0
        return own + rest / (self.v + 1)

    def p(self, u, w):
        if not self.after[u]:
            return self.share(w)
        n = self.pairs[u, w]
        return max(n - self.d_pair[min(n, 3)], 0) / self.after[u] + sum(self.d_pair[k] for k in self.kinds[u]) / self.after[u] * self.share(w)

    def row(self, text):
        w = self.tokens(text)
        base = sum(math.log10((self.c[x] + 1) / (self.n + 1 * (self.v + 1))) for x in w[1:])
        return len(w) - 1, sum(self.c[x] > 0 for x in w[1:]), self.n, base, sum(math.log10(self.p(a, b)) for a, b in zip(w, w[1:], strict=False))


@pytest.mark.parametrize("training", [TEXTS, [], [None, ""], ["one"]])
def test_scores_equal_the_definition(spark, training):
    brute = Brute(training)
    if training:
        assert sum(brute.p("<s>", w) for w in brute.c) + brute.p("<s>", "?") == pytest.approx(1)
    model = train(spark.createDataFrame([(t, 1) for t in training], "text string, block int").repartition(3))
    docs = spark.createDataFrame([(i if i % 4 else None, t, "b", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, block string, n_tokens int")
    found = score(docs, model).collect()
    got = sorted((str(r["doc_id"]), *r[1:6]) for r in found)
    expected = sorted((str(i if i % 4 else None), *brute.row(t)) for i, t in enumerate(TEXTS))
    assert len(got) == len(TEXTS)
    for a, b in zip(got, expected, strict=True):
        assert a == pytest.approx(b)
    assert score(docs.limit(0), model).count() == 0


def test_folds(spark):
    rows = spark.range(50).withColumn("fold", held_out(F.col("id"))).collect()
    assert [r["fold"] for r in rows] == [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(50)]
    assert spark.range(1).select(held_out(F.lit(None).cast("long")).alias("h")).first()["h"] is False


def test_blocks_come_back():
    draw = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        sums = draw.integers(0, 2**40, (len(keys), 3))
        back = ngram_lm.unpacked(ngram_lm.packed(keys, sums)) if n else None
        if n:
            assert (back[0] == keys).all()
            assert (back[1] == sums).all()


def test_pair_keys_can_be_undone():
    draw = np.random.default_rng(2)
    first, second = draw.integers(0, 2**32, (2, 1000))
    both = ngram_lm._unmixed(ngram_lm.pair_keys(first, second))
    assert (both >> np.uint64(32) == first).all()
    assert (both & np.uint64(2**32 - 1) == second).all()


def test_buckets_keep_the_order_of_keys():
    keys = np.sort(np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64))
    buckets = ngram_lm.bucket_of(keys, 7)
    assert (np.diff(buckets) >= 0).all()
    assert set(buckets) == set(range(7))


def test_files_are_whole_or_absent(tmp_path):
    values = np.arange(10, dtype="<u8")
    path = f"file://{tmp_path}/deep/er/0"
    ngram_lm.write_array(path, values)
    ngram_lm.write_array(path, values)  # a second run of a task
    assert (ngram_lm.map_array(path, "<u8") == values).all()
    assert [p.name for p in (tmp_path / "deep" / "er").iterdir()] == ["0"]
    with pytest.raises(OSError):
        ngram_lm.map_array(path + "x", "<u8")


@pytest.mark.parametrize(("name", "value"), [("NARROW", 3), ("LARGEST", 2), ("MAPPED", 2)])
def test_wide_ids_large_counts_and_few_open_files(spark, monkeypatch, name, value):
    """The same scores where ids do not fit a pair, counts need 64 bits, or hardly a file may stay open."""
    monkeypatch.setattr(ngram_lm, name, value)
    model = train(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    assert model.wide == (name == "NARROW")
    brute, texts = Brute(TEXTS), [t for t in TEXTS if t is not None]
    scorer = ngram_lm.Scorer(model)
    scorer.arrays.mapped = ngram_lm.MAPPED
    found = scorer([t.encode() for t in texts])
    for got, t in zip(zip(*found, strict=True), texts, strict=True):
        n, known, _, base, chance = brute.row(t)
        assert got == pytest.approx((n, known, base, chance))
    assert len(scorer.arrays.open) <= ngram_lm.MAPPED


def test_open_files_are_bounded(spark, monkeypatch):
    """With room for 64 files, a model of many more is read to its end."""
    import os

    monkeypatch.setattr(ngram_lm, "TOKENS_PER_BUCKET", 50)
    model = train(spark.createDataFrame([(" ".join(f"w{i}" for i in range(5000)),)], "text string"))
    arrays = ngram_lm.Arrays(model.path, model.n_buckets, model.starts, mapped=64)
    files = lambda: len(os.listdir("/proc/self/fd"))
    before = files()
    for bucket in range(model.n_buckets):
        for name in ngram_lm.Arrays.KINDS:
            arrays.get(name, bucket)
            assert files() - before <= 64 + 2
    assert model.n_buckets * 6 > 300 and len(arrays.open) == 64


def test_paths_as_hadoop_writes_them():
    system, where = ngram_lm.located("file:///tmp/x")
    assert (system.type_name, where) == ("local", "/tmp/x")
    system, where = ngram_lm.located("s3a://bucket/key?region=eu-west-1")
    assert (system.type_name, where) == ("s3", "bucket/key")


def test_arrays_of_other_stores_are_read_within_bounds(spark, monkeypatch):
    model = train(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    plain = ngram_lm.map_array
    monkeypatch.setattr(ngram_lm, "map_array", lambda path, kind: np.array(plain(path, kind)))
    arrays = ngram_lm.Arrays(model.path, model.n_buckets, model.starts, read_bytes=64)
    for bucket in range(model.n_buckets):
        for name in arrays.KINDS:
            arrays.get(name, bucket)
            assert arrays.held == sum(a.nbytes for a in arrays.open.values())
            assert arrays.held <= 64 or len(arrays.open) == 1


class BruteOfOrder:
    """A model of any order from its definition, with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.raw = order, {k: Counter() for k in range(1, order + 1)}
        for t in texts:
            w = Brute.tokens(t)
            for k in self.raw:
                self.raw[k].update(g for i in range(len(w) - k + 1) if (g := tuple(w[i : i + k])) != ("<s>",))
        self.counts = {order: self.raw[order]}
        for k in range(order - 1, 0, -1):
            before = Counter(g[1:] for g in self.raw[k + 1])
            self.counts[k] = {g: n if k > 1 and g[0] == "<s>" else before[g] for g, n in self.raw[k].items()}
        self.d = {k: discounts([sum(n == i for n in c.values()) for i in range(1, 5)]) for k, c in self.counts.items()}
        self.after = {k: defaultdict(list) for k in self.counts}
        for k, c in self.counts.items():
            for g, n in c.items():
                self.after[k][g[:-1]].append(n)

    def p(self, context, w):
        k = len(context) + 1
        follow, d = self.after[k].get(tuple(context), []), self.d[k]
        if k == 1:
            total, n = sum(follow), self.counts[1].get((w,), 0)
            rest = sum(d[min(x, 3)] for x in follow) / total if total else 1
            return (max(n - d[min(n, 3)], 0) / total if total else 0) + rest / (len(self.raw[1]) + 1)
        lower = self.p(context[1:], w)
        if not sum(follow):
            return lower
        n = self.counts[k].get((*context, w), 0)
        return (max(n - d[min(n, 3)], 0) + sum(d[min(x, 3)] for x in follow) * lower) / sum(follow)

    def score(self, text):
        w = Brute.tokens(text)
        return sum(math.log10(self.p(w[max(0, i - self.order + 1) : i], w[i])) for i in range(1, len(w)))


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("narrow", [1 << 32, 3])
def test_every_order_equals_the_definition(spark, monkeypatch, order, narrow):
    monkeypatch.setattr(ngram_lm, "NARROW", narrow)
    draw = random.Random(order)
    texts = [" ".join(draw.choices("a b c d e f the of".split(), k=draw.randrange(12))) for _ in range(60)] + ["", None, "alone", "x y", *TEXTS[:4]]
    brute = BruteOfOrder(texts, order)
    for context in (["<s>"], ["<s>", "a"][-order + 1 :], ["a", "b", "the"][-order + 1 :]):
        assert sum(brute.p(context, w) for (w,) in brute.raw[1]) + brute.p(context, "?") == pytest.approx(1)
    model = train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), order=order)
    asked = [t for t in texts if t is not None] + ["never seen at all", "the a zzz b c the", "b"]
    found = ngram_lm.Scorer(model)([t.encode() for t in asked])[3]
    assert found.tolist() == pytest.approx([brute.score(t) for t in asked])
    if order == 2:
        assert [brute.score(t) for t in asked] == pytest.approx([Brute(texts).row(t)[4] for t in asked])


@pytest.mark.parametrize("training", [[], [None, ""], ["one"]])
def test_little_training_text_of_a_higher_order(spark, training):
    model = train(spark.createDataFrame([(t,) for t in training], "text string"), order=3)
    found = ngram_lm.Scorer(model)([t.encode() for t in ("", "one", "one two", "x")])[3]
    assert found.tolist() == pytest.approx([BruteOfOrder(training, 3).score(t) for t in ("", "one", "one two", "x")])
    with pytest.raises(ValueError, match="order"):
        train(spark.createDataFrame([], "text string"), order=1)
