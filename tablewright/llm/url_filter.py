"""URL rules by a Bloom filter cascade.

A rule is a host and a path prefix with an action, ``allow`` or ``block``. It fits its host
and all subdomains where the path starts with the rule's; the longest fitting rule wins.
Every url has a few keys that could be rules: each suffix of its host at a label boundary,
with each prefix of its path as long as some rule's path. A url matches a rule exactly if
one of its keys is listed.

Membership is decided by a cascade: level 1 is a Bloom filter of the listed keys, level 2
one of the corpus keys that pass level 1 wrongly, level 3 one of the listed keys that pass
level 2, and so on until no key is left. Over the key universe for which it was built, the
first level that a key fails tells exactly whether it is listed; judging joins nothing.

Scale: the universe is never stored; a scan leaves only the keys that pass level 1. Every
level is sized by the count of its own keys, listed ones or false positives. Where one would
exceed ``max_filter_bytes``, all are built anew in more shards by key hash, each judged in a pass
of its own, so what is broadcast stays below that limit whatever the length of the list and
of the corpus. Set bits come to the driver as blobs of 64 KiB, no more than the filter itself.

Defined results: a url that is null or has no ``://`` has an empty host and path and no
rule; of a very long host only as many labels count as the longest rule has; two fitting rules of
equal length prefer the longer host; a key listed with several actions has the one that is
last in alphabetical order, so ``block`` before ``allow``; a rule without host or action fits
nothing; a url without a rule gets ``allow``, since no list holds it; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.storage import Scratch

PROBES = 5
BITS_PER_KEY = 10
#: Bytes of a filter that are put together by one task and fetched as one row.
BLOB = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as the rules see them."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, path_lengths: Sequence[int], most_labels: int) -> Column:
    """Every (key, host length) that a rule of at most ``most_labels`` labels for this url could have."""
    # Only the end of the host is cut into labels: one before it tells whether the first of them is whole.
    ending = F.substring_index(host, ".", -(most_labels + 1))
    labels = F.split(ending, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - most_labels + 1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    lengths = F.filter(F.array(*[F.lit(x) for x in sorted(set(path_lengths))]), lambda x: x <= F.length(path))
    each = F.transform(suffixes, lambda s: F.transform(lengths, lambda x: F.struct(F.concat(s, F.substring(path, F.lit(1), x)).alias("key"), F.length(s).alias("host_length"))))
    return F.when(host == "", F.array().cast("array<struct<key:string,host_length:int>>")).otherwise(F.flatten(each))


def key_hashes(key: Column) -> Column:
    """128 bits of a key, as two longs."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit("second")).alias("b"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(a: np.ndarray, b: np.ndarray, level: int, n_bits: int) -> np.ndarray:
    """The bits of each key at a level, one column per probe."""
    salt = np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    start, step = _mixed(a.astype(np.uint64) + salt), _mixed(b.astype(np.uint64) ^ salt) | np.uint64(1)
    return ((start[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(n_bits)).astype(np.int64)


@dataclass(frozen=True)
class Level:
    number: int
    n_bits: int
    bits: np.ndarray

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = positions(a, b, self.number, self.n_bits)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def listed(levels: Sequence[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key is listed, by the first level that it fails."""
    depth, alive = np.zeros(len(a), dtype=np.int64), np.ones(len(a), dtype=bool)
    for level in levels:
        rows = np.flatnonzero(alive)
        ok = level.passes(a[rows], b[rows])
        depth[rows[ok]] += 1
        alive[rows[~ok]] = False
    return depth % 2 == 1


def _build_level(keys: DataFrame, number: int, n_keys: int) -> Level:
    """A filter of the keys (columns a, b); the bits are set in the cluster and fetched as bytes."""
    n_bits = max(64, -(-n_keys * BITS_PER_KEY // 8) * 8)

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            at = positions(x["a"].to_numpy(), x["b"].to_numpy(), number, n_bits).ravel()
            yield pd.DataFrame({"byte": at >> 3, "mask": (1 << (at & 7)).astype(np.int32)})

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for x in batches:
            byte, mask = (np.asarray(x.column(i)) for i in range(2))
            for n in np.unique(byte // BLOB):
                mine = byte // BLOB == n
                held.setdefault(int(n), np.zeros(BLOB, dtype=np.uint8))[byte[mine] % BLOB] = mask[mine]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["n", "blob"])

    filled = keys.mapInPandas(bits, "byte long, mask int").groupBy("byte").agg(F.bit_or("mask").alias("mask"))
    whole = filled.repartition(-(-n_bits // (8 * BLOB)), F.floor(F.col("byte") / BLOB)).mapInArrow(blobs, "n long, blob binary")
    out = np.zeros(-(-n_bits // (8 * BLOB)) * BLOB, dtype=np.uint8)
    for r in whole.collect():
        out[r["n"] * BLOB : (r["n"] + 1) * BLOB] = np.frombuffer(r["blob"], dtype=np.uint8)
    return Level(number, n_bits, out[: n_bits // 8])


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(held.value.passes(a.to_numpy(), b.to_numpy()))

    return keys.filter(passes("a", "b"))


class TooLarge(Exception):
    """A level would need this many times the bytes that a filter may have."""

    def __init__(self, times: int) -> None:
        super().__init__(times)
        self.times = times


def _checked(n: int, max_bytes: int) -> int:
    if (times := -(-n * BITS_PER_KEY // 8 // max_bytes)) > 1:
        raise TooLarge(times)
    return n


def build_cascade(members: DataFrame, universe: DataFrame, scratch: Scratch, name: str, max_bytes: int = 32 << 20) -> list[Level]:
    """The levels for ``members`` among ``universe``; both have the key hashes a and b.

    False positives are found by an anti join of the few keys that pass level 1, so the universe itself is not joined.
    """
    members = scratch.table(members.select("a", "b").distinct(), f"{name}-listed")
    n = members.count()
    if not n:
        return []
    levels = [_build_level(members, 1, _checked(n, max_bytes))]
    wrong = _passing(universe.select("a", "b"), levels[0]).distinct().join(members, ["a", "b"], "left_anti")
    inside, outside = members, scratch.table(wrong, f"{name}-1")
    while n := outside.count():
        levels.append(_build_level(outside, len(levels) + 1, _checked(n, max_bytes)))
        still = scratch.table(_passing(inside, levels[-1]), f"{name}-{len(levels)}")
        inside, outside = outside, still
    return levels


class UrlFilter:
    """Rules with a cascade per action, exact for the urls it was built on."""

    def __init__(self, spark: SparkSession, rules: DataFrame, urls: DataFrame, url_col: str = "url", default: str = "allow", max_filter_bytes: int = 32 << 20) -> None:
        """rules: action, host, path."""
        self.spark, self.default, self.scratch = spark, default, Scratch(spark, "url-filter")
        rules = rules.filter("action is not null and host is not null")
        rules = self.scratch.table(rules.select("action", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")), "rules")
        self.path_lengths = sorted(x[0] for x in rules.select(F.length("path")).distinct().collect())
        sizes = {x["action"]: (x["n"], x["labels"]) for x in rules.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels")).collect()}
        self.actions = sorted(sizes)
        self.most_labels = max((labels for _, labels in sizes.values()), default=1)
        self.shards = max(1, -(-max((n for n, _ in sizes.values()), default=0) * BITS_PER_KEY // 8 // max_filter_bytes))
        keyed = rules.withColumn("h", key_hashes(F.concat("host", "path"))).select("action", "h.*")
        universe = self._with_keys(urls, url_col).select(F.explode("keys.h").alias("h")).select("h.*")
        while True:
            part = F.pmod(F.col("b"), F.lit(self.shards))
            try:
                self.cascades = {(a, s): build_cascade(keyed.filter((F.col("action") == a) & (part == s)), universe.filter(part == s), self.scratch, f"{a}-{s}", max_filter_bytes) for a in self.actions for s in range(self.shards)}
                break
            except TooLarge as found:
                # A tenth more, as shards are not quite equal.
                self.shards = self.shards * found.times * 11 // 10 + 1

    def _with_keys(self, urls: DataFrame, url_col: str, keep: Sequence[str] = ()) -> DataFrame:
        host, path = url_parts(urls[url_col])
        rows = urls.select(*keep, host.alias("host"), path.alias("path"))
        keys = candidate_keys(F.col("host"), F.col("path"), self.path_lengths or [0], self.most_labels)
        return rows.withColumn("keys", F.transform(keys, lambda k: F.struct(k["key"].alias("key"), k["host_length"].alias("host_length"), key_hashes(k["key"]).alias("h"))))

    def _marks(self, rows: DataFrame, action: str, shard: int) -> Column:
        """Per key of a row, whether the action's list holds it."""
        held, shards = self.spark.sparkContext.broadcast(self.cascades[action, shard]), self.shards

        @F.pandas_udf("array<boolean>")
        def marks(a: pd.Series, b: pd.Series) -> pd.Series:
            sizes = a.map(len).to_numpy()
            if not sizes.sum():
                return pd.Series([[]] * len(a))
            x, y = np.concatenate(a.to_numpy()).astype(np.int64), np.concatenate(b.to_numpy()).astype(np.int64)
            found = (np.mod(y, shards) == shard) & listed(held.value, x, y)
            return pd.Series(np.split(found, np.cumsum(sizes)[:-1]))

        return marks(rows["keys.h.a"], rows["keys.h.b"])

    def _hits(self, action: str) -> Column:
        """The listed keys of a row, so that the largest is the rule that wins."""
        mark = "m_" + action
        found = F.filter(F.arrays_zip("keys", mark), lambda x: x[mark])
        return F.transform(found, lambda x: F.struct(F.length(x["keys"]["key"]).alias("n"), x["keys"]["host_length"].alias("host_length"), x["keys"]["key"].alias("rule"), F.lit(action).alias("action")))

    def judge(self, urls: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
        """id, host, path, rule, verdict for every row."""
        rows = self._with_keys(urls, url_col, [id_col])
        for a in self.actions:
            for s in range(self.shards):
                old = rows["m_" + a] if s else None
                new = self._marks(rows, a, s)
                rows = rows.withColumn("m_" + a, new if old is None else F.zip_with(old, new, lambda x, y: x | y))
                if self.shards > 1:
                    rows = self.scratch.table(rows, f"judged-{a}-{s}")
        hits = [self._hits(a) for a in self.actions]
        best = F.array_max(F.concat(*hits)) if hits else F.lit(None).cast("struct<n:int,host_length:int,rule:string,action:string>")
        return rows.withColumn("best", best).select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(self.default)).alias("verdict"))


OP9_RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the five rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame([(r.action, r.host, r.path) for r in OP9_RULES], "action string, host string, path string")
    return UrlFilter(spark, rules, pages).judge(pages)


OP9_SQL = r"""
WITH rules(action, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), fits AS (
  SELECT p.page_id, p.host, p.path, r.action, r.host || r.path AS rule, length(r.host) AS host_length
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, host_length DESC) AS place FROM fits
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM ranked WHERE place = 1
"""
