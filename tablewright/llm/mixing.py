"""Mixing sources to target weights.

Every document gets a hash-random key, the MD5 of its identifier and text. Within a source
the keys order the documents at random but the same on every run. The order is never
materialised as one sort: the leading digits of the key are range buckets of it, so sums
per bucket, a prefix sum over the small table of buckets and a running sum inside each
bucket give every document its place. The cut at the source's budget is exact: the
document that crosses it is taken in part. A budget above the source's size repeats whole
epochs before the cut.

Scale: one scan of the texts makes slim rows, which are written once; they are shuffled
once by source and bucket and sorted there. The number of buckets follows the number of
rows, so a source with a third of all rows meets in as many tasks as there are buckets; it
has a bound of 2^22, so that the sums of one source's buckets fit one task, some 160 MB. Buckets
hold more than 1000 rows only beyond 4 x 10^9 rows in all. The table of sources
meets in one task as well: it has one row per source, like the weights given for it.

Defined results: a null text has size 0; a null source is a source of its own, ordered
last; rows that are equal in identifier, text and source are interchangeable;
empty sources and tables have budget 0; other columns are passed by, whatever their names.
Only DataFrame operations are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixPlan:
    """Weights by rank of the source, repeating; the share of all words to take; the most epochs of a source."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    max_epochs: float = 2.0
    rows_per_bucket: int = 1_000
    most_buckets: int = 1 << 22


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix_key(doc_id: Column, text: Column) -> Column:
    """32 hex digits, uniform over documents; a missing part counts as empty."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


def source_targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Targets follow the weights up to ``max_epochs`` of a source; what a full source cannot
    take is shared again by weight. With the sources ordered by cap over weight, those
    before some point are full and the others get one level times their weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, plan.weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(plan.weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", weight).withColumn("cap", F.lit(plan.max_epochs) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    goal = F.lit(plan.share) * F.sum("source_size").over(every)
    levels = ranked.withColumn("level", (goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    levels = levels.withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("level", level).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, plan: MixPlan | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, mix_key for every row of ``docs``."""
    plan = plan or MixPlan()
    scratch = Scratch(docs.sparkSession, "mixing")
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size"), mix_key(docs[id_col], docs[text_col]).alias("mix_key"))
    keyed = scratch.table(keyed, "keyed")
    n_buckets = min(max(1, keyed.count() // plan.rows_per_bucket), plan.most_buckets)
    # The first 7 hex digits as a number below 2^28, cut into equal ranges: buckets in the order of the keys.
    bucket = F.floor(F.conv(F.substring("mix_key", 1, 7), 16, 10).cast("long") * F.lit(n_buckets) / F.lit(1 << 28)).cast("long")
    rows = keyed.withColumn("bucket", bucket)
    buckets = scratch.table(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), plan)
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("words").over(in_order), F.lit(0)).alias("start"))
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "bucket", "start", "source_size", "target")
    starts = scratch.table(starts, "starts")

    within = Window.partitionBy("source", "bucket").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.bucket") == F.col("s.bucket"))
    placed = placed.alias("p").join(starts.alias("s"), same).withColumn("ahead", F.col("ahead") + F.col("start"))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("ahead")))
    return placed.select("doc_id", F.col("p.source").alias("source"), "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), "mix_key")


def apply_mix(docs: DataFrame, plan: MixPlan | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the columns of ``docs``, and per copy ``mix_epoch`` and ``mix_words``, the words to take of it.

    Columns of these two names in ``docs`` are replaced. Rows that are equal in identifier, text and source share evenly,
    to the word, what the mix takes of them; which of them has the odd words is not fixed.
    """
    scratch = Scratch(docs.sparkSession, "apply-mix")
    taken = mix(docs, plan, id_col, text_col, source_col).groupBy("source", "mix_key").agg(F.max("size").alias("size"), F.sum("taken").alias("total"), F.count(F.lit(1)).alias("copies"))
    taken = scratch.table(taken.filter("total > 0").withColumnRenamed("source", "of"), "taken")
    own = [c for c in docs.columns if c not in ("mix_epoch", "mix_words")]
    rows = docs.select(F.struct(*own).alias("row"), docs[source_col].cast("string").alias("source"), mix_key(docs[id_col], docs[text_col]).alias("mix_key"), F.spark_partition_id().alias("part"))
    rows = rows.join(taken, ["mix_key"]).filter(F.col("source").eqNullSafe(F.col("of")))
    share = F.floor(F.col("total") / F.col("copies"))
    if not taken.filter("copies > 1").isEmpty():
        # Equal rows are counted off by the partition that they came from, so that very many of them need not meet.
        many = scratch.table(rows.filter("copies > 1"), "repeated")
        key = ["of", "mix_key"]
        counts = many.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = scratch.table(counts.withColumn("before", before).withColumnsRenamed({"of": "of_2", "mix_key": "key_2", "part": "part_2"}), "counts")
        place = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.monotonically_increasing_id())) - 1
        same = F.col("of").eqNullSafe(F.col("of_2")) & (F.col("mix_key") == F.col("key_2")) & (F.col("part") == F.col("part_2"))
        many = many.withColumn("place", place).join(counts, same)
        odd = F.col("total") - share * F.col("copies")
        many = many.withColumn("taken", share + (F.col("place") + F.col("before") < odd).cast("long"))
        rows = rows.filter("copies = 1").withColumn("taken", share).select("row", "size", "taken").union(many.select("row", "size", "taken"))
    else:
        rows = rows.withColumn("taken", share)
    rows = rows.filter("taken > 0")
    epochs = F.floor((F.col("taken") - 1) / F.col("size"))
    copies = rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs)))
    words = F.least(F.col("size"), F.col("taken") - F.col("mix_epoch") * F.col("size"))
    return copies.select("row.*", "mix_epoch", words.alias("mix_words"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mix_key")


#: From a relation ``input_docs``; gives doc_id, source, size, source_size, target, taken, mix_key.
MIX_CTES = r"""
sized AS (
  SELECT doc_id, source, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS mix_key
  FROM input_docs
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         2.0::DOUBLE * source_size AS cap
  FROM by_source
), levelled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), chosen AS (
  SELECT (SELECT level FROM levelled WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1) AS level
), targets AS (
  SELECT source, source_size, least(cap, coalesce(chosen.level * w, cap)) AS target FROM weighted, chosen
), placed AS (
  SELECT s.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY mix_key, doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed
), mixed AS (
  SELECT doc_id, source, text, size, source_size, target, mix_key,
         (epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)))::BIGINT AS taken
  FROM cut
)
"""

OP7_SQL = f"WITH input_docs AS (SELECT * FROM documents), {MIX_CTES} SELECT doc_id, source, size, source_size, target, taken FROM mixed"
