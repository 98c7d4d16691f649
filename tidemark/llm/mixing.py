"""Mixing sources to target weights by systematic sampling.

Method: a source's documents, in order of size, each expect target / source_size copies. These expectations are
prefix-summed within the source, one random offset is added, and a document is taken once for each integer boundary that
its span crosses. Because the order is by size, a source's taken words differ from its target by less than its largest
document. Only DataFrame operations are used. Prefix sums don't gather a source in one place: rows are dealt by ranges of
(source, size, doc_id), numbered within their range, and the ranges' counts are summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spread import free, sweep, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point, null last, repeating; a source gives at most MOST times its size.
WEIGHTS, MOST, SEED = (5, 2, 1), 3, 17


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): target, expected copies per document and the random offset.

    The words of all sources are shared by weight; a source stops at ``most`` times its size and the rest is shared
    among the others by weight until none is above. One row per source, so unpartitioned windows are small here.
    """
    weight = f"element_at(array({', '.join(map(str, weights))}), cast((row_number() over (order by source nulls last) - 1) % {len(weights)} + 1 as int))"
    ranked = sizes.selectExpr("source", "source_size", f"cast({weight} as double) as weight").selectExpr("*", f"cast({most} * source_size as double) as cap")
    # in order of cap by weight: the level if all sources before are at their cap and the rest share alike
    by = "order by cap / weight, source nulls last"
    levels = ranked.selectExpr(
        "*", "cap / weight as ratio", f"row_number() over ({by}) as place",
        f"(sum(cast(source_size as double)) over () - coalesce(sum(cap) over ({by} rows between unbounded preceding and 1 preceding), 0D)) / sum(weight) over ({by} rows between current row and unbounded following) as level",
    )
    shared = levels.selectExpr("*", "coalesce(min_by(level, case when level <= ratio then place end) over (), max(ratio) over ()) as water")
    name = f"concat('{seed}:', coalesce(concat('s', source), 'n'))"
    return shared.selectExpr(
        "source", "source_size", "least(cap, water * weight) as target",
        f"cast(conv(substr(md5({name}), 1, 8), 16, 10) as double) / 4294967296D as start",
    ).withColumn("each", F.expr("case when source_size > 0 then target / source_size else 0D end"))


def draw(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, copies and taken = copies * size.

    size is the number of words (null or empty text: 0). A null source is a source of its own, the last one; null
    doc_ids come first among rows of a size; rows that repeat are drawn each for itself. Reruns agree.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    order = ["source", "size", "doc_id"]
    laid = table(sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    sweep(spark)
    laid = laid.selectExpr("doc_id", "source", "size", "shiftright(at, 33) as part", "at & 8589934591 as place")
    counts = laid.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.sum("size").alias("words"))
    before = counts.selectExpr("source as s", "part as p", "coalesce(sum(n) over (partition by source order by part rows between unbounded preceding and 1 preceding), 0L) - first as shift")
    plan = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most, seed).withColumnRenamed("source", "t")
    known = before.join(plan, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    drawn = laid.join(known, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    drawn = drawn.withColumn("rank", F.col("place") + F.col("shift"))
    copies = "cast(floor(start + (rank + 1) * each) - floor(start + rank * each) as long)"
    return drawn.selectExpr("doc_id", "size", "source_size", "target", f"{copies} as copies").withColumn("taken", F.expr("copies * size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as ``draw`` takes it. Rows that repeat a doc_id go by the most taken of them."""
    own, many, turn = (free(docs, x) for x in ("_id", "_copies", "_copy"))
    taken = draw(docs, weights, most, seed).groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(many)).where(F.col(many) > 0)
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(F.col(own)))
    return rows.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(many)))).select(*[F.col(f"`{c}`") for c in docs.columns])
