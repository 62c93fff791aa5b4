"""What a block scheduler would decide: counts of walks by block, and which block to run or evict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_counts(placed: DataFrame) -> DataFrame:
    """blk, nwalks of walks (blk, hop) that still have hops left."""
    return placed.filter("hop > 0").groupBy("blk").agg(F.count("*").alias("nwalks"))


def block_max_hop(placed: DataFrame) -> DataFrame:
    return placed.groupBy("blk").agg(F.max("hop").cast("long").alias("max_hop"))


def block_rank(arrivals: DataFrame) -> DataFrame:
    """blk, rank: walks that came into a block from another one; rows (blk, before)."""
    return arrivals.filter("before is null or before <> blk").groupBy("blk").agg(F.count("*").alias("rank"))


def arg_max(figures: DataFrame, figure: str) -> DataFrame:
    """The block with the largest figure; of equals the lowest."""
    return figures.orderBy(F.desc(figure), "blk").limit(1)


def max_hops_block(counts: DataFrame, hops: DataFrame) -> DataFrame:
    """The block with the largest number of hops left; if all are 0, that with the most walks."""
    both = hops.join(counts, "blk", "left").select("blk", "max_hop", F.coalesce("nwalks", F.lit(0)).alias("nwalks"))
    return both.orderBy(F.desc("max_hop"), F.when(F.col("max_hop") == 0, -F.col("nwalks")).otherwise(0), "blk").limit(1)


def top_ranked(ranks: DataFrame, k: int) -> DataFrame:
    """The k blocks of largest rank, without those of rank 0, in order of block."""
    return ranks.filter("rank > 0").orderBy(F.desc("rank"), "blk").limit(k).orderBy("blk")


def evict(slots: DataFrame, counts: DataFrame) -> DataFrame:
    """The slot (slot, blk) to give up: an empty one first, else that with the fewest walks, the lowest of equals."""
    held = slots.join(counts, "blk", "left").withColumn("nwalks", F.coalesce("nwalks", F.lit(0)))
    return held.orderBy(F.col("blk").isNotNull(), F.when(F.col("blk").isNotNull(), F.col("nwalks")).otherwise(0), "slot").limit(1).select("slot", "blk", "nwalks")


def choose(u: Column, share: float, by_hops: Column, by_walks: Column) -> Column:
    """With the share of draws u in [0, 1) the block by hops, else that by walks."""
    return F.when(u < share, by_hops).otherwise(by_walks)


def cached(counts: DataFrame, slots: DataFrame) -> DataFrame:
    """Counts of the blocks that have a slot."""
    return counts.join(slots, "blk", "left_semi")


def finished(walks: DataFrame) -> bool:
    """Whether no walk (hop) has hops left."""
    return walks.filter("hop > 0").isEmpty()


def migrations(placed: DataFrame) -> DataFrame:
    """from_blk, to_blk, walks: how often walks (walk_id, step, blk) went from a block to another one."""
    after = F.lead("blk").over(Window.partitionBy("walk_id").orderBy("step"))
    moves = placed.select(F.col("blk").alias("from_blk"), after.alias("to_blk")).filter("to_blk <> from_blk")
    return moves.groupBy("from_blk", "to_blk").agg(F.count("*").alias("walks"))


def decide(counts: DataFrame, hops: DataFrame, slots: DataFrame, u: float, share: float) -> DataFrame:
    """One decision of the state-aware scheduler: blk, slot, cached, evicted.

    The block is chosen by hops if u < share, else by walks; block 0 if no walk is left. If it has a slot, that is used. Otherwise it
    gets the slot that evict() names, and the block there (null if the slot was empty) goes.
    """
    spark = counts.sparkSession
    by_hops, by_walks = max_hops_block(counts, hops).select("blk"), arg_max(counts, "nwalks").select("blk")
    chosen = spark.range(1).join(by_hops if u < share else by_walks, how="left").select(F.coalesce("blk", F.lit(0)).cast("long").alias("blk"))
    held = slots.select(F.col("slot").alias("has"), F.col("blk").alias("h_blk"))
    lowest = chosen.join(held, chosen["blk"] == held["h_blk"], "left").groupBy("blk").agg(F.min("has").alias("has"))
    victim = evict(slots, counts).select(F.col("slot").alias("v_slot"), F.col("blk").alias("v_blk"))
    both = lowest.join(victim)
    cached_ = F.col("has").isNotNull()
    return both.select("blk", F.coalesce("has", "v_slot").alias("slot"), cached_.alias("cached"), F.when(~cached_, F.col("v_blk")).alias("evicted"))


def refill(ranks: DataFrame, k: int) -> DataFrame:
    """slot, blk: the rank scheduler's slots after a refill, the k blocks of largest rank in order of block."""
    return top_ranked(ranks, k).select((F.row_number().over(Window.orderBy("blk")) - 1).cast("long").alias("slot"), "blk")


def turn(slots: DataFrame, counts: DataFrame, ranks: DataFrame, at: int, k: int) -> tuple[DataFrame, int]:
    """A turn of the rank scheduler: (slots, slot to run). Slots are refilled, and the turn begins anew, if no walk is left in them; else they come round robin."""
    if cached(counts, slots).isEmpty():
        slots, at = refill(ranks, k), 0
    return slots, at % max(1, slots.count())
