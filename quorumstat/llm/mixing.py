"""Mixing sources to target weights, in native DataFrame expressions.

Temperature mixing: with token shares p of the sources, weights are w = p^a / sum(p^a).
The exponent a in [0, 1] is bisected until the weights' entropy reaches a target share of
its maximum or no source is repeated more often than a limit allows, whichever needs the
larger a.  The weights are then realised as block permutations: each source is cut by
hash into blocks of about `block_tokens` tokens; epoch e lists the blocks of each source in
an order of its own, and takes whole blocks until the source's token budget is spent.  The
order is cut into `RANGES` ranges of hash, whose totals are summed first, so that blocks of
a source are ranked range by range in parallel.  Within the block that crosses the budget,
documents are taken in hash order while the budget is not yet reached, so that a source
overruns its budget by less than one document.

Edge cases: a null source is a source of its own ('' in the result's order keys), a null
or empty text has no tokens and is taken along with its block without cost; repeated rows
count as rows; with a single source the exponent is irrelevant (1); a corpus without
tokens, or an empty table, gives no rows.  Rows without id are told apart by their text.
Input columns beyond id, text and source are ignored, or kept where `keep` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Exponents tried in one job; each round narrows the interval by so many parts.
CUTS = 16
ROUNDS = 6
#: Ranges of hash (two to this power) in which the blocks of a source are ranked.
RANGES = 12


def token_count(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")).cast("long")


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, tokens, rows) of `docs(source, tokens)`."""
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))


def weights(sizes: DataFrame, exponent: Column) -> DataFrame:
    """Adds share, weight: the token share and the tempered weight of each source with tokens."""
    whole = sizes.where("tokens > 0").withColumn("key", F.lit(1))
    total = whole.groupBy("key").agg(F.sum("tokens").alias("all_tokens"))
    one = whole.join(F.broadcast(total), "key").withColumn("share", F.col("tokens") / F.col("all_tokens")).withColumn("raw", F.pow("share", exponent))
    norm = one.groupBy("key").agg(F.sum("raw").alias("norm"))
    return one.join(F.broadcast(norm), "key").withColumn("weight", F.col("raw") / F.col("norm")).drop("key", "raw", "norm")


def _measures(sizes: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy, highest number of passes over a source) for each exponent, in one job over the sources."""
    total = sizes.agg(F.sum("tokens")).first()[0]
    one = sizes.where("tokens > 0").select("tokens", (F.col("tokens") / F.lit(float(total))).alias("p"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    one = one.withColumn("r", F.pow("p", F.col("a")))
    g = one.groupBy("a").agg(F.sum("r").alias("z"), F.sum(F.col("r") * F.log("r")).alias("rl"), F.max(F.col("r") / F.col("tokens")).alias("m"))
    rows = g.select("a", (F.log("z") - F.col("rl") / F.col("z")).alias("h"), (F.col("m") / F.col("z") * budget).alias("passes")).collect()  # a row for each exponent
    return sorted((r["a"], r["h"], r["passes"]) for r in rows)


def bisect_exponent(sizes: DataFrame, budget: float, entropy_share: float = 0.9, max_repeats: float = 4.0) -> float:
    """The largest exponent whose weights reach `entropy_share` of the maximal entropy, or the smallest one that repeats no
    source above `max_repeats`, if that is larger.

    Entropy and repetition both fall as the exponent grows to 1, so both are found by bisection.
    """
    n = sizes.where("tokens > 0").count()
    if n < 2:
        return 1.0
    target = entropy_share * _log(n)

    def search(holds, rising: bool) -> float:
        """rising: holds() is false and then true as the exponent grows; else true and then false."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * i / CUTS for i in range(CUTS + 1)]
            good = [holds(m) for m in _measures(sizes, grid, budget)]
            if rising:
                if not any(good):
                    return 1.0
                i = good.index(True)
                if i == 0:
                    return grid[0]
                lo, hi = grid[i - 1], grid[i]
            else:
                if all(good):
                    return grid[-1]
                i = good.index(False)
                if i == 0:
                    return grid[0]
                lo, hi = grid[i - 1], grid[i]
        return hi if rising else lo

    by_entropy = search(lambda m: m[1] >= target, False)
    by_repeats = search(lambda m: m[2] <= max_repeats, True)
    return max(by_entropy, by_repeats)


def _log(n: int) -> float:
    import math

    return math.log(n)


def mix(
    docs: DataFrame, budget_tokens: int | None = None, entropy_share: float = 0.9, max_repeats: float = 4.0, block_tokens: int = 50_000, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each taking of a document: doc_id, source, tokens, epoch, block, block_rank, weight, exponent.

    `budget_tokens` is the size of the mixture; unset, that of the corpus.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), token_count(F.col(text_col)).alias("tokens"), F.xxhash64(F.lit(seed), id_col, F.when(F.col(id_col).isNull(), F.col(text_col))).alias("_hash"), *keep)
    light = cut(rows)
    sizes = cut(source_sizes(light))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    budget = float(budget_tokens or total)
    a = bisect_exponent(sizes, budget, entropy_share, max_repeats)
    per_source = weights(sizes, F.lit(a)).select(
        "source", "weight", "tokens", (F.col("weight") * budget).alias("budget"), F.ceil(F.col("tokens") / block_tokens).cast("int").alias("n_blocks")
    )
    per_source = cut(per_source.withColumn("epochs", F.ceil(F.col("budget") / F.col("tokens")).cast("int")).withColumnRenamed("tokens", "source_tokens"))

    id_hash = F.col("_hash")
    # n_blocks of each source comes to the rows by a null-safe join: the source side has a row for each source
    placed = light.join(per_source.select(F.col("source").alias("s"), "n_blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("block", F.pmod(id_hash, F.col("n_blocks")).cast("int")).drop("n_blocks")
    blocks = cut(placed.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens")))

    # budgets by block: epochs before the last take all blocks; the last takes them in its order while budget is left
    last = per_source.withColumn("epoch", F.col("epochs") - 1).withColumn("left", F.col("budget") - F.col("source_tokens") * F.col("epoch"))
    order = F.xxhash64(F.lit(seed), "source", "epoch", "block")
    ranked = blocks.withColumnRenamed("source", "s").join(last, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranked = ranked.withColumn("order", order).withColumn("range", F.shiftright("order", 64 - RANGES))
    ranges = ranked.groupBy("source", "range").agg(F.sum("block_tokens").alias("range_tokens"))
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_tokens").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("block_tokens").over(W.partitionBy("source", "range").orderBy("order", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("inside", inside).join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    taken = ranked.withColumn("room", F.col("left") - F.col("earlier") - F.col("inside")).where("room > 0")
    final = taken.select("source", "block", "weight", F.col("epoch").alias("full_epochs"), F.when(F.col("room") < F.col("block_tokens"), F.col("room")).alias("room"), F.lit(True).alias("in_last"))
    rest = blocks.withColumnRenamed("source", "s").join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rest = rest.select("source", "block", "weight", (F.col("epochs") - 1).alias("full_epochs"))
    plan = rest.join(final.select(F.col("source").alias("s"), F.col("block").alias("b"), "room", "in_last"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")

    on = plan.withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    each = placed.join(on, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    # the crossing block of a source is small: its rows alone are summed in hash order
    within = W.partitionBy("source", "block").orderBy(id_hash, "doc_id", "tokens").rowsBetween(W.unboundedPreceding, -1)
    crossing = each.where("room is not null").withColumn("so_far", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    crossing = crossing.withColumn("last_too", F.col("so_far") < F.col("room")).drop("so_far")
    whole = each.where("room is null").withColumn("last_too", F.coalesce("in_last", F.lit(False)))
    every = whole.unionByName(crossing)
    times = F.col("full_epochs") + F.col("last_too").cast("int")
    out = every.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    return out.select("doc_id", "source", "tokens", "epoch", "block", order.alias("block_rank"), F.round("weight", 9).alias("weight"), F.lit(round(a, 9)).alias("exponent"), *keep)
