"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Source shares of tokens are raised to a power a and normalised.  a is found by bisection: the least
power whose weights have no more than the target entropy and repeat no source more than the limit.
Entropy falls as a grows; repeats are (hi/lo)**|1-a|, so the limit bounds a on both sides of 1, and it
comes first: if the target entropy lies beyond the upper bound, a is that bound, the entropy stays as
near the target as the limit lets it, and a warning says so.  Each bisection round is one small
aggregate over the table of sources, at 33 powers at once.  Rows fall in blocks by a hash; a source's budget is read as whole passes over
its blocks, then a seeded permutation of blocks cut where the budget ends: only the block at the cut is
ordered by row, so a source with a third of all rows is never sorted by one task.

The default budget is the least that reads every source whole once, so nothing is dropped; sources
with more weight than share repeat, at most max_repeats times on average.

Defined results: a null source is a source of its own; null and empty texts have no tokens and come
once with each whole pass; repeated rows are rows of their own; the last row to begin within a budget
is read whole; a result column whose name the id or source has is named with an underscore before it.  An empty table, or one without tokens, gives every row once.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, table

BLOCKS, MAX_REPEATS, SECTIONS, ROUNDS = 4096, 4.0, 32, 6


def tokens_of(text_col: str):
    """Words between white space: a token count that needs no vocabulary."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def power_for(sources: DataFrame, target_entropy: float | None, max_repeats: float) -> float:
    """The power a; sources has positive longs `tokens`, one row a source.  target_entropy: a share of the largest entropy possible."""
    first = sources.agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi")).first()
    if not first.n or first.n == 1:
        return 1.0
    spread = math.log(first.hi / first.lo)
    if spread == 0:  # equal sources have equal weights at any power
        return 1.0
    # The budget reads the source with the least weight for its share once; the other end repeats (hi/lo)**|1-a|.
    by_limit, most = max(0.0, 1 - math.log(max_repeats) / spread), 1 + math.log(max_repeats) / spread
    if target_entropy is None:
        return by_limit
    goal = target_entropy * math.log(first.n)
    lo, hi = 0.0, most
    for _ in range(ROUNDS):
        at = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
        # A row a source and power, added up by power before anything is shuffled.
        each = sources.select(F.log(F.col("tokens") / F.lit(float(first.hi))).alias("log_p"), F.posexplode(F.lit(at)).alias("k", "a"))
        weight = F.exp(F.col("log_p") * F.col("a"))
        sums = each.groupBy("k").agg(F.sum(weight).alias("z"), F.sum(weight * F.col("log_p") * F.col("a")).alias("s")).collect()
        entropy = [math.log(r.z) - r.s / r.z for r in sorted(sums)]
        k = next((k for k, h in enumerate(entropy) if h <= goal), None)
        if k is None:
            warnings.warn(f"mixing: at most {max_repeats} repeats leave an entropy of {entropy[-1] / math.log(first.n):.4f} of the largest, over the target {target_entropy}", stacklevel=2)
            return most
        lo, hi = at[max(0, k - 1)], at[k]
    return max(hi, by_limit)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float | None = 0.95, max_repeats: float = MAX_REPEATS, total_tokens: int | None = None, seed: int = 17, blocks: int = BLOCKS) -> DataFrame:
    """A row for each reading of a document: (id, source, n_tokens, weight, epoch, block, place).

    Reading order within a source is epoch, then place (the block's in that epoch's permutation), then
    the row's hash.
    """
    text = F.col(text_col).cast("string")
    key = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    h = F.xxhash64(F.lit(seed), F.col(id_col), text)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), tokens_of(text_col).alias("tokens"), h.alias("h"))
    rows = checkpointed(rows.withColumn("block", F.pmod(F.shiftright("h", 20), F.lit(blocks)).cast("int")))
    sums = checkpointed(rows.groupBy("key", "block").agg(F.sum("tokens").alias("tokens")))
    sources = checkpointed(sums.groupBy("key").agg(F.sum("tokens").alias("tokens")))
    some = sources.where("tokens > 0")
    a = power_for(some, target_entropy, max_repeats)
    top = some.agg(F.max("tokens").alias("hi"), F.min("tokens").alias("lo")).first()
    scale = some.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(top.hi or 1)), F.lit(a))).alias("z")).first().z or 1.0
    weight = F.pow(F.col("tokens") / F.lit(float(top.hi or 1)), F.lit(a)) / F.lit(scale)
    plan = sources.withColumn("weight", F.when(F.col("tokens") > 0, weight).otherwise(F.lit(0.0)))
    if total_tokens is None:
        total = plan.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight")).alias("t")).first().t or 0.0
    else:
        total = float(total_tokens)
    budget = F.round(F.col("weight") * F.lit(total)).cast("long")
    plan = plan.select("key", "weight", F.col("tokens").alias("of"), budget.alias("budget"))
    plan = plan.withColumn("whole", F.when(F.col("of") > 0, F.expr("budget div of")).otherwise(F.lit(1))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("of"))
    # Each pass permutes a source's blocks anew; the last is cut.
    passes = sums.join(plan, "key").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    passes = passes.where("epoch < whole or rest > 0")
    order = Window.partitionBy("key", "epoch").orderBy(F.xxhash64(F.lit(seed), "key", "epoch", "block"), "block")
    passes = passes.withColumn("place", F.row_number().over(order) - 1).withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    cut = (F.col("epoch") == F.col("whole")) & (F.col("before") + F.col("tokens") > F.col("rest"))
    passes = passes.where("epoch < whole or before < rest").select("key", "block", "weight", "epoch", "place", F.when(cut, F.col("rest") - F.col("before")).alias("room"))
    read = rows.join(passes, ["key", "block"])
    kept = ["id", "source", "tokens", "weight", "epoch", "block", "place"]
    inner = Window.partitionBy("key", "block").orderBy("h", F.col("id").asc_nulls_first(), "tokens").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = read.where("room is not null").withColumn("start", F.sum("tokens").over(inner) - F.col("tokens")).where("start < room")
    out = read.where("room is null").select(*kept).unionAll(at_cut.select(*kept))
    made = {"n_tokens": F.col("tokens"), "weight": F.col("weight"), "epoch": F.col("epoch"), "block": F.col("block"), "place": F.col("place").cast("long")}
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), *(c.alias(fresh(n, [id_col, source_col])) for n, c in made.items()))


def op8_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
