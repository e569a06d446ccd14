"""Problem 9: combining sources to target shares of all tokens.

Every document gets a key that is random in its id. A source's documents are
sorted by that key over ranges of it, prefix sums of their token counts are
taken over the ranges, and the source is cut where its budget is spent. Sources
smaller than their budget go round in whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm._util import cut
from lectern.llm.tokenizer import TOKENIZERS, token_counts


def budgets(sizes: DataFrame, mixture: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source of `mixture`: its documents, tokens, target and budget of tokens.

    The total is `total_tokens` or, by default, the largest that every source
    with tokens can serve its share of within `max_repeats`. A budget never
    exceeds tokens times `max_repeats`. Sources without tokens, null shares and
    shares or repeats of 0 get the budget 0. `mixture` has a row per source and
    is small by nature; nothing here grows with the documents but a sum.
    """
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    plan = (
        mixture.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
        .join(have, "source", "left")
        .fillna(0, ["n_docs", "n_tokens"])
        .withColumn("_most", F.col("n_tokens") * F.col("max_repeats"))
    )
    if total_tokens is None:
        able = F.when((F.col("_most") > 0) & (F.col("target_share") > 0), F.col("_most") / F.col("target_share"))
        total = F.coalesce(F.min(able).over(Window.partitionBy()), F.lit(0.0))
    else:
        total = F.lit(float(total_tokens))
    budget = F.least(F.floor(F.col("target_share") * total), F.col("_most")).cast("long")
    return plan.withColumn("budget", F.greatest(budget, F.lit(0).cast("long"))).drop("_most")


def mix(documents: DataFrame, mixture: DataFrame, seed: int = 17, total_tokens: int | None = None, vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, range_bits: int = 10) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection: `doc_id, source, n_tokens, copies`, a row per chosen document,
    copies between 1 and the source's `max_repeats`. shares: a row per source of
    `mixture` with target and actual share.

    Documents without tokens or with a source that `mixture` lacks are never
    chosen; repeated texts are documents in their own right. The keys fall
    evenly into 2**range_bits ranges whatever a source's share of the rows, so no
    task gets more of it than a range. Ties of the key fall to the smaller id.
    A source's tokens end less than one document below its budget.
    """
    known = mixture.select("source").where(F.col("source").isNotNull()).distinct()
    wanted = documents.select("doc_id", "source", "text").join(known, "source", "left_semi")
    sizes = cut(token_counts(wanted, vocabulary=vocabulary, tokenizers=tokenizers).where(F.col("n_tokens") > 0))
    plan = cut(budgets(sizes, mixture, total_tokens))
    keyed = sizes.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_range", F.shiftrightunsigned("_key", 64 - range_bits))
    ranges = keyed.groupBy("source", "_range").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    epochs = plan.where("budget > 0").select(
        "source", F.floor(F.col("budget") / F.col("n_tokens")).cast("int").alias("_full"), (F.col("budget") % F.col("n_tokens")).alias("_rest")
    )
    selection = (
        keyed.withColumn("_run", F.sum("n_tokens").over(within))
        .join(offsets, ["source", "_range"])
        .join(epochs, "source")
        .withColumn("copies", F.col("_full") + F.when(F.col("_run") + F.col("_offset") <= F.col("_rest"), 1).otherwise(0))
        .where("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )
    chosen = selection.groupBy("source").agg(F.count(F.lit(1)).alias("docs_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    everything = Window.partitionBy()  # a row per source of the mixture
    shares = (
        plan.join(chosen, "source", "left")
        .fillna(0, ["docs_used", "tokens_used", "most_copies"])
        .withColumn("actual_share", F.coalesce(F.col("tokens_used") / F.nullif(F.sum("tokens_used").over(everything), F.lit(0)), F.lit(0.0)))
        .select("source", "target_share", "actual_share", "n_docs", "n_tokens", "budget", "docs_used", "tokens_used", "most_copies", "max_repeats")
    )
    return selection, shares
