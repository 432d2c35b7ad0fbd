"""F0.5 per entity, reports, blocking quality, confidence intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(tp: Column, truth: Column, pred: Column) -> Column:
    return F.when((truth == 0) & (pred == 0), 1.0).otherwise(F.lit(1.25) * tp / (F.lit(0.25) * truth + pred))


def per_entity(s1: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """s1_id, country, n_true, n_pred, tp, f of every entity (id, country); 1 where both sides are empty.

    Pairs are tagged, united and aggregated once; entities join once.
    """
    tag = lambda df, t, p: df.select("s1_id", "rec_id").select("*", F.lit(t).alias("t"), F.lit(p).alias("p"))
    both = tag(truth, 1, 0).unionByName(tag(pred, 0, 1)).groupBy("s1_id", "rec_id").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    sums = both.groupBy("s1_id").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    out = s1.select(F.col("id").alias("s1_id"), "country").join(sums, "s1_id", "left").na.fill(0, ["n_true", "n_pred", "tp"])
    return out.withColumn("f", f05(F.col("tp"), F.col("n_true"), F.col("n_pred")))


def macro_f05(s1: DataFrame, truth: DataFrame, pred: DataFrame) -> float:
    return per_entity(s1, truth, pred).agg(F.avg("f")).first()[0]


def report(s1: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: macro F0.5, micro precision and recall, mean of singletons; and one per country (country, n, macro_f05)."""
    e = per_entity(s1, truth, pred)
    ratio = lambda c: F.sum("tp") / F.greatest(F.sum(c), F.lit(1)).cast("double")
    return e.rollup("country").agg(
        F.count("*").alias("n_s1"), F.avg("f").alias("macro_f05"), ratio("n_pred").alias("precision"), ratio("n_true").alias("recall"),
        F.avg(F.when(F.col("n_true") == 0, F.col("f"))).alias("singleton_f05"),
    ).withColumn("country", F.coalesce("country", F.lit("all")))


def blocking_report(s1: DataFrame, truth: DataFrame, candidates: DataFrame, n_recs: int | Column, strata: DataFrame | None = None) -> DataFrame:
    """One row (stratum "all"): candidates, per entity, per record, recall, oracle F0.5; and a row with the recall of each stratum."""
    pairs = candidates.select("s1_id", "rec_id").distinct()
    found = truth.join(pairs.withColumn("hit", F.lit(1)), ["s1_id", "rec_id"], "left").na.fill(0, ["hit"])
    oracle = per_entity(s1, truth, found.filter("hit = 1")).agg(F.avg("f").alias("oracle_f05"), F.count("*").alias("n_s1"))
    counts = pairs.agg(F.count("*").alias("n_cands"))
    total = found.agg(F.avg("hit").alias("recall")).crossJoin(oracle).crossJoin(counts)  # three single rows
    out = total.select(F.lit("all").alias("stratum"), "n_cands", F.try_divide("n_cands", "n_s1").alias("per_s1"), (F.col("n_cands") / F.lit(n_recs)).alias("per_rec"), "recall", "oracle_f05")
    if strata is None:
        return out
    each = found.join(strata, ["s1_id", "rec_id"]).groupBy("stratum").agg(F.avg("hit").alias("recall"))
    return out.unionByName(each, allowMissingColumns=True)


def macro_by_threshold(pred: DataFrame, s1: DataFrame, truth: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, precision, recall, f): the curve of best-entity assignments, every threshold in one pass.

    A record's best entity is the same at every threshold, so only the best pairs meet the thresholds that they reach.
    """
    from kithspark.operators.decide import best_first
    from kithspark.operators.retrieval import top_k

    best = top_k(pred.select("rec_id", "s1_id", "p"), "rec_id", best_first(), 1)
    marked = best.join(truth.select("rec_id", "s1_id").distinct().withColumn("t", F.lit(1)), ["rec_id", "s1_id"], "left").na.fill(0, ["t"])
    reached = marked.select("s1_id", "t", F.explode(F.filter(F.array(*map(F.lit, taus)), lambda x: x <= F.col("p"))).alias("tau"))
    mine = reached.groupBy("tau", "s1_id").agg(F.count("*").alias("n"), F.sum("t").alias("tp"))
    ids = s1.select(F.col("id").alias("s1_id"))
    n_true = ids.join(truth.distinct().groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").na.fill(0)
    base = n_true.agg(F.sum((F.col("n_true") == 0).cast("int")).alias("alone"), F.count("*").alias("ents"), F.sum("n_true").alias("all_true"))
    gain = mine.join(n_true, "s1_id").select("tau", "tp", "n", (f05(F.col("tp"), F.col("n_true"), F.col("n")) - (F.col("n_true") == 0).cast("int")).alias("d"))
    sums = gain.groupBy("tau").agg(F.sum("d").alias("d"), F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    grid = s1.sparkSession.createDataFrame([(float(t),) for t in taus], "tau double")
    rows = grid.join(F.broadcast(sums), "tau", "left").na.fill(0).crossJoin(base)  # a row per threshold and one row
    return rows.select("tau", (F.col("tp") / F.greatest("n", F.lit(1)).cast("double")).alias("precision"), (F.col("tp") / F.greatest("all_true", F.lit(1)).cast("double")).alias("recall"), ((F.col("alone") + F.col("d")) / F.col("ents")).alias("f"))


def bootstrap_ci(per_s1: DataFrame, seed: int = 0, resamples: int = 1000) -> tuple[float, float]:
    """2.5 % and 97.5 % bounds of the mean f, by resampling equal values as counts.

    f takes few distinct values, so a resample is one draw of counts of (value, how often); entities stay distributed.
    """
    import numpy as np

    rows = per_s1.groupBy(F.round("f", 6).alias("f")).count().orderBy("f").collect()  # a row per distinct value
    values, counts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
    draws = np.random.default_rng(seed).multinomial(counts.sum(), counts / counts.sum(), resamples)
    means = draws @ values / counts.sum()
    return tuple(np.quantile(means, [0.025, 0.975]).tolist())


def false_positives(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(kind, n): wrong pairs whose record belongs to another entity, and those whose record belongs to none."""
    wrong = pred.select("s1_id", "rec_id").join(truth, ["s1_id", "rec_id"], "left_anti")
    owned = truth.select("rec_id").distinct().withColumn("kind", F.lit("wrong_s1"))
    return wrong.join(owned, "rec_id", "left").groupBy(F.coalesce("kind", F.lit("distractor")).alias("kind")).agg(F.count("*").alias("n"))


def score_histogram(pred: DataFrame, bins: int = 40) -> DataFrame:
    """(bin, y, n): scores in equal bins, by label."""
    return pred.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin"), "y").agg(F.count("*").alias("n"))


def f05_by_matches(per_s1: DataFrame) -> DataFrame:
    """(n_true, n, f): entities and mean F0.5 by true matches."""
    return per_s1.groupBy("n_true").agg(F.count("*").alias("n"), F.avg("f").alias("f"))


def f05_bins(per_s1: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, loss): entities and their loss 1 - f by equal bins of f."""
    return per_s1.groupBy(F.least(F.floor(F.round("f", 9) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum(1 - F.col("f")).alias("loss"))


def matches_per_entity(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """(k, n): how many entities have k matches."""
    counts = truth.select("s1_id", "rec_id").distinct().groupBy("s1_id").agg(F.count("*").alias("k"))
    return s1.select(F.col("id").alias("s1_id")).join(counts, "s1_id", "left").groupBy(F.coalesce("k", F.lit(0)).alias("k")).agg(F.count("*").alias("n"))


def f05_by_block(per_s1: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, n, f): entities and mean F0.5 of each block (id, block); "*" is a block of its own."""
    return per_s1.join(blocks.select(F.col("id").alias("s1_id"), "block"), "s1_id").groupBy("block").agg(F.count("*").alias("n"), F.avg("f").alias("f"))


def loss_report(per_s1: DataFrame) -> DataFrame:
    """Per country and for all: entities, total loss 1 - f, that of entities without matches, perfect and empty-handed ones."""
    lone, loss = F.col("n_true") == 0, 1 - F.col("f")
    return per_s1.rollup("country").agg(
        F.count("*").alias("n_s1"), F.sum(loss).alias("loss"), F.coalesce(F.sum(F.when(lone, loss)), F.lit(0.0)).alias("loss_singleton"), F.count_if(F.col("f") == 1).alias("s1_perfect"),
        F.count_if(F.col("f") == 0).alias("s1_zero"), F.count_if(lone & (F.col("n_pred") > 0)).alias("singletons_with_pred"),
    ).withColumn("country", F.coalesce("country", F.lit("all")))


def error_anatomy(truth: DataFrame, candidates: DataFrame, pred: DataFrame, strata: DataFrame) -> DataFrame:
    """(stratum, cause, n) of missed pairs: not_retrieved, given_to_other_s1, below_tau."""
    missed = truth.join(pred.select("s1_id", "rec_id"), ["s1_id", "rec_id"], "left_anti")
    had = candidates.select("s1_id", "rec_id").distinct().withColumn("had", F.lit(True))
    given = pred.select("rec_id").distinct().withColumn("given", F.lit(True))
    why = F.when(F.col("had").isNull(), "not_retrieved").when(F.col("given").isNotNull(), "given_to_other_s1").otherwise("below_tau")
    rows = missed.join(had, ["s1_id", "rec_id"], "left").join(given, "rec_id", "left").join(strata, ["s1_id", "rec_id"])
    return rows.groupBy("stratum", why.alias("cause")).agg(F.count("*").alias("n"))


def false_positive_classes(wrong: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, n) of wrong pairs with nj, n1, nr, ncover, aempty: by owner, then name and number relation."""
    owned = truth.select("rec_id").distinct().withColumn("owned", F.lit(True))
    same = F.col("nj") == 1
    kind = F.when(F.col("owned").isNotNull(), "record belongs to another S1").when(same & F.col("aempty"), "same name, empty address")
    kind = kind.when(same & (F.coalesce("ncover", F.lit(0.0)) < 1) & (F.col("n1") > 0), "near-miss decoy (same name, number differs)").when(same, "same name, numbers agree")
    kind = kind.when(F.col("nj") >= 0.5, "similar name").otherwise("dissimilar name, similar address")
    return wrong.join(owned, "rec_id", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
