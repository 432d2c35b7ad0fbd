"""Entity-level context of scored pairs, and positive rates of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithspark.functions.text import bucket

HIGH = 0.5
FLOOR = 0.01
LEAST_SEEN = 5
FOLDS = 5


def record_context(pred: DataFrame) -> DataFrame:
    """pred with p1, p_rank, p_r2 (the record's second score, 0) and p_margin (lead over the best other entity)."""
    by = Window.partitionBy("rec_id")
    ranked = pred.withColumn("p_rank", F.row_number().over(by.orderBy(F.desc("p"), F.asc("s1_id"))))
    second = F.coalesce(F.max(F.when(F.col("p_rank") == 2, F.col("p"))).over(by), F.lit(0.0))
    rows = ranked.withColumns({"p1": F.col("p"), "p_r2": second, "__best": F.max("p").over(by)})
    return rows.withColumn("p_margin", F.col("p") - F.when(F.col("p_rank") == 1, F.col("p_r2")).otherwise(F.col("__best"))).drop("__best")


def sibling_context(pred: DataFrame) -> DataFrame:
    """pred (with src, sig) with sib_n, others of the same entity, source and address with p >= 0.5, and sib_max, the
    greatest p among them (null when alone); both null without an address."""
    by = Window.partitionBy("s1_id", "src", "sig")
    rows = pred.withColumn("__r", F.row_number().over(by.orderBy(F.desc("p"), F.asc("rec_id"))))
    first, second = (F.max(F.when(F.col("__r") == k, F.col("p"))).over(by) for k in (1, 2))
    high = (F.col("p") >= HIGH).cast("int")
    rows = rows.withColumns({"__a": first, "__b": second, "__n": F.sum(high).over(by)})
    known = F.col("sig").isNotNull()
    own = F.when(F.col("p") >= F.col("__a"), F.col("__b")).otherwise(F.col("__a"))
    return rows.withColumns({"sib_n": F.when(known, F.col("__n") - high), "sib_max": F.when(known, own)}).drop("__r", "__a", "__b", "__n")


def source_context(pred: DataFrame, sources: tuple[int, int] = (2, 3)) -> DataFrame:
    """pred with s_hi_same, s_hi_other, s_max_other, s_sum_other: the entity's support in the record's own source (without
    the record) and in the other one."""
    a, b = sources
    by = Window.partitionBy("s1_id")
    high = (F.col("p") >= HIGH).cast("int")
    of = lambda f, s, x: F.coalesce(f(F.when(F.col("src") == s, x)).over(by), F.lit(0))
    own = lambda x, y: F.when(F.col("src") == a, x).otherwise(y)
    p = F.col("p")
    return pred.withColumns({
        "s_hi_same": own(of(F.sum, a, high), of(F.sum, b, high)) - high, "s_hi_other": own(of(F.sum, b, high), of(F.sum, a, high)),
        "s_max_other": own(of(F.max, b, p), of(F.max, a, p)), "s_sum_other": own(of(F.sum, b, p), of(F.sum, a, p)),
    })


#: Sides of changed tokens, and the features that their rates give. The sides' and features' names.
SIDES = {"name": {"r": "tr", "s": "ts"}, "street": {"ar": "ta", "as": "tas"}, "pair": {"p": "tp"}, "shape": {"c1": "tc1", "c2": "tc2"}}


def changed_tokens(pairs: DataFrame, *kinds: str) -> DataFrame:
    """(rec_id, s1_id, side, t): what the record changes of the entity's tokens, of pairs with nt_r, nt_s (and st_r, st_s).

    name: tokens added (r) and dropped (s). street: the same of street tokens (ar, as). pair: the exact substitution (p) of
    at most two tokens a side. shape: the first four (c1) and last four (c2) letters of added name tokens.
    """
    kinds = kinds or ("name",)
    add, drop = F.array_except("nt_r", "nt_s"), F.array_except("nt_s", "nt_r")
    tag = lambda side, ts: F.transform(ts, lambda t: F.struct(F.lit(side).alias("side"), t.alias("t")))
    parts = []
    if "name" in kinds:
        parts += [tag("r", add), tag("s", drop)]
    if "street" in kinds:
        parts += [tag("ar", F.array_except("st_r", "st_s")), tag("as", F.array_except("st_s", "st_r"))]
    if "pair" in kinds:
        text = F.concat(F.array_join(F.sort_array(drop), " "), F.lit(">"), F.array_join(F.sort_array(add), " "))
        few = (F.size(add) <= 2) & (F.size(drop) <= 2) & (F.size(add) + F.size(drop) > 0)
        parts.append(F.when(few, tag("p", F.array(text))).otherwise(F.array().cast("array<struct<side:string,t:string>>")))
    if "shape" in kinds:
        parts += [tag("c1", F.transform(add, lambda t: F.substring(t, 1, 4))), tag("c2", F.transform(add, lambda t: F.right(t, F.lit(4))))]
    return pairs.select("rec_id", "s1_id", F.inline(F.concat(*parts)))


def folds(ids: Column, k: int = FOLDS, seed: int = 17) -> Column:
    return bucket(ids, seed, k)


def rate_table(tokens: DataFrame) -> DataFrame:
    """(side, t, fold, n, s): pairs and matches by token and fold, of rows (side, t, fold, y)."""
    return tokens.groupBy("side", "t", "fold").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("int")).alias("s"))


def rated(tokens: DataFrame, rates: DataFrame, out_of_fold: bool = True) -> DataFrame:
    """tokens (…, side, t, fold) with seen, the pairs with the token (in the other folds; null where no table row has it),
    and rate, its matches / pairs there; null if seen in fewer than 5."""
    every = rates.groupBy("side", "t").agg(F.sum("n").alias("N"), F.sum("s").alias("S"))
    rows = tokens.join(every, ["side", "t"], "left")
    n, s = F.col("N"), F.col("S")
    if out_of_fold:
        rows = rows.join(rates.withColumnsRenamed({"n": "fn", "s": "fs"}), ["side", "t", "fold"], "left")
        n, s = n - F.coalesce("fn", F.lit(0)), s - F.coalesce("fs", F.lit(0))
    rows = rows.withColumn("seen", n)
    return rows.withColumn("rate", F.when(F.col("seen") >= LEAST_SEEN, F.try_divide(s.cast("double"), n.cast("double")))).drop("N", "S", "fn", "fs")


def token_rate_features(tokens: DataFrame, *kinds: str) -> DataFrame:
    """Per pair, of rated tokens: least and greatest rate of each side, how many added name tokens are rated (tr_n), the
    substitution's rate and how often it was seen (tp_rate, tp_n)."""
    out = []
    for kind in kinds or ("name",):
        for side, prefix in SIDES[kind].items():
            on = lambda f, c, side=side: f(F.when(F.col("side") == side, F.col(c)))
            if kind == "pair":
                has = F.max(F.when(F.col("side") == side, F.coalesce("seen", F.lit(0))))
                out += [on(F.max, "rate").alias("tp_rate"), has.alias("tp_n")]
            else:
                out += [on(F.min, "rate").alias(f"{prefix}_min"), on(F.max, "rate").alias(f"{prefix}_max")]
        if kind == "name":
            named = F.count(F.when(F.col("side") == "r", F.lit(1)))
            out.append(F.when(named > 0, F.count(F.when(F.col("side") == "r", F.col("rate")))).alias("tr_n"))
    return tokens.groupBy("rec_id", "s1_id").agg(*out)
