"""Descriptive audits of sources and truth; each returns a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithspark.functions.text import all_matches, first_match, fold, sorted_key
from kithspark.operators.views import INDIC, LEGAL, STOP, name_tokens


def audit_tokens(c: str) -> Column:
    return all_matches(fold(F.col(c)), "[a-z0-9]+")


def audit_name_tokens(c: str = "name") -> Column:
    return name_tokens(fold(F.col(c)), STOP + LEGAL)


def audit_numbers(c: str = "addr") -> Column:
    return F.array_distinct(F.transform(all_matches(fold(F.col(c)), r"\d+"), lambda x: x.try_cast("bigint")))


def audit_house(c: str = "addr") -> Column:
    return first_match(fold(F.col(c)), r"^\D{0,12}?(\d[\w/-]*)")


def owners(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: labels, records, records of several owners, entities, singletons, most matches, mode of matches."""
    per_rec = truth.groupBy("rec_id").agg(F.count("*").alias("k")).agg(F.sum("k").alias("labels"), F.count("*").alias("records"), F.coalesce(F.sum((F.col("k") > 1).cast("int")), F.lit(0)).alias("multi_owner"))
    k = s1.select(F.col("id").alias("s1_id")).join(truth.groupBy("s1_id").agg(F.count("*").alias("k")), "s1_id", "left").na.fill(0, ["k"])
    sizes = k.groupBy("k").agg(F.count("*").alias("n"))
    per_s1 = sizes.agg(F.sum("n").alias("entities"), F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).alias("singletons"), F.max("k").alias("most"), F.max_by("k", F.struct("n", -F.col("k"))).alias("mode"))
    return per_rec.crossJoin(per_s1)  # one row each


def distractors(recs: DataFrame, truth: DataFrame) -> DataFrame:
    """(src, n, unmatched, share) of records by source."""
    owned = truth.select(F.col("rec_id").alias("id")).distinct().withColumn("o", F.lit(1))
    g = recs.join(owned, "id", "left").groupBy("src").agg(F.count("*").alias("n"), F.sum(F.col("o").isNull().cast("int")).alias("unmatched"))
    return g.withColumn("share", F.col("unmatched") / F.col("n"))


def country_agreement(s1: DataFrame, recs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: pairs and the share with one country."""
    p = truth.join(s1.select(F.col("id").alias("s1_id"), F.col("country").alias("c1")), "s1_id").join(recs.select(F.col("id").alias("rec_id"), "country"), "rec_id")
    return p.agg(F.count("*").alias("pairs"), F.avg((F.col("c1") == F.col("country")).cast("int")).alias("agree"))


def relation(a: Column, b: Column) -> Column:
    """How two house tokens differ; the first that holds."""
    x, y = F.regexp_extract(a, r"^(\d+)", 1), F.regexp_extract(b, r"^(\d+)", 1)
    gap = F.abs(x.try_cast("bigint") - y.try_cast("bigint"))
    out = F.when(a == b, "equal").when(x == y, "suffix differs").when(F.ltrim(x, F.lit("0")) == F.ltrim(y, F.lit("0")), "leading zero")
    out = out.when(F.endswith(x, y) | F.endswith(y, x), "first digit truncated").when(gap <= 10, "|delta| <= 10").when(gap <= 100, "|delta| <= 100")
    return out.otherwise("far")


def house_relation(s1: DataFrame, recs: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, rel, n, share): house relations of matched pairs, and of unmatched records with an entity of the same name key
    and city."""
    view = lambda df: df.select("id", sorted_key(audit_name_tokens()).alias("nkey"), F.lower(F.trim(F.try_element_at(F.split("addr", ","), F.lit(-2)))).alias("city"), audit_house().alias("h"))
    ours, theirs = view(s1), view(recs)
    matched = theirs.join(truth.withColumnRenamed("rec_id", "id"), "id").join(ours.select(F.col("id").alias("s1_id"), F.col("h").alias("h1")), "s1_id")
    free = theirs.join(truth.select(F.col("rec_id").alias("id")), "id", "left_anti")
    firsts = ours.groupBy("nkey", "city").agg(F.min_by("h", "id").alias("h1"))
    decoys = free.join(firsts, ["nkey", "city"])
    both = matched.select(F.lit("match").alias("kind"), "h", "h1").unionByName(decoys.select(F.lit("decoy").alias("kind"), "h", "h1")).dropna(subset=["h", "h1"])
    g = both.groupBy("kind", relation(F.col("h1"), F.col("h")).alias("rel")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("kind")))


def sibling_agreement(s1: DataFrame, recs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: groups of two or more siblings of one source whose first number differs from the entity's, and the share that
    agree on one wrong number."""
    first = lambda df, i, n: df.select(F.col("id").alias(i), *(["src"] if i == "rec_id" else []), F.get(audit_numbers(), F.lit(0)).alias(n))
    p = truth.join(first(s1, "s1_id", "n1"), "s1_id").join(first(recs, "rec_id", "n"), "rec_id").filter("n <> n1")
    g = p.groupBy("s1_id", "src").agg(F.count("*").alias("k"), F.countDistinct("n").alias("d")).filter("k >= 2")
    return g.agg(F.count("*").alias("groups"), F.avg((F.col("d") == 1).cast("int")).alias("one_number"))


def name_overlap(s1: DataFrame, recs: DataFrame, truth: DataFrame) -> DataFrame:
    """(country, n, no_shared, empty_addr): matched pairs without a shared name token, and with a blank address."""
    ours = s1.select(F.col("id").alias("s1_id"), "country", audit_name_tokens().alias("t1"))
    p = truth.join(ours, "s1_id").join(recs.select(F.col("id").alias("rec_id"), audit_name_tokens().alias("t"), "addr"), "rec_id")
    return p.groupBy("country").agg(F.count("*").alias("n"), F.avg((F.size(F.array_intersect("t", "t1")) == 0).cast("int")).alias("no_shared"), F.avg((F.trim("addr") == "").cast("int")).alias("empty_addr"))


def empty_address(recs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: records with a blank address and how many of them are matched."""
    blank = recs.filter(F.trim("addr") == "").select("id")
    owned = truth.select(F.col("rec_id").alias("id")).distinct().withColumn("o", F.lit(1))
    return blank.join(owned, "id", "left").agg(F.count("*").alias("n"), F.count("o").alias("matched"))


def native_alignment(s1: DataFrame, recs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: matched pairs with a native-script name and the share with equally many tokens."""
    count = F.size(F.split("name", " "))
    native = recs.filter(F.col("name").rlike(INDIC)).select(F.col("id").alias("rec_id"), count.alias("n"))
    p = truth.join(native, "rec_id").join(s1.select(F.col("id").alias("s1_id"), count.alias("n1")), "s1_id")
    return p.agg(F.count("*").alias("pairs"), F.avg((F.col("n") == F.col("n1")).cast("int")).alias("equal"))


def postal_codes(s1: DataFrame) -> DataFrame:
    """(country, n, five, six): shares of addresses with a number of five and of six digits."""
    has = lambda n: F.avg(F.col("addr").rlike(rf"\b\d{{{n}}}\b").cast("int"))
    return s1.groupBy("country").agg(F.count("*").alias("n"), has(5).alias("five"), has(6).alias("six"))


def order_leakage(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs and the correlation of two positions."""
    return pairs.agg(F.count("*").alias("pairs"), F.corr(a, b).alias("corr"))


def corruption_rates(s1: DataFrame, recs: DataFrame, truth: DataFrame) -> DataFrame:
    """(country, src, n, …): how often a matched record's name and address differ from the entity's, and how."""
    ours = s1.select(F.col("id").alias("s1_id"), "country", F.col("name").alias("n1"), F.col("addr").alias("a1"), audit_name_tokens().alias("t1"))
    theirs = recs.select(F.col("id").alias("rec_id"), "src", "name", "addr", audit_name_tokens().alias("t"))
    p = truth.join(ours, "s1_id").join(theirs, "rec_id")
    rate = lambda c, name: F.avg(c.cast("int")).alias(name)
    return p.groupBy("country", "src").agg(
        F.count("*").alias("n"), rate(F.col("name") != F.col("n1"), "name_changed"), rate(F.size(F.array_except("t", "t1")) > 0, "token_added"),
        rate(F.size(F.array_except("t1", "t")) > 0, "token_dropped"), rate(F.col("addr") != F.col("a1"), "addr_changed"), rate(F.trim("addr") == "", "addr_empty"),
    )
