"""States of addresses, learned component maps, dev subsets and blocks."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithspark.operators.views import US_STATES, components, sampled

# Indian states and territories as addresses name them.
INDIA = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh",
    "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland",
    "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand",
    "west bengal", "delhi", "chandigarh", "puducherry", "jammu and kashmir", "ladakh", "lakshadweep",
    "andaman and nicobar islands", "dadra and nagar haveli and daman and diu",
]
GIANT = 0.06
SHARE = 0.10
BLOCK = 150_000


def state_list(spark: SparkSession) -> DataFrame:
    """(country, comp, state): codes of US states, names of Indian ones."""
    rows = [("US", c, f"US:{c}") for c in US_STATES.values()] + [("India", c, f"India:{c}") for c in INDIA]
    return spark.createDataFrame(rows, "country string, comp string, state string")


def last_match(comps: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, state): the state of each address's right-most component that the mapping knows."""
    return comps.join(mapping, ["country", "comp"]).groupBy("id").agg(F.max_by("state", F.struct("pos", "state")).alias("state"))


def with_state(s1: DataFrame, mapping: DataFrame) -> DataFrame:
    return s1.join(last_match(components(s1), mapping), "id", "left")


def learn_components(s1: DataFrame, recs: DataFrame, truth: DataFrame, least: int = 20, purity: float = 0.95) -> DataFrame:
    """(country, comp, state): components of matched records that stand with one entity state (s1 has state) nearly always."""
    owners = truth.join(s1.filter("state is not null").select(F.col("id").alias("s1_id"), "state"), "s1_id").select(F.col("rec_id").alias("id"), "state")
    counts = components(recs).join(owners, "id").groupBy("country", "comp", "state").agg(F.count("*").alias("k"))
    return pure(counts, ["country", "comp"], least, purity).select("country", "comp", "state")


def pure(counts: DataFrame, by: list[str], least: int, purity: float) -> DataFrame:
    """Rows of counts (k) with at least `purity` of their group's sum, in groups of at least `least`."""
    total = F.sum("k").over(Window.partitionBy(*by))
    return counts.withColumn("n", total).filter((F.col("n") >= least) & (F.col("k") / F.col("n") >= purity))


def dev_states(s1: DataFrame, share: float = SHARE, seed: int = 7) -> dict[str, list[str]]:
    """Whole states for two subsets: of each country in shuffled order, without giants, until each has its share."""
    rows = s1.filter("state is not null").groupBy("country", "state").count().orderBy("country", "state").collect()  # a row per state
    out: dict[str, list[str]] = {"devtrain": [], "devval": []}
    for country in sorted({r["country"] for r in rows}):
        own = [(r["state"], r["count"]) for r in rows if r["country"] == country]
        total = sum(n for _, n in own)
        random.Random(f"{seed}/{country}").shuffle(own)
        names = iter(out)
        name, got = next(names), 0
        for state, n in own:
            if n > GIANT * total:
                continue
            if got >= share * total:
                name, got = next(names, None), 0
                if name is None:
                    break
            out[name].append(state)
            got += n
    return out


def dev_subset(states: list[str], s1: DataFrame, recs: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, records, truth) of the states: their entities, what these own, unowned records of the states, and of the
    unowned ones without a state a hashed share of the same size."""
    own = s1.filter(F.col("state").isin(states))
    part = own.count() / max(1, s1.count())
    pairs = truth.join(own.select(F.col("id").alias("s1_id")), "s1_id", "left_semi")
    free = recs.join(truth.select(F.col("rec_id").alias("id")), "id", "left_anti")
    owned = recs.join(pairs.select(F.col("rec_id").alias("id")), "id", "left_semi")
    stray = sampled(free.filter("state is null"), "id", 11, 1000, int(part * 1000))
    return own, owned.unionByName(free.filter(F.col("state").isin(states))).unionByName(stray), pairs


def next_fit(sizes: list[tuple[str, str, int]], target: int = BLOCK) -> list[tuple[str, str, str]]:
    """(country, state, block): states, largest first, fill blocks of about target entities; ties by name."""
    out, fill = [], {}
    for country, state, n in sorted(sizes, key=lambda r: (r[0], -r[2], r[1])):
        number, used = fill.get(country, (0, 0))
        if used and used + n > target:
            number, used = number + 1, 0
        fill[country] = (number, used + n)
        out.append((country, state, f"{country}_{number}"))
    return out


def plan_blocks(s1: DataFrame, recs: DataFrame, target: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, country, block) of entities, "*" without a state, and of records, null without one; both frames have state."""
    sizes = [tuple(r) for r in s1.filter("state is not null").groupBy("country", "state").count().collect()]  # a row per state
    blocks = s1.sparkSession.createDataFrame(next_fit(sizes, target), "country string, state string, block string")
    place = lambda df: df.select("id", "country", "state").join(F.broadcast(blocks), ["country", "state"], "left").select("id", "country", "block")
    return place(s1).withColumn("block", F.coalesce("block", F.lit("*"))), place(recs)


def replicate(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows (id, country, block) with those of no block, or "*", in every block (country, block) of their country."""
    free = F.coalesce("block", F.lit("*")) == "*"
    spread = rows.filter(free).drop("block").join(blocks.filter("block <> '*'").select("country", "block").distinct(), "country")
    return rows.filter(~free).unionByName(spread)
