"""The frozen configuration at full scale: models trained once, all blocks of the data scored in one plan, outputs written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithspark.functions.text import all_matches, fold
from kithspark.operators import decide, learn, splits
from kithspark.operators.pair_features import VERSIONS, pair_features
from kithspark.operators.retrieval import candidates
from kithspark.operators.views import addr_view, learn_dictionary, name_view, vocabulary
from kithspark.plans import runs
from kithspark.plans.experiments import config
from kithspark.scratch import cut
from kithspark.sources import tables

#: The frozen experiment; how much higher the threshold is on data with more unmatched records than train has.
FROZEN = "E-11v"
TAU_SHIFT = 0.05


@dataclass
class Models:
    """Both stages, the rate table and the native-script dictionary; meta: experiment, tau, oof_f05, F1 and F2."""

    stage1: PipelineModel
    stage2: PipelineModel
    rates: DataFrame | None
    dictionary: DataFrame
    meta: dict


def train(data: runs.Data, root: str, name: str = FROZEN, rates: DataFrame | None = None, **params) -> Models:
    """Fit both stages on data, save them under root with the rate table, the dictionary and the metadata, and load them."""
    spark = data.s1.sparkSession
    conf = config(name)
    f1, f2 = VERSIONS[conf["fv"]], runs.stage_two_features(conf)
    of = runs.build_pairs(conf, data)
    oof = cut(learn.out_of_fold(of.pairs, f1, **params))
    learn.save(learn.fit(of.pairs, f1, **params), f"{root}/stage1")
    second, table = runs.stage_two_table(conf, of, oof, rates)
    own = conf.get("hp", {}) | params
    tau, score = decide.choose_tau(cut(learn.out_of_fold(second, f2, **own)), data.s1, data.truth)
    learn.save(learn.fit(second, f2, **own), f"{root}/stage2")
    if table is not None:
        table.write.mode("overwrite").parquet(f"{root}/token_rates")
    learn_dictionary(data.recs, data.s1, data.truth).write.mode("overwrite").parquet(f"{root}/dictionary")
    tables.write_meta(spark, f"{root}/meta", {"experiment": name, "tau": tau, "oof_f05": score, "F1": f1, "F2": f2})
    return load(spark, root)


def load(spark: SparkSession, root: str) -> Models:
    rates = spark.read.parquet(f"{root}/token_rates") if tables.exists(spark, f"{root}/token_rates") else None
    return Models(learn.load(f"{root}/stage1"), learn.load(f"{root}/stage2"), rates, spark.read.parquet(f"{root}/dictionary"), tables.read_meta(spark, f"{root}/meta"))


def plan(s1: DataFrame, recs: DataFrame, components: DataFrame, target: int = splits.BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, country, block) of entities and records.

    An entity's state is the one its address names, else the one that its components (country, comp, state) were learnt to
    stand with; countries without states are one. A record's state is the learnt one. Entities without a state are in
    every block of their country ("*"), and so are records (null).
    """
    learnt = lambda df: splits.with_state(df, components)
    named = splits.with_state(s1.select("id", "country", "addr"), splits.state_list(s1.sparkSession)).withColumnRenamed("state", "named")
    both = learnt(named).withColumn("state", F.when(F.col("country").isin("US", "India"), F.coalesce("named", "state")).otherwise(F.col("country")))
    free = learnt(recs.select("id", "country", "addr"))
    free = free.withColumn("state", F.when(F.col("country").isin("US", "India"), F.col("state")).otherwise(F.coalesce("state", "country")))
    return splits.plan_blocks(both, free, target)


def score(models: Models, s1: DataFrame, recs: DataFrame, blocks_s1: DataFrame, blocks_recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, scores) as (block, rec_id, s1_id, ...): the block is the partition key of every count, cap, rank and join,
    so all blocks run in one plan and none waits for another."""
    conf = config(models.meta["experiment"])
    words = vocabulary(s1)
    view = lambda df: addr_view(name_view(df, conf["name"], words, models.dictionary), conf["addr"])
    a, b = cut(runs.in_blocks(view(s1), blocks_s1, blocks_s1)), cut(runs.in_blocks(view(recs), blocks_recs, blocks_s1))
    own_words = a.select("country", F.explode(all_matches(fold(F.col("name")), "[a-z0-9]+")).alias("word")).distinct()
    found = cut(candidates(conf, a, b))
    of = runs.Pairs(cut(pair_features(found, a, b, conf["fv"], own_words)), a, b)
    first = cut(learn.predict(models.stage1, of.pairs, models.meta["F1"]))
    second, _ = runs.stage_two_table(conf, of, first, models.rates, out_of_fold=False)
    scores = learn.predict(models.stage2, second, models.meta["F2"])
    return runs.out_of_blocks(found.select("rec_id", "s1_id")), cut(runs.out_of_blocks(scores))


def finish(models: Models, scores: DataFrame, blocks_recs: DataFrame, tau_shift: float = 0.0) -> DataFrame:
    """(s1_id, rec_id): each record's best entity over all blocks; one that stood in several must win by a margin."""
    free = blocks_recs.filter("block is null").select(F.col("id").alias("rec_id"))
    return decide.cross_block_assign(scores, models.meta["tau"] + tau_shift, free)


def infer(models: Models, s1: DataFrame, recs: DataFrame, components: DataFrame, out: str | None = None, target: int = splits.BLOCK, tau_shift: float = TAU_SHIFT) -> DataFrame:
    """Matches (s1_id, rec_id) of a whole split; with out, also written there: matching_results and candidate_pairs, a row per
    entity with its ids."""
    blocks = tuple(cut(b) for b in plan(s1, recs, components, target))
    found, scores = score(models, s1, recs, *blocks)
    got = cut(finish(models, scores, blocks[1], tau_shift))
    if out:
        tables.write_tsv(tables.id_lists(s1, got), f"{out}/matching_results.tsv")
        lists = tables.id_lists(s1, found).withColumnRenamed("matched_entity_ids", "candidate_entity_ids")
        tables.write_tsv(lists, f"{out}/candidate_pairs.tsv")
    return got


def load_dev(spark: SparkSession, at: str, name: str) -> runs.Data:
    """A dev subset (devtrain or devval) of the ingested training tables, by whole states. What is learnt on the way, the
    component map and the choice of states, is kept beside the tables."""
    s1, recs, truth = tables.load(spark, at, "train", 1), tables.load_recs(spark, at, "train"), tables.load_truth(spark, at)
    placed = cut(splits.with_state(s1, splits.state_list(spark)))
    components = tables.memo(spark, f"{at}/component_map", lambda: splits.learn_components(placed, recs, truth))
    chosen = tables.memo(spark, f"{at}/dev_states", lambda: spark.createDataFrame([(k, s) for k, v in splits.dev_states(placed).items() for s in v], "subset string, state string"))
    states = [r["state"] for r in chosen.filter(F.col("subset") == name).collect()]  # a row per state
    own, some, pairs = splits.dev_subset(states, placed, cut(splits.with_state(recs, components)), truth)
    return runs.Data(own.drop("state"), some.drop("state"), pairs)


def load_dictionary(spark: SparkSession, at: str, leave_out: DataFrame | None = None, tag: str = "all") -> DataFrame:
    """The native-script dictionary of the training tables without the pairs of some entities (s1_id), kept by its tag."""
    make = lambda: learn_dictionary(tables.load_recs(spark, at, "train"), tables.load(spark, at, "train", 1), tables.load_truth(spark, at), leave_out)
    return tables.memo(spark, f"{at}/dictionary_{tag}", make)
