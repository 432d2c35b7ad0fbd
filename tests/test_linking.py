import pytest
from pyspark.sql import functions as F

from kithspark.operators import context, decide, learn, metrics, pair_features, retrieval, splits
from kithspark.plans import experiments, runs
from kithspark.sources import tables

PAIR = "s1_id string, rec_id string"


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), PAIR)


@pytest.fixture(scope="module")
def worked(spark):
    s1 = spark.createDataFrame([(x, "US") for x in "abcd"], "id string, country string")
    truth = pairs(spark, ("a", "S2-47"), ("a", "S3-812"), ("d", "S2-9"))
    pred = pairs(spark, ("a", "S2-47"), ("a", "S2-193"), ("a", "S3-812"), ("c", "S2-1"))
    return s1, truth, pred


def test_f05(worked):
    s1, truth, pred = worked
    got = {r["s1_id"]: r["f"] for r in metrics.per_entity(s1, truth, pred).collect()}
    assert got == {"a": pytest.approx(0.7142857), "b": 1.0, "c": 0.0, "d": 0.0}
    assert metrics.macro_f05(s1, truth, pred.unionByName(pred)) == pytest.approx((0.7142857 + 1) / 4)


def test_blocking_report(worked):
    s1, truth, pred = worked
    row = metrics.blocking_report(s1, truth, pred, 4).first()
    assert row["recall"] == pytest.approx(2 / 3) and row["oracle_f05"] == pytest.approx(0.75) and row["n_cands"] == 4


def test_bootstrap(worked):
    s1, truth, pred = worked
    lo, hi = metrics.bootstrap_ci(metrics.per_entity(s1, truth, pred))
    assert 0 <= lo <= metrics.macro_f05(s1, truth, pred) <= hi <= 1


def views(spark, rows, src=False):
    schema = "id string, name string, addr string, country string" + (", src tinyint" if src else "")
    from kithspark.operators.views import addr_view, name_view

    return addr_view(name_view(spark.createDataFrame(rows, schema), "V2"), "A2")


@pytest.fixture(scope="module")
def sides(spark):
    s1 = views(spark, [("S1-1", "Autrey Factory", "2626 Belmont Ave", "US"), ("S1-2", "Other Shop", "9 Main Street", "US"), ("S1-3", "Autrey Factory", "77 Elm Road", "US")])
    recs = views(spark, [("S2-1", "Autrey Factory Inc", "2631 Belmont Ave", "US", 2), ("S2-2", "Factory Autrey", "02626 BELMONT AVE", "US", 2), ("S3-3", "Other Shop", "", "US", 3), ("S3-4", "Nothing", "", "IN", 3)], True)
    return s1, recs


def test_exact_block(sides):
    s1, recs = sides
    got = {(r["rec_id"], r["s1_id"]): r["hits"] for r in retrieval.exact_block(s1, recs).collect()}
    assert got[("S2-2", "S1-1")] > got[("S2-2", "S1-3")] and ("S3-3", "S1-2") in got and not any(k[0] == "S3-4" for k in got)
    top = retrieval.exact_block(s1, recs, topk=1).collect()
    assert len({r["rec_id"] for r in top}) == len(top)
    assert retrieval.exact_block(s1, recs, cap=0).count() == 0


def test_sparse(sides):
    s1, recs = sides
    got = retrieval.sparse_topk(s1, recs, 2).collect()
    best = {r["rec_id"]: r["s1_id"] for r in got if r["rank"] == 1}
    assert best["S2-2"] == "S1-1" and best["S3-3"] == "S1-2"
    assert all(r["rank"] <= 2 for r in got)


def test_union_and_prune(spark):
    a = spark.createDataFrame([("r", "s", 1.0, 1), ("r", "t", 0.4, 2)], "rec_id string, s1_id string, score double, rank int")
    b = spark.createDataFrame([("r", "t", 3), ("r", "u", 1)], "rec_id string, s1_id string, hits bigint")
    both = retrieval.union_candidates(a, b)
    got = {r["s1_id"]: (r["sp_score"], r["ex_hits"]) for r in both.collect()}
    assert got["s"] == (1.0, None) and got["t"][1] == 3 and got["u"] == (None, 1)
    assert {r["s1_id"] for r in retrieval.prune(both).collect()} == {"s", "t"}
    assert retrieval.cap_entities(both, 1).count() == 3


def test_near_miss(sides, spark):
    s1, recs = sides
    cands = pairs(spark, ("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S3-3")).withColumns({"sp_score": F.lit(1.0), "sp_rank": F.lit(1), "ex_hits": F.lit(1)})
    got = {r["rec_id"]: r for r in pair_features.pair_features(cands, s1, recs, 4, spark.createDataFrame([("autrey",), ("factory",)], "word string")).collect()}
    near, zero, blank = got["S2-1"], got["S2-2"], got["S3-3"]
    assert (near["nj"], near["ncover"], near["ndiff"]) == (1.0, 0.0, 5.0) and zero["ncover"] == 1.0
    assert near["leg_rel"] == 2 and near["leg_add"] == 1
    assert blank["aempty"] == 1 and blank["ncover"] == 0 and blank["aj"] == 0 and blank["n_prefix"] is None
    assert near["n_collide"] == 2 and near["n_ratio"] == 100


def test_empty_jaccards(spark):
    df = spark.createDataFrame([([], [])], "a array<string>, b array<string>")
    assert df.select(pair_features.jaccard("a", "b"), pair_features.jaccard("a", "b", 0.0)).first()[:] == (None, 0.0)


def test_cross_numbers(spark):
    rows = [([12], [21]), ([12], [123]), ([23], [123]), ([100], [200]), ([], [1]), ([1234], [1243])]
    df = spark.createDataFrame(rows, "nums_s array<bigint>, nums_r array<bigint>")
    got = [r[:] for r in df.select(*pair_features.cross_number_features().values()).collect()]
    assert got[0] == (False, False, True, 9)  # an anagram differs in no digit of the set
    assert got[1] == (True, False, False, 111) and got[2] == (False, True, False, 100)
    assert got[3] == (False, False, True, 100) and got[4] == (None, None, None, None)


def test_rules(sides, spark):
    s1, recs = sides
    cands = pairs(spark, ("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S3-3"), ("S1-3", "S2-2"))
    scored = decide.rule_score(cands, s1, recs)
    assert {(r["s1_id"], r["rec_id"]) for r in scored.collect()} == {("S1-1", "S2-2"), ("S1-2", "S3-3")}
    tied = spark.createDataFrame([("a", "r", 1.0), ("b", "r", 1.0), ("a", "q", 0.5)], PAIR + ", score double")
    assert [r[:] for r in decide.assign_untied(tied).collect()] == [("a", "q")]


def scored(spark, *rows):
    return spark.createDataFrame(list(rows), PAIR + ", p double")


def test_decisions(spark):
    pred = scored(spark, ("b", "r", 0.9), ("a", "r", 0.9), ("a", "q", 0.6), ("b", "q", 0.55), ("c", "z", 0.2))
    assert {r[:2] for r in decide.assign(pred, 0.5).collect()} == {("a", "r"), ("a", "q")}
    best = {r["rec_id"]: (r["s1_id"], r["p2"]) for r in decide.record_best(pred).collect()}
    assert best == {"r": ("a", 0.9), "q": ("a", 0.55), "z": ("c", 0.0)}
    assert decide.margin(pred, 0.5, 0.04).count() == 1
    free = spark.createDataFrame([("q",)], "rec_id string")
    assert {r["rec_id"] for r in decide.cross_block_assign(pred.unionByName(pred), 0.5, free).collect()} == {"r"}
    assert {r[:] for r in decide.expected_f05(scored(spark, ("a", "r", 0.95), ("a", "q", 0.9), ("a", "z", 0.05))).collect()} == {("a", "r"), ("a", "q")}
    assert decide.expected_f05(scored(spark, ("a", "r", 0.1))).count() == 0


def test_tau(spark, worked):
    s1, truth, _ = worked
    pred = scored(spark, ("a", "S2-47", 0.9), ("a", "S3-812", 0.8), ("d", "S2-9", 0.7), ("c", "S2-1", 0.5))
    assert decide.choose_tau(pred, s1, truth) == (0.55, 1.0)
    for row in metrics.macro_by_threshold(pred, s1, truth, [0.3, 0.75]).collect():
        assert row["f"] == pytest.approx(metrics.macro_f05(s1, truth, decide.assign(pred, row["tau"])))
    best, score = decide.tune(decide.margin, [{"tau": 0.1, "m": 0.0}, {"tau": 0.6, "m": 0.0}, {"tau": 0.65, "m": 0.0}], pred, s1, truth)
    assert best == {"tau": 0.6, "m": 0.0} and score == 1


def test_context(spark):
    pred = spark.createDataFrame([("s", "r1", 0.9, 2, 1), ("s", "r2", 0.6, 2, 1), ("s", "r3", 0.3, 3, None), ("t", "r1", 0.4, 2, 1)], PAIR + ", p double, src int, sig bigint")
    ctx = {(r["s1_id"], r["rec_id"]): r for r in context.source_context(context.sibling_context(context.record_context(pred))).collect()}
    assert ctx[("s", "r1")]["p_margin"] == pytest.approx(0.5) and ctx[("t", "r1")]["p_margin"] == pytest.approx(-0.5)
    assert (ctx[("s", "r1")]["sib_n"], ctx[("s", "r1")]["sib_max"]) == (1, 0.6) and ctx[("s", "r2")]["sib_max"] == 0.9
    assert ctx[("t", "r1")]["sib_max"] is None and ctx[("s", "r3")]["sib_n"] is None
    assert ctx[("s", "r3")]["s_hi_other"] == 2 and ctx[("s", "r3")]["s_max_other"] == 0.9 and ctx[("t", "r1")]["s_sum_other"] == 0


def test_rates(spark):
    rows = [("r", "x", i % 5, i % 2 == 0, f"q{i}", "s") for i in range(10)] + [("r", "y", 0, True, "q0", "s")]
    tokens = spark.createDataFrame(rows, "side string, t string, fold int, y boolean, rec_id string, s1_id string")
    got = {(r["t"], r["rec_id"]): r["rate"] for r in context.rated(tokens, context.rate_table(tokens)).collect()}
    assert got[("x", "q0")] == 4 / 8 and got[("y", "q0")] is None
    whole = context.rated(tokens, context.rate_table(tokens), False)
    assert {r["rate"] for r in whole.filter("t = 'x'").collect()} == {0.5}


def test_changed_tokens(spark):
    df = spark.createDataFrame([("r", "s", ["a", "bcdefg"], ["a", "z"], ["x"], [])], "rec_id string, s1_id string, nt_r array<string>, nt_s array<string>, st_r array<string>, st_s array<string>")
    get = lambda *kinds: {(r["side"], r["t"]) for r in context.changed_tokens(df, *kinds).collect()}
    assert get("name") == {("r", "bcdefg"), ("s", "z")} and get("street") == {("ar", "x")}
    assert get("pair") == {("p", "z>bcdefg")} and get("shape") == {("c1", "bcde"), ("c2", "defg")}
    tokens = context.changed_tokens(df, "name", "street", "pair", "shape").withColumns({"rate": F.lit(0.5), "seen": F.lit(7)})
    row = context.token_rate_features(tokens, "name", "street", "pair", "shape").first().asDict()
    assert list(row)[2:] == [c for g in ("TOKR", "TOKA", "TOKP", "TOKC") for c in (lambda x: [x[0], x[1], x[2], x[3], x[4]] if g == "TOKR" else x)(runs.STAGE2[g])]
    assert row["tr_n"] == 1 and row["tp_n"] == 7 and row["tas_min"] is None


def test_splits(spark):
    assert splits.next_fit([("US", "a", 5), ("US", "b", 9), ("US", "c", 4), ("IN", "d", 1)], 10) == [("IN", "d", "IN_0"), ("US", "b", "US_0"), ("US", "a", "US_1"), ("US", "c", "US_1")]
    rows = [(f"{c}{i}", "X", f"t{j}") for j, c in enumerate("abcdefghijklmnopqrstuvwxyz") for i in range(4)]
    s1 = spark.createDataFrame(rows, "id string, country string, state string")
    states = splits.dev_states(s1)
    assert states["devtrain"] and states["devval"] and not set(states["devtrain"]) & set(states["devval"])
    recs = s1.select(F.concat(F.lit("r"), "id").alias("id"), "country", "state")
    truth = s1.select(F.col("id").alias("s1_id"), F.concat(F.lit("r"), "id").alias("rec_id"))
    own, some, gt = splits.dev_subset(states["devval"], s1, recs, truth)
    assert own.count() == some.count() == gt.count() == 4 * len(states["devval"])
    a, b = splits.plan_blocks(s1.withColumn("state", F.when(F.col("state") != "t0", F.col("state"))), recs, 20)
    assert a.filter("block = '*'").count() == 4 and splits.replicate(a, a).filter("id = 'a0'").count() == a.filter("block <> '*'").select("block").distinct().count()


def test_configs(tmp_path, spark):
    v = experiments.config("E-11v")
    assert (v["name"], v["addr"], v["cap"], v["q"], v["qn"], v["prune"], v["s1cap"], v["fv"]) == ("V4", "A3", 3000, 6, 3, 0.5, 50, 4)
    assert v["stage2"] == ["CTX2", "SIB", "XSRC", "TOKR"] and len(pair_features.VERSIONS[4]) == 43 and len(pair_features.VERSIONS[1]) == 30
    assert experiments.pairs_path("x", v, "dev") == experiments.pairs_path("x", experiments.config("E-07s"), "dev") != experiments.pairs_path("x", experiments.config("E-07r"), "dev")
    log = str(tmp_path / "log")
    experiments.log_experiment(spark, log, "E-01", subset="devval", macro_f05=0.6396512, hypothesis='a "guess", or so')
    experiments.log_experiment(spark, log, "E-01", subset="devval", macro_f05=0.7, notes="old")
    experiments.log_experiment(spark, log, "E-01", subset="devtrain")
    for _ in range(2):
        experiments.conclude(spark, log, "E-01", "KEEP", "new")
    got = experiments.read_log(spark, log).orderBy("timestamp").collect()
    assert [r["conclusion"] for r in got] == ["INFO", "KEEP", "INFO"] and got[0]["macro_f05"] == "0.63965" and got[1]["notes"] == "new | new | old"
    assert got[0]["hypothesis"] == 'a "guess", or so' and got[0]["parent_id"] == "E-00" and got[0]["change"] == '{"name": "V2"}'


def test_sources(tmp_path, spark):
    (tmp_path / "train_s1.tsv").write_text('id\tname\taddr\tcountry\nS1-1\tA "q" B\t\tUS\n')
    for s in (2, 3):
        (tmp_path / f"train_s{s}.tsv").write_text(f"id\tname\taddr\tcountry\nS{s}-1\tx\t1 A\tUS\n")
    (tmp_path / "train_gt.tsv").write_text("s1\tm\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    to = str(tmp_path / "pq")
    tables.ingest(spark, str(tmp_path), to, ("train",))
    tables.ingest(spark, str(tmp_path), to, ("train",))
    assert tables.load(spark, to, "train", 1).first()[:] == ("S1-1", 'A "q" B', "", "US")
    assert {r["src"] for r in tables.load_recs(spark, to, "train").collect()} == {2, 3}
    truth = tables.load_truth(spark, to)
    assert {r[:] for r in truth.collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-1")}
    lists = tables.id_lists(spark.createDataFrame([("S1-1",), ("S1-2",)], "id string"), truth.unionByName(truth))
    assert {r[:] for r in lists.collect()} == {("S1-1", "S2-1,S3-1"), ("S1-2", "")}
    tables.write_tsv(lists.coalesce(1).orderBy("source1_entity_id"), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n"
    tables.write_meta(spark, str(tmp_path / "meta"), {"tau": 0.7})
    assert tables.read_meta(spark, str(tmp_path / "meta")) == {"tau": 0.7}
    tables.write_pairs(truth, str(tmp_path / "pairs"), 2)
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 2


def linked(spark, n=60):
    s1 = [(f"S1-{i}", f"alpha{i} beta{i % 7}", f"{i + 10} main street{i % 5}", "US" if i % 2 else "India") for i in range(n)]
    recs = [(f"S{2 + i % 2}-{i}", f"alpha{i} beta{i % 7}" if i % 3 else f"alpha{i}", f"{i + 10 + (i % 4 == 0)} main street{i % 5}", "US" if i % 2 else "India", 2 + i % 2) for i in range(n)]
    raw = "id string, name string, addr string, country string"
    truth = [(f"S1-{i}", f"S{2 + i % 2}-{i}") for i in range(n)]
    return runs.Data(spark.createDataFrame(s1, raw), spark.createDataFrame(recs, raw + ", src tinyint"), spark.createDataFrame(truth, PAIR))


def test_runs(spark):
    data = linked(spark)
    out = runs.run("E-04a", data, data)
    assert out["report"].filter("country = 'all'").first()["precision"] == 1
    small = dict(rounds=1, depth=2, least=1)
    first = runs.run_learned(experiments.config("E-07b"), data, data, **small)
    assert metrics.macro_f05(data.s1, data.truth, first["assigned"]) > 0.8
    params, got = runs.run_decision(experiments.config("E-13"), first["oof"], first["pred"], data)
    assert "floor" in params and got.count() > 0
    assert learn.importance(first["model"], pair_features.VERSIONS[2])[0][1] > 0


SMALL = dict(rounds=1, depth=2, least=1)


@pytest.fixture
def interpreted(spark):
    """Whole runs over a few rows take their time from compiling and re-planning; here plans are interpreted as they are."""
    own = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.usefixtures("interpreted")
def test_second_stage(spark):
    data = linked(spark)
    out = runs.run("E-11w", data, data, **SMALL)
    assert metrics.macro_f05(data.s1, data.truth, out["assigned"]) > 0.8 and out["report"].filter("country = 'all'").first()["precision"] > 0.8
    assert out["features"][-15:] == runs.STAGE2["TOKR"] + runs.STAGE2["TOKA"] + runs.STAGE2["TOKP"] + runs.STAGE2["TOKC"]
    whole = runs.full_rates(experiments.config("E-11w"), out["oof"], data, data.s1.limit(5).select(F.col("id").alias("s1_id")))
    assert {r["side"] for r in whole.select("side").distinct().collect()} <= {"r", "s", "ar", "as", "p", "c1", "c2"}


@pytest.mark.usefixtures("interpreted")
def test_test_labels_are_not_seen(spark):
    """Other labels of the test pairs, the same features; those of the training pairs do matter."""
    data = linked(spark)
    conf = experiments.config("E-07b") | {"stage2": ["CTX2", "TOKR", "TOKP"]}
    of = runs.build_pairs(conf, data)
    pred = of.pairs.select("rec_id", "s1_id", F.lit(0.5).cast("float").alias("p"))
    flipped = runs.Pairs(of.pairs.withColumn("y", (1 - F.col("y")).cast("byte")), of.s1, of.recs)
    feats = ["rec_id", "s1_id", *runs.STAGE2["CTX2"], *runs.STAGE2["TOKR"], *runs.STAGE2["TOKP"]]
    table, rates = runs.stage_two_table(conf, of, pred)
    rows = lambda df: sorted(map(repr, df.select(*feats).collect()))
    assert rows(runs.stage_two_table(conf, of, pred, rates, False)[0]) == rows(runs.stage_two_table(conf, flipped, pred, rates, False)[0])
    assert rows(runs.stage_two_table(conf, flipped, pred)[0]) != rows(table)
    with pytest.raises(ValueError, match="rates"):
        runs.stage_two_table(conf, of, pred, None, False)


@pytest.mark.usefixtures("interpreted")
def test_parameters_go_to_the_second_stage(spark, monkeypatch, tmp_path):
    seen = []
    fit = learn.fit
    monkeypatch.setattr(learn, "fit", lambda rows, feats, **p: (seen.append((len(feats), p.get("depth"))), fit(rows, feats, **(p | SMALL)))[1])
    data = linked(spark, 30)
    runs.run("E-11x", data, data, cache=str(tmp_path))
    assert seen == [(43, None)] * 3 + [(58, 8)] * 3
    assert len(list((tmp_path / "pairs").iterdir())) == 2  # E-07s and what shares its pairs, of both subsets


@pytest.mark.usefixtures("interpreted")
def test_across_countries(spark):
    data = linked(spark)
    got = runs.run("E-14", data, data, **SMALL)["by_country"]
    assert set(got) == {"US", "India"} and all(r["gap"] == pytest.approx(r["f05"] - r["f05_both"]) and r["f05_both"] > 0.5 for r in got.values())


def test_weak_records(spark):
    recs = spark.createDataFrame([("a", "<null>", []), ("b", "1 x", ["1", "x"]), ("c", "2 y", ["2", "y"])], "id string, addr string, at array<string>")
    found = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "t")], "rec_id string, s1_id string")
    assert sorted(r["id"] for r in retrieval.weak_records(recs, found).collect()) == ["a", "c"]


@pytest.mark.usefixtures("interpreted")
def test_inference(spark, tmp_path):
    """Models trained, saved, loaded and applied in several blocks find what belongs together; outputs have a row an entity."""
    from kithspark.plans import inference

    data = linked(spark, 40)
    models = inference.train(data, str(tmp_path / "models"), **SMALL)
    assert models.meta["F2"][:43] == models.meta["F1"] and models.rates.columns == ["side", "t", "fold", "n", "s"]
    s1, recs = (df.withColumn("addr", F.concat("addr", F.when(F.col("country") == "US", ", tx").otherwise(", goa"))) for df in (data.s1, data.recs))
    components = spark.createDataFrame([("US", "tx", "US:tx"), ("India", "goa", "India:goa")], "country string, comp string, state string")
    recs = recs.withColumn("addr", F.when(F.col("id") == "S2-0", "10 main street0").otherwise(F.col("addr")))
    blocks = inference.plan(s1, recs, components, 10)
    assert {r["block"] for r in blocks[0].collect()} == {"US_0", "India_0"} and blocks[1].filter("block is null").count() == 1
    got = inference.infer(models, s1, recs, components, str(tmp_path / "out"), 10, 0.0)
    assert metrics.macro_f05(data.s1, data.truth, got) > 0.7
    for name in ("matching_results", "candidate_pairs"):
        rows = spark.read.csv(str(tmp_path / "out" / f"{name}.tsv"), sep="\t", header=True)
        assert rows.count() == 40 and rows.columns[0] == "source1_entity_id"


def test_dev_loader(spark, tmp_path):
    from kithspark.operators.views import US_STATES
    from kithspark.plans import inference

    codes = sorted(US_STATES.values())[:40]
    raw = "id string, name string, addr string, country string"
    s1 = spark.createDataFrame([(f"S1-{c}{i}", f"n{i}", f"{i} road, {c}", "US") for c in codes for i in range(3)], raw)
    for k in (1, 2, 3):
        s1.withColumn("id", F.regexp_replace("id", "^S1", f"S{k}")).write.parquet(f"{tmp_path}/train_s{k}")
    s1.select(F.col("id").alias("s1_id"), F.regexp_replace("id", "^S1", "S2").alias("rec_id")).write.parquet(f"{tmp_path}/train_gt")
    one, two = (inference.load_dev(spark, str(tmp_path), n) for n in ("devtrain", "devval"))
    assert one.s1.count() > 0 and two.s1.count() > 0 and one.s1.join(two.s1, "id").count() == 0
    assert one.truth.count() == one.s1.count() and one.recs.filter("src = 2").count() == one.s1.count()
    assert inference.load_dictionary(spark, str(tmp_path)).count() == 0 and tables.exists(spark, f"{tmp_path}/dictionary_all")


def test_one_block_is_no_block(spark):
    data = linked(spark)
    conf = experiments.config("E-04a")
    s1, recs, _ = runs.views(conf, data)
    state = lambda df: df.withColumn("state", F.col("country"))
    a, b = splits.plan_blocks(state(s1), state(recs), 1000)
    odd = lambda df: df.withColumn("id", F.concat(F.lit("@"), "id", F.lit("@")))
    assert {r["rec_id"][0] + r["rec_id"][-1] for r in runs.score_blocks(odd(s1), odd(recs), odd(a), odd(b), conf).collect()} == {"@@"}
    blocks = runs.score_blocks(s1, recs, a, b, conf)
    whole = decide.rule_score(retrieval.candidates(conf, s1, recs), s1, recs, conf["addr"])
    assert {r[:] for r in blocks.select("rec_id", "s1_id").collect()} == {r[:] for r in whole.select("rec_id", "s1_id").collect()}


def test_ties_in_blocks_go_by_id_and_block(spark):
    """As text "S1-33@US_0" is before "S1-3@US_0"."""
    raw = "id string, name string, addr string, country string"
    data = runs.Data(spark.createDataFrame([(f"S1-{i}", "Blue Door", "7 Elm Road", "US") for i in ("3", "33")], raw), spark.createDataFrame([("S2-1", "Blue Door", "7 Elm Road", "US", 2)], raw + ", src tinyint"), pairs(spark, ("S1-3", "S2-1")))
    conf = experiments.config("E-04a") | {"topk": 1}
    s1, recs, _ = runs.views(conf, data)
    state = lambda df: df.withColumn("state", F.col("country"))
    got = runs.score_blocks(s1, recs, *splits.plan_blocks(state(s1), state(recs), 1000), conf).collect()
    assert [r[:3] for r in got] == [("US_0", "S2-1", "S1-33")]


def test_stream(tmp_path, spark):
    from kithspark.streaming.linking import entity_index, link_stream

    data = linked(spark)
    raw = data.recs.drop("src")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = link_stream(stream, entity_index(data.s1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 3 and got.select("rec_id").distinct().count() > 30
