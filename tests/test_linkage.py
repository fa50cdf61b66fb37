"""Blocking, ranking, decisions, metrics, validator, files and streaming on small cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.functions import text
from kinlink.operators import blocking, decide, keys, metrics, model, pair_features, prescreen, validate
from kinlink.plans import training
from kinlink.plans.link import FORMS, LinkConfig, candidates, link, normalised, rescored
from kinlink.sources import tsv
from kinlink.streaming import incremental

ENTITY = "entity_id string, business_name string, business_address string, country string"
ROWS = [
    ("S1-1", "Prime Money Corp", "17560 Ellis Road, Tahlequah, OK", "US"), ("S1-2", "State Bank of India", "5 MG Road, Pune", "India"), ("S1-3", "Nothing Alike", None, "US"),
    ("S2-1", "PRIME MONEY CORPORATION", "17560 Ellis Rd, Tahlequah", "US"), ("S3-1", "Prime Money Ltd", "Ellis Road Tahlequah", "US"),
    ("S2-2", "Completely Different Inc", "100 Oak St, Dallas TX", "US"), ("S2-3", "PRIME MONEY CORPORATION", "17560 Ellis Rd", "France"), ("S3-2", "State Bank Of India Ltd", "5 M G Rd Pune", "India"),
]


@pytest.fixture(scope="module")
def sides(spark):
    df = spark.createDataFrame(ROWS, ENTITY)
    return df.filter("entity_id like 'S1-%'"), df.filter("entity_id not like 'S1-%'")


def pairs_of(df):
    return {(r["s1_id"], r["cand_id"]) for r in df.collect()}


def test_blocking_finds_its_pairs_in_one_country(sides):
    got = pairs_of(candidates(*(normalised(x) for x in sides)))
    assert {("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S3-2")} <= got
    assert not {("S1-1", "S2-2"), ("S1-1", "S2-3")} & got


def test_pruning_counts_targets_only(spark):
    index = spark.createDataFrame([("t", f"S2-{k}") for k in range(5)] + [("u", "S2-1"), ("g4:x", "S2-1"), ("g4:x", "S2-2")], "key string, entity_id string")
    assert {r["key"] for r in blocking.pruned(index, 4).collect()} == {"u", "g4:x"}
    assert {r["key"] for r in blocking.pruned(index, 5, {"g4:": 1}).collect()} == {"t", "u"}


def test_link_end_to_end(sides, tmp_path, spark):
    kept, matches = link(*sides)
    got = pairs_of(matches)
    assert ("S1-1", "S2-1") in got and ("S1-2", "S3-2") in got and not any(a == "S1-3" for a, _ in got)
    assert got <= pairs_of(kept)
    lists = decide.lists(sides[0], matches)
    assert lists.count() == 3
    tsv.write_lists(lists, f"{tmp_path}/m", tsv.MATCHES)
    back = tsv.truth_pairs(tsv.read(spark, f"{tmp_path}/m", tsv.TRUTH))
    assert pairs_of(back) == got
    found = validate.findings(lists, sides[0].select(F.col("entity_id").alias("s1_id")), sides[1], decide.lists(sides[0], kept, "rank"))
    assert found.count() == 0 and validate.passes(validate.report(found))


def test_stream_equals_batch(sides, tmp_path, spark):
    s1, s23 = sides
    s1.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ENTITY).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    incremental.start(stream, s23, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {(r["s1_id"], r["ids"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r["s1_id"], r["ids"]) for r in decide.lists(s1, link(s1, s23)[1]).collect()}


def test_shared_scripts_meet(spark):
    one = normalised(spark.createDataFrame([("S1-1", "राम मार्केटिंग", "x", "India")], ENTITY))
    two = normalised(spark.createDataFrame([("S2-1", "Rama Marketinga", "y", "India")], ENTITY))
    assert candidates(one, two, LinkConfig(shared_scripts=True)).count() == 1


def test_keys_of_short_and_missing_names(spark):
    df = spark.createDataFrame([("Ab", None), (None, "12 Oak"), ("", "")], "n string, a string")
    got = [sorted(r["k"]) for r in df.select(keys.v1_keys(F.col("n"), F.col("a"), F.col("n")).alias("k")).collect()]
    assert got == [["Ab", "ab", "tok:Ab", "tok:ab"], ["num:12"], []]
    n = text.filled("n")
    got = [sorted(r["k"]) for r in df.select(keys.v2_keys(F.col("n"), F.col("a"), n, text.filled("a"), n, True).alias("k")).collect()]
    assert got == [["tok1:ab"], ["na:12|oak"], []]


def scored(spark):
    return spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.83), ("b", "x", 0.84), ("c", "x", 0.75), ("c", "y", 0.75), ("d", "x", 0.6)], "s1_id string, cand_id string, score double")


def test_decisions(spark):
    df = scored(spark)
    assert pairs_of(decide.threshold(df, 0.83)) == {("a", "x"), ("a", "y"), ("b", "x")}
    assert pairs_of(decide.gated(df)) == {("a", "x"), ("a", "y")}
    assert pairs_of(decide.with_fallback(df)) == {("a", "x"), ("b", "x"), ("c", "x")}


def test_metric_example(spark):
    s1 = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "entity_id string")
    truth = spark.createDataFrame([("e1", "a"), ("e1", "b"), ("e3", "c")], "s1_id string, cand_id string")
    predicted = spark.createDataFrame([("e1", "a"), ("e1", "b"), ("zz", "q")], "s1_id string, cand_id string")
    row = metrics.macro(s1, truth, predicted).first()
    assert abs(row["f05"] - 2 / 3) < 1e-12 and row["entities"] == 3 and row["precision"] == 1 and abs(row["recall"] - 2 / 3) < 1e-12


def test_tuning_equals_the_decision(spark):
    df = scored(spark)
    s1 = spark.createDataFrame([(x,) for x in "abcde"], "entity_id string")
    truth = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "s1_id string, cand_id string")
    got = {(r["theta"], r["gate"]): r["f05"] for r in metrics.tune(s1, truth, df, [0.7, 0.82], [0.5, 0.85]).collect()}
    for (theta, gate), f in got.items():
        assert abs(metrics.macro(s1, truth, decide.gated(df, theta, gate)).first()["f05"] - f) < 1e-12
    top = metrics.best(metrics.tune(s1, truth, df, [0.7, 0.82], [0.5, 0.85])).first()
    assert top["f05"] == max(got.values())


def test_validator_rules(spark):
    rows = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-2", "S1-9,X-1,S3-7"), ("S1-8", None)], "s1_id string, ids string")
    need = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")
    valid = spark.createDataFrame([("S2-1",)], "entity_id string")
    cand = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-7,X-1")], "s1_id string, ids string")
    found = validate.findings(rows, need, valid, cand)
    got = sorted((r["rule"], r["what"]) for r in found.collect())
    assert got == [("bad_prefix", "S1-2 -> X-1"), ("duplicate_id", "S1-1"), ("duplicate_row", "S1-1"), ("extra_s1", "S1-8"), ("missing_s1", "S1-3"), ("not_candidate", "S1-2 -> S1-9"), ("self_match", "S1-2 -> S1-9"), ("unknown_id", "S1-2 -> S3-7")]
    assert not validate.passes(validate.report(found))
    lines = spark.createDataFrame([("a\tb",), ("broken",), ("  ",)], "value string")
    assert [r["what"] for r in validate.malformed(lines).collect()] == ["broken"]
    assert validate.header_errors("a,b", ["a", "b"]) and validate.header_errors("", ["a"]) and not validate.header_errors("A \tb", ["a", "b"]) and validate.header_errors("a\tc", ["a", "b"])


def test_channels_keep_rescues(spark):
    rows = [("q", f"c{k:03d}", 1.0 + k / 1000, 0.1, 0.1, False, k == 0) for k in range(40)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, comp double, best_addr double, rom_score double, roman_wins boolean, rescue boolean")
    got = pairs_of(prescreen.channels(df, cap=60))
    assert ("q", "c000") in got and len(got) == 25 + 10 and prescreen.channels(df, cap=5).count() == 5


def test_features_and_model(sides):
    one, two = (normalised(x).cache() for x in sides)
    df = prescreen.attributes(candidates(one, two), one, two, *FORMS, "country")
    first, second = pair_features.first(df), pair_features.second(df)
    assert first.columns == ["s1_id", "cand_id", *pair_features.FIRST] and len(pair_features.FIRST) == 20
    assert second.columns == ["s1_id", "cand_id", *pair_features.SECOND] and len(pair_features.SECOND) == 25
    assert {t for c, t in second.dtypes if c not in ("s1_id", "cand_id")} == {"float"}
    label = second.withColumn("label", (F.col("name_lev") > 0.8).cast("int")).cache()
    fitted = model.train(label, pair_features.SECOND, rounds=2, depth=2)
    assert all(0 <= r["score"] <= 1 for r in model.score(fitted, second).collect())
    assert len(model.importance(fitted, pair_features.SECOND)) == 25


def test_sampling_is_by_query(spark):
    df = spark.createDataFrame([(f"s{i}", f"c{j}", int(j == 0 and i % 2 == 0)) for i in range(20) for j in range(30)], "s1_id string, cand_id string, label int")
    got = pair_features.training_pairs(df, 6).groupBy("s1_id").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
    assert all(r["n"] == (8 if r["p"] else 1) for r in got)
    split = pair_features.grouped_split(df, 50).groupBy("s1_id").agg(F.countDistinct("validation").alias("n")).collect()
    assert all(r["n"] == 1 for r in split)


def test_readers(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\t\"A\" Co\t\tUS\n S2-2 \tB\tx\tUS\n")
    assert tsv.entities(spark, f"{tmp_path}/e.tsv").count() == 2
    assert sorted(r[0] for r in tsv.id_column(spark, f"{tmp_path}/e.tsv").collect()) == ["S2-1", "S2-2"]
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-2,S2-1\nS1-2\t\n")
    got = sorted(tuple(r) for r in tsv.candidate_pairs(spark, f"{tmp_path}/c.tsv").collect())
    assert got == [("S1-1", "S2-1", 2), ("S1-1", "S2-2", 1)]
    df = tsv.entities(spark, f"{tmp_path}/e.tsv")
    assert tsv.sample(df, 1).count() == 1
    vectors = spark.createDataFrame([("S2-1", [1.0, 2.0])], "entity_id string, vector array<double>")
    assert tsv.embeddings(df, vectors, "emb_name").filter("emb_name is null").count() == 1


def test_two_stage_tuning(spark):
    df = scored(spark)
    s1 = spark.createDataFrame([(x,) for x in "abcde"], "entity_id string")
    truth = spark.createDataFrame([("a", "x"), ("b", "y")], "s1_id string, cand_id string")
    theta, gate, f05 = metrics.two_stage(s1, truth, df)
    assert gate is None or gate >= theta
    alone = max(metrics.macro(s1, truth, decide.threshold(df, t)).first()["f05"] for t in (0.05, 0.61, 0.76, 0.84, 0.85, 0.9, 0.95))
    assert f05 >= alone - 1e-12
    got = decide.gated(df, theta, gate) if gate else decide.threshold(df, theta)
    assert abs(metrics.macro(s1, truth, got).first()["f05"] - f05) < 1e-12


def test_selected_pairs(spark):
    truth = spark.createDataFrame([("a", str(k)) for k in range(10)], "s1_id string, cand_id string")
    cand = spark.createDataFrame([("a", str(k)) for k in range(5, 30)], "s1_id string, cand_id string")
    got = pair_features.selected_pairs(truth, cand, 4, 6).collect()
    assert sum(r["label"] for r in got) == 4 and len(got) == 10 and all((int(r["cand_id"]) < 10) == (r["label"] == 1) for r in got)


def test_validate_files(spark, tmp_path):
    ent = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    (tmp_path / "s1.tsv").write_text(ent + "S1-1\ta\tb\tc\nS1-2\ta\tb\tc\n")
    (tmp_path / "s2.tsv").write_text(ent + "S2-1\ta\tb\tc\n")
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n\nS1-2\t\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\t\nS1-2\t\n")
    at = lambda n: f"file://{tmp_path}/{n}"
    errors, warnings, _ = validate.validate_files(spark, at("m.tsv"), at("c.tsv"), at("s1.tsv"), (at("s2.tsv"),))
    assert errors == [] and len(warnings) == 1 and warnings[0].startswith("not_candidate: 1")
    errors, warnings, _ = validate.validate_files(spark, at("m.tsv"), None, at("s1.tsv"))
    assert errors == [] and len(warnings) == 2
    (tmp_path / "bad.tsv").write_text("source1_entity_id\tmatched_entity_ids\nbroken\nS1-1\tS3-9\n")
    errors, _, _ = validate.validate_files(spark, at("bad.tsv"), None, at("s1.tsv"), (at("s2.tsv"),))
    assert [e.split(":")[0] for e in sorted(errors)] == ["malformed", "missing_s1", "unknown_id"]
    (tmp_path / "comma.tsv").write_text("a,b\n")
    (tmp_path / "latin.tsv").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\t\xff\n")
    (tmp_path / "none.tsv").write_text("")
    for name in ("comma.tsv", "latin.tsv", "none.tsv", "absent.tsv"):
        assert validate.validate_files(spark, at(name), None, at("s1.tsv"))[0]
    assert validate.validate_files(spark, at("m.tsv"), None, at("absent.tsv"))[0]


def test_registered_queries_keep_keys_of_up_to_400_targets(spark):
    from kinlink.plans import catalogue

    index = spark.createDataFrame([("b", key, f"S2-{k}") for key, n in (("few", 400), ("many", 401)) for k in range(n)], "country string, key string, entity_id string")
    assert {r["key"] for r in blocking.pruned(index, catalogue.CAP, by=catalogue.BY).collect()} == {"few"}


def test_features_and_rankings_see_every_candidate(spark):
    ent = [("S1-1", "acme widgets", "1 main road", "US")] + [(f"S2-{1000 + k}", f"acme x{k}", "2 main road", "US") for k in range(150)] + [("S3-9907", "acme widgets", "1 main road", "US")]
    df = spark.createDataFrame(ent, ENTITY)
    one, two = (normalised(x) for x in (df.filter("entity_id = 'S1-1'"), df.filter("entity_id <> 'S1-1'")))
    pairs = prescreen.attributes(candidates(one, two), one, two, *FORMS, "business_name", "country")
    assert pair_features.second(pairs).count() == 151 == pair_features.first(pairs).count()
    best = prescreen.first_top(pairs, 30)
    assert best.count() == 30 and best.filter("rank = 1").first()["cand_id"] == "S3-9907"
    kept, _ = link(df.filter("entity_id = 'S1-1'"), df.filter("entity_id <> 'S1-1'"), LinkConfig(max_candidates=5, per_entity=60))
    assert kept.count() == 5  # a query keeps the targets that share most keys


def test_stream_keeps_only_its_targets(sides, tmp_path, spark):
    from kinlink.plans import store

    s1, s23 = sides
    s1.repartition(3).write.parquet(f"{tmp_path}/in")
    persisted = spark.sparkContext._jsc.getPersistentRDDs().size()
    at = store.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    stream = spark.readStream.schema(ENTITY).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    incremental.start(stream, s23, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == persisted
    assert sorted(n.split("-")[0] for n in set(os.listdir(at)) - before) == ["index", "targets"]


def test_rescoring_candidates_on_file_equals_the_link(sides, spark):
    s1, s23 = sides
    kept, matches = link(s1, s23)
    want = {(r["s1_id"], r["ids"]) for r in decide.lists(s1, matches).collect()}
    assert {(r["s1_id"], r["ids"]) for r in rescored(kept.select("s1_id", "cand_id"), s1, s23).collect()} == want
    odd = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-1"), ("S1-1", "S9-9"), ("S1-7", "S2-1")], "s1_id string, cand_id string")
    assert {(r["s1_id"], r["ids"]) for r in rescored(odd, s1, s23).collect()} == {("S1-1", "S2-1"), ("S1-2", ""), ("S1-3", "")}


def test_a_trained_model_is_saved_and_used_in_a_link(spark, tmp_path):
    words = "alder birch cedar maple olive poplar rowan spruce willow yew".split()
    ent = [(f"S1-{k}", f"{words[k % 10]} {words[(k * 7 + 3) % 10]} {k} ltd", f"{k} {words[(k * 3) % 10]} road", "US") for k in range(60)]
    ent += [(f"S2-{k}", f"{words[k % 10]} {words[(k * 7 + 3) % 10]} {k} limited", f"{k} {words[(k * 3) % 10]} rd", "US") for k in range(60)]
    df = spark.createDataFrame(ent, ENTITY)
    s1, s23 = df.filter("entity_id like 'S1-%'"), df.filter("entity_id like 'S2-%'")
    truth = s1.select(F.col("entity_id").alias("s1_id"), F.regexp_replace("entity_id", "S1", "S2").alias("cand_id"))
    trained = training.fit(s1, s23, truth, training.TrainConfig(rounds=3, depth=3, validation=30))
    assert trained.f05 > 0.8 and trained.theta in training.TrainConfig.thetas and trained.gate in training.TrainConfig.gates
    training.save(trained, spark, f"{tmp_path}/model")
    training.save(trained, spark, f"{tmp_path}/model")  # an older save is replaced
    back = training.load(spark, f"{tmp_path}/model")
    assert (back.theta, back.gate, back.f05) == (trained.theta, trained.gate, trained.f05)
    config = LinkConfig(theta=back.theta)
    got, again = (sorted(map(tuple, link(s1, s23, config, t.fitted)[1].collect())) for t in (trained, back))
    assert got == again and len(pairs_of(truth) & {(a, b) for a, b, _ in got}) > 45


def test_weights_favour_precision_by_the_factor(spark):
    df = spark.createDataFrame([(f"s{k}", "c", float(k), int(k < 5)) for k in range(20)], "s1_id string, cand_id string, x double, label int")
    assert model.class_weight(df) == 3.0
    fitted = model.train(df, ("x",), rounds=1, depth=1, factor=0.7)
    assert fitted.stages[-1].getOrDefault("weightCol") == "weight"


def test_line_numbers_and_headers_of_list_files(spark, tmp_path):
    head = "source1_entity_id\tmatched_entity_ids\n"
    at = lambda n: f"file://{tmp_path}/{n}"
    (tmp_path / "s1.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"S1-{k}\ta\tb\tc\n" for k in range(3000)))
    lines = [f"S1-{k}\t" for k in range(3000)]
    lines[1234], lines[2999] = "broken here", "broken there"
    (tmp_path / "m.tsv").write_text(head + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # the file is read in many splits
        errors, _, _ = validate.validate_files(spark, at("m.tsv"), None, at("s1.tsv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [e for e in errors if e.startswith("malformed")] == ["malformed: 2 (line 1236: broken here; line 3001: broken there)"]
    (tmp_path / "again.tsv").write_text(head + "S1-0\t\n" + head)  # a data line that equals the header is a row, not a header
    errors, _, _ = validate.validate_files(spark, at("again.tsv"), None, at("s1.tsv"))
    assert any(e.startswith("extra_s1: 1 (source1_entity_id)") for e in errors)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-0.csv").write_text(head + "S1-0\t\n")
    (tmp_path / "d" / "part-1.csv").write_text("S1-1\t\n")  # without a header
    assert validate.validate_files(spark, at("d"), None, at("s1.tsv"))[0][0].startswith("header is")


def test_stats_without_candidates_have_no_reduction(spark):
    pairs = spark.createDataFrame([("S1-1", "S2-1", 1), ("S1-1", "S2-2", 1)], "s1_id string, cand_id string, n_keys long")
    assert tuple(blocking.stats(pairs, 2, 3).first()) == (2, 1.0, 2, 3.0)
    assert tuple(blocking.stats(pairs.filter("false"), 2, 3).first()) == (0, 0.0, 0, None)


def test_class_weight_without_pairs_is_unknown(spark):
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0), ("S1-1", "S2-2", 0)], "s1_id string, cand_id string, label int")
    assert model.class_weight(pairs) == 2.0
    assert model.class_weight(pairs.filter("false")) is None


def test_counters_without_matches_do_not_know_several(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-1")], "s1_id string, cand_id string")
    assert tuple(decide.counters(s1, pairs, pairs).first()) == (3, 1, 3, 1, 3)
    assert tuple(decide.counters(s1, pairs, pairs.filter("s1_id = 'S1-2'")).first()) == (3, 2, 1, 0, 3)
    assert tuple(decide.counters(s1, pairs, pairs.filter("false")).first()) == (3, 3, 0, None, 3)
    assert tuple(decide.counters(s1.filter("false"), pairs, pairs).first()) == (0, None, 0, None, 0)


def test_numbered_blocks_give_the_same_without_a_shuffle_of_pairs(spark):
    """Of queries and targets that share several keys, keys of two countries and rows that repeat."""
    rows = lambda tag, n, m: [(f"{tag}-{i}", f"c{(i + k) % 2}", f"k{(i * k) % m}") for i in range(n) for k in range(1, 5)]
    schema = "entity_id string, country string, key string"
    q, t = spark.createDataFrame([*rows("S1", 9, 7), ("S1-1", "c0", "k1"), ("S1-1", "c0", "k1")], schema), spark.createDataFrame([*rows("S2", 12, 8), ("S2-3", "c1", "none")], schema)
    by = ("country",)
    got = blocking.block_numbered(q, blocking.numbered(t, by), by)
    want = blocking.block(q, t, by)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in x and "cand_id" in x for x in plan.splitlines()) and plan.splitlines()[0].startswith("Project") and "Join Inner" in plan.splitlines()[1]


def test_texts_of_entities_are_never_broadcast(spark, sides, tmp_path):
    """Computed texts are many times the file that Spark takes for their size; all candidates meet them without the driver."""
    one, two = sides
    one.unionByName(two).write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    a, b = (normalised(x) for x in (e.filter("entity_id like 'S1-%'"), e.filter("entity_id not like 'S1-%'")))
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-9", "S2-1")], "s1_id string, cand_id string")
    near = prescreen.attributes(pairs, a, b, *FORMS)
    keyed = blocking.block_numbered(blocking.long_keys(a, F.split("norm_name", " ")), blocking.numbered(blocking.long_keys(b, F.split("norm_name", " "))))
    for df in (near, keyed):
        plan = df._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
        assert "SortMergeJoin" in plan
    assert "Broadcast" not in near._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
    assert pairs_of(near) == {("S1-1", "S2-1")} and ("S1-1", "S2-1") in pairs_of(keyed)


def test_a_link_shuffles_no_pairs(spark, sides, monkeypatch):
    """Pairs are counted, scored and ranked where queries meet targets; neither their texts nor their scores are shuffled."""

    def never(*_):
        raise AssertionError("pairs with their entities' texts")

    want = [sorted(map(tuple, x.collect())) for x in link(*sides)]
    for what in ("attributes", "channels"):
        monkeypatch.setattr(prescreen, what, never)
    monkeypatch.setattr(blocking, "capped", never)
    assert want[1] and [sorted(map(tuple, x.collect())) for x in link(*sides)] == want


def test_blocks_of_any_size_and_shuffled_groups_link_alike(spark, sf, monkeypatch):
    """One block a group, many blocks a group, and groups too large for a block, with caps and ties; an id that repeats, with and without a country."""
    from kinlink.operators import cells
    from kinlink.plans.fixtures import entities, sides as halves

    s1, s23 = halves(entities(spark, sf, "rec").withColumn("country", F.when(F.col("country") < "Brand#3", "A").otherwise(F.col("country"))))
    config = LinkConfig(max_candidates=9, per_entity=4, gram_cap=30, cap=60)
    linked = lambda a, b: [sorted(map(tuple, x.collect()), key=str) for x in link(a, b, config)]
    want = linked(s1, s23)
    assert len(want[0]) > 50 and want[1]
    monkeypatch.setattr(cells, "QUERIES", 5)
    monkeypatch.setattr(cells, "STEP", 2)
    assert linked(s1, s23) == want
    twice = s23.union(s23.filter("entity_id like '%1'")).union(s23.filter("entity_id like '%2'").withColumn("country", F.lit(None).cast("string")))
    mixed = linked(s1, twice)
    monkeypatch.setattr(cells, "TARGETS", 0)
    assert linked(s1, s23) == want
    assert linked(s1, twice) == mixed and len(mixed[0]) >= len(want[0])


def test_vectors_of_blocks_equal_those_of_pairs(spark, sf, monkeypatch):
    """All candidates, made in blocks of any size without a join of texts, for groups too large for a block and for an id that repeats."""
    from kinlink.operators import cells
    from kinlink.plans.fixtures import entities, sides as halves
    from kinlink.plans.link import vectors

    one, two = (normalised(x.withColumn("country", F.when(F.col("country") < "Brand#3", "A").otherwise(F.col("country")))) for x in halves(entities(spark, sf, "rec")))
    rows = lambda df: sorted(map(tuple, df.collect()))
    of_pairs = lambda a, b: rows(pair_features.second(prescreen.attributes(candidates(a, b), a, b, *FORMS)))
    want, twice = of_pairs(one, two), two.union(two.filter("entity_id like '%1'"))
    assert len(want) > 500
    monkeypatch.setattr(cells, "QUERIES", 7)
    assert rows(vectors(one, twice)) == of_pairs(one, twice)
    monkeypatch.setattr(prescreen, "attributes", None)
    assert rows(vectors(one, two)) == want


@pytest.mark.parametrize("name", ["features_v1", "topk_v6", "topk_v1", "features_v2", "rescore_lists"])
def test_queries_of_all_candidates_shuffle_no_pairs(spark, sf, monkeypatch, name):
    """Pairs are made where queries meet targets; their entities' texts are not joined to them."""
    from kinlink.plans.catalogue import QUERIES

    def never(*_):
        raise AssertionError("pairs with their entities' texts")

    monkeypatch.setattr(prescreen, "attributes", never)
    assert len(QUERIES[name](spark, sf).columns) > 1


@pytest.fixture(scope="module")
def crowded(spark, sf):
    """Both normalised sides in few countries, and targets of which some repeat."""
    from kinlink.plans.fixtures import entities, sides as halves

    one, two = (normalised(x.withColumn("country", F.when(F.col("country") < "Brand#3", "A").otherwise(F.col("country")))) for x in halves(entities(spark, sf, "rec")))
    return one, two, two.union(two.filter("entity_id like '%1'"))


def of_pairs(a, b, *columns):
    return prescreen.attributes(candidates(a, b), a, b, *FORMS, *columns)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_first_vectors_of_blocks_equal_those_of_pairs(crowded, monkeypatch):
    from kinlink.operators import cells
    from kinlink.plans.link import first_vectors

    one, two, twice = crowded
    want = rows_of(pair_features.first(of_pairs(one, two, "country")))
    assert len(want) > 500
    monkeypatch.setattr(cells, "QUERIES", 40)
    assert rows_of(first_vectors(one, twice)) == rows_of(pair_features.first(of_pairs(one, twice, "country")))
    monkeypatch.setattr(prescreen, "attributes", None)
    assert rows_of(first_vectors(one, two)) == want


def records(n: int, m: int):
    """Tables of keyed records with few words, so that texts and scores repeat, and all their pairs that share a key."""
    import random

    import pyarrow as pa

    rng, words = random.Random(n), "12 12a old bolt bolts st rod b bb road".split()
    text = lambda most: " ".join(rng.choices(words, k=rng.randint(0, most)))
    rows = lambda tag, size: [{"entity_id": f"{tag}-{k}", "norm_name": text(3), "rom_name": text(3), "norm_addr": text(5), "number": rng.choice(["", "1"]), "keys": rng.choices("abcd", k=2)} for k in range(size)]
    one, two = rows("S1", n), rows("S2", m)
    return pa.Table.from_pylist(one), pa.Table.from_pylist(two), [(x, y) for x in one for y in two if set(x["keys"]) & set(y["keys"])]


def likeness(kind, pairs, column, n):
    from kinlink.functions.kernels import KERNELS

    return KERNELS[kind]([(x[column][:n], y[column][:n]) for x, y in pairs])


def ranked(pairs, score):
    """(s1_id, cand_id, score, rank), ids settling ties."""
    each = {}
    for (x, y), v in zip(pairs, score, strict=True):
        each.setdefault(x["entity_id"], []).append((-v, y["entity_id"]))
    return [(q, t, -v, k) for q, own in each.items() for k, (v, t) in enumerate(sorted(own), 1)]


@pytest.mark.parametrize("k", [1, 5])
def test_best_pairs_of_a_block_equal_those_of_all_pairs(monkeypatch, k):
    """With ties; addresses are compared only where the score could be among the best."""
    from kinlink.functions.kernels import KERNELS
    from kinlink.operators import cells

    one, two, pairs = records(40, 90)
    first = 1.2 * likeness("ratio", pairs, "norm_name", 100) + likeness("ratio", pairs, "norm_addr", 80)
    names = [likeness(kind, pairs, c, 100) for kind, c in (("ratio", "norm_name"), ("set_ratio", "norm_name"), ("set_ratio", "rom_name"))]
    sixth = 1.25 * np.maximum.reduce(names) + likeness("ratio", pairs, "norm_addr", 80)
    fields = [("norm_name", 100, cells.better), ("rom_name", None, KERNELS["set_ratio"])]
    for grid in (1 << 24, 10):
        monkeypatch.setattr(cells, "GRID", grid)
        monkeypatch.setattr(cells, "STEP", 7)
        for score, weight, own in ((first, 1.2, [("norm_name", 100, KERNELS["ratio"])]), (sixth, 1.25, fields)):
            got = [tuple(r.values()) for x in cells.leading(one, two, k, weight, own) for r in x.to_pylist()]
            assert sorted(got) == sorted(r for r in ranked(pairs, score.tolist()) if r[3] <= k)


def test_bounds_are_never_below_the_similarities(spark):
    import random

    import pyarrow as pa

    from kinlink.operators import cells

    rng, words = random.Random(7), "12 12a old bolt st rod b bb road - é".split()
    texts = ["", " ", *(" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(60))]
    table = pa.table({"t": texts})
    q, t = (x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts)), indexing="ij"))
    for kind in (cells.Likeness, cells.Sharing):
        near = kind(table, table, "t", 100)
        bound, exact = near.bound(q, t), near(q, t)
        assert (bound >= exact).all() and (bound < 1).any() and (bound == exact).any()


@pytest.mark.parametrize("theta,least", [(0.88, 0.70), (0.97, 0.5), (0.6, 0.7)])
def test_lists_of_a_block_equal_those_of_all_pairs(monkeypatch, theta, least):
    from kinlink.operators import cells

    one, two, pairs = records(60, 50)
    single = lambda *x: np.maximum.reduce(x).astype(np.float32).astype(np.float64)
    name = single(likeness("ratio", pairs, "norm_name", 120), likeness("set_ratio", pairs, "norm_name", 120), likeness("ratio", pairs, "rom_name", 120))
    place = single(likeness("ratio", pairs, "norm_addr", 100), likeness("set_ratio", pairs, "norm_addr", 100))
    score = np.minimum(0.6 * name + 0.4 * place + [0.05 * (x["number"] == y["number"] != "") for x, y in pairs], 1.0)
    rows = ranked(pairs, score.tolist())
    top = {q: v for q, _, v, k in rows if k == 1}
    want = {}
    for q, t, v, k in rows:
        if v >= theta or (top[q] < theta and k == 1 and v >= least):
            want.setdefault(q, []).append(t)
    monkeypatch.setattr(cells, "STEP", 7)
    got = {r["s1_id"]: r["ids"] for x in cells.rated(one, two, theta, least) for r in x.to_pylist()}
    assert got == {q: ",".join(sorted(t)) for q, t in want.items()} and 0 < len(got) and any("," in x for x in got.values())


def test_records_of_a_small_file_are_dealt_to_all_tasks(spark, sides):
    from kinlink.plans.link import spread

    one, _ = sides
    dealt = spread(one.coalesce(1))
    assert dealt.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert rows_of(dealt) == rows_of(one)
