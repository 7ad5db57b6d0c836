"""The stages in order against their rules on a small table."""

import hashlib

import corpus_pipeline as pipeline
import duckdb
from obscast.llm.oracles import ORACLES
from obscast.llm.shared import stored
from tests.llm.test_operators import jaccard, least_reachable, shingles


def test_stages_hold_on_the_sample(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-test")
        kept[name] = docs.collect()
    columns = set(pipeline.COLUMNS)
    for name, _ in pipeline.STAGES[:-1]:
        assert set(kept[name][0].asDict()) == columns
    assert len(kept["language_id"]) >= len(kept["quality_rules"]) == len(kept["line_dedup"]) >= len(kept["ngram_jaccard_join"])
    sets = {r.doc_id: shingles(r.text, 5) for r in kept["ngram_jaccard_join"]}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            assert not sets[a] or not sets[b] or jaccard(sets[a], sets[b]) < 0.8
    assert {r.doc_id for r in kept["best_fit_packing"]} == set(ids)


def test_every_stage_keeps_just_the_rows_that_its_rule_names(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = [(9_000_001, "12 ... ### 345", None, "s", 14), (9_000_002, None, "en", "s", None), (9_000_003, "too short", "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    named = dict(pipeline.STAGES)

    def under(rows, sql):
        con = duckdb.connect()
        con.register("documents", rows.toPandas())
        return con.sql(sql).fetchdf()

    before = docs.count()
    docs = stored(named["language_id"](spark, docs, sf_dir), "pipeline-test")
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & {9_000_001, 9_000_002} and len(ids) > 0.97 * (before - 3)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    assert {r.doc_id for r in good.collect()} <= ids

    found = under(docs, ORACLES["op9_quality_rules"])
    docs = stored(named["quality_rules"](spark, docs, sf_dir), "pipeline-test")
    assert {r.doc_id for r in docs.collect()} == set(found[found.kept].doc_id)

    found = under(docs, ORACLES["op3_line_dedup"])
    docs = stored(named["line_dedup"](spark, docs, sf_dir), "pipeline-test")
    rows = docs.collect()
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in rows} == dict(zip(found.doc_id, found.kept_sha256, strict=True))
    assert all(r.n_chars == len(r.text) for r in rows)

    first = least_reachable({r.doc_id: shingles(r.text, 5) for r in rows}, 80)
    docs = stored(named["ngram_jaccard_join"](spark, docs, sf_dir), "pipeline-test")
    assert {r.doc_id for r in docs.collect()} == set(first.values())
    packed = named["best_fit_packing"](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(first.values())


def test_no_documents_pass_through(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_one_row_of_a_group_stays_with_repeated_and_null_ids(spark):
    words = [f"w{k}" for k in range(60)]
    a, near_a = " ".join(words), " ".join([*words, "more"])
    b, c = " ".join(f"x{k}" for k in range(60)), " ".join(f"y{k}" for k in range(60))
    rows = [(1, a), (1, a), (1, b), (2, near_a), (None, near_a), (None, c), (None, c), (3, b), (4, ""), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (4, ""), (4, ""), (None, None)], key=str)
