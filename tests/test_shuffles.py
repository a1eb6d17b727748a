"""How often plans read and shuffle what grows; at size these decide whether a query ends."""

import contextlib

import pytest

from tessarix.plans import catalog, given

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def joined_by_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    with contextlib.suppress(Exception):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    """The plan before adaptive execution changes it."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_study_is_built_where_its_instances_were_joined(joined_by_shuffle):
    told = plan(catalog.QUERIES["A1_study_build"](joined_by_shuffle, SF))
    assert "Expand" not in told  # distinct counts would read each row several times
    assert told.count("Exchange hashpartitioning") == 4  # customers, orders by customer, orders and instances by study


def test_studies_and_their_fingerprints_are_one_aggregation(spark):
    told = plan(given.Given(spark, SF).studies())
    assert told.count("lineitem.parquet") == 1


def test_fingerprints_of_studies_are_those_of_their_headers(spark):
    from tessarix.operators import review

    g = given.Given(spark, SF)
    assert g.studies().select("uid", "fingerprint").exceptAll(review.fingerprints(g.headers())).isEmpty()


def test_what_was_approved_meets_instances_in_one_row_a_study(joined_by_shuffle):
    told = plan(catalog.QUERIES["V5_exportable"](joined_by_shuffle, SF))
    assert told.count("Exchange hashpartitioning") <= 32  # 58 when instances went around by object and by study again
    assert told.count("Exchange hashpartitioning(sop_uid") == 1  # where burned-in text needs a cover


def test_content_is_held_against_what_was_approved(spark):
    from tessarix.operators import review

    file = "study_uid string, sop_uid string, sop_class string, has_pixels boolean, burned string, file_id string, content_hash string, active boolean"
    ct = review.RELEASED["ct"]
    rows = [("a", "a1", ct, True, "NO", "f:1", "h1", True), ("b", "b1", ct, True, "NO", "f2", "new", True), ("c", "c1", ct, True, "NO", "f3", None, True), ("d", "d1", ct, True, "YES", "f4", "h4", True), ("e", "e1", ct, True, "YES", "f5", "h5", True), ("f", "f1", ct, True, "NO", "f6", "h6", True), ("f", "f1", ct, True, "NO", "f7", "h7", True)]
    approved = {"a": {"f:1": "h1", "gone": "h0"}, "b": {"f2": "old"}, "c": {"f3": "h3"}, "d": {"f4": "h4"}, "e": {"f5": "h5"}, "f": {"f6": "h6", "f7": "h7"}}
    studies = spark.createDataFrame([(u, 2 if u == "f" else 1, m) for u, m in approved.items()], "uid string, n int, source_hashes map<string,string>").selectExpr("*", "'approved' as state", "1 as report", "'r' as report_hash", "'p' as fingerprint", "'p' as approved_fingerprint", "false as conflict", "'' as clean", "'' as masks", "'' as note", "10 as bytes")
    studies = studies.withColumn("approved_hash", review.approval())
    reports = spark.createDataFrame([(1, "r", True)], "report int, hash string, active boolean")
    covered = spark.createDataFrame([("d1",)], "sop_uid string")
    got = {r.uid: r.reason for r in review.blocked(studies, spark.createDataFrame(rows, file), reports, covered).collect()}
    assert got == {"a": "", "b": "source content changed", "c": "source content changed", "d": "", "e": "burned-in annotation", "f": "conflicting copies"}


@pytest.mark.parametrize("name", ["E12_study_states", "A8_reasons", "J27_study_detail", "J13_report_pages"])
def test_pairs_of_a_surname_do_not_go_around(spark, monkeypatch, name):
    from tessarix.plans import linked

    kept, real = [], linked.written
    monkeypatch.setattr(linked, "written", lambda df, n: kept.append(n) or real(df, n))
    told = plan(catalog.QUERIES[name](spark, SF))
    assert "candidates" not in kept and "windowspecdefinition(uid" not in told


def test_files_are_counted_before_they_meet_the_roots(spark):
    told = plan(catalog.QUERIES["A6_source_coverage"](spark, SF))
    assert "count(distinct" not in told and told.split("HashAggregate", 1)[0].count("Join") >= 3  # nothing is counted after the joins


def test_a_preflight_reads_each_instance_once(spark):
    assert "Expand" not in plan(catalog.QUERIES["A20_preflight"](spark, SF))


def test_mask_documents_are_parsed_once(spark):
    assert "row_number" not in plan(catalog.QUERIES["J22_mask_targets"](spark, SF))  # they have been, and their masks were written


def test_a_review_queue_builds_its_studies_once(spark):
    told = plan(catalog.QUERIES["J15_review_queue"](spark, SF))
    assert "lineitem.parquet" not in told and "orders.parquet" not in told


def test_instances_take_the_masks_of_their_study_where_they_lie(joined_by_shuffle):
    told = plan(catalog.QUERIES["J22_mask_targets"](joined_by_shuffle, SF))
    assert told.count("Exchange hashpartitioning") == 5 and "Exchange hashpartitioning(sop_uid" not in told  # four build the instances, one groups masks


def test_masks_of_all_scopes_are_told_alike_with_pairs_and_without(spark):
    from pyspark.sql import functions as F

    from tessarix.operators import masks

    mask = "study_uid string, scope string, series_uid string, sop_uid string, frame bigint, x bigint, y bigint, w bigint, h bigint"
    told = [("a", "exam", None, None, None, 0, 0, 64, 64), ("a", "image", "a1", "i1", 0, 1, 1, 9, 9), ("b", "series", "b1", None, None, 4, 4, 90, 9), ("c", "image", "c1", "i6", 0, 1, 1, 2, 2), ("c", "image", "c1", "i6", 1, 1, 1, 2, 2), ("c", "image", "c1", "i7", 1, 1, 1, 2, 2)]
    file = "study_uid string, series_uid string, sop_uid string, rows int, columns int, samples int, frames int, burned string"
    rows = [("a", "a1", "i1", 64, 64, 1, 1, "YES"), ("a", None, "i2", 32, 64, 3, 1, None), ("b", "b1", "i3", 64, 64, 1, 1, "yes"), ("b", "b2", "i4", 64, 64, 1, 1, "YES"), ("c", "c1", "i6", 64, 64, 1, 2, "YES"), ("c", "c1", "i7", 64, 64, 1, 1, "YES"), ("d", "d1", "i8", 64, 64, 1, 1, "NO")]
    told, rows = spark.createDataFrame(told, mask), spark.createDataFrame(rows, file)
    pairs = masks.violations(masks.bound(told, rows))
    n = {r.sop_uid: (r.n, r.faults, r.first) for r in pairs.groupBy("sop_uid").agg(F.count("*").alias("n"), F.count_if(F.col("fault") != "").alias("faults"), F.min(F.when(F.col("fault") != "", F.col("fault"))).alias("first")).collect()}
    covered = {r.sop_uid for r in masks.covered(pairs).collect()}
    kept = {r.sop_uid for r in masks.quarantined(rows, masks.covered(pairs)).collect()}
    got = masks.targets(told, rows).collect()
    assert {r.sop_uid: (r.n_masks, r.faults, r.first_fault, r.covered, r.quarantined) for r in got} == {r.sop_uid: (*n.get(r.sop_uid, (0, 0, None)), r.sop_uid in covered, r.sop_uid in kept) for r in rows.collect()}
    assert len(got) == 7 and covered == {"i1", "i2", "i3", "i6"} and kept == {"i4", "i7"}
    assert masks.targets(told, rows.unionByName(rows)).where("sop_uid = 'i1'").select("n_masks").collect() == [(2,), (2,)]


def test_index_of_inactive_files_is_read_once(spark):
    told = plan(catalog.QUERIES["A10_historical_overlap"](spark, SF))
    assert "lineitem.parquet" not in told and "from_json" not in told  # 5 times before


def test_a_history_of_files_writes_no_studies(spark, monkeypatch):
    kept, real = [], catalog.written
    monkeypatch.setattr(catalog, "written", lambda df, n: kept.append(n) or real(df, n))
    catalog.QUERIES["A10_historical_overlap"](spark, SF)
    assert sorted(kept) == ["dated", "index"]  # the studies, which it doesn't read, came first before


def test_lists_of_a_study_stay_where_they_are_put_together(joined_by_shuffle):
    told = plan(catalog.QUERIES["J27_study_detail"](joined_by_shuffle, SF))
    above, _, join = told.partition("SortMergeJoin")
    assert join.startswith(" [phrase") and "Exchange" not in above  # whole lists went around by study before


def test_texts_are_cut_into_tokens_once(spark, monkeypatch):
    from tessarix.operators import postings

    kept, real = [], postings.written
    monkeypatch.setattr(postings, "written", lambda df, n: kept.append(n) or real(df, n))
    posted = postings.postings(spark.createDataFrame([(1, "van Dyk, Ann", "/a"), (2, "Dyk", "/van")], "report int, text string, path string"))
    found = postings.hits(posted, spark.createDataFrame([("van dyk",), ("Dyk",), ("Dyk",)], "phrase string"))
    assert kept == ["phrases", "asked"] and "regexp_extract_all(lower(text" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("Dyk", 1), ("Dyk", 2), ("van dyk", 1)]


def test_candidates_without_a_strong_reason_are_listed_by_path(spark):
    from tessarix.operators import matching

    studies = spark.createDataFrame([("u", "", "LEE^X", False), ("v", "", "LEE^Y", False)], "uid string, accession string, name string, conflict boolean")
    reports = spark.createDataFrame([(i, f"/{p}", "") for i, p in enumerate("cabd")], "report int, path string, text string")
    found = spark.createDataFrame([("u", 0, "by hand"), ("v", 2, matching.UID)], "uid string, report int, reason string")
    named = spark.createDataFrame([("LEE", 1), ("LEE", 2), ("LEE", 3)], "phrase string, report int")
    associated = spark.createDataFrame([("u", 3), ("v", 0), ("w", 1), ("w", 9)], "uid string, report int")
    listed = matching.gathered(studies, found, named, reports=reports, beside=matching.linked(associated, reports))
    got = sorted((r.uid, r.position, r.report, r.strength) for r in matching.detail(listed).collect())
    assert got == [("u", 0, 1, 2), ("u", 1, 2, 2), ("u", 2, 0, 2), ("u", 3, 3, 2), ("v", 0, 2, 0), ("v", 1, 1, 2), ("v", 2, 3, 2), ("v", 3, 0, 3), ("w", 0, 1, 3)]
