"""What a query needs several times is computed once, and results stay what they were."""

import pytest
from pyspark.sql import functions as F

from tessarix.functions import text as tx
from tessarix.functions.dialect import Spark
from tessarix.operators import review
from tessarix.plans import catalog, given, streamed
from tessarix.sources import dumps
from tessarix.streaming import incremental
from tessarix.streaming.incremental import Inventory

SF = "/root/testdata/sf0.001"
HEADER = "file_id string, study_uid string, size long, mtime long, active boolean"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_file_that_moved_is_gone_from_its_study(spark, tmp_path):
    """Its new study isn't touched, and may lie in another bucket."""
    instances = Inventory(str(tmp_path / "inv"), key="file_id", bucket_by="study_uid")
    first = spark.createDataFrame([("f1", "u", 1, 1, True), ("f2", "w", 1, 1, True)], HEADER)
    instances.write(first, 0)
    instances.write(spark.createDataFrame([("f1", "w", 1, 2, True)], HEADER), 1)
    held = review.fingerprints(first).withColumn("report", F.lit(1)).withColumn("report_hash", F.lit("h"))
    touched = spark.createDataFrame([("u", None)], "study_uid string, report int")
    found = incremental.invalid(instances, touched, held, spark.createDataFrame([(1, "h")], "report int, hash string"))
    assert [(r.uid, r.reason) for r in found.collect()] == [("u", "study vanished")]


def test_a_file_under_two_studies_in_one_batch_counts_once(spark, tmp_path):
    instances = Inventory(str(tmp_path / "inv"), key="file_id", bucket_by="study_uid")
    instances.write(spark.createDataFrame([("f1", "u", 1, 1, True), ("f1", "w", 1, 2, True), ("f2", "u", 1, 1, True), ("f2", "u", 2, 2, True)], HEADER), 0)
    assert sorted((r.file_id, r.study_uid, r["size"]) for r in instances.read(spark).collect()) == [("f1", "w", 1), ("f2", "u", 2)]
    assert [r.file_id for r in spark.read.parquet(str(tmp_path / "inv/deltas/batch=000000000")).where("study_uid = 'u'").collect()] == ["f2"]


def test_headers_go_into_the_inventory_without_a_copy(spark, monkeypatch):
    kept, real = [], streamed.written
    monkeypatch.setattr(streamed, "written", lambda df, n: kept.append(n) or real(df, n))
    told = plan(catalog.QUERIES["ST2_invalidated"](spark, SF))
    assert kept == ["associations", "touched"] and "lineitem.parquet" not in told


@pytest.mark.parametrize("name", ["A17_discovery_summary", "J4_discovery"])
def test_evidence_is_extracted_once(spark, name):
    assert "(?imd)" not in plan(catalog.QUERIES[name](spark, SF))


def test_a_funnel_counts_pairs_where_names_join_them(spark):
    told = plan(catalog.QUERIES["A14_emr_funnel"](spark, SF))
    assert "Expand" not in told and "(?imd)" not in told


def test_each_pattern_is_looked_for_once():
    d = Spark()
    told = tx.evidence(d, "fx_reports")
    for pattern in (tx.ACCESSION, tx.PATIENT_ID, tx.DOB, tx.EXAM_DATE, tx.GENERIC_DATE):
        assert told.count(d.lit(d.flags(pattern))) == 1


def test_terms_are_found_as_by_their_patterns(spark):
    d, texts = Spark(), ["mri lumbar", "MR of the x-ray", "CTX Brainy US", "headache, Head; sonogram", "computed  tomography", "magnetic resonance pet", "", None, "Xray ſonogram kneE"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").withColumn("up", F.upper("v"))
    for known in (tx.TEXT_MODALITIES, tx.TEXT_ANATOMY):
        assert all(tx._maybe("up", p) for p in known.values())
        assert df.where(~F.expr(f"{tx.terms(d, 'v', known)} <=> {tx.terms(d, 'v', known, 'up')}")).isEmpty()


def test_a_year_zero_is_no_date(spark):
    df = spark.createDataFrame([("00000101",), ("0000-1-1",), ("1/1/0000",), ("1/1/00",), ("0001-2-3",), ("2023-02-29 1:2:3",)], "v string")
    assert [r[0] for r in df.select(F.expr(tx.date(Spark(), "v"))).collect()] == ["", "", "", "20000101", "00010203", ""]


@pytest.mark.parametrize("name", ["J9_narratives", "A23_narrative_totals"])
def test_dump_lines_are_read_once(spark, name):
    assert "MapInArrow" not in plan(catalog.QUERIES[name](spark, SF))


def test_a_run_of_nulls_is_read_in_one_step(monkeypatch):
    steps, real = [], dumps._LITERAL

    class Counted:
        def match(self, *args):
            steps.append(args)
            return real.match(*args)

        def scanner(self, *args):
            raise AssertionError

    monkeypatch.setattr(dumps, "_LITERAL", Counted())
    assert dumps.parse_insert("INSERT INTO t VALUES (1, NULL" + ", null" * 20 + " , 'a', NULL, NULL);") == ("t", [["1", *[None] * 21, "a", None, None]], "")
    assert len(steps) == 5
    assert dumps.parse_insert("INSERT INTO t VALUES (NULL, NULLx);")[2] == "unsupported value"


@pytest.mark.parametrize("name, scans", [("V2_admissible", 0), ("V6_rescanned", 0), ("P1_open_studies", 1), ("A13_verified_sources", 2)])
def test_studies_are_built_once(spark, name, scans):
    assert plan(catalog.QUERIES[name](spark, SF)).count("lineitem.parquet") == scans


def test_recorded_fingerprints_are_those_of_the_headers_before(spark):
    g = given.Given(spark, SF)
    before = review.fingerprints(g.headers(size="case when o_orderkey % 9 = 0 then size + 1 else size end"))
    assert g.known.selectExpr("uid", "before as fingerprint").exceptAll(before).isEmpty()
    assert g.kept_studies().exceptAll(g.studies().select(g.kept_studies().columns)).isEmpty()
