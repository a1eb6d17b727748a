"""Values of single expressions, and sources that SQL can't check."""

import hashlib
import hmac
from datetime import datetime

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessarix.functions import text as tx
from tessarix.functions.dialect import Duck, Spark
from tessarix.operators import linkage, probe
from tessarix.plans import catalog
from tessarix.plans.fixtures import TABLES, fx
from tessarix.sources import ddl, dumps, files, reports

D = Spark()


def values(spark, fragment, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.select("i", F.expr(fragment).alias("o")).orderBy("i").select("o").collect()]


def test_names(spark):
    assert values(spark, tx.name(D, "v"), ["SMITH^JANE", "Jane, Smith", None, "", "O'Neil 3"]) == ["JANE SMITH", "JANE SMITH", "", "", "NEIL O"]
    assert values(spark, tx.surname(D, "v"), ["A B^C=x", "A, B", "SMITH", "JANE SMITH", None]) == ["A B", "A", "SMITH", "", ""]
    assert values(spark, tx.clean_id(D, "v"), ["ab-12 c", None]) == ["AB12C", ""]


def test_dates(spark):
    cases = {"20200102": "20200102", "2020-1-2": "20200102", "01/02/2020": "20200102", "1/2/69": "19690102", "1/2/68": "20680102", "2020-01-02 03:04:05": "20200102", "02/30/2020": "", "02/29/2024": "20240229", "20201301": "", "01-02-2020": "", "": "", " 20200102 ": "20200102", "0/1/2020": ""}
    assert values(spark, tx.date(D, "v"), list(cases)) == list(cases.values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dates(min_value=datetime(1900, 1, 1).date()), min_size=5, max_size=30))
def test_dates_round_trip(spark, days):
    assert values(spark, tx.date(D, "v"), [d.isoformat() for d in days]) == [d.strftime("%Y%m%d") for d in days]


def test_extraction(spark):
    report = "DOE, JANE (MR # MR12345)\nRESULTS MRI CERVICAL SPINE (Accession CV123456)\nDate of Service: 10/01/2026\nPatient Name - OTHER, JOHN\n"
    assert values(spark, f"concat_ws('|', {tx.names(D, 'v')})", [report]) == ["DOE JANE|JOHN OTHER"]
    assert values(spark, f"concat_ws('|', {tx.exam_dates(D, 'v')})", [report, "Admission date: 10/01/2026"]) == ["20261001", ""]
    assert values(spark, f"concat_ws('|', {tx.dump_modalities(D, 'v')})", ["X-RAY CHEST", "mri"]) == ["CR|DX", "MR"]


def test_keyed_tokens(spark):
    want = hmac.new(b"k", "subject\0é".encode(), hashlib.sha256).hexdigest()
    assert values(spark, D.hmac(b"k", "concat('subject', chr(0), v)"), ["é"]) == [want]


def test_insert_lines():
    assert dumps.parse_insert("INSERT INTO `db`.`t` VALUES (1,'a\\'b;),(',NULL),(-2.5,'it''s','x\\n');") == ("t", [["1", "a'b;),(", None], ["-2.5", "it's", "x\n"]], "")
    for bad in ("INSERT INTO t VALUES (NOW());", "INSERT INTO t VALUES (1)", "INSERT INTO t VALUES (1); DROP TABLE t;", "INSERT INTO t SELECT 1;"):
        assert dumps.parse_insert(bad)[1] == [] and dumps.parse_insert(bad)[2]
    assert dumps.parse_insert("-- comment") == (None, [], "")


def test_ddl(spark):
    sql = "-- CREATE TABLE no (a int);\nCREATE TABLE `labs` (`id` int, accession varchar(10), note text DEFAULT 'CREATE TABLE x (y int)', PRIMARY KEY (`id`));"
    got = ddl.ddl_columns(spark.createDataFrame([(1, sql), (2, None)], "dump int, value string"), key="dump").collect()
    assert [tuple(r) for r in got] == [(1, "labs", "id", False, False), (1, "labs", "accession", True, False), (1, "labs", "note", False, False)]


def test_ddl_tokens(monkeypatch):
    one = """CREATE TABLE t (a varchar(9) DEFAULT 'x--y', accession_no int); CREATE TABLE u ("odd, name" int, report_id int);"""
    assert ddl.tables(one) == ([("t", ["a", "accession_no"]), ("u", ["odd, name", "report_id"])], False)
    odd = """/* CREATE TABLE a (b int); */
COPY x (y) FROM stdin;
CREATE TABLE inside (z int);
\\.
create table if not exists "my"."tab ""le" ( [a(b] int, `c,d` enum('x)', 'it''s', 'b\\'c') -- , e int
  , f numeric(10, 2) DEFAULT (1), CONSTRAINT g CHECK (f > 0), KEY h (f), "check" int
);
DO $body$ CREATE TABLE no (i int); $body$;
SELECT 'x' CREATE TABLE none (j int);
CREATE TABLE open (k int,"""
    found, limited = ddl.tables(odd)
    assert limited and [(t.name, t.columns) for t in found] == [('my"."tab ""le', ["a(b", "c,d", "f"])]
    assert ddl.tables("") == ([], False) and ddl.tables("CREATE TABLE t () ; create table x") == ([("t", [])], False)
    many = "\n".join(f"CREATE TABLE t{i} (a int);" for i in range(201))
    assert len(ddl.tables(many)[0]) == 200 and ddl.tables(many)[1]
    wide = f"CREATE TABLE w ({', '.join(f'c{i} int' for i in range(1200))});"
    assert len(ddl.tables(wide)[0][0].columns) == 1000
    monkeypatch.setattr(ddl, "LONGEST_TABLE", 20)
    assert ddl.tables("CREATE TABLE long (aaaaaaaaaaaaaaaaaaaaaaaaaa int, b int);\nCREATE TABLE s (a int);") == ([("s", ["a"])], True)


def test_probe(spark):
    lines = ["INSERT INTO hl7labnotes VALUES (1,'findings: x',3,4,5,6,7,8),(1,NULL,3,4,5,6,7,8),(1,2);", "INSERT INTO `HL7LabNotes` VALUES (1,'Impression: FINDINGS:',3,4,5,6,7,8);", "INSERT INTO hl7labnotes VALUES (1,NOW());", "INSERT INTO hl7labnotes VALUES (1,2)", "INSERT INTO other VALUES (1);", "-- x", None, "INSERT INTO labdata VALUES (1,2,3,4,5,'r',7,'',9,'MRI lumbar spine');"]
    got = {(r.table, r.field, r.metric): r.n for r in probe.probe(dumps.insert_rows(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()}
    assert got == {("hl7labnotes", "", "statements"): 4, ("hl7labnotes", "", "rows"): 3, ("hl7labnotes", "", "width_mismatch"): 1, ("hl7labnotes", "", "parse_error"): 1, ("hl7labnotes", "", "unsupported"): 1, ("hl7labnotes", "notes", "populated"): 2, ("hl7labnotes", "notes", "FINDINGS:"): 2, ("hl7labnotes", "notes", "IMPRESSION:"): 1,
                   ("labdata", "", "statements"): 1, ("labdata", "", "rows"): 1, ("labdata", "result", "populated"): 1, ("labdata", "Addendum", "populated"): 1, ("labdata", "Addendum", "MRI LUMBAR SPINE"): 1}


def test_xml():
    assert reports.plain("<r><notes>a\nb</notes></r>") [:2] == ("a\nb", "xml")
    assert reports.plain("text")[:2] == ("text", "plain")
    for bad in ("<r>", "<!DOCTYPE r><r/>", "<r>" * 60 + "</r>" * 60):
        assert reports.plain(bad)[:2] == (bad, "unparsed")
    assert reports.plain("<r><notes>FINDINGS: clear\nlungs\n_____\nIMPRESSION: none</notes></r>")[0] == "FINDINGS\nclear lungs\n\nIMPRESSION\nnone"


def test_redaction(spark):
    df = spark.createDataFrame([(1, "Seen: John Smith called 212-555-0199 on 1/2/2020.\nFindings: clear.", ["Smith^John"]), (2, None, None)], "report int, text string, identifiers array<string>")
    one, two = reports.redacted(df).orderBy("report").collect()
    assert "Smith" not in one.text and "John" not in one.text and "1/2/2020" not in one.text and "Findings: clear." in one.text
    assert (two.text, two.n_spans) == ("", 0)


def test_cp1252(spark):
    every = [bytes([b]) for b in range(256)] + [bytes(range(32, 127)) + b"\x80 \x93x\x94", b"a\x81", b"", None]

    def slow(raw):
        try:
            return None if raw is None else raw.decode("cp1252")
        except UnicodeDecodeError:
            return None

    got = spark.createDataFrame(list(enumerate(every)), "i int, raw binary").select("i", files.cp1252("raw").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [slow(x) for x in every]


def test_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes("﻿Héllo".encode())
    (tmp_path / "a" / "y.txt").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "z.sql").write_text("--")
    listed = files.listing(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.kind) for r in listed.collect()} == {("x.txt", "report"), ("y.txt", "report"), ("z.sql", "sql")}
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.status) for r in files.reports(spark, str(tmp_path)).collect()}
    assert got == {"x.txt": ("Héllo", "ok"), "y.txt": (None, "error")}
    known = spark.createDataFrame([("p", 1, 1, "ok", 1, True), ("q", 2, 1, "ok", 1, True)], "path string, size int, mtime int, status string, run int, active boolean")
    seen = spark.createDataFrame([("p", 1, 1), ("r", 3, 3)], "path string, size int, mtime int")
    assert [r.path for r in files.changed(seen, known).collect()] == ["r"]
    assert {r.path: r.active for r in files.reconcile(known, seen, True).collect()} == {"p": True, "q": False}
    assert {r.path: r.active for r in files.reconcile(known, seen, False).collect()} == {"p": True, "q": True}
    newer = spark.createDataFrame([("p", 9, 2, "ok", 2, True)], known.schema)
    assert {r.path: r["size"] for r in files.upsert(known, newer).collect()} == {"p": 9, "q": 2}


def test_suggestions_take_dump_narratives(spark):
    """Studies without a conflict find their own dump narrative, sql before txt where points tie; conflicting ones find nothing."""
    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES["W1_top_suggestions"](spark, sf).toPandas()
    orders = spark.read.parquet(f"{sf}/orders.parquet").toPandas().o_orderkey
    silent = {f"1.2.840.99.{k}" for k in orders if k % 7 == 0 and k % 53}
    assert silent and set(got.source) == {"sql", "txt"}
    own = got[got.source == "sql"].groupby("uid").report.apply(set)
    assert any(int(u.rsplit(".", 1)[1]) in own.get(u, ()) for u in silent)
    for _, g in got.sort_values(["uid", "position"]).groupby("uid"):
        rows = list(zip(g.bucket.map({"strong": 0, "review": 1, "differences": 2}), -g.points, g.source, g.report, strict=True))
        assert rows == sorted(rows)
    studies = spark.sql(f"with {fx(catalog.over(spark, sf))} select uid from studies where conflict").toPandas()
    assert len(studies) and not set(studies.uid) & set(got.uid)


def test_summary_counts_pairs_before_the_limit(spark, tmp_path):
    """Eight orders of one patient, day and study kind, whose reports name no accession: 8 x 8 pairs."""
    sf = "/root/testdata/sf0.001"
    for name in TABLES:
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        if name in ("orders", "lineitem"):
            # reports of kind 2 hold name, birth date and study date, but no accession
            keys = [12 + 10 * i for i in range(20) if (12 + 10 * i) % 7 and (12 + 10 * i) % 53][:8]
            one = df.limit(1).drop("o_orderkey" if name == "orders" else "l_orderkey")
            df = one.crossJoin(spark.createDataFrame([(k,) for k in keys], f"{'o' if name == 'orders' else 'l'}_orderkey long")).select(*df.columns)
            if name == "orders":
                df = df.withColumn("o_custkey", F.lit(1).cast(df.schema["o_custkey"].dataType))
            else:
                df = df.withColumn("l_linenumber", F.lit(1).cast(df.schema["l_linenumber"].dataType))
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    row = catalog.QUERIES["A17_discovery_summary"](spark, str(tmp_path)).first()
    assert (row.studies, row.with_candidates, row.without, row.pairs) == (8, 8, 0, 64)
    assert catalog.QUERIES["J4_discovery"](spark, str(tmp_path)).count() == 8 * 8


def test_summary_equals_all_pairs(spark):
    """The counts that form no pairs, against every study judged with every report."""
    sf, d = "/root/testdata/sf0.001", Duck()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    judged = f"with {linkage.base(d, linkage.verified(d), linkage.DISCOVERY_STUDIES)}, every as (select uid, report from s cross join e), judged as materialized ({linkage.judged(d, 'every')}), found as ({linkage.discovered(d)})"
    pairs, studies, conflicting = con.execute(f"{judged} select count(*) filter (where confidence <> 'insufficient'), count(distinct uid) filter (where confidence <> 'insufficient'), count(*) filter (where confidence = 'insufficient' and len(conflicts) > 0) from found").fetchone()
    row = catalog.QUERIES["A17_discovery_summary"](spark, sf).first()
    assert (row.pairs, row.with_candidates, row.conflicting_pairs) == (pairs, studies, conflicting)
    assert row.reports_changed and row.reports_unreadable and row.reports_considered == row.reports_changed + row.reports_unreadable + row.reports_verified


def test_historical_counts(spark):
    """Counts of the index and of the reports against the derived rows themselves."""
    sf = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linestatus = 'F'").toPandas()
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus = 'F' and o_orderkey % 7 <> 0").toPandas().o_orderkey
    row = catalog.QUERIES["A10_historical_overlap"](spark, sf).first()
    invalid = items.l_partkey % 211 == 0
    lost = ~invalid & (items.l_partkey % 199 == 0)
    assert (row.n_rows, row.invalid_rows, row.rows_without_uid) == (len(items), invalid.sum(), lost.sum())
    assert row.studies == items[~invalid & ~lost].l_orderkey.nunique() and row.reports_considered == len(orders)
    assert 0 < row.name_date_modality_pairs <= row.name_and_date_pairs <= row.name_pairs <= row.surname_pairs


def test_study_detail_lists_all_candidates(spark):
    """Rows of all of a study's candidates in order, the associated report behind them; approvals are read, not a constant."""
    got = catalog.QUERIES["J27_study_detail"](spark, "/root/testdata/sf0.001").toPandas()
    assert not got.duplicated(["uid", "report"]).any()
    others = got[got.uid.str.rsplit(".", n=1).str[1].astype(int) != got.report]
    assert (others.reason == "Last name in report or filename").any() and (got.reason == "associated").any()
    for _, g in got.sort_values(["uid", "position"]).groupby("uid"):
        rows = list(zip(g.strength, g.path, g.report, strict=True))
        assert rows == sorted(rows) and g.position.tolist() == list(range(len(g))) and (g.reason == "associated").sum() <= 1
    outcome = catalog.QUERIES["V1_reconciled"](spark, "/root/testdata/sf0.001").toPandas()
    assert set(outcome.reason) == {"", "study conflict", "study changed", "report missing", "report changed", "study vanished"} and (outcome.kept == (outcome.reason == "")).all()
    after = catalog.QUERIES["V6_rescanned"](spark, "/root/testdata/sf0.001").toPandas()
    assert after.approval.isna().all() and set(after.state) == {"conflict", "needs_review", "unmatched"}
    assert set(after[after.state == "needs_review"].uid) == set(outcome[outcome.kept].uid)


def test_label_coverage(spark):
    """Label counts follow from the kinds of the derived reports; mentions inside a line are no labels."""
    sf = "/root/testdata/sf0.001"
    keys = [k for k in spark.read.parquet(f"{sf}/orders.parquet").toPandas().o_orderkey if k % 7]
    of = lambda *kinds: sum(k % 10 in kinds for k in keys)
    row = catalog.QUERIES["A16_label_coverage"](spark, sf).first()
    assert (row.label_medical_record, row.label_accession, row.label_exam_date) == (of(0), of(0, 3, 4), of(0, 2, 3))
    assert (row.label_service_date, row.label_result_date, row.label_patient_name) == (of(1, 7), of(6), of(0, 2, 3, 4, 6, 7, 8))
    assert row.with_study_uid == of(8) and row.with_dob == of(0, 2, 3)
