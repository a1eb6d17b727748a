"""Operators over small tables of their own, against literal rows and plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessarix.functions import extract
from tessarix.functions.text import REDACT
from tessarix.operators import browse, masks, narratives, review
from tessarix.sources import dumps, packages, reports


def test_layout():
    text = "MRI LUMBAR SPINE\nPatient: X\nHISTORY: back\npain\n\n_____\nREASON FOR EXAM: pain\nFINDINGS: clear\nlungs\n\nsecond\nIMPRESSION:\nnone"
    title, fields, parts = reports.sections(text.split("\n"))
    assert (title, fields) == ("MRI LUMBAR SPINE", ["Patient: X"])
    assert parts == [("CLINICAL HISTORY", "back pain"), ("INDICATION", "pain"), ("FINDINGS", "clear lungs"), ("FINDINGS", "second"), ("IMPRESSION", "none")]
    assert reports.layout(text.split("\n")).endswith("FINDINGS\nclear lungs\n\nsecond\n\nIMPRESSION\nnone")
    assert reports.layout(["no heading"]) == ""


def slow_redaction(text, identifiers):
    cuts = []
    for p in REDACT:
        cuts += [m.span() for m in re.finditer(p, text)]
    for known in identifiers:
        for part in {known, *re.split(r"[\^=]", known)}:
            if len(part) >= 2:
                cuts += [m.span() for m in re.finditer(rf"(?<!\w){re.escape(part)}(?!\w)", text, re.I)]
    out, at = [], 0
    inside = lambda i: any(a <= i < b for a, b in cuts)
    while at < len(text):
        if inside(at):
            while at < len(text) and inside(at):
                at += 1
            out.append(reports.MARK)
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def test_redaction_by_brute_force(spark):
    @settings(max_examples=120, deadline=None)
    @given(st.lists(st.sampled_from(["Smith", "John Smith", "smith^", "1/2/2020", "19990101", " ", "\n", "Patient: x", "123-45-6789", "é", "a+b", "Find", "-", "20200102 1/1/2020"]), max_size=9), st.lists(st.sampled_from(["Smith^John", "a+b", "x", "John Smith", "é", "nd=Find"]), max_size=3))
    def collect(parts, identifiers):
        cases.append(("".join(parts), identifiers))

    cases = []
    collect()
    rows = [(i, t, k) for i, (t, k) in enumerate(cases)]
    got = reports.redacted(spark.createDataFrame(rows, "report int, text string, identifiers array<string>")).collect()
    for r in got:
        text, identifiers = cases[r.report]
        assert r.text == slow_redaction(text, identifiers), (text, identifiers)


def test_extracts(spark):
    rows = [("12/31/30", "20301231"), ("1/2/31", "19310102"), ("02/30/2020", ""), ("99999999", "99999999"), ("2020-01-02", ""), (None, "")]
    df = spark.createDataFrame(rows, "v string, want string")
    assert all(r.got == r.want for r in df.select("want", extract.date8(F.col("v")).alias("got")).collect())
    titles = [("MRI LUMBAR", "MR"), ("MR x", "MR"), ("CT", "CT"), ("CTA chest", ""), ("ultrasound abd", "US"), ("X-RAY", "DX"), (None, "")]
    df = spark.createDataFrame(titles, "v string, want string")
    assert all(r.got == r.want for r in df.select("want", extract.title_modality(F.col("v")).alias("got")).collect())
    numbers = [0, 1, 10**9, 10**18 - 1, 2**64, 2**127 + 12345, 2**128 - 1]
    df = spark.createDataFrame([(f"{n:032x}", str(n)) for n in numbers], "v string, want string")
    assert all(r.got == r.want for r in df.select("want", extract.decimal128(F.col("v")).alias("got")).collect())
    assert spark.createDataFrame([(b"a\xffb",)], "v binary").select(extract.lenient("v").alias("t")).first().t == "a�b"


def test_review_rules(spark):
    drafts = spark.createDataFrame([("a", "h", "f"), ("b", "old", "f"), ("c", "h", "old"), ("d", "h", "f")], "uid string, source_hash string, fingerprint string")
    linked = spark.createDataFrame([("a", 1, "h", "f"), ("b", 1, "h", "f"), ("c", 2, "h", "f")], "uid string, report int, report_hash string, fingerprint string")
    studies = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f"), ("d", "f")], "uid string, fingerprint string")
    assert {r.uid: r.prepared for r in review.valid_drafts(drafts, linked, studies).collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert [r.report for r in review.shared_reports(linked, studies).collect()] == [1]
    each, totals = review.batch_outcome(studies.select("uid"), spark.createDataFrame([("a", "first", 1), ("a", "last", 2)], "uid string, error string, at int"))
    assert {r.uid: r.last_error for r in each.collect()} == {"a": "last", "b": "", "c": "", "d": ""} and tuple(totals.first()) == (1, 3, 4)
    leads = spark.createDataFrame([("a", 1), ("b", 2)], "uid string, report int")
    assert tuple(review.uniqueness(leads).first()) == (2, 2, 2, 0)
    instances = spark.createDataFrame([("f1", "a", 1, 1), ("f2", "a", 2, 2), ("f3", "b", 3, 3), ("f4", "c", 4, 4)], "file_id string, study_uid string, size int, mtime int")
    listing = spark.createDataFrame([("f1", 1, 1), ("f2", 2, 9), ("f3", 3, 3)], "file_id string, size int, mtime int")
    assert tuple(review.verified_sources(instances, listing, leads).first()) == (2, 3, 2, 1, 1)
    twice = leads.union(spark.createDataFrame([("a", 5)], leads.schema))
    assert tuple(review.verified_sources(instances, listing, twice).first()) == (2, None, None, None, None)
    texts = spark.createDataFrame([(1, "x")], "report int, name string")
    assert review.with_coverage(texts, None)[1].startswith("text reports only") and review.with_coverage(texts, texts)[0].count() == 2
    log = spark.createDataFrame([(1, 10.0, None, None), (2, 20.0, 21.0, 25.5)], "job int, created double, started double, finished double")
    assert [(r.job, r.elapsed, r.active) for r in review.newest_jobs(log, F.lit(100.0)).collect()] == [(2, 4.5, 1), (1, 90.0, 1)]
    dated = spark.createDataFrame([("a", "f", "20200101"), ("b", "f", "20210101"), ("c", "f", "20190101"), ("d", "f", "20220101")], "uid string, fingerprint string, date string")
    best = spark.createDataFrame([("a", "f", "strong", 90, 0), ("b", "f", "differences", 10, 1), ("b", "f", "review", 30, 0), ("c", "old", "strong", 99, 0)], "uid string, fingerprint string, bucket string, points int, position int")
    assert [(r.uid, r.bucket) for r in review.ordered_queue(dated, best).collect()] == [("a", "strong"), ("b", "review"), ("d", "none"), ("c", "none")]


def test_masks(spark):
    frame = '{"version":2,"masks":[{"scope":"image","series_uid":"1.2","sop_uid":"1.2.3","frame":%s,"rect":[0,0,5,5]}]}'
    cases = [("[]", ""), ("[[0,0,1,1]]", ""), ("[[0,0,0,1]]", "rectangle"), ("[[0,0,1]]", "rectangle"), ('[["0",0,1,1]]', "rectangle"), ("{}", "format"), (None, "format"), ('{"version":2.0,"masks":[]}', "format"), ('{"version":2,"masks":[],"x":1}', "format"), ('{"version":2,"masks":[]}', ""), (frame % 0, ""), (frame % -1, "frame"), (frame % "true", "frame"), (frame % '"0"', "frame"), ("[%s]" % ",".join(["[0,0,1,1]"] * 101), "number of masks"), ('{"version":2,"masks":[{"scope":"all","rect":[0,0,1,1]}]}', "scope or fields"), ('{"version":2,"masks":[{"scope":"series","series_uid":"1..2","rect":[0,0,1,1]}]}', "target"), ('{"version":2,"masks":[7]}', "scope or fields")]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "i int, document string")
    got = {r.i: r.reason for r in masks.parsed(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}
    m = spark.createDataFrame([("s", "image", "e", "p", 0, 0, 0, 5, 5), ("s", "image", "e", "p", 1, 0, 0, 5, 5), ("s", "series", "e2", None, None, 0, 0, 90, 5)], "study_uid string, scope string, series_uid string, sop_uid string, frame long, x long, y long, w long, h long")
    i = spark.createDataFrame([("s", "e", "p", 64, 64, 1, 2, "YES"), ("s", "e", "o", 64, 64, 1, 1, "yes"), ("s", "e2", "q", 64, 64, 1, 1, "YES")], "study_uid string, series_uid string, sop_uid string, rows int, columns int, samples int, frames int, burned string")
    pairs = masks.violations(masks.bound(m, i))
    assert sorted((r.sop_uid, r.fault) for r in pairs.collect()) == [("p", ""), ("p", ""), ("q", "outside the image")]
    covers = masks.covered(pairs)
    assert sorted(r.sop_uid for r in covers.collect()) == ["p", "q"] and [r.sop_uid for r in masks.quarantined(i, covers).collect()] == ["o"]


def test_narratives(spark):
    line = "INSERT INTO items VALUES (1, 'a'),(1, \"b\"),(2, 'c'),(2, 'c'),(NULL, 'd');"
    tables, faults = narratives.typed(dumps.insert_rows(spark.createDataFrame([(line,), ("INSERT INTO enc VALUES (1, 2);",), ("INSERT INTO enc VALUES (NOW());",)], "value string")))
    assert sorted((r.table, r.fault, r.n) for r in faults.collect()) == [("enc", "layout changed", 1), ("enc", "unsupported value", 1)]
    one, twice = narratives.unique(tables["items"], "item_id")
    assert {r.item_id: r.procedure_name for r in one.collect()} == {"1": "a", "2": "c"} and [r.item_id for r in twice.collect()] == ["1"]
    assert not narratives.index(tables)[1].first().publishable
    assert dumps.parse_insert("INSERT INTO t VALUES (+1,.5,1.,-2e3,\"it\\\"s \"\"q\"\" ''\",'\"');") == ("t", [["+1", ".5", "1.", "-2e3", "it\"s \"q\" ''", '"']], "")


def test_lists(spark):
    r = spark.createDataFrame([(1, "A_b.txt", "MRI of the Lumbar-Spine", True, "ok"), (2, "c.txt", "lumbarspine", True, "ok"), (3, "ab.txt", None, False, "ok")], "report int, path string, text string, active boolean, status string")
    assert [x.report for x in browse.found(r, "lumbar spine").collect()] == [1] and browse.found(r, " - ").count() == 0
    assert [x.report for x in browse.found(r, "BARS", phrase=False).collect()] == [2]
    assert [x.report for x in browse.by_path(r, "a_B").collect()] == [1]
    with pytest.raises(ValueError):
        browse.listed(r, "text; drop", browse.REPORT_ORDERS, "report")
    with pytest.raises(ValueError):
        browse.worklist(r, first="2020-01-01")


def test_packages(spark, tmp_path):
    rows = [("S1", "T1", "S1/a.txt", bytearray(b"one")), ("S1", "T2", "S1/b.txt", bytearray(b"two"))]
    entries = spark.createDataFrame(rows, "subject string, study string, path string, content binary")
    root = str(tmp_path / "out")
    packages.publish(entries, root, "e1")
    assert {r.path: r.status for r in packages.checked(spark, root, "e1").collect()} == {"S1/a.txt": "unchanged", "S1/b.txt": "unchanged"}
    assert [tuple(r) for r in packages.sizes(spark, root).collect()] == [("e1", 2, 6)]
    with pytest.raises(ValueError):
        packages.publish(entries, root, "e1")
    for bad in ("/etc/x", "a/../b", "a//b"):
        with pytest.raises(ValueError):
            packages.publish(entries.withColumn("path", F.lit(bad)).limit(1), root, "e2")
    entries.withColumn("content", F.when(F.col("study") == "T1", F.lit(b"new")).otherwise(F.col("content"))).where("study = 'T1'").write.mode("overwrite").partitionBy("subject", "study").parquet(f"{root}/e1/files")
    assert {r.path: r.status for r in packages.checked(spark, root, "e1").collect()} == {"S1/a.txt": "changed", "S1/b.txt": "missing"}


def test_identifiers_and_first_instances(spark):
    """Nulls, one-letter parts, repeats and inactive files; a study with nothing left isn't returned."""
    columns = "file_id string, study_uid string, series_uid string, sop_uid string, accession string, patient_id string, patient_name string, active boolean"
    rows = [("b", "1.2", "1.2.3", "1.2.3.4", None, "P1", "DOE^J=D^JO", True), ("a", "1.2", "1.2.3", "1.2.3.5", "A1", "P1", "DOE^J", True), ("c", "1.2", "9", "9.9", "A9", "P9", "GONE", False), ("d", "9.1", "1", "2", "3", "4", "5", False)]
    instances = spark.createDataFrame(rows, columns)
    got = review.identifiers(instances).collect()
    assert [(r.uid, r.identifiers) for r in got] == [("1.2", sorted(["1.2", "1.2.3", "1.2.3.4", "1.2.3.5", "A1", "P1", "DOE^J=D^JO", "DOE^J", "DOE", "JO"]))]
    assert [tuple(r) for r in review.first_instances(instances, 1).collect()] == [("1.2", "a", 1)]
    assert review.identifiers(instances.limit(0)).count() == review.first_instances(instances.limit(0)).count() == 0
