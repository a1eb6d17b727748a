"""The best reports by signatures against all pairs of every shared key, on random evidence under few surnames."""

import random

from pyspark.sql import functions as F

from tessarix.functions.dialect import Spark
from tessarix.operators import matching, postings, suggestions
from tessarix.operators.linkage import ORDER, judged, ranked

REPORT = "report long, path string, accession string, patient_id string, names array<string>, dob string, exam_date string, study_uid string, filename_key string, modalities array<string>, anatomy array<string>, report_date string, name_conflict boolean, name string, name_tokens array<string>"
STUDY = "uid string, s_accession string, s_patient string, s_name string, s_surname array<string>, s_modalities array<string>, s_anatomy array<string>, dob string, date string, fingerprint string"


def random_rows(seed, reports, studies):
    r = random.Random(seed)
    day = lambda: r.choice(["", "20200101", "20200102", "20200103"])
    kinds, parts = (["CT"], ["MR"], [], ["CT", "MR"]), (["KNEE"], ["HEAD"], [])
    ids = lambda p: r.choice(["", "", f"{p}{r.randrange(40)}"])
    told, asked = [], []
    for i in range(reports):
        name = r.choice(["", f"AN{r.randrange(9)} SMITH", f"BO{r.randrange(9)} LEE", "LEE SMITH"])
        many = r.random() < 0.1
        told.append((i if i % 3 else -1 - i, f"/r/{i}", ids("A"), ids("P"), [name] if name else [], day(), day(), r.choice(["", "", f"u{r.randrange(60)}"]), ids("A"), r.choice(kinds), r.choice(parts), day(), many, "" if many else name, sorted({*name.split(), *(["ODD"] if many else [])})))
    for i in range(studies):
        name = r.choice(["", f"AN{r.randrange(9)} SMITH", f"BO{r.randrange(9)} LEE", "LEE SMITH"])
        asked.append((f"u{i}", ids("A"), ids("P"), name, [w for w in name.split() if w in ("SMITH", "LEE")], r.choice([["CT"], ["MR"], ["CT", "MR"], [""]]), [r.choice(["KNEE", "HEAD", ""])], day(), day(), "f"))
    return told, asked


def slow(spark, told, asked, most):
    d = Spark()
    theirs, ours = suggestions.keys(told, asked)
    text = f"with e as (select * from {{told}}), s as (select * from {{asked}}), judged as ({judged(d, '{pairs}')}), ranked as ({ranked(d)}) select * from (select *, row_number() over (partition by uid order by {ORDER}) - 1 as position from ranked) r where position < {most}"
    return spark.sql(text, told=told, asked=asked, pairs=ours.join(theirs, "key").select("uid", "report").distinct())


def test_equals_all_pairs(spark):
    for seed, most in ((1, 10), (2, 3), (3, 1)):
        told, asked = random_rows(seed, 400, 60)
        told, asked = spark.createDataFrame(told, REPORT), spark.createDataFrame(asked, STUDY)
        order = ["uid", "position", "report", "bucket", "points", "matches", "differences", "missing"]
        got, want = (sorted(map(tuple, x.select(*order).collect())) for x in (suggestions.suggestions(told, asked, most), slow(spark, told, asked, most)))
        assert got == want and len(got) > 20 * most
        assert suggestions.by_surname(told, asked, most).groupBy("uid").count().agg(F.max("count")).first()[0] <= most
        assert suggestions.suggestions(told.limit(0), asked).count() == suggestions.suggestions(told, asked.limit(0)).count() == 0


def test_one_strong_among_many_weak(spark):
    """1100 reports of the surname and one that agrees in full: it is first, ten stay, few rows reach the last ranking."""
    weak = [(i, f"/r/{i}", "", "", ["X LEE"], "", "", "", "", [], [], "", False, f"X{i} LEE", ["LEE", f"X{i}"]) for i in range(1, 1101)]
    strong = [(5000, "/r/s", "", "", ["ANN LEE"], "19500101", "20200101", "", "", ["CT"], ["KNEE"], "", False, "ANN LEE", ["ANN", "LEE"])]
    told = spark.createDataFrame(weak + strong, REPORT)
    asked = spark.createDataFrame([("u", "", "", "ANN LEE", ["LEE"], ["CT"], ["KNEE"], "19500101", "20200101", "f")], STUDY)
    got = suggestions.suggestions(told, asked).orderBy("position").collect()
    assert len(got) == 10 and (got[0].report, got[0].bucket) == (5000, "strong") and suggestions.candidates(told, asked).count() <= 20


def test_phrases_in_postings(spark):
    rows = [(1, "De la Cruz, Ana. Cruz de la", "/a/x.txt"), (2, "de LA other cruz", "/a/cruz.txt"), (3, None, "/de/la-cruz.txt"), (4, "", ""), (5, "Ünal van Dyk", "/b")]
    posted = postings.postings(spark.createDataFrame(rows, "report int, text string, path string"))
    asked = spark.createDataFrame([("De la Cruz",), ("cruz",), ("la",), ("ünal VAN",), ("nobody here",), ("--",), ("cruz x",), ("De la Cruz",)], "phrase string")
    got = sorted(map(tuple, postings.hits(posted, asked).collect()))
    assert got == sorted([("De la Cruz", 1), ("De la Cruz", 3), ("cruz", 1), ("cruz", 2), ("cruz", 3), ("la", 1), ("la", 2), ("la", 3), ("ünal VAN", 5)])
    assert postings.hits(posted, asked.limit(0)).count() == 0


def test_states(spark):
    studies = spark.createDataFrame([(u, "A1" if u in "ab" else "", "LEE^X" if u in "ad" else "", u == "c") for u in "abcdef"], "uid string, accession string, name string, conflict boolean")
    reports = spark.createDataFrame([(1, "/r/A1.txt", "Study UID: b"), (2, "/r/2.txt", "lee"), (3, "/r/3.txt", "none")], "report int, path string, text string")
    found = matching.exact(studies, reports)
    listed = matching.candidates(studies, found, matching.surnames(studies, reports))
    assert {(r.uid, r.report, r.priority) for r in listed.collect()} == {("a", 1, 1), ("b", 1, 1), ("a", 2, 2), ("d", 2, 2)}
    got = {r.uid: r.state for r in matching.states(studies, listed, studies.where("uid in ('c', 'f')").select("uid")).collect()}
    assert got == {"a": "ambiguous", "b": "candidate", "c": "conflict", "d": "ambiguous", "e": "unmatched", "f": "needs_review"}


def test_pairs_of_an_identifier_are_told_before_rows_of_evidence_meet(spark):
    """60 reports of one patient ID and name, some with the study's accession or date: ten of them go on, in their final places."""
    rows = [(i, f"/r/{i}", "A1" if i == 50 else "", "P1", ["ANN LEE"], "", "20200101" if i == 40 else "", "", "", [], [], "", False, "ANN LEE", ["ANN", "LEE"]) for i in range(60)]
    asked = spark.createDataFrame([("u", "A1", "P1", "ANN LEE", ["LEE"], ["CT"], ["KNEE"], "", "20200101", "f")], STUDY)
    got = suggestions.candidates(spark.createDataFrame(rows, REPORT), asked).orderBy("position").collect()
    assert [r.report for r in got] == [50, 40, *range(8)] and [r.position for r in got] == list(range(10))


def test_a_queue_asks_for_one_suggestion_of_a_study(spark, monkeypatch):
    from tessarix.plans import linked

    asked_for, real = [], linked.suggestions.suggestions
    monkeypatch.setattr(linked.suggestions, "suggestions", lambda told, asked, most=10: asked_for.append(most) or real(told, asked, most))
    linked.review_queue(spark, "/root/testdata/sf0.001")
    assert asked_for == [1]


def test_rows_go_to_their_keys_once(spark):
    """Rows with what decides a place lie by key, pairs by study, and nothing else is shuffled."""
    told, asked = random_rows(4, 50, 20)
    told, asked = spark.createDataFrame(told, REPORT), spark.createDataFrame(asked, STUDY)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = suggestions.by_identifier(told, asked)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 3  # 7 when rows met their keys by a join
    without = suggestions.suggestions(told, asked.drop("fingerprint")).select("uid", "report", "position", "bucket")
    assert without.exceptAll(suggestions.suggestions(told, asked).select("uid", "report", "position", "bucket")).isEmpty() and not without.isEmpty()
