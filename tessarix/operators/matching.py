"""Candidates of studies among text reports: identifiers, surnames as phrases, and the states that follow.

Tables: studies (uid, accession, name, conflict), reports (report, path, text). A surname is looked up once, however many studies bear it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import Spark
from ..functions.text import SCAN_ACCESSION, SCAN_UID, column, stem, surname
from .postings import hits, postings

#: Surname candidates of a study at most.
MOST = 101
#: Rows of a page, and the orders that a list of candidates may have.
PAGE = 100
ORDERS = {"reason": ("strength", "path"), "filename": ("path",), "modified": ("-mtime", "path"), "patient": ("name_hint", "path")}
UID, ACCESSION, SURNAME, SEARCHED = "Study UID", "Accession / filename", "Last name in report or filename", "Last name search; unverified suggestion"


def family(studies: DataFrame) -> DataFrame:
    """uid, phrase: the surname of each study that has one."""
    return studies.select("uid", column(surname, "name").alias("phrase")).where("phrase <> ''")


def exact(studies: DataFrame, reports: DataFrame) -> DataFrame:
    """uid, report, reason: pairs by study UID, or by accession in text or filename; reasons of a pair are joined by commas."""
    scan = lambda p: F.regexp_extract_all("text", F.lit(Spark().flags(p)), F.lit(1))
    told = F.concat(*[F.transform(scan(p), lambda k: F.struct(k.alias("key"), F.lit(r).alias("reason"))) for p, r in ((SCAN_UID, UID), (SCAN_ACCESSION, ACCESSION))], F.array(F.struct(column(stem, "path").alias("key"), F.lit(ACCESSION).alias("reason"))))
    keyed = reports.select("report", F.explode(told).alias("k")).select("report", "k.*").where("key <> ''").distinct()
    asked = studies.select("uid", F.explode(F.array(F.struct(F.col("uid").alias("key"), F.lit(UID).alias("reason")), F.struct(F.col("accession").alias("key"), F.lit(ACCESSION).alias("reason")))).alias("k")).select("uid", "k.*").where("key <> ''")
    return asked.join(keyed, ["key", "reason"]).groupBy("uid", "report").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reason"))


def surnames(studies: DataFrame, reports: DataFrame) -> DataFrame:
    """phrase, report: the reports that hold a surname of a study."""
    return hits(postings(reports), family(studies).select("phrase").distinct())


def gathered(studies: DataFrame, found: DataFrame, by_name: DataFrame, most: int = MOST, reports: DataFrame | None = None, beside: DataFrame | None = None) -> DataFrame:
    """uid, phrase, exact, named: a study's exact pairs and the first ``most`` reports of its surname that aren't among them, as arrays by strength and path.

    A surname's reports are one row, put in order once, which all studies that bear it take as it is: no pair of a surname goes around.
    With ``reports`` each pair holds its path. Columns of ``beside`` (uid, ...) are joined before a study has its arrays, so these stay where they are.
    """
    shown = reports.select("report", "path") if reports is not None else None
    whole = lambda pairs: pairs.withColumn("path", F.lit(None).cast("string")) if shown is None else pairs.join(shown, "report")
    listed = F.array_sort(F.collect_list(F.struct(_strength().alias("strength"), "path", "report", "reason")))
    first = by_name.withColumn("_at", F.row_number().over(Window.partitionBy("phrase").orderBy("report"))).where(F.col("_at") <= most).drop("_at")
    held = whole(first.withColumn("reason", F.lit(SURNAME))).groupBy("phrase").agg(listed.alias("named"))
    own = whole(found.select("uid", "report", "reason")).groupBy("uid").agg(listed.alias("exact"))
    every = studies.select("uid", column(surname, "name").alias("phrase")).join(own, "uid", "left")
    every = (every if beside is None else every.join(beside, "uid", "full_outer")).join(held, "phrase", "left")
    for side in ("exact", "named"):
        every = every.withColumn(side, F.coalesce(side, F.array()))
    other = F.filter("named", lambda c: ~F.array_contains(F.col("exact.report"), c["report"]))
    return every.withColumn("named", F.when(F.arrays_overlap("named.report", "exact.report"), other).otherwise(F.col("named")))


def candidates(studies: DataFrame, found: DataFrame, by_name: DataFrame, most: int = MOST) -> DataFrame:
    """uid, report, reason, priority: exact pairs, then the first ``most`` reports of the surname that aren't exact ones."""
    each = gathered(studies, found, by_name, most).select("uid", F.size("exact").alias("n"), F.posexplode(F.concat("exact", "named")).alias("at", "c"))
    return each.select("uid", "c.report", "c.reason", F.when(F.col("at") < F.col("n"), 1).otherwise(2).alias("priority"))


def states(studies: DataFrame, listed: DataFrame, kept: DataFrame) -> DataFrame:
    """uid, state, n: conflict; needs_review where an association has been kept (uid); else by the number of candidates."""
    per = listed.groupBy("uid").agg(F.count("*").alias("n"), F.count_if(F.col("priority") == 1).alias("n_exact"))
    linked = kept.select("uid", F.lit(True).alias("linked")).distinct()
    state = F.when(F.col("conflict"), "conflict").when(F.col("linked"), "needs_review").when((F.col("n") == 1) & (F.col("n_exact") > 0), "candidate").when(F.col("n") > 0, "ambiguous").otherwise("unmatched")
    return studies.select("uid", "conflict").join(per, "uid", "left").join(linked, "uid", "left").select("uid", state.alias("state"), "n")


def _strength(reason: Column | str = "reason") -> Column:
    return F.when(F.contains(reason, F.lit(UID)), 0).when(F.contains(reason, F.lit("Accession")), 1).otherwise(2)


def page(studies: DataFrame, found: DataFrame, by_name: DataFrame, reports: DataFrame, order: str = "reason", size: int = PAGE, most: int = MOST) -> DataFrame:
    """Uid, report, reason, position, total: the first ``size`` of a study's candidates and of the reports that hold its surname, in an order.

    Reports of a surname are ordered once for all its studies, and a study takes the first ``size`` of them in one row: the exact
    pairs (``found``) that it has besides stand before them or take their place. Totals are counted, not listed.
    """
    if order not in ORDERS:
        raise ValueError(f"not an order of this list: {order}")
    names = [c.removeprefix("-") for c in ORDERS[order]]
    keys = [F.col(n).desc() if c[0] == "-" else F.col(n).asc() for c, n in zip(ORDERS[order], names, strict=True)]
    shown = reports.select("report", *[c for c in ("path", "mtime", "name_hint") if c in reports.columns])
    rising = [F.struct(F.col(n).isNull().alias("unknown"), (-F.col(n)).alias("value")) if c[0] == "-" else F.col(n) for c, n in zip(ORDERS[order], names, strict=True)]
    entry = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(rising)], "report", "reason").alias("entry")
    named = family(studies)
    first = lambda pairs, n, *by: pairs.withColumn("_at", F.row_number().over(Window.partitionBy("phrase").orderBy(*by))).where(F.col("_at") <= n).drop("_at")
    taken = first(by_name, most, "report").select("phrase", "report", F.lit(SURNAME).alias("reason"))
    top = first(by_name.join(shown, "report").withColumn("strength", F.lit(2)), size, *keys, "report").join(taken, ["phrase", "report"], "left").withColumn("reason", F.coalesce("reason", F.lit(SEARCHED)))
    hits = by_name.groupBy("phrase").agg(F.count("*").alias("of_name")).join(top.groupBy("phrase").agg(F.collect_list(entry).alias("top")), "phrase", "left")
    pairs = found.select("uid", "report", "reason").join(studies.select("uid"), "uid", "left_semi")
    own = pairs.join(shown, "report").withColumn("strength", _strength()).groupBy("uid").agg(F.collect_list(entry).alias("exact"))
    besides = pairs.join(named, "uid", "left").join(by_name, ["phrase", "report"], "left_anti").groupBy("uid").agg(F.count("*").alias("besides"))
    every = studies.select("uid").join(own, "uid", "left").join(besides, "uid", "left").join(named, "uid", "left").join(hits, "phrase", "left")
    for side in ("exact", "top"):
        every = every.withColumn(side, F.coalesce(side, F.array()))
    listed = F.concat("exact", F.filter("top", lambda c: ~F.array_contains(F.col("exact.report"), c["report"])))
    total = (F.coalesce("of_name", F.lit(0)) + F.coalesce("besides", F.lit(0))).alias("total")
    return every.select("uid", total, F.posexplode(F.slice(F.array_sort(listed), 1, size)).alias("position", "c")).select("uid", "c.report", "c.reason", "position", "total")


def linked(associated: DataFrame, reports: DataFrame) -> DataFrame:
    """uid, linked: the associated reports (uid, report) of a study that are there, as ``detail`` lists them."""
    behind = F.struct(F.lit(3).alias("strength"), "path", "report", F.lit("associated").alias("reason"))
    return associated.select("uid", "report").join(reports.select("report", "path"), "report").groupBy("uid").agg(F.array_sort(F.collect_set(behind)).alias("linked"))


def detail(listed: DataFrame) -> DataFrame:
    """Uid, report, path, reason, strength, position: all candidates by strength and path, the associated report behind them if it is none.

    ``listed`` comes from ``gathered`` with paths, and ``linked`` beside it. Both of a study's lists are in order, so one follows the other
    unless an exact pair is no stronger than a surname.
    """
    known = F.concat("exact", "named")
    beside = F.filter(F.coalesce("linked", F.array()), lambda c: ~F.array_contains(F.concat("exact.report", "named.report"), c["report"]))
    known = F.when(F.exists("exact", lambda c: c["strength"] >= 2), F.array_sort(known)).otherwise(known)
    return listed.select("uid", F.posexplode(F.concat(known, beside)).alias("position", "c")).select("uid", "c.report", "c.path", "c.reason", "c.strength", "position")
