"""Narratives from dump rows: four typed tables, unique by key, joined to one index, with what is missing told or refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The width that each table must have, and the places of the columns that are kept; the first is the key.
LAYOUT = {
    "labdataex": (28, 28, {"report_id": 0, "narrative": 5}),
    "labdata": (7, None, {"report_id": 0, "encounter_id": 1, "item_id": 2, "result_date": 6}),
    "enc": (4, None, {"encounter_id": 0, "patient_ref": 1, "encounter_date": 3}),
    "items": (2, None, {"item_id": 0, "procedure_name": 1}),
}
ADMITTED = r"FINDINGS:|IMPRESSION:"


def typed(rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The four tables of parsed rows (table, row, error), and the faults (table, fault, n) that make them unfit:
    lines that can't be read and rows of another width."""
    known = rows.where(F.col("table").isin(*LAYOUT))
    least = F.coalesce(*[F.when(F.col("table") == t, F.lit(a)) for t, (a, _, _) in LAYOUT.items()])
    exact = F.coalesce(*[F.when(F.col("table") == t, F.lit(b)) for t, (_, b, _) in LAYOUT.items() if b])
    wide = F.coalesce((F.size("row") >= least) & (F.size("row") <= F.coalesce(exact, F.lit(1 << 30))), F.lit(False))
    fault = F.when(F.col("error") != "", F.col("error")).when(~wide, "layout changed")
    faults = known.withColumn("fault", fault).where("fault is not null").groupBy("table", "fault").agg(F.count("*").alias("n"))
    good = known.where((F.col("error") == "") & wide)
    made = {t: good.where(F.col("table") == t).select(*[F.col("row")[i].alias(c) for c, i in places.items()]) for t, (_, _, places) in LAYOUT.items()}
    return {t: d.where(F.coalesce(F.col(d.columns[0]), F.lit("")) != "") for t, d in made.items()}, faults


def unique(table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table with one row a key, and the keys that stand for several different rows."""
    row = F.struct(*[c for c in table.columns if c != key])
    per = table.groupBy(key).agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    return per.select(key, "lo.*"), per.where(~F.col("lo").eqNullSafe(F.col("hi"))).select(key)


def index(tables: dict[str, DataFrame], independent: bool = False) -> tuple[DataFrame, DataFrame]:
    """The narrative index, and its totals with all that forbids publishing it.

    A strict index takes narratives with findings or an impression; ``independent`` takes every one that isn't empty and
    forgives missing links. ``publishable`` is false if a key is ambiguous, or if links are missing in a strict index.
    """
    told = tables["labdataex"].where(F.coalesce(F.col("narrative"), F.lit("")) != "")
    told = told if independent else told.where(F.upper("narrative").rlike(ADMITTED))
    one, twice = {}, []
    for name, table in {**tables, "labdataex": told}.items():
        one[name], again = unique(table, table.columns[0])
        twice.append(again.agg(F.count("*").alias("n")))
    whole = one["labdataex"].join(one["labdata"], "report_id", "left").join(one["enc"], "encounter_id", "left").join(one["items"], "item_id", "left")
    unlinked = F.col("encounter_id").isNull() | F.col("patient_ref").isNull() | F.col("item_id").isNull()
    totals = whole.agg(F.count("*").alias("narratives"), F.count("procedure_name").alias("with_procedure"), F.count("result_date").alias("with_result_date"), F.count_if(unlinked).alias("unlinked"))
    ambiguous = twice[0].union(twice[1]).union(twice[2]).union(twice[3]).agg(F.sum("n").cast("long").alias("ambiguous"))
    fine = (F.col("ambiguous") == 0) & (F.lit(independent) | (F.col("unlinked") == 0))
    return whole, totals.join(F.broadcast(ambiguous)).withColumn("publishable", fine)
