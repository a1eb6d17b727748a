"""What a dump holds, as counts: statements, rows and populated fields of the tables that may hold narratives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tables with their width and the places of their texts, the terms, and errors of a line as a whole.
LAYOUT = {
    "labdataex": (28, {"candidate_narrative_column_6": 5}),
    "hl7labnotes": (8, {"notes": 1}),
    "electronichl7content": (13, {"hl7message": 1, "newHL7Message": 9}),
    "recelectroniclabresults": (7, {"processedResult": 1}),
    "labdata": (None, {"result": 5, "Notes": 7, "Addendum": 9}),
}
TERMS = ("IMPRESSION:", "FINDINGS:", "MRI LUMBAR SPINE")
UNSUPPORTED = ("line too long", "a line must end its statement")


def probe(rows: DataFrame) -> DataFrame:
    """Table, field ('' for the table itself), metric, n of parsed rows (table, row, error, begins).

    Every row is melted to the metrics that it counts for and all are added up map-side, in one aggregation however many
    tables and fields there are. A line that can't be read counts for its statement and its error alone.
    """
    known = rows.withColumn("table", F.lower("table")).where(F.col("table").isin(*LAYOUT))
    of = lambda cond, field, metric: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(metric).alias("metric")))
    read = F.col("error") == ""
    every = [of(F.col("begins"), "", "statements"), of(F.col("error").isin(*UNSUPPORTED), "", "unsupported"), of(~read & ~F.col("error").isin(*UNSUPPORTED), "", "parse_error")]
    for table, (width, fields) in LAYOUT.items():
        here = read & (F.col("table") == table)
        wide = (F.size("row") > max(fields.values())) & (F.lit(width is None) | (F.size("row") == (width or 0)))
        every += [of(here & ~wide, "", "width_mismatch"), of(here & wide, "", "rows")]
        for field, at in fields.items():
            value = F.coalesce(F.get("row", F.lit(at)), F.lit(""))
            every.append(of(here & wide & (value != ""), field, "populated"))
            every += [of(here & wide & F.contains(F.upper(value), F.lit(term)), field, term) for term in TERMS]
    melted = known.select("table", F.explode(F.array_compact(F.array(*every))).alias("m"))
    return melted.groupBy("table", "m.field", "m.metric").agg(F.count("*").alias("n"))
