"""Lists that people look through: searches, pages and orders from allow-lists, over given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that a list may be ordered by, and how many rows a list shows.
STUDY_ORDERS, REPORT_ORDERS, DUMP_ORDERS = ("date", "accession", "name", "modality", "n", "state"), ("filename", "patient_hint", "mtime"), ("result_date", "report_id")
PAGE, ERRORS, PATHS, FOLDERS = 100, 100, 100, 200


def active(files: DataFrame, kind: str, status: str = "ok", inactive: bool = False) -> DataFrame:
    """Files of a kind and status, active ones unless ``inactive``; both reach the scan as pushed filters."""
    return files.where((F.col("kind") == kind) & (F.col("status") == status) & (F.col("active") == F.lit(not inactive)))


def page(rows: DataFrame, key: str, after=None, limit: int = PAGE) -> DataFrame:
    """The next rows by key: a keyset page, so no page before it is read."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def found(reports: DataFrame, query: str, texts: tuple[str, ...] = ("text", "path"), phrase: bool = True) -> DataFrame:
    """Reports with the query's words in a row as whole words, or with ``phrase`` off the query as it stands."""
    if not phrase:
        hit = F.lit(False)
        for c in texts:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower()))
        return reports.where(hit)
    words = lambda x: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    wanted = words(F.lit(query))
    hit = F.lit(False)
    for c in texts:
        hit = hit | F.contains(words(F.coalesce(F.col(c), F.lit(""))), wanted)
    return reports.where(hit & (F.trim(wanted) != ""))


def by_path(reports: DataFrame, query: str) -> DataFrame:
    """Active, readable reports whose path holds the query, whatever the case."""
    hit = F.contains(F.lower("path"), F.lit(query.lower()))
    return reports.where(F.col("active") & (F.col("status") == "ok") & hit).orderBy("path").limit(PATHS)


def listed(rows: DataFrame, order: str, allowed: tuple[str, ...], tie: str, descending: bool = False, offset: int = 0, limit: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """A page in an allowed order with ties by ``tie``, and the number of all rows; the first rows alone are sorted out."""
    if order not in allowed:
        raise ValueError(f"not an order of this list: {order}")
    by = F.col(order).desc() if descending else F.col(order).asc()
    return rows.orderBy(by, tie).offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))


def worklist(studies: DataFrame, query: str = "", queue: bool = False, state: str = "", modality: str = "", first: str = "", last: str = "") -> DataFrame:
    """Studies by a text in one field or all its parts in the name, and by queue, state, modality and dates."""
    for day in (first, last):
        if day and not (len(day) == 8 and day.isdigit()):
            raise ValueError("days are YYYYMMDD")
    out = studies
    if query:
        low = query.lower()
        name = F.lower("name")
        fields = F.lit(False)
        for c in ("accession", "patient", "name", "subject"):
            if c in studies.columns:
                fields = fields | F.contains(F.lower(F.col(c)), F.lit(low))
        parts = F.lit(True)
        for p in low.replace("^", " ").replace(",", " ").split():
            parts = parts & F.contains(name, F.lit(p))
        out = out.where(fields | parts)
    if queue:
        out = out.where(~F.col("state").isin("approved", "exported") & (F.col("n") > 0))
    for value, column in ((state, "state"), (modality, "modality")):
        out = out.where(F.col(column) == value) if value else out
    out = out.where(F.col("date") >= first) if first else out
    return out.where(F.col("date") <= last) if last else out


def modalities(studies: DataFrame) -> DataFrame:
    """The different values, in order."""
    return studies.select("modality").distinct().orderBy("modality")


def source_errors(files: DataFrame) -> DataFrame:
    """Active files that couldn't be read, with the error in their metadata."""
    return files.where(F.col("active") & (F.col("status") == "error")).select("path", "kind", F.get_json_object("metadata", "$.error").alias("error")).orderBy("path").limit(ERRORS)
