"""Identity of studies and dump narratives: strict pairs by name, birth date and exam, and why others aren't, as counts.

Tables: studies (uid, name, dob, date, modalities, regions, n), narratives (report, name, dob, exam_date, result_date,
modalities, regions, declared), with normalised names, days as YYYYMMDD, unknown as '', sets as arrays; declared holds
all names that the narrative states. Missing never matches and never contradicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes, in the order in which they are asked.
MISSING, DIFFERENT, NO_LINE, DECLARATIONS = "missing_primary_patient_name", "different_primary_patient_name", "no_independent_patient_name_line", "conflicting_patient_name_declarations"
DOB, NO_DOB, EXAM, MODALITY = "conflicting_dob", "missing_dob_evidence", "conflicting_exam_date", "conflicting_modality"
CONSISTENT = "identity_consistent_candidate_needs_exam_verification"


def _sets(a: str, b: str) -> Column:
    """compatible, conflict or, if either side is empty, unknown."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "unknown").when(F.arrays_overlap(a, b), "compatible").otherwise("conflict")


def _told(narratives: DataFrame) -> DataFrame:
    return narratives.select("report", F.col("name").alias("r_name"), F.col("dob").alias("r_dob"), F.col("exam_date").alias("r_exam"), F.col("result_date").alias("r_result"), F.col("modalities").alias("r_modalities"), F.col("regions").alias("r_regions"), F.array_sort("declared").alias("declared"))


def named_pairs(studies: DataFrame, narratives: DataFrame) -> DataFrame:
    """Uid, report, missing, conflicting, candidate, result_date_only of the pairs with one name."""
    both = studies.where("name <> ''").join(_told(narratives), F.col("name") == F.col("r_name"))
    fields = (("name", "r_name", "name"), ("dob", "r_dob", "dob"), ("exam_date", "r_exam", "date"))
    missing = F.array_compact(F.array(*[F.when(F.col(theirs) == "", k) for k, theirs, _ in fields]))
    conflicting = F.array_compact(F.array(*[F.when((F.col(theirs) != "") & (F.col(theirs) != F.col(ours)), k) for k, theirs, ours in fields]))
    return both.select("uid", "report", missing.alias("missing"), conflicting.alias("conflicting"), ((F.size(missing) == 0) & (F.size(conflicting) == 0)).alias("candidate"), ((F.col("r_exam") == "") & (F.col("r_result") != "") & (F.col("r_result") == F.col("date"))).alias("result_date_only"))


def strict_counts(studies: DataFrame, narratives: DataFrame) -> DataFrame:
    """For each study the pairs of its name and birth date: how many, strict, supported by a result date alone, contradicting, unclear.

    A strict pair needs the exam date, and modality and region known and compatible; a result date supports where no
    exam date is told and nothing contradicts.
    """
    both = studies.where("name <> '' and dob <> ''").join(_told(narratives), (F.col("name") == F.col("r_name")) & (F.col("dob") == F.col("r_dob")))
    both = both.withColumn("kind", _sets("modalities", "r_modalities")).withColumn("part", _sets("regions", "r_regions"))
    conflict = (F.col("kind") == "conflict") | (F.col("part") == "conflict")
    strict = (F.col("r_exam") != "") & (F.col("r_exam") == F.col("date")) & (F.col("kind") == "compatible") & (F.col("part") == "compatible")
    supporting = (F.col("r_exam") == "") & (F.col("r_result") != "") & (F.col("r_result") == F.col("date")) & ~conflict
    counts = {"strict_candidate": strict, "supporting_result_date_only": supporting, "modality_conflict": F.col("kind") == "conflict", "region_conflict": F.col("part") == "conflict", "unknown_exam_classification": (F.col("kind") == "unknown") | (F.col("part") == "unknown")}
    per = both.groupBy("uid").agg(F.count("*").alias("name_dob"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    return studies.select("uid").join(per, "uid", "left").fillna(0)


def codes(studies: DataFrame, narratives: DataFrame, cohort: int) -> DataFrame:
    """Cohort ('all', and studies of ``cohort`` images), code, pairs: one code for each pair of a study and a narrative.

    Pairs aren't formed. Both sides are counted by all that a code reads; those of one name meet, and the pairs of
    different names and of missing ones follow from the totals.
    """
    ours = studies.groupBy("name", "dob", "date", F.array_sort("modalities").alias("modalities"), (F.col("n") == cohort).alias("chosen")).agg(F.count("*").alias("n_ours"))
    theirs = _told(narratives).groupBy("r_name", "r_dob", "r_exam", F.array_sort("r_modalities").alias("r_modalities"), "declared").agg(F.count("*").alias("n_theirs"))
    code = F.when(F.size("declared") == 0, NO_LINE).when(F.col("declared") != F.array("name"), DECLARATIONS)
    code = code.when((F.col("dob") != "") & (F.col("r_dob") != "") & (F.col("dob") != F.col("r_dob")), DOB).when((F.col("dob") == "") | (F.col("r_dob") == ""), NO_DOB)
    code = code.when((F.col("r_exam") != "") & (F.col("r_exam") != F.col("date")), EXAM).when(_sets("modalities", "r_modalities") == "conflict", MODALITY).otherwise(CONSISTENT)
    met = ours.where("name <> ''").join(theirs, F.col("name") == F.col("r_name")).groupBy("chosen", code.alias("code")).agg(F.sum(F.col("n_ours") * F.col("n_theirs")).alias("pairs"))
    sides = ours.groupBy("chosen").agg(F.sum("n_ours").alias("every"), F.coalesce(F.sum(F.when(F.col("name") != "", F.col("n_ours"))), F.lit(0)).alias("named"))
    told = theirs.agg(F.coalesce(F.sum("n_theirs"), F.lit(0)).alias("r_every"), F.coalesce(F.sum(F.when(F.col("r_name") != "", F.col("n_theirs"))), F.lit(0)).alias("r_named"))
    linked = met.groupBy("chosen").agg(F.sum("pairs").alias("linked"))
    rest = sides.join(told).join(linked, "chosen", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))  # told is one row
    rest = rest.select("chosen", F.explode(F.array(F.struct(F.lit(MISSING).alias("code"), (F.col("every") * F.col("r_every") - F.col("named") * F.col("r_named")).alias("pairs")), F.struct(F.lit(DIFFERENT).alias("code"), (F.col("named") * F.col("r_named") - F.col("linked")).alias("pairs")))).alias("x")).select("chosen", "x.*")
    every = met.unionByName(rest).where("pairs > 0")
    return every.select(F.explode(F.when(F.col("chosen"), F.array(F.lit("all"), F.lit("chosen"))).otherwise(F.array(F.lit("all")))).alias("cohort"), "code", "pairs").groupBy("cohort", "code").agg(F.sum("pairs").alias("pairs"))
