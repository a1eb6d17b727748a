"""Review and release rules over given tables: who is open, what survives a rescan, what may be linked, released, batched.

Tables (further columns are ignored):
  instances     file_id, study_uid, series_uid, sop_uid, sop_class, modality, description, burned, frames, has_pixels, content_hash,
                active, and whatever else a header holds
  studies       uid, state, n, bytes, fingerprint, conflict, report, report_hash, approved_hash, approved_fingerprint, clean, masks,
                note, source_hashes (map of file_id to content_hash)
  reports       report, hash, active, status
  associations  uid, report, report_hash, fingerprint
Null and missing are unknown, and nothing unknown passes a rule. All joins are equi-joins on uid, report or file_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import Spark

# States that are closed to matching, and the object classes that a release may hold.
CLOSED = ("conflict", "approved", "exported", "review")
RELEASED = {
    "computed radiography": "1.2.840.10008.5.1.4.1.1.1",
    "digital x-ray for presentation": "1.2.840.10008.5.1.4.1.1.1.1",
    "digital mammography for presentation": "1.2.840.10008.5.1.4.1.1.1.2",
    "ct": "1.2.840.10008.5.1.4.1.1.2",
    "enhanced ct": "1.2.840.10008.5.1.4.1.1.2.1",
    "ultrasound multi-frame": "1.2.840.10008.5.1.4.1.1.3.1",
    "mr": "1.2.840.10008.5.1.4.1.1.4",
    "enhanced mr": "1.2.840.10008.5.1.4.1.1.4.1",
    "ultrasound": "1.2.840.10008.5.1.4.1.1.6.1",
    "secondary capture": "1.2.840.10008.5.1.4.1.1.7",
}
LEAST_NOTE, MOST_NOTE = 15, 2000


def fingerprint_of(d: Spark, fields, instead: dict[str, str] | None = None, where: str = "") -> str:
    """A3: the hash of a group of files, of all their fields by name; each value goes with its length, so no two headers look alike.

    ``instead`` holds expressions for fields that have other values; files outside of ``where`` don't count.
    """
    of = lambda c: f"cast({(instead or {}).get(c, c)} as string)"
    known = lambda c: f"coalesce(concat(cast(length({of(c)}) as string), ':', {of(c)}), '-')"
    one = f"concat({', '.join(known(c) for c in sorted(fields))})"
    return d.sha(d.join(d.sort(d.list(f"case when {where} then {one} end" if where else one)), ";"))


def fingerprints(instances: DataFrame) -> DataFrame:
    """A3: uid, fingerprint: a hash of all that is known of a study's files - id, size, time and every header field."""
    fields = [c for c in instances.columns if c != "active"]
    return instances.groupBy(F.col("study_uid").alias("uid")).agg(F.expr(fingerprint_of(Spark(), fields)).alias("fingerprint"))


def descriptions(instances: DataFrame, most: int = 3) -> DataFrame:
    """Uid, description: the first three different ones, and a mark if there are more."""
    known = F.array_sort(F.collect_set(F.when(F.trim("description") != "", F.trim("description"))))
    per = instances.groupBy(F.col("study_uid").alias("uid")).agg(known.alias("known"))
    shown = F.array_join(F.slice("known", 1, most), " / ")
    return per.select("uid", F.when(F.size("known") > most, F.concat(shown, F.lit(" / …"))).otherwise(shown).alias("description"))


def present(rows: DataFrame, instances: DataFrame, uid: str = "uid") -> DataFrame:
    """Rows whose study still has active instances."""
    live = instances.where("active").select(F.col("study_uid").alias("live_uid")).distinct()
    return rows.join(live, F.col(uid) == F.col("live_uid"), "left_semi")


def open_studies(studies: DataFrame, associations: DataFrame, instances: DataFrame) -> DataFrame:
    """Studies that may be matched: not closed, without a report or a current association, not vanished."""
    current = associations.select(F.col("uid").alias("a_uid"), F.col("fingerprint").alias("a_print"))
    loose = studies.where(~F.col("state").isin(*CLOSED) & F.col("report").isNull())
    return present(loose.join(current, (F.col("uid") == F.col("a_uid")) & (F.col("fingerprint") == F.col("a_print")), "left_anti"), instances)


def reconciled(associations: DataFrame, studies: DataFrame, reports: DataFrame) -> DataFrame:
    """Uid, report, kept, reason: an association holds if study and report are what they were when it was made."""
    s = studies.select(F.col("uid").alias("s_uid"), F.col("fingerprint").alias("s_print"), "conflict")
    r = reports.select(F.col("report").alias("r_id"), F.col("hash").alias("r_hash"), (F.col("active") & (F.col("status") == "ok")).alias("readable"))
    both = associations.join(s, F.col("uid") == F.col("s_uid"), "left").join(r, F.col("report") == F.col("r_id"), "left")
    reason = (
        F.when(F.col("s_uid").isNull(), "study vanished")
        .when(F.col("conflict"), "study conflict")
        .when(~F.coalesce(F.col("fingerprint") == F.col("s_print"), F.lit(False)), "study changed")
        .when(~F.coalesce("readable", F.lit(False)), "report missing")
        .when(~F.coalesce(F.col("report_hash") == F.col("r_hash"), F.lit(False)), "report changed")
        .otherwise("")
    )
    return both.select("uid", "report", reason.alias("reason")).withColumn("kept", F.col("reason") == "")


def rescanned(studies: DataFrame, outcome: DataFrame) -> DataFrame:
    """V1, V6: studies after a rescan: no approval survives, a kept association asks for review again."""
    kept = outcome.where("kept").select(F.col("uid").alias("k_uid"), F.col("report").alias("k_report"))
    state = F.when(F.col("conflict"), "conflict").when(F.col("k_report").isNotNull(), "needs_review").otherwise("unmatched")
    joined = studies.join(kept, F.col("uid") == F.col("k_uid"), "left").withColumn("state", state).withColumn("report", F.col("k_report"))
    none = F.lit(None)
    for c in ("approved_hash", "approved_fingerprint", "clean", "report_hash", "note"):
        if c in studies.columns:
            joined = joined.withColumn(c, none.cast(studies.schema[c].dataType))
    return joined.select(*studies.columns)


def shared_reports(associations: DataFrame, studies: DataFrame) -> DataFrame:
    """Report, report_hash that current associations of several studies use; counted map-side, so a report that
    many studies share is one row a task."""
    s = studies.select(F.col("uid").alias("s_uid"), F.col("fingerprint").alias("s_print"))
    current = associations.join(s, (F.col("uid") == F.col("s_uid")) & (F.col("fingerprint") == F.col("s_print")), "left_semi")
    return current.groupBy("report", "report_hash").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo <> hi").select("report", "report_hash")


def admissible(requests: DataFrame, studies: DataFrame, associations: DataFrame) -> DataFrame:
    """Uid, report, reasons (array) of each request (uid, report, report_hash, note, date_verified,
    conflicts_acknowledged, contradictions (array)); without reasons it is admitted."""
    s = studies.select(F.col("uid").alias("s_uid"), "state", "conflict")
    used = associations.join(studies.select(F.col("uid").alias("c_uid"), F.col("fingerprint").alias("c_print")), (F.col("uid") == F.col("c_uid")) & (F.col("fingerprint") == F.col("c_print")), "left_semi")
    used = used.groupBy(F.col("report").alias("u_report"), F.col("report_hash").alias("u_hash")).agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    joined = requests.join(s, F.col("uid") == F.col("s_uid"), "left").join(used, (F.col("report") == F.col("u_report")) & (F.col("report_hash") == F.col("u_hash")), "left")
    length = F.length(F.trim("note"))
    why = F.array_compact(
        F.array(
            F.when(F.col("s_uid").isNull(), "study unavailable"),
            F.when(~F.coalesce(length.between(LEAST_NOTE, MOST_NOTE), F.lit(False)), "review note"),
            F.when(~F.coalesce("date_verified", F.lit(False)), "date not verified"),
            F.when(~F.coalesce("conflicts_acknowledged", F.lit(False)), "conflicts not acknowledged"),
            F.when(F.col("state").isin("approved", "exported"), "study finalised"),
            F.when(F.col("conflict") | (F.size("contradictions") > 0), "contradiction"),
            F.when((F.col("lo") != F.col("uid")) | (F.col("hi") != F.col("uid")), "report used elsewhere"),
        )
    )
    return joined.select("uid", "report", why.alias("reasons"))


def valid_drafts(drafts: DataFrame, associations: DataFrame, studies: DataFrame) -> DataFrame:
    """V3: uid, prepared: a draft holds while its source is the association's and both fingerprints are the study's."""
    a = associations.select(F.col("uid").alias("a_uid"), F.col("report_hash").alias("a_hash"), F.col("fingerprint").alias("a_print"))
    s = studies.select(F.col("uid").alias("s_uid"), F.col("fingerprint").alias("s_print"))
    held = drafts.join(a, F.col("uid") == F.col("a_uid"), "left").join(s, F.col("uid") == F.col("s_uid"), "left")
    fine = (F.col("source_hash") == F.col("a_hash")) & (F.col("fingerprint") == F.col("a_print")) & (F.col("fingerprint") == F.col("s_print"))
    return held.select("uid", F.coalesce(fine, F.lit(False)).alias("prepared"))


def source_hashes(instances: DataFrame) -> DataFrame:
    """M5: uid, source_hashes: file_id to content_hash of the active instances."""
    each = instances.where("active").groupBy("study_uid", "file_id").agg(F.max("content_hash").alias("content_hash"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_id", "content_hash"))))
    return each.groupBy(F.col("study_uid").alias("uid")).agg(pairs.alias("source_hashes"))


def approval() -> Column:
    """the hash over all that a reviewer approved, of the columns of studies."""
    sources = F.array_sort(F.map_entries("source_hashes"))
    return F.sha2(F.to_json(F.struct("clean", "masks", "note", "report", "report_hash", sources.alias("sources")), {"ignoreNullFields": "false"}), 256)


def _content(file_id: Column | str, content_hash: Column | str) -> Column:
    """A file and its content as one text, null if either is unknown."""
    return F.concat(F.length(file_id).cast("string"), F.lit(":"), file_id, content_hash)


def blocked(studies: DataFrame, instances: DataFrame, reports: DataFrame, covered: DataFrame) -> DataFrame:
    """Uid, reason: the first that keeps a study from release, '' if none does.

    covered: sop_uid of instances whose every frame a mask covers. Instances are grouped by study once, and meet what was
    approved of it in its one row; by object they go around only where burned-in text needs a cover.
    """
    live, no = instances.where("active"), F.lit(False)
    burned = live.where(F.upper("burned") == "YES").select(F.col("study_uid").alias("o_uid"), "sop_uid")
    shown = burned.join(covered.select(F.col("sop_uid").alias("c_sop")), F.col("sop_uid") == F.col("c_sop"), "left_anti").select("o_uid").distinct().withColumn("open", F.lit(True))
    kind = F.col("sop_class").isin(*RELEASED.values()) & F.col("has_pixels")
    per_sop = live.groupBy("study_uid", "sop_uid").agg(
        F.count("*").alias("files"),
        (F.min("content_hash") != F.max("content_hash")).alias("twice"),
        F.max(~F.coalesce(kind, no)).alias("other"),
        F.max(F.col("file_id").isNull() | F.col("content_hash").isNull()).alias("unknown"),
        F.collect_list(_content("file_id", "content_hash")).alias("seen"),
    )
    per = per_sop.groupBy(F.col("study_uid").alias("i_uid")).agg(F.sum("files").alias("live"), F.flatten(F.collect_list("seen")).alias("seen"), *[F.max(x).alias(x) for x in ("twice", "other", "unknown")])
    unless = lambda x: ~F.coalesce(x, no)
    approved = F.transform(F.map_entries("source_hashes"), lambda e: _content(e["key"], e["value"]))
    judged = studies.join(per, F.col("uid") == F.col("i_uid"), "left").join(shown, F.col("uid") == F.col("o_uid"), "left").select(
        "uid", "report", "report_hash", "conflict", "bytes", "twice", "other", "open",
        ((F.col("state") == "approved") & (F.col("fingerprint") == F.col("approved_fingerprint"))).alias("reviewed"),
        (F.col("live") == F.col("n")).alias("counted"),
        (approval() == F.col("approved_hash")).alias("same"),
        (F.col("unknown") | unless(F.size(F.array_except("seen", approved)) == 0)).alias("changed"),
    )
    r = reports.where("active").select(F.col("report").alias("r_id"), F.col("hash").alias("r_hash"))
    s = judged.join(r, F.col("report") == F.col("r_id"), "left")
    reason = (
        F.when(unless(F.col("reviewed")), "not reviewed")
        .when(F.col("r_id").isNull() | unless(F.col("counted")), "catalog changed")
        .when(F.col("conflict"), "identity conflict")
        .when(unless(F.col("same")), "review content changed")
        .when(unless(F.col("r_hash") == F.col("report_hash")), "report changed")
        .when(F.col("changed"), "source content changed")
        .when(F.col("twice"), "conflicting copies")
        .when(F.col("other"), "object class")
        .when(F.col("open"), "burned-in annotation")
        .otherwise("")
    )
    return s.select("uid", reason.alias("reason"), "bytes")


def viewable(studies: DataFrame, instances: DataFrame) -> DataFrame:
    """Studies with instances, in no conflict and not under review, that hold as many as was recorded."""
    live = instances.where("active").groupBy(F.col("study_uid").alias("l_uid")).agg(F.count("*").alias("live"))
    return studies.where((F.col("n") > 0) & ~F.col("state").isin("conflict", "needs_review")).join(live, (F.col("uid") == F.col("l_uid")) & (F.col("n") == F.col("live")), "left_semi")


def to_prepare(studies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Uid, report of studies in state candidate."""
    c = candidates.select(F.col("uid").alias("c_uid"), "report")
    return studies.where("state = 'candidate'").select("uid").join(c, F.col("uid") == F.col("c_uid")).select("uid", "report")


def to_export(studies: DataFrame) -> DataFrame:
    """V7: uid of approved studies."""
    return studies.where("state = 'approved'").select("uid")


def batch_outcome(targets: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each target's last_error ('' where it went well), and failed, succeeded, of; failures: uid, error, at."""
    last = failures.groupBy(F.col("uid").alias("f_uid")).agg(F.max_by("error", "at").alias("error"))
    each = targets.join(last, F.col("uid") == F.col("f_uid"), "left").select("uid", F.coalesce("error", F.lit("")).alias("last_error"))
    failed = F.count_if(F.col("last_error") != "")
    return each, each.agg(failed.alias("failed"), (F.count("*") - failed).alias("succeeded"), F.count("*").alias("of"))


def uniqueness(leads: DataFrame) -> DataFrame:
    """Studies, pairs, studies with one report, with several, of leads (uid, report)."""
    per = leads.groupBy("uid").agg(F.count_distinct("report").alias("n"))
    return per.agg(F.count("*").alias("studies"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pairs"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") > 1).alias("several"))


def verified_sources(instances: DataFrame, listing: DataFrame, leads: DataFrame, most_studies: int = 20) -> DataFrame:
    """Studies, checked, unchanged, missing_or_changed, whole studies; nulls unless each study has one lead and there
    are ``most_studies`` at most."""
    counts = uniqueness(leads).select(((F.col("several") == 0) & (F.col("studies") <= most_studies)).alias("fit"), "studies")
    there = listing.select(F.col("file_id").alias("l_id"), F.col("size").alias("l_size"), F.col("mtime").alias("l_time"))
    own = instances.join(leads.select("uid").distinct(), F.col("study_uid") == F.col("uid"), "left_semi")
    same = F.coalesce((F.col("size") == F.col("l_size")) & (F.col("mtime") == F.col("l_time")), F.lit(False))
    per = own.join(there, F.col("file_id") == F.col("l_id"), "left").groupBy("study_uid").agg(F.count("*").alias("n"), F.count_if(same).alias("ok"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"), F.count_if(F.col("n") == F.col("ok")).alias("whole"))
    only = lambda x, name: F.when(F.col("fit"), x).cast("long").alias(name)
    return counts.join(total).select("studies", only(F.col("n"), "checked"), only(F.col("ok"), "unchanged"), only(F.col("n") - F.col("ok"), "missing_or_changed"), only(F.col("whole"), "whole_studies"))


# What a viewer takes uncompressed and losslessly compressed, and the tags that each instance needs.
NATIVE, COMPRESSED = ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1"), ("1.2.840.10008.1.2.4.70", "1.2.840.10008.1.2.4.90")
REQUIRED = ("read_study", "series_uid", "sop_uid", "sop_class", "syntax")


def preflight(instances: DataFrame) -> DataFrame:
    """Uid, instances, series, sops, multiframe, native, compressed, unsupported, missing (a map of tag to count), errors, ready.

    read_study is the study that the file itself names and readable whether it can be read; an unreadable file is an error and nothing else,
    one of another study an error too. A syntax that isn't known doesn't keep a study back.
    """
    read = instances.where("active").withColumn("ok", F.coalesce("readable", F.lit(False)))
    lacks = {t: F.col("ok") & (F.coalesce(F.col(t), F.lit("")) == "") for t in REQUIRED}
    of = lambda c: F.size(F.collect_set(F.when(F.col("ok") & (F.col(c) != ""), F.col(c)))).cast("long")
    syntax = F.coalesce("syntax", F.lit(""))
    per = read.groupBy(F.col("study_uid").alias("uid")).agg(
        F.count("*").alias("instances"),
        of("series_uid").alias("series"),
        of("sop_uid").alias("sops"),
        F.count_if(F.col("ok") & (F.col("frames") > 1)).alias("multiframe"),
        F.count_if(F.col("ok") & syntax.isin(*NATIVE)).alias("native"),
        F.count_if(F.col("ok") & syntax.isin(*COMPRESSED)).alias("compressed"),
        F.count_if(F.col("ok") & ~syntax.isin(*NATIVE, *COMPRESSED)).alias("unsupported"),
        F.map_filter(F.create_map(*[x for t, c in lacks.items() for x in (F.lit(t), F.count_if(c))]), lambda _, n: n > 0).alias("missing"),
        (F.count_if(~F.col("ok")) + F.count_if(F.col("ok") & (F.coalesce("read_study", F.lit("")) != F.col("study_uid")))).alias("errors"),
    )
    return per.withColumn("ready", (F.col("instances") == F.col("sops")) & (F.size("missing") == 0) & (F.col("errors") == 0))


def with_coverage(texts: DataFrame, narratives: DataFrame | None) -> tuple[DataFrame, str]:
    """Evidence of both sources, and what it covers: without a readable dump the text reports alone, said so."""
    if narratives is None:
        return texts.withColumn("source", F.lit("txt")), "text reports only; dump unavailable"
    return texts.withColumn("source", F.lit("txt")).unionByName(narratives.withColumn("source", F.lit("sql")), allowMissingColumns=True), "text reports and dump"


def newest_jobs(log: DataFrame, now: Column, most: int = 20) -> DataFrame:
    """The newest jobs with the seconds that they took or have been running, and how many are active."""
    active = log.agg(F.count_if(F.col("finished").isNull()).alias("active"))
    took = F.coalesce("finished", now).cast("double") - F.coalesce("started", "created").cast("double")
    return log.withColumn("elapsed", F.round(took, 3)).orderBy(F.desc("created"), F.desc("job")).limit(most).join(F.broadcast(active))


def ordered_queue(studies: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Every open study with its best suggestion, best bucket first, then newest."""
    own = Window.partitionBy("uid").orderBy("position")
    best = suggestions.withColumn("at", F.row_number().over(own)).where("at = 1").select(F.col("uid").alias("b_uid"), F.col("fingerprint").alias("b_print"), F.struct("bucket", "points").alias("ranking"))
    joined = studies.join(best, (F.col("uid") == F.col("b_uid")) & (F.col("fingerprint") == F.col("b_print")), "left")
    bucket = F.coalesce("ranking.bucket", F.lit("none"))
    rank = F.when(bucket == "strong", 0).when(bucket == "review", 1).when(bucket == "differences", 2).otherwise(3)
    return joined.select("uid", "date", bucket.alias("bucket"), F.col("ranking.points").alias("points"), rank.alias("rank")).orderBy("rank", F.desc("date"), "uid")


def identifiers(instances: DataFrame) -> DataFrame:
    """All that redaction must find of a study: six fields of its active instances, whole and in parts; (uid, identifiers).

    Null fields and parts of one letter give nothing; a study without any isn't returned.
    """
    fields = F.array("patient_id", "patient_name", "accession", "study_uid", "series_uid", "sop_uid")
    values = instances.where("active").select(F.col("study_uid").alias("uid"), F.explode(fields).alias("value")).where("value is not null").distinct()
    parts = values.select("uid", F.explode(F.concat(F.array("value"), F.split("value", r"[\^=]"))).alias("part")).where(F.length("part") >= 2)
    return parts.groupBy("uid").agg(F.array_sort(F.collect_set("part")).alias("identifiers"))


def first_instances(instances: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` active instances of each study by file; (uid, file_id, position)."""
    place = F.row_number().over(Window.partitionBy("study_uid").orderBy("file_id"))
    return instances.where("active").select(F.col("study_uid").alias("uid"), "file_id", place.alias("position")).where(F.col("position") <= n)
