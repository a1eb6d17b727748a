"""Queries of the operators that take tables, fed with tables derived from the given ones, and SQL of their own to check them.

The derived tables are input alone: instances, reports, studies, associations, masks and dump lines in which some things
have changed since they were last seen. The checks are written from the rules, not from the operators.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.dialect import Duck, Spark
from ..operators import browse, masks, narratives, review
from ..functions.text import REDACT
from ..sources import reports
from ..sources.dumps import insert_rows
from ..sources.shared import written
from .fixtures import TABLES, fx


def derived(d: Spark) -> str:
    """Instances with all that the rules read; text reports with their hash; a mask document of each study."""
    kinds = "case when l_linenumber = 7 then '1.2.840.10008.5.1.4.1.1.88.11' when modality = 'CT' then '1.2.840.10008.5.1.4.1.1.2' when modality = 'MR' then '1.2.840.10008.5.1.4.1.1.4' when modality = 'US' then '1.2.840.10008.5.1.4.1.1.6.1' else '1.2.840.10008.5.1.4.1.1.1.1' end"
    syntax = "case l_partkey % 5 when 0 then '1.2.840.10008.1.2.1' when 1 then '1.2.840.10008.1.2.4.70' when 2 then '1.2.840.10008.1.2.4.90' when 3 then '1.2.840.10008.1.2' else case when o_orderkey % 7 = 0 then '1.2.3' else '1.2.840.10008.1.2.1' end end"
    image = "concat('\"series_uid\":\"', study_uid, '.', cast(l_suppkey as string), '\"')"
    target = "concat('\"sop_uid\":\"', study_uid, '.', cast(l_suppkey as string), '.', cast(l_partkey as string), '.', cast(l_linenumber as string), '\"')"
    document = f"""case o_orderkey % 8 when 0 then '[[10,10,20,20],[0,0,64,64]]' when 1 then concat('{{"version":2,"masks":[{{"scope":"series",', {image}, ',"rect":[4,4,50,70]}}]}}')
      when 2 then concat('{{"version":2,"masks":[{{"scope":"image",', {image}, ',', {target}, ',"frame":0,"rect":[1,1,9,9]}},{{"scope":"image",', {image}, ',', {target}, ',"frame":1,"rect":[1,1,9,9]}}]}}')
      when 3 then '{{"version":3,"masks":[]}}' when 4 then '[[1,2.5,3,4]]' when 5 then '{{"version":2,"masks":[{{"scope":"exam","rect":[1,1,5,5],"frame":0}}]}}'
      when 6 then concat('{{"version":2,"masks":[{{"scope":"series","series_uid":"x1","rect":[1,1,5,5]}}]}}') else 'no json' end"""
    return f"""{fx(d)}, g_instances as (select file_id, study_uid, series_uid, sop_uid, accession, patient_id, issuer, patient_name, birth_date, study_date, modality, region, burned, size, mtime, o_orderkey, l_linenumber, l_partkey,
      case when l_linenumber % 4 = 0 then ' ' else concat(modality, ' ', region, ' ', cast(l_linenumber as string)) end as description, {kinds} as sop_class, {syntax} as syntax,
      64 * (1 + l_suppkey % 2) as height, case when modality = 'US' then 3 else 1 end as samples, 1 + l_partkey % 3 as frames, {d.sha("concat(sop_uid, ':', cast(size as string))")} as content_hash, o_orderkey % 97 <> 0 as active from fx_instances),
    g_first as (select study_uid, o_orderkey, series_uid, sop_uid, l_suppkey, l_partkey, l_linenumber from (select *, row_number() over (partition by study_uid order by sop_uid) as rn from fx_instances) x where rn = 1),
    g_documents as (select study_uid, o_orderkey, {document} as document from g_first),
    g_reports as (select report, path, text, {d.sha('text')} as hash, report % 23 <> 0 as active from fx_reports)"""


class Given:
    """The derived tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.d = spark, Spark({name: f"parquet.`{sf_dir}/{name}.parquet`" for name in TABLES})

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(f"with {derived(self.d)} {text}")

    def instances(self) -> DataFrame:
        own = self.sql("select *, height as width, true as has_pixels from g_instances")
        return own.withColumnRenamed("height", "rows").withColumnRenamed("width", "columns")

    def headers(self, where: str = "", size: str = "size", more: str = "") -> DataFrame:
        return self.sql(f"select {more and more + ', '}file_id, study_uid, series_uid, sop_uid, accession, patient_id, issuer, patient_name, birth_date, study_date, modality, region, burned, {size} as size, mtime from g_instances {where}")

    def reports(self) -> DataFrame:
        return self.sql("select report, path, text, hash, active, 'ok' as status from g_reports")

    def studies(self) -> DataFrame:
        """In one aggregation with their fingerprints, those of ``review.fingerprints`` over ``headers``."""
        return self.sql("select uid, study, n, bytes, modality, accession, patient, name, date, conflict, case when conflict then 'conflict' when study % 3 = 0 then 'candidate' when study % 10 = 1 then 'review' else 'approved' end as state, case when study % 3 = 0 then null else study end as report, fingerprint from studies")

    @cached_property
    def known(self) -> DataFrame:
        """``studies`` and, as ``before``, their fingerprints when sizes of every ninth study were others; built and written once."""
        return written(self.sql("select uid, study, n, bytes, modality, accession, patient, coalesce(name1, name2) as name, date, dob, region, conflict, case when conflict then 'conflict' when study % 3 = 0 then 'candidate' when study % 10 = 1 then 'review' else 'approved' end as state, case when study % 3 = 0 then null else study end as report, fingerprint, before from fx_study"), "known")

    def kept_studies(self) -> DataFrame:
        """``studies``, of the written ones."""
        return self.known.drop("before", "dob", "region")

    def associations(self) -> DataFrame:
        """Made before sizes changed in every ninth study and texts in every fourth report of the other ones."""
        known = f"parquet.`{self.known.path}`"
        linked = self.sql(f"select uid, case when study % 29 = 0 then 1 else study end as report, case when study % 29 = 0 then first_hash when study % 4 = 1 and study % 5 = 0 then {self.d.sha('concat(text, chr(33))')} else hash end as report_hash, before as fingerprint from (select uid, study, before from {known}) k left join (select report as r_id, text, hash from g_reports) r on r_id = study cross join (select min(hash) as first_hash from g_reports where report = 1) one where study % 4 <> 0")
        gone = self.sql(f"select concat('9.', uid) as uid, study as report, 'x' as report_hash, 'x' as fingerprint from {known} where study % 101 = 0")
        return linked.unionByName(gone)


def headers(spark, sf_dir):
    """Header fields of each file from JSON; a file without all three UIDs is an error."""
    fields = {"StudyInstanceUID": "study_uid", "SeriesInstanceUID": "series_uid", "SOPInstanceUID": "case when l_linenumber = 3 then '' when l_linenumber = 5 then null else sop_uid end", "PatientName": "patient_name", "StudyDate": "study_date", "Modality": "modality"}
    files = Given(spark, sf_dir).sql(f"select file_id, to_json(named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in fields.items())})) as metadata from g_instances")
    return extract.headers(files).select("file_id", "SOPInstanceUID", "PatientName", "Modality", "PatientID", "status", "error")


HEADERS = """select file_id, case when l_linenumber in (3, 5) then '' else sop_uid end as "SOPInstanceUID", patient_name as "PatientName", modality as "Modality", '' as "PatientID",
  case when l_linenumber in (3, 5) then 'error' else 'ok' end as status, case when l_linenumber in (3, 5) then 'missing identifiers' end as error from g_instances"""


def described(spark, sf_dir):
    """A study's first three different descriptions."""
    return review.descriptions(Given(spark, sf_dir).instances())


DESCRIBED = """select uid, case when len(l) > 3 then concat(array_to_string(l[1:3], ' / '), ' / …') else array_to_string(l, ' / ') end as description
  from (select study_uid as uid, coalesce(list_sort(list(distinct trim(description)) filter (where trim(description) <> '')), []) as l from g_instances group by study_uid) x"""


def open_studies(spark, sf_dir):
    """Studies that may still be matched."""
    g = Given(spark, sf_dir)
    return review.open_studies(g.kept_studies(), g.associations(), g.instances()).select("uid", "state")


OPEN = """select uid, 'candidate' as state from studies where not conflict and study % 3 = 0 and study % 97 <> 0 and (study % 4 = 0 or study % 9 = 0)"""


def reconciled(spark, sf_dir):
    """Which associations hold after a rescan, and why not."""
    g = Given(spark, sf_dir)
    return review.reconciled(g.associations(), g.kept_studies(), g.reports())


_OUTCOME = """(select a.uid, a.report, case when conflict then 'study conflict' when study % 9 = 0 then 'study changed' when r.report is null or not r.active then 'report missing'
    when study % 29 <> 0 and study % 4 = 1 and study % 5 = 0 then 'report changed' else '' end as reason, study, conflict from (select uid, study, conflict, case when study % 29 = 0 then 1 else study end as report from studies where study % 4 <> 0) a left join g_reports r on r.report = a.report)"""
RECONCILED = f"select uid, report, reason, reason = '' as kept from {_OUTCOME} o union all select concat('9.', uid), study, 'study vanished', false from studies where study % 101 = 0"


def rescanned(spark, sf_dir):
    """V1, V6: studies after a rescan: states and reports; approvals are gone."""
    g = Given(spark, sf_dir)
    studies = g.kept_studies().withColumn("approved_hash", F.lit("x")).withColumn("approved_fingerprint", F.col("fingerprint"))
    after = review.rescanned(studies, review.reconciled(g.associations(), studies, g.reports()))
    return after.select("uid", "state", "report", F.coalesce("approved_hash", "approved_fingerprint").alias("approval"))


RESCANNED = f"select s.uid, case when s.conflict then 'conflict' when o.uid is not null then 'needs_review' else 'unmatched' end as state, o.report, cast(null as varchar) as approval from studies s left join (select * from {_OUTCOME} x where reason = '') o on o.uid = s.uid"


def admissible(spark, sf_dir):
    """Why a requested association is refused."""
    g = Given(spark, sf_dir)
    known = f"(select uid, study from parquet.`{g.known.path}`)"
    wanted = g.sql(f"select uid, report, report_hash, case when study % 7 = 0 then 'too short' when study % 7 = 1 then null else 'compared with the printed header' end as note, study % 11 <> 0 as date_verified, study % 13 <> 0 as conflicts_acknowledged, case when study % 17 = 0 then array('dob') else array() end as contradictions from (select s.uid, s.study, case when study % 29 = 0 then 1 else study end as report, case when study % 29 = 0 then f.hash else r.hash end as report_hash from {known} s left join g_reports r on r.report = study left join g_reports f on f.report = 1) x")
    return review.admissible(wanted, g.kept_studies(), g.associations()).select("uid", "report", F.array_join("reasons", "; ").alias("reasons"))


ADMISSIBLE = """with w as (select uid, study, conflict, case when study % 29 = 0 then 1 else study end as report from studies),
  h as (select w.*, r.hash from w left join g_reports r on r.report = w.report),
  used as (select report, min(uid) as lo, max(uid) as hi from h where study % 4 <> 0 and study % 9 <> 0 and hash is not null and (study % 29 = 0 or not (study % 4 = 1 and study % 5 = 0)) group by report)
select h.uid, h.report, concat_ws('; ', case when study % 7 in (0, 1) then 'review note' end, case when study % 11 = 0 then 'date not verified' end, case when study % 13 = 0 then 'conflicts not acknowledged' end,
  case when not conflict and study % 3 <> 0 and study % 10 <> 1 then 'study finalised' end, case when conflict or study % 17 = 0 then 'contradiction' end, case when hash is not null and (lo <> h.uid or hi <> h.uid) then 'report used elsewhere' end) as reasons
from h left join used on used.report = h.report"""


def release(g: Given) -> DataFrame:
    """Studies with what was approved of them, some of it changed since."""
    s = g.studies().join(g.reports().select(F.col("report").alias("r"), "hash"), F.col("study") == F.col("r"), "left").join(review.source_hashes(g.instances()), "uid", "left")
    s = s.withColumn("report", F.col("study")).withColumn("report_hash", F.when(F.col("study") % 17 == 0, "old").otherwise(F.col("hash"))).withColumn("clean", F.concat(F.lit("clean "), "uid")).withColumn("masks", F.lit("[]")).withColumn("note", F.lit("compared and found the same"))
    s = s.withColumn("approved_hash", review.approval()).withColumn("approved_fingerprint", F.when(F.col("study") % 19 == 0, "old").otherwise(F.col("fingerprint")))
    return s.withColumn("note", F.when(F.col("study") % 5 == 0, F.lit("another note")).otherwise(F.col("note"))).withColumn("n", F.when(F.col("study") % 11 == 0, F.col("n") + 1).otherwise(F.col("n")))


def exportable(spark, sf_dir):
    """The first reason that keeps each study from release."""
    g = Given(spark, sf_dir)
    now = g.instances().withColumn("content_hash", F.when((F.col("o_orderkey") % 13 == 0) & (F.col("l_linenumber") == 1), "new").otherwise(F.col("content_hash")))
    covered = now.where("o_orderkey % 2 = 0").select("sop_uid")
    return review.blocked(release(g), now, g.reports(), covered)


EXPORTABLE = """with twice as (select distinct study_uid as t_uid from (select study_uid, sop_uid from g_instances where active group by study_uid, sop_uid having count(distinct content_hash) > 1) x), i as (select study_uid, max(l_linenumber) = 7 as other, min(l_linenumber) = 1 as begins, max(case when burned = 'YES' then 1 else 0 end) = 1 as burned from g_instances where active group by study_uid)
select uid, case when conflict or study % 3 = 0 or study % 10 = 1 or study % 19 = 0 then 'not reviewed' when r.report is null or not r.active or i.study_uid is null or study % 11 = 0 then 'catalog changed' when study % 5 = 0 then 'review content changed' when study % 17 = 0 then 'report changed'
  when study % 13 = 0 and begins then 'source content changed' when t_uid is not null then 'conflicting copies' when other then 'object class' when burned and study % 2 = 1 then 'burned-in annotation' else '' end as reason, bytes from studies left join g_reports r on r.report = study left join i on i.study_uid = uid left join twice on t_uid = uid"""


def batches(spark, sf_dir):
    """Studies to prepare with their report, studies to export, studies to view."""
    g = Given(spark, sf_dir)
    s = g.studies().withColumn("n", F.when(F.col("study") % 11 == 0, F.col("n") + 1).otherwise(F.col("n")))
    candidates = g.sql("select uid, report from studies join fx_reports on report = study")
    mark = lambda df, name: df.select("uid", F.lit(name).alias("set"), *([F.col("report")] if "report" in df.columns and name == "prepare" else [F.lit(None).cast("long").alias("report")]))
    return mark(review.to_prepare(s, candidates), "prepare").unionByName(mark(review.to_export(s), "export")).unionByName(mark(review.viewable(s, g.instances()), "view"))


BATCHES = """select uid, 'prepare' as "set", study as report from studies where not conflict and study % 3 = 0 and study % 7 <> 0
union all select uid, 'export', null from studies where not conflict and study % 3 <> 0 and study % 10 <> 1
union all select uid, 'view', null from studies where not conflict and study % 11 <> 0 and study % 97 <> 0"""


def mask_documents(spark, sf_dir):
    """Mask documents, how many masks they hold, and why some are refused."""
    return masks.parsed(Given(spark, sf_dir).sql("select * from g_documents")).select("study_uid", "reason", F.coalesce(F.size("masks"), F.lit(0)).alias("n_masks"))


MASK_DOCUMENTS = """select study_uid, case o_orderkey % 8 when 3 then 'format' when 4 then 'rectangle' when 5 then 'scope or fields' when 6 then 'target' when 7 then 'format' else '' end as reason,
  cast(case o_orderkey % 8 when 0 then 2 when 1 then 1 when 2 then 2 else 0 end as int) as n_masks from g_documents"""


def mask_targets(spark, sf_dir):
    """Masks bound to instances by scope, their faults, whole cover, and what burned-in text keeps back."""
    g = Given(spark, sf_dir)
    # rows without masks go behind the explode: a filter before it would be moved below the parsing and parse once more
    each = masks.parsed(g.sql("select * from g_documents")).select("study_uid", F.explode_outer("masks").alias("m")).where("m is not null")
    return masks.targets(written(each.select("study_uid", "m.*"), "masks"), g.instances())


MASK_TARGETS = """with first as (select study_uid as f_study, series_uid as f_series, sop_uid as f_sop from g_first),
  i as (select *, o_orderkey % 8 as k, series_uid = f_series as own_series, sop_uid = f_sop as own from g_instances join first on f_study = study_uid),
  m as (select sop_uid, burned, frames, samples, height, case when k = 0 then 2 when k = 1 and own_series then 1 when k = 2 and own then 2 else 0 end as n_masks, k from i),
  f as (select *, case when n_masks = 0 then 0 when samples <> 1 then n_masks when k = 1 and (54 > height or 74 > height) then 1 when k = 2 and frames = 1 then 1 else 0 end as faults from m),
  c as (select *, n_masks > 0 and (k in (0, 1) or frames = 2) as covered from f)
select sop_uid, cast(n_masks as bigint) as n_masks, cast(faults as bigint) as faults, case when faults = 0 then null when samples <> 1 then 'colour' when k = 1 then 'outside the image' else 'no such frame' end as first_fault, covered, burned = 'YES' and not covered as quarantined from c"""


def _dump_lines(g: Given) -> DataFrame:
    """INSERT lines of the four tables, with both kinds of quotes, several forms of numbers and identical duplicates."""
    blank = ", ".join(["NULL"] * 4)
    return g.sql(f"""select concat('INSERT INTO labdataex VALUES (', cast(o_orderkey as string), ', {blank}, ''', case when o_orderkey % 6 = 0 then 'nothing said' else concat('PATIENT: it\\\\''s ', family, ' findings: normal') end, '''', repeat(', NULL', 22), ');') as value from fx_order
      union all select concat('INSERT IGNORE INTO `labdata` VALUES (', cast(o_orderkey as string), ', ', cast(o_orderkey as string), ', "', cast(o_orderkey % 50 as string), '", +1, .5, 1., ''', date_format(exam, 'yyyyMMdd'), ''');') from fx_order where o_orderkey % 31 <> 0
      union all select concat('INSERT INTO db.enc VALUES (', cast(o_orderkey as string), ', ', cast(o_custkey as string), ', NULL, ''', date_format(exam, 'yyyyMMdd'), '''),(', cast(o_orderkey as string), ', ', cast(o_custkey as string), ', NULL, ''', date_format(exam, 'yyyyMMdd'), ''');') from fx_order where o_orderkey % 97 <> 0
      union all select concat('INSERT INTO items VALUES (', cast(k as string), ', "MR ""LUMBAR"" ', cast(k as string), '");') from (select distinct o_orderkey % 50 as k from fx_order where o_orderkey % 50 <> 49) x""")


def _dump_rows(g: Given) -> DataFrame:
    """The rows of the lines, which are read once for all four tables."""
    return written(insert_rows(_dump_lines(g)), "dump")


def narrative_index(spark, sf_dir):
    """Narratives with their lab row, encounter and procedure."""
    whole, _ = narratives.index(narratives.typed(_dump_rows(Given(spark, sf_dir)))[0])
    return whole.select("report_id", "narrative", "encounter_id", "result_date", "patient_ref", "encounter_date", "procedure_name")


_NARRATIVES = """(select cast(o_orderkey as varchar) as report_id, concat('PATIENT: it''s ', family, ' findings: normal') as narrative, case when o_orderkey % 31 <> 0 then cast(o_orderkey as varchar) end as encounter_id, case when o_orderkey % 31 <> 0 then strftime(exam, '%Y%m%d') end as result_date,
  case when o_orderkey % 31 <> 0 and o_orderkey % 97 <> 0 then cast(o_custkey as varchar) end as patient_ref, case when o_orderkey % 31 <> 0 and o_orderkey % 97 <> 0 then strftime(exam, '%Y%m%d') end as encounter_date,
  case when o_orderkey % 31 <> 0 and o_orderkey % 50 <> 49 then concat('MR "LUMBAR" ', cast(o_orderkey % 50 as varchar)) end as procedure_name, o_orderkey % 31 <> 0 as has_item from fx_order where o_orderkey % 6 <> 0)"""
NARRATIVE_INDEX = f"select report_id, narrative, encounter_id, result_date, patient_ref, encounter_date, procedure_name from {_NARRATIVES} n"


def narrative_totals(spark, sf_dir):
    """Totals of the index, strict and independent, and whether each may be published."""
    tables, _ = narratives.typed(_dump_rows(Given(spark, sf_dir)))
    made = [narratives.index(tables, free)[1].withColumn("mode", F.lit("independent" if free else "strict")) for free in (False, True)]
    return made[0].unionByName(made[1])


NARRATIVE_TOTALS = f"""select 'strict' as mode, count(*) as narratives, count(procedure_name) as with_procedure, count(result_date) as with_result_date, count(*) filter (where encounter_id is null or patient_ref is null or not has_item) as unlinked, cast(0 as bigint) as ambiguous, count(*) filter (where encounter_id is null or patient_ref is null) = 0 as publishable from {_NARRATIVES} n
union all select 'independent', count(*), count(*) filter (where o_orderkey % 31 <> 0 and o_orderkey % 50 <> 49), count(*) filter (where o_orderkey % 31 <> 0), count(*) filter (where o_orderkey % 31 = 0 or o_orderkey % 97 = 0), 0, true from fx_order"""


def browsed(spark, sf_dir):
    """Searches in reports by phrase, substring and path, a keyset page and an ordered page, as rows (list, at, report)."""
    reports = Given(spark, sf_dir).reports()
    first = lambda df, name: df.select(F.lit(name).alias("list"), "report")
    out = first(browse.found(reports, "mri lumbar", ("text",)), "phrase").unionByName(first(browse.found(reports, "RI LUM", ("text",), phrase=False), "substring"))
    out = out.unionByName(first(browse.by_path(reports, "/DOC1"), "path")).unionByName(first(browse.page(reports.where("active"), "report", 100), "page"))
    return out.unionByName(first(browse.listed(reports.withColumn("filename", F.col("path")), "filename", browse.REPORT_ORDERS, "report", True, 5)[0], "ordered"))


BROWSED = """select 'phrase' as list, report from g_reports where regexp_matches(text, '(?i)(^|[^A-Za-z0-9])MRI[^A-Za-z0-9]+LUMBAR($|[^A-Za-z0-9])') union all select 'substring', report from g_reports where lower(text) like '%ri lum%'
union all (select 'path', report from g_reports where active and lower(path) like '%/doc1%' order by path limit 100) union all (select 'page', report from g_reports where active and report > 100 order by report limit 100)
union all (select 'ordered', report from g_reports order by path desc, report limit 100 offset 5)"""


def errors(spark, sf_dir):
    """Active files that can't be read, and how many files each filter leaves."""
    files = Given(spark, sf_dir).sql("select path, case when report % 2 = 0 then 'report' else 'dicom' end as kind, case when report % 5 = 0 then 'error' else 'ok' end as status, active, case when report % 5 = 0 then concat('{\"error\":\"no ', cast(report % 3 as string), '\"}') else '{}' end as metadata from g_reports")
    counted = lambda df, name: df.agg(F.count("*").cast("string").alias("error")).select(F.lit(name).alias("path"), F.lit("count").alias("kind"), "error")
    return browse.source_errors(files).unionByName(counted(browse.active(files, "report"), "active")).unionByName(counted(browse.active(files, "report", inactive=True), "inactive"))


ERRORS = """(select path, case when report % 2 = 0 then 'report' else 'dicom' end as kind, concat('no ', cast(report % 3 as varchar)) as error from g_reports where active and report % 5 = 0 order by path limit 100)
union all select 'active', 'count', cast(count(*) as varchar) from g_reports where active and report % 2 = 0 and report % 5 <> 0 union all select 'inactive', 'count', cast(count(*) as varchar) from g_reports where not active and report % 2 = 0 and report % 5 <> 0"""


def worked(spark, sf_dir):
    """The review queue by name parts, modality and dates, in order, and the modalities to choose from."""
    s = Given(spark, sf_dir).studies().withColumn("subject", F.lit(""))
    shown, total = browse.listed(browse.worklist(s, "giv, FAM", queue=True, modality="MR", first="19940101", last="19981231"), "date", browse.STUDY_ORDERS, "uid", True, 3, 50)
    rows = shown.join(F.broadcast(total)).select("uid", "date", "total")
    return rows.unionByName(browse.modalities(s).select(F.col("modality").alias("uid"), F.lit("").alias("date"), F.lit(0).cast("long").alias("total")))


WORKED = """(select uid, date, (select count(*) from studies where modality = 'MR' and date between '19940101' and '19981231' and lower(name) like '%fam%' and lower(name) like '%giv%' and (conflict or study % 3 = 0 or study % 10 = 1)) as total from studies where modality = 'MR' and date between '19940101' and '19981231' and lower(name) like '%fam%' and lower(name) like '%giv%' and (conflict or study % 3 = 0 or study % 10 = 1) order by date desc, uid limit 50 offset 3)
union all select distinct modality, '', 0 from studies"""


def extracted(spark, sf_dir):
    """whole extracts and scan keys of each report."""
    rows = Given(spark, sf_dir).reports().select("report", extract.extract(F.col("text"), F.col("path")).alias("e"), extract.scan_keys(F.col("text"), F.col("path")).alias("k"))
    return rows.select("report", F.array_join("e.accessions", ",").alias("accessions"), F.array_join("e.uids", ",").alias("uids"), "e.patient_name", "e.mrn", "e.birth_date", "e.study_date", "e.modality", "k.name_hint")


EXTRACTED = """select report, case when o_orderkey % 10 in (0, 3, 4) then array_to_string(list_sort([accession, concat('doc', cast(report as varchar))]), ',') when o_orderkey % 10 = 1 then array_to_string(list_sort([accession, concat('doc', cast(report as varchar))]), ',') when o_orderkey % 10 = 9 then accession else concat('doc', cast(report as varchar)) end as accessions,
  case when o_orderkey % 10 = 8 then study_uid else '' end as uids, case when o_orderkey % 10 in (0, 2, 3, 4, 6, 7) then array_to_string(list_sort(string_split(concat(family, ' ', given), ' ')), ' ') else '' end as patient_name, case when o_orderkey % 10 = 0 then patient_id else '' end as mrn,
  case when o_orderkey % 10 in (0, 2) then strftime(dob, '%Y%m%d') when o_orderkey % 10 = 3 then '19030102' else '' end as birth_date, case when o_orderkey % 10 in (0, 3) then strftime(exam, '%Y%m%d') else '' end as study_date,
  case when o_orderkey % 10 in (0, 2, 5, 6, 7) then modality else '' end as modality, case when o_orderkey % 10 in (0, 2, 3, 4, 6, 7) then concat(family, ', ', given) when o_orderkey % 10 = 5 then concat('SOMEONE ', family) when o_orderkey % 10 = 8 then concat(family, ', ', given) else '' end as name_hint
from fx_reports join fx_order on o_orderkey = report"""


def research_uids(spark, sf_dir):
    """research UIDs of the studies, decimal text of 128 bits of a keyed hash."""
    g = Given(spark, sf_dir)
    token = F.expr(g.d.hmac(b"study-key", "concat('uid', chr(0), uid)"))
    return g.sql("select uid from studies").select("uid", extract.research_uid(token).alias("research_uid"))


def _research_sql() -> str:
    token = Duck().hmac(b"study-key", "concat('uid', chr(0), uid)")
    return f"select uid, concat('2.25.', cast(cast(concat('0x', substr({token}, 1, 32)) as uhugeint) as varchar)) as research_uid from studies"


def _read(g: Given) -> DataFrame:
    """Instances as read again: some can't be read, name another study, lack a class or a syntax, or have the lossy one."""
    syntax = F.when(F.col("l_partkey") % 29 == 0, "1.2.840.10008.1.2.4.50").when(F.col("l_partkey") % 31 == 0, "").otherwise(F.col("syntax"))
    own = g.instances().withColumn("syntax", syntax).withColumn("sop_class", F.when(F.col("l_partkey") % 37 == 0, None).otherwise(F.col("sop_class")))
    return own.withColumn("readable", F.col("l_partkey") % 41 != 0).withColumn("read_study", F.when(F.col("l_partkey") % 43 == 0, "9.9").otherwise(F.col("study_uid")))


def checked(spark, sf_dir):
    """Preflight of each study."""
    out = review.preflight(_read(Given(spark, sf_dir)))
    return out.withColumn("missing", F.array_join(F.array_sort(F.transform(F.map_entries("missing"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ","))


CHECKED = """with r as (select *, l_partkey % 41 <> 0 as ok, case when l_partkey % 29 = 0 then '1.2.840.10008.1.2.4.50' when l_partkey % 31 = 0 then '' else syntax end as s, l_partkey % 37 = 0 as classless from g_instances where active),
  p as (select study_uid as uid, count(*) as instances, count(distinct series_uid) filter (where ok) as series, count(distinct sop_uid) filter (where ok) as sops, count(*) filter (where ok and frames > 1) as multiframe, count(*) filter (where ok and s in ('1.2.840.10008.1.2', '1.2.840.10008.1.2.1')) as native,
    count(*) filter (where ok and s in ('1.2.840.10008.1.2.4.70', '1.2.840.10008.1.2.4.90')) as compressed, count(*) filter (where ok and s not in ('1.2.840.10008.1.2', '1.2.840.10008.1.2.1', '1.2.840.10008.1.2.4.70', '1.2.840.10008.1.2.4.90')) as unsupported,
    count(*) filter (where ok and classless) as no_class, count(*) filter (where ok and s = '') as no_syntax, count(*) filter (where not ok) + count(*) filter (where ok and l_partkey % 43 = 0) as errors from r group by study_uid)
select uid, instances, series, sops, multiframe, native, compressed, unsupported, concat_ws(',', case when no_class > 0 then concat('sop_class=', no_class) end, case when no_syntax > 0 then concat('syntax=', no_syntax) end) as missing, errors, errors = 0 and no_class = 0 and no_syntax = 0 and instances = sops as ready from p"""


def verified(spark, sf_dir):
    """Studies by how many reports their leads have, and sources of those with one alone held against a listing."""
    g = Given(spark, sf_dir)
    leads = written(g.sql("select uid, explode(case when study % 6 = 0 then array(study, study + 1) else array(study) end) as report from studies where not conflict"), "leads")
    alone = leads.where("report % 6 > 1")
    listing = g.instances().where("l_partkey % 37 <> 0").withColumn("size", F.when(F.col("l_partkey") % 31 == 0, F.col("size") + 1).otherwise(F.col("size")))
    one = review.verified_sources(g.instances(), listing, alone, most_studies=1 << 40)
    return one.join(review.uniqueness(leads).select(F.col("pairs").alias("lead_pairs"), "one", "several"))


VERIFIED = """with i as (select study_uid, l_partkey % 37 <> 0 and l_partkey % 31 <> 0 as same from g_instances join studies on uid = study_uid where not conflict and study % 6 > 1),
  p as (select study_uid, count(*) as n, count(*) filter (where same) as ok from i group by study_uid)
select count(*) as studies, cast(sum(n) as bigint) as checked, cast(sum(ok) as bigint) as unchanged, cast(sum(n - ok) as bigint) as missing_or_changed, count(*) filter (where n = ok) as whole_studies,
  (select count(*) + count(*) filter (where study % 6 = 0) from studies where not conflict) as lead_pairs, (select count(*) filter (where study % 6 <> 0) from studies where not conflict) as one, (select count(*) filter (where study % 6 = 0) from studies where not conflict) as several from p"""


def identified(spark, sf_dir):
    """The identifiers of each study that redaction looks for."""
    return review.identifiers(Given(spark, sf_dir).instances()).select("uid", F.size("identifiers").cast("long").alias("n"), F.array_join("identifiers", ";").alias("identifiers"))


IDENTIFIED = """select study_uid as uid, count(distinct p) as n, array_to_string(list_sort(list(distinct p)), ';') as identifiers from (select study_uid, unnest(list_concat([v], string_split(replace(v, '=', '^'), '^'))) as p
  from (select study_uid, unnest([patient_id, patient_name, accession, study_uid, series_uid, sop_uid]) as v from g_instances where active) x) y where length(p) >= 2 group by study_uid"""


def first_eight(spark, sf_dir):
    """The first eight instances of each study."""
    return review.first_instances(Given(spark, sf_dir).instances(), 8)


FIRST_EIGHT = """select study_uid as uid, file_id, 1 + (select count(*) from g_instances b where b.study_uid = a.study_uid and b.active and b.file_id < a.file_id) as position from g_instances a
  where active and (select count(*) from g_instances b where b.study_uid = a.study_uid and b.active and b.file_id < a.file_id) < 8"""


def redaction(spark, sf_dir):
    """Documents with header lines, dates and numbers of identifier shape replaced, spans merged."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.array().cast("array<string>").alias("identifiers"))
    out = reports.redacted(docs, keep="doc_id")
    return out.select("doc_id", F.length("text").cast("long").alias("n_after"), F.sha2("text", 256).alias("text_sha256"), (F.col("n_spans") > 0).alias("changed"))


def _redaction_sql() -> str:
    out = "coalesce(text, '')"
    for pattern in REDACT:
        out = f"regexp_replace({out}, {Duck().lit(pattern)}, '[REDACTED]', 'g')"
    return f"select doc_id, length({out}) as n_after, sha256({out}) as text_sha256, {out} like '%[REDACTED]%' as changed from documents"


def drafts(spark, sf_dir):
    """V3: which prepared drafts still hold after sizes and texts have changed."""
    g = Given(spark, sf_dir)
    kept = g.associations().where("uid not like '9.%'")
    made = kept.withColumn("source_hash", F.when(F.substring("uid", -1, 1) == "3", "old").otherwise(F.col("report_hash"))).withColumn("fingerprint", F.when(F.substring("uid", -1, 1) == "7", "old").otherwise(F.col("fingerprint")))
    return review.valid_drafts(made.select("uid", "source_hash", "fingerprint"), kept, g.kept_studies())


DRAFTS = "select uid, study % 9 <> 0 and study % 10 not in (3, 7) and (study % 7 <> 0 or study % 29 = 0) as prepared from studies where study % 4 <> 0"


def outcome(spark, sf_dir):
    """The last error of each study of a batch, and how many failed, behind them under a name of its own."""
    g = Given(spark, sf_dir)
    failures = g.sql("select uid, concat('no ', cast(k as string)) as error, study * k as at from studies cross join (select explode(array(1, 2, 3)) as k) x where study % 5 = 0 and k <= study % 4")
    each, total = review.batch_outcome(g.sql("select uid from studies"), failures)
    return each.unionByName(total.select(F.lit("all").alias("uid"), F.concat_ws("/", "failed", "succeeded", "of").alias("last_error")))


OUTCOME = """with e as (select uid, case when study % 5 = 0 and study % 4 > 0 then concat('no ', study % 4) else '' end as last_error from studies)
select * from e union all select 'all', concat_ws('/', count(*) filter (where last_error <> ''), count(*) filter (where last_error = ''), count(*)) from e"""


def newest(spark, sf_dir):
    """The twenty newest jobs, how long they took or have been running, and how many are active."""
    g = Given(spark, sf_dir)
    log = g.spark.sql(f"select event_id as job, event_type as kind, cast(ts as timestamp) as created, cast(ts as timestamp) + make_interval(0, 0, 0, 0, 0, 0, event_id % 7) as started, case when event_id % 3 <> 0 then cast(ts as timestamp) + make_interval(0, 0, 0, 0, 0, 2, event_id % 11) end as finished from {g.d.t('events')}")
    out = review.newest_jobs(log, F.lit("2024-12-31 00:00:00").cast("timestamp"))
    return out.select("job", "kind", F.round("elapsed", 3).alias("elapsed"), "active")


NEWEST = """select event_id as job, event_type as kind, round(case when event_id % 3 <> 0 then 120.0 + event_id % 11 - event_id % 7 else epoch(timestamp '2024-12-31 00:00:00') - epoch(ts) - event_id % 7 end, 3) as elapsed,
  (select count(*) from events where event_id % 3 = 0) as active from events order by ts desc, event_id desc limit 20"""


QUERIES = {
    "F35_redaction": (redaction, _redaction_sql()), "S7_headers": (headers, HEADERS), "A7_descriptions": (described, DESCRIBED), "P1_open_studies": (open_studies, OPEN), "V1_reconciled": (reconciled, RECONCILED), "V6_rescanned": (rescanned, RESCANNED),
    "V2_admissible": (admissible, ADMISSIBLE), "V5_exportable": (exportable, EXPORTABLE), "V7_batches": (batches, BATCHES), "F37_mask_documents": (mask_documents, MASK_DOCUMENTS), "J22_mask_targets": (mask_targets, MASK_TARGETS),
    "J9_narratives": (narrative_index, NARRATIVE_INDEX), "A23_narrative_totals": (narrative_totals, NARRATIVE_TOTALS), "P13_report_browse": (browsed, BROWSED), "P14_source_errors": (errors, ERRORS), "T1_worklist": (worked, WORKED),
    "F19_extracts": (extracted, EXTRACTED), "F29_research_uids": (research_uids, _research_sql()), "A20_preflight": (checked, CHECKED), "A13_verified_sources": (verified, VERIFIED), "V3_drafts": (drafts, DRAFTS), "A28_batch_outcome": (outcome, OUTCOME), "A29_newest_jobs": (newest, NEWEST), "U6_identifiers": (identified, IDENTIFIED), "W4_first_instances": (first_eight, FIRST_EIGHT),
}


def oracle(sql: str) -> str:
    """A check with the derived tables in front; one that begins with tables of its own goes on with them."""
    own = sql.removeprefix("with ")
    return f"with {derived(Duck())}{', ' if own != sql else ' '}{own}"
