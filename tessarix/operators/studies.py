"""Study build: one row a study from its instances, conflicts, fingerprints, series, duplicates, inventories."""

from __future__ import annotations

from ..functions.dialect import Spark
from ..plans.fixtures import conflicts, fingerprint, fx


def study_build(d: Spark) -> str:
    """A study's counts, modalities, first fields, conflicts, fingerprint and subject, in one aggregation; a study whose patient ID is blank is a subject of its own."""
    first = lambda x: f"min_by({x}, file_id)"
    return f"""with {fx(d)}, grouped as (select study_uid as uid, count(*) as n_instances, sum(size) as bytes, {d.csv('modality')} as modality, {conflicts(d)} as conflicts, {fingerprint(d)} as fingerprint,
      {first('accession')} as accession, {first('patient_id')} as patient, {first('patient_name')} as name, {first('study_date')} as date, {first('issuer')} as issuer from fx_instances group by study_uid)
    select uid, n_instances, bytes, modality, conflicts, fingerprint, accession, patient, name, date,
      concat('SUBJECT_', substring({d.hmac(b'study-key', "concat('subject', chr(0), case when patient = '' then uid else concat(issuer, chr(0), patient) end)")}, 1, 20)) as subject from grouped"""


def duplicates(d: Spark) -> str:
    """Copies of an instance with equal content keep one; with other content they quarantine the study."""
    return f"""with {fx(d)}, twice as (select study_uid, sop_uid, size as content from fx_instances union all select study_uid, sop_uid, size + 1 from fx_instances where o_orderkey % 71 = 0 union all select study_uid, sop_uid, size from fx_instances where o_orderkey % 73 = 0),
    per as (select study_uid, sop_uid, count(*) as copies, count(distinct content) as contents from twice group by study_uid, sop_uid)
    select study_uid, sum(copies) as n_rows, count(*) as kept, max(case when contents > 1 then 1 else 0 end) as quarantined from per group by study_uid having sum(copies) > count(*)"""


def series_counts(d: Spark) -> str:
    """Instances of each series, its modality from the first instance; an unknown code is OT."""
    return f"""with {fx(d)} select study_uid, series_uid, count(*) as n_instances, case when {d.has('min_by(modality, file_id)', '^[A-Z]{2}$')} then min_by(modality, file_id) else 'OT' end as modality from fx_instances group by study_uid, series_uid"""


def inventory(d: Spark) -> str:
    """The newest row of each path; unchanged rows are reused, vanished ones turn inactive."""
    return f"""with {fx(d)}, latest as (select *, row_number() over (partition by path order by run desc) as rn from fx_files),
    before as (select path as p, size as old_size, mtime as old_mtime from fx_files where run = 1)
    select path, root, size, case when run = 2 then 1 else 0 end as active, case when run = 2 and old_size = size and old_mtime = mtime then 'reused' when run = 2 and old_size is null then 'new' when run = 2 then 'read again' else 'vanished' end as action
    from latest left join before on path = p where rn = 1"""


def coverage(d: Spark) -> str:
    """Active files, images, errors, ignored files, studies and patients by root; a root without active files has null sums and zero counts."""
    status = "case l_partkey % 50 when 0 then 'error' when 1 then 'ignored' else 'ok' end"
    image = "kind = 'dicom' and status = 'ok'"
    count = lambda x: f"sum(case when kind is null then null when {x} then 1 else 0 end)"
    sums = f"count(kind) as files, {count(image)} as images, {count("status = 'error'")} as errors, {count("status = 'ignored'")} as ignored"
    patient = f"case when {image} and patient <> '' then concat(issuer, '|', patient) end"
    kept, shown = "", f"""select listed as root, {sums},
      count(distinct case when {image} then study_uid end) as studies, count(distinct {patient}) as patients from roots left join files on root = listed group by listed"""
    if d.name == "spark":  # few roots hold all files: they are counted by root before they meet the list
        kept = f"""counted as (select root as c_root, {sums} from files group by root),
    of_study as (select root as s_root, count(*) as studies from (select distinct root, study_uid from files where {image} and study_uid is not null) x group by root),
    of_patient as (select root as p_root, count(*) as patients from (select distinct root, {patient} as p from files) x where p is not null group by root),
    """
        shown = "select listed as root, coalesce(files, 0) as files, images, errors, ignored, coalesce(studies, 0) as studies, coalesce(patients, 0) as patients from roots left join counted on c_root = listed left join of_study on s_root = listed left join of_patient on p_root = listed"
    return f"""with {fx(d)}, files as (select concat('/src/', lower(modality)) as root, 'dicom' as kind, {status} as status, study_uid, issuer, case when l_suppkey % 9 = 0 then null else patient_id end as patient from fx_instances where not i_closed
      union all select '/src/reports', 'report', case when text = '' then 'error' else 'ok' end, null, null, null from fx_reports where not r_closed),
    {kept}roots as (select distinct concat('/src/', lower(modality)) as listed from fx_instances union all select '/src/reports' union all select '/src/unused')
    {shown}"""


def folder_scope(d: Spark) -> str:
    """Of selected folders, those inside another selected one are dropped."""
    parts = d.split("folder", "/")
    parents = d.map(d.steps(f"{d.size(parts)} - 1"), f"array_to_string(({parts})[1:x], '/')" if d.name == "duck" else f"array_join(slice({parts}, 1, cast(x as int)), '/')")
    return f"""with {fx(d)}, chosen as (select distinct root as folder from fx_files union all select distinct concat(root, '/', cast(doc_id % 3 as string)) from fx_files union all select '/other/x'),
    inside as (select distinct folder as child from (select folder, {d.explode(parents)} as parent from chosen) p where parent in (select folder from chosen))
    select folder from chosen left join inside on folder = child where child is null"""


QUERIES = {
    "A1_study_build": study_build,
    "A24_duplicate_instances": duplicates,
    "A25_series_counts": series_counts,
    "S3_incremental_inventory": inventory,
    "A6_source_coverage": coverage,
    "S2_folder_scope": folder_scope,
}
