"""Studies, reports, files and elements derived from the given tables; one SQL text serves Spark and the check."""

from __future__ import annotations

from ..functions.dialect import Spark
from ..operators import review

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def letters(x: str, n: int) -> str:
    return f"translate(lpad(cast({x} as string), {n}, '0'), '0123456789', 'ABCDEFGHIJ')"


def ymd(x: str) -> str:
    return f"replace(cast({x} as string), '-', '')"


def mdy(x: str) -> str:
    y = f"cast({x} as string)"
    return f"concat(substring({y}, 6, 2), '/', substring({y}, 9, 2), '/', substring({y}, 1, 4))"


#: Header fields of an instance.
HEADER = ("study_uid", "series_uid", "sop_uid", "accession", "patient_id", "issuer", "patient_name", "study_date", "modality", "burned", "birth_date", "region")


def fingerprint(d: Spark) -> str:
    """A3: a hash of all that is known of a study's files."""
    return review.fingerprint_of(d, ("file_id", "size", "mtime", *HEADER))


def recorded(d: Spark) -> str:
    """The fingerprint that was recorded of a study, before the sizes of every ninth one changed; the check derives it where it needs it."""
    if d.name == "duck":
        return ""
    own = review.fingerprint_of(d, ("file_id", "size", "mtime", *HEADER), {"size": "case when o_orderkey % 9 = 0 then size + 1 end"}, "o_orderkey % 9 = 0")
    return f" case when min(o_orderkey) % 9 = 0 then {own} else {fingerprint(d)} end as before,"


def conflicts(d: Spark) -> str:
    """A2: in what the files of a study contradict each other, '' if in nothing.

    Spark holds the least value against the largest: distinct counts of four fields would read each row five times.
    """
    several = lambda x: f"count(distinct {x}) > 1" if d.name == "duck" else f"min({x}) <> max({x})"
    differ = lambda x, label: f"case when {several(f"nullif(trim({x}), '')")} then '{label}' end"
    identity = several("concat_ws('|', patient_id, issuer, patient_name)")
    return f"concat_ws(', ', case when {identity} then 'patient identity' end, {differ('accession', 'accession')}, {differ('birth_date', 'date of birth')}, {differ('study_date', 'study date')})"


def fx(d: Spark) -> str:
    """The common table expressions; a query pays for those that it reads.

    Spark joins instances to their orders by study UID, so they lie by study afterwards and grouping them shuffles nothing more.
    """
    nl = "chr(10)"
    same_order = "l_orderkey = o_orderkey" if d.name == "duck" else "concat('1.2.840.99.', cast(l_orderkey as string)) = study_uid"
    name = f"concat(family, ', ', given, {nl})"
    lines = [
        f"concat('Accession: ', accession, {nl}, 'Patient Name: ', {name}, 'MRN: ', patient_id, {nl}, 'DOB: ', {mdy('dob')}, {nl}, 'Exam Date: ', {mdy('exam')}, {nl}, title, {nl}, 'FINDINGS: normal', {nl})",
        f"concat(family, ', ', given, ' (MR # ', patient_id, ')', {nl}, 'Results ', title, ' (Accession ', accession, ')', {nl}, 'Date of Service: ', {mdy('exam')}, {nl})",
        f"concat('Patient Name: ', {name}, 'DOB: ', {mdy('dob')}, {nl}, 'Study Date: ', {mdy('exam')}, {nl}, title, {nl})",
        f"concat('Accession: ', accession, {nl}, 'Patient Name: ', {name}, 'DOB: 01/02/1903', {nl}, 'Exam Date: ', {mdy('exam')}, {nl})",
        f"concat('Patient Name: ', {name}, 'Name: OTHER, PERSON', {nl}, 'Accession: ', accession, {nl})",
        f"concat('Patient: SOMEONE ', family, {nl}, title, {nl})",
        f"concat('Patient Name: ', {name}, 'Result Date: ', {mdy('exam')}, {nl}, title, {nl})",
        f"concat('Patient Name: ', {name}, 'Date of Service: ', {mdy('exam + 1')}, {nl}, title, {nl})",
        f"concat('Study Instance UID: ', study_uid, {nl}, 'Name: ', {name}, 'Date: ', {mdy('exam')}, {nl})",
        f"concat('FINDINGS: normal', {nl}, 'IMPRESSION: none', {nl})",
    ]
    text = " ".join(f"when {i} then {x}" for i, x in enumerate(lines))
    return f"""
fx_patient as (select c_custkey, concat('P', lpad(cast(c_custkey as string), 7, '0')) as patient_id, concat(case when c_custkey % 9 = 4 then 'VAN ' else '' end, 'FAM', {letters('c_custkey % 40', 2)}) as family,
  concat('GIV', {letters('c_custkey', 6)}) as given, date '1940-01-01' + cast(c_custkey * 37 % 20000 as int) as dob from {d.t('customer')}),
fx_order as (select o_orderkey, o_custkey, concat('1.2.840.99.', cast(o_orderkey as string)) as study_uid, concat('A', lpad(cast(o_orderkey as string), 8, '0')) as accession,
  cast(o_orderdate as date) as exam, case o_orderkey % 4 when 0 then 'MR' when 1 then 'CT' when 2 then 'US' else 'DX' end as modality,
  case o_orderkey % 5 when 0 then 'LUMBAR' when 1 then 'CERVICAL' when 2 then 'CHEST' when 3 then 'BRAIN' else 'KNEE' end as region,
  concat(case o_orderkey % 4 when 0 then 'MRI ' when 1 then 'CT ' when 2 then 'ULTRASOUND ' else 'XRAY ' end, case o_orderkey % 5 when 0 then 'LUMBAR' when 1 then 'CERVICAL' when 2 then 'CHEST' when 3 then 'BRAIN' else 'KNEE' end) as title,
  patient_id, family, given, dob, o_orderstatus = 'F' as closed from {d.t('orders')} join fx_patient on o_custkey = c_custkey),
fx_instances as (select concat('/src/img/', cast(o_orderkey as string), '/', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-', cast(cast(floor(l_extendedprice) as bigint) as string), '.dcm') as file_id, o_orderkey, l_linenumber, study_uid, concat(study_uid, '.', cast(l_suppkey as string)) as series_uid,
  concat(study_uid, '.', cast(l_suppkey as string), '.', cast(l_partkey as string), '.', cast(l_linenumber as string)) as sop_uid, accession, case when o_orderkey % 67 = 0 then '' else patient_id end as patient_id, case when o_orderkey % 3 = 0 then 'SYN' else 'OWN' end as issuer,
  case when o_orderkey % 53 = 0 and l_linenumber % 2 = 0 then 'OTHER^PERSON' else concat(family, '^', given) end as patient_name, case when o_orderkey % 59 = 0 and l_linenumber = 3 then {ymd('exam + 1')} else {ymd('exam')} end as study_date,
  case when l_linenumber = 7 then 'SR' else modality end as modality, case when l_returnflag = 'R' then 'YES' else 'NO' end as burned,
  case when o_orderkey % 6 = 0 then '' else {ymd('dob')} end as birth_date, cast(floor(l_extendedprice) as bigint) as size, l_partkey * 1000 as mtime, region, l_partkey, l_suppkey, l_linestatus = 'F' as i_closed
  from {d.t('lineitem')} join fx_order on {same_order}),
fx_reports as (select o_orderkey as report, case when o_orderkey % 10 = 9 then concat('/reports/', accession, '.txt') else concat('/reports/doc', cast(o_orderkey as string), '.txt') end as path,
  case o_orderkey % 10 {text} end as text, closed as r_closed from fx_order where o_orderkey % 7 <> 0),
fx_study as (select study_uid as uid, min(o_orderkey) as study, count(*) as n, sum(size) as bytes, {d.csv('modality')} as modality, min(accession) as accession, min(patient_id) as patient,
  min(case when l_linenumber = 1 then patient_name end) as name1, min(patient_name) as name2, min(study_date) as date, min(birth_date) as dob, min(region) as region,
  {fingerprint(d)} as fingerprint,{recorded(d)}
  {conflicts(d)} <> '' as conflict from fx_instances group by study_uid),
studies as (select uid, study, n, bytes, modality, accession, patient, coalesce(name1, name2) as name, date, dob, region, fingerprint, conflict from fx_study),
fx_dump as (select o_orderkey as report_id, o_orderkey as encounter_id, concat(case o_orderkey % 12 when 5 then 'SEEN: ' else '' end, case o_orderkey % 12 when 11 then '' else concat('PATIENT NAME: ', family, ', ', given) end, ' MRN: ', patient_id,
    case o_orderkey % 12 when 6 then concat({nl}, 'NAME: OTHER, PERSON', {nl}) else '' end, case o_orderkey % 12 when 7 then ' DATE OF BIRTH: 01/02/1903' when 8 then '' else concat(' DATE OF BIRTH: ', {mdy('dob')}) end,
    case o_orderkey % 12 when 9 then concat(' EXAM DATE: ', {mdy('exam')}) when 10 then concat(' EXAM DATE: ', {mdy('exam + 1')}) else '' end, ' FINDINGS: normal') as narrative,
  {ymd('exam + case when o_orderkey % 5 = 0 then 0 else 1 end')} as result_date, case when o_orderkey % 97 = 0 then null else cast(o_custkey as string) end as patient_ref, case when o_orderkey % 97 = 0 then null else {ymd('exam')} end as encounter_date, title as procedure_name from fx_order),
fx_files as (select 1 as run, concat('/src/', source, '/', cast(doc_id as string), '.txt') as path, concat('/src/', source) as root, n_chars as size, doc_id * 1000 as mtime, doc_id from {d.t('documents')}
  union all select 2, concat('/src/', source, '/', cast(doc_id as string), '.txt'), concat('/src/', source), case when doc_id % 13 = 0 then n_chars + 1 else n_chars end, doc_id * 1000, doc_id from {d.t('documents')} where doc_id % 11 <> 0
  union all select 2, concat('/src/', source, '/', cast(doc_id + 1000000 as string), '.txt'), concat('/src/', source), n_chars, doc_id * 1000, doc_id + 1000000 from {d.t('documents')} where doc_id % 17 = 0)"""
