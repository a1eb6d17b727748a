"""Normalisers and extractors of study and report evidence, as SQL fragments and as columns.

Unknown is the empty text. The patterns below are fixed values: results depend on them letter by letter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import Spark

# Patterns.
ACCESSION = r"(?im)^\s*(?:accession(?:\s*(?:number|no\.?|#))?|acc\s*#?)\s*[:=#]\s*([A-Z0-9._-]{3,64})\b"
PATIENT_ID = r"(?im)^\s*(?:patient\s*(?:id|number)|mrn|medical\s*record\s*(?:number|#))\s*[:=#]\s*([A-Z0-9._-]{3,64})\b"
NAME = r"(?im)^\s*(?:patient\s*name|name)\s*[:=]\s*([^\r\n]{3,120})"
DOB = r"(?im)^\s*(?:date\s*of\s*birth|dob)\s*[:=]\s*([^\r\n]{6,32})"
EXAM_DATE = r"(?im)^\s*(?:date\s*of\s*(?:study|exam(?:ination)?)|exam(?:ination)?\s*date|study\s*date)\s*[:=]\s*([^\r\n]{6,32})"
STUDY_UID = r"(?im)^\s*study(?:\s*instance)?\s*uid\s*[:=]\s*([0-9]+(?:\.[0-9]+)+)\b"
PRINTED_HEADER = r"(?im)^[ \t]*([A-Z][A-Z ,.'^\-]{3,90}?)[ \t]*\([ \t]*MR[ \t]*#[ \t]*([A-Z0-9._-]{3,64})[ \t]*[)\]}]"
PAREN_ACCESSION = r"(?i)\([ \t]*Accession[ \t]*(?:#|:)?[ \t]*([A-Z0-9._-]{2,64})[ \t]*[)\]}]"
NAME_LINES = r"(?im)^[ \t]*(?:patient[ \t]+name|patient|name)[ \t]*[:=\-][ \t]*([^\r\n]{2,120})"
NAME_CUT = r"(?i)[ \t]+(?:MRN|MR[ \t]*#|MEDICAL[ \t]+RECORD[ \t]+(?:NUMBER|#)|DOB|DATE[ \t]+OF[ \t]+BIRTH)\b.*"
GENERIC_DATE = r"(?im)^\s*date\s*:\s*([^\r\n]+)"
SERVICE_DATE = r"(?im)^[ \t]*(?:date[ \t]+of[ \t]+service|date[ \t]+of[ \t]+(?:exam(?:ination)?|study|procedure)|(?:exam(?:ination)?|study|procedure|performed|service)[ \t]+date|exam[ \t]+performed(?:[ \t]+on)?|performed[ \t]+on)[ \t]*[:=#-][ \t]*(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{8})\b"
SERVICE_DATE_SPACE = r"(?im)^[ \t]*(?:date[ \t]+of[ \t]+service|procedure[ \t]+date|exam(?:ination)?[ \t]+date|study[ \t]+date)[ \t]+(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{8})\b"
HEADING = r"(?im)^[ \t]*(?:results[ \t]+)?(?:(?:MRI?|CT|XRAY|X-RAY|ULTRASOUND|US|MAMMOGRAM|PET|NUCLEAR[ \t]+MEDICINE)\b[^\r\n]{0,150}|(?:EXAM|EXAMINATION|PROCEDURE|STUDY)[ \t]*:[^\r\n]{0,150})"
STRICT_NAME = r"(?is)\bPATIENT\s*NAME\s*:\s*(.*?)\s*\b(?:MEDICAL\s*RECORD\s*NUMBER|MRN|MR\s*#)\s*[:=#]"
STRICT_DOB = r"(?i)\b(?:DATE\s*OF\s*BIRTH|DOB)\s*:\s*(\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\d{8})"
STRICT_EXAM = r"(?i)\b(?:DATE\s*OF\s*STUDY|EXAM\s*DATE|DATE\s*OF\s*EXAM(?:INATION)?)\s*:\s*(\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\d{8})"
SCAN_ACCESSION = r"(?im)^\s*(?:accession(?:\s*(?:number|no\.?|#))?|acc(?:\s*#)?)\s*[:=]\s*([A-Za-z0-9._-]+)"
SCAN_UID = r"(?im)^\s*Study(?:\s*Instance)?\s*UID\s*[:=]\s*([0-9.]+)"
REDACT = (
    r"(?im)^\s*(?:patient|name|mrn|medical record|accession|dob|date of birth|address|phone|email|physician|referring|dictated by|signed by)\b[^\n]*",
    r"\b\d{1,4}[-/]\d{1,2}[-/]\d{1,4}\b",
    r"\b\d{8}\b",
    r"\b\d{3}[-. ]\d{2}[-. ]\d{4}\b",
)
# Terms.
TEXT_MODALITIES = {"CT": r"(?i)\b(?:CT|COMPUTED TOMOGRAPHY)\b", "MR": r"(?i)\b(?:MRI?|MAGNETIC RESONANCE)\b", "US": r"(?i)\b(?:US|ULTRASOUND|SONOGRAM)\b", "DX": r"(?i)\b(?:XRAY|X-RAY|RADIOGRAPH)\b", "MG": r"(?i)\b(?:MAMMOGRAM|MAMMOGRAPHY)\b", "NM": r"(?i)\b(?:NUCLEAR MEDICINE)\b", "PT": r"(?i)\b(?:PET)\b"}
TEXT_ANATOMY = {"LUMBAR": r"(?i)\bLUMBAR\b", "CERVICAL": r"(?i)\bCERVICAL\b", "THORACIC": r"(?i)\bTHORACIC\b", "BRAIN": r"(?i)\b(?:BRAIN|HEAD)\b", "CHEST": r"(?i)\bCHEST\b", "ABDOMEN": r"(?i)\bABDOMEN\b", "PELVIS": r"(?i)\bPELVIS\b", "KNEE": r"(?i)\bKNEE\b", "SHOULDER": r"(?i)\bSHOULDER\b"}
DUMP_MODALITIES = {"MR": r"(?i)\b(?:MR|MRI)\b", "CT": r"(?i)\bCT\b", "US": r"(?i)\b(?:US|ULTRASOUND)\b", "DX": r"(?i)\b(?:XRAY|X-RAY|X RAY|RADIOGRAPH|XR)\b"}
DUMP_REGIONS = {"LUMBAR": r"(?i)\bLUMBAR\b|\bL[\s-]?SPINE\b", "CERVICAL": r"(?i)\bCERVICAL\b|\bC[\s-]?SPINE\b", "THORACIC": r"(?i)\bTHORACIC\b|\bT[\s-]?SPINE\b", "PELVIS": r"(?i)\bPELVIS\b|\bPELVIC\b", "CHEST": r"(?i)\bCHEST\b", "BRAIN": r"(?i)\bBRAIN\b|\bHEAD\b", "KNEE": r"(?i)\bKNEE\b", "SHOULDER": r"(?i)\bSHOULDER\b", "HIP": r"(?i)\bHIP\b"}
DIALECTS = {"PostgreSQL": r"(?im)PostgreSQL database dump|^PGDMP", "MySQL/MariaDB": r"(?i)MySQL dump|MariaDB", "SQL Server": r"(?im)\[dbo\]|^GO\s*$", "SQLite": r"(?i)SQLite format|PRAGMA foreign_keys"}


def name(d: Spark, x: str) -> str:
    """the capital-letter words of a name, sorted."""
    return d.join(d.sort(d.rxall(f"upper(translate(coalesce({x}, ''), '^,', '  '))", "[A-Z]+")))


def clean_id(d: Spark, x: str) -> str:
    """capital letters and digits alone."""
    return d.rep(f"upper(coalesce({x}, ''))", "[^A-Z0-9]")


def date(d: Spark, x: str) -> str:
    """YYYYMMDD of a whole value in one of five layouts, else ''. Two-digit years from 69 on are of 19xx."""
    v = f"trim(coalesce({x}, ''))"
    if d.name == "spark":
        return _spark_date(d, v)
    part = lambda p, g: d.int(d.rx(v, p, g))
    packed, dashed, slashed = r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})(?: \d{1,2}:\d{1,2}:\d{1,2})?$", r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"
    year = part(slashed, 3)
    full = f"(case when {year} < 69 and length({d.rx(v, slashed, 3)}) = 2 then 2000 + {year} when length({d.rx(v, slashed, 3)}) = 2 then 1900 + {year} else {year} end)"
    one = lambda p, y, m, g: d.date_ok(y, m, g)
    return f"coalesce(case when {d.has(v, packed)} then {one(packed, part(packed, 1), part(packed, 2), part(packed, 3))} when {d.has(v, dashed)} then {one(dashed, part(dashed, 1), part(dashed, 2), part(dashed, 3))} when {d.has(v, slashed)} then {one(slashed, full, part(slashed, 1), part(slashed, 2))} end, '')"


def _spark_date(d: Spark, v: str) -> str:
    """A cast tells whether there is such a day; each part of the value is looked up once."""
    packed, dashed, slashed = r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})(?: \d{1,2}:\d{1,2}:\d{1,2})?$", r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"
    day = lambda p, y, m, g: f"concat(nullif({y}, '0000'), '-', {d.rx(v, p, m)}, '-', {d.rx(v, p, g)})"
    year = d.rx(v, slashed, 3)
    full = f"case when length({year}) = 4 then {year} when {year} < '69' then concat('20', {year}) else concat('19', {year}) end"
    told = f"case when {d.has(v, packed)} then {day(packed, d.rx(v, packed, 1), 2, 3)} when {d.has(v, dashed)} then {day(dashed, d.rx(v, dashed, 1), 2, 3)} when {d.has(v, slashed)} then {day(slashed, full, 1, 2)} end"
    return f"coalesce(replace(cast(try_cast({told} as date) as string), '-', ''), '')"


def surname(d: Spark, x: str) -> str:
    """the family part of a name."""
    head = f"trim({d.first(d.split(f'''coalesce({x}, '')''', '='))})"
    caret = d.first(f"split({head}, '\\\\^')") if d.name == "spark" else d.first(d.split(head, "^"))
    return f"case when {head} like '%^%' then trim({caret}) when {head} like '%,%' then trim({d.first(d.split(head, ','))}) when {head} not like '% %' then {head} else '' end"


def surname_words(d: Spark, x: str) -> str:
    """the words of the family part, none unless all have two letters."""
    words = d.rxall(f"upper({d.rx(f'''coalesce({x}, '')''', '^([^=^,]*)', 1)})", "[A-Z]+")
    return f"case when {d.size(d.filter(words, 'length(x) < 2'))} = 0 then {words} else {d.filter(words, 'false')} end"


def names(d: Spark, text: str) -> str:
    """all normalised names that a text states."""
    lines = d.map(d.rxall(text, NAME_LINES, 1), name(d, d.rep("x", NAME_CUT)))
    printed = d.map(d.rxall(text, PRINTED_HEADER, 1), name(d, "x"))
    return d.sort(d.distinct(d.filter(d.concat(lines, printed), "x <> ''")))


def terms(d: Spark, text: str, known: dict[str, str], capitals: str = "") -> str:
    """Sorted terms of a dictionary that a text holds; a pattern is looked for where ``capitals``, the text in capitals, has one of its words."""
    return d.sort(d.compact(*[f"case when {_maybe(capitals, p)}{d.has(text, p)} then '{k}' end" for k, p in known.items()]))


def _maybe(capitals: str, pattern: str) -> str:
    words = re.fullmatch(r"\(\?i\)\\b(?:\(\?:)?([A-Z |?-]+)\)?\\b", pattern)
    if not capitals or not words:
        return ""
    return "(" + " or ".join(f"contains({capitals}, '{re.sub('[A-Z][?]', '', w)}')" for w in words[1].split("|")) + ") and "


def dump_modalities(d: Spark, text: str) -> str:
    """modalities of a procedure; DX stands for CR too."""
    found = [f"case when {d.has(text, p)} then '{k}' end" for k, p in DUMP_MODALITIES.items()]
    return d.sort(d.compact(*found, f"case when {d.has(text, DUMP_MODALITIES['DX'])} then 'CR' end"))


def exam_dates(d: Spark, text: str) -> str:
    """explicit exam and service dates in the first 24 000 characters."""
    head = f"substring({text}, 1, 24000)"
    return d.sort(d.distinct(d.filter(d.map(d.concat(d.rxall(head, SERVICE_DATE, 1), d.rxall(head, SERVICE_DATE_SPACE, 1)), date(d, "x")), "x <> ''")))


def stem(d: Spark, path: str) -> str:
    """a path's last part without its suffix."""
    return d.rx(path, r"([^/]+?)(\.[^./]*)?$", 1)


def evidence(d: Spark, reports: str) -> str:
    """a row of evidence for each of ``reports`` (report, path, text)."""
    if d.name == "spark":
        return _spark_evidence(d, reports)
    h = "substring(text, 1, 20000)"
    printed = f"substring({h}, 1, 12000)"
    accession = f"case when {d.rx(h, ACCESSION)} <> '' then {clean_id(d, d.rx(h, ACCESSION))} else {clean_id(d, d.rx(h, PAREN_ACCESSION))} end"
    patient = f"case when {d.rx(h, PATIENT_ID)} <> '' then {clean_id(d, d.rx(h, PATIENT_ID))} else {clean_id(d, d.rx(printed, PRINTED_HEADER, 2))} end"
    return f"""select report, path, text, {accession} as accession, {patient} as patient_id, {names(d, 'text')} as names,
      {date(d, d.rx(h, DOB))} as dob, {date(d, d.rx(h, EXAM_DATE))} as exam_date, {d.rx(h, STUDY_UID)} as study_uid,
      {clean_id(d, stem(d, 'path'))} as filename_key, {terms(d, h, TEXT_MODALITIES)} as modalities, {terms(d, h, TEXT_ANATOMY)} as anatomy,
      {date(d, d.rx(h, GENERIC_DATE))} as report_date from {reports}"""


def _spark_evidence(d: Spark, reports: str) -> str:
    """Each pattern is looked for once in a text, and what it finds is read as a column."""
    found = {"accession": d.rx("head", ACCESSION), "paren": d.rx("head", PAREN_ACCESSION), "patient": d.rx("head", PATIENT_ID), "printed": d.rx("substring(head, 1, 12000)", PRINTED_HEADER, 2), "dob": d.rx("head", DOB), "exam": d.rx("head", EXAM_DATE), "generic": d.rx("head", GENERIC_DATE)}
    staged = f"(select *, {', '.join(f'{x} as f_{k}' for k, x in found.items())}, upper(head) as capitals from (select *, substring(text, 1, 20000) as head from {reports}) h) f"
    either = lambda a, b: f"case when {a} <> '' then {clean_id(d, a)} else {clean_id(d, b)} end"
    return f"""select report, path, text, {either('f_accession', 'f_paren')} as accession, {either('f_patient', 'f_printed')} as patient_id, {names(d, 'text')} as names,
      {date(d, 'f_dob')} as dob, {date(d, 'f_exam')} as exam_date, {d.rx('head', STUDY_UID)} as study_uid,
      {clean_id(d, stem(d, 'path'))} as filename_key, {terms(d, 'head', TEXT_MODALITIES, 'capitals')} as modalities, {terms(d, 'head', TEXT_ANATOMY, 'capitals')} as anatomy,
      {date(d, 'f_generic')} as report_date from {staged}"""


def column(fragment, *columns: str, **more) -> Column:
    """A fragment as a column of the DataFrame API: ``column(name, "patient_name")``."""
    return F.expr(fragment(Spark(), *columns, **more))
