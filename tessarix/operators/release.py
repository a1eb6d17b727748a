"""Review and release: what stays valid after a change, what may be exported, and why not; worklists and logs."""

from __future__ import annotations

from ..functions.dialect import Spark
from ..plans.fixtures import fx


def manifest(d: Spark) -> str:
    """A manifest against the package read again: files unchanged, changed, missing and unlisted."""
    return f"""with listed as (select concat('SUBJECT/', cast(doc_id as string), '.txt') as lpath, {d.sha("coalesce(text, '')")} as lsum, n_chars as lbytes from {d.t('documents')} where doc_id % 10 <> 9),
      there as (select concat('SUBJECT/', cast(doc_id as string), '.txt') as tpath, {d.sha("case when doc_id % 17 = 0 then concat(coalesce(text, ''), '!') else coalesce(text, '') end")} as tsum from {d.t('documents')} where doc_id % 13 <> 0)
      select status, count(*) as files, sum(lbytes) as bytes from (select case when tpath is null then 'missing' when lpath is null then 'unlisted' when lsum <> tsum then 'changed' else 'unchanged' end as status, lbytes from listed full outer join there on lpath = tpath) x group by status"""


def jobs(d: Spark) -> str:
    """Jobs by kind: failed, finished, longest, and each user's latest."""
    return f"""with log as (select event_id, event_type as kind, user_id, ts, case when event_type = 'error' then 'failed' else 'finished' end as state, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from {d.t('events')})
      select kind, state, count(*) as jobs, sum(case when rn = 1 then 1 else 0 end) as latest, count(distinct user_id) as users, max(event_id) as last_id from log group by kind, state"""


def audit(d: Spark) -> str:
    """Audit rows with the target's token instead of the target."""
    return f"select event_id, event_type as action, substring({d.hmac(b'audit-key', 'cast(user_id as string)')}, 1, 32) as target from {d.t('events')}"


def header_check(d: Spark) -> str:
    """Headers read again against the catalog, and what a study needs to be ready."""
    return f"""with {fx(d)}, again as (select sop_uid as asop, case when o_orderkey % 41 = 0 then 'CHANGED^NAME' else patient_name end as aname, study_date as adate from fx_instances where o_orderkey % 59 <> 0)
      select study_uid, count(*) as instances, count(distinct series_uid) as series, count(distinct sop_uid) as sops, sum(case when asop is null then 1 else 0 end) as missing, sum(case when aname <> patient_name or adate <> study_date then 1 else 0 end) as changed,
      sum(case when asop is null or aname <> patient_name then 1 else 0 end) = 0 and count(distinct sop_uid) = count(*) as ready from fx_instances left join again on asop = sop_uid group by study_uid"""


QUERIES = {"S14_package_check": manifest, "A29_jobs": jobs, "S15_audit": audit, "J21_header_check": header_check}
