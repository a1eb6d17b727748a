"""Queries over dump texts and lines written from the given tables, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import probe
from ..sources.ddl import ddl_columns
from ..sources.dumps import insert_rows
from .given import Given, oracle


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns that dumps declare among comments, texts, quoted names and COPY data, one dump for each part."""
    key, nl = "cast(p_partkey as string)", "chr(10)"
    odd = "case p_partkey % 3 when 0 then 'accession_no' when 1 then '\"odd, name\"' else 'patient_id' end"
    text = f"""concat('-- CREATE TABLE no (a int);', {nl}, 'CREATE TABLE `t', {key}, '` (id int, note varchar(9) DEFAULT ''x--y'', ', {odd}, ' int, PRIMARY KEY (id)); CREATE TABLE u (report_id int, price numeric(10, 2) /* , gone int */);', {nl},
      case when p_partkey % 5 = 0 then concat('COPY x FROM stdin;', {nl}, 'CREATE TABLE c (z int);', {nl}, chr(92), '.', {nl}) else '' end, 'SELECT ''', p_name, ' CREATE TABLE s (q int);'';', {nl}, case when p_partkey % 7 = 0 then 'CREATE TABLE open (k int' else '' end)"""
    g = Given(spark, sf_dir)
    return ddl_columns(g.spark.sql(f"select p_partkey as part, {text} as value from {g.d.t('part')}"), key="part")


DECLARED = """select p_partkey as part, case when c in ('report_id', 'price') then 'u' else concat('t', p_partkey) end as dump_table, c as "column", c in ('accession_no', 'patient_id', 'report_id') as is_link, p_partkey % 7 = 0 as limited
from (select p_partkey, unnest(['id', 'note', case p_partkey % 3 when 0 then 'accession_no' when 1 then 'odd, name' else 'patient_id' end, 'report_id', 'price']) as c from part) x"""


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements, rows, faults, populated fields and terms of dump lines, two rows a line."""
    blank = ", ".join(["NULL"] * 4)
    told = "case o_orderkey % 4 when 0 then '''IMPRESSION: a Findings: b''' when 1 then '''mri lumbar spine''' when 2 then '''''' else 'NULL' end"
    rest = "repeat(', NULL', 22)"
    g, key = Given(spark, sf_dir), "cast(o_orderkey as string)"
    return probe.probe(insert_rows(g.spark.sql(f"""select concat('INSERT INTO labdataex VALUES (', {key}, ', {blank}, ', {told}, {rest}, '),(', {key}, ', {blank}, ''x''', {rest}, ');') as value from {g.d.t('orders')}
      union all select concat('INSERT INTO `HL7LabNotes` VALUES (', {key}, ', ''findings: ', o_orderstatus, ''', 3, 4, 5, 6, 7', case when o_orderkey % 5 = 0 then '' else ', 8' end, ')', case when o_orderkey % 11 = 0 then '' else ';' end) from {g.d.t('orders')}
      union all select concat('INSERT INTO labdata VALUES (', {key}, ', 2, 3, 4, 5, ', case when o_orderkey % 6 = 0 then 'NOW()' else '''r''' end, ', 7, '''', 9, ''MRI LUMBAR SPINE'');') from {g.d.t('orders')}""")))


PROBED = """with o as (select o_orderkey as k from orders), f as (select *, k % 11 <> 0 as ended, k % 5 <> 0 as wide from o),
  m as (select 'labdataex' as "table", '' as field, 'statements' as metric, count(*) as n from o union all select 'labdataex', '', 'rows', 2 * count(*) from o
    union all select 'labdataex', 'candidate_narrative_column_6', 'populated', count(*) + count(*) filter (where k % 4 in (0, 1)) from o union all select 'labdataex', 'candidate_narrative_column_6', 'IMPRESSION:', count(*) from o where k % 4 = 0
    union all select 'labdataex', 'candidate_narrative_column_6', 'FINDINGS:', count(*) from o where k % 4 = 0 union all select 'labdataex', 'candidate_narrative_column_6', 'MRI LUMBAR SPINE', count(*) from o where k % 4 = 1
    union all select 'hl7labnotes', '', 'statements', count(*) from f union all select 'hl7labnotes', '', 'unsupported', count(*) from f where not ended union all select 'hl7labnotes', '', 'width_mismatch', count(*) from f where ended and not wide
    union all select 'hl7labnotes', '', 'rows', count(*) from f where ended and wide union all select 'hl7labnotes', 'notes', 'populated', count(*) from f where ended and wide union all select 'hl7labnotes', 'notes', 'FINDINGS:', count(*) from f where ended and wide
    union all select 'labdata', '', 'statements', count(*) from o union all select 'labdata', '', 'parse_error', count(*) from o where k % 6 = 0 union all select 'labdata', '', 'rows', count(*) from o where k % 6 <> 0
    union all select 'labdata', x, m, count(*) from o cross join (select unnest(['result', 'Addendum', 'Addendum']) as x, unnest(['populated', 'populated', 'MRI LUMBAR SPINE']) as m) c where k % 6 <> 0 group by x, m)
select "table", field, metric, n from m where n > 0"""
QUERIES = {"S10_declared": declared, "A21_dump_probe": probed}
ORACLES = {"S10_declared": oracle(DECLARED), "A21_dump_probe": oracle(PROBED)}
