"""All queries by name, with the SQL that checks them.

A query is a builder of SQL over fragments; Spark plans and runs one rendering of it, the check runs the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Duck, Spark
from ..operators import dump, linkage, release, studies
from ..sources.dumps import insert_rows
from ..sources.reports import formatted
from ..sources.shared import written
from . import dumped, given, linked, nested, packaged, streamed
from .fixtures import TABLES

BUILDERS = {**studies.QUERIES, **linkage.QUERIES, **dump.QUERIES, **release.QUERIES}


def whole(sql: str) -> str:
    """``sql`` with every sum as a 64-bit integer, in both engines: all that is summed here counts something."""
    out, i = [], 0
    while (j := sql.find("sum(", i)) >= 0:
        if j and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i : j + 4])
            i = j + 4
            continue
        end = _closed(sql, j + 3)
        if sql[end:].startswith(" over ("):
            end = _closed(sql, end + 6)
        out.append(f"{sql[i:j]}cast(sum({whole(sql[j + 4 : end])} as bigint)")
        i = end
    return "".join(out) + sql[i:]


def _closed(sql: str, opened: int) -> int:
    """Behind the parenthesis that closes the one at ``opened``."""
    depth = 0
    for i in range(opened, len(sql)):
        depth += (sql[i] == "(") - (sql[i] == ")")
        if not depth:
            return i + 1
    raise ValueError("a parenthesis is open")


class Writing(Spark):
    """Fragments for a session: what is to be computed once is written, and read as a table."""

    def __init__(self, spark: SparkSession, tables):
        super().__init__(tables)
        self.spark = spark

    def once(self, head, query, name):
        return f"select * from parquet.`{written(self.spark.sql(whole(f'with {head} {query}')), name).path}`"


def over(spark: SparkSession, sf_dir: str) -> Spark:
    """Spark's fragments over the tables of ``sf_dir``, read in place; nothing is registered in the session."""
    return Writing(spark, {name: f"parquet.`{sf_dir}/{name}.parquet`" for name in TABLES})


def run(builder):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(whole(builder(over(spark, sf_dir))))

    query.__doc__ = builder.__doc__
    return query


def dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT lines written from the orders, parsed back; lines with calls are errors."""
    d = over(spark, sf_dir)
    value = "case when o_orderkey % 89 = 0 then concat('INSERT INTO labdata VALUES (', cast(o_orderkey as string), ', NOW());') else concat('INSERT INTO `labdata` VALUES (', cast(o_orderkey as string), ', ''it\\\\''s (', o_orderstatus, '), ok'', NULL, -1.5),(', cast(o_custkey as string), ', ''x'', NULL, 2);') end"
    lines = spark.sql(f"select {value} as value from {d.t('orders')}")
    rows = insert_rows(lines)
    return rows.groupBy("table", "error").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col("row")[0].cast("long")), F.lit(0)).alias("sum_first"), F.min(F.col("row")[1]).alias("least_second"), F.count(F.col("row")[2]).alias("nulls_not"), F.max(F.size("row")).cast("long").alias("width"))


DUMP_SQL = """with t as (select o_orderkey as a, concat('it''s (', o_orderstatus, '), ok') as b from orders where o_orderkey % 89 <> 0 union all select o_custkey, 'x' from orders where o_orderkey % 89 <> 0)
select 'labdata' as "table", '' as error, count(*) as n_rows, cast(sum(a) as bigint) as sum_first, min(b) as least_second, cast(0 as bigint) as nulls_not, cast(4 as bigint) as width from t
union all select 'labdata', 'unsupported value', count(*), 0, null, 0, null from orders where o_orderkey % 89 = 0 having count(*) > 0"""


def xml_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped as XML notes, some of them broken, formatted to text."""
    d = over(spark, sf_dir)
    wrapped = "case when doc_id % 31 = 0 then '<labResult><notes>broken' when doc_id % 3 = 0 then concat('<labResult><notes>line ', cast(doc_id as string), '</notes></labResult>') else concat('doc ', coalesce(text, '')) end"
    return formatted(spark.sql(f"select doc_id as report, {wrapped} as text from {d.t('documents')}")).select("report", "status", F.sha2("text", 256).alias("text_sha256"))


XML_SQL = """select doc_id as report, case when doc_id % 31 = 0 then 'unparsed' when doc_id % 3 = 0 then 'xml' else 'plain' end as status,
sha256(case when doc_id % 31 = 0 then '<labResult><notes>broken' when doc_id % 3 = 0 then concat('line ', cast(doc_id as varchar)) else concat('doc ', coalesce(text, '')) end) as text_sha256 from documents"""

QUERIES = {name: run(b) for name, b in BUILDERS.items()} | {"S9_dump_rows": dump_rows, "F43_xml_reports": xml_reports} | {name: q for name, (q, _) in given.QUERIES.items()} | linked.QUERIES | nested.QUERIES | streamed.QUERIES | dumped.QUERIES | packaged.QUERIES
ORACLES = {name: whole(b(Duck())) for name, b in {**BUILDERS, **linked.PRODUCTS}.items()} | {"S9_dump_rows": DUMP_SQL, "F43_xml_reports": XML_SQL} | {name: given.oracle(sql) for name, (_, sql) in given.QUERIES.items()} | linked.ORACLES | nested.ORACLES | streamed.ORACLES | dumped.ORACLES | packaged.ORACLES
