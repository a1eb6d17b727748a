"""Phrases in reports by postings (token, report, field, position): each text is cut into tokens once, however many phrases are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Runs of letters and digits are tokens, whatever their case.
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(reports: DataFrame, fields: tuple[str, ...] = ("text", "path")) -> DataFrame:
    """report, field, position, token of every token; a null field has none, and no phrase goes from one field to the next."""
    every = F.array(*[F.struct(F.lit(i).alias("field"), tokens(F.col(c)).alias("tokens")) for i, c in enumerate(fields)])
    each = reports.select("report", F.explode(every).alias("f"))
    return each.select("report", F.col("f.field").alias("field"), F.posexplode("f.tokens").alias("position", "token"))


def hits(posted: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, report: the reports that hold a phrase's tokens in a row; phrases: phrase (text). One without tokens has none.

    A phrase is looked up by its rarest token; each further token is a join on (token, report, field, position), so the
    postings of its frequent words meet only reports that hold the rare one. Rounds are as many as the longest phrase has tokens.
    """
    asked = written(phrases.select("phrase").distinct().select("phrase", tokens(F.col("phrase")).alias("tokens")), "phrases").where(F.size("tokens") > 0)
    each = asked.select("phrase", F.size("tokens").alias("n"), F.posexplode("tokens").alias("offset", "token"))
    own = written(posted.join(each.select("token").distinct(), "token", "left_semi"), "asked")  # each round reads it, texts are cut once
    counted = own.groupBy("token").agg(F.count("*").alias("df"))
    of_phrase = Window.partitionBy("phrase")
    ordered = each.join(counted, "token").withColumn("at", F.row_number().over(of_phrase.orderBy("df", "offset"))).withColumn("known", F.count("*").over(of_phrase)).where("known = n")
    longest = asked.agg(F.max(F.size("tokens"))).first()[0] or 1
    found = ordered.where("at = 1").join(own, "token").select("phrase", "n", "report", "field", (F.col("position") - F.col("offset")).alias("start")).where("start >= 0")
    for k in range(2, longest + 1):
        further = ordered.where(F.col("at") == k).select("phrase", "token", "offset")
        here = found.where(F.col("n") >= k).join(further, "phrase").withColumn("position", F.col("start") + F.col("offset"))
        here = here.join(own.select("token", "report", "field", "position"), ["token", "report", "field", "position"], "left_semi")
        found = found.where(F.col("n") < k).unionByName(here.select("phrase", "n", "report", "field", "start"))
    return found.select("phrase", "report").distinct()
