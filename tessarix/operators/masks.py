"""Pixel masks as documents: parsed, validated, bound to instances, checked against their bounds and frames.

A document is JSON: a list of rectangles for the whole exam, or {"version": 2, "masks": [...]} with masks of exam, series
or image scope. Instances: study_uid, series_uid, sop_uid, rows, columns, samples, frames, burned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits, and the fields that a mask of each scope has, no more and no fewer.
MOST_MASKS, LONGEST_UID = 100, 64
FIELDS = {"exam": ("rect", "scope"), "series": ("rect", "scope", "series_uid"), "image": ("frame", "rect", "scope", "series_uid", "sop_uid")}
_UID = r"^[0-9]+([.][0-9]+)*$"


def parsed(documents: DataFrame, column: str = "document") -> DataFrame:
    """Every document as array ``masks`` (scope, series_uid, sop_uid, frame, x, y, w, h), and ``reason`` where it is invalid.

    Fields are read as variants, so numbers that are no integers and texts in their place are seen as such.
    """
    v = F.try_parse_json(F.col(column))
    kind = lambda x: F.schema_of_variant(x)
    made = documents.withColumn("_v", v)
    version = (F.try_variant_get("_v", "$.version", "int") == 2) & kind(F.variant_get("_v", "$.version", "variant")).isin("BIGINT")
    plain = F.try_variant_get("_v", "$", "array<variant>")
    second = F.when(version & (F.array_sort(F.map_keys(F.try_variant_get("_v", "$", "map<string,variant>"))) == F.array(F.lit("masks"), F.lit("version"))), F.try_variant_get("_v", "$.masks", "array<variant>"))
    made = made.withColumn("_old", plain.isNotNull()).withColumn("_all", F.coalesce(plain, second))
    item = lambda m, path, t: F.try_variant_get(m, path, t)
    whole = lambda m, path: F.when(F.schema_of_variant(F.try_variant_get(m, path, "variant")) == "BIGINT", item(m, path, "bigint"))
    text = lambda m, path: F.when(F.schema_of_variant(F.try_variant_get(m, path, "variant")) == "STRING", item(m, path, "string"))

    def one(m, rect, scope, keys):
        sides = [whole(rect, f"$[{i}]") for i in range(4)]
        return F.struct(
            scope.alias("scope"), text(m, "$.series_uid").alias("series_uid"), text(m, "$.sop_uid").alias("sop_uid"), whole(m, "$.frame").alias("frame"),
            *[s.alias(n) for s, n in zip(sides, "xywh", strict=True)], F.size(item(rect, "$", "array<variant>")).alias("sides"), keys.alias("keys"),
        )

    none = F.lit(None).cast("array<string>")
    masks = F.when(F.col("_old"), F.transform("_all", lambda m: one(m, m, F.lit("exam"), F.array(F.lit("rect"), F.lit("scope"))))).otherwise(
        F.transform("_all", lambda m: one(m, F.try_variant_get(m, "$.rect", "variant"), text(m, "$.scope"), F.coalesce(F.array_sort(F.map_keys(item(m, "$", "map<string,variant>"))), none)))
    )
    made = made.withColumn("masks", masks)
    right = lambda m: F.coalesce(sum((F.when((m["scope"] == s) & (m["keys"] == F.array(*map(F.lit, f))), 1).otherwise(0) for s, f in FIELDS.items()), F.lit(0)) == 1, F.lit(False))
    uid = lambda x: F.coalesce(x.rlike(_UID) & (F.length(x) <= LONGEST_UID), F.lit(False))
    targets = lambda m: (m["scope"] == "exam") | (uid(m["series_uid"]) & ((m["scope"] == "series") | uid(m["sop_uid"])))
    box = lambda m: F.coalesce((m["sides"] == 4) & (m["x"] >= 0) & (m["y"] >= 0) & (m["w"] > 0) & (m["h"] > 0), F.lit(False))
    reason = (
        F.when(F.col("_all").isNull(), "format")
        .when(F.size("_all") > MOST_MASKS, "number of masks")
        .when(F.exists("masks", lambda m: ~right(m)), "scope or fields")
        .when(F.exists("masks", lambda m: ~targets(m)), "target")
        .when(F.exists("masks", lambda m: (m["scope"] == "image") & ~F.coalesce(m["frame"] >= 0, F.lit(False))), "frame")
        .when(F.exists("masks", lambda m: ~box(m)), "rectangle")
        .otherwise("")
    )
    made = made.withColumn("reason", reason)
    shown = F.when(F.col("reason") == "", F.transform("masks", lambda m: m.dropFields("sides", "keys")))
    return made.withColumn("masks", shown).drop("_v", "_old", "_all")


def bound(masks: DataFrame, instances: DataFrame) -> DataFrame:
    """Each mask (study_uid and the fields of ``parsed``) with each instance that it applies to.

    One equi-join: each mask has one key by its scope, each instance the three keys that it answers to.
    """
    exam, series, image = (F.concat_ws("|", F.lit(s), *c) for s, c in (("exam", ["study_uid"]), ("series", ["study_uid", "series_uid"]), ("image", ["study_uid", "series_uid", "sop_uid"])))
    key = F.when(F.col("scope") == "exam", exam).when(F.col("scope") == "series", series).otherwise(image)
    m = masks.select(key.alias("m_key"), "scope", "frame", "x", "y", "w", "h")
    i = instances.select("*", F.explode(F.array(exam, series, image)).alias("i_key"))
    return i.join(m, F.col("i_key") == F.col("m_key")).drop("i_key", "m_key")


def _fault(m, samples, columns, rows, frames):
    fault = F.when(samples != 1, "colour").when((m["x"] + m["w"] > columns) | (m["y"] + m["h"] > rows), "outside the image")
    return fault.when((m["scope"] == "image") & (m["frame"] >= frames), "no such frame").otherwise("")


def violations(pairs: DataFrame) -> DataFrame:
    """bound pairs with ``fault``: colour, outside the image, no such frame, or ''."""
    mask = {n: F.col(n) for n in ("scope", "frame", "x", "y", "w", "h")}
    return pairs.withColumn("fault", _fault(mask, *map(F.col, ("samples", "columns", "rows", "frames"))))


def targets(masks: DataFrame, instances: DataFrame) -> DataFrame:
    """sop_uid, n_masks, faults, first_fault, covered, quarantined: a row for each row of ``instances``.

    What ``bound``, ``violations``, ``covered`` and ``quarantined`` tell of it, without pairs: a study's masks are one row, which its
    instances take where they lie. Copies of an instance are told each by itself, so none counts the masks of another one.
    """
    own = masks.groupBy("study_uid").agg(F.collect_list(F.struct("scope", "series_uid", "sop_uid", "frame", "x", "y", "w", "h")).alias("_masks"))
    same = lambda m, *names: reduce(lambda a, b: a & b, [m[n] == F.col(n) for n in names])
    applies = lambda m: F.coalesce(F.when(m["scope"] == "exam", True).when(m["scope"] == "series", same(m, "series_uid")).otherwise(same(m, "series_uid", "sop_uid")), F.lit(False))
    fault = lambda m: _fault(m, *map(F.col, ("samples", "columns", "rows", "frames")))
    met = F.transform(F.filter("_masks", applies), lambda m: F.struct((m["scope"] != "image").alias("wide"), m["frame"].alias("frame"), fault(m).alias("fault")))
    each = instances.join(own, "study_uid", "left").select("sop_uid", "burned", "frames", F.coalesce(met, F.array()).alias("_met"))
    faults = F.filter("_met.fault", lambda f: f != "")
    seen = F.array_distinct(F.filter(F.transform("_met", lambda m: F.when(~m["wide"], m["frame"])), lambda f: f.isNotNull()))
    frames = (F.size(seen) > 0) & (F.size(seen) == F.col("frames")) & (F.array_max(seen) < F.col("frames"))
    told = each.select("sop_uid", "burned", F.size("_met").cast("bigint").alias("n_masks"), F.size(faults).cast("bigint").alias("faults"), F.array_min(faults).alias("first_fault"), F.coalesce(F.exists("_met", lambda m: m["wide"]) | frames, F.lit(False)).alias("covered"))
    return told.withColumn("quarantined", F.coalesce(F.upper("burned") == "YES", F.lit(False)) & ~F.col("covered")).drop("burned")


def covered(pairs: DataFrame) -> DataFrame:
    """sop_uid of instances with a mask for the exam or series, or one for each of their frames and no other."""
    per = pairs.groupBy("sop_uid").agg(
        F.max(F.col("scope") != "image").alias("wide"), F.count_distinct(F.when(F.col("scope") == "image", F.col("frame"))).alias("seen"),
        F.max(F.when(F.col("scope") == "image", F.col("frame"))).alias("last"), F.max("frames").alias("frames"),
    )
    return per.where("wide or (seen = frames and last < frames)").select("sop_uid")


def quarantined(instances: DataFrame, covers: DataFrame) -> DataFrame:
    """instances with burned-in annotation that no mask covers whole."""
    c = covers.select(F.col("sop_uid").alias("c_sop")).distinct()
    return instances.where(F.upper("burned") == "YES").join(c, F.col("sop_uid") == F.col("c_sop"), "left_anti")
