"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are column expressions. Shallow trees are grown on labelled rows by Spark; every path from a root is a rule,
a conjunction of bounds. A logistic model with lasso penalty weighs the rules, most of them with zero, and what is left
compiles to one column expression that scores any table without Python.

Defined results: a null text counts as empty and gets a score like any other; labels that are null, or of documents
that don't exist, teach nothing; several labels of a document teach one each; with no labels every score is 0.5, with
one class alone all scores are its smoothed share; an empty table gives an empty result; other columns are never inputs.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Trees, their depth, the lasso penalty and the seed of the trees' samples.
TREES, DEPTH, PENALTY, SEED = 12, 3, 1e-3, 7


def _count(pattern: str) -> Column:
    return F.regexp_count("_t", F.lit(pattern)).cast("double")


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, list[str]]:
    """``keep`` and the statistics of each whole text; the statistics' names."""
    base = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_t"))
    base = base.withColumn("_w", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    base = base.select(*keep, "_t", F.size("_w").cast("double").alias("_n"), F.size(F.array_distinct("_w")).cast("double").alias("_d"), F.length("_t").cast("double").alias("_c"))
    per_char = {
        "upper": r"\p{Lu}",
        "digit": r"\p{Nd}",
        "symbol": r"[^\p{L}\p{M}\p{N}\s.,;:!?'()\"-]",
        "stop": r"[.;:?]",
        "bang": "!",
        "space": r"\s",
    }
    chars, words = F.greatest("_c", F.lit(1.0)), F.greatest("_n", F.lit(1.0))
    raw = base.select(*keep, "_n", "_d", "_c", *[_count(p).alias(f"_{k}") for k, p in per_char.items()])
    names = {
        **{f"{k}_share": F.col(f"_{k}") / chars for k in per_char},
        "symbols_a_word": F.col("_symbol") / words,
        "bangs_a_word": F.col("_bang") / words,
        "word_length": (F.col("_c") - F.col("_space")) / words,
        "distinct_share": F.col("_d") / words,
        "words_log": F.log1p("_n"),
        "distinct_root": F.col("_d") / F.sqrt(words),
    }
    return raw.select(*keep, *[c.alias(k) for k, c in names.items()]), list(names)


def paths(debug: str, names: list[str]) -> list[tuple]:
    """The distinct conjunctions of (statistic, is at most, bound) on all paths from the roots, in order of appearance."""
    found: dict[tuple, None] = {}
    stack: list[tuple[int, tuple]] = []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (names[int(m[2])], m[3] == "<=", float(m[4]))))
        bounds: dict[tuple, float] = {}
        for name, most, bound in (x for _, x in stack):
            k = (name, most)
            bounds[k] = bound if k not in bounds else (min if most else max)(bounds[k], bound)
        found[tuple((n, most, b) for (n, most), b in sorted(bounds.items()))] = None
    return list(found)


def compiled(rule: tuple) -> Column:
    """A rule as a column: 1.0 where all its bounds hold."""
    held = F.lit(True)
    for name, most, bound in rule:
        held = held & ((F.col(name) <= bound) if most else (F.col(name) > bound))
    return held.cast("double")


def fit(train: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = SEED) -> Column:
    """The score column learned from ``train``: the statistics and label, 0 or 1."""
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return F.lit((counts.get(1, 0) + (1 if counts else 0.5)) / (sum(counts.values()) + (2 if counts else 1.0)))
    # weights make both classes count the same while trees grow, so that rules for the rare class are found
    total = sum(counts.values())
    weighed = train.withColumn("weight", F.when(F.col("label") == 1, total / (2.0 * counts[1])).otherwise(total / (2.0 * counts[0])))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=seed, featureSubsetStrategy="onethird")
    model = forest.fit(weighed.withColumn("x", array_to_vector(F.array(*names))))
    rules = paths(model.toDebugString, names)
    if not rules:
        return F.lit((counts[1] + 1) / (total + 2))
    design = cut(train.select("label", array_to_vector(F.array(*map(compiled, rules))).alias("x")), "rules")
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=100)
    weights = lasso.fit(design)
    margin = F.lit(float(weights.intercept))
    for rule, w in zip(rules, weights.coefficients.toArray().tolist(), strict=True):
        if w:
            margin = margin + F.lit(w) * compiled(rule)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``, learned from its labelled rows that aren't held out."""
    stats, names = statistics(docs)
    stats = cut(stats, "statistics")
    marks = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("label"))
    train = cut(stats.join(marks, F.col("doc_id") == F.col("_id")).select("label", *names), "train")
    score = fit(train, names)
    out = stats.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
