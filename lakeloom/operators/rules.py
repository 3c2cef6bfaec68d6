"""Data-quality rules as data: one projection evaluates a suite, rows carry what they failed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKS = ("not_null", "regex", "in_set", "castable", "compare", "compare_cols", "not_future", "fk", "expr")
COMPARE = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__}


@dataclass(frozen=True)
class Rule:
    """One check. ``severity`` is ``reject`` (the row is invalid) or ``warn`` (it stays, and says so)."""

    id: str
    check: str
    severity: str = "reject"
    column: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.check not in CHECKS:
            raise ValueError(f"{self.id}: unknown check {self.check!r}")
        if self.severity not in ("reject", "warn"):
            raise ValueError(f"{self.id}: unknown severity {self.severity!r}")


@dataclass(frozen=True)
class Suite:
    dataset: str
    rules: Sequence[Rule]
    max_reject_rate: float = 0.05


class RejectRateExceeded(RuntimeError):
    """More rows were rejected than the suite allows."""


def _fails(rule: Rule, seen: int) -> Column:
    """True where the rule fails; never null. Null values pass everything but ``not_null``."""
    p, c = rule.params, F.col(rule.column) if rule.column else None
    match rule.check:
        case "not_null":
            return c.isNull()
        case "regex":
            bad = ~c.rlike(p["pattern"])
        case "in_set":
            bad = ~c.isin(*p["values"])
        case "castable":
            bad = c.isNotNull() & F.col(p["typed"]).isNull()
        case "compare":
            bad = ~COMPARE[p["op"]](c, F.lit(p["value"]))
        case "compare_cols":
            bad = ~COMPARE[p["op"]](F.col(p["left"]), F.col(p["right"]))
        case "not_future":
            bad = c > F.col(p.get("reference", "_ingested_at"))
        case "fk":
            bad = c.isNotNull() & F.col(f"_known{seen}").isNull()
        case "expr":
            bad = ~F.expr(p["expression"])
    return F.coalesce(bad, F.lit(False))


def evaluate(df: DataFrame, suite: Suite, refs: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``df`` with ``rule_ids`` (failed, severity reject), ``errors`` (their messages) and ``quality_warnings`` (failed, severity warn).

    Foreign keys are left joins with the distinct keys of the reference; Spark broadcasts them where they turn out to be
    small. Everything else is one projection.
    """
    refs = refs or {}
    flagged = df
    for i, r in enumerate(suite.rules):
        if r.check == "fk":
            if r.params["ref"] not in refs:
                raise KeyError(f"{r.id}: no reference {r.params['ref']!r}")
            keys = refs[r.params["ref"]].select(F.col(r.params["ref_column"]).alias(f"_key{i}")).where(F.col(f"_key{i}").isNotNull()).distinct().withColumn(f"_known{i}", F.lit(1))
            flagged = flagged.join(keys, flagged[r.column] == keys[f"_key{i}"], "left").drop(f"_key{i}")
    names = [f"_fail{i}" for i in range(len(suite.rules))]
    flagged = flagged.select("*", *[_fails(r, i).alias(n) for i, (r, n) in enumerate(zip(suite.rules, names, strict=True))])

    def listed(severity: str, text) -> Column:
        hits = [F.when(F.col(n), F.lit(text(r))) for r, n in zip(suite.rules, names, strict=True) if r.severity == severity]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")

    message = lambda r: f"{r.column or r.params.get('expression') or r.params.get('left')}: {r.check} failed"
    out = flagged.withColumn("rule_ids", listed("reject", lambda r: r.id)).withColumn("errors", listed("reject",
        message)).withColumn("quality_warnings", listed("warn", lambda r: r.id))
    return out.drop(*names, *[f"_known{i}" for i in range(len(suite.rules))])


def valid(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(F.size("rule_ids") == 0).drop("rule_ids", "errors")


def rejected(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(F.size("rule_ids") > 0)


def statistics(evaluated: DataFrame, suite: Suite) -> DataFrame:
    """``rule_id``, ``severity``, ``failed`` and ``total`` for every rule, also those that never fail; one aggregation."""
    every = F.concat("rule_ids", "quality_warnings")
    sums = evaluated.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.array_contains(every, r.id)).alias(f"n{i}") for i, r in enumerate(suite.rules)])
    each = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.col(f"n{i}").alias("failed")) for i, r in enumerate(suite.rules)])
    return sums.select("total", F.explode(each).alias("r")).select("r.rule_id", "r.severity", "r.failed", "total")


def reject_rate(evaluated: DataFrame, suite: Suite) -> DataFrame:
    """One row: ``total``, ``rejected``, ``rate`` and whether the breaker trips (strictly above the suite's limit)."""
    sums = evaluated.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("rule_ids") > 0).alias("rejected"))
    rate = F.when(F.col("total") > 0, F.col("rejected") / F.col("total")).otherwise(0.0)
    return sums.withColumn("rate", rate).withColumn("tripped", F.col("rate") > suite.max_reject_rate)


def enforce(evaluated: DataFrame, suite: Suite) -> None:
    """Raise if the breaker trips. Write the quarantine before, so that the evidence stays."""
    r = reject_rate(evaluated, suite).head()
    if r["tripped"]:
        raise RejectRateExceeded(f"{suite.dataset}: {r['rejected']} of {r['total']} rows rejected, limit {suite.max_reject_rate}")


def rule_passes(stats: DataFrame, suite: Suite) -> DataFrame:
    """``stats`` with ``passed``: a rule passes while its failures stay within the suite's rate."""
    return stats.withColumn("passed", F.col("failed") <= F.col("total") * suite.max_reject_rate)


# ---- quarantine


def quarantine_records(evaluated: DataFrame, record_columns: Sequence[str], dataset: str, source: str, batch_id: str, stage: str, run_id: str) -> DataFrame:
    """One JSON record per rejected row: the raw columns as delivered, what they failed, and where they come from."""
    return rejected(evaluated).select(
        F.to_json(F.struct(*record_columns)).alias("record"), F.lit(dataset).alias("dataset"), F.lit(source).alias("source"), F.lit(batch_id).alias("batch_id"),
        F.lit(stage).alias("stage"), "rule_ids", "errors", F.current_timestamp().alias("detected_at"), F.lit(run_id).alias("run_id"),
    )


def write_quarantine(records: DataFrame, path: str) -> None:
    """Write records, where they are, by dataset, batch and stage. A rerun of a batch replaces its records, so that none counts twice."""
    records.write.mode("overwrite").option("compression", "gzip").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "batch_id", "stage").json(path)


QUARANTINE = "record string, source string, rule_ids array<string>, errors array<string>, detected_at timestamp, run_id string, dataset string, batch_id string, stage string"


def read_quarantine(spark: SparkSession, path: str, dataset: str, batch_id: str | None = None) -> DataFrame:
    """Records of a dataset, or of one batch of it; partitions are pruned."""
    out = spark.read.schema(QUARANTINE).json(path).where(F.col("dataset") == dataset)
    return out if batch_id is None else out.where(F.col("batch_id") == batch_id)


def quarantine_counts(records: DataFrame) -> DataFrame:
    """Records by rule; those without a rule are parse errors."""
    ids = F.when(F.size("rule_ids") > 0, F.col("rule_ids")).otherwise(F.array(F.lit("parse")))
    return records.select(F.explode(ids).alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("records"))


# ---- checks of tables


def check_unique(df: DataFrame, table: str, *keys: str) -> DataFrame:
    """Rows too many for their key; rows with a null key fail."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.agg(F.lit(f"unique_{table}").alias("check_name"), F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - F.countDistinct(F.when(whole,
        F.struct(*keys)))).alias("failed"))


def check_reference(df: DataFrame, name: str, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Keys that aren't null and have no parent."""
    keys = parent.select(F.col(parent_key).alias("_p")).distinct()
    probed = df.join(keys, df[key] == keys["_p"], "left")
    return probed.agg(F.lit(f"reference_{name}").alias("check_name"), F.count(F.lit(1)).alias("total"), F.count_if(F.col(key).isNotNull() & F.col("_p").isNull()).alias("failed"))


def check_predicates(df: DataFrame, predicates: Mapping[str, str]) -> DataFrame:
    """Rows that fail each SQL predicate (null doesn't count), all in one pass."""
    sums = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(~F.expr(e)).alias(n) for n, e in predicates.items()])
    each = F.array(*[F.struct(F.lit(f"range_{n}").alias("check_name"), F.col(n).alias("failed")) for n in predicates])
    return sums.select(F.explode(each).alias("c"), "total").select("c.check_name", "total", "c.failed")


def check_null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    sums = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    each = F.array(*[F.struct(F.lit(f"nulls_{c}").alias("check_name"), F.col(c).alias("failed")) for c in columns])
    return sums.select(F.explode(each).alias("c"), "total").select("c.check_name", "total", "c.failed")


def check_freshness(df: DataFrame, name: str, column: str, due: Column) -> DataFrame:
    """Fails if the newest value is older than ``due``, or there is none."""
    newest = df.agg(F.max(column).alias("newest"))
    return newest.select(F.lit(f"fresh_{name}").alias("check_name"), F.lit(1).cast("long").alias("total"), F.coalesce(F.col("newest") < due,
        F.lit(True)).cast("long").alias("failed"))


def summarize(checks: DataFrame, limits: Mapping[str, float], severities: Mapping[str, str]) -> DataFrame:
    """``checks`` with ``failure_rate`` (six places), ``threshold``, ``severity`` and ``passed``."""
    pick = lambda m, default: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("check_name")),
        F.lit(default)) if m else F.lit(default)
    rated = checks.withColumn("failure_rate", F.when(F.col("total") > 0, F.round(F.col("failed") / F.col("total"), 6)).otherwise(0.0))
    rated = rated.withColumn("threshold", pick(limits, 0.0)).withColumn("severity", pick(severities, "error"))
    return rated.withColumn("passed", F.col("failure_rate") <= F.col("threshold"))


def overall_status(summary: DataFrame) -> DataFrame:
    """``fail`` if an error check fails, else ``warn`` if a warning fails, else ``pass``."""
    bad = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s)) > 0
    return summary.agg(F.when(bad("error"), "fail").when(bad("warn"), "warn").otherwise("pass").alias("status"), F.count(F.lit(1)).alias("checks"),
        F.count_if("passed").alias("passed"))
