"""Small fixed dimension tables built from ``vigil.fixed_values``.

Each table has a size fixed by the literal lists (≤ a dozen rows), which is
the proven bound that justifies broadcasting it in joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil import fixed_values as FV


def intervention_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FV.INTERVENTION_TYPES,
                                 "type string, description string, base_effectiveness double")


def intervention_rules(spark: SparkSession) -> DataFrame:
    """``crime_type, ord, type, actions`` — rule order within a crime type."""
    rows, seen = [], {}
    for crime, kind, actions in FV.INTERVENTION_RULES:
        seen[crime] = seen.get(crime, 0) + 1
        rows.append((crime, seen[crime], kind, actions))
    return spark.createDataFrame(rows, "crime_type string, ord int, type string, actions array<string>")


def rule_crime_types() -> list[str]:
    return sorted({c for c, _, _ in FV.INTERVENTION_RULES if c != "*"})


def risk_factor_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FV.RISK_FACTOR_WEIGHTS, "factor string, weight double")
