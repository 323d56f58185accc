"""Named policies, requirements by risk, and compliance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

POLICY_SCHEMA = (
    "policy string, display_name string, level string, epsilon double, delta double, k_anonymity int, "
    "transform_quasi_identifiers boolean, add_noise_to_numeric boolean, generalize_categorical boolean, "
    "preserve_statistics boolean, enable_t_closeness boolean, enable_l_diversity boolean, "
    "utility_weight double, description string"
)


@dataclass(frozen=True)
class Policy:
    """The settings of a policy that steer a run."""

    name: str
    level: str
    epsilon: float
    k: int
    t_closeness: bool = False
    l_diversity: bool = False


def policy_named(name: str) -> Policy:
    """A named policy; unknown names mean the standard one."""
    by_name = {row[0]: row for row in K.POLICIES}
    row = by_name.get(name.lower(), by_name["standard"])
    return Policy(row[0], row[2], row[3], row[5], row[10], row[11])


def custom_policy(epsilon: float, k: int) -> Policy:
    """A policy with its own epsilon and k; the level follows from epsilon."""
    level = next((name for at_least, name in K.CUSTOM_LEVELS if epsilon >= at_least), K.CUSTOM_TOP_LEVEL)
    return Policy("custom", level, epsilon, k)


def custom_level(epsilon: Column) -> Column:
    """The protection level of a custom policy's epsilon."""
    level = None
    for at_least, name in K.CUSTOM_LEVELS:
        level = F.when(epsilon >= at_least, name) if level is None else level.when(epsilon >= at_least, name)
    return level.otherwise(K.CUSTOM_TOP_LEVEL)


def custom_policies(requests: DataFrame, epsilon: str = "epsilon", k: str = "k_anonymity") -> DataFrame:
    """Requested (epsilon, k) pairs as policies: level, its number and description."""
    level = custom_level(F.col(epsilon))
    levels = F.create_map(*[F.lit(x) for pair in K.LEVELS.items() for x in pair])
    text = F.format_string("Custom policy (ε=%s, k=%s)", F.col(epsilon).cast("string"), F.col(k).cast("string"))
    return requests.withColumns(
        {"level": level, "level_value": F.element_at(levels, level), "delta": F.lit(K.DELTA), "description": text}
    )


def policies_table(spark: SparkSession, custom: list[Policy] = ()) -> DataFrame:
    """All named policies, with the numeric level, plus custom ones."""
    rows = list(K.POLICIES)
    for p in custom:
        rows.append((p.name, "Custom Policy", p.level, p.epsilon, K.DELTA, p.k, True, True, True,
                     True, p.t_closeness, p.l_diversity, 0.5, f"Custom policy (ε={p.epsilon}, k={p.k})"))
    levels = F.create_map(*[F.lit(x) for pair in K.LEVELS.items() for x in pair])
    return spark.createDataFrame(rows, POLICY_SCHEMA).withColumn("level_value", F.element_at(levels, F.col("level")))


def _band(row: tuple):
    names = ["from_score", "min_epsilon", "max_epsilon", "min_k", "force_strict", "allow_utility_loss", "band"]
    return F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row)])


def resolve_policies(requests: DataFrame, name: str = "policy") -> DataFrame:
    """Requested policy names joined to their settings, unknown ones to standard."""
    table = policies_table(requests.sparkSession)
    known = [row[0] for row in K.POLICIES]
    lowered = F.lower(F.col(name))
    resolved = requests.withColumn(name, F.when(lowered.isin(*known), lowered).otherwise("standard"))
    return resolved.join(F.broadcast(table), resolved[name] == table["policy"], "inner").drop(table["policy"])


def compliance(scores: DataFrame, policies: DataFrame | None = None, score: str = "risk_score") -> DataFrame:
    """Check every scored group against every policy; issues as a text list.

    The band of a score is computed, not searched for, so the scored side
    meets the policies, each listed once per band, in one broadcast equi-join.
    """
    policies = policies if policies is not None else policies_table(scores.sparkSession)
    listed = policies.select("*", F.inline(F.array(*[_band(row) for row in K.RISK_BANDS])))
    band = None
    for start, *_ in K.RISK_BANDS:
        hit = F.col(score) >= start
        band = F.when(hit, start) if band is None else band.when(hit, start)
    # an unknown score meets every policy too, without a band to hold it to
    plain = policies.select("*", F.lit(None).cast("int").alias("from_score"))
    listed = listed.unionByName(plain, allowMissingColumns=True)
    joined = scores.withColumn("_band", band).join(F.broadcast(listed), F.col("_band").eqNullSafe(F.col("from_score")))
    joined = joined.drop("_band")
    issues = F.array_compact(
        F.array(
            F.when(
                F.col("epsilon") > F.col("max_epsilon"),
                F.format_string("Epsilon too high (%s > %s) for risk level",
                                F.col("epsilon").cast("string"), F.col("max_epsilon").cast("string")),
            ),
            F.when(
                F.col("k_anonymity") < F.col("min_k"),
                F.format_string("k-anonymity too low (%s < %s)",
                                F.col("k_anonymity").cast("string"), F.col("min_k").cast("string")),
            ),
            F.when(
                F.col("force_strict") & (F.col("level_value") < K.LEVELS["STRICT"]),
                F.lit("Strict mode required for this risk level"),
            ),
        )
    )
    known = F.col(score).isNotNull()
    issues = F.when(known, issues)
    return joined.withColumn("issues", issues).withColumn("is_compliant", F.when(known, F.size("issues") == 0))


def column_rule_check(classified: DataFrame) -> DataFrame:
    """Whether the mechanism used on a column is among the methods its kind allows.

    Takes (column, mechanism); a column's kind is the first rule name its name contains.
    ``limits`` holds what else the rule demands of the treatment.
    """
    rule = None
    for name, allowed, protection in K.COLUMN_RULES:
        hit = F.lower("column").contains(name)
        limits = [F.lit(x) for pair in K.COLUMN_RULE_LIMITS.get(name, {}).items() for x in pair]
        listed = F.struct(
            F.lit(name).alias("rule"),
            F.array(*[F.lit(m) for m in allowed]).alias("allowed_methods"),
            F.lit(True).alias("must_transform"),
            F.lit(protection).alias("min_protection"),
            (F.create_map(*limits) if limits else F.create_map().cast("map<string,string>")).alias("limits"),
        )
        rule = F.when(hit, listed) if rule is None else rule.when(hit, listed)
    ruled = classified.withColumn("_rule", rule).select("*", "_rule.*").drop("_rule")
    return ruled.withColumn("method_allowed", F.array_contains("allowed_methods", F.col("mechanism")))
