"""Whole-table privatization.

Three steps: one profiling job decides the treatment of every column, one
projection applies all per-value treatments at once, and only columns that
need k-anonymity join their own category table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import masks, parse
from ..functions.randomized import numeric_release
from . import anonymize, checks, classify, json_rewrite, policy, risk

METADATA_SCHEMA = (
    "column string, position int, type string, sensitivity string, mechanism string, "
    "guarantee string, treatment string, epsilon decimal(18,9)"
)


@dataclass
class ColumnPlan:
    """Decision for one column."""

    column: str
    position: int
    type: str
    sensitivity: str
    mechanism: str
    treatment: str
    nonzero: bool
    epsilon: Decimal | None = None

    @property
    def guarantee(self) -> str:
        return "DIFFERENTIAL_PRIVACY" if self.type == "numeric" else "NON_DP_ANONYMIZATION"


@dataclass
class PrivacyPlan:
    """Decisions for a table and the settings they follow from."""

    risk_score: int
    epsilon: Decimal
    k: int
    strict: bool
    rows: int
    columns: list[ColumnPlan] = field(default_factory=list)
    l_diversity: bool = True

    def metadata(self, df: DataFrame) -> DataFrame:
        """One row per column of the schema."""
        rows = [
            (c.column, c.position, c.type, c.sensitivity, c.mechanism, c.guarantee, c.treatment, c.epsilon)
            for c in self.columns
        ]
        return df.sparkSession.createDataFrame(rows, METADATA_SCHEMA)


def settings_for_risk(score: int) -> tuple[Decimal, int, bool]:
    """(epsilon, k, strict) by risk score."""
    for at_least, epsilon, k, strict in K.RISK_CONFIG:
        if score >= at_least:
            return Decimal(str(epsilon)), k, strict
    raise ValueError("risk score below zero")


def epsilon_shares(total: Decimal, parts: int) -> list[Decimal]:
    """Equal shares that never exceed the total; exact, so the last share is not lost to rounding."""
    step = Decimal("0.000000001")
    share = (total / max(1, parts)).quantize(step, rounding="ROUND_DOWN")
    return [share] * parts


def guarantee_level(epsilon: Decimal) -> str:
    """Name of the protection level of an epsilon."""
    for bound, name in ((Decimal("0.5"), "Very Strong"), (Decimal(1), "Strong"), (Decimal(2), "Moderate")):
        if epsilon <= bound:
            return name
    return "Basic"


def treatment_of(name: str, kind: str, effective: str, rows: int, small: int = 0) -> str:
    """Treatment of a column by its type and, for quasi-identifiers, its name.

    Tables of fewer than ``small`` rows have their categories generalized instead of
    made k-anonymous.
    """
    if name == "data":
        return "json"
    if effective == "numeric":
        return "numeric"
    if effective == "quasi_identifier":
        for treatment, words in K.QUASI_DISPATCH:
            if parse.has_any(name, words):
                return treatment
        return "k_anonymity"
    if effective == "categorical":
        return "k_anonymity" if rows >= small else "category"
    if effective == "temporal":
        return "date"
    if effective == "geospatial":
        return "location"
    return "hash"


def plan_privacy(
    df: DataFrame,
    risk_score: int | None = None,
    policy_name: str = "standard",
    compat: str = "policy",
    columns: list[str] | None = None,
    distinct: str = "exact",
    sample_by: list[str] | None = None,
    small: int = 0,
) -> PrivacyPlan:
    """Profile the table and decide every column's treatment.

    ``columns`` names what is to be released; the others get no plan, and no release.
    ``small`` (``K.SMALL_DATASET_ROWS`` is the customary number) sets apart tables of
    fewer rows, see ``treatment_of``; by default tables of any size are treated alike.

    ``compat='risk'`` takes epsilon and k from the risk score alone;
    ``'policy'`` tightens them to the named policy as well.
    """
    columns = columns or df.columns
    profiled = classify.numeric_override(
        classify.combine_signals(classify.profile_columns(df, columns, distinct, sample_by))
    )
    # the score is a subquery of the profile, so that one action runs both
    score = risk.dataset_risk(df, columns).select("risk_score").scalar() if risk_score is None else F.lit(risk_score)
    # one row per column of the schema
    found = {r["column"]: r for r in profiled.withColumn("risk_score", score).collect()}
    risk_score = next(iter(found.values()))["risk_score"]
    epsilon, k, strict = settings_for_risk(risk_score)
    chosen = policy.policy_named(policy_name)
    if compat == "policy":
        epsilon = min(epsilon, Decimal(str(chosen.epsilon)))
        k = max(k, chosen.k)
    rows = max((r["n"] for r in found.values()), default=0)
    rows = df.count() if rows < small else rows
    plan = PrivacyPlan(risk_score, epsilon, k, strict, rows, l_diversity=compat == "risk" or chosen.l_diversity)
    for position, name in enumerate(columns):
        r = found[name]
        treatment = treatment_of(name, r["type"], r["effective_type"], rows, small) if r["n"] else "none"
        nonzero = r["m_nonzero"] > 0
        plan.columns.append(
            ColumnPlan(name, position, r["type"], r["sensitivity"], r["mechanism"], treatment, nonzero)
        )
    noisy = [c for c in plan.columns if c.treatment == "numeric" and c.nonzero]
    for c, share in zip(noisy, epsilon_shares(epsilon, len(noisy))):
        c.epsilon = share
    return plan


def value_expression(c: ColumnPlan, data_type: str, secret: str, key: str) -> Column | None:
    """Per-value treatment, or None when the column needs more than its own value."""
    value = F.col(f"`{c.column}`")
    text = value.cast("string")
    if c.treatment == "none":
        return value
    if c.treatment == "numeric":
        if not c.nonzero:
            return value
        number = parse.number_or_null(value, data_type)
        return numeric_release(number, c.column, secret, F.col(f"`{key}`"))
    if c.treatment in ("json", "k_anonymity", "category"):
        return None
    apply = {
        "pseudonym": masks.pseudonym,
        "email": masks.mask_email,
        "phone": masks.mask_phone,
        "location": masks.generalize_location,
        "date": masks.generalize_date,
        "hash": masks.hash_keep_length,
        "redact": masks.redact,
        "suppress": masks.suppress,
    }
    return apply[c.treatment](text)


def apply_plan(
    df: DataFrame, plan: PrivacyPlan, secret: str, key: str, keep: list[str] | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Apply a plan; ``key`` names the row key that drives the noise.

    The row key itself may be treated too: its original is carried along until
    the last column is done. Rows without a key end the job, as their noise could not
    be drawn; rows that share a key share their noise. Columns without a plan are left
    out, except those that ``keep`` lists to be released as they are. ``source`` may name
    the whole table when ``df`` holds some of its rows.
    """
    types = dict(df.dtypes)
    by_value = []
    whole_column = []
    planned = {c.column: c for c in plan.columns}
    released = [n for n in df.columns if n in planned or n in (keep or [])]
    for name in released:
        expression = value_expression(planned[name], types[name], secret, key) if name in planned else F.col(f"`{name}`")
        if expression is None:
            whole_column.append(planned[name])
            expression = F.col(f"`{name}`")
        by_value.append(expression.alias(name))
    known = F.coalesce(F.col(f"`{key}`"), F.raise_error(F.lit(f"row key {key} must not be null")))
    result = df.select(*by_value, known.alias("_row_key"))
    whole = source if source is not None else df
    texts = [c.column for c in whole_column if c.treatment == "k_anonymity" and types[c.column] == "string"]
    counted = anonymize.count_categories(whole, texts) if texts else {}
    for c in whole_column:
        if c.treatment == "json":
            result = json_rewrite.anonymize_json(result, c.column, secret, "_row_key")
        elif c.treatment == "category":
            result = anonymize.generalize_categories(result, c.column)
        else:
            result = anonymize.k_anonymize(
                result, c.column, plan.k, secret, "_row_key", source=whole, counted=counted.get(c.column)
            )
    return result.where(F.col("_row_key").isNotNull()).select(*[F.col(f"`{n}`") for n in released])


def privatize(
    df: DataFrame,
    secret: str,
    key: str,
    risk_score: int | None = None,
    policy_name: str = "standard",
    compat: str = "policy",
    columns: list[str] | None = None,
) -> tuple[DataFrame, PrivacyPlan]:
    """Classify, score and anonymize a table; returns the table and its plan."""
    plan = plan_privacy(df, risk_score, policy_name, compat, columns)
    return apply_plan(df, plan, secret, key), plan


def assess_and_privatize(
    df: DataFrame,
    secret: str,
    key: str,
    policy_name: str = "standard",
    compat: str = "policy",
    columns: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Score, anonymize and score again: the released table and a one-row report."""
    released, plan = privatize(df, secret, key, None, policy_name, compat, columns)
    after = risk.residual_risk(released, plan.metadata(df), [c.column for c in plan.columns])
    before = F.lit(plan.risk_score)
    report = after.select(
        F.lit(policy.policy_named(policy_name).name).alias("policy_used"),
        before.alias("risk_score"),
        risk.risk_level(before).alias("risk_level"),
        F.col("risk_score").alias("new_risk_score"),
        F.col("risk_level").alias("new_risk_level"),
        "coverage",
        risk.risk_reduction(before, F.col("risk_score")).alias("risk_reduction_percent"),
    )
    return released, report


def release_summary(original: DataFrame, released: DataFrame, plan: PrivacyPlan) -> DataFrame:
    """One row: settings, guarantee level, utility and the l-diversity check."""
    summary = checks.utility(released, [c.column for c in plan.columns]).select(
        F.lit(plan.risk_score).alias("risk_score"),
        F.lit(plan.epsilon).cast("double").alias("epsilon_total"),
        F.lit(K.DELTA).alias("delta"),
        F.lit(plan.k).alias("k_anonymity"),
        F.lit(plan.strict).alias("strict_mode"),
        F.lit(guarantee_level(plan.epsilon)).alias("privacy_level"),
        F.lit(len(plan.columns)).alias("columns_transformed"),
        "*",
    )
    quasi = [c.column for c in plan.columns if c.type == "quasi_identifier"]
    sensitive = [c.column for c in plan.columns if c.type == "sensitive"]
    if plan.l_diversity and quasi and sensitive:
        # every sensitive column counts: a class may be diverse in one and uniform in another
        found = [checks.l_diversity(original, quasi, name).select("violations_found").scalar() for name in sensitive]
        violations = found[0] if len(found) == 1 else F.greatest(*found)
        summary = summary.withColumn("l_violations", violations)
    return summary


def proof(df: DataFrame, plan: PrivacyPlan, secret: str, key: str, rows: int = 5) -> DataFrame:
    """Original and released values side by side for the first rows by key.

    The pairs come from one pass with the original kept next to the treated
    columns; no row matching by position.
    """
    originals = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    # only the rows shown are treated; the counts behind k-anonymity come from the whole table
    first = df.orderBy(F.asc_nulls_last(f"`{key}`")).limit(rows)
    treated = apply_plan(first.withColumn("_original", originals), plan, secret, key, ["_original"], source=df)
    shown = treated.select(
        F.col("_original").alias("original"),
        F.struct(*[F.col(f"`{c.column}`") for c in plan.columns]).alias("anonymized"),
    )
    return shown.orderBy(F.col(f"original.`{key}`")).limit(rows)
