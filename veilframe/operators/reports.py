"""Reports on ledgers, transactions and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def budget_percent() -> Column:
    """Remaining share of the maximum in percent; 0 when there is no maximum."""
    share = F.col("epsilon_remaining") / F.nullif(F.col("max_epsilon"), F.lit(0.0)) * 100.0
    return F.coalesce(share, F.lit(0.0))


def budget_level(percent: Column) -> Column:
    """HIGH, MEDIUM, LOW or CRITICAL."""
    label = None
    for above, name, _ in K.BUDGET_BANDS:
        label = F.when(percent > above, name) if label is None else label.when(percent > above, name)
    return label.otherwise(K.BUDGET_BOTTOM[0])


def degradation_factor(percent: Column) -> Column:
    """Noise multiplier of a budget level."""
    factor = None
    for above, _, value in K.BUDGET_BANDS:
        hit = F.lit(value)
        factor = F.when(percent > above, hit) if factor is None else factor.when(percent > above, hit)
    return factor.otherwise(F.lit(K.BUDGET_BOTTOM[1]))


def budget_warning(percent: Column) -> Column:
    """Warning text shown with a query result; null while the budget is high."""
    shown = F.format_string("%.1f%%", percent)
    factor = F.format_string("%.1fx", degradation_factor(percent))
    level = budget_level(percent)
    medium = F.concat(
        F.lit("Your privacy budget is at "), shown, F.lit(". Noise has been increased "), factor,
        F.lit(" for stronger privacy protection."),
    )
    low = F.concat(
        F.lit("⚠️ Your privacy budget is running low ("), shown,
        F.lit(" remaining). Noise has been increased "), factor, F.lit(" for stronger privacy protection."),
    )
    critical = F.concat(
        F.lit("🚨 CRITICAL: Only "), shown, F.lit(" budget remaining! Noise has been increased "), factor,
        F.lit(". Consider requesting a budget reset."),
    )
    return F.when(level == "MEDIUM", medium).when(level == "LOW", low).when(level == "CRITICAL", critical)


def budget_status(ledger: DataFrame) -> DataFrame:
    """Remaining, total, percent, status, degradation and query count per user."""
    percent = budget_percent()
    return ledger.select(
        "user_id",
        F.bround("epsilon_remaining", 6).alias("epsilon_remaining"),
        F.col("max_epsilon").alias("epsilon_total"),
        F.bround(percent, 2).alias("budget_percentage"),
        budget_level(percent).alias("status"),
        degradation_factor(percent).alias("degradation_factor"),
        "total_queries",
        "last_refill",
    )


def all_budgets(ledger: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every user's budget with query count and last query, lowest percent first."""
    used = transactions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_queries"), F.max("ts").alias("last_query")
    )
    percent = budget_percent()
    joined = ledger.select("user_id", "epsilon_remaining", "max_epsilon", "last_refill").join(used, "user_id", "left")
    return joined.select(
        "user_id",
        F.bround("epsilon_remaining", 6).alias("epsilon_remaining"),
        F.col("max_epsilon").alias("epsilon_total"),
        F.bround(percent, 2).alias("budget_percentage"),
        budget_level(percent).alias("status"),
        F.coalesce("total_queries", F.lit(0)).alias("total_queries"),
        "last_query",
        "last_refill",
    ).orderBy("budget_percentage", "user_id")


def user_list(ledger: DataFrame) -> DataFrame:
    """Users with their budget, newest first."""
    percent = budget_percent()
    return ledger.select(
        "user_id",
        "team_id",
        F.bround("epsilon_remaining", 4).alias("epsilon_remaining"),
        F.col("max_epsilon").alias("epsilon_total"),
        F.bround(percent, 1).alias("budget_percent"),
        budget_level(percent).alias("status"),
        "created_at",
    ).orderBy(F.desc("created_at"), "user_id")


def system_stats(ledger: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row: users, queries, average share of budget used."""
    used = (F.col("max_epsilon") - F.col("epsilon_remaining")) / F.col("max_epsilon") * 100.0
    queries = transactions.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ledger.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.bround(F.coalesce(F.avg(used), F.lit(0.0)), 2).alias("average_budget_used_percent"),
    ).select("total_users", queries.alias("total_queries"), "average_budget_used_percent")


def query_breakdown(transactions: DataFrame) -> DataFrame:
    """Queries per type, most frequent first."""
    return (
        transactions.groupBy("query_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query_type")
    )


def status_histogram(ledger: DataFrame) -> DataFrame:
    """Users per status; statuses nobody has are listed with 0."""
    spark = ledger.sparkSession
    levels = spark.createDataFrame([(i, s) for i, s in enumerate(K.STATUS_ORDER)], "position int, status string")
    counts = ledger.groupBy(budget_level(budget_percent()).alias("status")).agg(F.count(F.lit(1)).alias("users"))
    return levels.join(counts, "status", "left").select(
        "position", "status", F.coalesce("users", F.lit(0)).alias("users")
    )


def queries_remaining(ledger: DataFrame, remaining_cents: Column) -> DataFrame:
    """Whole queries of each basic type the remaining budget still pays for.

    Counted in hundredths of epsilon, so 0.3 / 0.1 is 3 and not 2.
    """
    costs = K.QUERY_COST_CENTS
    return ledger.select(
        "user_id",
        *[
            F.floor(remaining_cents / F.lit(costs[kind])).cast("bigint").alias(f"{kind}_queries")
            for kind in ("count", "mean", "sum")
        ],
    )


def audit_entries(transactions: DataFrame, sensitivity: Column | None = None) -> DataFrame:
    """Audit form of transactions: rounded amounts and the derived mathematical texts.

    The effective epsilon is cost divided by degradation, as queries run.
    """
    sensitivity = sensitivity if sensitivity is not None else F.lit(1.0)
    percent = budget_percent()
    factor = degradation_factor(percent)
    effective = F.col("epsilon_cost") / factor
    scale = sensitivity / effective
    return transactions.select(
        "user_id",
        F.col("ts").alias("timestamp"),
        "query_id",
        "query_type",
        F.bround("epsilon_cost", 6).alias("epsilon_cost"),
        F.bround("epsilon_remaining", 6).alias("epsilon_remaining"),
        F.lit("LaplaceBoundedDomain").alias("mechanism"),
        F.struct(
            F.bround(sensitivity, 4).alias("sensitivity"),
            F.bround(scale, 4).alias("noise_scale"),
            F.format_string("Laplace(μ=0, b=%.2f)", scale).alias("noise_distribution"),
            F.format_string("%.1fx", factor).alias("degradation_applied"),
            F.bround(effective, 6).alias("effective_epsilon"),
        ).alias("mathematical_output"),
    )


def audit_log(transactions: DataFrame, limit: int = K.AUDIT_LIMIT) -> DataFrame:
    """The newest entries of every user.

    Ranking with a limit is cut off before the shuffle as well, so a user with
    most of the log sends at most ``limit`` rows per task.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("query_id"))
    ranked = audit_entries(transactions).withColumn("entry", F.row_number().over(newest))
    return ranked.where(F.col("entry") <= limit)


def erase_users(table: DataFrame, erased: DataFrame, user: str = "user_id") -> DataFrame:
    """A ledger, history or membership table without the given users."""
    return table.join(erased.select(user), user, "left_anti")


def entries_of(entries: DataFrame, user: int | str) -> DataFrame:
    """One user's part of an audit log."""
    return entries.where(F.col("user_id") == F.lit(user))
