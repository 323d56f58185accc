"""Differentially private aggregates.

Values are clipped to public bounds, reduced by one partial/final aggregate,
and noise keyed by the query is added to the one-row (or per-group) result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import keyed
from ..session import materialize
from .ordering import with_position
from .reports import budget_level, budget_percent, budget_warning, degradation_factor

COMPARISONS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}
QUERY_TYPES = list(K.QUERY_COST_CENTS)


def field_sensitivity(name: str, typical: float | None = None) -> tuple[float, float, float]:
    """(sensitivity, lower, upper) by field name, else by magnitude, else the default."""
    lowered = name.lower()
    for word, sensitivity, lower, upper in K.FIELD_SENSITIVITY:
        if word in lowered:
            return sensitivity, lower, upper
    if typical is None:
        return K.DEFAULT_SENSITIVITY
    for below, sensitivity, lower, upper in K.MAGNITUDE_SENSITIVITY:
        if abs(typical) < below:
            return sensitivity, lower, upper
    return K.MAGNITUDE_TOP


def apply_filters(df: DataFrame, filters: dict[str, dict]) -> DataFrame:
    """Keep rows that satisfy all ``{field: {operator, value}}`` conditions."""
    for name, condition in filters.items():
        operator = condition["operator"]
        if operator not in COMPARISONS:
            raise ValueError(f"operator {operator!r} is not one of {list(COMPARISONS)}")
        if name not in df.columns:
            raise ValueError(f"unknown field {name!r}")
        df = df.where(COMPARISONS[operator](F.col(f"`{name}`"), F.lit(condition["value"])))
    return df


def effective_epsilon(query_type: str, degradation: float = 1.0) -> float:
    """Cost of a query type divided by the degradation factor."""
    return K.QUERY_COST_CENTS[query_type] / 100.0 / degradation


def clip(c: Column, lower: float, upper: float) -> Column:
    """The value moved into [lower, upper]; null and NaN are unknown."""
    value = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    moved = F.least(F.greatest(value, F.lit(float(lower))), F.lit(float(upper)))
    return F.when(value.isNotNull(), moved)


def _statistics(c: Column, lower: float, upper: float) -> list[Column]:
    """Exact statistics the mechanisms start from.

    The variance is taken from sums of offsets from the middle of the bounds,
    which keeps the numbers small and the aggregate a plain partial sum.
    """
    middle = (lower + upper) / 2.0
    centred = clip(c, lower, upper) - F.lit(middle)
    known = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return [
        F.count(known).alias("_n"),
        F.count_if(known != 0).alias("_nonzero"),
        F.coalesce(F.sum(clip(c, lower, upper)), F.lit(0.0)).alias("_sum"),
        F.avg(clip(c, lower, upper)).alias("_mean"),
        F.coalesce(F.avg(centred * centred) - F.avg(centred) * F.avg(centred), F.lit(0.0)).alias("_var"),
    ]


def truncated(value: Column, u: Column, scale: Column, lower: Column, upper: Column) -> Column:
    """Laplace noise, then the nearest point of [lower, upper]."""
    return F.least(F.greatest(value + keyed.laplace(u, scale), lower), upper)


def bounded(value: Column, u: Column, epsilon: float, sensitivity: Column, lower: Column, upper: Column) -> Column:
    """Bounded-domain Laplace with its calibrated scale."""
    scale = keyed.bounded_laplace_scale(epsilon, sensitivity, upper - lower)
    return keyed.bounded_laplace(value, u, scale, lower, upper)


def _with_result(stats: DataFrame, query_type: str, u: Column, epsilon: float, lower: float, upper: float) -> DataFrame:
    n = F.greatest(F.col("_n"), F.lit(1)).cast("double")
    low, high, width = F.lit(float(lower)), F.lit(float(upper)), float(upper - lower)
    if query_type == "count":
        noisy = F.rint(F.col("_nonzero") + keyed.laplace(u, 1.0 / epsilon))
        return stats.withColumn("result", F.greatest(noisy, F.lit(0.0)))
    if query_type == "mean":
        mean = F.coalesce("_mean", F.lit((lower + upper) / 2.0))
        return stats.withColumn("result", truncated(mean, u, F.lit(width / epsilon) / n, low, high))
    if query_type == "sum":
        # one record moves a clipped sum by at most the larger bound
        reach = F.lit(float(max(abs(lower), abs(upper))))
        return stats.withColumn("result", bounded(F.col("_sum"), u, epsilon, reach, low * n, high * n))
    reach = F.greatest(F.lit(width * width) * (n - 1.0) / (n * n), F.lit(1e-12))
    variance = F.greatest(F.col("_var"), F.lit(0.0))
    released = bounded(variance, u, epsilon, reach, F.lit(0.0), F.lit(width * width / 4.0))
    return stats.withColumn("result", F.sqrt(released) if query_type == "std" else released)


def _check(query_type: str, lower: float, upper: float) -> None:
    if query_type not in K.QUERY_COST_CENTS:
        raise ValueError(f"query type {query_type!r} is not one of {QUERY_TYPES}")
    if not lower < upper:
        raise ValueError("the lower bound must be below the upper bound")


def dp_aggregate(
    df: DataFrame,
    field: str,
    query_type: str,
    lower: float,
    upper: float,
    secret: str,
    query_id: str,
    degradation: float = 1.0,
) -> DataFrame:
    """One row: the private result and the privacy parameters that produced it."""
    _check(query_type, lower, upper)
    epsilon = effective_epsilon(query_type, degradation)
    u = keyed.uniform(secret, "dp_" + query_type, field, F.lit(query_id))
    stats = df.agg(*_statistics(F.col(f"`{field}`"), lower, upper))
    return _with_result(stats, query_type, u, epsilon, lower, upper).select(
        F.lit(query_type).alias("query_type"),
        F.lit(field).alias("field"),
        "result",
        F.lit(epsilon).alias("effective_epsilon"),
    )


def dp_grouped(
    df: DataFrame,
    group: str,
    public_groups: DataFrame,
    field: str,
    query_type: str,
    lower: float,
    upper: float,
    secret: str,
    query_id: str,
    degradation: float = 1.0,
) -> DataFrame:
    """The same per group of a public, fixed list.

    Only listed groups are reported and listed groups without rows are
    reported too: presence of a group in the data is not revealed. Each
    record belongs to one group, so the groups share one epsilon.
    """
    _check(query_type, lower, upper)
    epsilon = effective_epsilon(query_type, degradation)
    stats = df.groupBy(group).agg(*_statistics(F.col(f"`{field}`"), lower, upper))
    listed = public_groups.select(group).join(stats, group, "left").fillna(
        0, subset=["_n", "_nonzero", "_sum", "_var"]
    )
    row = F.concat(F.lit(query_id + "|"), F.col(group).cast("string"))
    u = keyed.uniform(secret, "dp_" + query_type, field, row)
    return _with_result(listed, query_type, u, epsilon, lower, upper).select(group, "result")


def dp_query(
    tables: dict[str, DataFrame],
    request: dict,
    remaining_cents: int,
    secret: str,
    degradation: float = 1.0,
) -> DataFrame:
    """A request {query_id, table_name, field_name, query_type, filters?} under a budget.

    Returns the private aggregate, or one row with an error when the budget
    does not cover the cost or the request is invalid.
    """
    spark = next(iter(tables.values())).sparkSession
    for part in ("table_name", "field_name", "query_type"):
        if not request.get(part):
            return _error(spark, f"{part} required", remaining_cents, 0)
    query_type = request["query_type"]
    if query_type not in K.QUERY_COST_CENTS:
        return _error(spark, "Invalid query type", remaining_cents, 0)
    cost = K.QUERY_COST_CENTS[query_type]
    if remaining_cents < cost:
        return _error(spark, "BUDGET_EXHAUSTED", remaining_cents, cost)
    _, lower, upper = field_sensitivity(request["field_name"])
    lower, upper = request.get("bounds", (lower, upper))
    rows = apply_filters(tables[request["table_name"]], request.get("filters") or {})
    return dp_aggregate(
        rows, request["field_name"], query_type, lower, upper, secret, request["query_id"], degradation
    )


def _error(spark, message: str, remaining: int, required: int) -> DataFrame:
    return spark.range(1).select(
        F.lit(message).alias("error"),
        F.lit(remaining / 100.0).alias("epsilon_remaining"),
        F.lit(required / 100.0).alias("epsilon_required"),
    )


def answer_log(
    decisions: DataFrame, df: DataFrame, field: str, lower: float, upper: float, secret: str
) -> DataFrame:
    """Answer a whole log of decided queries on one field.

    ``decisions``: query_id, user_id, query_type, epsilon_cost, accepted,
    epsilon_remaining, max_epsilon. Refused queries carry an error.
    """
    stats = df.agg(*_statistics(F.col(f"`{field}`"), lower, upper))
    known = stats.select("*", F.lit(0).alias("spec"), F.lit(float(lower)).alias("_lower"), F.lit(float(upper)).alias("_upper"))
    u = keyed.uniform(secret, "dp_answer", field, F.col("query_id"))
    return _answers(decisions.withColumn("spec", F.lit(0)), known, u)


MAX_SPECS = 200


def invalid_request(tables: dict[str, list[str]]) -> Column:
    """Why a request {table_name, field_name, query_type, filter_field, filter_operator} cannot be answered, else null.

    ``tables`` lists the fields that may be asked for and filtered by, per table.
    """
    reason = F.lit(None).cast("string")
    offered = F.create_map(*[x for t, fields in tables.items() for x in (F.lit(t), F.array(*[F.lit(f) for f in fields]))])
    fields = F.element_at(offered, F.col("table_name"))
    checks = [
        (F.col("filter_field").isNotNull() & ~F.coalesce(F.col("filter_operator").isin(*COMPARISONS), F.lit(False)), "Invalid filter operator"),
        (F.col("filter_field").isNotNull() & ~F.coalesce(F.array_contains(fields, F.col("filter_field")), F.lit(False)), "Unknown filter field"),
        (~F.col("query_type").isin(*QUERY_TYPES), "Invalid query type"),
        (~F.coalesce(F.array_contains(fields, F.col("field_name")), F.lit(False)), "Unknown field"),
        (F.col("query_type").isNull(), "query_type required"),
        (F.col("field_name").isNull(), "field_name required"),
        (F.col("table_name").isNull(), "table_name required"),
    ]
    for wrong, text in checks:  # the last one that holds wins
        reason = F.when(wrong, F.lit(text)).otherwise(reason)
    return reason


def answer_requests(
    decisions: DataFrame, df: DataFrame, bounds: dict[str, tuple[float, float]], secret: str, max_specs: int = MAX_SPECS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Answer a log of decided requests with their own fields and filters.

    ``decisions`` as for ``answer_log`` with field_name, filter_field, filter_operator and
    filter_value (no filter: null); its columns ``keep`` are kept. ``bounds`` gives the public bounds of each field. The
    different (field, filter) pairs become conditional aggregates, ``max_specs`` of them per pass over the table,
    as many passes as they need.
    """
    names = ["field_name", "filter_field", "filter_operator", "filter_value"]
    pairs = decisions.select(*names).distinct()
    listed = materialize(with_position(pairs, names, "spec").withColumn("spec", F.col("spec").cast("int")))
    number = listed.count()
    stats = []
    for start in range(0, number, max_specs):
        wanted = listed.where((F.col("spec") >= start) & (F.col("spec") < start + max_specs)).collect()
        aggregates, rows = [], []
        for w in wanted:
            i, value = w["spec"], F.col(f"`{w['field_name']}`")
            if w["filter_field"] is not None:
                value = F.when(COMPARISONS[w["filter_operator"]](F.col(f"`{w['filter_field']}`"), F.lit(w["filter_value"])), value)
            lower, upper = (float(x) for x in bounds[w["field_name"]])
            aggregates.append(F.struct(*_statistics(value, lower, upper)).alias(f"s{i}"))
            rows.append(F.struct(F.lit(i).alias("spec"), F.lit(lower).alias("_lower"), F.lit(upper).alias("_upper"), F.col(f"s{i}").alias("s")))
        stats.append(df.agg(*aggregates).select(F.inline(F.array(*rows))).select("spec", "_lower", "_upper", "s.*"))
    if not stats:
        empty = "spec int, _lower double, _upper double, _n bigint, _nonzero bigint, _sum double, _mean double, _var double"
        stats = [decisions.sparkSession.createDataFrame([], empty)]
    same = [decisions[n].eqNullSafe(listed[n]) for n in names]
    marked = decisions.join(listed, same).select(*[decisions[c] for c in decisions.columns], "spec")
    u = keyed.uniform(secret, "dp_answer", "request", F.concat("field_name", F.lit("|"), F.col("query_id").cast("string")))
    return _answers(marked, reduce(DataFrame.unionByName, stats), u, number <= MAX_SPECS, keep)


def _answers(
    decisions: DataFrame, stats: DataFrame, u: Column, few: bool = True, keep: list[str] | None = None
) -> DataFrame:
    """Private answers of decided queries from the exact statistics of their ``spec``.

    Noise scales are solved once per (spec, query type, degradation), 20 rows a spec, and
    every accepted query gets its own keyed draw.
    """
    n = F.greatest(F.col("_n"), F.lit(1)).cast("double")
    low, high = F.col("_lower"), F.col("_upper")
    width = high - low
    kind, eps = F.col("query_type"), F.col("effective_epsilon")
    spread = kind.isin("variance", "std")
    # per query type: true value, domain, and how far one record can move it
    value = (
        F.when(kind == "count", F.col("_nonzero").cast("double"))
        .when(kind == "mean", F.coalesce("_mean", (low + high) / 2.0))
        .when(kind == "sum", F.col("_sum"))
        .otherwise(F.greatest(F.col("_var"), F.lit(0.0)))
    )
    bottom = F.when(kind == "mean", low).when(kind == "sum", low * n).otherwise(F.lit(0.0))
    top = F.when(kind == "mean", high).when(kind == "sum", high * n).when(spread, width * width / 4.0)
    reach = (
        F.when(kind == "count", F.lit(1.0))
        .when(kind == "mean", width / n)
        .when(kind == "sum", F.greatest(F.abs(low), F.abs(high)))
        .otherwise(F.greatest(width * width * (n - 1.0) / (n * n), F.lit(1e-12)))
    )
    factors = [factor for _, _, factor in K.BUDGET_BANDS] + [K.BUDGET_BOTTOM[1]]
    costs = F.array(*[F.struct(F.lit(t).alias("query_type"), F.lit(c / 100.0).alias("cost")) for t, c in K.QUERY_COST_CENTS.items()])
    kinds = stats.select("*", F.inline(costs)).select(
        "*", F.explode(F.array(*[F.lit(f) for f in factors])).alias("degradation_factor")
    )
    prepared = kinds.withColumn("effective_epsilon", F.col("cost") / F.col("degradation_factor")).select(
        "spec", "query_type", "degradation_factor", "effective_epsilon", "_lower", "_upper",
        value.alias("_value"), bottom.alias("_bottom"), top.alias("_top"), reach.alias("_reach"),
    )
    bounded_kind = spread | (kind == "sum")
    scale = F.when(
        bounded_kind, keyed.bounded_laplace_scale(eps, F.col("_reach"), F.col("_top") - F.col("_bottom"))
    ).otherwise(F.col("_reach") / eps)
    mechanisms = prepared.withColumn("noise_scale", scale)
    if few:  # at most 20 rows for each of MAX_SPECS
        mechanisms = F.broadcast(mechanisms)

    percent = budget_percent()
    asked = decisions.withColumn("degradation_factor", degradation_factor(percent)).withColumn("_percent", percent)
    drawn = asked.join(mechanisms, ["spec", "query_type", "degradation_factor"]).withColumn("_u", u)
    plain = F.col("_value") + keyed.laplace(F.col("_u"), F.col("noise_scale"))
    inside = keyed.bounded_laplace(
        F.col("_value"), F.col("_u"), F.col("noise_scale"), F.col("_bottom"), F.coalesce("_top", F.lit(float("inf")))
    )
    answer = (
        F.when(kind == "count", F.greatest(F.rint(plain), F.lit(0.0)))
        .when(kind == "mean", F.least(F.greatest(plain, low), high))
        .when(kind == "std", F.sqrt(inside))
        .otherwise(inside)
    )
    accepted = F.col("accepted")
    return drawn.select(
        "query_id",
        "user_id",
        "query_type",
        F.when(accepted, answer).alias("result"),
        F.when(~accepted, F.lit("BUDGET_EXHAUSTED")).alias("error"),
        "epsilon_cost",
        "epsilon_remaining",
        F.bround("_percent", 2).alias("budget_percentage"),
        "degradation_factor",
        F.when(accepted, eps).alias("effective_epsilon"),
        F.when(accepted, F.col("noise_scale")).alias("noise_scale"),
        budget_level(F.col("_percent")).alias("budget_status"),
        budget_warning(F.col("_percent")).alias("warning"),
        *(keep or []),
    )


def seeded_laplace(df: DataFrame, value: str, query_id: str, ts: str, key: str, scale: float, hours: int = 24) -> DataFrame:
    """Add deterministic Laplace noise: equal query and rotation window, equal noise."""
    hexdigest = keyed.seed_digest(key, F.col(query_id), keyed.rotation_window(F.col(ts), hours))
    noise = keyed.laplace(keyed.uniform_of(hexdigest), scale)
    return df.withColumn("noise", noise).withColumn("noisy", F.col(value) + F.col("noise"))


def seeded_gaussian(df: DataFrame, value: str, query_id: str, ts: str, key: str, sigma: float, hours: int = 24) -> DataFrame:
    """Add deterministic Gaussian noise from two slots of the query's seed."""
    hexdigest = keyed.seed_digest(key, F.col(query_id), keyed.rotation_window(F.col(ts), hours))
    noise = keyed.gaussian(keyed.uniform_of(hexdigest, 0), keyed.uniform_of(hexdigest, 1), sigma)
    return df.withColumn("noise", noise).withColumn("noisy", F.col(value) + F.col("noise"))
