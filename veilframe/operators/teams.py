"""Team reports and similar-query detection inside teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import materialize
from .ordering import with_running_total

_ASKED = ["query_id", "user_id", "team_id", "ts", "table_name", "field_name", "query_type"]


def roster(memberships: DataFrame, teams: DataFrame, ledger: DataFrame) -> DataFrame:
    """Active members with team data and remaining epsilon (null without a ledger)."""
    return (
        memberships.where("is_active")
        .join(teams, "team_id")
        .join(ledger.select("user_id", "epsilon_remaining"), "user_id", "left")
        .select("team_id", "team_name", "user_id", "role", "joined_at", "epsilon_remaining")
    )


def capacity(teams: DataFrame, memberships: DataFrame) -> DataFrame:
    """Member count, including inactive members, and whether a team is full."""
    counts = memberships.groupBy("team_id").agg(F.count(F.lit(1)).alias("members"))
    members = F.coalesce(F.col("members"), F.lit(0))
    return teams.join(counts, "team_id", "left").select(
        "team_id", members.alias("members"), "max_members", (members >= F.col("max_members")).alias("is_full")
    )


def assignment(events: DataFrame) -> DataFrame:
    """Current team per user from join/leave events (user_id, ts, event_id, action, team_id)."""
    team = F.when(F.col("action") == "join", F.col("team_id"))
    state = F.struct(team.alias("team_id"), F.col("ts").alias("changed_at"))
    last = events.groupBy("user_id").agg(F.max_by(state, F.struct("ts", "event_id")).alias("s"))
    return last.select("user_id", "s.team_id", "s.changed_at")


def fingerprint(*parts: str):
    """Digest of the parts that make two queries the same question."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def _counts_at(probes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Queries of the same key group up to each probe, as a running total over all groups."""
    ordered = probes.select("_nth", "query_id", "moment", "is_query", "side", *keys)
    order = [*keys, "moment", "side", "query_id", "_nth"]
    return with_running_total(ordered, order, {name: F.col("is_query")}).select("_nth", "side", name)


def factors(similar: str, own: str) -> list[Column]:
    """Number of like queries, whether a teammate asked one, and the cost factor."""
    none, same, other = K.SIMILAR_MULTIPLIER
    cross = F.col(similar) > F.col(own)
    factor = F.when(F.col(similar) == 0, none).when(cross, other).otherwise(same)
    return [
        F.col(similar).alias("similar_queries_detected"), cross.alias("cross_user_detection"), factor.alias("budget_multiplier")
    ]


def with_similar(log: DataFrame, window_seconds: int = K.SIMILAR_WINDOW_SECONDS) -> DataFrame:
    """The log with ``_similar`` and ``_own``: earlier like queries within the window, and those of the same user.

    ``log``: query_id, user_id, team_id, ts, table_name, field_name, query_type, and more.
    Like queries share team, table, field and type; of two at the same time the
    one with the smaller id is earlier. Every row is a query of its own, also where ids repeat.

    No pairs are formed. Every query sends two rows, itself and the start of its
    window, into one global order of (group, time); the difference of the running
    totals there is the number of like queries in between. The same total over
    (group, user) gives the user's own share, the rest are teammates'. Work is
    two sorts of twice the log, whatever the group sizes.
    """
    numbered = materialize(log.withColumn("_nth", F.monotonically_increasing_id()))
    base = numbered.select(
        "_nth",
        "query_id",
        "user_id",
        F.unhex(fingerprint("team_id", "table_name", "field_name", "query_type")).alias("print"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )
    # at equal times window starts come before queries
    probes = base.select("*", F.inline(F.array(
        F.struct((F.col("at") - F.lit(window_seconds * 1_000_000)).alias("moment"),
                 F.lit(0).alias("side"), F.lit(0).alias("is_query")),
        F.struct(F.col("at").alias("moment"), F.lit(1).alias("side"), F.lit(1).alias("is_query")),
    )))
    team = _counts_at(probes, ["print"], "team_total")
    own = _counts_at(probes, ["print", "user_id"], "own_total")

    def between(counts: DataFrame, total: str, name: str) -> DataFrame:
        end = F.max(F.when(F.col("side") == 1, F.col(total)))
        start = F.max(F.when(F.col("side") == 0, F.col(total)))
        # the query itself is not similar to itself
        return counts.groupBy("_nth").agg((end - start - 1).alias(name))

    counts = between(team, "team_total", "_similar").join(between(own, "own_total", "_own"), "_nth")
    return numbered.join(counts, "_nth").drop("_nth")


def similar_queries(log: DataFrame, window_seconds: int = K.SIMILAR_WINDOW_SECONDS) -> DataFrame:
    """For each query the number of earlier like queries of its team, whether a teammate asked one, and the cost factor."""
    counted = with_similar(log.select(*_ASKED), window_seconds)
    return counted.select("query_id", "user_id", "team_id", *factors("_similar", "_own"))


def charged(log: DataFrame, window_seconds: int = K.SIMILAR_WINDOW_SECONDS) -> DataFrame:
    """A query log whose ``cost_cents`` carry the similarity factor; the plain cost stays as ``base_cost_cents``."""
    counted = with_similar(log, window_seconds)
    factor = factors("_similar", "_own")[-1]
    cost = (F.col("cost_cents") * F.col("budget_multiplier")).cast("bigint")
    priced = counted.withColumn("budget_multiplier", factor).withColumn("base_cost_cents", F.col("cost_cents"))
    return priced.withColumn("cost_cents", cost).drop("_similar", "_own")
