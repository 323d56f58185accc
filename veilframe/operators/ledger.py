"""Budget ledger: refill, accept or refuse, in time order per budget holder.

Every decision depends on the balance the previous one left, but no holder's
history has to fit into one task. Events are range-partitioned on (holder,
time), so a dominant holder spreads over many partitions, and each partition
is folded on its own once its opening state is known. Opening states come from
two summaries of the partitions that continue a holder:

* clock: refill moments depend on event times alone (see ``_refill``), and only
  on how long before the partition's first event the last refill was, which
  matters up to one hour. A table over those 3601 whole seconds is the
  partition's effect on the clock.
* balance: with refills known, a partition maps opening to closing balances piece by
  piece: on each piece the balance is shifted by an amount or ends at a constant.
  The few pieces, never all balances, are the partition's effect on the balance.

Chaining the tables of one holder handles one row per partition, not events.
Holders inside one partition, the usual case, need no summary at all.

Amounts are integers, so results do not depend on summation order. The ledger
clock ticks in whole seconds. Holders must be known: an event without one ends the
job, since it would escape every budget. Ids stay in Arrow columns, exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from . import skew
from .ordering import in_global_order

HOUR = K.REFILL_INTERVAL_SECONDS
# units per hundredth of epsilon: whole cents for the hourly rule; for the fractional rule
# a tenth of the maximum per hour, counted per second, is then a whole number of units
UNITS_PER_CENT = {"hourly": 1, "fractional": 36000}
OPEN, RESET, QUERY = 0, 1, 2
_FOLD_COLUMNS = (
    "accepted boolean, refill_units bigint, before_units bigint, remaining_units bigint, "
    "max_cents bigint, last_refill_s bigint"
)


def _known(column: str, what: str) -> Column:
    """A column whose nulls end the job."""
    return F.coalesce(F.col(column), F.raise_error(F.lit(f"{what} must not be null")))


def normalize(
    queries: DataFrame,
    holder: str,
    resets: DataFrame | None = None,
    opening: DataFrame | None = None,
    rule: str = "hourly",
    carry: list[str] | None = None,
) -> DataFrame:
    """Bring queries, admin resets and opening ledgers into one event table.

    ``carry`` names columns of the queries that go through the fold with them, as ``carried``.

    queries: holder, query_id, ts, query_type, cost_cents (positive); holder and ts not null
    resets:  holder, reset_id, ts, max_cents
    opening: holder, max_cents, remaining_units, last_refill_s (a former fold's ledgers)
    """
    holder_type = dict(queries.dtypes)[holder]
    id_type = dict(queries.dtypes)["query_id"]
    cost = F.when(F.col("cost_cents") > 0, F.col("cost_cents")).otherwise(
        F.raise_error(F.lit("cost_cents must be positive"))
    )
    moment = F.unix_micros(_known("ts", "ts").cast("timestamp"))
    who = _known(holder, holder)
    events = queries.select(
        who.alias("holder"),
        moment.alias("at_us"),
        F.lit(QUERY).alias("kind"),
        F.col("query_id").alias("event_id"),
        F.col("query_type"),
        cost.cast("bigint").alias("cents"),
        F.lit(0).cast("bigint").alias("set_units"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    per_cent = UNITS_PER_CENT[rule]
    if resets is not None:
        events = events.unionByName(
            resets.select(
                who.cast(holder_type).alias("holder"),
                moment.alias("at_us"),
                F.lit(RESET).alias("kind"),
                F.col("reset_id").cast(id_type).alias("event_id"),
                F.lit(None).cast("string").alias("query_type"),
                _known("max_cents", "max_cents").cast("bigint").alias("cents"),
                (_known("max_cents", "max_cents").cast("bigint") * per_cent).alias("set_units"),
                F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"),
            ),
            allowMissingColumns=bool(carry),
        )
    if opening is not None:
        events = events.unionByName(
            opening.select(
                F.col("holder").cast(holder_type),
                F.lit(-(2**62)).cast("bigint").alias("at_us"),
                F.lit(OPEN).alias("kind"),
                F.lit("0").cast(id_type).alias("event_id"),
                F.lit(None).cast("string").alias("query_type"),
                F.col("max_cents").cast("bigint").alias("cents"),
                F.col("remaining_units").cast("bigint").alias("set_units"),
                F.col("last_refill_s").cast("bigint").alias("at_s"),
            ),
            allowMissingColumns=bool(carry),
        )
    return events


# ------------------------------------------------------------------ one partition
def _refill(rule: str, elapsed: int, fresh: bool, max_cents: int, rate: int) -> int:
    """Units due after ``elapsed`` seconds, before the cap; 0 when the clock does not move.

    hourly:     ``rate`` per whole hour; the clock moves whenever an hour has passed.
    fractional: a tenth of the maximum per hour, by the second; the clock stays while the
                ledger is full. It is full only until the first query after a reset, so
                ``fresh`` tells without looking at the balance.
    """
    if elapsed < HOUR:
        return 0
    if rule == "hourly":
        return rate * (elapsed // HOUR)
    return 0 if fresh else max_cents * elapsed


def _ignored(rule: str, cents: int, max_cents: int) -> bool:
    """A query dearer than the whole budget is refused before the fractional clock is read."""
    return rule == "fractional" and cents > max_cents


def _clock_moves(rule: str, elapsed: int, fresh: bool) -> bool:
    return elapsed >= HOUR and (rule == "hourly" or not fresh)


class _Fold:
    """State of one holder while its events pass by."""

    def __init__(self, rule: str, default_max: int, rate: int):
        self.rule, self.default_max, self.rate = rule, default_max, rate
        self.unit = UNITS_PER_CENT[rule]

    def create(self, at: int) -> None:
        self.restore(at, True, self.default_max, self.default_max * self.unit)

    def restore(self, last: int, fresh: bool, max_cents: int, units: int) -> None:
        self.last, self.fresh, self.max, self.units = last, fresh, max_cents, units

    def set(self, at: int, max_cents: int, units: int) -> None:
        self.restore(at, units >= max_cents * self.unit, max_cents, units)

    def query(self, at: int, cents: int) -> tuple[bool, int, int]:
        """(accepted, refilled units, units before spending)."""
        if _ignored(self.rule, cents, self.max):
            return False, 0, self.units
        elapsed = at - self.last
        refill = 0
        if _clock_moves(self.rule, elapsed, self.fresh):
            due = _refill(self.rule, elapsed, self.fresh, self.max, self.rate)
            refill = min(due, self.max * self.unit - self.units)
            self.units += refill
            self.last = at
        self.fresh = False
        before, cost = self.units, cents * self.unit
        if before < cost:
            return False, refill, before
        self.units = before - cost
        return True, refill, before


_ADDED = [
    ("accepted", pa.bool_()), ("refill_units", pa.int64()), ("before_units", pa.int64()),
    ("remaining_units", pa.int64()), ("max_cents", pa.int64()), ("last_refill_s", pa.int64()),
]


def _fold_partition(
    batches: Iterator[pa.RecordBatch], rule: str, default_max: int, rate: int, opened: dict
) -> Iterator[pa.RecordBatch]:
    """Fold one sorted partition; ``opened`` holds the state a partition starts from."""
    fold, holder, first = _Fold(rule, default_max, rate), None, True
    for batch in batches:
        out = []
        needed = ("holder", "kind", "at_s", "cents", "set_units", "_part")
        for who, kind, at, cents, units, part in zip(*(batch.column(n).to_pylist() for n in needed)):
            if first or who != holder:
                if first and part in opened:
                    fold.restore(*opened[part])
                else:
                    fold.create(at)
                holder, first = who, False
            if kind == QUERY:
                accepted, refill, before = fold.query(at, cents)
            else:
                before = fold.units if kind == RESET else units
                fold.set(at, cents, units)
                accepted, refill = None, units - before
            out.append((accepted, refill, before, fold.units, fold.max, fold.last))
        kept = [n for n in batch.schema.names if n not in ("_part", "_row")]
        added = zip(*out) if out else [()] * len(_ADDED)
        columns = {n: batch.column(n) for n in kept}
        columns |= {n: pa.array(values, t) for (n, t), values in zip(_ADDED, added)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


# ------------------------------------------------------------------ summaries
def _pack(table: np.ndarray) -> bytes:
    """Run-length form of an integer table: runs of equal values or of equal shifts."""
    best = b""
    for mode, flat in ((0, table), (1, table - np.arange(table.size))):
        starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        packed = np.concatenate(([mode, starts.size], starts, flat[starts])).astype(np.int64).tobytes()
        if not best or len(packed) < len(best):
            best = packed
    return best


def _look_up(packed: bytes, index: int) -> int:
    """One entry of a packed table."""
    numbers = np.frombuffer(packed, dtype=np.int64)
    mode, n = int(numbers[0]), int(numbers[1])
    run = int(np.searchsorted(numbers[2 : 2 + n], index, side="right")) - 1
    return int(numbers[2 + n + run]) + (index if mode else 0)


def _clock_end(times: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Last refill moment after passing all event times, for many starting moments at once."""
    last = last.copy()
    while True:
        nxt = np.searchsorted(times, last + HOUR)
        moving = nxt < times.size
        if not moving.any():
            return last
        last[moving] = times[nxt[moving]]


def _segment_clock(rule: str, seg: pd.DataFrame, max_cents: int, begins: bool) -> dict:
    """A segment's effect on (last refill, fresh)."""
    at, kind, cents = (seg[c].to_numpy() for c in ("at_s", "kind", "cents"))
    first = int(at[0])
    sets = np.flatnonzero(kind != QUERY)
    if sets.size:
        s = int(sets[-1])
        max_cents, last = int(cents[s]), int(at[s])
        full = int(seg["set_units"].iloc[s]) >= max_cents * UNITS_PER_CENT[rule]
        at, cents = at[s + 1 :], cents[s + 1 :]
    else:
        last, full = first, True
    if rule == "fractional":
        at = at[cents <= max_cents]
    # a full ledger leaves the fractional clock alone until its first query
    result = {"first_s": first, "touched": bool(at.size), "known": bool(sets.size) or begins}
    if result["known"]:
        fresh = full and rule == "fractional"
        end = _clock_end(at[1:] if fresh else at, np.array([last]))[0]
        return {**result, "last_s": int(end), "fresh": bool(fresh and not at.size), "table": b"", "table_fresh": b""}
    starts = first - HOUR + np.arange(HOUR + 1)
    plain = _pack(_clock_end(at, starts) - first)
    after_first = _pack(_clock_end(at[1:], starts) - first) if rule == "fractional" else plain
    return {**result, "last_s": 0, "fresh": False, "table": plain, "table_fresh": after_first}


class _Pieces:
    """A map from opening balances 0 to ``top`` to balances, piece by piece.

    From each start on, up to the next, the balance is the opening plus ``value``, or
    ``value`` itself where ``fixed``.
    """

    def __init__(self, top: int):
        self.top = top
        self.start, self.fixed, self.value = np.zeros(1, np.int64), np.zeros(1, bool), np.zeros(1, np.int64)

    def _split(self, balance: int) -> None:
        """Cut the pieces in which the balance passes this amount."""
        last = np.append(self.start[1:], self.top + 1) - 1
        at = balance - self.value  # the opening that now stands at the balance
        inside = ~self.fixed & (at > self.start) & (at <= last)
        if inside.any():
            where = np.flatnonzero(inside) + 1
            self.start = np.insert(self.start, where, at[inside])
            self.fixed = np.insert(self.fixed, where, False)
            self.value = np.insert(self.value, where, self.value[inside])

    def _now(self) -> np.ndarray:
        """The balance at the start of each piece."""
        return np.where(self.fixed, self.value, self.start + self.value)

    def _merge(self) -> None:
        same = (self.fixed[1:] == self.fixed[:-1]) & (self.value[1:] == self.value[:-1])
        keep = np.concatenate(([True], ~same))
        self.start, self.fixed, self.value = self.start[keep], self.fixed[keep], self.value[keep]

    def refill(self, units: int) -> None:
        if units >= self.top:  # everybody is full
            self.__init__(self.top)
            self.fixed[:], self.value[:] = True, self.top
            return
        self._split(self.top - units)
        full = self._now() >= self.top - units
        self.value = np.where(full, self.top, self.value + units)
        self.fixed = self.fixed | full
        self._merge()

    def spend(self, units: int) -> None:
        self._split(units)
        self.value = np.where(self._now() >= units, self.value - units, self.value)
        self._merge()

    def pack(self) -> bytes:
        numbers = ([self.start.size], self.start, self.fixed, self.value)
        return np.concatenate([np.asarray(n, np.int64) for n in numbers]).tobytes()

    @staticmethod
    def closing(packed: bytes, opening: int) -> int:
        numbers = np.frombuffer(packed, np.int64)
        n = int(numbers[0])
        piece = int(np.searchsorted(numbers[1 : 1 + n], opening, side="right")) - 1
        value = int(numbers[1 + 2 * n + piece])
        return value if numbers[1 + n + piece] else opening + value


def _segment_balance(
    rule: str, seg: pd.DataFrame, entry: tuple | None, default_max: int, rate: int
) -> tuple[int | None, bytes]:
    """A segment's closing balance, or its pieces from opening to closing balance."""
    sets = np.flatnonzero(seg["kind"].to_numpy() != QUERY)
    if sets.size or entry is None:
        fold = _Fold(rule, default_max, rate)
        if sets.size:
            seg = seg.iloc[int(sets[-1]) :]
            fold.set(int(seg["at_s"].iloc[0]), int(seg["cents"].iloc[0]), int(seg["set_units"].iloc[0]))
            seg = seg.iloc[1:]
        else:
            fold.create(int(seg["at_s"].iloc[0]))
        for at, cents in zip(seg["at_s"].tolist(), seg["cents"].tolist()):
            fold.query(at, cents)
        return fold.units, b""
    last, fresh, max_cents = entry
    unit = UNITS_PER_CENT[rule]
    pieces = _Pieces(max_cents * unit)
    for at, cents in zip(seg["at_s"].tolist(), seg["cents"].tolist()):
        if _ignored(rule, cents, max_cents):
            continue
        elapsed = at - last
        if _clock_moves(rule, elapsed, fresh):
            pieces.refill(_refill(rule, elapsed, fresh, max_cents, rate))
            last = at
        fresh = False
        pieces.spend(cents * unit)
    return None, pieces.pack()


_CLOCK_SCHEMA = (
    "holder {h}, part bigint, first_s bigint, touched boolean, known boolean, last_s bigint, "
    "fresh boolean, `table` binary, table_fresh binary"
)
_BALANCE_SCHEMA = "holder {h}, part bigint, units bigint, `table` binary"


def _segments(batches: Iterator[pd.DataFrame]) -> dict:
    """Collect the (at most two) spanning segments of a partition."""
    collected: dict = {}
    for pdf in batches:
        for key, rows in pdf.groupby(["holder", "_part"], sort=False):
            collected.setdefault(key, []).append(rows)
    return {key: pd.concat(rows, ignore_index=True) for key, rows in collected.items()}


def _opening_states(placed: DataFrame, rule: str, default_max: int, rate: int) -> dict:
    """State at the start of every partition that continues a holder."""
    holder_type = dict(placed.dtypes)["holder"]
    maximum = F.max_by(F.when(F.col("kind") != QUERY, F.col("cents")), F.when(F.col("kind") != QUERY, F.col("_row")))
    segments = placed.groupBy("holder", "_part").agg(maximum.alias("set_max"))
    spanning = segments.groupBy("holder").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    by_part = Window.partitionBy("holder").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a partition boundary cuts at most one holder: no more rows than twice the partitions
    chain = (
        segments.join(spanning.select("holder"), "holder", "left_semi")
        .withColumn("max_in", F.coalesce(F.last("set_max", ignorenulls=True).over(by_part), F.lit(default_max)))
        .withColumn("begins", F.row_number().over(Window.partitionBy("holder").orderBy("_part")) == 1)
        .select("holder", "_part", "max_in", "begins")
        .collect()
    )
    if not chain:
        return {}
    begins = {(r["holder"], r["_part"]): (r["max_in"], r["begins"]) for r in chain}
    wanted = placed.sparkSession.createDataFrame(
        [(r["holder"], r["_part"]) for r in chain], f"holder {holder_type}, _part bigint"
    )
    rows = placed.join(F.broadcast(wanted), ["holder", "_part"], "left_semi").select(
        "holder", "_part", "kind", "at_s", "cents", "set_units"
    )

    def clock(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, seg in _segments(batches).items():
            summary = _segment_clock(rule, seg, *begins[key])
            yield pd.DataFrame([{"holder": key[0], "part": key[1], **summary}])

    def chain_clock(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, last, fresh = [], 0, False
        for r in pdf.sort_values("part").itertuples():
            out.append((r.holder, r.part, last, fresh))
            if r.known:
                last, fresh = r.last_s, r.fresh
            else:
                table = r.table_fresh if fresh else r.table
                last = r.first_s + _look_up(table, max(HOUR - (r.first_s - last), 0))
                fresh = fresh and not r.touched
        return pd.DataFrame(out, columns=["holder", "part", "last_s", "fresh"])

    clocks = rows.mapInPandas(clock, _CLOCK_SCHEMA.format(h=holder_type))
    entries = {
        (r["holder"], r["part"]): (r["last_s"], r["fresh"], begins[r["holder"], r["part"]][0])
        for r in clocks.groupBy("holder")
        .applyInPandas(chain_clock, f"holder {holder_type}, part bigint, last_s bigint, fresh boolean")
        .collect()
    }

    def balance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, seg in _segments(batches).items():
            entry = None if begins[key][1] else entries[key]
            units, table = _segment_balance(rule, seg, entry, default_max, rate)
            row = {"holder": key[0], "part": key[1], "units": units, "table": table}
            yield pd.DataFrame([row]).astype({"units": "Int64"})

    def chain_balance(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, units = [], 0
        for r in pdf.sort_values("part").itertuples():
            out.append((r.holder, r.part, units))
            if len(r.table):
                units = _Pieces.closing(r.table, units)
            else:
                units = int(r.units)
        return pd.DataFrame(out, columns=["holder", "part", "units"])

    balances = rows.mapInPandas(balance, _BALANCE_SCHEMA.format(h=holder_type))
    opened = {}
    for r in (
        balances.groupBy("holder")
        .applyInPandas(chain_balance, f"holder {holder_type}, part bigint, units bigint")
        .collect()
    ):
        key = (r["holder"], r["part"])
        if not begins[key][1]:
            last, fresh, max_cents = entries[key]
            opened[r["part"]] = (last, fresh, max_cents, r["units"])
    return opened


# ------------------------------------------------------------------ public operators
def fold_events(
    events: DataFrame,
    rule: str = "hourly",
    max_cents: int = K.DEFAULT_BUDGET_CENTS,
    refill_cents: int = K.HOURLY_REFILL_CENTS,
) -> DataFrame:
    """Decide every event of a normalized event table.

    Adds: accepted (null for resets), refill_units, before_units (after the
    refill, before spending), remaining_units, max_cents, last_refill_s.
    """
    if rule not in UNITS_PER_CENT:
        raise ValueError(f"rule is one of {list(UNITS_PER_CENT)}")
    placed = in_global_order(events, ["holder", "at_us", "kind", "event_id"])
    opened = _opening_states(placed, rule, max_cents, refill_cents)
    schema = ", ".join(f"{n} {t}" for n, t in placed.dtypes if n not in ("_part", "_row"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _fold_partition(batches, rule, max_cents, refill_cents, opened)

    return placed.mapInArrow(decide, f"{schema}, {_FOLD_COLUMNS}")


def epsilon(units: str, rule: str = "hourly"):
    """Units as epsilon."""
    return F.col(units) / F.lit(100.0 * UNITS_PER_CENT[rule])


def ledger_fold(
    queries: DataFrame,
    holder: str = "user_id",
    rule: str = "hourly",
    max_cents: int = K.DEFAULT_BUDGET_CENTS,
    refill_cents: int = K.HOURLY_REFILL_CENTS,
    resets: DataFrame | None = None,
    opening: DataFrame | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Accept or refuse every query of a log against its holder's budget; ``carry`` as in ``normalize``."""
    events = normalize(queries, holder, resets, opening, rule, carry)
    return fold_events(events, rule, max_cents, refill_cents)


def decisions(folded: DataFrame, holder: str = "user_id", rule: str = "hourly") -> DataFrame:
    """Query decisions with amounts in epsilon, and the columns carried through the fold."""
    return folded.where(F.col("kind") == QUERY).select(
        F.col("holder").alias(holder),
        F.col("event_id").alias("query_id"),
        F.timestamp_micros("at_us").alias("ts"),
        "query_type",
        (F.col("cents") / F.lit(100.0)).alias("epsilon_cost"),
        "accepted",
        epsilon("refill_units", rule).alias("refill"),
        epsilon("remaining_units", rule).alias("epsilon_remaining"),
        (F.col("max_cents") / F.lit(100.0)).alias("max_epsilon"),
        *(["carried.*"] if "carried" in folded.columns else []),
    )


def transactions(folded: DataFrame, holder: str = "user_id", rule: str = "hourly") -> DataFrame:
    """Accepted queries only: the transaction log."""
    return decisions(folded, holder, rule).where("accepted").drop("accepted")


def refills(folded: DataFrame, holder: str = "user_id", rule: str = "hourly") -> DataFrame:
    """Refill log: automatic refills that added something, and every admin reset."""
    logged = (F.col("kind") == RESET) | ((F.col("kind") == QUERY) & (F.col("refill_units") > 0))
    before = F.when(F.col("kind") == RESET, F.col("before_units")).otherwise(
        F.col("before_units") - F.col("refill_units")
    )
    unit = F.lit(100.0 * UNITS_PER_CENT[rule])
    return folded.where(logged).select(
        F.col("holder").alias(holder),
        F.timestamp_micros("at_us").alias("ts"),
        (F.col("refill_units") / unit).alias("refill_amount"),
        (before / unit).alias("epsilon_before"),
        ((before + F.col("refill_units")) / unit).alias("epsilon_after"),
        F.when(F.col("kind") == RESET, "ADMIN").otherwise("AUTOMATIC").alias("refill_type"),
    )


def ledgers(folded: DataFrame) -> DataFrame:
    """Final state per holder; max_by combines on the map side, so no holder is gathered."""
    state = F.struct("max_cents", "remaining_units", "last_refill_s")
    order = F.struct("at_us", "kind", "event_id")
    real = F.when(F.col("kind") != OPEN, F.col("at_us"))
    closing = folded.groupBy("holder").agg(
        F.max_by(state, order).alias("s"),
        F.count_if(F.col("accepted")).alias("queries"),
        F.timestamp_micros(F.max(F.when(F.col("accepted"), F.col("at_us")))).alias("last_query"),
        F.timestamp_micros(F.min(real)).alias("created_at"),
    )
    return closing.select("holder", "s.*", "queries", "last_query", "created_at")


def ledger_table(folded: DataFrame, holder: str = "user_id", rule: str = "hourly") -> DataFrame:
    """Ledgers in epsilon: remaining, maximum, last refill, query count."""
    return ledgers(folded).select(
        F.col("holder").alias(holder),
        (F.col("max_cents") / F.lit(100.0)).alias("max_epsilon"),
        epsilon("remaining_units", rule).alias("epsilon_remaining"),
        F.timestamp_seconds("last_refill_s").alias("last_refill"),
        F.col("queries").alias("total_queries"),
        "last_query",
        "created_at",
    )


def open_ledgers(users: DataFrame, existing: DataFrame, user: str = "user_id", max_epsilon: float = 10.0) -> DataFrame:
    """Existing ledgers, and a full one for every user who has none."""
    created = users.select(user).distinct().join(existing.select(user), user, "left_anti")
    full = created.select(
        user, F.lit(max_epsilon).alias("max_epsilon"), F.lit(max_epsilon).alias("epsilon_remaining")
    )
    return existing.select(user, "max_epsilon", "epsilon_remaining").unionByName(full)


def reset_all(ledger: DataFrame, epsilon_value: float, at: str) -> DataFrame:
    """Every ledger full at a new maximum; one projection."""
    value = F.lit(float(epsilon_value))
    return (
        ledger.withColumn("max_epsilon", value)
        .withColumn("epsilon_remaining", value)
        .withColumn("last_refill", F.lit(at).cast("timestamp"))
    )


def team_holder(queries: DataFrame, memberships: DataFrame, teams: DataFrame, user: str = "user_id") -> DataFrame:
    """Add ``holder``: the team for members of teams with a shared budget, else the user."""
    shared = memberships.join(teams.where("shared_budget").select("team_id"), "team_id").select(user, "team_id")
    joined = skew.look_up(queries, shared, user)
    holder = F.when(F.col("team_id").isNotNull(), F.concat(F.lit("team:"), F.col("team_id").cast("string")))
    return joined.withColumn(
        "holder", F.coalesce(holder, F.concat(F.lit("user:"), F.col(user).cast("string")))
    ).drop("team_id")
