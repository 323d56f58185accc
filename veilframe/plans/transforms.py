"""Queries for value transformations and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import keyed, masks, parse, randomized, ranges
from ..operators import anonymize
from .base import (
    DEMOGRAPHIC_SQL, PEOPLE_SQL, SECRET, demographic, digest_sql, hex_sql, laplace_sql, people,
    pick_sql, pool_noise_sql, query, quoted, table, uniform_of_sql, uniform_sql,
)


# ------------------------------------------------------------------ hashes and masks
@query(
    "hash_identifier",
    "SELECT c_custkey, substr(sha256(c_name), 1, length(c_name)) AS name_hash, "
    "substr(sha256(CAST(c_custkey AS VARCHAR)), 1, length(CAST(c_custkey AS VARCHAR))) AS key_hash FROM customer",
)
def hash_identifier(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        masks.hash_keep_length(F.col("c_name")).alias("name_hash"),
        masks.hash_keep_length(F.col("c_custkey")).alias("key_hash"),
    )


@query(
    "pseudonymize_names",
    f"WITH {PEOPLE_SQL} SELECT id, concat('Person_', lpad(CAST(CAST(concat('0x', substr(sha256(full_name), 1, 16)) "
    "AS UBIGINT) % 100000 AS VARCHAR), 5, '0')) AS person FROM people",
)
def pseudonymize_names(spark, sf):
    return people(spark, sf).select("id", masks.pseudonym(F.col("full_name")).alias("person"))


_MASK_EMAIL_SQL = (
    "CASE WHEN strpos({c}, '@') > 0 THEN concat(substr(substr({c}, 1, strpos({c}, '@') - 1), 1, 2), "
    "repeat('*', greatest(1, strpos({c}, '@') - 3)), substr({c}, strpos({c}, '@'))) ELSE '[MASKED]' END"
)
# every kind of address: as given, with a second @, one-letter local part, none at all
_ADDRESS = (
    "CASE id % 4 WHEN 0 THEN email WHEN 1 THEN concat(email, '@relay') "
    "WHEN 2 THEN concat('x@', CAST(id AS STRING), '.org') ELSE full_name END"
)


@query(
    "mask_email",
    f"WITH {PEOPLE_SQL}, a AS (SELECT id, {_ADDRESS} AS address FROM people) "
    f"SELECT id, {_MASK_EMAIL_SQL.format(c='address')} AS masked FROM a",
)
def mask_email(spark, sf):
    addresses = people(spark, sf).selectExpr("id", f"{_ADDRESS} AS address")
    return addresses.select("id", masks.mask_email(F.col("address")).alias("masked"))


_PHONE = (
    "CASE id % 3 WHEN 0 THEN phone WHEN 1 THEN concat('(', substring(phone, 2, 3), ') ', substring(phone, 5, 4), "
    "'-', substring(phone, 9, 5)) ELSE substring(phone, 1, 8) END"
)


@query(
    "mask_phone",
    f"WITH {PEOPLE_SQL}, a AS (SELECT id, {_PHONE} AS p FROM people), "
    "b AS (SELECT id, translate(p, '-() ', '') AS p FROM a) "
    "SELECT id, CASE WHEN length(p) >= 10 THEN concat(repeat('*', length(p) - 4), right(p, 4)) "
    "ELSE '[MASKED]' END AS masked FROM b",
)
def mask_phone(spark, sf):
    return people(spark, sf).selectExpr("id", f"{_PHONE} AS p").select(
        "id", masks.mask_phone(F.col("p")).alias("masked")
    )


@query(
    "mask_aadhaar",
    f"WITH {DEMOGRAPHIC_SQL}, d AS (SELECT record_id, aadhaar, regexp_replace(aadhaar, '[^0-9]', '', 'g') AS g "
    "FROM demographic) SELECT record_id, CASE WHEN length(g) < 4 THEN repeat('X', length(aadhaar)) "
    "WHEN strpos(aadhaar, ' ') > 0 THEN concat('XXXX XXXX ', right(g, 4)) "
    "ELSE concat(repeat('X', length(g) - 4), right(g, 4)) END AS masked FROM d",
)
def mask_aadhaar(spark, sf):
    return demographic(spark, sf).select("record_id", masks.mask_aadhaar(F.col("aadhaar")).alias("masked"))


@query(
    "mask_pan",
    f"WITH {DEMOGRAPHIC_SQL}, d AS (SELECT record_id, upper(trim(pan)) AS p FROM demographic) "
    "SELECT record_id, CASE WHEN length(p) = 10 THEN concat(substr(p, 1, 5), '****', right(p, 1)) "
    "WHEN length(p) > 6 THEN concat(substr(p, 1, 3), repeat('*', length(p) - 6), right(p, 3)) "
    "ELSE repeat('*', length(p)) END AS masked FROM d",
)
def mask_pan(spark, sf):
    return demographic(spark, sf).select("record_id", masks.mask_pan(F.col("pan")).alias("masked"))


@query(
    "anonymize_district",
    f"WITH {DEMOGRAPHIC_SQL} SELECT record_id, concat('District ', CAST({hex_sql('substr(md5(lower(district)), 1, 8)')} "
    "% 10 + 1 AS VARCHAR)) AS alias FROM demographic",
)
def anonymize_district(spark, sf):
    return demographic(spark, sf).select("record_id", masks.district_alias(F.col("district")).alias("alias"))


@query(
    "hash_java32",
    f"WITH {PEOPLE_SQL}, h AS (SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), "
    "list_transform(string_split(full_name, ''), lambda x: CAST(ascii(x) AS BIGINT))), "
    "lambda a, b: (a * 31 + b) & 4294967295) AS h FROM people) "
    "SELECT id, concat('hash_', lower(printf('%x', abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)))) "
    "AS hashed FROM h",
)
def hash_java32(spark, sf):
    return people(spark, sf).select("id", masks.java_hash(F.col("full_name")).alias("hashed"))


# ------------------------------------------------------------------ generalization
@query(
    "generalize_date",
    r"SELECT doc_id, CASE WHEN regexp_matches(text, '(^|[^\pL\pN\pM_])(19|20)[0-9]{2}($|[^\pL\pN\pM_])') "
    r"THEN regexp_extract(text, '(?:^|[^\pL\pN\pM_])((?:19|20)[0-9]{2})(?:$|[^\pL\pN\pM_])', 1) "
    "ELSE '[DATE]' END AS year FROM documents",
)
def generalize_date(spark, sf):
    return table(spark, sf, "documents").select("doc_id", masks.generalize_date(F.col("text")).alias("year"))


@query(
    "generalize_location",
    f"WITH {PEOPLE_SQL} SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE '[REGION]' END AS region FROM people",
)
def generalize_location(spark, sf):
    places = people(spark, sf).selectExpr("id", "CASE WHEN id % 9 = 0 THEN NULL ELSE gps END AS gps")
    return places.select("id", masks.generalize_location(F.col("gps")).alias("region"))


@query(
    "generalize_categories",
    f"WITH {DEMOGRAPHIC_SQL} SELECT record_id, CASE WHEN (SELECT count(DISTINCT state) FROM demographic) > 10 "
    "THEN '[CATEGORY]' ELSE state END AS state, CASE WHEN (SELECT count(DISTINCT gender) FROM demographic) > 10 "
    "THEN '[CATEGORY]' ELSE gender END AS gender FROM demographic",
)
def generalize_categories(spark, sf):
    rows = demographic(spark, sf).select("record_id", "state", "gender")
    return anonymize.generalize_categories(anonymize.generalize_categories(rows, "state"), "gender")


def _ladder_sql(value: str, steps, top: str, first_open: bool) -> str:
    parts = []
    for i, (bound, label) in enumerate(steps):
        sign = "<" if first_open and i == 0 else "<="
        parts.append(f"WHEN {value} {sign} {bound} THEN {quoted(label)}")
    return f"CASE {' '.join(parts)} ELSE {quoted(top)} END"


@query(
    "bucket_age",
    f"WITH {DEMOGRAPHIC_SQL} SELECT record_id, {_ladder_sql('age', K.AGE_RANGES, K.AGE_TOP, False)} AS age_range "
    "FROM demographic",
)
def bucket_age(spark, sf):
    return demographic(spark, sf).select("record_id", ranges.age_range(F.col("age")).alias("age_range"))


@query(
    "bucket_income",
    f"WITH {DEMOGRAPHIC_SQL} SELECT record_id, "
    f"{_ladder_sql('monthly_income', K.INCOME_RANGES, K.INCOME_TOP, True)} AS income_range FROM demographic",
)
def bucket_income(spark, sf):
    return demographic(spark, sf).select("record_id", ranges.income_range(F.col("monthly_income")).alias("income_range"))


@query(
    "bucket_household",
    "SELECT p_partkey, " + _ladder_sql("p_size", K.HOUSEHOLD_RANGES, K.HOUSEHOLD_TOP, False) + " AS size_range FROM part",
)
def bucket_household(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ranges.household_range(F.col("p_size")).alias("size_range"))


@query(
    "bucket_land",
    f"WITH {DEMOGRAPHIC_SQL} SELECT record_id, "
    f"{_ladder_sql('land_owned_acres', K.LAND_RANGES, K.LAND_TOP, True)} AS land_range FROM demographic",
)
def bucket_land(spark, sf):
    return demographic(spark, sf).select("record_id", ranges.land_range(F.col("land_owned_acres")).alias("land_range"))


@query(
    "bucket_equal_width",
    "WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) "
    "SELECT o_orderkey, round(lo + (least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) + 0.5) * ((hi - lo) / 10), 2) "
    "AS bucket FROM orders, b",
)
def bucket_equal_width(spark, sf):
    return anonymize.bucket_equal_width(table(spark, sf, "orders"), "o_totalprice", "bucket").select(
        "o_orderkey", "bucket"
    )


# ------------------------------------------------------------------ randomized response
_RR_BOOL = digest_sql("rr_boolean", "urgent", "o_orderkey")


@query(
    "rr_boolean",
    f"SELECT o_orderkey, CASE WHEN {uniform_of_sql(_RR_BOOL, 0)} < 0.75 THEN o_orderpriority = '1-URGENT' "
    f"ELSE {uniform_of_sql(_RR_BOOL, 1)} < 0.5 END AS answer FROM orders",
)
def rr_boolean(spark, sf):
    orders = table(spark, sf, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return orders.select(
        "o_orderkey", randomized.rr_boolean(urgent, SECRET, "urgent", F.col("o_orderkey")).alias("answer")
    )


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_RR_CAT = digest_sql("rr_categorical", "status", "c_custkey")
_RR_CAT_SQL = (
    f"CASE WHEN {uniform_of_sql(_RR_CAT, 0)} < 0.75 THEN c_mktsegment "
    f"ELSE {pick_sql(SEGMENTS, uniform_of_sql(_RR_CAT, 1))} END"
)


@query("rr_categorical", f"SELECT c_custkey, {_RR_CAT_SQL} AS answer FROM customer")
def rr_categorical(spark, sf):
    customer = table(spark, sf, "customer")
    answer = randomized.rr_categorical(F.col("c_mktsegment"), SEGMENTS, SECRET, "status", F.col("c_custkey"))
    return customer.select("c_custkey", answer.alias("answer"))


@query(
    "rr_estimate",
    f"WITH a AS (SELECT {_RR_CAT_SQL} AS answer FROM customer), "
    "c AS (SELECT answer, count(*) AS observed FROM a GROUP BY answer) "
    "SELECT answer, observed, round(observed / (SELECT sum(observed) FROM c), 6) AS observed_share, "
    "round((observed / (SELECT sum(observed) FROM c) - 0.25 / 5) / 0.75, 6) AS estimated_share FROM c",
)
def rr_estimate(spark, sf):
    estimated = anonymize.estimate_shares(rr_categorical(spark, sf), "answer", len(SEGMENTS))
    return estimated.select(
        "answer",
        "observed",
        F.round("observed_share", 6).alias("observed_share"),
        F.round("estimated_share", 6).alias("estimated_share"),
    )


_KANON_K = 5
_KANON_DIGEST = digest_sql("k_anonymity", "age", "record_id")


def _k_anonymity_sql(source_cte: str, source: str, key: str, column: str, k: int) -> str:
    digest = digest_sql("k_anonymity", column, key)
    return (
        f"WITH {source_cte}, counts AS (SELECT {column} AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL "
        f"GROUP BY {column}), cats AS (SELECT v, n, row_number() OVER (ORDER BY v) - 1 AS i FROM counts), "
        f"drawn AS (SELECT s.{key}, s.{column}, n, {uniform_of_sql(digest, 0)} AS u, "
        f"CAST(floor({uniform_of_sql(digest, 1)} * (SELECT count(*) FROM cats)) AS BIGINT) AS target "
        f"FROM {source} s LEFT JOIN cats ON s.{column} = cats.v) "
        f"SELECT d.{key}, CASE WHEN d.n < {k} AND d.u >= 0.75 THEN c.v ELSE d.{column} END AS {column} "
        f"FROM drawn d LEFT JOIN cats c ON c.i = d.target"
    )


_ORDER_PLACES = (
    "places AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'metropolis' "
    "WHEN o_orderkey % 11 = 5 THEN NULL ELSE concat('village ', CAST(o_custkey * 3 AS STRING)) END AS place FROM orders)"
)


@query("k_anonymity_column", _k_anonymity_sql(_ORDER_PLACES, "places", "o_orderkey", "place", 12))
def k_anonymity_column(spark, sf):
    # one place holds a third of all rows, the others are rare
    places = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'metropolis' WHEN o_orderkey % 11 = 5 THEN NULL "
        "ELSE concat('village ', CAST(o_custkey * 3 AS STRING)) END AS place",
    )
    return anonymize.k_anonymize(places, "place", 12, SECRET, "o_orderkey")


# ------------------------------------------------------------------ noise
@query(
    "noise_discrete_pool",
    f"SELECT o_orderkey, {pool_noise_sql('o_totalprice', 'totalprice', 'o_orderkey')} AS totalprice, "
    f"{pool_noise_sql('CAST(o_custkey % 100 - 2 AS DOUBLE)', 'years', 'o_orderkey')} AS years FROM orders",
)
def noise_discrete_pool(spark, sf):
    key = F.col("o_orderkey")
    years = (F.col("o_custkey") % 100 - 2).cast("double")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        randomized.pool_noise(F.col("o_totalprice"), "totalprice", SECRET, key).alias("totalprice"),
        randomized.pool_noise(years, "years", SECRET, key).alias("years"),
    )


@query(
    "noise_numeric_column",
    f"SELECT event_id, {pool_noise_sql('value', 'amount', 'event_id')} AS amount, round_even(value, 1) AS score, "
    "CAST(0 AS BIGINT) AS empty FROM events",
)
def noise_numeric_column(spark, sf):
    # money takes noise, scores are rounded, an all-zero column stays
    rows = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("amount"), F.col("value").alias("score"), F.lit(0.0).alias("empty")
    )
    for column in ("amount", "score", "empty"):
        rows = anonymize.release_numeric(rows, column, SECRET, "event_id")
    return rows


@query(
    "noise_laplace_record",
    "SELECT event_id, printf('%.2f', value + "
    + laplace_sql(uniform_sql("laplace_record", "value", "event_id"), "1.0 / 0.5")
    + ") AS noisy, event_type AS unchanged FROM events",
)
def noise_laplace_record(spark, sf):
    key = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id",
        randomized.laplace_record(F.col("value").cast("string"), 0.5, SECRET, "value", key).alias("noisy"),
        randomized.laplace_record(F.col("event_type"), 0.5, SECRET, "event_type", key).alias("unchanged"),
    )


_MESSY = (
    "CASE id % 6 WHEN 0 THEN concat(' $', CAST(id AS STRING), ',000.5 ') WHEN 1 THEN CAST(salary AS STRING) "
    "WHEN 2 THEN concat(CAST(id AS STRING), 'd') WHEN 3 THEN full_name WHEN 4 THEN concat('-', CAST(id AS STRING), 'e2') "
    "ELSE concat(CAST(id AS STRING), '_000') END"
)


@query(
    "safe_numeric",
    f"WITH {PEOPLE_SQL}, m AS (SELECT id, trim(translate({_MESSY}, '$,', '')) AS t FROM people) "
    f"SELECT id, CASE WHEN regexp_matches(t, {quoted(parse.FLOAT_PATTERN)}) THEN CAST(replace(t, '_', '') AS DOUBLE) "
    "END AS number FROM m",
)
def safe_numeric(spark, sf):
    messy = people(spark, sf).selectExpr("id", f"{_MESSY} AS t")
    return messy.select("id", parse.safe_numeric(F.col("t")).alias("number"))


# ------------------------------------------------------------------ seeded noise
SEED_KEY = "noise-key"


def seed_sql(query_id: str, window: str) -> str:
    block = SEED_KEY.encode().ljust(64, b"\0")
    inner = "".join(f"{b ^ 0x36:02X}" for b in block)
    outer = "".join(f"{b ^ 0x5C:02X}" for b in block)
    message = f"encode(concat(CAST({query_id} AS VARCHAR), '||', {window}))"
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


_DAY_WINDOW = "strftime(ts, '%Y-%m-%d-00')"
_EVENT_SEED = seed_sql("event_id", _DAY_WINDOW)


@query(
    "seed_window",
    "SELECT event_id, strftime(ts, '%Y-%m-%d-00') AS daily, strftime(ts, '%Y-%m-%d-%H') AS hourly, "
    "strftime(ts, '%Y-W%U') AS weekly, concat('bucket-', CAST(epoch_us(ts) // 3600000000 // 6 AS VARCHAR)) AS custom, "
    f"{hex_sql(f'substr({_EVENT_SEED}, 1, 8)')} AS seed FROM events",
)
def seed_window(spark, sf):
    ts = F.col("ts").cast("timestamp")
    daily = keyed.rotation_window(ts, 24)
    return table(spark, sf, "events").select(
        "event_id",
        daily.alias("daily"),
        keyed.rotation_window(ts, 1).alias("hourly"),
        keyed.rotation_window(ts, 168).alias("weekly"),
        keyed.rotation_window(ts, 6).alias("custom"),
        keyed.seed32(keyed.seed_digest(SEED_KEY, F.col("event_id"), daily)).alias("seed"),
    )
