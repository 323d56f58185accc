"""Anonymization inside JSON documents.

The schema is found by a distributed aggregate; then one expression per key is generated
by walking it and the document is written anew, so the rewrite is a projection without
Python. Values are read as variants by their exact keys: absent keys stay absent, explicit
nulls stay null, keys that differ in case stay apart, and a key that holds values of several
types has each of them treated by its own type (lists and objects there are hashed as
text). Documents that are objects, lists and plain values may stand in one column: each kind is
treated by itself, plain values are hashed. That plan grows with the number of different keys.

Documents whose keys are data themselves (ids, for example) take ``anonymize_json_ragged``: one
expression walks every document by its own keys, and the plan grows with the depth of the documents alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import keyed, masks, parse
from ..functions.randomized import pool_noise


# A type stands after a colon, or as a list's element; elsewhere the same word is a key.
_TYPE_AT = r"(?:(?<=: )|(?<=ARRAY<)|(?<=^))"


def opens_with(c: Column) -> Column:
    """The first character of a JSON text that is no blank: it tells objects from lists from plain values."""
    return F.substring(F.ltrim(F.translate(c, "\t\n\r", "   ")), 1, 1)


def infer_types(df: DataFrame, column: str) -> tuple[T.DataType, T.DataType]:
    """Union schemas of the objects and of the lists of a JSON text column (one aggregate, no sampling).

    Keys with values of several types are VARIANT, keys that are always null VOID, as is a schema without documents.
    """
    text = F.col(f"`{column}`")
    parsed = F.try_parse_json(text)
    kinds = [F.schema_of_variant_agg(F.when(opens_with(text) == start, parsed)) for start in "{["]
    found = [s or "VOID" for s in df.agg(*kinds).first()]
    return tuple(T._parse_datatype_string(re.sub(_TYPE_AT + "OBJECT<", "STRUCT<", s)) for s in found)


def infer_schema(df: DataFrame, column: str) -> T.DataType:
    """The union schema of the objects for reading rows: keys of several types and null keys are text."""

    def plain(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, plain(f.dataType)) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(plain(t.elementType))
        return T.StringType() if isinstance(t, (T.VariantType, T.NullType)) else t

    return plain(infer_types(df, column)[0])


def _rewrite_text(c: Column, key: str, secret: str, row_key: Column) -> Column:
    digits = F.translate(c, "- ()", "")
    number = parse.float_text(c)
    if parse.has_any(key, K.JSON_NAME_KEYS):
        by_key = masks.pseudonym(c)
    elif parse.has_any(key, K.JSON_AADHAAR_KEYS):
        by_key = masks.mask_aadhaar(c)
    elif parse.has_any(key, K.JSON_PAN_KEYS):
        by_key = masks.mask_pan(c)
    elif parse.has_any(key, K.JSON_HASH_KEYS):
        by_key = masks.hash_keep_length(c)
    elif parse.has_any(key, K.JSON_KEEP_KEYS):
        by_key = c
    else:
        noisy = pool_noise(number, key, secret, row_key).cast("string")
        by_key = F.when(number.isNotNull(), noisy).otherwise(c)
    return (
        F.when(c.contains("@") & c.contains("."), masks.mask_email(c))
        .when(digits.rlike(r"(?U)^\d{10,}$"), masks.mask_phone(c))
        .otherwise(by_key)
    )


def rewrite(c: Column, data_type: T.DataType, secret: str, row_key: Column, key: str = "", path: str = "$") -> Column:
    """Expression that anonymizes a value of the given type; lists keep their parent's key."""
    if isinstance(data_type, T.StructType):
        fields = [
            rewrite(c.getField(f.name), f.dataType, secret, row_key, f.name.lower(), f"{path}.{f.name}").alias(f.name)
            for f in data_type.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(data_type, T.ArrayType):
        return F.transform(
            c,
            lambda item, i: rewrite(
                item,
                data_type.elementType,
                secret,
                F.concat(row_key, F.lit("|"), i.cast("string")),
                key,
                f"{path}[]",
            ),
        )
    located = F.concat(row_key, F.lit(f"|{path}"))
    if isinstance(data_type, T.StringType):
        return F.when(c.isNotNull(), _rewrite_text(c, key, secret, located))
    if isinstance(data_type, T.BooleanType):
        return pool_noise(c.cast("int").cast("double"), key, secret, located)
    if isinstance(data_type, T.NumericType):
        return pool_noise(c.cast("double"), key, secret, located)
    return c


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _member(v: Column, name: str) -> Column:
    """The value under a key, absent as null."""
    for quote in "'", '"':
        if quote not in name and "\\" not in name:
            return F.try_variant_get(v, f"$[{quote}{name}{quote}]", "variant")
    return F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), name)


def _once(c: Column, use) -> Column:
    """``use`` of a value that is computed once a row, however often it stands in the expression."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _document(v: Column, t: T.DataType, secret: str, row_key: Column, key: str, path: str) -> Column:
    """The JSON text of a variant with its values anonymized; null where the variant is absent."""
    located = F.concat(row_key, F.lit(f"|{path}"))
    if isinstance(t, T.StructType):
        def member(f: T.StructField) -> Column:
            label = F.concat(_quoted(F.lit(f.name)), F.lit(":"))
            below = f.dataType, secret, row_key, f.name.lower(), f"{path}.{f.name}"
            return _once(_member(v, f.name), lambda x: F.when(x.isNotNull(), F.concat(label, _document(x, *below))))

        members = [member(f) for f in t.fields]
        text = F.concat(F.lit("{"), F.array_join(F.array(*members) if members else F.array().cast("array<string>"), ","), F.lit("}"))
    elif isinstance(t, T.ArrayType):
        items = F.transform(
            F.try_variant_get(v, "$", "array<variant>"),
            lambda item, i: F.coalesce(
                _document(item, t.elementType, secret, F.concat(row_key, F.lit("|"), i.cast("string")), key, f"{path}[]"),
                F.lit("null"),
            ),
        )
        text = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    elif isinstance(t, T.StringType):
        text = _quoted(_once(F.try_variant_get(v, "$", "string"), lambda c: _rewrite_text(c, key, secret, located)))
    elif isinstance(t, T.BooleanType):
        text = pool_noise(F.try_variant_get(v, "$", "boolean").cast("int").cast("double"), key, secret, located).cast("string")
    elif isinstance(t, T.NumericType):
        text = pool_noise(F.try_variant_get(v, "$", "double"), key, secret, located).cast("string")
    elif isinstance(t, T.VariantType):
        kind = F.schema_of_variant(v)
        text = F.when(kind == "STRING", _document(v, T.StringType(), secret, row_key, key, path))
        text = text.when(kind == "BOOLEAN", _document(v, T.BooleanType(), secret, row_key, key, path))
        text = text.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _document(v, T.DoubleType(), secret, row_key, key, path))
        text = text.otherwise(_quoted(masks.hash_keep_length(F.to_json(v))))
    else:
        text = F.lit("null")
    return F.when(F.is_variant_null(v), F.lit("null")).when(v.isNotNull(), text)


def anonymize_json(df: DataFrame, column: str, secret: str, key: str, schema: T.DataType | None = None) -> DataFrame:
    """Rewrite a JSON text column, or a struct or list column; text that is no JSON is hashed."""
    nested = df.schema[column].dataType
    value, row_key = F.col(f"`{column}`"), F.col(f"`{key}`").cast("string")
    if isinstance(nested, (T.StructType, T.ArrayType)):
        return df.withColumn(column, rewrite(value, nested, secret, row_key))
    parsed, start = F.try_parse_json(value), opens_with(value)
    plain = masks.hash_keep_length(value)
    if schema is not None:
        return df.withColumn(column, F.when(parsed.isNotNull(), _document(parsed, schema, secret, row_key, "", "$")).otherwise(plain))
    kinds = [(k, t) for k, t in zip("{[", infer_types(df, column)) if isinstance(t, (T.StructType, T.ArrayType))]
    if not kinds:
        return df.withColumn(column, plain)
    rewritten = F.when(F.is_variant_null(parsed), F.lit("null"))
    for kind, data_type in kinds:
        rewritten = rewritten.when(parsed.isNotNull() & (start == kind), _document(parsed, data_type, secret, row_key, "", "$"))
    return df.withColumn(column, rewritten.otherwise(plain))


# ------------------------------------------------------------------ keys that are data
def _text_by_key(c: Column, key: Column, secret: str, located: Column) -> Column:
    """``_rewrite_text`` for a key that is only known in the row."""
    def has(words: list[str]) -> Column:
        return key.rlike("|".join(map(re.escape, words)))

    number = parse.float_text(c)
    return (
        F.when(c.contains("@") & c.contains("."), masks.mask_email(c))
        .when(F.translate(c, "- ()", "").rlike(r"(?U)^\d{10,}$"), masks.mask_phone(c))
        .when(has(K.JSON_NAME_KEYS), masks.pseudonym(c))
        .when(has(K.JSON_AADHAAR_KEYS), masks.mask_aadhaar(c))
        .when(has(K.JSON_PAN_KEYS), masks.mask_pan(c))
        .when(has(K.JSON_HASH_KEYS), masks.hash_keep_length(c))
        .when(has(K.JSON_KEEP_KEYS), c)
        .when(number.isNotNull(), _noise_by_key(number, key, secret, located).cast("string"))
        .otherwise(c)
    )


def _noise_by_key(c: Column, key: Column, secret: str, located: Column) -> Column:
    """Pool noise for a key that is only known in the row."""
    rounded = F.rint(c).cast("bigint")
    u = keyed.uniform(secret, "pool_noise", "", F.concat(key, F.lit("|"), located))
    money = key.rlike("|".join(map(re.escape, K.CURRENCY_WORDS)))
    moved = F.greatest(F.lit(0).cast("bigint"), rounded + keyed.pick(K.INTEGER_POOL, u))
    return F.when(money, rounded + keyed.pick(K.CURRENCY_POOL, u)).when(c < 0, rounded).otherwise(moved)


def _walk(v: Column, key: Column, path: Column, row_key: Column, depth: int, secret: str) -> Column:
    """The JSON text of a variant with its values anonymized by the keys they stand under; ``depth`` levels at most."""
    located = F.concat(row_key, F.lit("|"), path)
    kind = F.schema_of_variant(v)
    value = (
        F.when(kind == "STRING", _quoted(_text_by_key(F.try_variant_get(v, "$", "string"), key, secret, located)))
        .when(kind == "BOOLEAN", _noise_by_key(F.try_variant_get(v, "$", "boolean").cast("int").cast("double"), key, secret, located).cast("string"))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _noise_by_key(F.try_variant_get(v, "$", "double"), key, secret, located).cast("string"))
        .otherwise(_quoted(masks.hash_keep_length(F.to_json(v))))
    )
    text = F.when(F.is_variant_null(v), F.lit("null"))
    if depth > 0:
        members = F.try_variant_get(v, "$", "map<string,variant>")
        items = F.try_variant_get(v, "$", "array<variant>")
        # one list for members and items, so that the next level stands in the expression once
        below = F.coalesce(
            F.transform(F.map_entries(members), lambda e: F.struct(
                F.concat(_quoted(e["key"]), F.lit(":")).alias("label"), F.lower(e["key"]).alias("key"),
                F.concat(path, F.lit("."), e["key"]).alias("path"), row_key.alias("row"), e["value"].alias("v"))),
            F.transform(items, lambda x, i: F.struct(
                F.lit("").alias("label"), key.alias("key"), F.concat(path, F.lit("[]")).alias("path"),
                F.concat(row_key, F.lit("|"), i.cast("string")).alias("row"), x.alias("v"))),
        )
        written = F.transform(below, lambda e: F.concat(
            e["label"], F.coalesce(_walk(e["v"], e["key"], e["path"], e["row"], depth - 1, secret), F.lit("null"))))
        joined = F.array_join(written, ",")
        text = text.when(members.isNotNull(), F.concat(F.lit("{"), joined, F.lit("}"))).when(
            items.isNotNull(), F.concat(F.lit("["), joined, F.lit("]"))
        )
    return text.when(v.isNotNull(), value)


def json_depth(df: DataFrame, column: str) -> int:
    """Levels of objects and lists in the deepest document of a JSON text column; 0 without any."""
    marks = F.regexp_replace(F.col(f"`{column}`"), r'"(?:[^"\\\\]|\\\\.)*+"|[^\[\]{}"]', "")
    steps = F.transform(F.split(marks, ""), lambda m: F.when(m.isin("{", "["), 1).when(m.isin("}", "]"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deepest = F.aggregate(
        steps, start,
        lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")),
        lambda a: a["most"],
    )
    known = F.try_parse_json(F.col(f"`{column}`")).isNotNull()
    return df.agg(F.max(F.when(known, deepest))).first()[0] or 0


def anonymize_json_ragged(df: DataFrame, column: str, secret: str, key: str, depth: int | None = None) -> DataFrame:
    """Rewrite JSON texts whose keys are data: every value by its own key, kind and place.

    Objects, lists and plain values may be mixed at any place. Values are treated as ``anonymize_json``
    treats them, with draws of their own; a document's keys stay, so they must not identify anyone. ``depth``, found by
    a pass if it is not given, bounds the levels; deeper values are hashed as text. Text that is no JSON, and documents
    that are plain values, are hashed.
    """
    value, row_key = F.col(f"`{column}`"), F.col(f"`{key}`").cast("string")
    parsed = F.try_parse_json(value)
    levels = json_depth(df, column) if depth is None else depth
    walked = _walk(parsed, F.lit(""), F.lit("$"), row_key, levels, secret)
    nested = parsed.isNotNull() & opens_with(value).isin("{", "[")
    return df.withColumn(column, F.when(nested, walked).otherwise(masks.hash_keep_length(value)))
