"""Typed values, tuples and record ids as Columns.

A typed value is a struct (type, value) of strings, so 0, '0', false and '' stay distinct;
null means no value. There is no float: FLOAT, DOUBLE and nested types are refused.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidConfiguration

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Patterns of text keys.
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ULID = "(?i)^[0-7][0-9A-HJKMNP-TV-Z]{25}$"


def atom(moment: Column) -> Column:
    """A timestamp as text to the second with its offset, or a date at midnight."""
    return F.date_format(moment.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssxxx")


def struct(tag: Column | str, value: Column) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.when(value.isNotNull(), F.struct(tag.alias("type"), value.alias("value")))


def typed_text(c: Column, kind: T.DataType, logical: str | None = None) -> tuple[str, Column]:
    """Tag and text of a column's typed value; ``logical`` 'enum:Name' tags a backing value."""
    if logical and logical.startswith("enum:"):
        return logical, c.cast("string")
    if isinstance(kind, T.StringType) or isinstance(kind, T.DecimalType):
        return "string", c.cast("string")
    if isinstance(kind, _WHOLE):
        return "integer", c.cast("string")
    if isinstance(kind, T.BooleanType):
        return "boolean", F.when(c, "1").when(~c, "0")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime", atom(c)
    raise InvalidConfiguration(f"values of type {kind.simpleString()} cannot be compared or matched")


def typed(c: Column, kind: T.DataType, logical: str | None = None) -> Column:
    """The typed value of a column."""
    return struct(*typed_text(c, kind, logical))


def typed_equal(a: Column, b: Column) -> Column:
    """Both null, or equal in tag and value."""
    return a.eqNullSafe(b)


def tuple_json(parts: Sequence[Column]) -> Column:
    """JSON array of [type, value] pairs; null if any part is null."""
    whole = F.to_json(F.array(*[F.array(p["type"], p["value"]) for p in parts]))
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, whole)


def text_json(value: Column) -> Column:
    """A text as a JSON list of one, or null. The value is computed once, however dear it is."""
    return F.nullif(F.to_json(F.array(value)), F.lit("[null]"))


def tuple_text(parts: Sequence[tuple[str, Column]]) -> Column:
    """What :func:`tuple_json` gives for (tag, text) pairs; each text is computed once.

    A part is one concatenation around its text, which is null where the text is.
    """
    pieces: list[Column] = []
    for tag, value in parts:
        head = json.dumps(tag, ensure_ascii=False)
        pieces += [F.lit(("," if pieces else "[") + f"[{head},"), F.substr(text_json(value), F.lit(2))]
    return F.concat(*pieces, F.lit("]"))


def list_json(parts: Sequence[Column]) -> Column:
    return F.to_json(F.array(*parts))


def key_domain(c: Column, kind: T.DataType) -> Column:
    """int, uuid, ulid or string. Text keys are told apart row by row."""
    if isinstance(kind, (*_WHOLE, T.DecimalType)):
        return F.lit("int")
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(UUID), "uuid").when(c.rlike(ULID), "ulid").otherwise("string")
    raise InvalidConfiguration(f"a key cannot be of type {kind.simpleString()}")


def record_id(c: Column, kind: T.DataType) -> Column:
    return struct(key_domain(c, kind), c.cast("string"))


def encode_id(r: Column) -> Column:
    return F.concat(r["type"], F.lit(":"), r["value"])


def decode_id(text: Column) -> Column:
    """The struct of an encoded id, split at the first colon; null where there is none."""
    at = F.instr(text, ":")
    return F.when(at > 1, F.struct(F.substring(text, F.lit(1), at - 1).alias("type"), F.substring(text, at + 1, F.length(text)).alias("value")))


def id_order(r: Column) -> Column:
    """A sort key: numbers by sign and size, however long; everything else bytewise.

    Ids of different domains sort by domain; use :func:`same_domain` where mixing is an error.
    """
    v = r["value"]
    number = (r["type"] == "int") & v.rlike("^-?[0-9]+$")
    digits = F.regexp_replace(F.regexp_replace(v, "^-", ""), "^0+(?=[0-9])", "")
    negative = v.startswith("-") & (digits != "0")
    # A longer number is larger; of negative numbers the longer and larger digits come first.
    flipped = F.translate(digits, "0123456789", "9876543210")
    sign = F.when(number, F.when(negative, 0).otherwise(1))
    size = F.when(number, F.when(negative, -F.length(digits)).otherwise(F.length(digits)))
    return F.struct(r["type"].alias("type"), sign.alias("sign"), size.alias("size"), F.when(number, F.when(negative, flipped).otherwise(digits)).otherwise(v).alias("value"))


def same_domain(a: Column, b: Column) -> Column:
    return a["type"] == b["type"]


def valid_int(text: Column) -> Column:
    """Whether text is a whole number; a lone minus is not."""
    return text.rlike("^-?[0-9]+$")


def display(c: Column, kind: T.DataType) -> Column:
    """A value for readers: null is empty, true and false, dates as text, the rest as it is or as JSON."""
    if isinstance(kind, T.BooleanType):
        shown = F.when(c, "true").when(~c, "false")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        shown = atom(c)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        shown = F.to_json(c)
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit(""))
