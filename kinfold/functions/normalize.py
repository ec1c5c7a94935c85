"""Normalizers: a column to a typed value, or null where it gives no key.

``text`` gives the tag and the text, each expression of it once, which is what keys are made
of; ``apply`` gives the struct of both.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import _WHOLE, atom, struct, typed_text

#: The white space that trimming removes. No-break space is not of it.
ASCII_BLANK = " \t\n\r\0\x0b"
#: An address of up to 254 characters, with a local part of up to 64 and a dotted domain.
EMAIL = r"^(?=.{1,254}$)(?=[^@]{1,64}@)[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?$"


def ascii_trim(c: Column) -> Column:
    return F.trim(c, F.lit(ASCII_BLANK))


def _flag(b: bool) -> str:
    return "1" if b else "0"


class _Normalizer:
    def apply(self, c: Column, kind: T.DataType, logical: str | None = None) -> Column:
        return struct(*self.text(c, kind, logical))


@dataclass(frozen=True)
class Identity(_Normalizer):
    """The value as it is. Blank text gives no key, other text stays untrimmed."""

    @property
    def version(self) -> str:
        return "identity:v1"

    @property
    def arguments(self) -> str:
        return "[]"

    def text(self, c: Column, kind: T.DataType, logical: str | None = None) -> tuple[str, Column]:
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "string", atom(c)
        tag, value = typed_text(c, kind, logical)
        return tag, F.when(ascii_trim(c) != "", value) if isinstance(kind, T.StringType) else value


@dataclass(frozen=True)
class TrimmedText(_Normalizer):
    """Text or whole numbers, trimmed; optionally composed (NFC) before and lower-cased after."""

    lowercase: bool = False
    nfc: bool = False

    @property
    def version(self) -> str:
        return f"trimmed-text:v1:lowercase={_flag(self.lowercase)}:nfc={_flag(self.nfc)}"

    @property
    def arguments(self) -> str:
        return json.dumps([self.lowercase, self.nfc])

    def text(self, c: Column, kind: T.DataType, logical: str | None = None) -> tuple[str, Column]:
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            text = atom(c)
        elif isinstance(kind, T.StringType):
            text = F.when(F.is_valid_utf8(c), c)
        elif isinstance(kind, _WHOLE):
            text = c.cast("string")
        else:
            typed_text(c, kind, logical)  # refuses floats and nested types
            return "string", F.lit(None).cast("string")
        if self.nfc:
            text = _compose()(text)
        text = ascii_trim(text)
        return "string", F.nullif(F.lower(text) if self.lowercase else text, F.lit(""))


@dataclass(frozen=True)
class Email(_Normalizer):
    """A valid address, its domain lower-cased; the local part only on request. Tags and dots stay."""

    lowercase_local: bool = False

    @property
    def version(self) -> str:
        return f"email:v1:local={_flag(self.lowercase_local)}"

    @property
    def arguments(self) -> str:
        return json.dumps([self.lowercase_local])

    def text(self, c: Column, kind: T.DataType, logical: str | None = None) -> tuple[str, Column]:
        if not isinstance(kind, T.StringType):
            typed_text(c, kind, logical)
            return "string", F.lit(None).cast("string")
        text = ascii_trim(c)
        local = F.substring_index(text, "@", 1)
        local = F.lower(local) if self.lowercase_local else local
        return "string", F.when(text.rlike(EMAIL), F.concat(local, F.lit("@"), F.lower(F.substring_index(text, "@", -1))))


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def _compose():
    """NFC has no built-in; a rule must ask for this Python function."""
    return F.pandas_udf(_nfc, "string")
