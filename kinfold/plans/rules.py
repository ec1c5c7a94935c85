"""Exact matching rules."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidConfiguration
from ..functions.normalize import Identity
from ..functions.values import tuple_text


@dataclass(frozen=True)
class ExactRule:
    """Records match where every field, by one normalizer, gives the same value.

    One missing or invalid field and the record has no key under the rule.
    """

    id: str
    fields: tuple[str, ...]
    normalizer: object = Identity()
    label: str = ""

    @property
    def signature(self) -> str:
        """Changes whenever keys of the rule would."""
        n = self.normalizer
        return json.dumps(["exact", self.id, *self.fields, type(n).__name__, n.arguments, n.version], ensure_ascii=False, separators=(",", ":"))

    def components(self, schema: T.StructType, logical: dict[str, str] | None = None) -> Column:
        """The encoded tuple, or null."""
        if not self.fields:
            raise InvalidConfiguration(f"rule {self.id} has no field")
        names = {f.name: f.dataType for f in schema.fields}
        if missing := [f for f in self.fields if f not in names]:
            raise InvalidConfiguration(f"rule {self.id}: no column {missing[0]}")
        return tuple_text([self.normalizer.text(F.col(f"`{f}`"), names[f], (logical or {}).get(f)) for f in self.fields])
