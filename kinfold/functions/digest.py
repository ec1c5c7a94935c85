"""HMAC-SHA-256 over JSON lists, as Columns and on the driver.

The message of a digest is the JSON list [version, context..., payload]. As a Column it is
two nested SHA-2 calls over literals computed once, so it stays in generated code.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import text_json

VERSION = "v1"
_BLOCK = 64


def _json(parts: Sequence[str]) -> str:
    return json.dumps(list(parts), ensure_ascii=False, separators=(",", ":"))


def pads(key: bytes) -> tuple[bytes, bytes]:
    key = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_column(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA-256 of a text column; null for null."""
    inner, outer = pads(key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def keyed(key: bytes, context: Sequence[str | Column], payload: Column) -> Column:
    """Digest of a payload column in a context; the constant part of the message is one literal."""
    if all(isinstance(x, str) for x in context):
        head = _json([VERSION, *context])[:-1] + ","
        # text_json gives ["payload"]: its first bracket is replaced by the literal head.
        return hmac_column(key, F.concat(F.lit(head), F.substr(text_json(payload), F.lit(2))))
    parts = [F.lit(x) if isinstance(x, str) else x for x in (VERSION, *context)]
    return F.when(payload.isNotNull(), hmac_column(key, F.to_json(F.array(*parts, payload))))


def keyed_text(key: bytes, context: Sequence[str], payload: str) -> str:
    """The same digest of one value on the driver."""
    return hmac.new(key, _json([VERSION, *context, payload]).encode(), hashlib.sha256).hexdigest()


def same(a: str, b: str) -> bool:
    """Comparison in constant time."""
    return hmac.compare_digest(a.encode(), b.encode())


def scope_hash(key: bytes, definition: str, connection: str, domain: str, tenant: str | None) -> str:
    """Panel and actor are not part of a scope."""
    return hmac.new(key, _json([VERSION, definition, connection, domain, tenant or ""]).encode(), hashlib.sha256).hexdigest()


def retirement_domain(connection: str, model: str, domain: str) -> str:
    """A plain SHA-256, so it survives a change of the key."""
    return hashlib.sha256(_json(["retirement-domain:v2", connection, model, domain]).encode()).hexdigest()


def legacy_retirement_domain(key: bytes, connection: str, model: str, domain: str) -> str:
    """The first version of the domain, keyed; :mod:`kinfold.operators.resolve` migrates it."""
    return hmac.new(key, _json(["retirement-domain:v1", connection, model, domain]).encode(), hashlib.sha256).hexdigest()


def pair_hash(key: bytes, scope: str, a: Column, b: Column) -> Column:
    """Digest of two encoded ids, whichever comes first."""
    return keyed(key, ["dismissal-pair", scope], F.to_json(F.array(F.least(a, b), F.greatest(a, b))))
