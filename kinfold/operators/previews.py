"""Stored previews of plans: encrypted, bound to actor, panel and scope, and short-lived."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DomainConflict, ForbiddenOperation, RecordUnavailable, StalePreview
from ..plans.context import Context
from .apply import decrypt, encrypt

SCHEMA = "id string, operation_id string, scope_id string, definition_id string, panel_id string, actor_ref string, payload_hash string, plan_payload binary, expires_at timestamp, created_at timestamp, updated_at timestamp"


def rows(plans: DataFrame, context: Context, key: bytes, now: dt.datetime, minutes: int) -> DataFrame:
    """One preview per plan (with operation_id). Field values are not part of the stored plan."""
    light = F.transform("differences", lambda x: F.struct(x["field"].alias("field"), x["resolution"].alias("resolution")))
    body = F.to_json(F.struct("source_id", "survivor_id", light.alias("differences"), "impacts", "blockers", "fingerprint"))
    at = F.lit(now).cast("timestamp")
    until = F.lit(now + dt.timedelta(minutes=max(1, minutes))).cast("timestamp")
    return plans.select(F.col("operation_id").alias("id"), "operation_id", F.lit(context.scope).alias("scope_id"), F.lit(context.definition).alias("definition_id"), F.lit(context.panel).alias("panel_id"), F.lit(context.actor).alias("actor_ref"), F.sha2(body, 256).alias("payload_hash"), encrypt(body, key).alias("plan_payload"), until.alias("expires_at"), at.alias("created_at"), at.alias("updated_at"))


def find(held: DataFrame, operation_id: str, context: Context, key: bytes, now: dt.datetime) -> dict:
    """The stored plan. Checks: there, actor, panel, expiry, decryption, hash, scope; in this order."""
    import json

    at = F.lit(now).cast("timestamp")
    got = held.where(F.col("operation_id") == operation_id).select("*", decrypt(F.col("plan_payload"), key).alias("body"), (F.col("expires_at") <= at).alias("old")).limit(1).collect()
    if not got:
        raise RecordUnavailable("no such preview")
    r = got[0]
    if r["actor_ref"] != context.actor or r["panel_id"] != context.panel:
        raise ForbiddenOperation("the preview is another actor's")
    if r["old"]:
        raise StalePreview("the preview expired")
    if r["body"] is None:
        raise DomainConflict("the preview cannot be read")
    import hashlib

    if hashlib.sha256(r["body"].encode()).hexdigest() != r["payload_hash"]:
        raise DomainConflict("the preview was altered")
    if r["scope_id"] != context.scope:
        raise ForbiddenOperation("the preview is of another scope")
    return json.loads(r["body"])


def prune(held: DataFrame, now: dt.datetime) -> tuple[DataFrame, int]:
    """What is not expired, and how many were."""
    dead = F.col("expires_at") < F.lit(now).cast("timestamp")
    return held.where(~dead), held.where(dead).count()
