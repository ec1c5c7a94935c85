"""Review: members of buckets re-read live, with what changed since the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import atom
from ..plans.definition import Definition
from .keys import build_keys, with_record_id
from .suggest import BUCKET

#: States of a scan, and of a review.
ACTIVE = ("queued", "running")
TERMINAL = ("succeeded", "failed", "cancelled")
REVIEW_STATES = ("never-scanned", "scanning", "failed", "empty", "has-results")


def review_title(title: Column | None, key: Column) -> Column:
    """A title that is not empty, or #key."""
    fallback = F.concat(F.lit("#"), key.cast("string"))
    return fallback if title is None else F.coalesce(F.when(title.cast("string") != "", title.cast("string")), fallback)


def plan_title(title: Column | None, key: Column) -> Column:
    """Any title that is there, the empty one included, or #key."""
    fallback = F.concat(F.lit("#"), key.cast("string"))
    return fallback if title is None else F.coalesce(title.cast("string"), fallback)


def members(d: Definition, shown: DataFrame, visible: DataFrame, ledger: DataFrame | None, domain: str, key: bytes) -> DataFrame:
    """Shown members with title, missing, retired and changed, and usable and stale from these.

    missing: not visible now. changed: visible, but its key under the rule is another one now.
    """
    now = with_record_id(d, visible)
    title = F.col(d.title) if d.title else None
    titles = now.select("record_id", review_title(title, F.col(d.key)).alias("title"))
    keys = build_keys(d, visible, key).select("record_id", "rule_id", F.col("digest").alias("now_digest"))
    out = shown.join(titles, "record_id", "left").join(keys, ["record_id", "rule_id"], "left")
    if ledger is None:
        out = out.withColumn("retired", F.lit(False))
    else:
        gone = ledger.where(F.col("retirement_domain") == domain).select(F.col("source_id").alias("record_id"), F.col("source_id_type").alias("record_id_type"), F.lit(True).alias("_gone")).distinct()
        out = out.join(gone, ["record_id", "record_id_type"], "left").withColumn("retired", F.coalesce("_gone", F.lit(False))).drop("_gone")
    out = out.withColumn("missing", F.col("title").isNull()).withColumn("changed", F.col("title").isNotNull() & ~F.col("now_digest").eqNullSafe(F.col("digest"))).drop("now_digest")
    return out.withColumn("usable", ~F.col("missing") & ~F.col("retired")).withColumn("stale", F.col("missing") | F.col("retired") | F.col("changed"))


def groups(rows: DataFrame) -> DataFrame:
    """One row per bucket: members in order of id, whether any is stale, whether two or more are usable."""
    m = F.struct("record_id", "record_id_type", "title", "missing", "retired", "changed")
    return rows.groupBy(*BUCKET).agg(
        F.array_sort(F.collect_list(m)).alias("members"),
        F.max("n").alias("n"),
        F.max("hidden").alias("hidden"),
        F.bool_or("stale").alias("stale"),
        (F.count_if("usable") >= 2).alias("reviewable"),
    )


def latest_scans(scans: DataFrame) -> DataFrame:
    """The newest scan of each scope by created_at, then id."""
    w = Window.partitionBy("scope_id").orderBy(F.desc("created_at"), F.desc("id"))
    return scans.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_succeeded(scans: DataFrame) -> DataFrame:
    """scope_id, id and finished_at of the scan that finished last."""
    done = scans.where("state = 'succeeded'").groupBy("scope_id").agg(F.max(F.struct("finished_at", "id")).alias("m"))
    return done.select("scope_id", "m.id", "m.finished_at")


def summary(scopes: DataFrame, scans: DataFrame, counts: DataFrame) -> DataFrame:
    """scope_id, review_state, n_buckets, finished_at. scanning comes before failed, failed before the rest."""
    last = latest_scans(scans).select("scope_id", F.col("state").alias("scan_state"))
    done = latest_succeeded(scans).select("scope_id", "finished_at")
    out = scopes.select(F.col("id").alias("scope_id"), "current_generation_id").join(last, "scope_id", "left").join(done, "scope_id", "left").join(counts, "scope_id", "left")
    n = F.coalesce("n_buckets", F.lit(0)).cast("long")
    state = F.when(F.col("scan_state").isin(*ACTIVE), "scanning").when(F.col("scan_state") == "failed", "failed").when(F.col("current_generation_id").isNull(), "never-scanned").when(n > 0, "has-results").otherwise("empty")
    return out.select("scope_id", state.alias("review_state"), n.alias("n_buckets"), "finished_at")


def has_published(state: Column) -> Column:
    """What the review page treats as results; scanning and failed count although nothing may be published."""
    return state.isin("scanning", "failed", "empty", "has-results")


def banner(summaries: DataFrame, permitted: bool = True) -> DataFrame:
    """One row a scope: tone, count and flags; nothing where it is not permitted."""
    tone = F.when(F.col("review_state") == "failed", "danger").when(F.col("review_state") == "has-results", "warning").when(F.col("review_state") == "scanning", "info").when(F.col("review_state") == "empty", "success").otherwise("gray")
    out = summaries.select("scope_id", "review_state", tone.alias("tone"), "n_buckets", (F.col("review_state") == "scanning").alias("scanning"), (F.col("n_buckets") > 0).alias("reviewable"), atom(F.col("finished_at")).alias("finished_at"))
    return out if permitted else out.where(F.lit(False))


def stalled(cutoff: Column) -> Column:
    """Queued since before the cutoff, or running without a heartbeat since."""
    beat = F.coalesce("heartbeat_at", "created_at")
    return ((F.col("state") == "queued") & (F.col("created_at") < cutoff)) | ((F.col("state") == "running") & (beat < cutoff))


def prunable(scans: DataFrame, scopes: DataFrame, cutoff: Column) -> DataFrame:
    """Terminal scans that finished before the cutoff and whose generation is not the published one."""
    s = scopes.select(F.col("id").alias("scope_id"), "current_generation_id")
    return scans.join(s, "scope_id", "left").where(F.col("state").isin(*TERMINAL) & (F.col("finished_at") < cutoff) & (F.col("current_generation_id").isNull() | (F.col("generation_id") != F.col("current_generation_id"))))
