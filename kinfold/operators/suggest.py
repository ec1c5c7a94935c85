"""Candidate buckets: memberships that share rule and digest, as seen now."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digest import pair_hash
from ..sources.work import cut

BUCKET = ["rule_id", "digest"]


def not_retired(rows: DataFrame, ledger: DataFrame | None, domain: str) -> DataFrame:
    """Rows whose (record_id_type, record_id) was not retired in the domain."""
    if ledger is None:
        return rows
    gone = ledger.where(F.col("retirement_domain") == domain).select(F.col("source_id").alias("record_id"), F.col("source_id_type").alias("record_id_type"))
    return rows.join(gone, ["record_id", "record_id_type"], "left_anti")


def visible_members(memberships: DataFrame, visible_ids: DataFrame, ledger: DataFrame | None = None, domain: str = "") -> DataFrame:
    """Memberships of records that are visible now and not retired. ``visible_ids`` has record_id."""
    seen = memberships.join(visible_ids.select("record_id").distinct(), "record_id", "left_semi")
    return not_retired(seen, ledger, domain)


def buckets(members: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """rule_id, label, digest, n for buckets of two or more."""
    out = members.groupBy(*BUCKET).agg(F.count("*").alias("n")).where("n >= 2")
    return out.withColumn("label", label(F.col("rule_id"), labels or {}))


def label(rule_id: Column, labels: dict[str, str]) -> Column:
    """The rule's label, or its id."""
    named = {k: v for k, v in labels.items() if v}
    if not named:
        return rule_id
    return F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(named.items()) for x in kv])[rule_id], rule_id)


def pair_buckets(members: DataFrame) -> DataFrame:
    """rule_id, digest, low, high (encoded ids, in order) of buckets with exactly two members."""
    rid = F.concat("record_id_type", F.lit(":"), "record_id")
    two = members.groupBy(*BUCKET).agg(F.count("*").alias("n"), F.min(rid).alias("low"), F.max(rid).alias("high"))
    return two.where("n = 2").drop("n")


def suppressed(members: DataFrame, signature_maps: DataFrame, dismissals: DataFrame, key: bytes, scope: str, revision: str) -> DataFrame:
    """Buckets whose two visible members were dismissed as a pair and whose keys have not changed since.

    Buckets of three or more are never suppressed.
    """
    pairs = pair_buckets(members).withColumn("pair_hash", pair_hash(key, scope, F.col("low"), F.col("high")))
    sig = signature_maps.select(F.concat("record_id_type", F.lit(":"), "record_id").alias("id"), F.to_json("signatures").alias("sig"))
    pairs = pairs.join(sig.select(F.col("id").alias("low"), F.col("sig").alias("low_sig")), "low").join(sig.select(F.col("id").alias("high"), F.col("sig").alias("high_sig")), "high")
    live = dismissals.where((F.col("scope_id") == scope) & F.col("reopened_at").isNull() & (F.col("definition_revision") == revision))
    live = live.select("pair_hash", F.to_json("signatures.low").alias("low_sig"), F.to_json("signatures.high").alias("high_sig"))
    return pairs.join(live, ["pair_hash", "low_sig", "high_sig"], "left_semi").select(*BUCKET)


def without(found: DataFrame, hidden: DataFrame) -> DataFrame:
    return found.join(hidden, BUCKET, "left_anti")


def page(found: DataFrame, number: int, size: int) -> DataFrame:
    """One page of buckets in order of rule and digest, after suppression. Numbers below 1 count as 1."""
    number, size = max(1, number), max(1, size)
    return found.orderBy(*BUCKET).offset((number - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // max(1, size)))


def first_members(members: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The first k members of each bucket by id as text, with the number not shown."""
    w = Window.partitionBy(*BUCKET).orderBy("record_id", "record_id_type")
    rows = members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(1, k))
    return rows.join(found.select(*BUCKET, "n"), BUCKET).withColumn("hidden", F.greatest(F.lit(0), F.col("n") - max(1, k)))


def direct_matches(pairs: DataFrame, memberships: DataFrame, a: str = "source_id", b: str = "survivor_id") -> DataFrame:
    """The pairs that share a key under at least one rule, with the shared rules in order.

    Overlaps are not chained: a-b and b-c do not make a-c.
    """
    m = memberships.select("rule_id", "digest", "record_id")
    left = pairs.join(m.withColumnRenamed("record_id", a), a)
    both = left.join(m.select("rule_id", "digest", F.col("record_id").alias(b)), [b, "rule_id", "digest"])
    return both.groupBy(a, b).agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


#: Ids in one block of a kind, about; ids in one run of ends; fewest and most pairs in a cell of the grid, about.
_BLOCK, _RUN, _CELL = 256, 256, (1 << 20, 1 << 26)


def open_chains(memberships: DataFrame, first: str, second: str) -> DataFrame:
    """The pairs (a, c), each once, where some b shares the first rule with a and the second with c, but a and c share neither.

    Such a b is neither a nor c, as these would then share a rule. So a pair belongs by the kinds of its ends,
    the keys a record has under both rules (more than one a rule only where ids repeat): kinds meet, not records,
    and records come in blocks of a kind that are opened last. Every row that is made is one of the result.
    A grid over the blocks of equal first keys deals the pairs of a frequent key to many tasks. Its cells grow with
    the result, up to a bound, so that ids are sent few times; a task makes the pairs of about one cell.
    In a cell all starts meet one run of ends after the other. So a file of the result holds few ids, and in it a start
    stays for a run while the ends come round: Parquet's dictionaries and compression need little for both.
    """
    digests = lambda rule: F.array_sort(F.collect_set(F.when(F.col("rule_id") == rule, F.col("digest"))))
    own = memberships.where(F.col("rule_id").isin(first, second)).groupBy("record_id").agg(digests(first).alias("n"), digests(second).alias("s"))
    sizes = own.groupBy("n", "s").agg(F.count("*").alias("size"))
    block = F.pmod(F.xxhash64("record_id"), F.ceil(F.col("size") / _BLOCK)).alias("block")
    blocks = cut(own.join(sizes, ["n", "s"]).groupBy("n", "s", block).agg(F.collect_list("record_id").alias("ids")))
    kinds = blocks.groupBy("n", "s").agg(F.sum(F.size("ids")).alias("size"))

    # (n, s): first keys of a and second keys of c that some b has together.
    met = kinds.select("n", F.explode("s").alias("y")).select(F.explode("n").alias("x"), "y").distinct()
    of_c = kinds.select("s", F.explode("s").alias("y")).distinct()
    of_a = kinds.select("n", F.explode("n").alias("x")).distinct()
    linked = met.join(of_c, "y").join(of_a, "x").select("n", "s").distinct()
    # Of these, the ones where some a with n shares no second key with c.
    near = linked.select("n", "s", F.explode("s").alias("y")).join(kinds.select("n", F.col("s").alias("t"), F.explode("s").alias("y")), ["n", "y"])
    near = near.select("n", "s", "t").distinct().groupBy("n", "s").agg(F.count("*").alias("near"))
    linked = linked.join(kinds.groupBy("n").agg(F.count("*").alias("kinds")), "n").join(near, ["n", "s"], "left").where(F.col("kinds") > F.coalesce("near", F.lit(0)))

    ends = cut(kinds.select(F.col("n").alias("m"), "s", "size").join(linked.select("n", "s"), "s").where(~F.arrays_overlap("m", "n")))
    grid = kinds.groupBy("n").agg(F.sum("size").alias("rows")).join(ends.groupBy("n").agg(F.sum("size").alias("columns")), "n")
    total = grid.agg(F.sum(F.col("rows").cast("double") * F.col("columns"))).first()[0] or 0.0
    cell = min(_CELL[1], max(_CELL[0], total / int(memberships.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tasks = math.ceil(total / cell) or 1
    grid = cut(grid.select("n", *[F.ceil(F.col(k) / math.sqrt(cell)).alias(k) for k in ("rows", "columns")]))

    place = ["n", "row", "column"]
    dealt = lambda k: F.pmod(F.xxhash64(F.col("ids")[0]), k)
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    a = blocks.join(grid, "n").select("n", F.col("s").alias("t"), F.col("ids").alias("a"), dealt("rows").alias("row"), every("columns").alias("column"))
    c = blocks.withColumnRenamed("n", "m").join(ends.select("m", "s", "n"), ["m", "s"]).join(grid, "n")
    c = c.select("n", "s", "ids", dealt("columns").alias("column"), every("rows").alias("row")).repartition(tasks, *place)
    c = c.groupBy(*place).agg(F.flatten(F.collect_list(F.transform("ids", lambda x: F.struct("s", x.alias("id"))))).alias("c"))
    runs = F.transform(F.sequence(F.lit(1), F.size("c"), F.lit(_RUN)), lambda i: F.slice("c", i, _RUN))
    c = c.select(*place, F.explode(runs).alias("c"))
    single = lambda x: (F.size("t") == 1) & (F.size(x) == 1)
    apart = F.filter("c", lambda x: F.when(single(x["s"]), F.col("t")[0] != x["s"][0]).otherwise(~F.arrays_overlap("t", x["s"])))
    # The left side of a merge join is the outer loop: one run of ends, then all starts of the cell.
    pairs = c.join(a.repartition(tasks, *place).hint("merge"), place).select("a", F.transform(apart, lambda x: x["id"]).alias("c"))
    return pairs.select(F.explode("a").alias("a"), "c").select("a", F.explode("c").alias("c"))
