"""Mixing sources to target weights by hierarchical budgeting, in native DataFrame operations.

Leaves are (domain, lang, source). A token budget flows down the tree: at each node it is
split among the children by weight, a child never gets more than its subtree can supply
(its tokens times ``max_epochs``, without leaves that a weight of 0 shuts out), and what a child cannot supply goes to its siblings in
proportion to their weights. Only what all siblings together cannot supply remains with
the ancestor, whose own siblings were offered it in the same way one level up.

A leaf spends its budget in whole epochs and then on a prefix of one more: its rows in an
order seeded by (seed, epoch, id), as far as the tokens reach. The prefix is found by
running sums over coarse ranges of hash buckets, over the buckets of the one range in which
the tokens run out, and over the rows of the one such bucket, so no task sees a whole leaf;
it is applied as a cut-off per leaf, so texts are never shuffled. Texts are read once to
count tokens; all else works on a kept table of id, leaf and size.

Edge cases: null text and empty text have 0 tokens; null domain, lang or source count as
the empty string; a leaf without tokens, or of weight 0, gets nothing; unlisted names have
weight 1; budgets are whole tokens, rounded down; rows that repeat an id and size stand
together in the order and are taken together, where the tokens reach for all; an empty table gives an
empty result; a budget above what the tree can supply selects everything ``max_epochs``
times.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

LEAF = ("domain", "lang", "source")
#: Rows of a hash bucket, on average, and buckets of a coarse range.
BUCKET_ROWS, RANGE = 256, 1024
#: Rows of a leaf table (a few hundred bytes each) up to which it is broadcast.
BROADCAST_LEAVES = 50_000


@dataclass(frozen=True)
class Mix:
    """Target weights (whole numbers) by name at each level, and the amount."""

    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    share: float = 0.8  #: budget as a share of all tokens
    max_epochs: int = 2
    seed: str = "mix-1"


#: The mix of the registered query and the pipeline.
PRODUCTION = Mix(domains={"d0": 4, "d1": 3, "d2": 2, "d3": 1}, langs={"en": 5, "de": 2, "fr": 2, "es": 1}, sources={"src0": 2})


def domain_of(source: Column) -> Column:
    """The domain of a source: d0 to d3 by its number; sources without a number are of d0."""
    return F.concat(F.lit("d"), (F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % 4).cast("string"))


def tokens(text: Column) -> Column:
    """Pieces between blanks and line feeds."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.translate(t, " \n", "")) + 1).cast("long")


def _weight(name: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("double")
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))])[name], F.lit(1.0))


def _rows(docs: DataFrame, domain: Column | None) -> DataFrame:
    """doc_id, leaf, n_tokens and the columns of ``docs`` under prefixed names."""
    domain = domain_of(F.col("source")) if domain is None else domain
    named = [F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns]
    return docs.select(*named, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), tokens(F.col("text")).alias("n_tokens"))


def share_out(children: DataFrame, parents: DataFrame | int, keys: list[str], order: str) -> DataFrame:
    """Budgets of children (keys, order, weight, cap) from those of their parents (keys, budget), or from the root's.

    With children sorted by cap / weight, those that the level of water reaches are filled;
    the others share the rest by weight.
    """
    c = children.where("weight > 0 and cap > 0").withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    if keys:
        c, part = c.join(parents, keys), Window.partitionBy(*keys)
    else:
        c, part = c.withColumn("budget", F.lit(parents).cast("long")), Window.partitionBy(F.lit(1))  # one row a domain
    upto = part.orderBy("ratio", order).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("filled", F.sum("cap").over(upto)).withColumn("left", F.sum("weight").over(part) - F.sum("weight").over(upto))
    c = c.withColumn("full", F.col("filled").cast("double") + F.col("ratio") * F.col("left") <= F.col("budget").cast("double"))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(part)
    weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(part)
    c = c.withColumn("rest", rest).withColumn("open", weight)
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.floor(F.col("rest").cast("double") * F.col("weight") / F.col("open")).cast("long")))
    return c.withColumn("got", got).select(*keys, order, F.col("got").alias("budget"))


def _join_small(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a leaf-sized table that is kept already, without dealing rows by leaf.

    A table of up to ``BROADCAST_LEAVES`` rows is broadcast; a larger one is repeated once per
    salt, so that a leaf with a third of all rows spreads over many tasks.
    """
    if small.count() <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(small), keys)
    salts = 64
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def budgets(rows: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, budget, n_tokens and n_rows of each leaf. The leaf table is one row a source."""
    leaves = shared.cut(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")))
    cap = F.sum(F.col("n_tokens") * mix.max_epochs).alias("cap")
    total = leaves.agg(F.floor(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("double") * mix.share).cast("long")).first()[0]
    # What a weight of 0 further down shuts out can spend nothing.
    low_open = leaves.where(_weight(F.col("source"), mix.sources) > 0)
    mid_open = low_open.where(_weight(F.col("lang"), mix.langs) > 0)
    top = share_out(mid_open.groupBy("domain").agg(cap).withColumn("weight", _weight(F.col("domain"), mix.domains)), total, [], "domain")
    mid = share_out(low_open.groupBy("domain", "lang").agg(cap).withColumn("weight", _weight(F.col("lang"), mix.langs)), top, ["domain"], "lang")
    low = share_out(leaves.groupBy(*LEAF).agg(cap).withColumn("weight", _weight(F.col("source"), mix.sources)), mid, ["domain", "lang"], "source")
    return low.join(leaves, list(LEAF)).where("n_tokens > 0")


def _key(mix: Mix) -> Column:
    return F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _bucket() -> Column:
    return F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * F.col("buckets") / float(1 << 32)).cast("long")


def _place(n_tokens: Column) -> Column:
    return F.struct(F.col("key"), F.coalesce("doc_id", F.lit(-1)).alias("id"), n_tokens.alias("n"))


def _last_begun(sums: DataFrame, by: str) -> DataFrame:
    """LEAF, ``by``, before, rest: per leaf the last range that its tokens reach, and the tokens before it.

    ``sums`` has LEAF, ``by``, own and rest, and ``base``, the tokens before its first range.
    """
    w = Window.partitionBy(*LEAF).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    begun = sums.withColumn("before", F.col("base") + F.sum("own").over(w) - F.col("own")).where("before <= rest")
    return begun.groupBy(*LEAF).agg(F.max_by(F.struct(by, "before", "rest"), by).alias("e")).select(*LEAF, "e.*")


def _plan(light: DataFrame, mix: Mix) -> DataFrame:
    """LEAF, epochs, rest, buckets, edge and last: whole epochs, and the place up to which one more is taken."""
    leaf = budgets(light, mix).withColumn("epochs", F.floor(F.col("budget") / F.col("n_tokens")).cast("long"))
    leaf = shared.cut(leaf.select(*LEAF, "epochs", (F.col("budget") - F.col("epochs") * F.col("n_tokens")).alias("rest"), F.ceil(F.col("n_rows") / BUCKET_ROWS).cast("long").alias("buckets")))
    dealt = _join_small(light, leaf.where("rest > 0"), list(LEAF)).withColumn("key", _key(mix)).withColumn("bucket", _bucket())
    sums = dealt.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("own"), F.first("rest").alias("rest"))
    sums = shared.cut(sums.withColumn("range", F.floor(F.col("bucket") / RANGE)))
    coarse = sums.groupBy(*LEAF, "range").agg(F.sum("own").alias("own"), F.first("rest").alias("rest"), F.lit(0).cast("long").alias("base"))
    coarse = _last_begun(coarse, "range").select(*LEAF, "range", F.col("before").alias("base"))
    edge = shared.cut(_last_begun(sums.join(coarse, [*LEAF, "range"]), "bucket"))
    inside = _join_small(dealt.drop("rest"), edge, [*LEAF, "bucket"]).withColumn("place", _place(F.col("n_tokens")))
    # Rows of one place are counted before they meet, however many repeat an id.
    places = inside.groupBy(*LEAF, "place").agg(F.sum("n_tokens").alias("own"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    run = F.sum("own").over(Window.partitionBy(*LEAF).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    last = places.withColumn("upto", F.col("before") + run).where("upto <= rest").groupBy(*LEAF).agg(F.max("place").alias("last"))
    cut = edge.join(last, list(LEAF), "left").select(*LEAF, F.col("bucket").alias("edge"), "last")
    return shared.cut(leaf.join(cut, list(LEAF), "left"))


def _taken(rows: DataFrame, plan: DataFrame, mix: Mix, n_tokens: Column) -> DataFrame:
    """The rows that the plan takes, with copies. The size is looked at only in the bucket where tokens run out."""
    out = _join_small(rows, plan, list(LEAF)).withColumn("key", _key(mix))
    extra = F.when(F.col("rest") <= 0, 0).when(_bucket() < F.col("edge"), 1).when((_bucket() == F.col("edge")) & (_place(n_tokens) <= F.col("last")), 1).otherwise(0)
    return out.withColumn("copies", (F.col("epochs") + extra).cast("long")).where("copies > 0").drop("epochs", "rest", "buckets", "edge", "last", "key")


def _light(rows: DataFrame) -> DataFrame:
    return shared.cut(rows.select("doc_id", *LEAF, "n_tokens"))


def select(docs: DataFrame, mix: Mix = PRODUCTION, domain: Column | None = None) -> DataFrame:
    """doc_id, leaf, n_tokens and copies of the rows that the mix takes."""
    light = _light(_rows(docs, domain))
    return _taken(light, _plan(light, mix), mix, F.col("n_tokens"))


def mix(docs: DataFrame, how: Mix = PRODUCTION, domain: Column | None = None) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    rows = _rows(docs, domain)
    plan = _plan(_light(rows), how)
    taken = _taken(rows.drop("n_tokens"), plan, how, tokens(F.col("in_text")))
    taken = taken.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])


def oracle(how: Mix = PRODUCTION) -> str:
    """DuckDB SQL for the registered query: a plain running sum over each leaf."""

    def case(name: str, weights: dict[str, int]) -> str:
        return "case " + name + "".join(f" when '{k}' then {float(v)!r}" for k, v in sorted(weights.items())) + " else 1.0 end" if weights else "1.0"

    def level(n: int, children: str, keys: list[str], own: str, weight: str, parent: str) -> str:
        part = "partition by " + ", ".join(keys) if keys else ""
        join = f"join {parent} p using ({', '.join(keys)})" if keys else f"cross join {parent} p"
        return f"""
c{n} as (select {', '.join([*keys, own])}, sum(n_tokens * {how.max_epochs})::bigint cap, ({weight})::double weight from {children} group by {', '.join([*keys, own])}),
r{n} as (select c.*, p.budget, cap::double / weight ratio from c{n} c {join} where weight > 0 and cap > 0),
f{n} as (select *, sum(cap) over ({part} order by ratio, {own} rows unbounded preceding) filled, sum(weight) over ({part}) - sum(weight) over ({part} order by ratio, {own} rows unbounded preceding) remaining from r{n}),
g{n} as (select *, filled::double + ratio * remaining <= budget::double is_full from f{n}),
h{n} as (select *, budget - sum(case when is_full then cap else 0 end) over ({part}) rest, sum(case when is_full then 0.0::double else weight end) over ({part}) open_weight from g{n}),
b{n} as (select {', '.join([*keys, own])}, (case when is_full then cap else least(cap, floor(rest::double * weight / open_weight)::bigint) end)::bigint budget from h{n})"""

    return f"""
with docs as (
  select doc_id, coalesce(lang, '') lang, coalesce(source, '') source,
         'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) as int), 0) % 4) as domain,
         (case when coalesce(text, '') = '' then 0 else length(text) - length(translate(text, ' ' || chr(10), '')) + 1 end)::bigint n_tokens
  from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint n_tokens, count(*) n_rows from docs group by all),
total as (select floor(coalesce(sum(n_tokens), 0)::double * {how.share})::bigint budget from leaves),
{level(1, 'leaves', [], 'domain', case('domain', how.domains), 'total').strip()},
{level(2, 'leaves', ['domain'], 'lang', case('lang', how.langs), 'b1').strip()},
{level(3, 'leaves', ['domain', 'lang'], 'source', case('source', how.sources), 'b2').strip()},
plan as (select domain, lang, source, (b.budget // l.n_tokens)::bigint epochs, b.budget % l.n_tokens rest from b3 b join leaves l using (domain, lang, source) where l.n_tokens > 0),
ordered as (
  select d.*, epochs, rest, sum(d.n_tokens) over (partition by domain, lang, source order by md5('{how.seed}:' || epochs || ':' || coalesce(doc_id::varchar, '')), doc_id, d.n_tokens rows unbounded preceding) upto
  from docs d join plan using (domain, lang, source))
select doc_id, domain, lang, source, n_tokens, (epochs + case when rest > 0 and upto <= rest then 1 else 0 end)::bigint copies
from ordered where epochs > 0 or (rest > 0 and upto <= rest)"""
