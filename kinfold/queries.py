"""Registered queries of the engine over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import digest, normalize, values
from .operators import apply, compare, dismiss, keys, previews, resolve, review, suggest
from .operators.desk import Desk
from .operators.lifecycle import Scans
from .plans.context import Ability, AbilityMap, Context
from .plans.definition import Definition, MergeField, Relation, Retirement, scoped, visible
from .plans.rules import ExactRule
from .sources.scan import by_key, by_keys, host, keyset_chunk
from .sources.store import Store
from .sources.work import cut, numbered, work_root

KEY = b"kinfold registered queries"
AUDIT_KEY = b"0123456789abcdef"
NOW = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
DOMAIN = "demo"
EVERYTHING = AbilityMap(frozenset(Ability))

NAME = ExactRule("name", ("p_name",), normalize.TrimmedText(lowercase=True), "Same name")
SPEC = ExactRule("spec", ("p_brand", "p_type", "p_size"), normalize.Identity(), "Same specification")
PARTS = Definition("parts", "part", "p_partkey", (NAME, SPEC), label="Parts", title="p_name", authorizer=EVERYTHING)
DAY = ExactRule("customer-day", ("o_custkey", "o_orderdate"), normalize.Identity())
LINES = Relation("lines", "lineitem", "l_orderkey", "l_linenumber", unique_keys=(("l_orderkey", "l_linenumber"),), cap=5)
ORDERS = Definition("orders", "orders", "o_orderkey", (DAY,), title="status", fields=(MergeField("status"), MergeField("priority"), MergeField("note", audited=False, blank_is_missing=True)), relations=(LINES,), unique_keys=(("status", "priority"),), deleted_at="deleted_at", created_at="o_orderdate", updated_at="updated_at", authorizer=EVERYTHING, retirement=Retirement(), validator=lambda: F.array().cast("array<string>"), guards_writes=True, inventory_acknowledged=True)
TEXT = ExactRule("text", ("text",), normalize.TrimmedText(lowercase=True))
DOCS = Definition("docs", "documents", "doc_id", (TEXT,), tenant="source", visible=lambda df, c: df.where("lang = 'en'"), authorizer=EVERYTHING)
EVENTS = Definition("events", "events", "event_id", (ExactRule("user", ("user_id",)), ExactRule("user-type", ("user_id", "event_type"))), authorizer=EVERYTHING)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _context(d: Definition, tenant: str | None = None) -> Context:
    return Context(d.id, d.connection, "scope-1", "actor-1", "admin", tenant)


# -- SQL of shared parts ------------------------------------------------------------------

_BLANK = "(' ' || chr(9) || chr(10) || chr(13) || chr(11))"


def _sql_hmac(message: str) -> str:
    inner, outer = digest.pads(KEY)
    return f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({message}))))"


def _sql_keyed(context: list[str], payload: str) -> str:
    head = digest._json([digest.VERSION, *context])[:-1] + ","
    quoted = head.replace("'", "''")
    return f"case when {payload} is not null then {_sql_hmac(f"'{quoted}' || substr(to_json([{payload}])::varchar, 2)")} end"


def _sql_rule(d: Definition, rule: ExactRule, payload: str) -> str:
    return _sql_keyed([d.id, rule.id, rule.signature, d.revision], payload)


_NAME_TUPLE = f"case when trim(p_name, {_BLANK}) <> '' then to_json([['string', lower(trim(p_name, {_BLANK}))]])::varchar end"
_SPEC_TUPLE = f"case when trim(p_brand, {_BLANK}) <> '' and trim(p_type, {_BLANK}) <> '' and p_size is not null then to_json([['string', p_brand], ['string', p_type], ['integer', p_size::varchar]])::varchar end"


def _members_sql(table: str = "part", name: str = "members") -> str:
    return f"""{name} as (
  select * from (
    select 'name' rule_id, {_sql_rule(PARTS, NAME, _NAME_TUPLE)} digest, p_partkey::varchar record_id, 'int' record_id_type from {table}
    union all
    select 'spec', {_sql_rule(PARTS, SPEC, _SPEC_TUPLE)}, p_partkey::varchar, 'int' from {table}) where digest is not null)"""


_BUCKETS = "buckets as (select rule_id, digest, count(*) n from members group by all having count(*) >= 2)"
_LEDGER_SQL = "ledger as (select p_partkey::varchar source_id, 'int' source_id_type, (p_partkey + 3)::varchar survivor_id from part where p_partkey % 7 = 0)"
_ORDERS_SQL = """ord as (select o_orderkey, o_custkey, o_orderdate, o_orderstatus status, nullif(o_orderpriority, '1-URGENT') priority,
  case o_orderkey % 3 when 0 then '  ' when 1 then 'n' || (o_orderkey % 2) end note, null::timestamp deleted_at, o_orderdate updated_at from orders),
pairs as (select max(o_orderkey)::varchar source_id, min(o_orderkey)::varchar survivor_id from ord group by o_custkey, o_orderdate having count(*) = 2)"""
_ATOM = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
_SIDES = "sides as (select p.*, a.status source_status, b.status survivor_status, a.priority source_priority, b.priority survivor_priority, a.note source_note, b.note survivor_note from pairs p join ord a on a.o_orderkey::varchar = source_id join ord b on b.o_orderkey::varchar = survivor_id)"


def _policy(f: str) -> str:
    a, b = f"source_{f}", f"survivor_{f}"
    blank = " or trim({}) = ''" if f == "note" else ""
    na, nb = (f"({x} is null{blank.format(x)})" for x in (a, b))
    return f"case when {na} and {nb} then 'both_missing' when {nb} then 'take_source' when {na} then 'retain_survivor' when {a} = {b} then 'retain_survivor' else 'choice_required' end"


def _compare_sql(f: str) -> str:
    a, b = f"source_{f}", f"survivor_{f}"
    return f"case when {a} is null and {b} is null then 'empty' when {b} is null then 'source_only' when {a} is null then 'survivor_only' when {a} = {b} then 'identical' else 'different' end"


_DIFF = "diff as (" + " union all ".join(f"select source_id, survivor_id, '{f}' field, {_policy(f)} resolution, source_{f} source_value, survivor_{f} survivor_value, {_compare_sql(f)} comparison from sides" for f in ("status", "priority", "note")) + ")"

# -- inputs -------------------------------------------------------------------------------


def _part(spark, d) -> DataFrame:
    return host(spark, d, "part")


def _members(spark, d) -> DataFrame:
    return keys.build_keys(PARTS, _part(spark, d), KEY)


def _published(spark, d) -> DataFrame:
    """The memberships as a scan leaves them: computed once, read often."""
    return cut(_members(spark, d))


def _part_ledger(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return _part(spark, d).where(k % 7 == 0).select(F.lit(DOMAIN).alias("retirement_domain"), k.cast("string").alias("source_id"), F.lit("int").alias("source_id_type"), (k + 3).cast("string").alias("survivor_id"), F.timestamp_seconds(k).alias("committed_at"), F.concat(F.lit("op-"), k.cast("string")).alias("operation_id"))


def _ids(df: DataFrame, d: Definition) -> DataFrame:
    return df.select(F.col(d.key).cast("string").alias("record_id"))


def _orders(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    note = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit("n"), (k % 2).cast("string")))
    return host(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderstatus").alias("status"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"), note.alias("note"), F.lit(None).cast("timestamp").alias("deleted_at"), F.col("o_orderdate").alias("updated_at"))


def _candidates(spark, d) -> DataFrame:
    """The two records of each bucket of exactly two, smaller key first."""
    o = _orders(spark, d)
    two = o.groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("n"), F.min("o_orderkey").cast("string").alias("a"), F.max("o_orderkey").cast("string").alias("b"))
    return cut(two.where("n = 2").select("a", "b"))


def _pairs(spark, d) -> DataFrame:
    return _candidates(spark, d).select(F.col("b").alias("source_id"), F.col("a").alias("survivor_id"))


def _lines(spark, d) -> DataFrame:
    return host(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")


def _shown(c: Column) -> Column:
    return F.array_join(c, ",")


# -- keys ---------------------------------------------------------------------------------


@_query("select event_id, to_json([['integer', user_id::varchar]])::varchar tuple from events where user_id is not null")
def keys_identity(spark, d):
    e = host(spark, d, "events")
    return e.select("event_id", EVENTS.rules[0].components(e.schema).alias("tuple")).where("tuple is not null")


@_query(f"select p_partkey, lower(trim(p_name, {_BLANK})) as value, 'string' as type from part where p_partkey % 5 <> 0")
def keys_trimmed(spark, d):
    noisy = _part(spark, d).select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, " \t\n").otherwise(F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t\n"))).alias("raw"))
    v = normalize.TrimmedText(lowercase=True).apply(F.col("raw"), noisy.schema["raw"].dataType)
    return noisy.select("p_partkey", v["value"].alias("value"), v["type"].alias("type")).where("value is not null")


@_query("""select c_custkey, case c_custkey % 5 when 0 then 'Cust.' || c_custkey || '+x@example.com' when 1 then 'c' || c_custkey || '@mail.example.org' end as value
from customer where c_custkey % 5 < 2""")
def keys_email(spark, d):
    c, k = host(spark, d, "customer"), F.col("c_custkey")
    text = k.cast("string")
    raw = F.when(k % 5 == 0, F.concat(F.lit("  Cust."), text, F.lit("+x@Example.COM "))).when(k % 5 == 1, F.concat(F.lit("c"), text, F.lit("@MAIL.example.org"))).when(k % 5 == 2, F.concat(F.lit("c"), text, F.lit("@localhost"))).when(k % 5 == 3, F.concat(F.lit("c "), text, F.lit("@example.com"))).otherwise("not-an-email")
    c = c.select("c_custkey", raw.alias("email"))
    return c.select("c_custkey", normalize.Email().apply(F.col("email"), c.schema["email"].dataType)["value"].alias("value")).where("value is not null")


@_query(f"select p_partkey, {_SPEC_TUPLE} tuple from part")
def keys_composite(spark, d):
    p = _part(spark, d)
    return p.select("p_partkey", SPEC.components(p.schema).alias("tuple"))


@_query(f"select doc_id, {_sql_rule(DOCS, TEXT, f"case when trim(text, {_BLANK}) <> '' then to_json([['string', lower(trim(text, {_BLANK}))]])::varchar end")} digest from documents")
def digest_hmac(spark, d):
    docs = host(spark, d, "documents")
    return docs.select("doc_id", keys.rule_digest(DOCS, TEXT, KEY, docs.schema).alias("digest"))


@_query(f"with {_members_sql()} select * from members")
def membership_explode(spark, d):
    return _members(spark, d)


@_query(f"""with {_members_sql()} select record_id, string_agg(rule_id || '=' || digest, ',' order by rule_id) signatures from members group by 1""")
def record_signatures(spark, d):
    s = keys.signatures(_members(spark, d))
    return s.select("record_id", F.array_join(F.transform(F.map_entries("signatures"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("signatures"))


@_query(f"select p_partkey, nfc_normalize(trim(p_name, {_BLANK}) || 'e' || chr(769) || p_partkey) as value from part")
def keys_nfc(spark, d):
    p = _part(spark, d).select("p_partkey", F.concat(F.trim("p_name"), F.lit("e\u0301"), F.col("p_partkey").cast("string"), F.lit(" \t")).alias("raw"))
    return p.select("p_partkey", normalize.TrimmedText(nfc=True).apply(F.col("raw"), p.schema["raw"].dataType)["value"].alias("value"))


@_query("select p_partkey, to_json([p_name, p_brand, p_type])::varchar as parts from part")
def list_encode(spark, d):
    return _part(spark, d).select("p_partkey", values.list_json([F.col("p_name"), F.col("p_brand"), F.col("p_type")]).alias("parts"))


def _sql_scope(tenant: str) -> str:
    return _sql_hmac(f"to_json(['v1', 'parts', 'default', 'default', {tenant}])::varchar")


@_query(f"""select n_name, {_sql_scope("n_name")} as scope, sha256(to_json(['retirement-domain:v2', 'default', n_name, 'default'])::varchar) retirement, {_sql_hmac("to_json(['v1', 'retirement-domain:v1', 'default', n_name, 'default'])::varchar").replace("'v1', 'retirement-domain:v1'", "'retirement-domain:v1'")} legacy from nation""")
def scope_digests(spark, d):
    """Digests of scopes and domains are made on the driver; nations stand for tenants and tables."""
    names = [r["n_name"] for r in host(spark, d, "nation").select("n_name").collect()]  # the nations, 25
    rows = [(n, digest.scope_hash(KEY, "parts", "default", "default", n), digest.retirement_domain("default", n, "default"), digest.legacy_retirement_domain(KEY, "default", n, "default")) for n in names]
    return spark.createDataFrame(rows, "n_name string, scope string, retirement string, legacy string")


# -- buckets ------------------------------------------------------------------------------


@_query(f"with {_members_sql()}, {_BUCKETS} select rule_id, case rule_id when 'name' then 'Same name' else 'Same specification' end as label, digest, n from buckets")
def bucket_count(spark, d):
    return suggest.buckets(_members(spark, d), {r.id: r.label for r in PARTS.rules})


_TOPK = """top as (select m.rule_id, m.digest, record_id, n, row_number() over (partition by m.rule_id, m.digest order by record_id) rn from members m join buckets using (rule_id, digest))"""


@_query(f"with {_members_sql()}, {_BUCKETS}, {_TOPK} select rule_id, digest, record_id, rn::int rn, n, greatest(0, n - 3) hidden from top where rn <= 3")
def bucket_members_topk(spark, d):
    m = _published(spark, d)
    return suggest.first_members(m, suggest.buckets(m), 3).select("rule_id", "digest", "record_id", "rn", "n", "hidden")


@_query(f"with {_members_sql()}, {_BUCKETS} select * from buckets order by rule_id, digest limit 10 offset 10")
def bucket_page(spark, d):
    return suggest.page(suggest.buckets(_members(spark, d)), 2, 10).select("rule_id", "digest", "n")


@_query(f"with {_members_sql('(select * from part where p_size <= 25)')}, {_BUCKETS} select * from buckets")
def bucket_visible(spark, d):
    p = _part(spark, d)
    seen = suggest.visible_members(keys.build_keys(PARTS, p, KEY), _ids(p.where("p_size <= 25"), PARTS))
    return suggest.buckets(seen).select("rule_id", "digest", "n")


@_query(f"with {_LEDGER_SQL}, {_members_sql('(select * from part where p_partkey::varchar not in (select source_id from ledger))')}, {_BUCKETS} select * from buckets")
def bucket_excl_retired(spark, d):
    m = suggest.not_retired(_members(spark, d), _part_ledger(spark, d), DOMAIN)
    return suggest.buckets(m).select("rule_id", "digest", "n")


_TWO = "two as (select rule_id, digest, min(record_id_type || ':' || record_id) low, max(record_id_type || ':' || record_id) high from members group by all having count(*) = 2)"


def _dismissals(m: DataFrame, every: int) -> DataFrame:
    """Pairs of two-member buckets whose lower key divides by ``every``."""
    two = suggest.pair_buckets(m).where(F.substring_index("low", ":", -1).cast("long") % every == 0)
    return dismiss.rows(two.select(F.col("low").alias("a"), F.col("high").alias("b")), keys.signatures(m), KEY, "scope-1", PARTS.revision, "actor-1", NOW)


@_query(f"""with {_members_sql()}, {_BUCKETS}, {_TWO}, gone as (select distinct low, high from two where split_part(low, ':', 2)::bigint % 2 = 0)
select b.rule_id, b.digest, n from buckets b left join two t using (rule_id, digest) where not exists (select 1 from gone g where g.low = t.low and g.high = t.high)""")
def bucket_suppressed(spark, d):
    m = _published(spark, d)
    hidden = suggest.suppressed(m, keys.signatures(m), _dismissals(m, 2), KEY, "scope-1", PARTS.revision)
    return suggest.without(suggest.buckets(m), hidden).select("rule_id", "digest", "n")


@_query(f"""with {_members_sql()}, {_TWO} select distinct low, high from two where split_part(low, ':', 2)::bigint % 3 = 0""")
def dismissed_pairs(spark, d):
    m = _published(spark, d)
    pairs = suggest.pair_buckets(m).select(F.col("low").alias("a"), F.col("high").alias("b"))
    return dismiss.dismissed(pairs, keys.signatures(m), _dismissals(m, 3), KEY, "scope-1", PARTS.revision)


@_query(f"""with {_members_sql()}, {_TWO}, held as (select distinct low, high from two where split_part(low, ':', 2)::bigint % 2 = 0), fresh as (select distinct low, high from two where split_part(low, ':', 2)::bigint % 3 = 0)
select coalesce(h.low, f.low) low, coalesce(h.high, f.high) high, f.low is null reopened from held h full join fresh f on h.low = f.low and h.high = f.high""")
def dismissal_upsert(spark, d):
    m = _published(spark, d)
    held = _dismissals(m, 2).withColumn("reopened_at", F.lit(NOW).cast("timestamp"))
    out = dismiss.upsert(held, _dismissals(m, 3))
    return out.select(F.col("record_ids")[0].alias("low"), F.col("record_ids")[1].alias("high"), F.col("reopened_at").isNotNull().alias("reopened"))


_CHOSEN = "chosen as (select a.p_partkey::varchar source_id, b.p_partkey::varchar survivor_id from part a join part b on b.p_partkey = a.p_partkey + 40)"


@_query(f"""with {_members_sql()}, {_CHOSEN} select source_id, survivor_id, string_agg(distinct a.rule_id, ',' order by a.rule_id) rules
from chosen join members a on a.record_id = source_id join members b on b.record_id = survivor_id and b.rule_id = a.rule_id and b.digest = a.digest group by all""")
def direct_match(spark, d):
    k = F.col("p_partkey")
    pairs = _part(spark, d).select(k.cast("string").alias("source_id"), (k + 40).cast("string").alias("survivor_id"))
    return suggest.direct_matches(pairs, _published(spark, d)).withColumn("rules", _shown(F.col("rules")))


@_query(f"""with {_members_sql()}, joined as (select a.record_id a, b.record_id b, c.record_id c from members a join members b on a.rule_id = 'name' and b.rule_id = 'name' and a.digest = b.digest and a.record_id <> b.record_id
  join members b2 on b2.rule_id = 'spec' and b2.record_id = b.record_id join members c on c.rule_id = 'spec' and c.digest = b2.digest and c.record_id <> b.record_id and c.record_id <> a.record_id)
select distinct j.a, j.c from joined j where not exists (select 1 from members x join members y on x.rule_id = y.rule_id and x.digest = y.digest where x.record_id = j.a and y.record_id = j.c)""")
def overlap_no_closure(spark, d):
    """a-b by name and b-c by specification do not make a-c: the chains whose ends share no rule."""
    return suggest.open_chains(_members(spark, d), NAME.id, SPEC.id)


@_query(f"""with two as (select 'int:' || a.p_partkey a, 'int:' || b.p_partkey b from part a join part b on b.p_partkey = a.p_partkey + 1)
select a, b, {_sql_keyed(["dismissal-pair", "scope-1"], "to_json([least(a, b), greatest(a, b)])::varchar")} pair_hash from two""")
def pair_hash(spark, d):
    k = F.col("p_partkey")
    p = _part(spark, d)
    pairs = p.join(p.select((k - 1).alias("p_partkey")), "p_partkey").select(F.concat(F.lit("int:"), k.cast("string")).alias("a"), F.concat(F.lit("int:"), (k + 1).cast("string")).alias("b"))
    return pairs.withColumn("pair_hash", digest.pair_hash(KEY, "scope-1", F.col("b"), F.col("a")))


# -- review -------------------------------------------------------------------------------


def _now_parts(spark, d) -> DataFrame:
    """Parts as they are after the scan: every 13th is gone, every 11th has another name."""
    k = F.col("p_partkey")
    return _part(spark, d).where(k % 13 != 0).withColumn("p_name", F.when(k % 11 == 0, F.concat("p_name", F.lit(" v2"))).when(k % 17 == 0, "").otherwise(F.col("p_name")))


_NOW_SQL = "now as (select p_partkey, case when p_partkey % 11 = 0 then p_name || ' v2' when p_partkey % 17 = 0 then '' else p_name end p_name, p_brand, p_type, p_size from part where p_partkey % 13 <> 0)"
_FLAGS = f"""with {_LEDGER_SQL}, {_NOW_SQL}, {_members_sql()}, {_BUCKETS}, {_TOPK}, {_members_sql('now', 'live')},
flags as (select t.rule_id, t.digest, t.record_id, n, case when k.p_partkey is null then null when k.p_name <> '' then k.p_name else '#' || t.record_id end title, k.p_partkey is null missing, t.record_id in (select source_id from ledger) retired,
  k.p_partkey is not null and l.digest is distinct from t.digest changed from top t left join now k on k.p_partkey::varchar = t.record_id left join live l on l.record_id = t.record_id and l.rule_id = t.rule_id where rn <= 4)"""


def _review(spark, d) -> DataFrame:
    m = _published(spark, d)
    shown = suggest.first_members(m, suggest.buckets(m), 4)
    return review.members(PARTS, shown, _now_parts(spark, d), _part_ledger(spark, d), DOMAIN, KEY)


@_query(_FLAGS + "select rule_id, digest, record_id, title, missing, retired, changed, not missing and not retired usable, missing or retired or changed stale from flags")
def review_members_flags(spark, d):
    return _review(spark, d).select("rule_id", "digest", "record_id", "title", "missing", "retired", "changed", "usable", "stale")


@_query(_FLAGS + "select rule_id, digest, string_agg(record_id, ',' order by record_id) members, max(n) n, greatest(0, max(n) - 4) hidden, bool_or(missing or retired or changed) stale, count_if(not missing and not retired) >= 2 reviewable from flags group by all")
def review_groups(spark, d):
    g = review.groups(_review(spark, d))
    return g.withColumn("members", F.array_join("members.record_id", ","))


@_query(_FLAGS + "select record_id, rule_id from flags where changed")
def signature_changed(spark, d):
    return _review(spark, d).where("changed").select("record_id", "rule_id")


@_query(f"with {_NOW_SQL} select p_partkey, case when p_name = '' then '#' || p_partkey else p_name end review_title, p_name plan_title from now")
def title_projection(spark, d):
    p, t, k = _now_parts(spark, d), F.col("p_name"), F.col("p_partkey")
    return p.select("p_partkey", review.review_title(t, k).alias("review_title"), review.plan_title(t, k).alias("plan_title"))


def _scans(spark, d) -> tuple[DataFrame, DataFrame]:
    """Scopes are nations and scans are orders, so every state and time occurs."""
    o, k = host(spark, d, "orders"), F.col("o_orderkey")
    state = F.element_at(F.array(*[F.lit(s) for s in ("queued", "running", "succeeded", "failed", "cancelled")]), (k % 5 + 1).cast("int"))
    day = lambda n: F.col("o_orderdate") + F.make_interval(days=F.lit(n))
    scans = o.select(k.cast("string").alias("id"), (F.col("o_custkey") % 30).cast("string").alias("scope_id"), F.concat(F.lit("g"), k.cast("string")).alias("generation_id"), state.alias("state"), F.when(k % 4 != 0, day(1)).alias("heartbeat_at"), F.when(k % 5 >= 2, day(2)).alias("finished_at"), F.col("o_orderdate").alias("created_at"))
    scopes = host(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("g"), (F.col("n_nationkey") * 4 + 2).cast("string"))).alias("current_generation_id"))
    return scopes, scans


_SCANS_SQL = """scans as (select o_orderkey::varchar id, (o_custkey % 30)::varchar scope_id, 'g' || o_orderkey generation_id, ['queued', 'running', 'succeeded', 'failed', 'cancelled'][(o_orderkey % 5 + 1)::int] state,
  case when o_orderkey % 4 <> 0 then o_orderdate + interval 1 day end heartbeat_at, case when o_orderkey % 5 >= 2 then o_orderdate + interval 2 day end finished_at, o_orderdate created_at from orders),
scopes as (select n_nationkey::varchar id, case when n_nationkey % 3 <> 0 then 'g' || (n_nationkey * 4 + 2) end current_generation_id from nation)"""
_SUMMARY_SQL = f"""with {_SCANS_SQL}, last as (select scope_id, arg_max(state, (created_at, id)) scan_state from scans group by 1), done as (select scope_id, max(finished_at) finished_at from scans where state = 'succeeded' group by 1),
counts as (select (c_nationkey)::varchar scope_id, count(*) n_buckets from customer where c_nationkey % 4 <> 1 group by 1),
s as (select s.id scope_id, case when scan_state in ('queued', 'running') then 'scanning' when scan_state = 'failed' then 'failed' when current_generation_id is null then 'never-scanned' when coalesce(n_buckets, 0) > 0 then 'has-results' else 'empty' end review_state, coalesce(n_buckets, 0) n_buckets, finished_at
  from scopes s left join last on last.scope_id = s.id left join done on done.scope_id = s.id left join counts on counts.scope_id = s.id)"""


def _summaries(spark, d) -> DataFrame:
    counts = host(spark, d, "customer").where("c_nationkey % 4 <> 1").groupBy(F.col("c_nationkey").cast("string").alias("scope_id")).agg(F.count("*").alias("n_buckets"))
    return review.summary(*_scans(spark, d), counts)


@_query(_SUMMARY_SQL + "select * from s")
def review_summary(spark, d):
    return _summaries(spark, d)


@_query(_SUMMARY_SQL + "select scope_id, case review_state when 'failed' then 'danger' when 'has-results' then 'warning' when 'scanning' then 'info' when 'empty' then 'success' else 'gray' end tone, n_buckets, n_buckets > 0 reviewable, review_state <> 'never-scanned' published from s")
def review_banner(spark, d):
    return review.banner(_summaries(spark, d)).select("scope_id", "tone", "n_buckets", "reviewable", review.has_published(F.col("review_state")).alias("published"))


@_query(f"with {_SCANS_SQL} select id, state from scans where (state = 'queued' and created_at < timestamp '1996-01-01') or (state = 'running' and coalesce(heartbeat_at, created_at) < timestamp '1996-01-01')")
def scan_stalled(spark, d):
    return _scans(spark, d)[1].where(review.stalled(F.lit("1996-01-01").cast("timestamp"))).select("id", "state")


@_query(f"""with {_SCANS_SQL} select s.id, s.scope_id from scans s left join scopes c on c.id = s.scope_id
where state in ('succeeded', 'failed', 'cancelled') and finished_at < timestamp '1997-01-01' and (current_generation_id is null or generation_id <> current_generation_id)""")
def scan_prunable(spark, d):
    scopes, scans = _scans(spark, d)
    return review.prunable(scans, scopes, F.lit("1997-01-01").cast("timestamp")).select("id", "scope_id")


@_query(f"with {_LEDGER_SQL}, {_members_sql('(select * from part where p_partkey::varchar not in (select source_id from ledger))')} select (select count(*) from part) scanned, (select count(*) from members) indexed, (select count(*) from ledger) skipped_retired")
def scan_counters(spark, d):
    """Read, indexed and skipped rows in one pass."""
    own = keys.with_record_id(PARTS, _part(spark, d))
    n = sum((F.when(keys.rule_digest(PARTS, r, KEY, own.schema).isNotNull(), 1).otherwise(0) for r in PARTS.rules), F.lit(0))
    marked = resolve.is_retired(own.withColumn("n_keys", n), _part_ledger(spark, d), DOMAIN)
    return marked.agg(F.count("*").alias("scanned"), F.sum(F.when(~F.col("retired"), F.col("n_keys"))).alias("indexed"), F.count_if("retired").alias("skipped_retired"))


# -- comparison and plans -------------------------------------------------------------------


@_query(f"with {_ORDERS_SQL} select source_id, survivor_id, 'lower-id' reason from pairs")
def survivor_recommend(spark, d):
    return compare.recommend(ORDERS, _candidates(spark, d), _orders(spark, d))


@_query("""with p as (select a.o_orderkey ak, b.o_orderkey bk, a.o_orderdate ad, b.o_orderdate bd from orders a join orders b on b.o_orderkey = a.o_orderkey + 7)
select case when ad < bd then bk when bd < ad then ak else bk end::varchar source_id, case when ad < bd then ak when bd < ad then bk else ak end::varchar survivor_id, case when ad <> bd then 'older' else 'lower-id' end reason from p""")
def survivor_by_age(spark, d):
    o = _orders(spark, d)
    pairs = o.select(F.col("o_orderkey").cast("string").alias("a"), (F.col("o_orderkey") + 7).cast("string").alias("b"))
    return compare.recommend(ORDERS, pairs, o)


def _both(spark, d) -> tuple[DataFrame, DataFrame]:
    o = _orders(spark, d)
    return compare.joined(ORDERS, _pairs(spark, d), o), o


def _diff(spark, d) -> DataFrame:
    both, o = _both(spark, d)
    return compare.field_diff(ORDERS, both, o.schema)


@_query(f"with {_ORDERS_SQL}, {_SIDES}, {_DIFF} select source_id, survivor_id, field, resolution, source_value, survivor_value, case when resolution in ('both_missing', 'take_source') then source_value else survivor_value end proposed, resolution <> 'retain_survivor' differs from diff")
def field_diff(spark, d):
    return _diff(spark, d).select("source_id", "survivor_id", "field", "resolution", F.col("source.value").alias("source_value"), F.col("survivor.value").alias("survivor_value"), F.col("proposed.value").alias("proposed"), "differs")


@_query(f"with {_ORDERS_SQL}, {_SIDES}, {_DIFF} select source_id, survivor_id, count(*) total, count_if(comparison = 'identical') identical, count_if(comparison = 'different') different, count_if(comparison in ('source_only', 'survivor_only')) one_sided, count_if(comparison = 'empty') empty from diff group by all")
def diff_summary(spark, d):
    return compare.diff_summary(_diff(spark, d))


@_query(f"with {_ORDERS_SQL}, {_SIDES}, {_DIFF} select source_id, survivor_id, field from diff where field in ('status', 'priority') and resolution = 'choice_required'")
def unique_blockers(spark, d):
    return compare.unique_blockers(ORDERS, _diff(spark, d))


@_query(f"""with {_ORDERS_SQL}, n as (select l_orderkey::varchar k, count(*) c from lineitem group by 1)
select source_id, survivor_id, coalesce(a.c, 0) moving, coalesce(b.c, 0) as current, coalesce(a.c, 0) + coalesce(b.c, 0) resulting, 'Move ' || coalesce(a.c, 0) || ' lines to ' || survivor_id || '; resulting total ' || (coalesce(a.c, 0) + coalesce(b.c, 0)) || '.' summary
from pairs left join n a on a.k = source_id left join n b on b.k = survivor_id""")
def relation_impact(spark, d):
    return compare.impacts(ORDERS, LINES, _pairs(spark, d), _lines(spark, d)).drop("relation", "too_large")


@_query(f"with {_ORDERS_SQL}, n as (select l_orderkey::varchar k, count(*) c from lineitem group by 1) select source_id, survivor_id, coalesce(c, 0) > 5 too_large from pairs left join n on k = source_id")
def relation_cap(spark, d):
    return compare.impacts(ORDERS, LINES, _pairs(spark, d), _lines(spark, d), labels=False).select("source_id", "survivor_id", "too_large")


@_query(f"""with {_ORDERS_SQL} select distinct source_id, survivor_id from pairs join lineitem a on a.l_orderkey::varchar = source_id join lineitem b on b.l_orderkey::varchar = survivor_id and b.l_linenumber = a.l_linenumber
union select source_id, survivor_id from pairs join lineitem a on a.l_orderkey::varchar = source_id group by source_id, survivor_id, l_linenumber having count(*) > 1""")
def relation_collision(spark, d):
    return compare.collisions(LINES, _pairs(spark, d), _lines(spark, d)).select("source_id", "survivor_id")


@_query(f"""with {_ORDERS_SQL}, n as (select l_orderkey::varchar k, count(*) c from lineitem group by 1)
select source_id, survivor_id from pairs join n a on a.k = source_id left join n b on b.k = survivor_id where a.c > 1 or b.c >= 1""")
def single_child(spark, d):
    """A unique key of the foreign key alone allows one child in all."""
    return compare.collisions(replace(LINES, unique_keys=(("l_orderkey",),)), _pairs(spark, d), _lines(spark, d)).select("source_id", "survivor_id")


@_query(f"with {_ORDERS_SQL} select source_id, survivor_id, source_id in (select l_orderkey::varchar from lineitem where l_partkey % 10 = 0) changed from pairs")
def inventory_changed(spark, d):
    """A child that is gone changes the fingerprint of its pair."""
    o, pairs, lines = _orders(spark, d), _pairs(spark, d), _lines(spark, d)
    kids = [compare.child_ids(LINES, pairs, x) for x in (lines, lines.where("l_partkey % 10 <> 0"))]
    a, b = (compare.fingerprints(ORDERS, pairs, o, KEY, k).withColumnRenamed("fingerprint", n) for k, n in zip(kids, "ab"))
    return a.join(b, compare.PAIR).select(*compare.PAIR, (F.col("a") != F.col("b")).alias("changed"))


@_query(f"with {_ORDERS_SQL} select source_id, survivor_id, string_agg('int:' || l_linenumber, ',' order by l_linenumber) child_ids from pairs join lineitem on l_orderkey::varchar = source_id group by all")
def child_inventory(spark, d):
    return compare.child_ids(LINES, _pairs(spark, d), _lines(spark, d)).withColumn("child_ids", _shown(F.col("child_ids")))


@_query(f"with {_ORDERS_SQL} select source_id, survivor_id, source_id::bigint % 4 = 0 or survivor_id::bigint % 4 = 0 changed from pairs")
def fingerprint_changed(spark, d):
    """Fingerprints before and after an edit of every fourth record; a new updated_at alone changes none."""
    o = _orders(spark, d)
    edited = o.withColumn("status", F.when(F.col("o_orderkey") % 4 == 0, F.concat("status", F.lit("!"))).otherwise(F.col("status"))).withColumn("updated_at", F.lit(NOW).cast("timestamp"))
    pairs = _pairs(spark, d)
    a, b = (compare.fingerprints(ORDERS, pairs, x, KEY).withColumnRenamed("fingerprint", n) for x, n in ((o, "a"), (edited, "b")))
    return a.join(b, compare.PAIR).select(*compare.PAIR, (F.col("a") != F.col("b")).alias("changed"))


_BLOCKERS = f"""with {_ORDERS_SQL}, {_SIDES}, {_DIFF}, n as (select l_orderkey::varchar k, count(*) c from lineitem group by 1),
hit as (select distinct source_id, survivor_id from pairs join lineitem a on a.l_orderkey::varchar = source_id join lineitem b on b.l_orderkey::varchar = survivor_id and b.l_linenumber = a.l_linenumber
  union select source_id, survivor_id from pairs join lineitem a on a.l_orderkey::varchar = source_id group by source_id, survivor_id, l_linenumber having count(*) > 1),
b as (select source_id, survivor_id, 'source_retired' b from pairs where source_id::bigint % 6 = 0
 union all select source_id, survivor_id, 'survivor_retired' from pairs where survivor_id::bigint % 10 = 0
 union all select source_id, survivor_id, 'merge_too_large:lines' from pairs join n on k = source_id where c > 5
 union all select source_id, survivor_id, 'collision:lines' from hit
 union all select source_id, survivor_id, 'choice_required:' || field from diff where resolution = 'choice_required'
 union all select source_id, survivor_id, 'unique_field:' || field from diff where resolution = 'choice_required' and field in ('status', 'priority'))"""


def _order_ledger(spark, d) -> DataFrame:
    """Some sources and survivors are retired already; string ids of equal text are other records."""
    ends = _pairs(spark, d).select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(6).alias("by")), F.struct(F.col("survivor_id").alias("id"), F.lit(10).alias("by")))).alias("x")).select("x.*")
    kind = F.when(F.col("id").cast("long") % F.col("by") == 0, "int").when(F.col("id").cast("long") % 4 == 1, "string")
    ends = ends.withColumn("kind", kind).where("kind is not null")
    return ends.select(F.lit(DOMAIN).alias("retirement_domain"), F.col("id").alias("source_id"), F.col("kind").alias("source_id_type"), F.lit("0").alias("survivor_id"))


def _plan(spark, d) -> DataFrame:
    o = _orders(spark, d)
    return compare.plan(ORDERS, _pairs(spark, d), o, {"lines": _lines(spark, d)}, _order_ledger(spark, d), DOMAIN, KEY, keys.build_keys(ORDERS, o, KEY))


@_query(_BLOCKERS + "select p.source_id, p.survivor_id, coalesce(string_agg(b, ',' order by b), '') blockers, 'customer-day' reasons from pairs p left join b using (source_id, survivor_id) group by all")
def merge_plan(spark, d):
    return _plan(spark, d).select("source_id", "survivor_id", _shown(F.array_sort("blockers")).alias("blockers"), _shown(F.col("reasons")).alias("reasons"))


@_query(_BLOCKERS + ", f as (select p.source_id, p.survivor_id, count_if(b is not null and b not like 'choice%') fatal, count_if(b like 'choice%') choices from pairs p left join b using (source_id, survivor_id) group by all) select source_id, survivor_id, fatal + choices = 0 confirmable, fatal = 0 as with_choices from f")
def merge_confirmable(spark, d):
    p = _plan(spark, d)
    all_chosen = F.create_map(*[F.lit(x) for f in ORDERS.fields for x in (f.name, "survivor")])
    return p.select("source_id", "survivor_id", compare.confirmable(F.col("blockers")).alias("confirmable"), compare.can_confirm(F.col("blockers"), all_chosen).alias("with_choices"))


# -- merges ---------------------------------------------------------------------------------


def _batch(spark, d) -> DataFrame:
    """Every pair with explicit choices: status from the source, priority by policy, note from the survivor."""
    choices = F.create_map(F.lit("status"), F.lit("source"), F.lit("note"), F.lit("survivor"))
    return _pairs(spark, d).withColumn("choices", choices).withColumn("operation_id", F.concat(F.lit("op-"), "source_id"))


_TAKEN = """taken as (select survivor_id, source_status status, coalesce(survivor_priority, source_priority) priority, survivor_note note from sides)"""


@_query(f"with {_ORDERS_SQL}, {_SIDES}, {_TAKEN} select o_orderkey, coalesce(t.status, o.status) status, case when t.survivor_id is not null then t.priority else o.priority end priority, o.note from ord o left join taken t on t.survivor_id = o.o_orderkey::varchar")
def merge_apply_survivor(spark, d):
    return apply.merged_records(ORDERS, _orders(spark, d), _batch(spark, d), NOW).select("o_orderkey", "status", "priority", "note")


@_query(f"with {_ORDERS_SQL} select coalesce(survivor_id::bigint, l_orderkey) l_orderkey, l_linenumber, l_partkey from lineitem left join pairs on source_id = l_orderkey::varchar")
def merge_apply_children(spark, d):
    return apply.moved_children(LINES, _lines(spark, d), _batch(spark, d))


@_query(f"with {_ORDERS_SQL} select o_orderkey, source_id is not null retired from ord left join pairs on source_id = o_orderkey::varchar")
def merge_retired_source(spark, d):
    return apply.merged_records(ORDERS, _orders(spark, d), _batch(spark, d), NOW).select("o_orderkey", F.col("deleted_at").isNotNull().alias("retired"))


@_query(f"with {_ORDERS_SQL} select source_id, 'int' source_id_type, survivor_id, 'op-' || source_id operation_id, 2 retirement_domain_version from pairs")
def merge_ledger(spark, d):
    book = apply.ledger_rows(ORDERS, _orders(spark, d), _batch(spark, d), _context(ORDERS), DOMAIN, NOW, AUDIT_KEY)
    return book.select("source_id", "source_id_type", "survivor_id", "operation_id", "retirement_domain_version")


@_query(f"""with {_ORDERS_SQL}, {_SIDES} select 'op-' || source_id operation_id, {_policy('status')} status_resolution, 'source' status_choice, source_status status_after, null::varchar note_after from sides""")
def merge_audit(spark, d):
    """The audit payload, decrypted again: values only of audited fields."""
    book = apply.ledger_rows(ORDERS, _orders(spark, d), _batch(spark, d), _context(ORDERS), DOMAIN, NOW, AUDIT_KEY)
    v = "struct<type:string,value:string>"
    body = F.from_json(apply.decrypt(F.col("audit_payload"), AUDIT_KEY), f"fields array<struct<field:string,resolution:string,choice:string,before:{v},after:{v}>>, revision string")
    return book.select("operation_id", body["fields"].alias("f")).select("operation_id", F.col("f")[0]["resolution"].alias("status_resolution"), F.col("f")[0]["choice"].alias("status_choice"), F.col("f")[0]["after"]["value"].alias("status_after"), F.col("f")[2]["after"]["value"].alias("note_after"))


@_query(f"""with {_ORDERS_SQL}, {_SIDES}, {_TAKEN}, after as (select o_orderkey, coalesce(t.status, o.status) status, case when t.survivor_id is not null then t.priority else o.priority end priority from ord o left join taken t on t.survivor_id = o.o_orderkey::varchar where o_orderkey::varchar not in (select source_id from pairs))
select 'unique:status,priority' violation, count(*) n from (select status, priority from after where status is not null and priority is not null group by all having count(*) > 1) having count(*) > 0""")
def merge_postconditions(spark, d):
    """Violations by kind. The unique key of this definition is violated by the data itself; nothing else may be."""
    o, batch, kids = _orders(spark, d), _batch(spark, d), _lines(spark, d)
    book = apply.ledger_rows(ORDERS, o, batch, _context(ORDERS), DOMAIN, NOW, AUDIT_KEY)
    bad = apply.postconditions(ORDERS, batch, o, apply.merged_records(ORDERS, o, batch, NOW), {"lines": apply.moved_children(LINES, kids, batch)}, book, DOMAIN)
    return bad.groupBy("violation").agg(F.count("*").alias("n"))


@_query(f"with {_ORDERS_SQL} select source_id, 'op-' || source_id operation_id, case when source_id::bigint % 3 = 0 then 'choices' end problem from pairs where source_id::bigint % 2 = 0")
def merge_replay(spark, d):
    """Operations that are in the ledger; with other choices they are another merge."""
    batch = _batch(spark, d)
    book = apply.ledger_rows(ORDERS, _orders(spark, d), batch, _context(ORDERS), DOMAIN, NOW, AUDIT_KEY).where(F.col("source_id").cast("long") % 2 == 0)
    other = F.create_map(F.lit("status"), F.lit("survivor"), F.lit("note"), F.lit("survivor"))
    again = batch.withColumn("choices", F.when(F.col("source_id").cast("long") % 3 == 0, other).otherwise(F.col("choices")))
    return apply.replays(again, book, _context(ORDERS), AUDIT_KEY).select("source_id", "operation_id", "problem")


MERGEABLE = replace(ORDERS, id="orders-open", unique_keys=(), relations=(replace(LINES, unique_keys=(), cap=None),))
_DECIDED = {"status": "source", "priority": "survivor", "note": "survivor"}


def _desk(spark, d) -> Desk:
    """The orders and lines in a store of their own."""
    store = Store(spark, f"{work_root(spark)}/desk-{dt.datetime.now().timestamp():.6f}")
    orders, lines = _orders(spark, d), _lines(spark, d)
    desk = Desk(store, MERGEABLE, {"orders": orders.schema, "lineitem": lines.schema}, KEY, AUDIT_KEY, lambda: NOW)
    desk.load(orders=orders, lineitem=lines)
    return desk


def _decided(desk: Desk, spark, d) -> DataFrame:
    plans = desk.plan(_context(MERGEABLE), _pairs(spark, d)).select(*compare.PAIR, "fingerprint")
    choices = F.create_map(*[F.lit(x) for kv in _DECIDED.items() for x in kv])
    return cut(plans.withColumn("choices", choices).withColumn("operation_id", F.concat(F.lit("op-"), "source_id")))


@_query(f"""with {_ORDERS_SQL}, {_SIDES}, n as (select coalesce(survivor_id::bigint, l_orderkey) k, count(*) n from lineitem left join pairs on source_id = l_orderkey::varchar group by 1)
select o_orderkey, coalesce(s.source_status, o.status) status, o.priority, o.note, o_orderkey::varchar in (select source_id from pairs) retired, coalesce(n, 0) n_lines, (select count(*) from pairs) n_ledger
from ord o left join sides s on s.survivor_id = o.o_orderkey::varchar left join n on k = o_orderkey""")
def merge_commit(spark, d):
    """All decided merges, committed; what the store holds afterwards. The second commit of the batch changes nothing."""
    desk = _desk(spark, d)
    plans = _decided(desk, spark, d)
    for _ in range(2):
        desk.merge(_context(MERGEABLE), plans)
    state = desk.store.state()
    lines = desk.table("lineitem", state).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    out = desk.table("orders", state).join(lines, "o_orderkey", "left").select("o_orderkey", "status", "priority", "note", F.col("deleted_at").isNotNull().alias("retired"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    return out.crossJoin(F.broadcast(desk.ledger(state).agg(F.count("*").alias("n_ledger"))))  # one row


@_query(f"""with {_ORDERS_SQL}, {_SIDES}, n as (select l_orderkey::varchar k, count(*) n from lineitem group by 1)
select 'op-' || source_id operation_id, coalesce(n, 0) moved_total, to_json(source_status)::varchar as written_status, false replayed from sides left join n on k = source_id""")
def merge_results(spark, d):
    """What each operation wrote and moved, as the audit of the ledger has it."""
    desk = _desk(spark, d)
    out = desk.merge(_context(MERGEABLE), _decided(desk, spark, d))
    return out.select("operation_id", "moved_total", F.col("written")["status"].alias("written_status"), "replayed")


@_query(f"""with {_ORDERS_SQL}, {_SIDES}, one as (select * from sides order by source_id limit 1), f as (select *, unnest(['status', 'priority', 'note']) as field from one)
select 'op-' || source_id operation_id, 'int:' || source_id source_id, 'int:' || survivor_id survivor_id, field, case field when 'status' then 'source' else 'survivor' end choice, case when field = 'status' then source_status end as after, field <> 'note' audited, 'customer-day' reasons, (select count(*) from lineitem where l_orderkey::varchar = f.source_id) moved from f""")
def audit_read(spark, d):
    """The audit of the first operation, a row a field."""
    desk = _desk(spark, d)
    context = _context(MERGEABLE)
    plans = _decided(desk, spark, d)
    desk.merge(context, plans)
    first = plans.orderBy("source_id").first()
    if first is None:
        return spark.createDataFrame([], "operation_id string, source_id string, survivor_id string, field string, choice string, after string, audited boolean, reasons string, moved long")
    a = desk.audit_read(context, first["operation_id"])
    rows = [(a["operation_id"], a["source_id"], a["survivor_id"], f["field"], f["choice"], (f.get("after") or {}).get("value"), f["audited"], ",".join(a["reasons"]), sum(r["count"] for r in a["relations"])) for f in a["fields"]]
    return spark.createDataFrame(rows, "operation_id string, source_id string, survivor_id string, field string, choice string, after string, audited boolean, reasons string, moved long")


@_query(f"""with {_ORDERS_SQL}, {_SIDES}, kids as (select distinct l_orderkey::varchar k from lineitem where l_partkey % 50 = 0)
select source_id, survivor_id, source_status = 'P' or survivor_status = 'P' or source_id::bigint % 5 = 0 records, source_id in (select k from kids) children from sides""")
def record_authorization(spark, d):
    """Both records must be visible to the actor, the pair permitted and every child that would move."""
    limits = AbilityMap(frozenset(Ability), F.col("status") != "P", F.col("source__o_orderkey") % 5 != 0, F.col("l_partkey") % 50 != 0)
    o = _orders(spark, d)
    p = compare.plan(replace(MERGEABLE, authorizer=limits), _pairs(spark, d), o, {"lines": _lines(spark, d)}, None, DOMAIN, KEY)
    return p.select("source_id", "survivor_id", F.array_contains("blockers", "forbidden_operation").alias("records"), F.array_contains("blockers", "forbidden_operation:lines").alias("children"))


@_query(f"with {_ORDERS_SQL}, ends as (select source_id::bigint id from pairs union select survivor_id::bigint from pairs) select 'int:' || id encoded, row_number() over (order by id)::int place from ends")
def lock_order(spark, d):
    ends = _pairs(spark, d).select(F.explode(F.array("source_id", "survivor_id")).alias("id")).select(F.col("id").cast("long")).distinct()
    rid = values.record_id(F.col("id"), ends.schema["id"].dataType)
    return numbered(ends.select(values.encode_id(rid).alias("encoded"), values.id_order(rid).alias("o")), [F.col("o")]).drop("o")


@_query(f"with {_ORDERS_SQL} select 'op-' || source_id operation_id, source_id::bigint % 2 = 0 expired from pairs")
def preview_expiry(spark, d):
    plans = _plan(spark, d).withColumn("operation_id", F.concat(F.lit("op-"), "source_id"))
    held = previews.rows(plans, _context(ORDERS), AUDIT_KEY, NOW, 30)
    odd = F.substring_index("operation_id", "-", -1).cast("long") % 2 == 0
    held = held.withColumn("expires_at", F.when(odd, F.lit(NOW - dt.timedelta(days=1)).cast("timestamp")).otherwise(F.col("expires_at")))
    kept, _ = previews.prune(held, NOW)
    return held.select("operation_id").join(kept.select("operation_id", F.lit(True).alias("k")), "operation_id", "left").select("operation_id", F.col("k").isNull().alias("expired"))


# -- ledger ---------------------------------------------------------------------------------


@_query(f"with {_LEDGER_SQL} select source_id, survivor_id, row_number() over (order by source_id::bigint)::int place from ledger")
def ledger_mappings(spark, d):
    rows = resolve.mappings(_part_ledger(spark, d), DOMAIN)
    return numbered(rows, [F.col("committed_at"), F.col("operation_id")]).select("source_id", "survivor_id", "place")


def _chain_ledger(spark, d) -> DataFrame:
    """Chains of up to eleven hops inside blocks of sixteen, a loop in every tenth block, and one hop of string ids."""
    k = F.col("p_partkey")
    p = _part(spark, d)
    to = F.when((F.floor(k / 16) % 10 == 0) & (k % 16 == 1), k + 2).otherwise(k - 1)
    edge = lambda kind, to: [F.lit(DOMAIN).alias("retirement_domain"), k.cast("string").alias("source_id"), F.lit(kind).alias("source_id_type"), to.alias("survivor_id"), F.lit(kind).alias("survivor_id_type")]
    step = p.where((k % 16 > 0) & (k % 16 <= 12)).select(*edge("int", to.cast("string")))
    return step.unionByName(p.where(k % 8 == 5).select(*edge("string", F.concat(F.lit("x"), k.cast("string")))))


_CHAIN = """with recursive e as (select p_partkey s, case when (p_partkey // 16) % 10 = 0 and p_partkey % 16 = 1 then p_partkey + 2 else p_partkey - 1 end t from part where p_partkey % 16 > 0 and p_partkey % 16 <= 12),
c as (select p_partkey r, p_partkey cur, 0 hops from part union all select r, t, hops + 1 from c join e on s = cur where hops <= 10),
m as (select r, arg_max(cur, hops) cur, max(hops) hops from c group by r)
select r::varchar record_id, 'int' record_id_type, case when hops <= 10 then cur::varchar end survivor_id, case when hops <= 10 then 'int' end survivor_id_type, least(hops, 10)::int hops, case when hops > 10 then 'unresolvable' else 'resolved' end status from m
union all select p_partkey::varchar, 'string', case when p_partkey % 8 = 5 then 'x' || p_partkey else p_partkey::varchar end, 'string', (p_partkey % 8 = 5)::int, 'resolved' from part where p_partkey % 4 = 1"""


@_query(_CHAIN)
def survivor_chain(spark, d):
    """Number ids and string ids of the same text have chains of their own."""
    own = keys.with_record_id(PARTS, _part(spark, d)).select("record_id", "record_id_type")
    texts = own.where(F.col("record_id").cast("long") % 4 == 1).withColumn("record_id_type", F.lit("string"))
    return resolve.survivors(own.unionByName(texts), _chain_ledger(spark, d), DOMAIN)


@_query(f"with {_LEDGER_SQL} select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey::varchar in (select p_partkey::varchar from part where p_size <= 40) and l_partkey::varchar not in (select source_id from ledger)")
def writer_guard(spark, d):
    """Retired string ids of the same text do not close a parent."""
    live = keys.with_record_id(PARTS, _part(spark, d).where("p_size <= 40")).select("record_id", "record_id_type")
    book = _part_ledger(spark, d).select("retirement_domain", "source_id", "source_id_type")
    texts = _part(spark, d).select(F.lit(DOMAIN).alias("retirement_domain"), F.col("p_partkey").cast("string").alias("source_id"), F.lit("string").alias("source_id_type"))
    return resolve.guard_new_children(_lines(spark, d), "l_partkey", live, book.unionByName(texts), DOMAIN)


@_query(f"with {_LEDGER_SQL} select source_id, case when source_id::bigint % 2 = 0 then 'new-a' else 'demo' end retirement_domain, 2 retirement_domain_version from ledger")
def domain_migration(spark, d):
    old = F.col("source_id").cast("long") % 2 == 0
    book = _part_ledger(spark, d).withColumn("retirement_domain", F.when(old, "old-a").otherwise(DOMAIN)).withColumn("retirement_domain_version", F.when(old, 1).otherwise(2))
    return resolve.migrate(book, {"old-a": "new-a"}).select("source_id", "retirement_domain", "retirement_domain_version")


@_query(f"with {_LEDGER_SQL} select source_id, 2::bigint n from ledger where source_id::bigint % 5 = 0")
def ledger_terminal_guard(spark, d):
    book = _part_ledger(spark, d)
    return resolve.duplicate_sources(book.unionByName(book.where(F.col("source_id").cast("long") % 5 == 0))).select("source_id", "n")


@_query(f"with {_LEDGER_SQL} select p_partkey::varchar record_id, p_partkey::varchar in (select source_id from ledger) retired from part")
def retired_flags(spark, d):
    return resolve.is_retired(keys.with_record_id(PARTS, _part(spark, d)).select("record_id", "record_id_type"), _part_ledger(spark, d), DOMAIN).select("record_id", "retired")


# -- scans of host tables ---------------------------------------------------------------------


@_query("""with t as (select p_partkey, case p_partkey % 4 when 0 then -p_partkey when 1 then p_partkey * 1000000007 else p_partkey end v from part) select p_partkey, row_number() over (order by v, p_partkey)::int place, 'int:' || v encoded from t""")
def record_id_order(spark, d):
    k = F.col("p_partkey")
    p = _part(spark, d).select("p_partkey", F.when(k % 4 == 0, -k).when(k % 4 == 1, k * 1000000007).otherwise(k).alias("v"))
    rid = values.record_id(F.col("v"), p.schema["v"].dataType)
    rows = p.select("p_partkey", values.encode_id(rid).alias("encoded"))
    order = values.id_order(values.decode_id(F.col("encoded")))
    return numbered(rows.withColumn("o", order), [F.col("o"), F.col("p_partkey")]).drop("o")


@_query("""select c_custkey, case c_custkey % 3 when 0 then 'uuid' when 1 then 'ulid' else 'string' end key_domain from customer""")
def key_domains(spark, d):
    k = F.col("c_custkey")
    hexed = F.lower(F.lpad(F.hex(k), 12, "0"))
    text = F.when(k % 3 == 0, F.concat(F.lit("123e4567-E89B-12d3-a456-"), hexed)).when(k % 3 == 1, F.concat(F.lit("01ARZ3NDEKTSV4"), F.upper(hexed))).otherwise(F.concat(F.lit("key-"), k.cast("string")))
    c = host(spark, d, "customer").select("c_custkey", text.alias("t"))
    return c.select("c_custkey", values.key_domain(F.col("t"), c.schema["t"].dataType).alias("key_domain"))


@_query("select o_orderkey from orders where o_orderkey > 100 order by o_orderkey limit 1000")
def keyset_chunk_scan(spark, d):
    return keyset_chunk(ORDERS, _orders(spark, d), _context(ORDERS), 100, 1000).select("o_orderkey")


@_query("select max(o_orderkey) o_orderkey, max_by(o_orderstatus, o_orderkey) as status from orders")
def row_lookup(spark, d):
    """One record by its key."""
    o = _orders(spark, d)
    r = by_key(ORDERS, o, _context(ORDERS), o.agg(F.max("o_orderkey")).first()[0])
    return spark.createDataFrame([(r["o_orderkey"], r["status"])], "o_orderkey long, status string")


@_query(f"with {_members_sql()} select * from members")
def scan_publish(spark, d):
    """A scan from its reservation to the generation that readers see; a cancelled one leaves nothing."""
    scans = Scans(Store(spark, f"{work_root(spark)}/scans-{dt.datetime.now().timestamp():.6f}"), KEY)
    context, part = _context(PARTS), _part(spark, d)
    scans.cancel(scans.start(PARTS, context))
    scans.run(PARTS, context, scans.start(PARTS, context), part)
    return scans.memberships(context).select("rule_id", "digest", "record_id", "record_id_type")


@_query("select doc_id from documents where source = 'src3' and lang = 'en'")
def scan_visible(spark, d):
    return visible(DOCS, host(spark, d, "documents"), _context(DOCS, "src3")).select("doc_id")


@_query("select doc_id from documents where false")
def scan_no_tenant(spark, d):
    return scoped(DOCS, host(spark, d, "documents"), _context(DOCS)).select("doc_id")


@_query("select w.id record_id, doc_id is not null found from (select range::varchar id from range(0, 400)) w left join (select * from documents where source = 'src3' and lang = 'en') d on d.doc_id::varchar = w.id")
def lookup_many(spark, d):
    wanted = spark.range(400).select(F.col("id").cast("string").alias("record_id"))
    return by_keys(DOCS, host(spark, d, "documents"), _context(DOCS, "src3"), wanted).select("record_id", F.col("doc_id").isNotNull().alias("found"))


@_query("""select o_orderkey, coalesce(nullif(o_orderpriority, '1-URGENT'), '') priority, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' as day, case when o_orderkey % 2 = 0 then 'true' else 'false' end even, o_custkey::varchar customer from orders""")
def value_display(spark, d):
    o = _orders(spark, d).withColumn("even", F.col("o_orderkey") % 2 == 0)
    show = lambda c: values.display(F.col(c), o.schema[c].dataType)
    return o.select("o_orderkey", show("priority").alias("priority"), show("o_orderdate").alias("day"), show("even").alias("even"), show("o_custkey").alias("customer"))


@_query("""with t as (select o_orderkey, nullif(o_orderkey % 7, 3) a, nullif(o_custkey % 7, 5) b, o_orderstatus s, o_orderdate d, o_totalprice::decimal(12, 2) p from orders)
select o_orderkey, a is not distinct from b as numbers, a is null and s is null as mixed, nullif(s, 'F') is not distinct from case when o_orderkey % 2 = 0 then s end as texts, date_trunc('month', d) = d as days, (a % 2 = 1) is not distinct from (b % 2 = 1) as flags, p::varchar = round(p, 0)::decimal(12, 2)::varchar as amounts from t""")
def typed_equality(spark, d):
    """Equal values of one kind are equal, null is equal to null alone, and a number is never the text of it."""
    k = F.col("o_orderkey")
    o = host(spark, d, "orders").select("o_orderkey", F.nullif(k % 7, F.lit(3)).alias("a"), F.nullif(F.col("o_custkey") % 7, F.lit(5)).alias("b"), F.col("o_orderstatus").alias("s"), F.col("o_orderdate").cast("timestamp").alias("d"), F.col("o_totalprice").cast("decimal(12,2)").alias("p"))
    o = o.withColumn("a_text", F.col("a").cast("string")).withColumn("s1", F.nullif("s", F.lit("F"))).withColumn("s2", F.when(k % 2 == 0, F.col("s"))).withColumn("month", F.date_trunc("month", "d"))
    o = o.withColumn("odd_a", F.col("a") % 2 == 1).withColumn("odd_b", F.col("b") % 2 == 1).withColumn("whole", F.round("p", 0).cast("decimal(12,2)"))
    same = lambda x, y: values.typed_equal(*(values.typed(F.col(c), o.schema[c].dataType) for c in (x, y)))
    return o.select("o_orderkey", same("a", "b").alias("numbers"), (same("a", "a_text") & F.col("s").isNull() | same("a", "a_text") & F.col("a").isNotNull()).alias("mixed"), same("s1", "s2").alias("texts"), same("d", "month").alias("days"), same("odd_a", "odd_b").alias("flags"), same("p", "whole").alias("amounts"))


_EVENTS_SQL = f"""with ev as (select event_id, event_type, case when event_id % 20 = 0 then null when event_id % 10 = 0 then user_id + 1 else user_id end user_id from events),
m as (select 'user' rule_id, {_sql_rule(EVENTS, EVENTS.rules[0], "case when user_id is not null then to_json([['integer', user_id::varchar]])::varchar end")} digest, event_id::varchar record_id from ev
union all select 'user-type', {_sql_rule(EVENTS, EVENTS.rules[1], f"case when user_id is not null and trim(event_type, {_BLANK}) <> '' then to_json([['integer', user_id::varchar], ['string', event_type]])::varchar end")}, event_id::varchar from ev)
select * from m where digest is not null"""


@_query(_EVENTS_SQL)
def stream_scan(spark, d):
    """Memberships by a resumable stream, after files with changes arrived: a key that disappeared is gone."""
    from .streaming import incremental

    work = f"{work_root(spark)}/stream-{dt.datetime.now().timestamp():.6f}"
    e, k = host(spark, d, "events"), F.col("event_id")
    late = e.where(k % 10 == 0).withColumn("user_id", F.when(k % 20 != 0, F.col("user_id") + 1).cast(e.schema["user_id"].dataType))
    for part in (e, late):
        part.write.mode("append").parquet(f"{work}/src")
        incremental.start(spark, EVENTS, _context(EVENTS), f"{work}/src", e.schema, f"{work}/out", f"{work}/cursor", KEY).awaitTermination()
    return incremental.memberships(spark, f"{work}/out").select("rule_id", "digest", "record_id")


FIXTURE_RULES = (
    ExactRule("reference", ("reference",), normalize.TrimmedText(lowercase=True)),
    ExactRule("email", ("email",), normalize.Email()),
    ExactRule("name-and-email", ("display_name", "email"), normalize.TrimmedText(lowercase=True)),
)
CONTACTS = Definition("fixture-contacts", "contacts", "id", FIXTURE_RULES, title="display_name", tenant="tenant_id", authorizer=EVERYTHING)


def fixture_contacts(spark: SparkSession, n: int = 100_000) -> DataFrame:
    """The records of the baseline's workload. Of every 500 the first two share a reference."""
    i = F.col("id")
    text = i.cast("string")
    reference = F.when(i % 500 < 2, F.concat(F.lit("BENCH-"), F.floor(i / 500).cast("string"))).otherwise(F.concat(F.lit("UNIQUE-"), text))
    return spark.range(n).select("id", F.lit("tenant-a").alias("tenant_id"), reference.alias("reference"), F.concat(F.lit("person"), text, F.lit("@example.com")).alias("email"), F.concat(F.lit("Person "), text).alias("display_name"))


_CONTACTS_SQL = """contacts as (select range id, case when range % 500 < 2 then 'BENCH-' || range // 500 else 'UNIQUE-' || range end reference, 'person' || range || '@example.com' email, 'Person ' || range display_name from range(100000))"""


def _lower_pair(*columns: str) -> str:
    return "to_json([" + ", ".join(f"['string', lower(trim({c}, {_BLANK}))]" for c in columns) + "])::varchar"


_CONTACT_KEYS = " union all ".join(f"select '{r.id}' rule_id, {_sql_rule(CONTACTS, r, _lower_pair(*r.fields))} digest from contacts" for r in FIXTURE_RULES)


@_query(f"""with {_CONTACTS_SQL}, keys as ({_CONTACT_KEYS}), sizes as (select rule_id, digest, count(*) n from keys where digest is not null group by all)
select max(case when n >= 2 then rule_id end) rule_id, sum(n)::bigint memberships, count_if(n >= 2) buckets, max(n) largest, min(digest) first_digest, max(digest) last_digest from sizes""")
def fixture_100k_scan(spark, d):
    """The baseline's workload, which has no table: counts of its keys, and the least and largest of them."""
    m = keys.build_keys(CONTACTS, scoped(CONTACTS, fixture_contacts(spark), _context(CONTACTS, "tenant-a")), KEY)
    # One pass: bucket sizes, then totals of them.
    sizes = m.groupBy("rule_id", "digest").agg(F.count("*").alias("n"))
    return sizes.agg(F.max(F.when(F.col("n") >= 2, F.col("rule_id"))).alias("rule_id"), F.sum("n").alias("memberships"), F.count_if(F.col("n") >= 2).alias("buckets"), F.max("n").alias("largest"), F.min("digest").alias("first_digest"), F.max("digest").alias("last_digest"))
