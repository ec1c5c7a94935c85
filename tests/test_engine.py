"""Scans, review, dismissals, plans, merges and the ledger on the contacts fixture."""

import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinfold.errors import DomainConflict, ForbiddenOperation, InvalidConfiguration, MergeTooLarge, MissingContext, RecordUnavailable, RetryExhausted, StalePreview
from kinfold.functions import normalize
from kinfold.operators import apply, compare, dismiss, keys, previews, resolve, review, suggest
from kinfold.operators.desk import Desk
from kinfold.operators.lifecycle import Scans, ulid
from kinfold.plans.context import Ability, AbilityMap, DenyAll, NullContextResolver, ServiceContextResolver, require
from kinfold.plans.context import resolve as context_of
from kinfold.plans.definition import Definition, MergeField, Registry, Relation, Retirement, validate
from kinfold.plans.rules import ExactRule
from kinfold.sources.scan import by_key, by_keys, keyset_chunk, stream_rows
from kinfold.sources.store import Conflict, Store
from kinfold.streaming import incremental

KEY, AUDIT, NOW = b"test key", b"0123456789abcdef", dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
LOWER = normalize.TrimmedText(lowercase=True)
NOTES = Relation("notes", "notes", "contact_id", "id", deleted_at="deleted_at", unique_keys=(("contact_id", "body"),), cap=3)
ALL = AbilityMap(frozenset(Ability))
CONTACTS = Definition(
    "fixture-contacts", "contacts", "id",
    (ExactRule("reference", ("reference",), LOWER, "Reference"), ExactRule("email", ("email",), normalize.Email()), ExactRule("name-and-email", ("display_name", "email"), LOWER)),
    title="display_name", domain="crm", tenant="tenant_id", scope_keys=("tenant_id",), deleted_at="deleted_at", created_at="created_at", updated_at="updated_at",
    fields=(MergeField("reference"), MergeField("external_ref"), MergeField("display_name"), MergeField("notes", audited=False, blank_is_missing=True)),
    relations=(NOTES,), unique_keys=(("external_ref",),), authorizer=ALL, retirement=Retirement(), validator=lambda: F.array().cast("array<string>"), guards_writes=True, inventory_acknowledged=True,
)
SCHEMA = "id long, tenant_id string, reference string, external_ref string, email string, display_name string, notes string, created_at timestamp, updated_at timestamp, deleted_at timestamp"
NOTE_SCHEMA = "id long, contact_id long, body string, deleted_at timestamp"


def contacts(spark, *rows):
    base = {"tenant_id": "tenant-a", "reference": None, "external_ref": None, "email": None, "display_name": None, "notes": None, "created_at": NOW, "updated_at": NOW, "deleted_at": None}
    full = [{**base, "id": i + 1, **r} for i, r in enumerate(rows)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)


def notes(spark, *rows):
    return spark.createDataFrame([(i + 1, *r, None) if len(r) == 2 else (i + 1, *r) for i, r in enumerate(rows)], NOTE_SCHEMA)


@pytest.fixture
def context():
    return context_of(CONTACTS, ServiceContextResolver("actor-1", "admin", "tenant-a"), KEY)


def buckets(spark, df):
    m = keys.build_keys(CONTACTS, df, KEY)
    return {r["rule_id"]: r["n"] for r in suggest.buckets(m).collect()}, m


def test_pairs_blanks_and_overlaps(spark):
    found, m = buckets(spark, contacts(spark, {"reference": "ACME"}, {"reference": " acme "}, {"reference": "OTHER"}))
    assert found == {"reference": 2}
    _, m = buckets(spark, contacts(spark, {"reference": None, "email": "not-an-email"}, {"reference": "  "}))
    assert m.count() == 0
    found, m = buckets(spark, contacts(spark, {"reference": "r"}, {"reference": "r", "email": "a@example.com"}, {"email": "a@EXAMPLE.com"}))
    assert found == {"reference": 2, "email": 2}
    pairs = spark.createDataFrame([("1", "2"), ("2", "3"), ("1", "3")], "source_id string, survivor_id string")
    assert sorted((r["source_id"], r["survivor_id"]) for r in suggest.direct_matches(pairs, m).collect()) == [("1", "2"), ("2", "3")]


def test_members_order_is_of_text(spark):
    _, m = buckets(spark, contacts(spark, *[{"reference": "x"} for _ in range(12)]))
    rows = suggest.first_members(m, suggest.buckets(m), 3).orderBy("rn").collect()
    assert [r["record_id"] for r in rows] == ["1", "10", "11"] and rows[0]["hidden"] == 9
    assert suggest.page_count(0, 10) == 1 and suggest.page_count(21, 10) == 3


def test_lifecycle(spark, context, tmp_path):
    events, now = [], [NOW]
    scans = Scans(Store(spark, f"file://{tmp_path}/s"), KEY, lambda: now[0], [lambda *e: events.append(e[0]), lambda *_: 1 / 0])
    df = contacts(spark, {"reference": "a"}, {"reference": "A"}, {"reference": "b", "tenant_id": "tenant-b"}, {"reference": "a", "deleted_at": NOW})
    assert scans.memberships(context).count() == 0
    one = scans.start(CONTACTS, context)
    with pytest.raises(DomainConflict):
        scans.start(CONTACTS, context)
    assert scans.run(CONTACTS, context, one, df) == {"chunks": 1, "scanned": 2, "indexed": 2, "skipped_retired": 0}
    assert scans.memberships(context).count() == 2 and events == ["ScanCompleted"]
    now[0] += dt.timedelta(seconds=1)
    two = scans.start(CONTACTS, context)
    scans.cancel(two)
    with pytest.raises(DomainConflict):
        scans.run(CONTACTS, context, two, df)
    now[0] += dt.timedelta(seconds=1)
    three = scans.start(CONTACTS, context)
    with pytest.raises(DomainConflict):
        scans.publish(replace(CONTACTS, revision="2"), three, {})
    now[0] = NOW + dt.timedelta(hours=1)
    assert scans.recover_stalled(15) == 1
    scopes, log = scans.frames()
    state = review.summary(scopes, log, spark.createDataFrame([(context.scope, 1)], "scope_id string, n_buckets long")).first()
    assert state["review_state"] == "failed" and log.where("failure_code = 'scan_abandoned'").count() == 1
    now[0] = NOW + dt.timedelta(days=90)
    assert scans.prune(30) == 2 and scans.memberships(context).count() == 2
    nobody = context_of(CONTACTS, ServiceContextResolver("actor-1"), KEY)
    four = scans.start(CONTACTS, nobody)
    assert scans.run(CONTACTS, nobody, four, df)["indexed"] == 0
    five = scans.start(CONTACTS, context)
    with pytest.raises(Exception):
        scans.run(CONTACTS, context, five, df.drop("email"))
    assert scans.store.state()["scans"][five]["failure_code"] == "scan_failed"
    with pytest.raises(ForbiddenOperation):
        scans.start(replace(CONTACTS, authorizer=DenyAll()), context)


def test_store_conflicts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit(lambda s: s["tables"].update(a="x"))
    old = store.state()
    store.commit(lambda s: s["tables"].update(b="y"))
    with pytest.raises(Conflict):
        store._publish({**old, "version": 2})
    assert store.state()["tables"] == {"a": "x", "b": "y"} and store.version() == 2
    store._publish = lambda s: (_ for _ in ()).throw(Conflict())
    with pytest.raises(RetryExhausted):
        store.commit(lambda s: None)
    folder = store.write("t", spark.range(3))
    assert spark.read.parquet(folder).count() == 3
    store.drop(folder)
    with pytest.raises(ValueError):
        store.drop("/elsewhere")


def test_review_flags(spark):
    before = contacts(spark, {"reference": "a", "display_name": "A"}, {"reference": "a"}, {"reference": "a"}, {"reference": "a"})
    m = keys.build_keys(CONTACTS, before, KEY)
    now = before.where("id <> 2").withColumn("reference", F.when(F.col("id") == 3, "z").otherwise(F.col("reference")))
    ledger = spark.createDataFrame([("dom", "4", "int")], "retirement_domain string, source_id string, source_id_type string")
    shown = suggest.first_members(m, suggest.buckets(m), 10)
    rows = {r["record_id"]: r for r in review.members(CONTACTS, shown, now, ledger, "dom", KEY).collect()}
    assert rows["1"]["title"] == "A" and not rows["1"]["stale"]
    assert rows["2"]["missing"] and rows["3"]["changed"] and rows["3"]["title"] == "#3" and rows["4"]["retired"]
    group = review.groups(review.members(CONTACTS, shown, now, ledger, "dom", KEY)).first()
    assert group["stale"] and group["reviewable"]


def test_dismissals(spark):
    df = contacts(spark, {"reference": "a"}, {"reference": "a"}, {"reference": "b"}, {"reference": "b"}, {"reference": "b"})
    m = keys.build_keys(CONTACTS, df, KEY)
    sig = keys.signatures(m)
    pair = spark.createDataFrame([("int:2", "int:1")], "a string, b string")
    held = dismiss.upsert(spark.createDataFrame([], dismiss.SCHEMA), dismiss.rows(pair, sig, KEY, "s", "1", "me", NOW))
    hidden = suggest.suppressed(m, sig, held, KEY, "s", "1")
    assert [r["n"] for r in suggest.without(suggest.buckets(m), hidden).collect()] == [3]
    assert dismiss.dismissed(pair, sig, held, KEY, "s", "1").count() == 1
    for other in ({"scope": "t"}, {"revision": "2"}):
        assert suggest.suppressed(m, sig, held, KEY, **{"scope": "s", "revision": "1", **other}).count() == 0
    again = dismiss.reopen(held, [held.first()["pair_hash"]], "s", NOW)
    assert suggest.suppressed(m, sig, again, KEY, "s", "1").count() == 0
    closed = dismiss.upsert(again, dismiss.rows(pair, sig, KEY, "s", "1", "me", NOW))
    assert closed.count() == 1 and closed.first()["reopened_at"] is None
    moved = df.withColumn("email", F.when(F.col("id") == 1, "x@example.com"))
    m2 = keys.build_keys(CONTACTS, moved, KEY)
    assert suggest.suppressed(m2, keys.signatures(m2), held, KEY, "s", "1").count() == 0


def test_field_policy(spark):
    cases = [("SAME", "SAME", "retain_survivor"), (None, "ONLY-SOURCE", "take_source"), ("Alpha", None, "retain_survivor"), (None, None, "both_missing"), ("ONE", "TWO", "choice_required"), ("   ", "Content", "choice_required")]
    for survivor, source, want in cases:
        df = contacts(spark, {"reference": source, "notes": source}, {"reference": survivor, "notes": survivor})
        pairs = spark.createDataFrame([("1", "2")], "source_id string, survivor_id string")
        rows = {r["field"]: r["resolution"] for r in compare.field_diff(CONTACTS, compare.joined(CONTACTS, pairs, df), df.schema).collect()}
        assert rows["reference"] == want
        assert rows["notes"] == ("take_source" if survivor == "   " else want)


PAIRS = "source_id string, survivor_id string"


def planned(spark, df, kids, pairs=(("2", "1"),), ledger=None):
    p = spark.createDataFrame(list(pairs), PAIRS)
    return compare.plan(CONTACTS, p, df, {"notes": kids}, ledger, "dom", KEY, keys.build_keys(CONTACTS, df, KEY))


def test_plan_blockers(spark):
    df = contacts(spark, {"reference": "a", "external_ref": "x"}, {"reference": "A", "external_ref": "y"}, {"reference": "q"})
    kids = notes(spark, (1, "same"), (2, "same"), (2, "other"), (2, "trash", NOW))
    p = planned(spark, df, kids, [("2", "1"), ("1", "1"), ("9", "1")]).collect()
    by = {(r["source_id"], r["survivor_id"]): r for r in p}
    b = by["2", "1"]["blockers"]
    assert b == ["collision:notes", "choice_required:reference", "choice_required:external_ref", "unique_field:external_ref"]
    assert by["2", "1"]["reasons"] == ["reference"] and by["1", "1"]["blockers"][0] == "same_record" and by["9", "1"]["blockers"] == ["record_unavailable"]
    i = by["2", "1"]["impacts"][0]
    assert (i["moving"], i["current"], i["resulting"]) == (2, 1, 3) and i["summary"] == "Move 2 notes to 1; resulting total 3."
    too_many = notes(spark, *[(2, f"n{k}") for k in range(4)])
    assert "merge_too_large:notes" in planned(spark, df, too_many).first()["blockers"]
    assert "merge_too_large:notes" not in planned(spark, df, notes(spark, *[(2, f"n{k}") for k in range(3)])).first()["blockers"]


def test_fingerprints(spark):
    df = contacts(spark, {"reference": "a"}, {"reference": "a"})
    kids = notes(spark, (2, "x"))
    base = planned(spark, df, kids).first()["fingerprint"]
    assert planned(spark, df.withColumn("updated_at", F.current_timestamp()), kids).first()["fingerprint"] == base
    assert planned(spark, df, notes(spark, (2, "x"), (2, "y"))).first()["fingerprint"] != base
    assert planned(spark, df.withColumn("display_name", F.lit("n")), kids).first()["fingerprint"] != base


def test_recommend(spark):
    df = contacts(spark, {"created_at": NOW}, {"created_at": NOW - dt.timedelta(days=1)}, {"created_at": NOW})
    c = spark.createDataFrame([("1", "2"), ("3", "1")], "a string, b string")
    got = {r["source_id"]: (r["survivor_id"], r["reason"]) for r in compare.recommend(CONTACTS, c, df).collect()}
    assert got == {"1": ("2", "older"), "3": ("1", "lower-id")}


def run_merge(spark, context, df, kids, plans, ledger, **more):
    m = keys.build_keys(CONTACTS, df, KEY)
    return apply.execute(CONTACTS, plans, df, df.where("deleted_at is null"), {"notes": kids}, ledger, m, context, "dom", KEY, AUDIT, NOW, **more)


def test_execute(spark, context):
    df = contacts(spark, {"reference": "a", "display_name": "Old"}, {"reference": "a", "display_name": "New", "notes": "kept"}, {"reference": "z"})
    kids = notes(spark, (1, "one"), (2, "two"), (2, "gone", NOW))
    ledger = spark.createDataFrame([], resolve.LEDGER)
    plan = planned(spark, df, kids, ledger=ledger).withColumn("operation_id", F.lit("op-1"))
    undecided = plan.withColumn("choices", F.create_map().cast("map<string,string>"))
    with pytest.raises(DomainConflict, match="choice"):
        run_merge(spark, context, df, kids, undecided, ledger)
    ready = plan.withColumn("choices", F.create_map(F.lit("display_name"), F.lit("source"))).cache()
    ready.count()
    with pytest.raises(StalePreview):
        run_merge(spark, context, df.withColumn("reference", F.lit("b")), kids, ready, ledger)
    with pytest.raises(DomainConflict, match="no key"):
        loose = df.withColumn("reference", F.when(F.col("id") == 1, "a"))
        p = planned(spark, loose, kids, ledger=ledger).withColumn("operation_id", F.lit("x")).withColumn("choices", F.create_map(F.lit("display_name"), F.lit("source")))
        run_merge(spark, context, loose, kids, p, ledger)
    with pytest.raises(DomainConflict, match="more than one pair"):
        run_merge(spark, context, df, kids, ready.unionByName(ready.withColumn("survivor_id", F.lit("3"))), ledger)
    with pytest.raises(DomainConflict, match="not a merge field"):
        run_merge(spark, context, df, kids, ready.withColumn("choices", F.create_map(F.lit("display_name"), F.lit("source"), F.lit("email"), F.lit("source"))), ledger)
    out = run_merge(spark, context, df, kids, ready, ledger)
    rows = {r["id"]: r for r in out["records"].collect()}
    assert rows[1]["display_name"] == "New" and rows[1]["notes"] == "kept" and rows[1]["deleted_at"] is None
    assert rows[2]["deleted_at"] is not None and rows[3]["updated_at"] == rows[3]["created_at"]
    moved = {r["body"]: r["contact_id"] for r in out["children:notes"].collect()}
    assert moved == {"one": 1, "two": 1, "gone": 2} and len(moved) == kids.count()
    book = out["ledger"].cache()
    assert book.count() == 1 and book.first()["survivor_id"] == "1"
    payload = json.loads(book.select(apply.decrypt(F.col("audit_payload"), AUDIT)).first()[0])
    by = {f["field"]: f for f in payload["fields"]}
    assert by["display_name"]["after"]["value"] == "New" and "after" not in by["notes"] or by["notes"]["after"] is None
    assert book.select(apply.decrypt(F.col("audit_payload"), b"f" * 16)).first()[0] is None
    # The same operation again is a no-op; the same source again is refused.
    again = run_merge(spark, context, out["records"], out["children:notes"], ready, book)
    assert again["ledger"].count() == 1 and sorted(map(str, again["records"].collect())) == sorted(map(str, out["records"].collect()))
    with pytest.raises(DomainConflict):
        apply.append_ledger(book, book.withColumn("operation_id", F.lit("op-2")))
    with pytest.raises(MergeTooLarge):
        many = notes(spark, *[(2, f"n{k}") for k in range(4)])
        p = planned(spark, df, many, ledger=ledger).withColumn("operation_id", F.lit("x")).withColumn("choices", F.create_map(F.lit("display_name"), F.lit("source")))
        run_merge(spark, context, df, many, p, ledger)


def test_ledger(spark):
    edges = [("dom", str(i), str(i + 1)) for i in range(1, 13)] + [("dom", "a", "b"), ("dom", "b", "a"), ("other", "z", "y")]
    ledger = spark.createDataFrame(edges, "retirement_domain string, source_id string, survivor_id string")
    ids = spark.createDataFrame([(x,) for x in ("1", "3", "12", "a", "z", "q")], "record_id string")
    seen = spark.createDataFrame([("13",), ("z",)], "record_id string")
    got = {r["record_id"]: (r["survivor_id"], r["status"]) for r in resolve.survivors(ids, ledger, "dom", seen).collect()}
    assert got == {"1": (None, "unresolvable"), "3": ("13", "resolved"), "12": ("13", "resolved"), "a": (None, "unresolvable"), "z": ("z", "resolved"), "q": (None, "invisible")}
    book = spark.createDataFrame([("old", 1, "1"), ("new", 2, "2")], "retirement_domain string, retirement_domain_version int, source_id string")
    with pytest.raises(DomainConflict):
        resolve.migrate(book, {})
    assert {r["retirement_domain"] for r in resolve.migrate(book, {"old": "new"}).collect()} == {"new"}
    kids = spark.createDataFrame([(1, 5), (2, 6), (3, None), (4, 7)], "id long, fk long")
    live = spark.createDataFrame([("5",), ("6",)], "record_id string")
    gone = spark.createDataFrame([("dom", "6", "5")], "retirement_domain string, source_id string, survivor_id string")
    assert sorted(r["id"] for r in resolve.guard_new_children(kids, "fk", live, gone, "dom").collect()) == [1, 3]


def test_previews(spark, context):
    df = contacts(spark, {"reference": "a"}, {"reference": "a"})
    plan = planned(spark, df, notes(spark, (2, "x"))).withColumn("operation_id", F.lit("op-1"))
    held = previews.rows(plan, context, AUDIT, NOW, 30).cache()
    assert previews.find(held, "op-1", context, AUDIT, NOW)["survivor_id"] == "1"
    cases = [("nope", context, AUDIT, NOW, RecordUnavailable), ("op-1", replace(context, actor="x"), AUDIT, NOW, ForbiddenOperation), ("op-1", replace(context, panel="x"), AUDIT, NOW, ForbiddenOperation), ("op-1", context, AUDIT, NOW + dt.timedelta(hours=1), StalePreview), ("op-1", context, b"f" * 16, NOW, DomainConflict), ("op-1", replace(context, scope="x"), AUDIT, NOW, ForbiddenOperation)]
    for op, c, k, at, kind in cases:
        with pytest.raises(kind):
            previews.find(held, op, c, k, at)
    with pytest.raises(DomainConflict):
        previews.find(held.withColumn("payload_hash", F.lit("0")), "op-1", context, AUDIT, NOW)
    assert previews.prune(held, NOW + dt.timedelta(days=1))[1] == 1 and previews.prune(held, NOW)[1] == 0


def test_validation(spark):
    df, kids = contacts(spark, {}), notes(spark, (1, "x"))
    schemas = {"contacts": df.schema, "notes": kids.schema}
    assert validate(CONTACTS, schemas).can("merge")
    for change in ({"id": "Bad Id"}, {"table": "none"}, {"key": ("a", "b")}, {"key": "none"}, {"rules": ()}, {"rules": (ExactRule("a", ("none",)),)}, {"rules": (ExactRule("a", ("id",)), ExactRule("a", ("id",)))}, {"revision": ""}, {"tenant": "none"}):
        assert not validate(replace(CONTACTS, **change), schemas).can("detection"), change
    for change in ({"fields": (MergeField("id"),)}, {"fields": (MergeField("none"),)}, {"fields": (MergeField("notes"), MergeField("notes"))}, {"logical": {"notes": "json"}}, {"relations": (replace(NOTES, kind="morph_many"),)}, {"relations": (replace(NOTES, complete=False),)}, {"relations": (replace(NOTES, parent_key="uuid"),)}, {"relations": (replace(NOTES, connection="b"),)}, {"authorizer": DenyAll()}, {"retirement": None}, {"deleted_at": None}, {"validator": None}, {"guards_writes": False}, {"inventory_acknowledged": False}):
        report = validate(replace(CONTACTS, **change), schemas)
        assert report.can("detection") and not report.can("merge"), change
    assert [i.severity for i in validate(replace(CONTACTS, connection="sqlite", relations=()), schemas).issues] == ["warning"]
    r = Registry(CONTACTS)
    assert r.get(CONTACTS.id) is CONTACTS
    with pytest.raises(InvalidConfiguration):
        r.add(CONTACTS)
    with pytest.raises(InvalidConfiguration):
        r.get("none")


def test_context(context):
    with pytest.raises(MissingContext):
        context_of(CONTACTS, NullContextResolver(), KEY)
    other = context_of(CONTACTS, ServiceContextResolver("someone", "panel", "tenant-a"), KEY)
    assert other.scope == context.scope
    with pytest.raises(ForbiddenOperation):
        require(replace(CONTACTS, authorizer=AbilityMap(frozenset({Ability.REVIEW}))), Ability.MERGE, context)
    assert len(ulid()) == 26 and ulid(NOW) < ulid(NOW + dt.timedelta(seconds=1))


def test_lookups(spark, context):
    df = contacts(spark, {}, {"deleted_at": NOW}, {"tenant_id": "tenant-b"}, {})
    assert by_key(CONTACTS, df, context, 1)["id"] == 1
    assert by_key(CONTACTS, df, context, 2, trashed=True)["id"] == 2
    for k in (2, 3, 99):
        with pytest.raises(RecordUnavailable):
            by_key(CONTACTS, df, context, k)
    wanted = spark.createDataFrame([("1",), ("2",)], "record_id string")
    assert {r["record_id"]: r["id"] for r in by_keys(CONTACTS, df, context, wanted).collect()} == {"1": 1, "2": None}
    assert [r["id"] for r in keyset_chunk(CONTACTS, df, context, 1, 10).collect()] == [4]
    assert len(list(stream_rows(df))) == 4


def test_incremental(spark, context, tmp_path):
    df = contacts(spark, {"reference": "a"}, {"reference": "b"})
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("src", "out", "mark"))
    for part in (df.where("id = 1"), df.where("id = 2")):
        part.write.mode("append").parquet(src)
        incremental.start(spark, CONTACTS, context, src, df.schema, out, mark, KEY).awaitTermination()
    assert incremental.memberships(spark, out).count() == 2
    df.where("id = 1").withColumn("reference", F.lit("c")).write.mode("append").parquet(src)
    incremental.start(spark, CONTACTS, context, src, df.schema, out, mark, KEY).awaitTermination()
    want = keys.build_keys(CONTACTS, df.withColumn("reference", F.when(F.col("id") == 1, "c").otherwise("b")), KEY)
    assert sorted(map(str, incremental.memberships(spark, out).collect())) == sorted(map(str, want.collect()))


def test_a_dead_writer_locks_nobody(spark, tmp_path):
    """A writer that stops before the last step leaves a draft; the next commit takes the version."""
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit(lambda s: s["tables"].update(a="x"))
    link = store._link

    def die(draft, final):
        raise KeyboardInterrupt

    store._link = die
    with pytest.raises(KeyboardInterrupt):
        store.commit(lambda s: s["tables"].update(b="y"))
    store._link = link
    assert store.commit(lambda s: s["tables"].update(c="z"))["tables"] == {"a": "x", "c": "z"} and store.version() == 2


def test_writers_at_once_all_commit(spark, tmp_path):
    import threading

    store, failed = Store(spark, f"file://{tmp_path}/s"), []

    def work(k):
        try:
            store.commit(lambda s: s["tables"].update({f"t{k}": "x"}), attempts=12)
        except RetryExhausted as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and store.version() == 6 and len(store.state()["tables"]) == 6


def test_long_scans_keep_their_heart_beating(spark, context, tmp_path):
    """A scan longer than the timeout is not taken for a dead one."""
    import time

    scans = Scans(Store(spark, f"file://{tmp_path}/s"), KEY, heartbeat=0.2)
    df = contacts(spark, {"reference": "a"}, {"reference": "b"}).coalesce(1)
    slow = F.udf(lambda x: time.sleep(1.5) or x, "string")
    one = scans.start(CONTACTS, context)
    assert scans.run(CONTACTS, context, one, df.withColumn("reference", slow("reference")))["indexed"] == 2
    scan = scans.store.state()["scans"][one]
    beat, begun = (dt.datetime.fromisoformat(scan[k]) for k in ("heartbeat_at", "started_at"))
    assert beat - begun > dt.timedelta(seconds=1) and scan["state"] == "succeeded"


def test_a_key_that_disappears_is_gone(spark, context, tmp_path):
    df = contacts(spark, {"reference": "a", "email": "a@example.com"}, {"reference": "b"}, {"reference": "c"})
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("src", "out", "mark"))
    assert incremental.memberships(spark, out).count() == 0
    late = df.where("id < 3").withColumn("email", F.lit(None).cast("string")).withColumn("deleted_at", F.when(F.col("id") == 2, F.lit(NOW)))
    for part in (df, late):
        part.write.mode("append").parquet(src)
        incremental.start(spark, CONTACTS, context, src, df.schema, out, mark, KEY).awaitTermination()
    got = sorted((r["record_id"], r["rule_id"]) for r in incremental.memberships(spark, out).collect())
    assert got == [("1", "reference"), ("3", "reference")]


def test_chains_and_guards_tell_types_apart(spark):
    ledger = spark.createDataFrame([("dom", "5", "string", "9", "string"), ("dom", "6", "int", "7", "int")], "retirement_domain string, source_id string, source_id_type string, survivor_id string, survivor_id_type string")
    ids = spark.createDataFrame([("5", "int"), ("5", "string"), ("6", "int")], "record_id string, record_id_type string")
    seen = spark.createDataFrame([("5", "int"), ("9", "string")], "record_id string, record_id_type string")
    got = {(r["record_id"], r["record_id_type"]): (r["survivor_id"], r["survivor_id_type"], r["status"]) for r in resolve.survivors(ids, ledger, "dom", seen).collect()}
    assert got == {("5", "int"): ("5", "int", "resolved"), ("5", "string"): ("9", "string", "resolved"), ("6", "int"): (None, None, "invisible")}
    kids = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, fk long")
    live = spark.createDataFrame([("5", "int"), ("6", "int")], "record_id string, record_id_type string")
    assert sorted(r["id"] for r in resolve.guard_new_children(kids, "fk", live, ledger, "dom").collect()) == [1, 3]


def desk_of(spark, tmp_path, df, kids, d=CONTACTS, events=None):
    desk = Desk(Store(spark, f"file://{tmp_path}/d"), d, {"contacts": df.schema, "notes": kids.schema}, KEY, AUDIT, lambda: NOW, [lambda *e: events.append(e)] if events is not None else [])
    desk.load(contacts=df, notes=kids)
    return desk


def decided(desk, context, pairs, **choices):
    plans = desk.plan(context, pairs).select("source_id", "survivor_id", "fingerprint")
    given = F.create_map(*[F.lit(x) for kv in choices.items() for x in kv]) if choices else F.create_map().cast("map<string,string>")
    return plans.withColumn("choices", given).withColumn("operation_id", F.concat(F.lit("op-"), "source_id")).checkpoint()


def test_desk_commits_replays_and_audits(spark, context, tmp_path):
    events = []
    df = contacts(spark, {"reference": "a", "display_name": "Old"}, {"reference": "a", "display_name": "New"}, {"reference": "z"}).repartition(3, "id")
    kids = notes(spark, (1, "one"), (2, "two"), (3, "three"))
    desk = desk_of(spark, tmp_path, df, kids, events=events)
    untouched = set(desk.store.state()["tables"]["contacts"])
    pair = spark.createDataFrame([("2", "1")], PAIRS)
    plans = decided(desk, context, pair, display_name="source")
    (one,) = desk.merge(context, plans).collect()
    assert not one["replayed"] and one["moved_total"] == 1 and one["written"] == {"display_name": '"New"'}
    assert [e[0] for e in events] == ["MergeCompleted"]
    state = desk.store.state()
    assert untouched & set(state["tables"]["contacts"])  # files without a touched record are kept by name
    rows = {r["id"]: r for r in desk.table("contacts").collect()}
    assert len(rows) == 3 and rows[1]["display_name"] == "New" and rows[2]["deleted_at"] is not None and rows[3]["deleted_at"] is None
    assert {r["body"]: r["contact_id"] for r in desk.table("notes").collect()} == {"one": 1, "two": 1, "three": 3}
    # Again: the same is a replay and changes nothing, other choices and other actors are refused.
    assert [r["replayed"] for r in desk.merge(context, plans).collect()] == [True] and desk.store.version() == state["version"]
    with pytest.raises(DomainConflict, match="choices"):
        desk.merge(context, plans.withColumn("choices", F.create_map(F.lit("display_name"), F.lit("survivor"))))
    with pytest.raises(ForbiddenOperation, match="actor"):
        desk.merge(replace(context, actor="other"), plans)
    assert events[-1][0] == "MergeFailed" and events[-1][1]["code"] == "forbidden_operation"
    audit = desk.audit_read(context, "op-2")
    assert audit["actor"] == context.actor and audit["relations"] == [{"relation": "notes", "count": 1, "child_ids": ["int:2"]}] and audit["reasons"] == ["reference"]
    with pytest.raises(RecordUnavailable):
        desk.audit_read(context, "nope")
    with pytest.raises(ForbiddenOperation):
        desk.audit_read(replace(context, scope="x"), "op-2")
    # A record that was merged away is neither source nor survivor again.
    gone = desk.survivors(context, spark.createDataFrame([("2", "int")], "record_id string, record_id_type string")).first()
    assert (gone["survivor_id"], gone["status"]) == ("1", "resolved")


def test_desk_makes_a_merge_again_when_another_came_first(spark, context, tmp_path):
    df = contacts(spark, *[{"reference": r} for r in "aabb"])
    desk = desk_of(spark, tmp_path, df, notes(spark, (1, "x")))
    first, second = (decided(desk, context, spark.createDataFrame([p], PAIRS)) for p in (("2", "1"), ("4", "3")))
    swap, seen = desk.store.swap, []

    def late(base, tables):
        if not seen:
            seen.append(1)
            desk.merge(context, second)
        return swap(base, tables)

    desk.store.swap = late
    assert not desk.merge(context, first).first()["replayed"]
    assert sorted(r["id"] for r in desk.table("contacts").where("deleted_at is not null").collect()) == [2, 4] and desk.ledger().count() == 2


def test_desk_asks_for_every_ability(spark, context, tmp_path):
    df, kids = contacts(spark, {"reference": "a"}, {"reference": "a"}), notes(spark, (2, "x"))
    pair = spark.createDataFrame([("2", "1")], PAIRS)
    desk = desk_of(spark, tmp_path, df, kids)
    plans = decided(desk, context, pair)
    m = keys.build_keys(CONTACTS, df, KEY)
    encoded = spark.createDataFrame([("int:1", "int:2")], "a string, b string")
    steps = {Ability.REVIEW: lambda x: x.review_page(context, m), Ability.DISMISS: lambda x: x.dismiss(context, encoded), Ability.MERGE: lambda x: x.merge(context, plans), Ability.VIEW_AUDIT: lambda x: x.audit_read(context, "op-2")}
    for ability, step in steps.items():
        desk.d = replace(CONTACTS, authorizer=AbilityMap(frozenset(Ability) - {ability}))
        with pytest.raises(ForbiddenOperation):
            step(desk)
    # Records, pairs and children are asked about, too.
    for limits in (AbilityMap(frozenset(Ability), F.col("id") != 1), AbilityMap(frozenset(Ability), None, F.col("source__id") != 2), AbilityMap(frozenset(Ability), None, None, F.col("body") != "x")):
        desk.d = replace(CONTACTS, authorizer=limits)
        with pytest.raises(ForbiddenOperation):
            desk.merge(context, plans)
    desk.d = CONTACTS
    groups, total, pages = desk.review_page(context, m)
    assert (total, pages) == (1, 1) and [x["record_id"] for x in groups.first()["members"]] == ["1", "2"]
    desk.dismiss(context, encoded)
    assert desk.review_page(context, m)[1] == 0 and desk.dismissals().count() == 1
    desk.reopen(context, [desk.dismissals().first()["pair_hash"]])
    assert desk.review_page(context, m)[1] == 1


def test_a_retired_survivor_is_refused(spark):
    df = contacts(spark, {"reference": "a"}, {"reference": "a"})
    ledger = spark.createDataFrame([("dom", "1", "int"), ("dom", "2", "string")], "retirement_domain string, source_id string, source_id_type string")
    assert planned(spark, df, notes(spark, (2, "x")), ledger=ledger).first()["blockers"] == ["survivor_retired"]
