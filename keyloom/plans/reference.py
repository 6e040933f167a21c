"""Queries for the store's own operators, over whole tables, with their SQL.

``events`` serves as a change log where no log table fits: event_id is the
sequence number, user_id the key, event_type 'error' a delete, value the payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keyloom.functions.keys import encoded_key, is_put, key_text
from keyloom.operators import dense, documents, expiry, log, objects, policy, recovery, refs, summary
from keyloom.session import table
from keyloom.sources import sql_sink

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def change_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("lsn"), F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")


def wal(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "wal_records")
    return w.select("store_id", "collection", key_text(F.col("key")).alias("rec_key"), "lsn", "op", "version", "value")


def hot_state(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Last event per user, of all or of the given ones, as an object with its bookkeeping; a tick is a thousandth event."""
    e = table(spark, d, "events") if events is None else events
    last = e.groupBy("user_id").agg(F.max(F.struct("event_id", "event_type", "value")).alias("b"), F.count(F.lit(1)).alias("n"))
    return last.select(F.col("user_id").alias("key"), F.col("b.event_id").alias("version"), F.col("b.event_id").alias("last_touch"), (F.col("b.event_type") == "click").alias("dirty"), (F.col("b.event_type") == "error").alias("tombstone"), F.col("b.value").alias("value"))


_HOT = """
hot as (select user_id as key, max(event_id) as version, max(event_id) as last_touch, arg_max(event_type, event_id) = 'click' as dirty,
               arg_max(event_type, event_id) = 'error' as tombstone, arg_max(value, event_id) as value from events group by user_id)
"""
_LAST = "last as (select user_id, max(event_id) as lsn, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id)"

# ------------------------------------------------------------ log and recovery


@query(f"with {_LAST} select user_id as key, lsn, value from last where event_type <> 'error'")
def recover_live_state(spark, d):
    return log.live_rows(log.latest(change_log(spark, d), ["key"], "lsn")).select("key", "lsn", "value")


@query("select event_id as lsn, user_id as key, row_number() over (partition by user_id order by event_id) as version from events")
def assign_versions(spark, d):
    return log.assign_versions(change_log(spark, d), ["key"], "lsn").select("lsn", "key", "version")


@query("select event_id as lsn, user_id as key, lag(value) over (partition by user_id order by event_id) as previous from events")
def previous_value(spark, d):
    return log.previous_value(change_log(spark, d), ["key"], "lsn", "value").select("lsn", "key", "previous")


@query(f"with {_LAST} select user_id as key, lsn, value from last where event_type <> 'error'")
def recover_checkpoint_suffix(spark, d):
    changes = change_log(spark, d)
    lsn = (changes.agg(F.max("lsn")).first()[0] or 0) // 2
    snapshot = recovery.snapshot_at(changes, ["key"], "lsn", lsn)
    return recovery.recover(snapshot, changes, ["key"], "lsn", lsn).select("key", "lsn", "value")


@query("""
with ranked as (select *, row_number() over (partition by store_id, collection, key order by lsn desc) as rn from wal_records)
select collection, count(*) as live from ranked where rn = 1 and lower(op) in ('put', '1') group by collection""")
def count_live_by_collection(spark, d):
    rows = wal(spark, d)
    return log.count_live(rows, ["store_id", "rec_key", "collection"], "lsn", "collection")


@query("select user_id as key, max(event_id) as tombstone from events where event_type = 'error' group by user_id")
def tombstone_max_version(spark, d):
    return log.tombstone_versions(change_log(spark, d), ["key"], "lsn")


@query("""
with v as (select user_id, count(*) as actual from events group by user_id),
b as (select c_custkey as key, c_nationkey as expected from customer)
select b.key, b.expected as expected_version, coalesce(v.actual, 0) as actual_version from b left join v on v.user_id = b.key where b.expected <> coalesce(v.actual, 0)""")
def expected_version_conflicts(spark, d):
    current = log.assign_versions(change_log(spark, d), ["key"], "lsn")
    batch = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("expected_version"))
    return log.split_conflicts(batch, current, ["key"])[1].select("key", "expected_version", "actual_version")


@query("select row_number() over (order by o_orderdate, o_orderkey) + (select max(event_id) from events) as lsn, o_orderkey as key from orders")
def append_log(spark, d):
    batch = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderdate")
    return log.append_with_lsn(change_log(spark, d), batch, ["o_orderdate", "key"]).select("lsn", "key")


@query(f"with {_LAST} select count(*) filter (event_type <> 'error') as live, count(*) filter (event_type = 'error') as tombstones, count(*) filter (event_type = 'click') as dirty, max(lsn) as clock from last")
def store_stats(spark, d):
    e = table(spark, d, "events").withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("put"))
    return log.store_stats(e, ["user_id"], "event_id", F.col("event_type") == "click")


@query("select user_id as key, least(count(*), 15) as accesses from events group by user_id")
def frequency_saturating(spark, d):
    return log.frequencies(change_log(spark, d), ["key"], 15)


@query("select collection, sum(n)::bigint as record_count from (select collection, count(distinct (store_id, key)) as n from wal_records group by collection) group by collection")
def checkpoint_metadata(spark, d):
    rows = wal(spark, d)
    snapshot = log.latest(rows.select("store_id", "collection", "rec_key", "lsn", "op"), ["store_id", "collection", "rec_key"], "lsn")
    return recovery.checkpoint_metadata(snapshot)


@query("""
with c as (select distinct store_id, kind, path, coalesce(checkpoint_lsn, lsn) as reached from checkpoints where finished_at is not null),
r as (select *, row_number() over (partition by store_id, kind order by reached desc, path desc) as rn from c)
select store_id, kind, reached from r where rn <= 2""")
def keep_last_n(spark, d):
    c = table(spark, d, "checkpoints").where("finished_at is not null").select("store_id", "kind", "path", F.coalesce("checkpoint_lsn", "lsn").alias("reached")).distinct()
    rows = c.withColumn("rank_by", F.struct("reached", "path"))
    return recovery.keep_last(rows, ["store_id", "kind"], "rank_by", 2).select("store_id", "kind", "reached")


@query("""
with w as (select store_id, segment_no, lsn, arrived_at, lag(lsn) over (partition by store_id, segment_no order by arrived_at, lsn) as previous_lsn from wal_records)
select store_id, segment_no, lsn, previous_lsn from w where lsn <= previous_lsn""")
def sequence_faults(spark, d):
    rows = table(spark, d, "wal_records").select("store_id", "segment_no", "lsn", "arrived_at")
    return recovery.sequence_faults(rows, ["store_id", "segment_no"], "arrived_at", "lsn").select("store_id", "segment_no", "lsn", "previous_lsn")


@query("""
with f as (select distinct store_id, decode(key) as k, version, lower(op) in ('put', '1') as live, value from flush_records),
v as (select store_id, k, version, live, row_number() over (partition by store_id, k order by version desc) as rn from (select distinct store_id, k, version, live from f where not starts_with(k, '@exp/'))),
m as (select store_id, substr(k, 6) as k, version, max((json_extract_string(decode(value), '$.expires_at'))::bigint) as expires_at from f where live and starts_with(k, '@exp/') group by all)
select v.store_id, v.k as rec_key, v.version, coalesce(m.expires_at, 0) as expires_at from v left join m on m.store_id = v.store_id and m.k = v.k and m.version = v.version where v.rn = 1 and v.live""")
def recover_objects(spark, d):
    f = table(spark, d, "flush_records")
    # Keys are unique per store; the store goes into the key so that one pass recovers all stores.
    text = key_text(F.col("key"))
    meta = text.startswith("@exp/")
    full = F.when(meta, F.concat(F.lit("@exp/"), F.col("store_id"), F.lit("\x00"), F.substring(text, F.lit(6), F.length(text)))).otherwise(F.concat("store_id", F.lit("\x00"), text))
    rows = f.select(full.alias("key"), "version", F.when(is_put(F.col("op")), "put").otherwise("delete").alias("op"), "value")
    out = recovery.recover_objects(rows, "@exp/")
    return out.select(F.split_part("key", F.lit("\x00"), F.lit(1)).alias("store_id"), F.split_part("key", F.lit("\x00"), F.lit(2)).alias("rec_key"), "version", "expires_at")


# ------------------------------------------------------------------- documents


def _customers() -> documents.Schema:
    s, i, x = (documents.FieldType(k) for k in ("string", "int64", "float"))
    return documents.Schema("customer", (documents.Field("c_custkey", i, primary=True, indexed=True), documents.Field("c_name", s, indexed=True, unique=True), documents.Field("c_nationkey", i, indexed=True, reference=("nation", "n_nationkey")), documents.Field("c_acctbal", x), documents.Field("c_mktsegment", s, indexed=True)))


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def index_lookup(spark, d):
    return documents.lookup(table(spark, d, "customer"), _customers(), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


@query("select c_mktsegment as value, count(*) as keys, min(c_custkey) as first_key, max(c_custkey) as last_key from customer group by c_mktsegment")
def index_rebuild_counts(spark, d):
    entries = documents.index_entries(table(spark, d, "customer"), "c_mktsegment", "c_custkey")
    return entries.groupBy("value").agg(F.count(F.lit(1)).alias("keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Keys asked for: the users of all events, some of which are no customers."""
    return table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("ordinal"))


@query("select c.c_custkey, c.c_name, r.ordinal from customer c join (select user_id, min(event_id) as ordinal from events group by user_id) r on r.user_id = c.c_custkey")
def multi_get(spark, d):
    return documents.multi_get(table(spark, d, "customer"), _requests(spark, d), "c_custkey").select("c_custkey", "c_name", "ordinal")


@query("select e.event_id as ordinal, e.user_id as c_custkey, c.c_name from events e left join customer c on c.c_custkey = e.user_id")
def multi_get_positional(spark, d):
    return documents.multi_get_positional(table(spark, d, "customer"), _requests(spark, d), "c_custkey").select("ordinal", "c_custkey", "c_name")


@query()
def document_validation(spark, d):
    """The documents of all collections against all fields that schema_fields declares, a row a document; ``document_faults`` has the same faults a row each, checked by SQL."""
    schemas = documents.declared_schemas(table(spark, d, "schema_fields"))
    docs = table(spark, d, "schema_flush").where("document is not null").select("store_id", "lsn", "collection", "document").distinct()
    errors = documents.collection_errors(F.col("collection"), F.col("document"), schemas)
    return docs.select("store_id", "lsn", "collection", F.array_join(errors, "; ").alias("errors"))


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 'Tower' else c_name end as c_name, c_nationkey + case when c_mktsegment = 'BUILDING' then 100 else 0 end as c_nationkey from customer")
def partial_update(spark, d):
    docs = table(spark, d, "customer")
    return documents.partial_update(docs, "c_custkey", sets={"c_name": F.lit("Tower")}, increment={"c_nationkey": 100}, where=F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name", "c_nationkey")


@query("select o_orderkey as key from orders where o_orderkey not in (select c_custkey from customer)")
def create_only(spark, d):
    return documents.create_only(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), "key")[0]


@query("""
select n_nationkey, '01' || list_aggregate(list_reverse(regexp_extract_all(printf('%08X', n_nationkey::int), '(..)', 1)), 'string_agg', '') as int_key,
  '00' || hex(encode(n_name)) as text_key from nation""")
def primary_key_encoding(spark, d):
    return table(spark, d, "nation").select("n_nationkey", encoded_key(F.col("n_nationkey"), "int32").alias("int_key"), encoded_key(F.col("n_name"), "string").alias("text_key"))


# ------------------------------------------------------------------ references


@query("select o_orderkey, o_custkey, c_name as ref_c_name from orders left join customer on o_custkey = c_custkey")
def include_forward(spark, d):
    return refs.include_forward(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey", "ref_c_name")


@query("select s_suppkey, n_name as ref_n_name, r_name as ref_r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def include_forward_chain(spark, d):
    one = refs.include_forward(table(spark, d, "supplier"), table(spark, d, "nation"), "s_nationkey", "n_nationkey")
    two = refs.include_forward(one, table(spark, d, "region"), "ref_n_regionkey", "r_regionkey")
    return two.select("s_suppkey", "ref_n_name", "ref_r_name")


@query("select c_custkey as target_key, o_orderkey from customer join orders on o_custkey = c_custkey")
def include_reverse(spark, d):
    return refs.include_reverse(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("target_key", "o_orderkey")


@query("select c_custkey, count(o_orderkey) as \"references\" from customer left join orders on o_custkey = c_custkey group by c_custkey")
def reverse_counts(spark, d):
    return refs.reverse_counts(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey")


@query("select id, company_id from users u where company_id is not null and not exists (select 1 from companies c where c.id = u.company_id)")
def dangling_references(spark, d):
    return refs.dangling(table(spark, d, "users"), table(spark, d, "companies"), "company_id", "id").select("id", "company_id")


# --------------------------------------------------------------- typed objects


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("member"), F.col("value").alias("score"))


@query("select user_id as key, sum((json_extract(props, '$.k'))::bigint)::bigint as value, false as overflow from events group by user_id")
def counter_incr_by(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.get_json_object("props", "$.k").cast("bigint").alias("delta"))
    return objects.counters(e, "key", "delta")


@query("select event_id as seq, sum((json_extract(props, '$.k'))::bigint) over (partition by user_id order by event_id)::bigint as after from events")
def counter_running(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("bigint").alias("delta"))
    return objects.counter_log(e, "key", "delta", "seq").select("seq", "after")


@query("select user_id as key, (sum((9000000000000000000 + event_id)::hugeint) % 9223372036854775808)::bigint as value from events group by user_id")
def dense_fetch_add_wrap(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), (F.lit(9000000000000000000) + F.col("event_id")).alias("delta"))
    return objects.wrapping_counters(e, "key", "delta")


@query("select user_id as key, event_id as member, value as score from (select *, row_number() over (partition by user_id order by value, event_id) as rn from events) where rn <= 3")
def zrange_head(spark, d):
    return objects.rank_range(_scores(spark, d), ["key"], objects.score_order("score", "member"), 0, 2)


@query("select user_id as key, event_id as member, value as score from (select *, row_number() over (partition by user_id order by value desc, event_id desc) as rn from events) where rn <= 3")
def zrange_negative(spark, d):
    return objects.rank_range(_scores(spark, d), ["key"], ["score", "member"], -3, -1)


@query("select user_id as key, event_id as member from (select *, row_number() over (partition by user_id order by value, event_id) as rn, count(*) over (partition by user_id) as n from events) where rn > 1 and rn <= n - 1")
def zrange_mixed(spark, d):
    return objects.rank_range(_scores(spark, d), ["key"], ["score", "member"], 1, -2).select("key", "member")


@query("select user_id as key, event_type as member, arg_max(value, event_id) as score from events group by all")
def zscore_last_write(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return objects.scored_set(e, "key", "member", "score", "seq")


@query("select user_id as key, event_id as member from events where event_type <> 'view'")
def zrem_members(spark, d):
    rows = _scores(spark, d).select("key", "member")
    gone = table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("event_id").alias("member"))
    return objects.without_members(rows, gone, ["key", "member"])


def _thread_lists(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as lists: orders are keys, lines their elements."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("l_partkey").alias("value"))
    return rows


@query("select l_orderkey as key, l_partkey as value from (select *, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc, l_suppkey desc) as rn from lineitem) where rn <= 2")
def list_range_tail(spark, d):
    return objects.rank_range(_thread_lists(spark, d), ["key"], ["pos"], -2, -1).select("key", "value")


@query("select l_orderkey as key, l_partkey as value from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn from lineitem) where rn > 1")
def list_pop_front(spark, d):
    return objects.pop(_thread_lists(spark, d), "key")[1].select("key", "value")


@query("select l_orderkey as key, l_partkey as value from (select *, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc, l_suppkey desc) as rn from lineitem) where rn = 1")
def list_pop_back(spark, d):
    return objects.pop(_thread_lists(spark, d), "key", front=False)[0].select("key", "value")


@query("""
with recursive c as (
  select user_id, event_id, case event_type when 'click' then 'pop_front' when 'error' then 'pop_back' else 'push' end as op, row_number() over (partition by user_id order by event_id) as n from events),
run as (
  select user_id, 0::bigint as n, []::varchar[] as items, null::bigint as event_id, null::varchar as op, null::varchar as popped from (select distinct user_id from events)
  union all
  select c.user_id, c.n, case c.op when 'push' then list_append(r.items, c.event_id::varchar) when 'pop_front' then r.items[2:] else r.items[:-2] end,
    c.event_id, c.op, case c.op when 'pop_front' then r.items[1] when 'pop_back' then r.items[-1] end
  from run r join c on c.user_id = r.user_id and c.n = r.n + 1)
select user_id::varchar as key, event_id as seq, op, popped, len(items)::int as length from run where n > 0""")
def list_command_replay(spark, d):
    """Pushes by views and signups, pops by clicks (front) and errors (back), replayed per user."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "click", "pop_front").when(F.col("event_type") == "error", "pop_back").otherwise("push")
    return objects.list_commands(e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").cast("string").alias("value")))


@query("select user_id as key, event_type as field, arg_max(value, event_id) as value from events group by all")
def hash_merge_last_wins(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), "value", F.col("event_id").alias("seq"))
    return objects.hash_fields(e, "key", "field", "value", "seq")


@query("select distinct user_id as key, event_type as member from events")
def set_add_members(spark, d):
    return objects.set_members(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("member")), "key", "member")


@query("""
select distinct user_id as key, event_type as member from events
except select user_id, event_type from events where (json_extract(props, '$.k'))::int < 10""")
def set_remove_members(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("member"), "props")
    gone = e.where(F.get_json_object("props", "$.k").cast("int") < 10)
    return objects.without_members(objects.set_members(e, "key", "member"), gone, ["key", "member"])


@query("select c_custkey as key, count(distinct event_type) as size from customer left join events on user_id = c_custkey group by c_custkey")
def container_cardinality(spark, d):
    members = set_add_members(spark, d)
    return objects.cardinality(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), members, "key")


@query("select o_custkey as key, string_agg(o_orderstatus, '' order by o_orderkey) as value from orders group by o_custkey")
def append_bytes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("suffix"))
    return objects.appended(o, "key", "suffix", "seq")


# --------------------------------------------------------------- expiry, tiers


@query("""
select event_id, user_id as key, coalesce(event_id + 500 <= lead(event_id) over (partition by user_id order by event_id), true) as outlived from events""")
def ttl_spans(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("key"))
    return expiry.ttl_spans(e, ["key"], "event_id", F.lit(500).cast("bigint")).select("event_id", "key", "outlived")


@query("""
with g as (select event_id, user_id, case when event_id - lag(event_id) over w < 2000 then 0 else 1 end as fresh from events window w as (partition by user_id order by event_id))
select event_id, user_id as key, sum(fresh) over (partition by user_id order by event_id)::bigint as session from g""")
def tti_sessions(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("key"))
    return expiry.tti_sessions(e, ["key"], "event_id", F.lit(2000)).select("event_id", "key", "session")


@query(f"with {_HOT}, c as (select max(version) as now from hot) select key, version, value from hot, c where not tombstone and not (now >= version + 5000) and not (now - last_touch >= 3000)")
def expired_keys_hidden(spark, d):
    hot = hot_state(spark, d)
    now = hot.agg(F.max("version").alias("m")).scalar()
    gone = expiry.expired(now, F.col("last_touch"), F.col("version") + 5000, F.lit(3000))
    return hot.where(~F.col("tombstone") & ~gone).select("key", "version", "value")


@query(f"with {_HOT}, c as (select max(version) as now from hot) select key, version from hot, c where dirty and now - last_touch >= now // 200")
def idle_flush_selection(spark, d):
    hot = hot_state(spark, d)
    now = _now(hot)
    return expiry.idle_dirty(hot, F.lit(now), now // 200).select("key", "version")


@query(f"with {_HOT}, c as (select max(version) as now from hot) select key, version from hot, c where tombstone or now - last_touch < 1000")
def evict_idle(spark, d):
    hot = hot_state(spark, d)
    return expiry.evict_idle(hot, hot.agg(F.max("version").alias("m")).scalar(), 1000).select("key", "version")


def _now(hot: DataFrame) -> int:
    return int(hot.agg(F.max("version")).first()[0] or 0)


@query(f"with {_HOT}, c as (select max(version) as now from hot) select key, version from hot, c where not dirty and now - last_touch >= now // 200 order by last_touch, version, key limit 128")
def demote_oldest(spark, d):
    hot = hot_state(spark, d)
    now = _now(hot)
    return expiry.demote(hot, now, idle_ticks=now // 200).select("key", "version")


@query(f"""
with {_HOT}, c as (select max(version) as now from hot)
select case when dirty then 'skipped_dirty' when now - last_touch < now // 200 then 'skipped_recent' else 'candidate' end as disposition, count(*) as n from hot, c group by 1""")
def demotion_report(spark, d):
    hot = hot_state(spark, d)
    now = _now(hot)
    return expiry.demotion_report(hot, now, idle_ticks=now // 200)


def _cold(spark: SparkSession, d: str, events: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every event, of all or of the given ones, but errors as a cold record in one of four generations, errors as tombstones."""
    e = table(spark, d, "events") if events is None else events
    gen = F.shiftright("event_id", 2) % 4
    cold = e.where("event_type <> 'error'").select(F.col("user_id").alias("key"), gen.alias("generation"), F.col("event_id").alias("version"), "value", F.col("event_id").alias("last_touch"), F.lit(0).alias("expires_at"), F.lit(0).alias("tti_ticks"))
    return cold, e.where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"))


_COLD = """
cold as (select user_id as key, (event_id >> 2) % 4 as generation, event_id as version, value, row_number() over (partition by user_id order by (event_id >> 2) % 4 desc, event_id desc) as rn from events where event_type <> 'error'),
buried as (select user_id as key, max(event_id) as version from events where event_type = 'error' group by user_id),
seen as (select c.key, c.version, c.value from cold c left join buried b on b.key = c.key where c.rn = 1 and (b.version is null or b.version < c.version))
"""


@query(f"with {_COLD} select key, version, value, 5 as generation from seen")
def cold_gc(spark, d):
    return expiry.compact_cold(*_cold(spark, d), ["key"], now=0, to_generation=5).select("key", "version", "value", "generation")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every event in one of two parts that take turns in blocks of 1024, so that a key may be newer in either."""
    e = table(spark, d, "events")
    block = F.shiftright("event_id", 10) % 2
    return e.where(block == 0), e.where(block == 1)


_TIERS = """
halves as (select *, (event_id >> 10) % 2 as half from events),
ranked as (select *, row_number() over (partition by user_id order by event_id desc) as rn from halves where half = 0),
hot as (select user_id as key, event_id as version, event_type = 'error' as tombstone, value from ranked where rn = 1),
cold as (select user_id as key, event_id as version, value, row_number() over (partition by user_id order by (event_id >> 2) % 4 desc, event_id desc) as rn from halves where half = 1 and event_type <> 'error'),
buried as (select user_id as key, max(event_id) as version from halves where half = 1 and event_type = 'error' group by user_id),
seen as (select c.key, c.version, c.value from cold c left join buried b on b.key = c.key where c.rn = 1 and (b.version is null or b.version < c.version))
"""


@query(f"""
with {_TIERS}
select coalesce(h.key, s.key) as key, case when h.key is null or s.version > h.version then s.version else h.version end as version,
  case when h.key is null or s.version > h.version then s.value else h.value end as value, case when h.key is null or s.version > h.version then 'cold' else 'hot' end as tier
from hot h full join seen s on s.key = h.key where not coalesce(h.tombstone, false)""")
def cold_read_through(spark, d):
    """All keys of both tiers, each event in one of them."""
    hot, cold = _halves(spark, d)
    return expiry.read_through(hot_state(spark, d, hot), *_cold(spark, d, cold), ["key"])


@query(f"with {_TIERS} select s.key, s.version from seen s where not exists (select 1 from hot h where h.key = s.key and h.version >= s.version)")
def promotion_guard(spark, d):
    hot, cold = _halves(spark, d)
    records, buried = _cold(spark, d, cold)
    return expiry.promotable(records, hot_state(spark, d, hot), buried, ["key"], now=0).select("key", "version")


@query("""
with held as (select user_id, max(event_id) as v from events where (event_id >> 10) % 2 = 0 group by user_id)
select e.event_id as lsn, e.user_id as key from events e left join held h on h.user_id = e.user_id where (e.event_id >> 10) % 2 = 1 and (h.v is null or e.event_id > h.v)""")
def drop_stale_records(spark, d):
    """A batch of one half of the events against what is stored of the other."""
    stored, batch = (e.select(F.col("event_id").alias("lsn"), F.col("user_id").alias("key")) for e in _halves(spark, d))
    return log.drop_stale(batch, stored, ["key"], "lsn")


# ----------------------------------------------------------------- dense lanes


def _lane(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_custkey") * 3).alias("value"), (F.col("c_custkey") % 5 == 0).alias("dirty"))


@query("select event_id as ordinal, user_id as idx, coalesce(c_custkey * 3, 0) as value from events left join customer on c_custkey = user_id")
def dense_gather(spark, d):
    return dense.gather(_lane(spark, d), table(spark, d, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("idx")))


@query("""
with w as (select user_id as idx, max(event_id) as v from events group by user_id)
select coalesce(c_custkey, idx) as idx, coalesce(v, c_custkey * 3) as value, coalesce(v is not null or c_custkey % 5 = 0, false) as dirty from customer full join w on idx = c_custkey""")
def dense_scatter(spark, d):
    writes = table(spark, d, "events").select(F.col("user_id").alias("idx"), F.col("event_id").alias("value"), F.col("event_id").alias("seq"))
    return dense.scatter(_lane(spark, d), writes, "seq")


@query("""
select event_id as seq, (coalesce(c_custkey * 3, 0) + coalesce(sum(event_id) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0))::bigint as previous
from events left join customer on c_custkey = user_id""")
def dense_fetch_add(spark, d):
    deltas = table(spark, d, "events").select(F.col("user_id").alias("idx"), F.col("event_id").alias("delta"), F.col("event_id").alias("seq"))
    return dense.fetch_add(_lane(spark, d), deltas, "seq").select("seq", "previous")


@query("select c_custkey as idx, c_custkey * 3 as value from customer where c_custkey % 5 = 0 order by c_custkey limit 100")
def dense_dirty_slots(spark, d):
    return dense.dirty_slots(_lane(spark, d), 100).select("idx", "value")


@query("""
with r as (select event_id, user_id % 8 as shard, row_number() over (partition by user_id % 8 order by event_id) as rn from events)
select event_id from r order by shard, rn limit 1000""")
def bounded_drain(spark, d):
    return dense.bounded_drain(table(spark, d, "events"), F.col("user_id") % 8, ["event_id"], 1000).select("event_id")


@query("select c_custkey as key, c_custkey * 3 as value from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderkey = c_custkey * 3)")
def remove_if_value(spark, d):
    t = _lane(spark, d).select(F.col("idx").alias("key"), "value")
    return dense.remove_if_value(t, table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value")), "key")


@query("select o_orderkey as seq, coalesce(lag(o_orderkey) over (partition by o_custkey order by o_orderkey), c_custkey * 3) as old_value from orders left join customer on c_custkey = o_custkey")
def insert_returning_old(spark, d):
    t = _lane(spark, d).select(F.col("idx").alias("key"), "value")
    writes = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("seq"))
    return dense.insert_returning_old(t, writes, "key", "seq").select("seq", "old_value")


@query("select store_id, lsn, case when document is null or not json_valid(document) then 'malformed' end as fault from (select distinct store_id, lsn, document from schema_flush)")
def codec_safety(spark, d):
    docs = table(spark, d, "schema_flush").select("store_id", "lsn", "document").distinct()
    return docs.select("store_id", "lsn", documents.codec_fault(F.col("document")).alias("fault"))


# -------------------------------------------------------------- sinks, summary


@query("""
with b as (select o_custkey as k, max(o_orderkey) as l, arg_max(o_orderstatus, o_orderkey) as s from orders group by o_custkey)
select c_custkey as key, case when b.l is not null and b.s <> 'F' and 500 < b.l then b.l else 500 end as lsn, case when b.l is not null and b.s <> 'F' and 500 < b.l then b.s else 'base' end as status
from customer left join b on b.k = c_custkey where not coalesce(b.s = 'F' and 500 <= b.l, false)
union all select b.k, b.l, b.s from b where b.s <> 'F' and b.k not in (select c_custkey from customer)""")
def guarded_upsert(spark, d):
    target = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(500).cast("bigint").alias("lsn"), F.lit("base").alias("status"))
    batch = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("lsn"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("put").alias("op"))
    return sql_sink.guarded_merge(target, batch, "key", "lsn")


@query("""
with s as (select event_type, list(value order by value) as v from events where value is not null group by event_type)
select event_type, len(v) as n, v[floor((len(v) - 1) * 0.5 + 0.5)::int + 1] as p50, v[floor((len(v) - 1) * 0.99 + 0.5)::int + 1] as p99 from s""")
def latency_summary(spark, d):
    return summary.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p99": 0.99})


@query("""
with s as (select event_type, list(value order by value) as v, min(value) as lo, max(value) as hi, avg(value) as mean, stddev_pop(value) as sd from events where value is not null group by event_type)
select event_type, lo as min, hi as max, v[len(v) // 2 + 1] as median, v[floor((len(v) - 1) * 0.95 + 0.5)::int + 1] as p95, round(sd * 100 / mean, 4) as cv from s""")
def run_summary(spark, d):
    out = summary.run_summary(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "min", "max", "median", "p95", F.round("cv", 4).alias("cv"))


@query()
def s3fifo_hit_ratio(spark, d):
    """The users of all events, replayed through a cache for a tenth of the customers."""
    trace = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"))
    return policy.hit_ratio(policy.replay(trace, policy.PolicyConfig(capacity=128, shards=4)))


@query()
def zipf_trace_hit_ratio(spark, d):
    """A generated Zipf trace through the same policy with frequency admission."""
    trace = policy.zipf_trace(spark, 200_000, 20_000, 1.1)
    return policy.hit_ratio(policy.replay(trace, policy.PolicyConfig(capacity=2000, shards=8, admission="plain")))
