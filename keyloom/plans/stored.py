"""Queries that write to storage or run streams and read the result again, with SQL for what must come back.

``events`` serves as a change log as in :mod:`keyloom.plans.reference`.  Files go
to the shared folder and are deleted when the driver ends.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyloom.functions import codecs
from keyloom.functions.keys import encoded_key
from keyloom.operators import dense, documents, expiry, log, objects, pages, policy, recovery
from keyloom.plans.reference import _COLD, _HOT, _LAST, _cold, _halves, _now, change_log, hot_state
from keyloom.session import scratch, table
from keyloom.sources import files, wal
from keyloom.streaming import expiring, flusher

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


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The change log with keys and values as bytes, the event type as collection; numbers start from 1, as log records must."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    value = F.when(F.col("event_type") != "error", F.encode("props", "UTF-8"))
    return e.select((F.col("event_id") + 1).alias("lsn"), F.col("event_type").alias("collection"), op.alias("op"), F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"), value.alias("value"))


# ------------------------------------------------------------------------ logs


@query("select event_id + 1 as lsn, event_type as collection, user_id::varchar as key, case when event_type = 'error' then 'delete' else 'put' end as op, case when event_type <> 'error' then props end as value from events")
def log_segments_reread(spark, d):
    """The whole log as binary segments and back."""
    path = scratch(spark, "segments")
    wal.write_segments(_records(spark, d).withColumn("version", F.col("lsn")), path)
    back = wal.read_segments(spark, f"{path}/*.wal")
    return back.select("lsn", "collection", F.col("key").cast("string").alias("key"), "op", F.col("value").cast("string").alias("value"))


@query("select event_id + 1 as lsn, case when event_type = 'error' then 'delete' else 'put' end as op from events where event_id + 1 > (select (max(event_id) + 1) // 2 from events)")
def log_replayed_after(spark, d):
    """Replay of the segments behind a sequence number."""
    path = scratch(spark, "segments")
    rows = _records(spark, d)
    wal.write_segments(rows.withColumn("version", F.col("lsn")), path)
    half = (rows.agg(F.max("lsn")).first()[0] or 0) // 2
    return wal.read_segments(spark, f"{path}/*.wal", after=half).select("lsn", "op")


@query("select event_id + 1 as version, user_id::varchar as key, case when event_type = 'error' then 'delete' else 'put' end as op, case when event_type <> 'error' then props end as value from events")
def generic_log_reread(spark, d):
    path = scratch(spark, "generic")
    wal.write_generic(_records(spark, d).withColumnRenamed("lsn", "version"), path)
    return wal.read_generic(spark, f"{path}/*.log").select("version", F.col("key").cast("string").alias("key"), "op", F.col("value").cast("string").alias("value"))


@query("""
with o as (select event_id, user_id, event_type, event_id + 1 > (select (max(event_id) + 1) // 2 from events) as second from events)
select row_number() over (order by second, event_id) as lsn, event_type as collection, user_id::varchar as key, row_number() over (partition by event_type, user_id order by second, event_id) as version from o""")
def log_resumed(spark, d):
    """Two appends to one log, the second of which goes on with numbers and versions."""
    path = scratch(spark, "log")
    rows = _records(spark, d).withColumnRenamed("lsn", "n")
    half = (rows.agg(F.max("n")).first()[0] or 0) // 2
    for part in (rows.where(F.col("n") <= half), rows.where(F.col("n") > half)):
        wal.append_segments(part, path, ["n"])
    return wal.read_segments(spark, f"{path}/*.wal").select("lsn", "collection", F.col("key").cast("string").alias("key"), "version")


@query(f"with {_LAST} select user_id as key, lsn, value from last where event_type <> 'error'")
def checkpoint_and_replay(spark, d):
    """Two stored snapshots, the newest of which recovery reads, and the log behind it."""
    changes = change_log(spark, d)
    top = changes.agg(F.max("lsn")).first()[0] or 0
    store = recovery.CheckpointStore(spark, scratch(spark, "checkpoints"))
    for lsn in (top // 3, 2 * top // 3):
        store.write(recovery.snapshot_at(changes, ["key"], "lsn", lsn), lsn)
    lsn, snapshot = store.load_latest()
    return recovery.recover(snapshot, changes, ["key"], "lsn", lsn).select("key", "lsn", "value")


# ----------------------------------------------------------------- other files


@query("select doc_id::varchar as url, text as content from documents where text <> '' and doc_id is not null")
def json_lines_reread(spark, d):
    path = scratch(spark, "jsonl")
    files.write_jsonl(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), F.encode("text", "UTF-8").alias("content")), path)
    return files.read_jsonl(spark, path)


@query("select doc_id::varchar as url, octet_length(encode(text)) as bytes, md5(text) as digest from documents where text <> '' and doc_id is not null")
def archives_reread(spark, d):
    """Posts as gzipped web archives and back; records without content are no pages."""
    path = scratch(spark, "archives")
    files.write_archives(table(spark, d, "documents").where("doc_id is not null"), path, "doc_id", "text")
    back = files.read_archives(spark, f"{path}/*.wet.gz")
    return back.select("url", F.octet_length("content").cast("bigint").alias("bytes"), F.md5("content").alias("digest"))


@query("select user_id::varchar as key, count(*) as accesses from events group by user_id")
def trace_counts(spark, d):
    """Accesses per key of a CSV trace."""
    path = scratch(spark, "trace")
    table(spark, d, "events").select("event_id", "user_id").write.csv(path)
    return files.read_trace(spark, path).groupBy("key").agg(F.count(F.lit(1)).alias("accesses"))


@query("""
select n_nationkey, hex(encode(left(rpad(substr(n_name, 3, 6), 6, '#'), 6))) as part, least(greatest(length(n_name) - 2, 0), 6) as available,
  hex(encode(substr(n_name, 1, 2) || '!!' || substr(n_name, 5))) as written, hex(encode(substr(n_name, 1, 4))) as cut from nation""")
def page_file_edits(spark, d):
    """Reads, writes and cuts at byte offsets; fill bytes are shown as '#'."""
    content = F.encode("n_name", "UTF-8")
    part = files.page_read(content, 2, 6)
    shown = F.hex(F.encode(F.translate(part["data"].cast("string"), "\x00", "#"), "UTF-8"))
    return table(spark, d, "nation").select("n_nationkey", shown.alias("part"), part["available"].alias("available"), F.hex(files.page_write(content, 2, b"!!")).alias("written"), F.hex(files.page_truncate(content, 4)).alias("cut"))


# ------------------------------------------------------------------- documents


@query("select store_id, lsn, json_extract_string(document, '$.profile.name') as name, json_extract_string(document, '$.email') as email from (select distinct store_id, lsn, document from schema_flush where document is not null and json_valid(document))")
def nested_projection(spark, d):
    docs = table(spark, d, "schema_flush").select("store_id", "lsn", "document").distinct().where(F.coalesce(documents.codec_fault(F.col("document")), F.lit("")) != "malformed")
    return docs.select("store_id", "lsn", documents.value_at(F.col("document"), "profile.name").alias("name"), documents.value_at(F.col("document"), "email").alias("email"))


@query("""
select collection, name, case when field_type like '{"object"%' then 'object' when field_type like '{"array"%' or field_type like '%[]' then 'array' else field_type end as kind,
  not (field_type like '{%' or field_type = 'json') as indexable, not (field_type like '{%' or field_type = 'json' or field_type like '%[]') as sortable, is_primary as "primary" from schema_fields""")
def declared_fields(spark, d):
    """The declared schemas, loaded, parsed and checked."""
    found = documents.declared_schemas(table(spark, d, "schema_fields"))
    catalog = documents.Catalog()
    for s in found.values():
        catalog.register(s)
    rows = [(c, f.name, f.type.kind, f.type.indexable, f.type.sortable, f.primary) for c in catalog.names() for f in catalog.schemas[c].fields]
    return spark.createDataFrame(rows, "collection string, name string, kind string, indexable boolean, sortable boolean, primary boolean")


@query("""
with u as (select *, row_number() over () as rn from users), last as (select *, row_number() over (partition by id order by version desc, tombstone desc, arrived_at, rn) as k from u where id is not null)
select email, count(distinct id) as holders, min(id) as first_key from last where k = 1 and not coalesce(tombstone, false) and email is not null group by email having count(distinct id) > 1""")
def unique_violations(spark, d):
    """Emails that more than one live user holds."""
    u = table(spark, d, "users").where("id is not null")
    best = u.groupBy("id").agg(F.max(F.struct("version", F.coalesce("tombstone", F.lit(False)).alias("dead"), "email")).alias("b"))
    return documents.unique_violations(best.where("not b.dead").select("id", "b.email"), "email", "id")


@query("""
select id, version, case when company_id is not null then upper(id) else profile.name end as name, case when company_id is not null then 'here' end as town,
  case when company_id is not null then coalesce(age, 0) + 2 else age end as age, case when company_id is not null then 1 end::bigint as visits, case when company_id is null then email end as email from users""")
def partial_update_nested(spark, d):
    """Ordered steps through nested paths: parents are made, missing numbers start from 0."""
    u = table(spark, d, "users").select("id", "version", "email", "profile", "company_id", "age")
    steps = [documents.Update("set", "profile.name", F.upper("id")), documents.Update("set", "profile.at.town", "here"), documents.Update("increment", "age", 3), documents.Update("increment", "age", -1), documents.Update("increment", "visits", 1), documents.Update("unset", "email")]
    out = documents.update_documents(u, "id", steps, where=F.col("company_id").isNotNull())
    return out.select("id", "version", F.col("profile.name").alias("name"), F.col("profile.at.town").alias("town"), "age", "visits", "email")


_FAULTS = """
with recursive fields as (
  select collection, name, case when starts_with(trim(field_type), '{') then field_type else '"' || field_type || '"' end as t, is_optional as optional from schema_fields),
types as (select collection, '{"object":[' || string_agg('{"name":"' || name || '","type":' || t || ',"optional":' || optional || '}', ',') || ']}' as t from fields group by collection),
docs as (select distinct store_id, lsn, collection, document, json_valid(document) as good from schema_flush where document is not null),
walk as (
  select store_id, lsn, d.collection, d.document, d.document as v, t.t::json as t, '' as path, null::varchar as fault from docs d join types t on t.collection = d.collection where good
  union all
  select store_id, lsn, collection, document, n.v, n.t, n.path, n.fault
  from walk w, lateral (
    select json_extract(w.v, '$."' || (f.x ->> '$.name') || '"')::varchar as v, case when json_type(f.x, '$.type') = 'VARCHAR' and (f.x ->> '$.type') like '%[]' then ('{"array":"' || replace(f.x ->> '$.type', '[]', '') || '"}')::json else f.x -> '$.type' end as t,
      case when w.path = '' then '' else w.path || '.' end || (f.x ->> '$.name') as path,
      case when json_type(w.v, '$."' || (f.x ->> '$.name') || '"') is null then case when coalesce((f.x ->> '$.optional')::boolean, false) then 'absent' else 'missing' end
           when json_type(w.v, '$."' || (f.x ->> '$.name') || '"') = 'NULL' then case when coalesce((f.x ->> '$.optional')::boolean, false) or (f.x ->> '$.type') = 'json' then 'absent' else 'null' end end as fault
    from (select unnest(json_extract(w.t, '$.object[*]')) as x) f where json_type(w.v) = 'OBJECT' and json_type(w.t, '$.object') = 'ARRAY'
    union all
    select json_extract(w.v, '$[' || i || ']')::varchar, json_extract(w.t, '$.array'), w.path || '[' || i || ']', null::varchar
    from (select unnest(range(coalesce(json_array_length(w.v), 0)::bigint)) as i where json_type(w.v) = 'ARRAY' and json_type(w.t, '$.array') is not null) e) n
  where w.fault is null),
judged as (
  select store_id, lsn, collection, document, path, coalesce(fault,
    case when json_type(t, '$.object') = 'ARRAY' then case when json_type(v) <> 'OBJECT' then 'type' end
         when json_type(t, '$.array') is not null then case when json_type(v) <> 'ARRAY' then 'type' end
         when t ->> '$' in ('string', 'bytes') then case when json_type(v) <> 'VARCHAR' then 'type' end
         when t ->> '$' = 'bool' then case when json_type(v) <> 'BOOLEAN' then 'type' end
         when t ->> '$' = 'float' then case when json_type(v) not in ('BIGINT', 'UBIGINT', 'DOUBLE') then 'type' end
         when t ->> '$' in ('int32', 'int64') then case when json_type(v) not in ('BIGINT', 'UBIGINT') or try_cast(v as bigint) is null then 'type' when t ->> '$' = 'int32' and v::bigint not between -2147483648 and 2147483647 then 'range' end end) as fault
  from walk)
"""


@query(_FAULTS + "select store_id, lsn, collection, case when path = '' then 'document' else path end || ': ' || fault as fault, count(*) as copies from judged where fault <> 'absent' group by all union all select store_id, lsn, collection, 'document: malformed', count(*) from docs where not good group by all")
def document_faults(spark, d):
    """Every fault of every distinct document, of all collections and all declared fields, to the innermost values."""
    schemas = documents.declared_schemas(table(spark, d, "schema_fields"))
    docs = table(spark, d, "schema_flush").where("document is not null").select("store_id", "lsn", "collection", "document").distinct()
    faults = docs.select("store_id", "lsn", "collection", F.explode(documents.collection_errors(F.col("collection"), F.col("document"), schemas)).alias("fault"))
    return faults.groupBy("store_id", "lsn", "collection", "fault").agg(F.count(F.lit(1)).alias("copies"))


@query("""
with b as (select o_custkey::varchar as key, o_orderkey as seq, 'm' || (o_orderkey % 9973) as email, o_orderstatus = 'F' as gone, o_orderpriority like '1%' as bad from orders),
good as (select key, seq, email, first_value(key) over (partition by email order by seq) as holder from b where not gone and not bad),
taken as (select key, seq, email from good where holder = key union all select key, seq, null from b where gone),
last as (select *, row_number() over (partition by key order by seq desc) as rn, count(*) over (partition by key) as n from taken),
new as (select coalesce(l.key, c_custkey::varchar) as key, case when l.key is null then c_name else l.email end as email, (c_custkey is not null)::bigint + coalesce(l.n, 0) as version from customer full join (select * from last where rn = 1) l on l.key = c_custkey::varchar)
select key, email, version, null as reason from new where email is not null
union all select key, null, seq, 'email: type' from b where not gone and bad union all select key, null, seq, 'email: not unique' from good where holder <> key""")
def put_documents(spark, d):
    """The write path: customers as documents, orders as puts and deletes, some of which break the schema or a unique field."""
    s = documents.FieldType("string")
    schema = documents.Schema("customers", (documents.Field("id", s, primary=True, indexed=True), documents.Field("email", s, indexed=True, unique=True)))
    current = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("email"))).alias("document"), F.lit(1).cast("bigint").alias("version"))
    o, key = table(spark, d, "orders"), F.col("o_custkey").cast("string")
    mail = F.concat(F.lit("m"), (F.col("o_orderkey") % 9973).cast("string"))
    doc = F.when(F.col("o_orderpriority").startswith("1"), F.to_json(F.struct(key.alias("id"), F.lit(5).alias("email")))).otherwise(F.to_json(F.struct(key.alias("id"), mail.alias("email"))))
    batch = o.select(key.alias("key"), F.when(F.col("o_orderstatus") != "F", doc).alias("document"), F.col("o_orderkey").alias("seq"))
    state, rejected = documents.put_documents(current, batch, schema)
    rows = state.select("key", F.get_json_object("document", "$.email").alias("email"), "version", F.lit(None).cast("string").alias("reason"))
    return rows.unionByName(rejected.select("key", F.lit(None).cast("string").alias("email"), F.col("seq").alias("version"), "reason"))


# -------------------------------------------------------------- objects, values


@query("""
with r as (select event_id, user_id, (event_id >> 10) % 2 as half from events),
n as (select *, row_number() over (partition by user_id, half order by event_id) - 1 as k, count(*) filter (half = 0) over (partition by user_id) as before from r)
select user_id as key, (case when half = 0 then k else before + k end)::int as pos, event_id as value from n""")
def list_push(spark, d):
    """Lists of one half of the events, and the other half pushed to their tails."""
    base, pushed = _halves(spark, d)
    lists = log.assign_versions(base.select("event_id", "user_id"), ["user_id"], "event_id", "pos").select(F.col("user_id").alias("key"), (F.col("pos") - 1).cast("int").alias("pos"), F.col("event_id").alias("value"))
    return objects.append_positions(lists, pushed.select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.col("event_id").alias("seq")), "key", "seq")


@query("select user_id as key, event_id % 7 as field, arg_max(case when event_type <> 'error' then value else -1 end, event_id) as value from events group by all having arg_max(event_type, event_id) <> 'error'")
def hash_field_deletes(spark, d):
    """Hash fields whose last command was a delete are gone."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 7).alias("field"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.col("event_id").alias("seq"))
    return objects.hash_fields(e, "key", "field", "value", "seq")


@query("""
with s as (select distinct user_id as key, event_type as member, (event_id >> 10) % 2 as half from events)
select distinct key, member from s a where half = 1 or not exists (select 1 from s b where b.key = a.key and b.half = 1)""")
def set_assignment(spark, d):
    """Sets of one half of the events, replaced where the other half assigns new ones."""
    old, new = (objects.set_members(e.select(F.col("user_id").alias("key"), F.col("event_type").alias("member")), "key", "member") for e in _halves(spark, d))
    return objects.assign(old, new, "key")


@query("select c_custkey as key, max(value) as value from customer left join events on user_id = c_custkey and event_type = 'view' group by c_custkey")
def typed_reads(spark, d):
    """Values read as the type they have, null for keys that hold nothing."""
    views = table(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("held"), F.max("event_type").alias("tag"))
    j = table(spark, d, "customer").join(views, F.col("c_custkey") == F.col("user_id"), "left")
    return j.select(F.col("c_custkey").alias("key"), objects.type_guard(F.col("held"), F.col("tag"), "view").alias("value"))


@query("select event_id, props as text, user_id as number, value from events")
def value_codec_reread(spark, d):
    """Each event as a tagged document value and back."""

    @F.pandas_udf("text string, number bigint, value double")
    def through(text: pd.Series, number: pd.Series, value: pd.Series) -> pd.DataFrame:
        back = []
        for t, n, x in zip(text, number, value):
            doc = {"text": None if pd.isna(t) else t, "number": None if pd.isna(n) else int(n), "value": None if pd.isna(x) else float(x)}
            back.append(codecs.decode_value(codecs.encode_value(doc)))
        return pd.DataFrame(back, columns=["text", "number", "value"])

    e = table(spark, d, "events")
    return e.select("event_id", through("props", F.col("user_id").cast("bigint"), F.col("value").cast("double")).alias("v")).select("event_id", "v.text", "v.number", "v.value")


@query("select event_id, 'integer' as kind, user_id::varchar as shown from events union all select event_id, 'string', props from events where props is not null")
def object_codec_reread(spark, d):
    """Integers and strings as typed object values and back."""

    @F.pandas_udf("kind string, shown string")
    def through(kind: pd.Series, text: pd.Series) -> pd.DataFrame:
        back = [codecs.decode_object(codecs.encode_object(k, int(t) if k == "integer" else t)) for k, t in zip(kind, text)]
        return pd.DataFrame([(k, str(v)) for k, v in back], columns=["kind", "shown"])

    e = table(spark, d, "events")
    rows = e.select("event_id", F.lit("integer").alias("k"), F.col("user_id").cast("string").alias("t")).unionByName(e.where("props is not null").select("event_id", F.lit("string").alias("k"), F.col("props").alias("t")))
    return rows.select("event_id", through("k", "t").alias("v")).select("event_id", "v.kind", "v.shown")


# ------------------------------------------------------------- tiers, streams


@query("""
with r as (select user_id as key, event_id as version, value, (event_id >> 10) % 2 as half, event_type from events),
ranked as (select *, row_number() over (partition by key order by half desc, version desc) as rn from (select * from r where event_type <> 'error' qualify row_number() over (partition by key, half order by version desc) = 1)),
buried as (select key, max(version) as version from r where event_type = 'error' group by key)
select k.key, k.version, k.value, 3 as generation from ranked k left join buried b on b.key = k.key where rn = 1 and (b.version is null or b.version < k.version)""")
def cold_tier_compacted(spark, d):
    """Two stored generations with their tombstones, compacted and read again."""
    tier = expiry.ColdTier(spark, scratch(spark, "cold"), ["key"])
    for half in _halves(spark, d):
        records, buried = _cold(spark, d, half)
        newest = records.groupBy("key").agg(F.max(F.struct("version", "value", "last_touch")).alias("b")).select("key", "b.*", F.lit(0).alias("expires_at"), F.lit(0).alias("tti_ticks"))
        tier.add(newest, buried)
    tier.compact(now=0)
    return tier.records().select("key", "version", "value", "generation")


@query(f"with {_LAST} select user_id as key, lsn, value from last where event_type <> 'error'")
def delta_table(spark, d):
    """Batches as deltas, folded into a base between, one batch delivered twice."""
    path = scratch(spark, "deltas")
    flush, changes = flusher.delta_sink(path), change_log(spark, d)
    part = F.shiftright("lsn", 9) % 4
    for n in (0, 1, 2, 1, 3):
        flush(log.latest(changes.where(part == n), ["key"], "lsn"), n)
        if n == 2:
            flusher.compact_table(spark, path, "key", "lsn")
    return flusher.current_rows(spark, path, "key", "lsn").select("key", "lsn", "value")


def _streamed(spark: SparkSession, d: str, rows: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _run(stream: DataFrame, spark: SparkSession, schema) -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    out = scratch(spark, "stream-out")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query("""
with e as (select event_id, user_id, lead(event_id) over (partition by user_id order by event_id) as following, max(event_id) over () as top from events)
select user_id::varchar as key, event_id + 500 as tick, 'expired' as event from e where following >= event_id + 500 or following is null and event_id + 500 < top""")
def stream_expiries(spark, d):
    """Writes that live for 500 ticks: which of them expire, by the next touch or by timer."""
    e = table(spark, d, "events")
    touches = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("tick"), F.lit(500).cast("bigint").alias("ttl_ticks"), F.lit(0).cast("bigint").alias("tti_ticks"), F.lit(True).alias("write"))
    return _run(expiring.expiries(_streamed(spark, d, touches, "touches")), spark, expiring.OUT)


@query("select store_id, decode(key) as rec_key, version from flush_records group by all")
def stream_deduplicated(spark, d):
    """The flush log as a stream, one row of each message (of all that is in the watermark's reach)."""
    f = table(spark, d, "flush_records").select("store_id", F.col("key").cast("string").alias("rec_key"), "version", F.col("arrived_at").cast("timestamp").alias("arrived_at"))
    once = flusher.deduplicated(_streamed(spark, d, f.coalesce(1), "flushes"), ["store_id", "rec_key", "version"], "arrived_at", "3650 days")
    return _run(once.select("store_id", "rec_key", "version"), spark, "store_id string, rec_key string, version bigint")


@query(f"with {_LAST} select user_id as key, lsn, value from last where event_type <> 'error'")
def stream_write_behind(spark, d):
    """A change stream flushed in micro-batches to a table of deltas."""
    path = scratch(spark, "table")
    stream = _streamed(spark, d, change_log(spark, d), "changes")
    q = flusher.start_flusher(stream, ["key"], "lsn", flusher.delta_sink(path), scratch(spark, "state"), every="0 seconds")
    q.processAllAvailable()
    q.stop()
    return flusher.current_rows(spark, path, "key", "lsn").select("key", "lsn", "value")


@query("select event_id as lsn, user_id as key from events")
def stream_append_log(spark, d):
    """A change stream appended to a log, durable by micro-batch."""
    path = scratch(spark, "appended")
    q = flusher.append_log(_streamed(spark, d, change_log(spark, d), "changes"), path, scratch(spark, "state"), every="0 seconds")
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(path).select("lsn", "key")


@query(f"with {_HOT}, c as (select max(version) as now from hot) select key, version, 'flushed' as went from hot, c where dirty and now - last_touch >= now // 200 union all select key, version, 'stays' from hot, c where not (dirty and now - last_touch >= now // 200)")
def idle_flush(spark, d):
    """Idle dirty rows are written behind and evicted, the others stay."""
    hot = hot_state(spark, d)
    now = _now(hot)
    flushed, rest = expiry.flush_idle(hot, now, now // 200)
    return flushed.select("key", "version", F.lit("flushed").alias("went")).unionByName(rest.select("key", "version", F.lit("stays").alias("went")))


@query(f"""
with {_COLD}, t as (select count(*) as a from events where event_type <> 'error'), k as (select count(*) as b from cold where rn = 1), s as (select count(*) as c from seen)
select 'superseded' as disposition, a - b as n from t, k union all select 'deleted', b - c from k, s union all select 'expired', 0 union all select 'kept', c from s""")
def cold_gc_report(spark, d):
    return expiry.compaction_report(*_cold(spark, d), ["key"], now=0)


@query("""
with members as (select distinct user_id as key, event_type as member from events), asked as (select c_custkey as key, unnest(['view', 'error', 'none']) as member from customer)
select a.key, a.member, m.key is not null as present from asked a left join members m on m.key = a.key and m.member = a.member""")
def set_contains(spark, d):
    members = objects.set_members(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("member")), "key", "member")
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.explode(F.array(F.lit("view"), F.lit("error"), F.lit("none"))).alias("member"))
    return objects.contains(asked, members, ["key", "member"])


@query("select o_orderkey, '02' || list_aggregate(list_reverse(regexp_extract_all(printf('%016X', o_orderkey::bigint), '(..)', 1)), 'string_agg', '') as number_key, '03' || hex(encode(o_orderstatus)) as bytes_key from orders")
def key_encoding_long_and_bytes(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", encoded_key(F.col("o_orderkey").cast("bigint"), "int64").alias("number_key"), encoded_key(F.encode("o_orderstatus", "UTF-8"), "bytes").alias("bytes_key"))


@query("select user_id as key, count(*) as accesses, unnest(['doorkeeper', 'packed', 'plain', 'two_counter']) as kind, true as in_bounds from events group by user_id")
def sketches_never_undercount(spark, d):
    """Sketches that don't age estimate at least what was counted, up to where they saturate; a doorkeeper keeps the first access."""
    trace = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"))
    exact, out = log.frequencies(trace, ["key"]), None
    for kind, most, off in (("plain", 255, 0), ("packed", 15, 0), ("doorkeeper", 255, 1), ("two_counter", 15, 0)):
        est = policy.sketch_estimates(trace, policy.PolicyConfig(capacity=4096, shards=4, admission=kind), sample=1 << 60)
        held = F.col("estimate").between(F.least(F.col("accesses") - off, F.lit(most)), most)
        part = exact.join(est, "key").select("key", "accesses", F.lit(kind).alias("kind"), held.alias("in_bounds"))
        out = part if out is None else out.unionByName(part)
    return out


@query("select o_custkey::varchar as file, sum(octet_length(encode(o_orderstatus || ':' || o_orderkey || ';')))::bigint as length, md5(string_agg(o_orderstatus || ':' || o_orderkey || ';', '' order by o_orderkey)) as digest from orders group by o_custkey")
def paged_files(spark, d):
    """Each customer's orders written piece by piece into a file of small pages, and the whole file read back."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("seq"), F.concat("o_orderstatus", F.lit(":"), F.col("o_orderkey").cast("string"), F.lit(";")).alias("text"))
    from keyloom.operators.segments import running_sum

    placed = running_sum(o, ["file"], "seq", F.octet_length("text"), "offset", inclusive=False)
    stored = pages.write_at(spark.createDataFrame([], pages.SCHEMA), placed.select("file", "offset", F.encode("text", "UTF-8").alias("data"), "seq"), page=64)
    sizes = pages.lengths(stored, 64)
    back = pages.read_at(stored, sizes.withColumn("offset", F.lit(0).cast("bigint")), page=64)
    return back.select("file", F.col("available").alias("length"), F.md5("data").alias("digest"))


@query(f"with {_LAST} select user_id as key, lsn, value from last where event_type <> 'error'")
def checkpoint_and_reset(spark, d):
    """A log that is emptied by a checkpoint half way; the snapshot and what came later are all that is left."""
    changes = change_log(spark, d)
    half = (changes.agg(F.max("lsn")).first()[0] or 0) // 2
    store = recovery.CheckpointStore(spark, scratch(spark, "checkpoints"))
    lsn, _ = store.checkpoint_and_reset(changes.where(F.col("lsn") <= half), ["key"], "lsn")
    return recovery.recover(store.load_latest()[1], changes.where(F.col("lsn") > half), ["key"], "lsn", lsn).select("key", "lsn", "value")


@query()
def hot_key_trace_hit_ratio(spark, d):
    """A generated trace whose hot fifth of keys gets four fifths of the accesses, through the cache policy."""
    return policy.hit_ratio(policy.replay(policy.hot_key_trace(spark, 100_000, 10_000), policy.PolicyConfig(capacity=2000, shards=8)))


@query(f"with {_LAST} select user_id::varchar as key, lsn + 1 as version, value, (select max(event_id) + 1 from events) as lsn from last where event_type <> 'error'")
def object_snapshot_reread(spark, d):
    """The live state as object snapshot files with footers, and back."""
    path, changes = scratch(spark, "objects"), change_log(spark, d)
    top = log.high_water_mark(changes, [], "lsn").first()[0] or 0
    live = log.rebuilt(changes, ["key"], "lsn").select((F.col("lsn") + 1).alias("version"), F.lit("put").alias("op"), F.encode(F.col("key").cast("string"), "UTF-8").alias("key"), F.encode(F.col("value").cast("string"), "UTF-8").alias("value"))
    wal.write_object_snapshot(live, path, top + 1)
    back = wal.read_object_snapshot(spark, f"{path}/*.obj")
    return back.select(F.col("key").cast("string").alias("key"), "version", F.col("value").cast("string").cast("double").alias("value"), "lsn")


@query("select event_id, value, user_id as number, event_type = 'click' as flag from events")
def dense_values_packed(spark, d):
    """Numbers and truth values as the 8-byte words that dense lanes keep, and back."""
    e = table(spark, d, "events")
    words = e.select("event_id", dense.packed(F.col("value"), "f64").alias("v"), dense.packed(F.col("user_id"), "i64").alias("n"), dense.packed(F.col("event_type") == "click", "bool").alias("f"))
    return words.select("event_id", dense.unpacked(F.col("v"), "f64").alias("value"), dense.unpacked(F.col("n"), "i64").alias("number"), dense.unpacked(F.col("f"), "bool").alias("flag"))


@query(f"with {_HOT} select c_custkey as key, version, last_touch, version + 5000 as expires_at, 3000 as tti_ticks from customer join hot on hot.key = c_custkey where not tombstone")
def expiry_of_keys(spark, d):
    """Times of the requested keys that hold a value."""
    state = hot_state(spark, d).withColumn("expires_at", F.col("version") + 5000).withColumn("tti_ticks", F.lit(3000))
    return expiry.expiry_meta(state, table(spark, d, "customer").select(F.col("c_custkey").alias("key")), ["key"])


@query("select store_id, max(lsn) as high_water_mark from wal_records group by store_id")
def high_water_marks(spark, d):
    return log.high_water_mark(table(spark, d, "wal_records"), ["store_id"], "lsn")


@query(f"with {_HOT} select key, version, dirty from hot where dirty or not exists (select 1 from customer where c_custkey = key and c_nationkey < 12)")
def evict_clean_keys(spark, d):
    """Rows of the customers of some nations leave the cache, unless they are dirty."""
    asked = table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("key"))
    return expiry.evict_clean(hot_state(spark, d), asked, ["key"]).select("key", "version", "dirty")


@query("""
with halves as (select *, (event_id >> 10) % 2 as half from events),
last as (select user_id as key, half, max(event_id) as version, arg_max(value, event_id) as value, arg_max(event_type, event_id) = 'click' as dirty from halves group by all)
select coalesce(a.key, b.key) as key, greatest(a.version, b.version) as version, case when a.key is null or b.version > a.version then b.value else a.value end as value, case when a.key is null or b.version > a.version then false else a.dirty end as dirty
from (select * from last where half = 0) a full join (select * from last where half = 1) b on b.key = a.key""")
def load_clean_records(spark, d):
    """Records of one half of the events, loaded clean into a cache that holds the other half."""
    held, stored = (hot_state(spark, d, half) for half in _halves(spark, d))
    return expiry.load_clean(held, stored, ["key"]).select("key", "version", "value", "dirty")
