"""Queries p1_ to p6_: the general problems of TESTDATA.md over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keyloom.functions.keys import key_text
from keyloom.operators import changefeed, dedupe, incremental, nested, orphans, skew
from keyloom.session import scratch, table

#: Where queries part early arrivals from later ones.
_LATER = "2025-02-01 00:00:00"

# ---------------------------------------------------------------- problem 1


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    users, companies = table(spark, d, "users"), table(spark, d, "companies")
    refs = orphans.declared_references({"users": (users, ["company_id"]), "companies": (companies, ["parent_id"])}, table(spark, d, "forward_includes"), table(spark, d, "schema_fields"))
    cols = ["id", "version", "tombstone", "arrived_at"]
    parents = users.select(F.lit("users").alias("collection"), *cols).unionByName(companies.select(F.lit("companies").alias("collection"), *cols))
    return refs.where(F.col("ref_collection").isin("users", "companies")), parents


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphans(*_references(spark, d))
    return found.select("collection", "rec_key", "ref_field", F.date_format("arrived_at", "yyyy-MM").alias("period")).distinct()


def p1_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field and month."""
    return p1_found(spark, d).groupBy("collection", "ref_field", "period").agg(F.count(F.lit(1)).alias("orphans"))


_P1 = """
with declared as (select distinct collection, name, ref_collection from schema_fields where ref_collection in ('users', 'companies')),
refs0 as (
  select 'users' as collection, id as rec_key, 'company_id' as ref_field, company_id as k, arrived_at from users
  union all select 'companies', id, 'parent_id', parent_id, arrived_at from companies
  union all select collection, primary_key, field, reference_key, arrived_at from forward_includes),
refs as (select distinct r.*, d.ref_collection from refs0 r join declared d on r.collection = d.collection and r.ref_field = d.name where k is not null),
parents as (select 'users' as c, id, version, tombstone, arrived_at as at from users union all select 'companies', id, version, tombstone, arrived_at from companies),
held_then as (
  select r.collection, r.rec_key, r.ref_field, r.k, r.arrived_at, r.ref_collection, arg_max(p.tombstone, p.version) as dead
  from refs r join parents p on p.c = r.ref_collection and p.id = r.k and p.at <= r.arrived_at group by all),
held_last as (select c, id, arg_max(tombstone, version) as dead from parents group by all),
p1 as (
  select distinct r.collection, r.rec_key, r.ref_field, strftime(r.arrived_at, '%Y-%m') as period from refs r
  where not exists (select 1 from held_then h where h.collection = r.collection and h.rec_key = r.rec_key and h.ref_field = r.ref_field and h.k = r.k and h.arrived_at = r.arrived_at and not h.dead)
     or not exists (select 1 from held_last h where h.c = r.ref_collection and h.id = r.k and not h.dead))
"""

# ---------------------------------------------------------------- problem 2

_KEY = ["collection", "rec_key"]


def _wal_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wal_records").withColumn("rec_key", key_text(F.col("key")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(_wal_keys(spark, d), _KEY, 0.01).select(*_KEY)


def p2_key_totals(spark: SparkSession, d: str) -> DataFrame:
    """Records, last LSN and bytes of every key, heavy or not."""
    rows = _wal_keys(spark, d)
    folds = [skew.Fold("records", "count"), skew.Fold("last_lsn", "max", F.col("lsn")), skew.Fold("bytes", "sum", F.octet_length("value").cast("bigint"))]
    return skew.salted_fold(rows, _KEY, folds).withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("bigint")))


# ---------------------------------------------------------------- problem 3


def _log_rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    lsn = {"wal_records": "lsn", "flush_records": "version"}[name]
    return table(spark, d, name).select("store_id", key_text(F.col("key")).alias("rec_key"), F.col(lsn).alias("lsn"), "arrived_at")


def _pending(spark: SparkSession, d: str, name: str, kind: str) -> DataFrame:
    rows = incremental.pending_records(_log_rows(spark, d, name), table(spark, d, "checkpoints"), kind)
    return rows.select(F.lit(name).alias("log_name"), "store_id", "rec_key", "lsn")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d, "wal_records", "raw").unionByName(_pending(spark, d, "flush_records", "object"))


def p3_pending_per_store(spark: SparkSession, d: str) -> DataFrame:
    """How much each store's next run has to process."""
    return p3_found(spark, d).groupBy("log_name", "store_id").agg(F.count(F.lit(1)).alias("pending"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def p3_runs_after_failure(spark: SparkSession, d: str) -> DataFrame:
    """Which run handed each flush record on: one over the early arrivals, then one over all; between them a run that died before publishing and one that came second."""
    log = _log_rows(spark, d, "flush_records")
    ident = ["store_id", "rec_key", "lsn"]
    runs = incremental.RunLedger(spark, scratch(spark, "runs"), ident, "lsn")
    runs.commit(runs.pending(log.where(F.col("arrived_at") < F.lit(_LATER).cast("timestamp_ntz"))))
    state = runs.state()
    runs.pending(log).write.parquet(f"{runs.root}/out/died")
    runs.commit(runs.pending(log), based_on=state)
    try:
        runs.commit(runs.pending(log.limit(0)), based_on=state)
    except RuntimeError:
        pass
    out = None
    for m in runs.manifests():
        part = spark.read.parquet(m["out"]).select(F.lit(m["number"] + 1).alias("run"), *ident)
        out = part if out is None else out.unionByName(part)
    return out


_P3 = """
with logs as (
  select 'wal_records' as log_name, 'raw' as kind, store_id, decode(key) as rec_key, lsn, min(arrived_at) as first_at from wal_records group by all
  union all select 'flush_records', 'object', store_id, decode(key), version, min(arrived_at) from flush_records group by all),
good as (
  select store_id, kind, case kind when 'raw' then checkpoint_lsn else lsn end as ck, started_at from checkpoints
  where finished_at is not null and path not like '%.tmp' and footer_count = record_count),
last_ck as (select store_id, kind, ck, started_at, row_number() over (partition by store_id, kind order by ck desc, started_at desc) as rn from good where ck is not null),
p3 as (
  select log_name, l.store_id, rec_key, lsn from logs l left join last_ck c on c.store_id = l.store_id and c.kind = l.kind and c.rn = 1
  where not coalesce(lsn <= c.ck and first_at <= c.started_at, false))
"""

# ---------------------------------------------------------------- problem 4


_DOC = ["store_id", "lsn"]


def _routed(spark: SparkSession, d: str) -> nested.Routed:
    """All documents, flattened by one walk and routed to their typed tables."""
    schema = nested.declared_schema(table(spark, d, "schema_fields"))
    rows = nested.flatten(nested.one_copy(table(spark, d, "schema_flush"), _DOC), schema, _DOC)
    return nested.route(rows, schema, _DOC, scratch(spark, "routed"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).supertype().select(*_DOC, "path", "ordinals")


def p4_parent_links(spark: SparkSession, d: str) -> DataFrame:
    """The supertype table: every object with its parent."""
    return _routed(spark, d).supertype().select(*_DOC, "path", "ordinals", "parent_path", "parent_ordinals", "extras")


def p4_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Structural variants per path and how many objects have them."""
    return _routed(spark, d).supertype().groupBy("collection", "path", "shape", "extras").agg(F.count(F.lit(1)).alias("objects"))


def p4_deal_rows(spark: SparkSession, d: str) -> DataFrame:
    """A typed child table: the rows of the deals of companies, linked to their deal."""
    return _routed(spark, d).table("companies", "deals.terms.rows")


def p4_deal_amounts(spark: SparkSession, d: str) -> DataFrame:
    """The typed columns of that table."""
    return p4_deal_rows(spark, d).select(*_DOC, "ordinals", "parent_path", "parent_ordinals", "sku", "qty", "price")


def p4_routed_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the typed tables of all declared paths and variants, with parent links and their typed columns as JSON."""
    routed, out = _routed(spark, d), None
    for collection, path in routed.paths():
        t = routed.table(collection, path)
        link = [*_DOC, "ordinals", "parent_path", "parent_ordinals", "shape"]
        typed = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in t.columns if c not in (*link, "payload")]))
        part = t.select(F.lit(collection).alias("collection"), F.lit(path).alias("path"), *link, typed.alias("typed"), "payload")
        out = part if out is None else out.unionByName(part)
    return out


# The declared types and the documents are walked level by level: a text that encodes JSON is read first, then an
# object gives its declared fields and an array its elements.
_P4 = """
with recursive types as (
  select collection, '{"object":[' || string_agg('{"name":"' || name || '","type":' || case when starts_with(trim(field_type), '{') then field_type else '"' || field_type || '"' end || '}', ',') || ']}' as t
  from schema_fields group by collection),
docs as (
  select store_id, lsn, collection, document from (
    select *, row_number() over (partition by store_id, lsn order by arrived_at nulls last, length(document), document) as rn from schema_flush where document is not null)
  where rn = 1 and json_valid(document)),
walk as (
  select store_id, lsn, d.document as v, t.t, '' as path, '' as ordinals, '' as parent_path, '' as parent_ordinals, false as element
  from docs d join types t on t.collection = d.collection
  union all
  select store_id, lsn, n.v, n.t, n.path, n.ordinals, n.parent_path, n.parent_ordinals, n.element
  from walk w, lateral (
    select w.v ->> '$' as v, w.t, w.path, w.ordinals, w.parent_path, w.parent_ordinals, w.element
    where json_type(w.v) = 'VARCHAR' and json_valid(w.v ->> '$')
    union all
    select json_extract(w.v, '$."' || (f.x ->> '$.name') || '"')::varchar, f.x -> '$.type', case when w.path = '' then '' else w.path || '.' end || (f.x ->> '$.name'), w.ordinals,
      case when w.element then w.path else w.parent_path end, case when w.element then w.ordinals else w.parent_ordinals end, false
    from (select unnest(json_extract(w.t, '$.object[*]')) as x) f
    where json_type(w.v) = 'OBJECT' and json_type(w.t) = 'OBJECT' and json_type(f.x, '$.type') = 'OBJECT' and json_type(json_extract(w.v, '$."' || (f.x ->> '$.name') || '"')) in ('OBJECT', 'ARRAY', 'VARCHAR')
    union all
    select json_extract(w.v, '$[' || i || ']')::varchar, json_extract(w.t, '$.array'), w.path, case when w.ordinals = '' then '' else w.ordinals || '.' end || i, w.parent_path, w.parent_ordinals, true
    from (select unnest(range(coalesce(json_array_length(w.v), 0)::bigint)) as i where json_type(w.v) = 'ARRAY' and json_type(w.t, '$.array') = 'OBJECT') e
    union all
    select w.v, json_extract(w.t, '$.array'), w.path, case when w.ordinals = '' then '' else w.ordinals || '.' end || '0', w.parent_path, w.parent_ordinals, true
    where json_type(w.v) = 'OBJECT' and json_type(w.t, '$.array.object') = 'ARRAY') n),
p4 as (select distinct store_id, lsn, path, ordinals, parent_path, parent_ordinals, v, t from walk where element and json_type(v) = 'OBJECT' and json_type(t, '$.object') = 'ARRAY')
"""

# ---------------------------------------------------------------- problem 5

#: Identifier and tie-break of each log that is delivered at least once.
_DELIVERED = {"flush_records": (["store_id", "rec_key", "version"], "version", "value"), "schema_flush": (["store_id", "lsn"], "lsn", "document")}


def _delivered(spark: SparkSession, d: str, name: str) -> DataFrame:
    body = _DELIVERED[name][2]
    return table(spark, d, name).withColumn("rec_key", key_text(F.col("key"))).withColumn("body_hash", F.xxhash64(body))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, (ident, number, _) in _DELIVERED.items():
        carry = [] if "rec_key" in ident else ["rec_key"]
        rows = dedupe.repeated(_delivered(spark, d, name), ident, "arrived_at", ["batch_id", "body_hash"], carry)
        rows = rows.select(F.lit(name).alias("log_name"), "store_id", "rec_key", F.col(number).alias("ident"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p5_unique_flush(spark: SparkSession, d: str) -> DataFrame:
    """The flush log with one copy of each record."""
    rows = dedupe.first_copies(_delivered(spark, d, "flush_records"), ["store_id", "rec_key", "version"], "arrived_at", ["batch_id", "body_hash"])
    return rows.select("store_id", "rec_key", "version", F.date_format("arrived_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_arrival"))


def p5_new_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages that arrived from February 2025 on and were not stored before."""
    rows = _delivered(spark, d, "flush_records")
    ident, later = ["store_id", "rec_key", "version"], F.col("arrived_at") >= F.lit(_LATER).cast("timestamp_ntz")
    return dedupe.new_messages(rows.where(later), rows.where(~later), ident, "arrived_at", ["batch_id", "body_hash"]).select(*ident)


# ---------------------------------------------------------------- problem 6

_STATE = ["store_id", "collection", "rec_key"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    state = changefeed.fold_changes(changefeed.as_changes(_wal_keys(spark, d), _STATE, "lsn", "op"), _STATE)
    return changefeed.live(state).select(*_STATE, F.col("kl_seq").alias("lsn"))


def p6_current_state(spark: SparkSession, d: str) -> DataFrame:
    """The content of each collection, with versions and values."""
    changes = changefeed.as_changes(_wal_keys(spark, d), _STATE, "lsn", "op", ["version", "value"])
    state = changefeed.live(changefeed.fold_changes(changes, _STATE, ["version", "value"]))
    return state.select(*_STATE, F.col("kl_seq").alias("lsn"), "version", F.hex("value").alias("value_hex"))


def p6_base_and_late(spark: SparkSession, d: str) -> DataFrame:
    """Live keys per collection from a base that held early arrivals, then the rest folded in."""
    changes = changefeed.as_changes(_wal_keys(spark, d), [*_STATE, "arrived_at"], "lsn", "op")
    early = F.col("arrived_at") < F.lit(_LATER).cast("timestamp_ntz")
    base = changefeed.fold_changes(changes.where(early), _STATE)
    state = changefeed.live(changefeed.fold_changes(changes.where(~early), _STATE, base=base))
    return state.groupBy("collection").agg(F.count(F.lit(1)).alias("live_keys"), F.sum("kl_seq").alias("lsn_sum"))


_P6 = """
with ranked as (
  select store_id, collection, decode(key) as rec_key, lsn, version, value, lower(op) in ('put', '1') as live,
         row_number() over (partition by store_id, collection, key order by lsn desc, lower(op) in ('put', '1') desc, version desc, value desc) as rn
  from wal_records where lsn is not null),
p6 as (select store_id, collection, rec_key, lsn, version, value from ranked where rn = 1 and live)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_orphan_report": p1_orphan_report,
    "p2_found": p2_found,
    "p2_key_totals": p2_key_totals,
    "p3_found": p3_found,
    "p3_pending_per_store": p3_pending_per_store,
    "p3_runs_after_failure": p3_runs_after_failure,
    "p4_found": p4_found,
    "p4_parent_links": p4_parent_links,
    "p4_shapes": p4_shapes,
    "p4_deal_rows": p4_deal_rows,
    "p4_deal_amounts": p4_deal_amounts,
    "p4_routed_rows": p4_routed_rows,
    "p5_found": p5_found,
    "p5_unique_flush": p5_unique_flush,
    "p5_new_messages": p5_new_messages,
    "p6_found": p6_found,
    "p6_current_state": p6_current_state,
    "p6_base_and_late": p6_base_and_late,
}

SQL = {
    "p1_found": _P1 + "select collection, rec_key, ref_field, period from p1",
    "p1_orphan_report": _P1 + "select collection, ref_field, period, count(*) as orphans from p1 group by all",
    "p2_found": "select collection, decode(key) as rec_key from wal_records group by all having count(*) >= 0.01 * (select count(*) from wal_records)",
    "p2_key_totals": "select collection, decode(key) as rec_key, count(*) as records, max(lsn) as last_lsn, coalesce(sum(octet_length(value)), 0)::bigint as bytes from wal_records group by collection, key",
    "p3_found": _P3 + "select log_name, store_id, rec_key, lsn from p3",
    "p3_pending_per_store": _P3 + "select log_name, store_id, count(*) as pending, min(lsn) as first_lsn, max(lsn) as last_lsn from p3 group by all",
    "p3_runs_after_failure": "select case when min(arrived_at) < timestamp '2025-02-01 00:00:00' then 1 else 2 end as run, store_id, decode(key) as rec_key, version as lsn from flush_records group by store_id, key, version",
    "p4_found": _P4 + "select store_id, lsn, path, ordinals from p4",
    "p4_parent_links": _P4 + """
select store_id, lsn, path, ordinals, parent_path, parent_ordinals,
  exists (select 1 from (select unnest(json_keys(v)) as k) where k not in (select unnest(json_extract_string(t, '$.object[*].name')))) as extras from p4""",
    "p4_deal_amounts": _P4 + """
select store_id, lsn, ordinals, parent_path, parent_ordinals, v ->> '$.sku' as sku, case when json_type(v, '$.qty') in ('BIGINT', 'UBIGINT') then try_cast(v ->> '$.qty' as int) end as qty,
  case when json_type(v, '$.price') in ('BIGINT', 'UBIGINT', 'DOUBLE') then (v ->> '$.price')::double end as price from p4 where path = 'deals.terms.rows'""",
    "p5_found": """
select 'flush_records' as log_name, store_id, decode(key) as rec_key, version as ident from flush_records group by all having count(*) > 1
union all select 'schema_flush', store_id, arg_min(decode(key), (arrived_at, batch_id)), lsn from schema_flush group by store_id, lsn having count(*) > 1""",
    "p5_unique_flush": "select store_id, decode(key) as rec_key, version, strftime(min(arrived_at), '%Y-%m-%d %H:%M:%S.%f') as first_arrival from flush_records group by store_id, key, version",
    "p5_new_messages": "select store_id, decode(key) as rec_key, version from flush_records group by store_id, key, version having min(arrived_at) >= timestamp '2025-02-01 00:00:00'",
    "p6_found": _P6 + "select store_id, collection, rec_key, lsn from p6",
    "p6_current_state": _P6 + "select store_id, collection, rec_key, lsn, version, hex(value) as value_hex from p6",
    "p6_base_and_late": _P6 + "select collection, count(*) as live_keys, sum(lsn)::bigint as lsn_sum from p6 group by collection",
}
