"""Every query of the library by name, with the SQL that it must agree with.

The log of most queries is ``events``: key user_id, seq event_id, a tombstone where event_type is error, value as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.operators import changelog, compaction, placement, replication, runs, snapshot
from palimpsest.scratch import leave, shared_dir
from palimpsest.sources import frames, manifest
from palimpsest.store import Sharded, Store
from palimpsest.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Bytes at which a run of the queries closes, and events in a run of those that cut by number.
FLUSH, RUNS = 1024, 4


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return changelog.changelog(e, F.col("user_id"), F.col("event_id"), F.col("value"), F.col("event_type") == "error")


def _top(log: DataFrame) -> int:
    return changelog.last_seq(log)


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The log as runs of equal stretches of numbers, and the last number."""
    log = _log(spark, sf_dir)
    top = _top(log)
    return log.withColumn("run_id", F.floor(F.col("seq") * RUNS / (top + 1)).cast("long")), top


def _out(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*(F.col(c).alias(names.get(c, c)) for c in df.columns))


LOG = "log as (select user_id as key, event_id as seq, case when event_type = 'error' then 0 else 1 end as op, case when event_type = 'error' then null else value end as value from events), top as (select max(seq) as top from log)"
RUN = LOG + f", run as (select *, cast(floor(seq * {RUNS} / (top + 1)) as bigint) as run_id from log, top)"
NEWEST = "select * from (select *, row_number() over (partition by key order by seq desc, op desc) as rn from log, top where seq <= {t}) where rn = 1"
KEYS = [1, 7, 42]


@query(f"with {LOG} select key, seq, value from ({NEWEST.format(t='top')}) where op = 1 and key in (1, 7, 42)")
def get_latest(spark, sf_dir):
    return snapshot.get(_log(spark, sf_dir), KEYS)


@query(f"with {LOG} select key, seq, value from ({NEWEST.format(t='top // 2')}) where op = 1 and key in (1, 7, 42)")
def get_at(spark, sf_dir):
    log = _log(spark, sf_dir)
    return snapshot.get(log, KEYS, _top(log) // 2)


@query(f"""with {LOG}, probe as (select user_id as key, event_id - 100 as "at", event_id from events),
    hit as (select p.key, p."at", p.event_id, l.op, l.value, row_number() over (partition by p.event_id order by l.seq desc, l.op desc) as rn from probe p left join log l on l.key = p.key and l.seq <= p."at")
    select key, "at", event_id, coalesce(op = 1, false) as found, case when op = 1 then value end as value from hit where rn = 1""")
def multi_get_at(spark, sf_dir):
    probes = _table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("event_id") - 100).alias("at"), "event_id")
    return snapshot.multi_get(_log(spark, sf_dir), probes, width=4096)


@query(f"with {LOG} select key, seq, value from ({NEWEST.format(t='top // 2')}) where op = 1")
def snapshot_as_of(spark, sf_dir):
    log = _log(spark, sf_dir)
    return snapshot.snapshot(log, _top(log) // 2)


@query(f"with {LOG} select key, seq, value from ({NEWEST.format(t='top')}) where op = 1")
def snapshot_latest(spark, sf_dir):
    return snapshot.snapshot(_log(spark, sf_dir))


@query(f"""with {LOG}, a as ({NEWEST.format(t='top // 2')}), b as ({NEWEST.format(t='top')}),
    x as (select * from a where op = 1), y as (select * from b where op = 1)
    select coalesce(x.key, y.key) as key, case when x.key is null then 'added' when y.key is null then 'removed' else 'changed' end as change, x.value as old_value, y.value as new_value
    from x full join y on x.key = y.key where x.key is null or y.key is null or x.seq <> y.seq""")
def snapshot_diff(spark, sf_dir):
    log = _log(spark, sf_dir)
    top = _top(log)
    return snapshot.diff(log, top // 2, top)


@query(f"with {LOG} select key, seq, op, value, lead(seq) over (partition by key order by seq, op) as until, row_number() over (partition by key order by seq, op) as version from log")
def version_history(spark, sf_dir):
    return changelog.history(_log(spark, sf_dir))


@query("select conv_id as key, turn as seq, role, lead(turn) over (partition by conv_id order by turn) as until, length(text) as n_chars from conversations")
def conversation_history(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    log = changelog.changelog(c, F.col("conv_id"), F.col("turn"), F.struct("role", F.length("text").cast("long").alias("n_chars")))
    return changelog.history(log).select("key", "seq", "value.role", "until", "value.n_chars")


@query(f"with {LOG} select key, seq, op, value from log, top where seq > top // 4 and seq <= top // 2")
def changes_between(spark, sf_dir):
    log = _log(spark, sf_dir)
    top = _top(log)
    return changelog.changes_between(log, top // 4, top // 2)


@query(f"with {LOG} select key, seq from ({NEWEST.format(t='top')}) where op = 0")
def tombstone_mask(spark, sf_dir):
    return snapshot.tombstones(_log(spark, sf_dir))


@query(f"with {LOG} select key, seq, op, value from (select *, lag(op) over (partition by key order by seq, op) as b from log) where op = 1 and b = 0")
def delete_then_reput(spark, sf_dir):
    return changelog.reput_after_delete(_log(spark, sf_dir))


@query(f"with {LOG} select o_custkey as key, (select top from top) + row_number() over (order by o_orderkey) as seq, o_totalprice as value from orders")
def next_seq(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_totalprice").alias("value"))
    return changelog.number_rows(orders, ["o_orderkey"], _top(_log(spark, sf_dir))).select("key", "seq", "value")


@query(f"with {LOG}, batch as (select o_custkey as key, (select top from top) + row_number() over (order by o_orderkey) as seq, 1 as op, o_totalprice as value from orders), log2 as (select * from log union all select * from batch) select key, count(*) as versions, max(seq) as last_seq from log2 group by key")
def put_batch(spark, sf_dir):
    log = _log(spark, sf_dir)
    batch = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_totalprice").alias("value"))
    return changelog.put(log, batch, ["o_orderkey"]).groupBy("key").agg(F.count("*").alias("versions"), F.max("seq").alias("last_seq"))


@query(f"with {LOG}, dead as (select distinct o_custkey as key from orders where o_orderstatus = 'P'), log2 as (select * from log where key not in (select key from dead)) select key, seq, value from (select *, row_number() over (partition by key order by seq desc, op desc) as rn from log2) where rn = 1 and op = 1")
def delete_batch(spark, sf_dir):
    gone = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")).distinct()
    return snapshot.snapshot(changelog.delete(_log(spark, sf_dir), gone, ["key"]))


@query(f"with {LOG} select key, seq, op, value from log")
def replay_log(spark, sf_dir):
    log = _log(spark, sf_dir)
    return changelog.replay(log, changelog.changes_between(log, _top(log) // 2, _top(log)))


# Codecs

ASCII = "list_transform(string_split({c}, ''), lambda ch: cast(ord(ch) as bigint))"
FNV = "list_reduce(list_concat([cast(2166136261 as bigint)], " + ASCII + "), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query("select c_custkey, hex(encode(c_name)) || printf('%016X', c_custkey) || '01' as internal_key from customer")
def internal_key_encode(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.hex(codec.encode_key(F.col("c_name"), F.col("c_custkey"), F.lit(codec.PUT))).alias("internal_key"))


@query("select c_custkey, c_name as key, c_custkey as seq, 1 as op from customer")
def internal_key_parse(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    raw = c.select("c_custkey", codec.parse_key(codec.encode_key(F.col("c_name"), F.col("c_custkey"), F.lit(codec.PUT))).alias("p"))
    return raw.select("c_custkey", F.col("p.key").cast("string").alias("key"), "p.seq", "p.op")


@query(f"with {LOG} select key, seq, op, row_number() over (partition by key order by seq desc, op desc) as position from log")
def internal_key_order(spark, sf_dir):
    return runs.position(_log(spark, sf_dir)).select("key", "seq", "op", "position")


CRC_SQL = "xor(list_reduce(list_concat([cast(4294967295 as bigint)], " + ASCII + "), lambda h, b: xor(h >> 8, list_reduce(list_concat([xor(h, b) & 255], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))), 4294967295)"


@query(f"select c_custkey, {CRC_SQL.format(c='c_name')} as crc from customer")
def crc32_key(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", codec.crc32(F.col("c_name")).alias("crc"))


@query(f"select c_custkey, {FNV.format(c='c_name')} as fnv from customer")
def fnv1a_key(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", codec.fnv1a(F.col("c_name")).alias("fnv"))


POSITIONS = "with h as (select c_custkey, c_name, c_nationkey, " + FNV.format(c="c_name") + " as h from customer), pos as (select c_custkey, c_name, c_nationkey, i, ((h + i * 2654435769) & 4294967295) % 32768 as position from h, (select unnest(range(3)) as i))"


@query(POSITIONS + " select c_custkey, i, position from pos")
def bloom_positions(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.posexplode(codec.bloom_positions(F.col("c_name"))).alias("i", "position")).withColumn("i", F.col("i").cast("long"))


@query(POSITIONS + """, bits as (select distinct c_nationkey as run_id, position from pos),
    probe as (select c_name as key, (c_nationkey + 1) % 25 as run_id, position from pos),
    hit as (select p.run_id, p.key, bool_and(b.position is not null) as all_set from probe p left join bits b on b.run_id = p.run_id and b.position = p.position group by 1, 2)
    select run_id, key, all_set or run_id not in (select run_id from bits) as might_contain from hit""")
def bloom_might_contain(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    built = runs.bloom_build(c.select(F.col("c_nationkey").alias("run_id"), F.col("c_name").alias("key")))
    return runs.bloom_test(c.select(((F.col("c_nationkey") + 1) % 25).alias("run_id"), F.col("c_name").alias("key")), built)


FRAME = "with r as (select c_custkey, hex(encode(c_name)) || printf('%016X', c_custkey) || '01' as k, hex(encode(c_mktsegment)) as v from customer), p as (select *, printf('%08X', length(k) // 2) as kn, printf('%08X', length(v) // 2) as vn from r)"
LE = "substr({c}, 7, 2) || substr({c}, 5, 2) || substr({c}, 3, 2) || substr({c}, 1, 2)"


@query(FRAME + f" select c_custkey, {LE.format(c='kn')} || k || {LE.format(c='vn')} || v as record from p")
def run_record_encode(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    key = codec.encode_key(F.col("c_name"), F.col("c_custkey"), F.lit(codec.PUT))
    return c.select("c_custkey", F.hex(codec.record(key, F.col("c_mktsegment"))).alias("record"))


HEX_BYTES = "list_transform(range(length({c}) // 2), lambda i: (strpos('0123456789ABCDEF', substr({c}, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr({c}, 2 * i + 2, 1)) - 1)"


@query(FRAME + f", q as (select c_custkey, {LE.format(c='kn')} || k || {LE.format(c='vn')} || v as body from p), z as (select c_custkey, body, printf('%08X', {CRC_SQL.replace(ASCII, HEX_BYTES).format(c='body')}) as crc from q) select c_custkey, {LE.format(c='crc')} || body as frame from z")
def wal_frame_encode(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    frame = codec.log_frame(codec.encode_key(F.col("c_name"), F.col("c_custkey"), F.lit(codec.PUT)), F.col("c_mktsegment"))
    return c.select("c_custkey", F.hex(frame).alias("frame"))


# Sizes, runs, indexes

SIZE = "octet_length(encode(cast(key as varchar))) + case when op = 1 then octet_length(encode(cast(value as varchar))) else 0 end + 139"


@query("select o_orderkey, octet_length(encode(o_orderpriority)) + octet_length(encode(o_orderstatus)) + 139 as size from orders")
def entry_size(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select("o_orderkey", codec.entry_size(F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit(codec.PUT)).alias("size"))


PRIORITY = "olog as (select o_custkey as key, o_orderkey as seq, case when o_orderstatus = 'F' then 0 else 1 end as op, o_orderpriority as value from orders), sized as (select *, octet_length(encode(cast(key as varchar))) + case when op = 1 then octet_length(encode(value)) else 0 end + 139 as size from olog)"


def _orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return changelog.changelog(o, F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus") == "F")


@query(f"with {PRIORITY} select key, seq, size, cast(sum(size) over (partition by key order by seq, op rows unbounded preceding) as bigint) as running from sized")
def memtable_cumulative_size(spark, sf_dir):
    return runs.running_size(_orders_log(spark, sf_dir)).select("key", "seq", "size", "running")


@query(f"""with recursive {PRIORITY}, n as (select key, seq, size, row_number() over (partition by key order by seq, op) as i from sized),
    fold as (select key, seq, i, cast(0 as bigint) as segment, cast(size as bigint) as held from n where i = 1
        union all select n.key, n.seq, n.i, case when f.held >= {FLUSH} then f.segment + 1 else f.segment end, case when f.held >= {FLUSH} then cast(n.size as bigint) else f.held + n.size end from fold f join n on n.key = f.key and n.i = f.i + 1)
    select key, seq, segment from fold""")
def run_segments(spark, sf_dir):
    return runs.flush_runs(_orders_log(spark, sf_dir), FLUSH).select("key", "seq", "segment")


ZONES = "select run_id, min(key) as min_key, max(key) as max_key, count(*) as entries, min(seq) as min_seq, max(seq) as max_seq from run group by run_id"


@query(f"with {RUN} {ZONES}")
def run_zone_map(spark, sf_dir):
    return runs.zone_map(_runs(spark, sf_dir)[0])


@query("with r as (select c_custkey as key, c_nationkey as run_id from customer), z as (select run_id, min(key) as lo, max(key) as hi from r group by run_id) select distinct o_custkey as key, run_id from orders join z on o_custkey between lo and hi")
def run_prune(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("run_id"), F.lit(0).alias("seq"))
    return runs.prune(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct(), runs.zone_map(c))


BLOCKS = """with recursive r as (select c_nationkey as run_id, c_name as key, octet_length(encode(c_name)) + 9 + octet_length(encode(c_mktsegment)) + 8 as size, row_number() over (partition by c_nationkey order by c_name, c_custkey desc) as i from customer),
    fold as (select run_id, key, size, i, cast(0 as bigint) as block, cast(size as bigint) as held from r where i = 1
        union all select r.run_id, r.key, r.size, r.i, case when f.held >= 512 then f.block + 1 else f.block end, case when f.held >= 512 then cast(r.size as bigint) else f.held + r.size end from fold f join r on r.run_id = f.run_id and r.i = f.i + 1),
    idx as (select run_id, block, min(key) as first_key, count(*) as entries, cast(sum(size) as bigint) as bytes from fold group by 1, 2)"""


def _customer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("run_id"), F.col("c_name").alias("key"), F.col("c_custkey").alias("seq"), F.lit(codec.PUT).alias("op"), F.col("c_mktsegment").alias("value"))


@query(BLOCKS + " select run_id, block, first_key, entries, bytes from idx")
def sparse_block_index(spark, sf_dir):
    return runs.block_index(_customer_runs(spark, sf_dir), block=512)


@query(BLOCKS + " select p.c_nationkey as run_id, p.c_name as key, max(block) as block from customer p left join idx on idx.run_id = p.c_nationkey and idx.first_key <= p.c_name group by 1, 2")
def block_lookup(spark, sf_dir):
    rows = _customer_runs(spark, sf_dir)
    return runs.block_of(rows.select("run_id", "key"), runs.block_index(rows, block=512))


# Compaction


@query(f"with {RUN} select run_id, key, seq, op, row_number() over (partition by key order by seq desc, op desc) as position from run")
def kway_merge(spark, sf_dir):
    log, top = _runs(spark, sf_dir)
    parts = [log.where(F.col("run_id") == i) for i in range(RUNS)]
    return runs.position(runs.merge(*parts)).select("run_id", "key", "seq", "op", "position")


KEPT = "select run_id, key, seq, op, value from (select *, row_number() over (partition by {by}key, seq <= top * 7 // 10 order by seq desc, op desc) as rn from run) where seq > top * 7 // 10 or (rn = 1 and op = 1)"


@query(f"with {RUN} {KEPT.format(by='')}")
def compact_by_key(spark, sf_dir):
    log, top = _runs(spark, sf_dir)
    return compaction.retain(log, top * 7 // 10).select("run_id", "key", "seq", "op", "value")


@query(f"with {RUN} {KEPT.format(by='run_id, ')}")
def compact_by_run(spark, sf_dir):
    log, top = _runs(spark, sf_dir)
    return compaction.retain(log, top * 7 // 10, "run").select("run_id", "key", "seq", "op", "value")


@query(f"with {RUN}, a as ({KEPT.format(by='')}), b as ({KEPT.format(by='run_id, ')}) select (select count(*) from run) as before, (select count(*) from a) as after_key, (select count(*) from b) as after_run")
def compaction_reclaim(spark, sf_dir):
    log, top = _runs(spark, sf_dir)
    return compaction.reclaimed(log, top * 7 // 10)


@query(f"""with {RUN}, b as ({KEPT.format(by='run_id, ')}),
    live as (select * from (select *, row_number() over (partition by key order by seq desc, op desc) as rn from run where seq <= top * 7 // 10) where rn = 1 and op = 1),
    after as (select key, seq, op, value from (select b.*, row_number() over (partition by key order by seq desc, op desc) as rn from b, top where seq <= top * 7 // 10) where rn = 1 and op = 1)
    select key, seq, value from after where key not in (select key from live)""")
def resurrected_keys(spark, sf_dir):
    log, top = _runs(spark, sf_dir)
    return compaction.resurrected(log, top * 7 // 10)


@query("select n_nationkey as run_id, n_nationkey as ordinal from nation order by n_nationkey limit 4")
def compaction_select(spark, sf_dir):
    return compaction.choose(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run_id"), F.col("n_nationkey").alias("ordinal")))


# Catalog and log files

ENTRIES = """with z as (select o_custkey % 50 as f, min(o_orderkey) as lo, max(o_orderkey) as hi from orders group by 1),
    e as (select f * 3 as pos, 'ADD' as action, 'run-' || f as path, lo, hi from z union all select f * 3 + 1, 'REMOVE', 'run-' || (f - 4), lo, hi from z where f % 3 = 0 union all select f * 3 + 2, 'ADD', 'run-' || (f - 4), lo, hi from z where f % 6 = 0)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("f")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    row = lambda at, action, path: z.select((F.col("f") * 3 + at).alias("pos"), F.lit(action).alias("action"), F.concat(F.lit("run-"), path.cast("string")).alias("path"), F.col("lo").cast("string").alias("min_key"), F.col("hi").cast("string").alias("max_key"), "f")
    e = row(0, "ADD", F.col("f")).union(row(1, "REMOVE", F.col("f") - 4).where("f % 3 = 0")).union(row(2, "ADD", F.col("f") - 4).where("f % 6 = 0"))
    return e.drop("f")


@query(ENTRIES + """, nx as (select a.pos, a.path, a.lo, a.hi, (select min(pos) from e b where b.path = a.path and b.pos > a.pos and b.action = 'ADD') as na, (select min(pos) from e b where b.path = a.path and b.pos > a.pos and b.action = 'REMOVE') as nr from e a where a.action = 'ADD')
    select pos, path, cast(lo as varchar) as min_key, cast(hi as varchar) as max_key from nx where nr is null or na < nr""")
def manifest_live(spark, sf_dir):
    return manifest.live(manifest.parse(manifest.encode(_entries(spark, sf_dir))))


@query(ENTRIES + """ select pos, '{"action":"' || action || '","path":"' || path || '","min_key":"' || lo || '","max_key":"' || hi || '"}' as line from e""")
def manifest_encode(spark, sf_dir):
    return manifest.encode(_entries(spark, sf_dir))


@query("with f as (select event_id as pos, user_id, value, event_id % 997 = 500 as bad from events), b as (select min(pos) as first_bad from f where bad) select pos, user_id from f, b where first_bad is null or pos < first_bad")
def wal_valid_prefix(spark, sf_dir):
    return frames.valid_prefix(_frames(spark, sf_dir)).select("pos", "user_id")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    payload = codec.record(codec.encode_key(F.col("user_id").cast("string"), F.col("event_id"), F.lit(1)), F.col("event_type"))
    return e.select(F.col("event_id").alias("pos"), "user_id", payload.alias("payload")).withColumn("crc", F.crc32("payload") + (F.col("pos") % 997 == 500).cast("int"))


@query("with f as (select event_id as pos, event_id % 997 = 500 as bad from events) select max(pos) as max_seq from f where pos < coalesce((select min(pos) from f where bad), 9223372036854775807)")
def wal_max_seq(spark, sf_dir):
    return frames.valid_prefix(_frames(spark, sf_dir)).agg(F.max("pos").alias("max_seq"))


@query(f"with f as (select c_nationkey as log, c_custkey as pos, c_name, c_mktsegment, c_custkey % 97 = 50 as bad, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i from customer), b as (select log, min(i) as first from f where bad group by log) select cast(log as varchar) as log, i as pos, c_name as key, pos as seq, 1 as op, c_mktsegment as value from f left join b using (log) where first is null or i < first")
def log_files_recovered(spark, sf_dir):
    """Logs written as files of frames, some of them spoilt, and what a reading of the files has."""
    c, folder = _table(spark, sf_dir, "customer"), _folder(spark, "logs")
    frame = codec.log_frame(codec.encode_key(F.col("c_name"), F.col("c_custkey"), F.lit(codec.PUT)), F.col("c_mktsegment"))
    spoilt = F.concat(F.expr("X'00000000'"), F.substring(frame, F.lit(5), F.octet_length(frame)))
    frames.write_logs(c.select(F.col("c_nationkey").alias("log"), F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 97 == 50, spoilt).otherwise(frame).alias("frame")), folder)
    got = frames.read_log(spark, f"{folder}/*.log")
    return got.select(F.regexp_extract("path", r"([^/]+)\.log$", 1).alias("log"), "pos", F.col("key").cast("string").alias("key"), "seq", "op", F.col("value").cast("string").alias("value"))


@query("select cast(c_nationkey as varchar) as run_id, row_number() over (partition by c_nationkey order by c_name, c_custkey desc) - 1 as pos, c_name as key, c_custkey as seq, 1 as op, c_mktsegment as value from customer")
def run_files_read(spark, sf_dir):
    """Runs written as files with their filter, index, key range and footer, and read back."""
    folder = _folder(spark, "runs")
    frames.write_run_files(_customer_runs(spark, sf_dir), folder)
    got = frames.read_run_files(spark, f"{folder}/*.run")
    return got.select(F.regexp_extract("path", r"([^/]+)\.run$", 1).alias("run_id"), "pos", F.col("key").cast("string").alias("key"), "seq", "op", F.col("value").cast("string").alias("value"))


# Placement

NODES = "with node as (select n_nationkey as ordinal, n_name as node from nation), tok as (select ordinal, node, i, " + CRC_SQL.format(c="(node || ':' || i)") + " as token from node, (select unnest(range(8)) as i)), ring as (select token, arg_max(node, ordinal * 100 + i) as node from tok group by token)"


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.ring(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"), F.col("n_nationkey").alias("ordinal")), 8)


@query(NODES + " select token, node from ring")
def ring_tokens(spark, sf_dir):
    return _ring(spark, sf_dir)


ROUTED = NODES + ", k as (select c_custkey, c_name, " + CRC_SQL.format(c="c_name") + " as hash from customer), up as (select k.c_custkey, k.hash, min(r.token) as token from k left join ring r on r.token >= k.hash group by 1, 2), routed as (select c_custkey, hash, r.node from up join ring r on r.token = coalesce(up.token, (select min(token) from ring)))"


@query(ROUTED + " select c_custkey, hash, node from routed")
def ring_route(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return placement.route(c, _ring(spark, sf_dir), "c_name").select("c_custkey", "hash", "node")


@query(ROUTED + " select node, count(*) as keys, cast(sum(octet_length(encode(c_name))) as bigint) as bytes, count(*) * (count(*) over ()) / (sum(count(*)) over ()) as skew from routed join customer using (c_custkey) group by node")
def shard_balance(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").withColumn("bytes_", F.octet_length("c_name"))
    return placement.balance(placement.route(c, _ring(spark, sf_dir), "c_name"), "bytes_")


# Wire

REQUEST = "req as (select event_id as pos, case event_type when 'error' then 3 when 'click' then 2 when 'purchase' then 2 else 1 end as op, cast(user_id as varchar) as key, event_type as value from events)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", 3).when(F.col("event_type").isin("click", "purchase"), 2).otherwise(1)
    return e.select(F.col("event_id").alias("pos"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"))


@query(f"with {REQUEST} select pos, printf('%08X', 2 + octet_length(encode(key)) + octet_length(encode(value))) || printf('%02X', op) || printf('%04X', octet_length(encode(key))) || hex(encode(key)) || hex(encode(value)) as frame from req")
def wire_request_encode(spark, sf_dir):
    return _requests(spark, sf_dir).select("pos", F.hex(codec.encode_request(F.col("op"), F.col("key"), F.col("value"))).alias("frame"))


@query(f"with {REQUEST} select pos, 'ok' as status, op, key, value from req")
def wire_request_decode(spark, sf_dir):
    r = _requests(spark, sf_dir)
    got = r.select("pos", codec.decode_request(codec.encode_request(F.col("op"), F.col("key"), F.col("value"))).alias("d"))
    return got.select("pos", "d.status", "d.op", F.col("d.key").cast("string").alias("key"), F.col("d.value").cast("string").alias("value"))


BAD = "case pos % 5 when 0 then 'ok' when 1 then 'short' when 2 then 'too_large' when 3 then 'bad_key_length' else 'short' end"


@query(f"with {REQUEST} select pos, {BAD} as status, case when pos % 5 = 0 then op else -1 end as op, case when pos % 5 = 0 then key end as key, case when pos % 5 = 0 then value end as value from req")
def wire_request_errors(spark, sf_dir):
    """Frames that are whole, cut off in the value, of a size above the cap, with a key longer than the frame, cut off in the head."""
    r = _requests(spark, sf_dir)
    good, kind = codec.encode_request(F.col("op"), F.col("key"), F.col("value")), F.col("pos") % 5
    rest = lambda at: F.substring(good, F.lit(at), F.octet_length(good))
    frame = (
        F.when(kind == 0, good)
        .when(kind == 1, F.substring(good, F.lit(1), F.octet_length(good) - 1))
        .when(kind == 2, F.concat(codec.big_endian(F.lit(codec.MAX_PAYLOAD + 1), 4), rest(5)))
        .when(kind == 3, F.concat(F.substring(good, 1, 5), codec.big_endian(F.octet_length(good), 2), rest(8)))
        .otherwise(F.substring(good, 1, 6))
    )
    got = r.select("pos", codec.decode_request(frame).alias("d"))
    return got.select("pos", "d.status", F.coalesce("d.op", F.lit(-1)).alias("op"), F.col("d.key").cast("string").alias("key"), F.col("d.value").cast("string").alias("value"))


@query(f"with {REQUEST} select pos, printf('%08X', 1 + case pos % 3 when 0 then octet_length(encode(value)) else 0 end) || printf('%02X', pos % 3) || case pos % 3 when 0 then hex(encode(value)) else '' end as frame from req")
def wire_response_statuses(spark, sf_dir):
    """Answers that are found, not found and failed; only the first has a value."""
    status = (F.col("pos") % 3).cast("int")
    return _requests(spark, sf_dir).select("pos", F.hex(codec.encode_response(status, F.when(status == 0, F.col("value")))).alias("frame"))


@query(ROUTED + ", r as (select node, o_orderstatus = 'F' as del from routed join orders on o_custkey = c_custkey) select node, count(*) as requests, count(*) filter (where del) as deletes from r group by node")
def gateway_requests(spark, sf_dir):
    """What a gateway sends each shard of the requests for customers' orders."""
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    sent = Sharded(_ring(spark, sf_dir)).route(c.join(o, c.c_custkey == o.o_custkey).select("c_name", "o_orderstatus"), "c_name")
    return sent.groupBy("node").agg(F.count("*").alias("requests"), F.count_if(F.col("o_orderstatus") == "F").alias("deletes"))


@query(f"""with {REQUEST}, w as (select * from req where op <> 1), g as (select r.pos, w.op as wop, w.value, row_number() over (partition by r.pos order by w.pos desc) as rn from req r left join w on w.key = r.key and w.pos < r.pos where r.op = 1)
    select pos, case when wop = 2 then 0 else 1 end as status, case when wop = 2 then value end as value from g where rn = 1 union all select pos, 0, null from w""")
def wire_dispatch(spark, sf_dir):
    r = _requests(spark, sf_dir)
    w = r.where(F.col("op") != codec.GET_REQUEST)
    log = changelog.changelog(w, F.col("key"), F.col("pos"), F.col("value"), F.col("op") == codec.DELETE_REQUEST)
    read = snapshot.multi_get(log, r.where(F.col("op") == codec.GET_REQUEST).select("key", (F.col("pos") - 1).alias("at"), "pos"), width=4096)
    answers = read.select("pos", F.when(F.col("found"), 0).otherwise(1).alias("status"), "value")
    return answers.union(w.select("pos", F.lit(0).alias("status"), F.lit(None).cast("string").alias("value")))


@query(f"with {REQUEST} select pos, printf('%08X', 1 + octet_length(encode(value))) || '00' || hex(encode(value)) as frame from req")
def wire_response_encode(spark, sf_dir):
    return _requests(spark, sf_dir).select("pos", F.hex(codec.encode_response(F.lit(0), F.col("value"))).alias("frame"))


# Replicated logs: each nation is a replica of its region's group; what it has is set by its customers.

REPLICA = 'progress as (select n_regionkey as "group", n_name as peer, count(*) as match_index from nation join customer on c_nationkey = n_nationkey group by 1, 2)'


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    return n.join(c, n.n_nationkey == c.c_nationkey).groupBy(F.col("n_regionkey").alias("group"), F.col("n_name").alias("peer")).agg(F.count("*").alias("match_index"))


@query(f'with {REPLICA} select "group", list_sort(list(match_index))[(count(*) - 1) // 2 + 1] as quorum_index from progress group by 1')
def quorum_index(spark, sf_dir):
    return replication.quorum_index(_progress(spark, sf_dir))


@query(f"""with {REPLICA}, q as (select "group", list_sort(list(match_index))[(count(*) - 1) // 2 + 1] as qi from progress group by 1), entry as (select "group", i as "index", case when i < 30 then 1 else 2 end as term from q, (select unnest(range(1, 2000)) as i))
    select q."group", case when qi > 5 and term = 2 then qi else 5 end as commit_index from q left join entry e on e."group" = q."group" and e."index" = qi""")
def commit_index(spark, sf_dir):
    p = _progress(spark, sf_dir)
    groups = p.select("group").distinct()
    log = groups.select("group", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(1999).cast("long"))).alias("index")).withColumn("term", F.when(F.col("index") < 30, 1).otherwise(2))
    return replication.commit_index(p, log, 2, 5)


RLOG = "leader as (select event_id as idx, event_id // 1000 + 1 as term from events), follower as (select replica, e.event_id as idx, e.event_id // 1000 + case when replica * 1300 < e.event_id then 2 else 1 end as term from events e, (select distinct n_nationkey % 7 as replica from nation) where e.event_id <= (select max(event_id) from events) - replica * 100)"


def _replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, sf_dir, "events")
    leader = e.select(F.col("event_id").alias("index"), (F.floor(F.col("event_id") / 1000) + 1).alias("term"), F.col("event_type").alias("command"))
    names = [r.replica for r in _table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 7).alias("replica")).distinct().orderBy("replica").collect()]  # seven at most
    top = e.agg(F.max("event_id")).first()[0] or 0
    rows = leader.select("*", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<int>")).alias("replica")).where(F.col("index") <= top - F.col("replica") * 100)
    follower = rows.withColumn("term", F.floor(F.col("index") / 1000) + F.when(F.col("replica") * 1300 < F.col("index"), 2).otherwise(1))
    return leader, follower.select("replica", "index", "term", "command")


@query(f"with {RLOG} select f.replica, min(case when l.term <> f.term then f.idx end) as first_conflict, (select count(*) from leader) - count(l.idx) as missing from follower f left join leader l on l.idx = f.idx group by 1")
def log_divergence(spark, sf_dir):
    return replication.divergence(*_replicas(spark, sf_dir))


@query(f"""with {RLOG}, cut as (select f.replica, coalesce(min(case when l.term <> f.term then f.idx end), max(f.idx) + 1) as cut from follower f left join leader l on l.idx = f.idx group by 1)
    select replica, idx as "index", term from follower join cut using (replica) where idx < cut union all select replica, idx, term from leader join cut on idx >= cut""")
def follower_logs(spark, sf_dir):
    return replication.follow(*_replicas(spark, sf_dir)).select("replica", "index", "term")


@query(f"with {RLOG}, last as (select max(idx) as top from leader) select 'leader' as replica, idx as \"index\", term from leader union all select 'leader', top + o_orderkey, 99 from orders, last")
def propose(spark, sf_dir):
    leader = _replicas(spark, sf_dir)[0].withColumn("replica", F.lit("leader")).select("replica", "index", "term", "command")
    batch = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("command"))
    last = replication.last_info(leader).first()
    return replication.append(leader, batch, "leader", 99, last.last_index if last else 0).select("replica", "index", "term")


@query(f"with {RLOG} select replica, idx as \"index\", term from follower where idx > 7000")
def log_entries_after(spark, sf_dir):
    return replication.entries_after(_replicas(spark, sf_dir)[1], 7000).select("replica", "index", "term")


@query(f"with {RLOG} select replica, idx as \"index\", term from follower where idx < 3000")
def log_truncate(spark, sf_dir):
    return replication.truncate(_replicas(spark, sf_dir)[1], 3000).select("replica", "index", "term")


@query(f"with {RLOG} select replica, term from follower where idx = 4321")
def term_at(spark, sf_dir):
    return replication.term_at(_replicas(spark, sf_dir)[1], 4321)


@query("select user_id as node, max(event_id // 1000 + 1) as term from events group by 1")
def current_terms(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return replication.current_terms(e.select(F.col("user_id").alias("node"), (F.floor(F.col("event_id") / 1000) + 1).alias("term")))


@query(f"with {RLOG} select replica, max(idx) as last_index, arg_max(term, idx) as last_term from follower group by 1")
def replica_last_info(spark, sf_dir):
    return replication.last_info(_replicas(spark, sf_dir)[1])


@query(f"with {REPLICA}, {RLOG} select peer, idx as \"index\", term from progress join leader on idx >= match_index * 100")
def replica_tail(spark, sf_dir):
    p = _progress(spark, sf_dir).select("peer", (F.col("match_index") * 100).alias("next_index"))
    return replication.replica_tail(_replicas(spark, sf_dir)[0], p).select("peer", "index", "term")


@query(f"with {RLOG}, ends as (select replica, max(idx) as last_index from follower group by 1), req as (select replica, 10 as term, 3 as current_term, replica * 1000 as prev_index, replica + 1 as prev_term, 5000 as leader_commit from ends) select r.replica, r.prev_index, (prev_index = 0 or coalesce(f.term = prev_term, false)) as success, case when prev_index = 0 or coalesce(f.term = prev_term, false) then least(leader_commit, last_index) end as \"commit\" from req r join ends using (replica) left join follower f on f.replica = r.replica and f.idx = r.prev_index")
def append_entries(spark, sf_dir):
    follower = _replicas(spark, sf_dir)[1]
    r = follower.select("replica").distinct()
    req = r.select("replica", F.lit(10).alias("term"), F.lit(3).alias("current_term"), (F.col("replica") * 1000).alias("prev_index"), (F.col("replica") + 1).alias("prev_term"), F.lit(5000).cast("long").alias("leader_commit"))
    return replication.accept_entries(req, follower).select("replica", "prev_index", "success", "commit")


VOTES = f"""{REPLICA}, cand as (select peer as candidate, 7 as term, match_index as last_log_index, match_index % 3 as last_log_term from progress), voter as (select peer as voter, match_index % 5 + 4 as current_term, case when match_index % 2 = 0 then peer end as voted_for, match_index as last_index, match_index % 3 as last_term from progress),
    vote as (select candidate, voter, term >= current_term and (term > current_term or voted_for is null or voted_for = candidate) and (last_log_term > last_term or (last_log_term = last_term and last_log_index >= last_index)) as granted from cand join voter on candidate <> voter)"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, m = _progress(spark, sf_dir), F.col("match_index")
    requests = p.select(F.col("peer").alias("candidate"), F.lit(7).alias("term"), m.alias("last_log_index"), (m % 3).alias("last_log_term"))
    voters = p.select(F.col("peer").alias("voter"), (m % 5 + 4).alias("current_term"), F.when(m % 2 == 0, F.col("peer")).alias("voted_for"), m.alias("last_index"), (m % 3).alias("last_term"))
    return replication.grant_votes(requests, voters)


@query(f"with {VOTES} select candidate, voter, granted from vote")
def vote_grant(spark, sf_dir):
    return _votes(spark, sf_dir).select("candidate", "voter", "granted")


@query(f"with {VOTES} select candidate, count(*) filter (where granted) + 1 as granted, (count(*) + 1) // 2 + 1 as quorum, count(*) filter (where granted) + 1 >= (count(*) + 1) // 2 + 1 as elected from vote group by 1")
def election(spark, sf_dir):
    return replication.elected(_votes(spark, sf_dir))


@query(f"with {RLOG} select idx as \"index\", term from leader where idx > 100 and idx <= 900")
def apply_committed(spark, sf_dir):
    return replication.to_apply(_replicas(spark, sf_dir)[0], 100, 900).select("index", "term")


@query("with b as (select user_id as node, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as new from events), s as (select node, ts, sum(new) over (partition by node order by ts rows unbounded preceding) as k from b) select node, min(ts) as first, max(ts) + interval 1 hour as last, count(*) as beats from s group by node, k")
def heartbeat_sessions(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return replication.silent_spells(e.select(F.col("user_id").alias("node"), F.col("ts").alias("at")), "1 hour")


@query(f"with {LOG} select key, seq, value from ({NEWEST.format(t='top')}) where op = 1")
def stream_latest(spark, sf_dir):
    """The table read as a stream that ends, committed to a store in micro-batches, and what the store then has."""
    schema = _table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(sf_dir + "/events.parquet*")
    log = changelog.changelog(source, F.col("user_id"), F.col("event_id"), F.col("value"), F.col("event_type") == "error")
    folder = _folder(spark, "stream")
    store = Store(spark, f"{folder}/store", value="double", key="long")
    ingest.ingest(log, store, f"{folder}/checkpoint").awaitTermination()
    return Store(spark, f"{folder}/store", value="double", key="long").snapshot()


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted at the end."""
    folder = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    leave(spark, folder)
    return folder


# A store in a folder: orders put in four batches by status and key, tombstones, a compaction, and a reopening.

CYCLE = """put as (select o_custkey as key, o_orderkey, o_totalprice as value, o_orderkey % 4 as b from orders), n as (select *, count(*) over (partition by b) as in_batch from put),
    base as (select b, cast(coalesce(sum(c) over (order by b rows between unbounded preceding and 1 preceding), 0) as bigint) as before from (select b, count(*) as c from put group by b)),
    numbered as (select key, before + row_number() over (partition by b order by o_orderkey) as seq, 1 as op, value from put join base using (b)),
    dead as (select distinct o_custkey as key from orders where o_orderstatus = 'P'),
    log as (select * from numbered union all select key, (select count(*) from put) + row_number() over (order by key) as seq, 0 as op, null as value from dead)"""


def _cycled(spark: SparkSession, sf_dir: str) -> Store:
    o = _table(spark, sf_dir, "orders")
    folder = _folder(spark, "cycle")
    store = Store(spark, folder, value="double", key="long")
    for b in range(4):
        store.put(o.where(F.col("o_orderkey") % 4 == b).select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), "o_orderkey"), ["o_orderkey"])
    store.delete(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")).distinct())
    return Store(spark, folder, value="double", key="long")


def _newest(log: str, upto: str) -> str:
    return f"select key, seq, value from (select *, row_number() over (partition by key order by seq desc) as rn from {log} where seq <= {upto}) where rn = 1 and op = 1"


@query(f"with {CYCLE} {_newest('log', '(select count(*) from put)')}")
def store_reopened(spark, sf_dir):
    """As of the last put, read by a store that was opened anew."""
    store = _cycled(spark, sf_dir)
    gone = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct().count()
    return store.snapshot(store.next_seq() - gone)


@query(f"with {CYCLE}, h as (select before as h from base where b = 2), kept as (select * from log, h where seq > h union all (select key, seq, op, value, h from (select *, row_number() over (partition by key order by seq desc) as rn from log, h where seq <= h) where rn = 1 and op = 1)) select key, seq, op, value from kept")
def store_compacted(spark, sf_dir):
    """All entries after the four oldest runs are merged, with what the first two batches hold as the horizon."""
    store = _cycled(spark, sf_dir)
    horizon = _table(spark, sf_dir, "orders").where("o_orderkey % 4 < 2").count()
    store.compact(horizon)
    store.vacuum()
    return Store(spark, store.folder, value="double", key="long").log().drop("run_id")


@query(f"with {CYCLE}, v as (select distinct b as pos from put union all select 4) select pos, case when pos < 4 then (select before from base where base.b = pos) + (select count(*) from put where put.b = pos) else (select max(seq) from log) end as max_seq from v")
def store_runs(spark, sf_dir):
    """The catalog's live runs by age, with the last number of each."""
    runs_ = _cycled(spark, sf_dir).catalog.runs()
    return spark.createDataFrame([(i, r["max_seq"]) for i, r in enumerate(runs_)], "pos long, max_seq long")
