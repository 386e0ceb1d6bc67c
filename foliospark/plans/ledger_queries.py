"""Registered queries of the ledger, library and event relations, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.operators import ledger as L
from foliospark.sources import tables as S

R = S.RESOURCES_SQL
COUNTS = "count(*) pages, count(*) filter (status = 'done') done, count(*) filter (status = 'failed') failed"
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"select task_id, {COUNTS} from {R} group by 1")
def chapter_page_counts(spark, d):
    return L.page_counts(S.resources(spark, d), "task_id")


@query(f"select count(*) filter (status = 'done') done, count(*) filter (status = 'failed') failed, count(*) total from {R}")
def task_status_counts(spark, d):
    return S.resources(spark, d).agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))


@query(f"""select task_id, count(*) pages, count(*) filter (status = 'done') done,
  case when count(*) filter (status in ('pending', 'downloading')) > 0 then null when count(*) filter (status = 'done') = count(*) then 'done'
  when count(*) filter (status = 'done') > 0 then 'partial' else 'failed' end finish from {R} group by 1""")
def task_finish_status(spark, d):
    return L.finish_status(S.resources(spark, d))


@query(f"select *, case when failed > 0 then 'failed' else 'done' end status from (select task_id, {COUNTS} from {R} group by 1) where done + failed = pages")
def settled_chapters(spark, d):
    return L.settled_chapters(S.resources(spark, d))


@query(f"""select o_orderkey task_id, o_custkey source_id, page, size, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey, page) place
  from {R} r join orders on o_orderkey = task_id where r.status = 'done'""")
def done_chapters_join(spark, d):
    done = S.resources(spark, d).where("status = 'done'").drop("status")
    met = done.join(S.tasks(spark, d).drop("status"), "task_id")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("created_at", "task_id", "page"))
    return met.select("task_id", "source_id", "page", "size", place.alias("place"))


@query(f"""with r as (select o_custkey source_id, page chapter, task_id, row_number() over (partition by o_custkey, page order by o_orderdate desc, o_orderkey desc) k, status
  from {R} r join orders on o_orderkey = task_id),
  w as (select source_id, chapter, task_id, row_number() over (partition by source_id order by chapter) place from r where k = 1 and status = 'done')
  select source_id, chapter, task_id from w where place = chapter""")
def latest_wins_prefix(spark, d):
    rows = S.resources(spark, d).join(S.tasks(spark, d).drop("status"), "task_id").withColumnRenamed("page", "chapter")
    newest = L.latest_wins(rows, ["source_id", "chapter"], F.desc("created_at"), F.desc("task_id")).where("status = 'done'")
    return L.contiguous_prefix(newest, ["source_id"], "chapter").select("source_id", "chapter", "task_id")


@query(f"select task_id, page, 'downloading' status, 1::int attempts from {R} r where status = 'pending' and exists (select 1 from orders where o_orderkey = task_id and o_orderstatus = 'P')")
def claimable_resources(spark, d):
    tasks = S.tasks(spark, d).withColumn("status", F.when(F.col("status") == "P", "running").otherwise(F.col("status")))
    return L.claim(S.resources(spark, d).withColumn("attempts", F.lit(0)), tasks).select("task_id", "page", "status", "attempts")


@query("select n_nationkey, n_name, (select count(*) from customer where c_nationkey = n_nationkey and c_acctbal > 9000) members from nation")
def group_member_counts(spark, d):
    members = S.table(spark, d, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").count()
    nation = S.table(spark, d, "nation")
    return nation.join(members, nation["n_nationkey"] == members["c_nationkey"], "left").select("n_nationkey", "n_name", F.coalesce("count", F.lit(0)).alias("members"))


@query("select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey")
def group_membership(spark, d):
    nation, customer = S.table(spark, d, "nation"), S.table(spark, d, "customer")
    return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", "n_name")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def orphan_ids(spark, d):
    orders, li = S.table(spark, d, "orders").select("o_orderkey"), S.table(spark, d, "lineitem").select("l_orderkey")
    return orders.join(li, orders["o_orderkey"] == li["l_orderkey"], "left_anti")


@query("select c_custkey, o_orderkey first_missing from (select o_custkey c_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) k from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)) where k = 1")
def first_missing_per_request(spark, d):
    orders, li = S.table(spark, d, "orders"), S.table(spark, d, "lineitem").select("l_orderkey")
    gone = orders.join(li, orders["o_orderkey"] == li["l_orderkey"], "left_anti")
    return gone.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_missing"))


@query("""select p_partkey, p_name, f.n follows, s_name from part left join (select l_partkey, count(*) n from lineitem where l_quantity > 45 group by 1) f on l_partkey = p_partkey
  left join supplier on s_suppkey = p_partkey""")
def library_left_joins(spark, d):
    part, supplier = S.table(spark, d, "part"), S.table(spark, d, "supplier")
    follows = S.table(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.count("*").alias("follows"))
    met = part.join(follows, part["p_partkey"] == follows["l_partkey"], "left").join(supplier, part["p_partkey"] == supplier["s_suppkey"], "left")
    return met.select("p_partkey", "p_name", "follows", "s_name")


@query("select p_partkey, p_name, p_brand from part where lower(p_name) like '%1%e%' or lower(p_brand) like '%#1_%'")
def library_search(spark, d):
    name, brand = F.lower("p_name"), F.lower("p_brand")
    return S.table(spark, d, "part").where(name.like("%1%e%") | brand.like("%#1_%")).select("p_partkey", "p_name", "p_brand")


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k <= 50")
def recent_history_top50(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return S.table(spark, d, "events").withColumn("k", k).where("k <= 50").select("user_id", "event_id")


@query("select user_id, max_by(event_id, ts) event_id, max(ts) ts from events group by 1")
def latest_event_per_job(spark, d):
    return S.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("select event_id, user_id, event_type from events where event_id > 5000 order by event_id")
def event_resume(spark, d):
    return S.table(spark, d, "events").where("event_id > 5000").select("event_id", "user_id", "event_type").orderBy("event_id")


@query("""select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) p from events) where p is distinct from event_type""")
def progress_change_feed(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return S.table(spark, d, "events").withColumn("p", before).where(~F.col("p").eqNullSafe(F.col("event_type"))).select("event_id", "user_id", "event_type")


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) seq from events")
def event_sequence(spark, d):
    return S.table(spark, d, "events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))


@query("select user_id, case when bool_or(event_type = 'purchase') then 'active' when bool_and(event_type = 'view') then 'done' else 'idle' end queue from events group by 1")
def queue_status(spark, d):
    status = F.when(F.bool_or(F.col("event_type") == "purchase"), "active").when(F.bool_and(F.col("event_type") == "view"), "done").otherwise("idle")
    return S.table(spark, d, "events").groupBy("user_id").agg(status.alias("queue"))


@query("select o_orderkey task_id, sha256(concat('{\"options\":{\"status\":\"', o_orderstatus, '\"},\"source\":', o_custkey, '}')) identity from orders")
def task_identity_hash(spark, d):
    o = S.table(spark, d, "orders")
    key = F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("options"), F.col("o_custkey").alias("source")))
    return o.select(F.col("o_orderkey").alias("task_id"), F.sha2(key, 256).alias("identity"))


@query("""select doc_id, digest, first_doc from (select doc_id, sha256(text) digest, min(doc_id) over (partition by sha256(text)) first_doc, count(*) over (partition by sha256(text)) n from documents) where n > 1""")
def hash_duplicates(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    groups = docs.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    return docs.join(groups, "digest").select("doc_id", "digest", "first_doc")


@query("select c_custkey book_id, greatest(0, count(o_orderkey) filter (o_orderstatus = 'O') - count(o_orderkey) filter (o_orderstatus = 'F'))::bigint updates from customer left join orders on o_custkey = c_custkey group by 1")
def follow_updates(spark, d):
    customer, o = S.table(spark, d, "customer").select("c_custkey"), S.table(spark, d, "orders")
    n = o.groupBy("o_custkey").agg((F.count_if(F.col("o_orderstatus") == "O") - F.count_if(F.col("o_orderstatus") == "F")).alias("n"))
    return customer.join(n, customer["c_custkey"] == n["o_custkey"], "left").select(F.col("c_custkey").alias("book_id"), F.greatest(F.lit(0), F.coalesce("n", F.lit(0))).cast("long").alias("updates"))


@query("""with n as (select c_custkey id, c_acctbal v from customer), u as (select o_custkey id, max(o_totalprice) v from orders where o_orderstatus = 'P' group by 1)
  select coalesce(u.id, n.id) id, coalesce(u.v, n.v) v from n full join u using (id)""")
def merge_upsert(spark, d):
    old = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    new = S.table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v"))
    return L.merge(old, new, ["id"])


@query("""with t as (select o_orderkey k, 'old' origin from orders where o_orderstatus = 'F') select * from t union all select distinct l_orderkey, 'new' from lineitem where l_orderkey not in (select k from t)""")
def insert_if_absent(spark, d):
    old = S.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("old").alias("origin"))
    new = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("new").alias("origin"))
    return L.insert_absent(old, new, ["k"])


@query(f"""select task_id, page, lpad(page::varchar, greatest(length(max(page) over (partition by task_id)::varchar), 3)::int, '0') label,
  (sum(size) over (partition by task_id order by page))::bigint upto from {R}""")
def page_labels(spark, d):
    w = Window.partitionBy("task_id")
    width = F.greatest(F.length(F.max("page").over(w).cast("string")), F.lit(3))
    return S.resources(spark, d).select("task_id", "page", F.lpad(F.col("page").cast("string"), width, F.lit("0")).alias("label"), F.sum("size").over(w.orderBy("page")).alias("upto"))


@query(f"select page, count(*) n, sum(size)::bigint bytes, sum(size)::bigint // count(*) mean from (select *, row_number() over (partition by task_id order by page) k from {R}) where k <= 3 group by 1")
def size_estimate(spark, d):
    k = F.row_number().over(Window.partitionBy("task_id").orderBy("page"))
    s = S.resources(spark, d).withColumn("k", k).where("k <= 3").groupBy("page").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return s.select("page", "n", "bytes", F.expr("bytes div n").alias("mean"))


@query(f"select task_id, page, coalesce(nullif(status, 'pending'), 'cancelled') outcome from {R}")
def cancel_salvage(spark, d):
    return S.resources(spark, d).select("task_id", "page", F.coalesce(F.nullif("status", F.lit("pending")), F.lit("cancelled")).alias("outcome"))
