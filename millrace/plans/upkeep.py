"""Queries of upkeep and of published points, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import upkeep as U
from millrace.plans.registry import query
from millrace.plans.rules import Rows
from millrace.sources import snapshots
from millrace.sources.tables import scratch_folder, table

#: Orders pass for prune plans, with some counts of zero or null.
ESTIMATES = Rows(
    "orders",
    plan="o_orderkey",
    vector_points="o_orderkey % 3",
    artifacts="CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 END",
    graph_nodes="o_custkey % 2",
    graph_edges="o_custkey % 3",
    memory_records="0",
    ledger_generations="o_orderkey % 4",
    jobs="CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END",
    cache_entries="o_custkey % 5",
)
_STEPS = f"SELECT plan, rank, target, n::BIGINT AS estimated FROM (SELECT plan, unnest([0, 1, 2, 4, 5, 6]) AS rank, unnest(['vector', 'artifact', 'graph', 'ledger', 'job_retention', 'cache']) AS target, unnest([vector_points, coalesce(artifacts, 0), graph_nodes + graph_edges, ledger_generations, jobs, cache_entries]) AS n FROM {ESTIMATES.sql}) WHERE n > 0"


@query(_STEPS)
def prune_plans(spark, d):
    return U.prune_steps(ESTIMATES.frame(spark, d), "plan")


@query(f"""WITH s AS (SELECT *, (plan + rank) % 11 = 0 AS failed, CASE WHEN plan % 13 = 0 THEN 'admin_required' WHEN plan % 17 = 3 THEN 'fence_check_failed' END AS denied FROM ({_STEPS})),
b AS (SELECT *, coalesce(max(failed::INT) OVER (PARTITION BY plan ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND target = 'ledger' AS blocked FROM s),
o AS (SELECT plan, estimated, CASE WHEN denied IS NOT NULL THEN denied WHEN blocked THEN 'skipped' WHEN failed THEN 'failed' ELSE 'completed' END AS status FROM b)
SELECT plan, coalesce(max(status) FILTER (WHERE status IN ('admin_required', 'fence_check_failed')), CASE WHEN bool_or(status = 'failed') AND bool_or(status = 'completed') THEN 'completed_degraded' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'completed' END) AS status,
 sum(CASE WHEN status = 'completed' THEN estimated ELSE 0 END)::BIGINT AS deleted, sum(CASE WHEN status IN ('failed', 'skipped') THEN estimated ELSE 0 END)::BIGINT AS debt FROM o GROUP BY plan""")
def prune_results(spark, d):
    """Plans prune the generation that is their number modulo 17, while the third is current."""
    steps = U.prune_steps(ESTIMATES.frame(spark, d), "plan")
    plan = F.col("plan")
    done = U.prune_outcomes(steps, "plan", F.lit(3), plan % 17, plan % 13 != 0, (plan + F.col("rank")) % 11 == 0)
    return U.plan_status(done, "plan")


#: Pages of two runs: validators of the last one, and what this one saw.
_OLD = Rows("customer", "c_custkey % 3 <> 0", url="c_custkey", etag="CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('e', c_custkey) END", last_modified="'m'", miss_count="c_custkey % 4")
_SEEN = Rows("customer", "c_custkey % 2 = 0", url="c_custkey")
_FRESH = Rows("customer", "c_custkey % 5 <> 0", url="c_custkey", etag="CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('f', c_custkey) END", last_modified="CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'n' END")


@query(f"""SELECT url, CASE WHEN here AND cached THEN e ELSE etag END AS etag, CASE WHEN here AND cached THEN m ELSE last_modified END AS last_modified, CASE WHEN here THEN 0 ELSE miss_count + 1 END AS miss_count
FROM (SELECT coalesce(o.url, f.url) AS url, coalesce(o.url, f.url) % 2 = 0 AS here, f.url IS NOT NULL AS cached, o.*EXCLUDE(url), f.etag AS e, f.last_modified AS m FROM {_OLD.sql} o FULL JOIN (SELECT * FROM {_FRESH.sql} WHERE url % 2 = 0) f ON o.url = f.url)
WHERE NOT (here AND cached AND e IS NULL AND m IS NULL) AND CASE WHEN here THEN 0 ELSE miss_count + 1 END < 3""")
def page_validators(spark, d):
    return U.next_validators(_OLD.frame(spark, d), _SEEN.frame(spark, d), _FRESH.frame(spark, d), 3)


@query("SELECT c_custkey AS url FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 < 3 AND c_custkey % 2 <> 0 AND c_custkey % 7 <> 0")
def page_reconciled(spark, d):
    """The last run's pages with a validator that this run visited (not every seventh) and was not sent again."""
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("url"))
    return U.reconcile_targets(pages, _OLD.frame(spark, d).select("url"), _SEEN.frame(spark, d), pages.where("url % 7 <> 0"), _OLD.frame(spark, d), 3)


_MEMORY = dict(memory_id="c_custkey", body="c_mktsegment", memory_type="CASE WHEN c_custkey % 2 = 0 THEN 'fact' ELSE 'task' END", scope_kind="'project'", scope_value="concat('p', c_nationkey)")
_KEPT = Rows("customer", "c_custkey % 4 = 0", **_MEMORY, status="CASE c_custkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'archived' WHEN 2 THEN 'working' WHEN 3 THEN 'forgotten' ELSE 'review' END")
_COMING = Rows("customer", "c_custkey % 4 <> 0", **_MEMORY | {"body": "CASE WHEN c_custkey % 9 = 0 THEN concat(c_name, c_mktsegment) ELSE c_mktsegment END"}, status="'active'")
_CONTENT = "body, memory_type, scope_kind, scope_value"


@query(f"""WITH j AS (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM {_KEPT.sql} k WHERE (k.body, k.memory_type, k.scope_kind, k.scope_value) = (c.body, c.memory_type, c.scope_kind, c.scope_value)) OR row_number() OVER (PARTITION BY {_CONTENT} ORDER BY memory_id) > 1 THEN 'duplicate' WHEN strlen(body) > 25 THEN 'redaction_failed' ELSE 'created' END AS outcome FROM {_COMING.sql} c),
r AS (SELECT memory_id, {_CONTENT}, status FROM {_KEPT.sql} UNION ALL SELECT memory_id, {_CONTENT}, 'review' FROM j WHERE outcome = 'created')
SELECT memory_id, status, NULL AS outcome FROM r WHERE status NOT IN ('forgotten', 'archived', 'working') UNION ALL SELECT memory_id, NULL, outcome FROM j""")
def memory_import_and_export(spark, d):
    """What an export holds after a merge, and how each record that came in fared."""
    after, outcomes = U.imported(_KEPT.frame(spark, d), _COMING.frame(spark, d), most_bytes=25)
    none = F.lit(None).cast("string")
    return U.exported(after).select("memory_id", "status", none.alias("outcome")).unionByName(outcomes.select("memory_id", none.alias("status"), "outcome"))


@query(f"""WITH s AS (SELECT DISTINCT scope_value FROM {_COMING.sql}) SELECT memory_id, CASE WHEN scope_value IN (SELECT scope_value FROM s) THEN 'archived' ELSE status END AS status FROM {_KEPT.sql} UNION ALL SELECT memory_id, 'review' FROM {_COMING.sql}""")
def memory_import_replaced(spark, d):
    return U.imported(_KEPT.frame(spark, d), _COMING.frame(spark, d), replace_scopes=True)[0].select("memory_id", "status")


_BOUND = "CASE o_orderkey % 7 WHEN 0 THEN concat(o_custkey % 40, 'd') WHEN 1 THEN ' 2w ' WHEN 2 THEN '2024-01-10' WHEN 3 THEN '2024-01-10T00:00:00+02:00' WHEN 4 THEN 'soon' WHEN 5 THEN '' ELSE NULL END"


def _bound(x: str, end: int) -> str:
    """Microseconds of a bound, now being the second of February 2024."""
    now = "epoch_us(TIMESTAMP '2024-02-02')"
    return f"CASE WHEN regexp_matches(trim({x}), '^[0-9]+d$') THEN {now} - regexp_extract({x}, '[0-9]+')::BIGINT * 86400000000 WHEN trim({x}) = '2w' THEN {now} - 14 * 86400000000 WHEN {x} = '2024-01-10' THEN epoch_us(TIMESTAMP '2024-01-10') + {end} WHEN contains({x}, 'T') THEN epoch_us(TIMESTAMP '2024-01-09 22:00:00') END"


@query(f"""WITH b AS (SELECT o_orderkey, {_BOUND} AS a, {_BOUND.replace('o_orderkey % 7', 'o_custkey % 7')} AS z FROM orders), t AS (SELECT *, {_bound('a', 0)} AS low, {_bound('z', 86_399_999_999)} AS high FROM b)
SELECT o_orderkey, low AS since_us, high AS before_us, CASE WHEN a = 'soon' OR z = 'soon' THEN 'invalid temporal bound' WHEN low > high THEN 'since is later than before' END AS fault FROM t""")
def time_bounds(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{_BOUND} AS a", f"{_BOUND.replace('o_orderkey % 7', 'o_custkey % 7')} AS z")
    found = U.bounds(rows, "a", "z", F.lit("2024-02-02T00:00:00Z").cast("timestamp"), ["o_orderkey"])
    return found.select("o_orderkey", F.unix_micros("since_at").alias("since_us"), F.unix_micros("before_at").alias("before_us"), "fault")


@query("SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS text_md5, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS generation FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def published_points(spark, d):
    """Two generations published into the shared folder, the second an upsert of every third document, and what is read back."""
    docs, root = table(spark, d, "documents"), scratch_folder(spark, "points")
    one = docs.where("doc_id % 2 = 0").select("doc_id", "text", F.lit(1).alias("generation"))
    two = docs.where("doc_id % 3 = 0").select("doc_id", F.concat("text", F.lit("!")).alias("text"), F.lit(2).alias("generation"))
    snapshots.publish(one, root, "first", one.count(), key="doc_id")
    snapshots.publish(two, root, "second", two.count(), previous="first", key="doc_id")
    return snapshots.read_points(spark, root).select("doc_id", F.md5("text").alias("text_md5"), "generation")
