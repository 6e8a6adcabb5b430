"""Queries of the general operators for missing references and hierarchies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.operators.hierarchy import descendants, resolve_hierarchy
from lodeseam.operators.orphans import find_orphans, orphan_report, references
from lodeseam.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    index, qa, purge = (table(spark, d, t) for t in ("doc_index", "synthetic_qa", "purge_log"))
    refs = references(index, "doc_index", "id", "parent_id", "created_at").unionByName(references(qa, "synthetic_qa", "id", "chunk_id", "created_at"))
    return find_orphans(
        refs,
        index.select("id", F.col("created_at").alias("at")),
        purge.select(F.col("row_id").alias("id"), F.col("purged_at").alias("at")),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("tab", "id", "reason", "period").distinct()


def p1_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def _resolved(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    return resolve_hierarchy(table(spark, d, "doc_index"), paths=paths)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d, paths=False).where("cycle_id is not null").select("id", "cycle_id", "place")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    r = _resolved(spark, d).where("path is not null")
    return r.select("id", "root_id", F.col("depth").cast("bigint").alias("depth"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_resolved(spark, d)).select("ancestor_id", "id", F.col("distance").cast("bigint").alias("distance"))


_BAD = """
with ix as (select distinct id, parent_id, created_at from doc_index where id is not null),
refs as (select 'doc_index' tab, id, parent_id ref, created_at from ix where parent_id is not null
 union select 'synthetic_qa', id, chunk_id, created_at from synthetic_qa where chunk_id is not null),
tgt as (select id, min(created_at) target_at from ix group by id),
pur as (select row_id, max(purged_at) purged_at from purge_log where row_id is not null group by row_id),
j as (select r.*, t.id tid, t.target_at, p.row_id pid, p.purged_at from refs r left join tgt t on r.ref = t.id left join pur p on r.ref = p.row_id),
bad as (select tab, id, ref, case when (tid is null and pid is not null) or (tid is not null and purged_at >= target_at) then 'deleted'
  when tid is null then 'missing' when target_at > created_at then 'late' end reason,
  coalesce(strftime(created_at, '%Y-%m'), 'none') period from j)
"""
_TREE = """
with recursive n as (select id, min(parent_id) up from doc_index where id is not null group by id),
r as (select n.id, n.id root_id, 0::bigint depth, n.id::varchar path from n left join n p on n.up = p.id where p.id is null
 union all select n.id, r.root_id, r.depth + 1, r.path || '/' || n.id from r join n on n.up = r.id)
"""
_CYCLE = """
with recursive n as (select id, min(parent_id) up from doc_index where id is not null group by id),
ok as (select n.id from n left join n p on n.up = p.id where p.id is null union all select n.id from ok join n on n.up = ok.id),
lost as (select id, up from n where id not in (select id from ok)),
w as (select id start, up cur from lost union select w.start, l.up from w join lost l on w.cur = l.id),
ring as (select distinct start id from w where start = cur),
cyc as (select r.id, min(w.cur) cycle_id from ring r join w on w.start = r.id group by r.id)
select l.id, min(c.cycle_id) cycle_id, case when l.id in (select id from ring) then 'on' else 'below' end place
from lost l join w on w.start = l.id join cyc c on c.id = w.cur group by l.id
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_orphan_counts": p1_orphan_counts,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
}

SQL = {
    "p1_found": _BAD + "select distinct tab, id, reason, period from bad where reason is not null",
    "p1_orphan_counts": _BAD + "select tab, reason, period, count(*) n_refs, count(distinct ref) n_keys from bad where reason is not null group by all",
    "p3_found": _CYCLE,
    "p3_paths": _TREE + "select id, root_id, depth, path from r",
    "p3_descendants": _TREE + ", up as (select id, depth, unnest(string_split(path, '/'))::bigint ancestor_id, generate_subscripts(string_split(path, '/'), 1) i from r) "
    "select ancestor_id, id, (depth - i + 1)::bigint distance from up where ancestor_id <> id",
}
