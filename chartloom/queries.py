"""Queries over the core operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import flatten, intervals
from chartloom.session import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(
    """
    WITH b AS (SELECT DISTINCT case_id, page_start AS s, page_end AS e FROM toc WHERE page_start <= page_end),
    m AS (SELECT *, max(e) OVER (PARTITION BY case_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
    g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m),
    p AS (SELECT case_id, n, min(s) AS page_start, max(e) AS page_end FROM g GROUP BY case_id, n),
    q AS (SELECT *, lead(page_start) OVER (PARTITION BY case_id ORDER BY n) AS next_start FROM p)
    SELECT case_id, 'period' AS kind, page_start, page_end FROM q
    UNION ALL SELECT case_id, 'gap', page_end + 1, next_start - 1 FROM q WHERE next_start IS NOT NULL
    """
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sweep(table(spark, sf_dir, "toc"), "case_id", "page_start", "page_end")


#: Section, members that hold parents and children, and the child's label.
SECTIONS = {
    "case_metadata": ("filings", "decisions", "level"),
    "mental_rfc_assessment": ("section_1_activities", "activities", "activity"),
    "raw_fields": ("evidence_received", "exhibits", "exhibit_id"),
}
DDE_LISTS = tuple(f"{s}.{p}" for s, (p, _, _) in SECTIONS.items()) + tuple(f"{s}.{p}.{c}" for s, (p, c, _) in SECTIONS.items())


def dde_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of all results, written to the shared folder by tag."""
    path = shared_folder(spark, "dde_tables")
    flatten.write_tables(flatten.emit_once(table(spark, sf_dir, "dde_results"), "dde_id", "result_json", DDE_LISTS, ("raw_fields",)), path)
    return spark.read.schema(f"{flatten.EMITTED.format(id='BIGINT')}").parquet(path)


_P5_SECTION = """
    SELECT dde_id, '{s}' AS section, {at}->'{p}' AS ps, '{c}' AS ck, '{label}' AS lk FROM r
"""


@query(
    """
    WITH r AS (SELECT DISTINCT dde_id, result_json::JSON AS j FROM dde_results WHERE json_valid(result_json) AND json_type(result_json) = 'OBJECT'),
    s AS ("""
    + " UNION ALL ".join(
        _P5_SECTION.format(s=s, p=p, c=c, label=label, at=f"j->'{s}'" if s != "raw_fields" else "(CASE WHEN json_type(j->'raw_fields') = 'VARCHAR' THEN CASE WHEN json_valid(j->>'raw_fields') THEN (j->>'raw_fields')::JSON END ELSE j->'raw_fields' END)")
        for s, (p, c, label) in SECTIONS.items()
    )
    + """),
    a AS (SELECT *, CASE json_type(ps) WHEN 'OBJECT' THEN [ps] WHEN 'ARRAY' THEN ps->'$[*]' END AS pl FROM s),
    b AS (SELECT dde_id, section, ck, lk, pl[i + 1] AS parent, i AS parent_no FROM a, unnest(range(len(pl))) AS t(i)),
    d AS (SELECT *, parent->ck AS cs FROM b WHERE json_type(parent) = 'OBJECT'),
    e AS (SELECT *, CASE json_type(cs) WHEN 'OBJECT' THEN [cs] WHEN 'ARRAY' THEN cs->'$[*]' END AS cl FROM d),
    f AS (SELECT dde_id, section, parent_no, lk, cl[i + 1] AS child, i AS child_no FROM e, unnest(range(len(cl))) AS t(i))
    SELECT dde_id, section, parent_no::INT AS parent_no, child_no::INT AS child_no, child->>lk AS label FROM f WHERE json_type(child) = 'OBJECT'
    """
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, found = dde_tables(spark, sf_dir), None
    for section, (parents, children, label) in SECTIONS.items():
        rows = flatten.table_of(tables, f"{section}.{parents}.{children}", f"`{label}` STRING")
        part = rows.select(F.col("record_id").alias("dde_id"), F.lit(section).alias("section"), F.col("parent_position").alias("parent_no"), F.col("position").alias("child_no"), F.col(label).alias("label"))
        found = part if found is None else found.unionByName(part)
    return found


@query()
def p5_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by tag, the records too deep to be read among them."""
    return dde_tables(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("rows"))
