"""Hierarchy queries over document_elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.operators.hierarchy import descendants, hierarchy
from loamstone.plans.tables import cut, table


def _solved(spark: SparkSession, sf_dir: str, paths: bool) -> DataFrame:
    e = table(spark, sf_dir, "document_elements")
    # links rarely leave a file, so files (in blocks of pages) make good fragments
    locality = F.xxhash64("provenance.source_file", F.floor(F.col("provenance.page") / 64))
    return hierarchy(e, "element_id", "parent_id", "child_ids", locality, paths)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solved(spark, sf_dir, False).where("finding is not null").select(F.col("id").alias("element_id"), "finding")


def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per element: parent, root, depth, path (root first, ' > ' between ids), number of descendants, finding."""
    solved = cut(_solved(spark, sf_dir, True))
    below = descendants(solved).groupBy("ancestor").agg(F.count("*").alias("n"))
    return solved.join(below, solved["id"] == below["ancestor"], "left").select(
        F.col("id").alias("element_id"), F.col("parent").alias("effective_parent"), F.col("root").alias("root_id"), F.col("depth").cast("long").alias("depth"),
        F.array_join("path", " > ").alias("path"), F.when(F.col("path").isNotNull(), F.coalesce("n", F.lit(0))).cast("long").alias("n_descendants"), "finding",
    )


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(_solved(spark, sf_dir, True)).select(F.col("ancestor").alias("element_id"), F.col("id").alias("descendant_id"), F.col("distance").cast("long").alias("distance"))


_EFFECTIVE = """
WITH RECURSIVE own AS (SELECT element_id, min(parent_id) AS parent_id FROM document_elements WHERE element_id IS NOT NULL GROUP BY element_id),
listed AS (SELECT c AS element_id, min(element_id) AS lister FROM (SELECT element_id, unnest(child_ids) AS c FROM document_elements) GROUP BY c),
node AS (SELECT o.element_id, coalesce(o.parent_id, l.lister) AS parent FROM own o LEFT JOIN listed l USING (element_id)),
link AS (SELECT n.element_id, n.parent, p.element_id IS NOT NULL AS inside FROM node n LEFT JOIN own p ON p.element_id = n.parent),
down AS (
  SELECT element_id, element_id AS root, 0 AS depth, [element_id] AS path FROM link WHERE NOT inside
  UNION ALL
  SELECT l.element_id, d.root, d.depth + 1, list_append(d.path, l.element_id) FROM link l JOIN down d ON l.parent = d.element_id WHERE l.inside
),
lost AS (SELECT l.element_id, l.parent FROM link l WHERE l.element_id NOT IN (SELECT element_id FROM down)),
walk AS (
  SELECT element_id AS start, parent AS at FROM lost
  UNION
  SELECT w.start, l.parent FROM walk w JOIN lost l ON l.element_id = w.at
),
finding AS (
  SELECT element_id, CASE WHEN EXISTS (SELECT 1 FROM walk w WHERE w.start = lost.element_id AND w.at = lost.element_id) THEN 'cycle' ELSE 'below_cycle' END AS finding FROM lost
  UNION ALL
  SELECT element_id, 'orphan' FROM link WHERE parent IS NOT NULL AND NOT inside
)
"""

SQL = {
    "p4_found": _EFFECTIVE + "SELECT element_id, finding FROM finding",
    "p4_hierarchy": _EFFECTIVE
    + """, steps AS (SELECT element_id, unnest(path) AS ancestor FROM down),
below AS (SELECT ancestor, count(*) - 1 AS n FROM steps GROUP BY ancestor)
SELECT l.element_id, l.parent AS effective_parent, d.root AS root_id, CAST(d.depth AS BIGINT) AS depth, array_to_string(d.path, ' > ') AS path,
  CAST(b.n AS BIGINT) AS n_descendants, f.finding
FROM link l LEFT JOIN down d USING (element_id) LEFT JOIN below b ON b.ancestor = d.element_id LEFT JOIN finding f ON f.element_id = l.element_id""",
    "p4_descendants": _EFFECTIVE
    + """SELECT ancestor AS element_id, element_id AS descendant_id, CAST(depth - k AS BIGINT) AS distance FROM (
  SELECT element_id, depth, unnest(path) AS ancestor, unnest(range(len(path))) AS k FROM down) WHERE k < depth""",
}

QUERIES = {"p4_found": p4_found, "p4_hierarchy": p4_hierarchy, "p4_descendants": p4_descendants}
