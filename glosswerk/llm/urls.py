"""URL filters by a path-template tree.

Each host has a tree of path segments.  Numbers and long hexadecimal runs in a segment are wildcards
from the start.  Then, from the root down, the children of a node are merged to the wildcard ``*``
unless the node has one child only or the child's share of good labels differs from its node's
beyond ``z`` standard errors: similar branches become one, a branch that stands out keeps its name.
A node of more than ``max_branch`` children is a variable segment; there a child needs ``far`` as
many standard errors to stand out, as among many some do by chance.

The leaves are templates.  A template's purity is its share of good pages among its labelled ones,
smoothed towards that of all labelled pages as by ``prior`` more of them.  Templates of at least
``min_labelled`` labelled pages and a purity under ``least`` are rejected, with all their pages.

A level of the tree is an aggregation of distinct paths by (host, prefix, segment), and another one of its result
by (host, prefix); both combine before they shuffle and are joined back, so no step needs a host's pages in one place.  Segments beyond ``depth`` are one, ``**``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, id_type, require, stored

DEPTH, MAX_BRANCH, Z, FAR, PRIOR, MIN_LABELLED, LEAST = 6, 16, 2.0, 2.0, 4.0, 5, 0.6

_HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_HEX = "[0-9a-fA-F]{12,}"


def templates(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", depth: int = DEPTH, max_branch: int = MAX_BRANCH, z: float = Z, far: float = FAR, prior: float = PRIOR, min_labelled: int = MIN_LABELLED, least: float = LEAST) -> DataFrame:
    """``(page_id, host, template, pages, labelled, purity, rejected)`` for each row of ``pages``.

    ``labels`` has ``(page_id, good)`` with 0 or 1; NULLs are left out, and of an id's labels the
    least counts.  NULL urls and those without scheme and host have a NULL host and template and
    aren't rejected.  Repeated rows count and are given each.  Without labels nothing is rejected.  Ids keep their type.
    An empty table gives an empty one.  Urls of any length and depth are read whole; other columns are ignored, whatever their names.
    """
    require(pages, id_col, url_col)
    require(labels, "page_id", "good")
    url = col(pages, url_col).cast("string")
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _PATH, 1), _HEX, "{h}"), "[0-9]+", "{n}")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    short = F.when(F.size("segments") > depth, F.concat(F.slice("segments", 1, depth - 1), F.array(F.lit("**")))).otherwise(F.col("segments"))
    mark = (
        labels.select(F.col("page_id").cast(id_type(pages, id_col)).alias("page_id"), (F.col("good").cast("int") > 0).cast("long").alias("good"))
        .where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    )
    rows = stored(
        pages.select(col(pages, id_col).alias("page_id"), F.nullif(host, F.lit("")).alias("host"), segments.alias("segments"))
        .select("page_id", "host", F.when(F.col("host").isNotNull(), short).alias("path"))
        .join(mark, "page_id", "left"),
        "url-pages",
    )
    total = rows.where("host IS NOT NULL").agg(F.count("good").alias("n"), F.sum("good").alias("k")).first()
    overall = total["k"] / total["n"] if total["n"] else 1.0
    sums = [F.sum("labelled").alias("labelled"), F.sum("good").alias("good")]
    tree = rows.where("host IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("pages"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    tree = tree.withColumn("template", F.lit(""))
    tree = stored(tree, "url-tree")
    deepest = min(depth, tree.agg(F.max(F.size("path"))).first()[0] or 0)
    for k in range(deepest):
        segment = F.get("path", F.lit(k))
        tree = tree.withColumn("segment", segment)
        children = tree.where("segment IS NOT NULL").groupBy("host", "template", "segment").agg(*sums)
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("branches"), F.sum("labelled").alias("n"), F.sum("good").alias("k"))
        children = children.join(nodes, ["host", "template"])
        rate = (F.col("k") + F.lit(prior) * F.lit(overall)) / (F.col("n") + F.lit(prior))
        off = F.abs(F.col("good") - F.col("labelled") * rate)
        bound = F.when(F.col("branches") > max_branch, F.lit(z * far)).otherwise(F.lit(z)) * F.sqrt(F.col("labelled") * rate * (F.lit(1.0) - rate))
        own = (F.col("branches") == 1) | ((F.col("labelled") >= min_labelled) & (off > bound))
        named = children.select("host", "template", "segment", F.concat("template", F.lit("/"), F.when(own, F.col("segment")).otherwise(F.lit("*"))).alias("longer"))
        tree = tree.join(named, ["host", "template", "segment"], "left").select("host", "path", "pages", "labelled", "good", F.coalesce("longer", "template").alias("template"))
        tree = stored(tree, "url-tree")
    leaves = tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "good")])
    purity = (F.col("good") + F.lit(prior) * F.lit(overall)) / (F.col("labelled") + F.lit(prior))
    scored = tree.select("host", "path", "template").join(leaves, ["host", "template"]).withColumn("purity", purity)
    return rows.join(scored, ["host", "path"], "left").select(
        "page_id", "host", "template", "pages", "labelled", "purity",
        F.coalesce((F.col("labelled") >= min_labelled) & (F.col("purity") < least), F.lit(False)).alias("rejected"),
    )


def document_labels(labels: DataFrame) -> DataFrame:
    """Labels of pages by those of the documents of the same ids: good are those of quality that aren't toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))


def _levels() -> str:
    text, before = "", "t0"
    for k in range(DEPTH):
        text += f"""
), s{k} AS (
  SELECT *, path[{k + 1}] AS segment FROM {before}
), c{k} AS (
  SELECT host, template, segment, labelled, good, count(*) OVER n AS branches, sum(labelled) OVER n AS n, sum(good) OVER n AS k
  FROM (SELECT host, template, segment, sum(labelled) AS labelled, sum(good) AS good FROM s{k} WHERE segment IS NOT NULL GROUP BY ALL)
  WINDOW n AS (PARTITION BY host, template)
), r{k} AS (
  SELECT *, (k + {PRIOR}::DOUBLE * overall) / (n + {PRIOR}::DOUBLE) AS rate FROM c{k}, whole
), m{k} AS (
  SELECT host, template, segment, template || '/' || CASE WHEN branches = 1 OR (labelled >= {MIN_LABELLED} AND abs(good - labelled * rate)
    > CASE WHEN branches > {MAX_BRANCH} THEN {Z * FAR}::DOUBLE ELSE {Z}::DOUBLE END * sqrt(labelled * rate * (1 - rate))) THEN segment ELSE '*' END AS longer FROM r{k}
), t{k + 1} AS (
  SELECT s.host, s.path, s.pages, s.labelled, s.good, coalesce(m.longer, s.template) AS template FROM s{k} s LEFT JOIN m{k} m USING (host, template, segment)"""
        before = f"t{k + 1}"
    return text


#: The registered query with the parameters above.
ORACLE_SQL = rf"""
WITH marks AS (
  SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id
), parts AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{_HOST}', 1)), '') AS host,
    list_filter(string_split(regexp_replace(regexp_replace(regexp_extract(url, '{_PATH}', 1), '{_HEX}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g'), '/'), lambda x: x <> '') AS p
  FROM pages
), rows AS (
  SELECT page_id, host, CASE WHEN host IS NULL THEN NULL WHEN len(p) > {DEPTH} THEN list_append(p[1:{DEPTH - 1}], '**') ELSE p END AS path, good
  FROM parts LEFT JOIN marks USING (page_id)
), whole AS (
  SELECT sum(good)::DOUBLE / count(good) AS overall FROM rows WHERE host IS NOT NULL
), t0 AS (
  SELECT host, path, count(*) AS pages, count(good) AS labelled, coalesce(sum(good), 0) AS good, '' AS template FROM rows WHERE host IS NOT NULL GROUP BY host, path{_levels()}
), scored AS (
  SELECT host, path, template, sum(pages) OVER l AS pages, sum(labelled) OVER l AS labelled, (sum(good) OVER l + {PRIOR}::DOUBLE * overall) / (sum(labelled) OVER l + {PRIOR}::DOUBLE) AS purity
  FROM t{DEPTH}, whole WINDOW l AS (PARTITION BY host, template)
)
SELECT r.page_id, r.host, s.template, s.pages::BIGINT AS pages, s.labelled::BIGINT AS labelled, s.purity, coalesce(s.labelled >= {MIN_LABELLED} AND s.purity < {LEAST}, false) AS rejected
FROM rows r LEFT JOIN scored s ON r.host = s.host AND r.path = s.path
"""
