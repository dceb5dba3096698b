"""Cross-site boilerplate removal by the number of distinct sites that carry a line.

Lines seen on at least two sites get a HyperLogLog sketch of their sites,
merged by aggregation; only lines whose estimate is near the threshold get an
exact distinct count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage_table

_SPACES = " \t\n\x0b\x0c\r"


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, row (the text's hash), line_no, h, site of each line with a word; lines are compared without outer white space."""
    site = F.xxhash64(F.coalesce("site", F.lit("\0null")))
    lines = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("row"), site.alias("site"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.trim("line", F.lit(_SPACES))).filter("line <> ''").select("doc_id", "row", "line_no", F.xxhash64("line").alias("h"), "site")


def spread_lines(spark: SparkSession, occ: DataFrame, min_sites: int, lg_k: int = 12, band: float = 0.25) -> DataFrame:
    """h, keep_doc, keep_line, keep_row, of written occurrences ``occ``: lines on at least ``min_sites`` sites and their first occurrence.

    The sketch's error at lg_k = 12 is 1.6 %, so an estimate outside the band of
    25 % decides, and inside it sites are counted exactly.
    """
    many = occ.groupBy("h").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.min(F.struct("doc_id", "line_no", "row")).alias("first")).filter("lo <> hi").select("h", "first")
    many = stage_table(spark, many, "lines")
    seen = occ.join(many.select("h"), "h", "left_semi").select("h", "site")
    sketched = seen.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    sketched = stage_table(spark, sketched.filter(F.col("sites") >= min_sites * (1 - band)), "spread")
    sure = sketched.filter(F.col("sites") > min_sites * (1 + band)).select("h")
    near = sketched.filter(F.col("sites") <= min_sites * (1 + band)).select("h")
    exact = seen.join(near, "h", "left_semi").distinct().groupBy("h").count().filter(F.col("count") >= min_sites).select("h")
    spread = many.join(sure.union(exact), "h", "left_semi")
    return stage_table(spark, spread.select("h", F.col("first.doc_id").alias("keep_doc"), F.col("first.line_no").alias("keep_line"), F.col("first.row").alias("keep_row")), "boilerplate")


def remove_boilerplate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10) -> DataFrame:
    """All columns of ``docs``, ``text`` without boilerplate lines, and n_lines, n_removed.

    A line on at least ``min_sites`` sites stays at its first occurrence only
    (smallest id, then line number, then the text's hash; a null id comes first). Rows are never
    dropped: a text may end up empty. A null text stays null, with no lines; a
    null site is a site of its own. Rows of the same id and text are
    treated alike, those that share an id only are rows of their own. An empty table gives an empty result.
    A very long text is one row of an array of its lines. Lines are compared by 64-bit hashes.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site"))
    occ = stage_table(spark, occurrences(given), "occurrences")
    spread = spread_lines(spark, occ, min_sites)
    gone = occ.join(spread, "h").filter(~(F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("line_no") == F.col("keep_line")) & (F.col("row") == F.col("keep_row"))))
    # Names no table of the caller's can have.
    own = {k: f"{k}_{uuid.uuid4().hex}" for k in ("id", "row", "gone", "text", "lines", "removed")}
    gone = gone.groupBy(F.col("doc_id").alias(own["id"]), F.col("row").alias(own["row"])).agg(F.collect_set("line_no").alias(own["gone"]))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone[own["id"]]) & (F.xxhash64(docs[text_col]) == gone[own["row"]]), "left")
    lines, hit = F.split(docs[text_col], "\n"), F.col(own["gone"])
    left = F.array_join(F.filter(lines, lambda _, i: ~F.coalesce(F.array_contains(hit, i), F.lit(False))), "\n")
    worded = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    keep = [F.when(hit.isNull(), docs[text_col]).otherwise(left).alias(text_col) if c == text_col else docs[c] for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*keep, count(F.when(docs[text_col].isNotNull(), worded)).alias("n_lines"), count(F.when(hit.isNotNull(), F.size(hit))).alias("n_removed"))


SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents
), lines AS (
  SELECT rid, doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM rows WHERE text IS NOT NULL
), trimmed AS (
  SELECT rid, doc_id, coalesce(source, chr(1)) AS site, md5(text) AS h, raw, line_no, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM lines
), spread AS (
  SELECT line, min({'known': doc_id IS NOT NULL, 'd': coalesce(doc_id, 0), 'n': line_no, 'h': h}) AS first FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10
), marked AS (
  SELECT t.*, s.line IS NOT NULL AND {'known': doc_id IS NOT NULL, 'd': coalesce(doc_id, 0), 'n': line_no, 'h': h} <> s.first AS gone FROM trimmed t LEFT JOIN spread s ON t.line = s.line
), joined AS (
  SELECT rid, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY rid
)
SELECT d.doc_id, CAST(coalesce(j.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(j.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(length(j.text) AS BIGINT) AS left_chars, md5(j.text) AS left_md5
FROM rows d LEFT JOIN joined j ON d.rid = j.rid
"""
