"""URL filter by a tree of path templates per host.

Level by level, the children of a node are merged into one wildcard branch when they vary (a digit, or few pages) or
when the share of blocked pages among their labelled pages does not differ from that of their siblings.  A template is
rejected when its smoothed purity, (blocked + 1) / (labelled + 2), reaches the threshold.  Labels are the pages that a
rule decides, so a template without labelled pages stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.session import written

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEPTH = 6  # segments that get a level of their own; what is deeper shares one wildcard
SUPPORT = 4  # pages that a branch of its own has
DIFFERS = 2.0  # standard errors by which the blocked share of a branch of its own differs
PURITY = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for every page.

    A null url, or one without ``://``, has an empty host and path and shares the template of that empty host.  Repeated
    rows count as often as they occur; other columns are ignored.
    """
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = rows.withColumns({"segs": segments, "node": F.col("host"), "labelled": F.col("r").isNotNull().cast("long"),
                             "blocked": F.coalesce((F.col("r.verdict") == "block").cast("long"), F.lit(0).cast("long"))})
    rows = written(rows, "url-pages")
    levels = rows.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in range(min(levels, DEPTH)):
        seg = F.get("segs", F.lit(d))
        at = rows.withColumn("seg", F.when(seg.rlike("[0-9]"), "*").otherwise(seg))
        kids = at.where("seg is not null").groupBy("node", "seg").agg(F.count("*").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        sums = kids.groupBy("node").agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
        rest = F.col("all_l") - F.col("l")
        share, other, pooled = F.try_divide("b", "l"), F.try_divide(F.col("all_b") - F.col("b"), rest), F.try_divide("all_b", "all_l")
        # The counts are whole numbers, so the comparison is made without a root: difference^2 against variance.
        like = (F.col("l") > 0) & (rest > 0) & ((share - other) * (share - other) <= DIFFERS * DIFFERS * pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("l")) + F.try_divide(F.lit(1), rest)))
        merged = kids.join(sums, "node").select("node", "seg", F.when((F.col("n") < SUPPORT) | F.coalesce(like, F.lit(False)), "*").otherwise(F.col("seg")).alias("arc"))
        rows = at.join(merged, ["node", "seg"], "left").withColumn("node", F.when(F.col("seg").isNull(), F.col("node")).otherwise(F.concat_ws("/", "node", "arc"))).drop("seg", "arc")
        rows = written(rows, "url-level")
    rows = rows.withColumn("node", F.when(F.size("segs") > DEPTH, F.concat("node", F.lit("/**"))).otherwise(F.col("node")))
    purity = rows.groupBy("node").agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("purity"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return rows.join(purity, "node").select(F.col("key").alias(key), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"),
                                            F.col("node").alias("template"), "purity")


def twin_sql() -> str:
    """The same in DuckDB SQL, one pair of steps per level."""
    rule = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}|{h}{p}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    steps = [f"""p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path FROM pages)""",
             f"q AS (SELECT *, {rule} AS r FROM p)",
             """u0 AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, host AS node,
  (r IS NOT NULL)::INT AS l, coalesce(starts_with(r, 'block'), false)::INT AS b FROM q)"""]
    for d in range(DEPTH):
        steps.append(f"""a{d} AS (SELECT *, CASE WHEN regexp_matches(segs[{d + 1}], '[0-9]') THEN '*' ELSE segs[{d + 1}] END AS seg FROM u{d})""")
        steps.append(f"""k{d} AS (SELECT node, seg, count(*) AS n, sum(l) AS l, sum(b) AS b FROM a{d} WHERE seg IS NOT NULL GROUP BY 1, 2)""")
        steps.append(f"""m{d} AS (SELECT node, seg, CASE WHEN n < {SUPPORT} OR (l > 0 AND al > l AND
  (b/l - (ab-b)/(al-l)) * (b/l - (ab-b)/(al-l)) <= {DIFFERS * DIFFERS} * (ab/al) * (1 - ab/al) * (1/l + 1/(al-l))) THEN '*' ELSE seg END AS arc
  FROM (SELECT *, sum(l) OVER w AS al, sum(b) OVER w AS ab FROM k{d} WINDOW w AS (PARTITION BY node)))""")
        steps.append(f"""u{d + 1} AS (SELECT a.page_id, host, path, r, segs, l, b, CASE WHEN a.seg IS NULL THEN a.node ELSE a.node || '/' || arc END AS node
  FROM a{d} a LEFT JOIN m{d} m ON a.node = m.node AND a.seg = m.seg)""")
    steps.append(f"""t AS (SELECT * REPLACE (CASE WHEN len(segs) > {DEPTH} THEN node || '/**' ELSE node END AS node) FROM u{DEPTH})""")
    steps.append("v AS (SELECT *, (sum(b) OVER (PARTITION BY node) + 1) / (sum(l) OVER (PARTITION BY node) + 2) AS purity FROM t)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT page_id, host, path, nullif(split_part(coalesce(r, ''), '|', 2), '') AS rule,
  CASE WHEN r IS NOT NULL THEN split_part(r, '|', 1) WHEN purity >= {PURITY} THEN 'block' ELSE 'allow' END AS verdict, node AS template, purity FROM v"""
