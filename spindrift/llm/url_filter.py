"""URL filters: host-suffix and path-prefix expressions of each URL, equi-joined on short hash prefixes.

Everything is a DataFrame expression.  A rule is a host and a path; it fits its
host and all subdomains where the URL's path starts with the rule's path.  Of
each URL only the expressions are made whose shape (labels of the host,
characters of the path) some rule has, so neither long hosts nor long paths
multiply rows.  Expressions meet rules on the first 8 hex digits of their
SHA-256; the full digest then confirms, and the longest rule wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """From the first :// to the next / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after(url), "#", 1)).otherwise("")
    return F.coalesce(F.translate(_cut(rest, "/", "?"), _UPPER, _LOWER), F.lit(""))


def path_of(url):
    """From the end of the host up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after(url), "#", 1)).otherwise("")
    host = _cut(rest, "/", "?")
    return F.coalesce(F.substring_index(F.substr(rest, F.length(host) + 1), "?", 1), F.lit(""))


def _after(url):
    return F.substr(url, F.instr(url, "://") + 3)


def _cut(text, *marks):
    return reduce(lambda t, m: F.substring_index(t, m, 1), marks, text)


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of pages, then host, path, rule (host and path in one, else null), verdict.

    rules has host, path and verdict ('allow' or 'block'); hosts are compared
    A-Z lower-cased.  The longest rule (host and path in characters) that fits
    decides; of equal rules with different verdicts 'block' does.  Without a rule
    the verdict is `default`.  A null URL, or one without ://, has an empty host
    and path, which no rule with a host fits.  Rules with a null or empty host or
    null verdict are left out, a null path is an empty one.  Columns of pages
    named host, path, rule or verdict are replaced; repeated rows stay.
    """
    spark = pages.sparkSession
    known = rules.select(F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("r_host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("r_path"), F.col("verdict").cast("string").alias("r_verdict"))
    known = known.where("r_host <> '' and r_verdict is not null").groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    known = known.withColumn("full", _digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("full", 1, SHORT))
    labels = F.size(F.split("r_host", "\\."))
    # one row per shape of rule: hosts have at most 127 labels, so shapes are few however many rules there are
    shapes = sorted((r.labels, r.chars) for r in known.select(labels.alias("labels"), F.length("r_path").alias("chars")).distinct().collect())
    urls = pages.select(F.col(url_col).cast("string").alias("u")).where("u is not null").distinct().select("u", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"))
    expressions = F.filter(
        F.array(
            *[
                F.when(
                    (F.size(F.split("h", "\\.")) >= n) & (F.length("p") >= c),
                    F.struct(F.substring_index("h", ".", -n).alias("eh"), F.substring("p", 1, c).alias("ep")),
                )
                for n, c in shapes
            ]
        )
        if shapes
        else F.expr("cast(array() as array<struct<eh:string,ep:string>>)"),
        lambda e: e.isNotNull(),
    )
    asked = urls.where("h <> ''").select("u", F.explode(expressions).alias("e")).select("u", _digest(F.col("e.eh"), F.col("e.ep")).alias("asked")).withColumn("s", F.substring("asked", 1, SHORT))
    fits = asked.join(known, F.col("s") == F.col("short")).where("asked = full")
    order = F.struct(F.length(F.concat("r_host", "r_path")), F.when(F.col("r_verdict") == "block", 1).otherwise(0), "r_host", "r_path")
    best = fits.groupBy("u").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("best"))
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col(url_col).cast("string")
    joined = pages.select(*rest, host_of(url).alias("host"), path_of(url).alias("path"), url.alias("__url")).join(best, F.col("__url") == F.col("u"), "left")
    return joined.select(*rest, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
