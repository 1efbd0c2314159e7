"""URL filters: expressions of host suffix and path prefix, looked up by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Longest path that a rule may have; it bounds the prefixes a URL is expanded to.
MAX_PATH = 2048
#: Hexadecimal digits of a digest that the rows meet on.
SHORT = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://`` or for null.

    The host is lower-cased in A-Z only, and keeps a user or port it may hold.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def _keyed(df: DataFrame, expression: str) -> DataFrame:
    """The rows with the full digest of the expression and its short prefix."""
    digest = F.sha2(F.col(expression), 256)
    return df.withColumn("digest", digest) \
        .withColumn("short", F.substring("digest", 1, SHORT))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """The rule that decides each URL: (id, host, path, rule, verdict).

    ``rules`` has host, path, verdict.  A rule fits its host and all subdomains
    if the URL's path starts with its own.  The longest rule (host and path
    together) wins; of equally long ones ``block`` wins, then the greater text.
    Without a rule the rule is null and the verdict ``default``.  Null and
    malformed URLs have empty parts, which no rule fits; rules with a null or an
    empty host or a null path are void; other columns are not read; repeated
    rows stay.

    URLs are expanded only to the shapes (labels of the host, characters of the
    path) that occur among the rules, at most 127 by ``MAX_PATH``: that list
    alone reaches the driver.  Distinct parts are judged once, so that many
    copies of one URL meet the rules as one row.
    """
    rules = rules.where("host <> '' AND path IS NOT NULL").select(
        F.lower("host").alias("host"), "path", "verdict")
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"),
                          F.length("path").alias("chars")).distinct().collect()
    if any(s.labels > 127 or s.chars > MAX_PATH for s in shapes):
        raise ValueError(f"a rule has over 127 labels or {MAX_PATH} characters of path")
    host, path = url_parts(F.col(url_col))
    pages = pages.select(id_col, host.alias("host"), path.alias("path"))
    if not shapes:
        return pages.select("*", F.lit(None).cast("string").alias("rule"),
                            F.lit(default).alias("verdict"))

    labels = F.size(F.split("host", r"\."))
    fits = [F.when((labels >= s.labels) & (F.length("path") >= s.chars) & (F.col("host") != ""),
                   F.concat(F.substring_index("host", ".", -s.labels),
                            F.substring("path", 1, s.chars)))
            for s in sorted(shapes)]
    expanded = _keyed(pages.select("host", "path").distinct().select(
        "host", "path", F.explode(F.array_distinct(F.array_compact(F.array(*fits))))
        .alias("expression")), "expression")
    # The greatest verdict of a repeated rule is block, as b follows a.
    listed = _keyed(rules.groupBy(F.concat("host", "path").alias("rule"))
                    .agg(F.max("verdict").alias("verdict")), "rule")
    rank = F.struct(F.length("rule"), F.col("verdict"), F.col("rule"))
    hits = expanded.join(listed.withColumnRenamed("digest", "full"), "short") \
        .where((F.col("digest") == F.col("full")) & (F.col("expression") == F.col("rule")))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    return pages.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
