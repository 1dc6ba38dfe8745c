"""URL filter: pattern rules indexed by their rarest literal token.

A rule's literal tokens are the runs of letters and digits that any fitting url must hold whole.
Each rule is filed under the token that the fewest urls of the table hold; a url's tokens fetch
the rules filed under them by an equi join, and only those rules run their regular expression.
Rules without a whole token are filed under the empty token, which every url carries.

Urls are judged once per distinct (host, path); the verdict goes back by a join that adaptive
execution splits when many pages share a url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lateline.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDGE = "\n"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Phrases that block a url where no rule fits; "*" inside stands for anything.
PATTERNS = ["cheap-pills", "spam-farm", "online-casino", "free-*-download"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null url and one without ``://``."""
    host = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"\\$1")


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda t: t != ""))


def site_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with regular expression and whole tokens."""
    host, path = F.translate("host", UPPER, LOWER), F.col("path")
    site = F.when(host == "", F.lit(f"^[^{EDGE}]*")).otherwise(
        F.concat(F.lit(f"^(?:[^{EDGE}]*\\.)?"), _quoted(host)))
    # The last run of the path may go on in the url, so it is no whole token.
    whole = F.concat(host, F.lit("/"), F.regexp_replace(path, "[A-Za-z0-9]+$", ""))
    return rules.select(
        F.concat(host, path).alias("rule"), "verdict", F.lit(True).alias("named"),
        F.concat(site, F.lit(EDGE), _quoted(path)).alias("regex"), _tokens(whole).alias("tokens"))


def phrase_rules(phrases: DataFrame) -> DataFrame:
    """Blocking phrases (phrase) that stand between separators anywhere in host or path."""
    part = F.transform(F.split("phrase", r"\*"), _quoted)
    whole = F.regexp_replace("phrase", r"[A-Za-z0-9]*\*[A-Za-z0-9]*", " ")
    return phrases.select(
        F.col("phrase").alias("rule"), F.lit("block").alias("verdict"), F.lit(False).alias("named"),
        F.concat(F.lit("(?:^|[^A-Za-z0-9])"), F.array_join(part, ".*"),
                 F.lit("(?:[^A-Za-z0-9]|$)")).alias("regex"), _tokens(whole).alias("tokens"))


def index_by_rarest(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """``rules`` with the token under which each is filed; ``url_tokens``: url rows exploded."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = (url_tokens.join(wanted, "token", "left_semi")
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    each = (rules.select("rule", "verdict", "named", "regex", F.explode_outer("tokens").alias("token"))
            .join(counts, "token", "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))
    return (each.groupBy("rule", "verdict", "named", "regex")
            .agg(F.min(F.struct("n", F.coalesce("token", F.lit("")).alias("token"))).alias("rarest"))
            .select("rule", "verdict", "named", "regex", F.col("rarest.token").alias("token")))


def _table(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A table of literals, without Python data in the plan."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def default_rules(spark: SparkSession) -> DataFrame:
    return _table(spark, RULES, ("host", "path", "verdict"))


def default_patterns(spark: SparkSession) -> DataFrame:
    return _table(spark, [(p,) for p in PATTERNS], ("phrase",))


def filter_urls(pages: DataFrame, rules: DataFrame | None = None,
                patterns: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, phrase for every row of ``pages``.

    The longest fitting rule decides (of equal rules block wins); where none fits, a url that
    holds a blocking phrase is blocked and any other allowed. A null url and one without ``://``
    have empty host and path and are allowed; repeated rows and null ids give a row each; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = materialize(seen.groupBy("host", "path").count(), "urls")
    every = F.array_append(_tokens(F.concat_ws("/", "host", "path")), F.lit(""))
    url_tokens = urls.select("host", "path", F.explode(every).alias("token"))
    all_rules = site_rules(default_rules(spark) if rules is None else rules).unionByName(
        phrase_rules(default_patterns(spark) if patterns is None else patterns))
    index = materialize(index_by_rarest(all_rules, url_tokens), "rule-index")
    text = F.concat("host", F.lit(EDGE), "path")
    fits = url_tokens.join(index, "token").filter(F.rlike(text, F.col("regex")))
    longest = F.struct(F.length("rule").alias("size"), "rule", "verdict")
    judged = fits.groupBy("host", "path").agg(
        F.max(F.when(F.col("named"), longest)).alias("best"),
        F.min(F.when(~F.col("named"), F.col("rule"))).alias("phrase"))
    own = F.when(F.col("phrase").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return (seen.join(judged, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", own).alias("verdict"), "phrase"))
