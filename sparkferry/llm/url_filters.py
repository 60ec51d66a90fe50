"""URL filters by short hash prefixes, in DataFrame functions only.

Each url is expanded into its host's suffixes; those that some rule has are expanded by prefixes of the path, of the lengths
that the host's rules have. Both kinds of expressions are equi-joined on the first bytes of their digests; full digests confirm, and
precedence decides. So a url's work grows with its own labels and with the path lengths of the rules of its own hosts, not with the list.

Shuffles: one, of a row for each url (the matches of a url are combined before it). The rules are the small side; Spark
broadcasts them when its statistics show them to be under its limit, and else sort-merge joins, where adaptive execution
splits the partition of an expression that a large share of urls have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkferry.llm._frames import pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that the join is on: four bytes.
PREFIX_DIGITS = 8


def split_url(url) -> tuple:
    """Host and path columns of a url. Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower
    case (with any port or user part); path: what follows up to `?`, `#` or the end. Both empty without `://` or for null."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, whole, 1), UPPER, LOWER), F.regexp_extract(url, whole, 2)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(action, `host/path`) pairs as a DataFrame of host, path and action. The path begins at the first slash."""
    cut = [(r.partition("/"), a) for a, r in rules]
    if not cut:
        return spark.range(0).select(F.lit("").alias("host"), F.lit("").alias("path"), F.lit("").alias("action"))
    rows = [F.struct(F.lit(h).alias("host"), F.lit(s + p).alias("path"), F.lit(a).alias("action")) for (h, s, p), a in cut]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Each row's kept columns with host, path, rule and verdict.

    rules: host, path, action (`allow` or `block`); a null in any of them makes a rule void. A rule fits its host and all
    subdomains where the url's path starts with its path (any prefix, not only whole segments). The longest fitting rule
    (host and path together) wins; on a tie the longer host, then `block`. Without a fit the rule is null and the verdict
    is `default`. A null or unparsable url has an empty host, which no rule fits; repeated rows each get their verdict;
    an empty table gives an empty one; other columns of df may have any name. keep: columns of df that are returned.
    """
    names = {f"k{i}": k for i, k in enumerate(keep)}
    if made := {"host", "path", "rule", "verdict"} & {k.lower() for k in keep}:
        raise ValueError(f"kept columns clash with results: {sorted(made)}")
    lists = pick(rules, host="host", path="path", action="action").dropna().distinct()
    lists = lists.where(F.col("action").isin("allow", "block") & (F.col("host") != "")).select(
        F.concat("host", "path").alias("rule"), F.translate("host", UPPER, LOWER).alias("host"), "path", "action"
    )
    lists = lists.withColumn("digest", F.sha2(F.concat("host", "path"), 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    hosts = lists.groupBy("host").agg(F.array_sort(F.collect_set(F.length("path"))).alias("chars"))
    hosts = hosts.select(F.sha2("host", 256).alias("host_digest"), "chars").withColumn("host_prefix", F.substring("host_digest", 1, PREFIX_DIGITS))

    host, path = split_url(F.col("u"))
    pages = pick(df, u=url, **names).select(F.monotonically_increasing_id().alias("rid"), *names, host.alias("host"), path.alias("path"))
    # Host suffixes first; only where a rule has that host are paths cut, to the lengths that its rules have.
    most = lists.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1  # longer suffixes can't be a rule's
    labels = F.least(F.lit(most), F.size(F.split("host", r"\.", most + 1)))
    suffixes = F.transform(F.sequence(F.lit(1), labels), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    asked = pages.withColumn("suffix", F.explode(F.array_distinct(F.concat(F.array(F.lit(None).cast("string")), suffixes))))
    asked = asked.withColumn("asked", F.sha2("suffix", 256)).withColumn("asked_prefix", F.substring("asked", 1, PREFIX_DIGITS))
    known = asked.join(hosts, (F.col("asked_prefix") == F.col("host_prefix")) & (F.col("asked") == F.col("host_digest")), "left")
    cut = F.transform("chars", lambda n: F.concat("suffix", F.substr("path", F.lit(1), n)))
    known = known.select("rid", *names, "host", "path", F.explode_outer(F.array_distinct(cut)).alias("expr"))
    known = known.withColumn("asked", F.sha2("expr", 256)).withColumn("asked_prefix", F.substring("asked", 1, PREFIX_DIGITS))
    near = known.join(lists.select("prefix", "digest", "rule", "action"), F.col("asked_prefix") == F.col("prefix"), "left")
    sure = (F.col("asked") == F.col("digest")) & (F.col("host") != "")
    rank = F.when(sure, F.struct(F.length("rule").alias("n"), F.length(F.substring_index("rule", "/", 1)).alias("h"), F.col("action"), F.col("rule")))
    best = near.groupBy("rid").agg(F.first(F.struct(*names, "host", "path")).alias("row"), F.max(rank).alias("best"))
    return best.select(
        *[F.col(f"row.{k}").alias(v) for k, v in names.items()], F.col("row.host").alias("host"), F.col("row.path").alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
