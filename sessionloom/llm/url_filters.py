"""URL allow and block rules by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the short hash prefix that the join is on.
PREFIX_DIGITS = 8
#: Parts that the rows of one key are dealt to where rules are not broadcast.
SALTS = 16
#: Rules up to this many are broadcast (under 300 bytes each); more are joined by a shuffle on the prefix.
MAX_BROADCAST_RULES = 200_000


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """df with ``host`` and ``path`` (without ``?`` and ``#`` parts); null or no ``://``: both empty."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))})


def _joinable(rules: DataFrame) -> DataFrame:
    """Rules with the host, the path, the part of the path up to its last slash, digests and depths."""
    slash = F.instr("rule", "/")
    host = F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))
    path = F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise(F.lit(""))
    folder = F.regexp_extract(path, r"^((?:.*/)?)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (
        rules.where("rule IS NOT NULL AND verdict IS NOT NULL")
        .select("rule", "verdict", F.translate(host, upper, upper.lower()).alias("r_host"), path.alias("r_path"), folder.alias("r_folder"))
        .withColumns(
            {
                "r_key": F.substring(F.sha2(F.concat("r_host", "r_folder"), 256), 1, PREFIX_DIGITS),
                "r_digest": F.sha2(F.concat("r_host", "r_path"), 256),
                "r_path_length": F.length("r_path"),
                "r_labels": F.size(F.split("r_host", r"\.")),
                "r_slashes": F.size(F.split("r_folder", "/")) - 1,
            }
        )
        .dropDuplicates(["rule", "verdict"])
    )


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", default: str = "allow") -> DataFrame:
    """Judge every page's url by the longest rule that fits.

    ``rules`` has ``rule`` (a host, then a path, as in ``example.com/en/``) and ``verdict``. A rule fits its host and
    all its subdomains where the url's path starts with the rule's path. Each distinct url is expanded into host
    suffixes times path prefixes that end with a slash (as many labels and slashes as any rule has), hashed with
    SHA-256; rows are equi-joined on the first 32 bits, and a candidate counts if the digest of host suffix and of as
    much path as the rule has is the rule's. The longest rule wins; among equally long ones the longer host, then
    the larger rule and verdict in string order (so block before allow).

    Returns page_id, host, path, rule, verdict, in as many rows as ``pages`` has, repeated rows too. Null and
    unparsable urls have empty host and path, which only a rule without host fits. Other columns are ignored.
    """
    rules = _joinable(rules)
    most = rules.agg(F.count("*").alias("n"), F.max("r_labels").alias("labels"), F.max("r_slashes").alias("slashes")).first()
    rows = split_url(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    deepest, longest = F.lit(max(1, most["labels"] or 1)), F.lit(most["slashes"] or 0)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), deepest)), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, longest)), lambda k: F.when(k > 0, F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))).otherwise(F.lit("")))
    expanded = (
        rows.select("host", "path")
        .distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("r_key", F.substring(F.sha2(F.concat("suffix", "prefix"), 256), 1, PREFIX_DIGITS))
    )
    rules = rules.drop("r_labels", "r_slashes", "r_folder")
    if most["n"] <= MAX_BROADCAST_RULES:
        candidates = expanded.join(F.broadcast(rules), "r_key")
    else:
        # a bare host such as com is in a large part of all urls
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        candidates = expanded.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS))).join(salted, ["r_key", "salt"]).drop("salt")
    fitting = candidates.where(F.sha2(F.concat("suffix", F.substring(F.col("path"), F.lit(1), F.col("r_path_length"))), 256) == F.col("r_digest"))
    best = fitting.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("r_host").alias("h"), "rule", "verdict")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
