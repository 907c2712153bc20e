"""URL filters: pattern rules indexed by their rarest literal token.

A rule's literal tokens are runs of small letters and digits that its expression bounds on both sides, so any address
it matches holds them whole; capitals are borders, as in the expressions.  The rarest of
them over all addresses is the rule's key; an address's tokens fetch candidate rules and only those run their
expressions.  Only SQL functions; while the rules are few they are a literal map and nothing is shuffled, beyond
that candidates come from a join on the tokens.

Host rules fit a host and its subdomains when the path starts with theirs, and the longest that fits decides;
where none fits, the pattern rules do (block if any matches), else the address is allowed.

Edge cases: a null address, or one without "://", has empty host and path and is judged like any other; ties
between rules of one length go to the smaller rule; repeated rows are judged each on its own; very long addresses are judged whole;
an empty table gives no rows; columns other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rules that fit a literal map; more take the join.
SMALL = 2000


@dataclass(frozen=True)
class Rule:
    name: str
    regex: str
    verdict: str
    tokens: tuple[str, ...]
    weight: int  # the longest host rule wins; pattern rules weigh 0


def host_rule(name: str, verdict: str) -> Rule:
    """name: host and path in one, like net/de/."""
    host, slash, path = name.partition("/")
    parts = path.split("/")
    whole = parts[:-1]  # the last may go on in the address
    tokens = tuple(t for p in (host.lower(), *whole) for t in re.findall("[a-z0-9]+", p))
    return Rule(name, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", verdict, tokens, len(name))


def pattern_rule(name: str, regex: str, tokens: tuple[str, ...]) -> Rule:
    return Rule(name, regex, "block", tokens, 0)


HOST_RULES = (
    host_rule("com/en/", "block"),
    host_rule("example.com/en/7", "allow"),
    host_rule("net/de/", "allow"),
    host_rule("example.net/de/8", "block"),
    host_rule("org/es/", "block"),
)
PATTERN_RULES = (
    pattern_rule("casino", r"(^|[^a-z0-9])casino([^a-z0-9]|$)", ("casino",)),
    pattern_rule("porn", r"(^|[^a-z0-9])porn([^a-z0-9]|$)", ("porn",)),
    pattern_rule("torrent", r"(^|[^a-z0-9])torrent/", ("torrent",)),
    pattern_rule("ad-server", r"^ads?\.[^/]*/click", ()),
    pattern_rule("executable", r"\.(exe|msi)$", ()),
)


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path, both empty without '://'."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def tokens_of(place: F.Column) -> F.Column:
    return F.array_distinct(F.split(place, "[^a-z0-9]+"))


def keys_of(rules: tuple[Rule, ...], places: DataFrame) -> dict[str, list[Rule]]:
    """Rarest token over all addresses -> rules; rules without a literal token have the key ''.

    Only counts of the rules' own tokens come to the driver.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = {}
    if wanted:
        told = places.select(F.explode(tokens_of(F.col("place"))).alias("token")).where(F.col("token").isin(wanted))
        counts = {r["token"]: r["n"] for r in told.groupBy("token").agg(F.count("*").alias("n")).collect()}
    keyed: dict[str, list[Rule]] = {}
    for r in rules:
        key = min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else ""
        keyed.setdefault(key, []).append(r)
    return keyed


def _struct(r: Rule) -> F.Column:
    return F.struct(F.lit(r.weight).alias("weight"), F.lit(r.name).alias("name"), F.lit(r.regex).alias("regex"), F.lit(r.verdict).alias("verdict"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, method_rule of every row."""
    host, path = parts(F.col("url"))
    rows = pages.select(pages[id_column].cast("bigint").alias("page_id"), pages[url_column].cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("place", F.concat("host", "path"))
    keyed = keys_of(rules, rows.select("place"))
    always = keyed.pop("", [])
    none = F.filter(F.array(_struct(Rule("", "", "", (), 0))), lambda x: F.lit(False))
    if len(rules) <= SMALL:
        index = F.create_map(*[x for k, rs in keyed.items() for x in (F.lit(k), F.array(*map(_struct, rs)))]) if keyed else None
        fetched = F.flatten(F.transform(tokens_of(F.col("place")), lambda t: F.coalesce(index[t], none))) if keyed else none
        rows = rows.withColumn("candidates", fetched)
    else:
        spark = pages.sparkSession
        table = spark.createDataFrame([(k, r.weight, r.name, r.regex, r.verdict) for k, rs in keyed.items() for r in rs], "token string, weight int, name string, regex string, verdict string")
        met = rows.select("place").distinct().select("place", F.explode(tokens_of(F.col("place"))).alias("token")).join(table, "token")
        met = met.where(F.call_function("rlike", F.col("place"), F.col("regex"))).groupBy("place").agg(F.collect_list(F.struct("weight", "name", "regex", "verdict")).alias("candidates"))
        rows = rows.join(met, "place", "left").withColumn("candidates", F.coalesce("candidates", none))
    candidates = F.concat("candidates", F.array(*map(_struct, always))) if always else F.col("candidates")
    rows = rows.withColumn("fits", F.filter(candidates, lambda r: F.call_function("rlike", F.col("place"), r["regex"])))
    order = lambda a, b: F.when(a["weight"] != b["weight"], b["weight"] - a["weight"]).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    hosts = F.array_sort(F.filter("fits", lambda r: r["weight"] > 0), order)
    patterns = F.array_sort(F.filter("fits", lambda r: r["weight"] == 0), order)
    rows = rows.withColumns({"by_host": F.get(hosts, F.lit(0)), "by_pattern": F.get(patterns, F.lit(0))})
    return rows.select("page_id", "host", "path", F.col("by_host.name").alias("rule"), F.coalesce("by_host.verdict", "by_pattern.verdict", F.lit("allow")).alias("verdict"), F.col("by_pattern.name").alias("method_rule"))
