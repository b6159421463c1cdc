"""URL filters: pattern rules found by their rarest literal token.

Every rule is a regular expression with the literal tokens that any match must hold.
How often these tokens occur in the URLs is counted first; each rule is then filed
under its rarest one. A URL's own tokens fetch the rules filed under them, and only
those run their expression. The index of a short list is one map value, so nothing is shuffled
but the counts of the rules' tokens; the rules of a long list are fetched by a hash join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerrecon.llm.common import lower_ascii, private_name

#: Rules up to which the index is one value that is searched in each row; more are joined by their token.
INDEX_RULES = 300
#: Rules that are broadcast for that join; more are shuffled.
BROADCAST_RULES = 200_000
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is searched in ``host + path``; of the rules that match, the largest ``rank`` decides.

    ``tokens``: lower-case runs of letters and digits that stand whole in every URL that matches.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def site_rule(verdict: str, site: str) -> PatternRule:
    """A rule like ``example.net/en/``: that host and its subdomains, paths that begin so; longer rules win."""
    host, slash, path = site.partition("/")
    # a token of the path counts only if the rule itself ends it
    ended = re.findall(f"({TOKEN})(?=[^a-z0-9])", (slash + path).lower()) if path == path.lower() else []
    tokens = tuple(dict.fromkeys(re.findall(TOKEN, host) + ended))
    return PatternRule(site, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tokens, 1_000 + len(site))


def word_rule(verdict: str, *words: str) -> PatternRule:
    """A rule for hosts that hold these words next to each other, each of them whole."""
    joined = "[^a-z0-9/]+".join(map(re.escape, words))
    return PatternRule("-".join(words), verdict, rf"^[^/]*(?<![a-z0-9]){joined}(?![a-z0-9])", tuple(words), len("-".join(words)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower_ascii(address), F.lit(f"({TOKEN})"), F.lit(1)))


def judge_urls(pages: DataFrame, rules: list[PatternRule], default: str = "allow", url_col: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (name of the deciding rule, else NULL) and ``verdict``.

    Ties in rank go to the larger name. NULL and empty URLs, and those without ``://``,
    have an empty host and path and take the default. Rows are judged each by itself;
    columns of the names added here are replaced, all others pass through. Without rules
    everything takes the default.
    """
    if any(not r.tokens for r in rules):
        raise ValueError("a rule without a literal token cannot be filed")
    spark = pages.sparkSession
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")])
    kept = [F.col(f"`{c}`") for c in pages.columns]
    address, best = private_name(pages, "_address"), private_name(pages, "_best")
    host, path = url_parts(F.col(f"`{url_col}`"))
    parted = pages.withColumns({"host": host, "path": path}).withColumn(address, F.concat("host", "path"))
    if not rules:
        judged = parted.withColumn(best, F.lit(None).cast("struct<rank:int,name:string,verdict:string>"))
    else:
        listed = spark.createDataFrame(
            [(r.name, r.verdict, r.pattern, list(r.tokens), r.rank) for r in rules],
            "name string, verdict string, pattern string, tokens array<string>, rank int",
        )
        small = lambda df: F.broadcast(df) if len(rules) <= BROADCAST_RULES else df
        wanted = listed.select(F.explode("tokens").alias("token")).distinct()
        seen = (
            parted.select(F.explode(_tokens(F.col(address))).alias("token"))
            .join(small(wanted), "token", "left_semi").groupBy("token").count()
        )
        rarest = (
            listed.withColumn("token", F.explode("tokens")).join(small(seen), "token", "left")
            .groupBy("name", "verdict", "pattern", "rank")
            .agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
        )
        if len(rules) <= INDEX_RULES:
            index = private_name(parted, "_index")
            judged = parted.withColumn(index, _index_of(rarest)).withColumn(best, _best_in_index(F.col(index), F.col(address)))
        else:
            judged = _best_by_join(parted, small(rarest), address, best)
    decided = F.col(best)
    return judged.select(
        *kept, "host", "path", decided["name"].alias("rule"), F.coalesce(decided["verdict"], F.lit(default)).alias("verdict"))


def _index_of(rarest: DataFrame) -> Column:
    """Rules by the token they are filed under, as one map value."""
    filed = rarest.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "verdict", "pattern"))).alias("rules"))
    return filed.agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("index")).scalar()


def _best_in_index(index: Column, address: Column) -> Column:
    """The deciding rule of an address among those filed under its tokens."""
    fetched = F.flatten(F.filter(F.transform(_tokens(address), lambda t: F.try_element_at(index, t)), lambda x: x.isNotNull()))
    matching = F.filter(fetched, lambda r: F.regexp_like(address, r["pattern"]))
    return F.array_max(F.transform(matching, lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict"))))


def _best_by_join(parted: DataFrame, rarest: DataFrame, address: str, best: str) -> DataFrame:
    """``parted`` with its deciding rule: tokens of each different address fetch rules by a join, which are tried there."""
    addresses = parted.select(F.col(address).alias("address")).distinct()
    tried = addresses.select("address", F.explode(_tokens(F.col("address"))).alias("token")).join(rarest, "token").where(
        F.regexp_like("address", F.col("pattern")))
    winners = tried.groupBy("address").agg(F.max(F.struct("rank", "name", "verdict")).alias(best))
    return parted.join(winners, F.col(address) == F.col("address"), "left").drop("address")
