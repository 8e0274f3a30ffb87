"""robots.txt as tables: groups and rules from text, and which rule decides a URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def parse(texts: DataFrame, agent: str, key: str = "origin", text: str = "text") -> DataFrame:
    """(key, pattern, is_allow, crawl_delay): rules of the groups that name the agent most specifically. Where there is a delay but no rule, an empty pattern carries it.

    Consecutive User-agent lines share a group, one after a rule starts a new one. An agent matches if it begins the
    product token; the empty one and * match least. A bare Disallow allows all; negative or non-numeric delays are ignored.
    """
    token = agent.split()[0].split("/")[0].lower()
    lines = texts.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("i", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    parts = lines.withColumn("field", F.lower(F.trim(F.regexp_extract(bare, r"^([^:]+):", 1)))).withColumn("value", F.trim(F.regexp_extract(bare, r"^[^:]+:(.*)$", 1)))
    known = parts.filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy(key).orderBy("i")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = known.withColumn("opens", opens.cast("long")).withColumn("g", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    name = F.lower("value")
    fits = (F.col("field") == "user-agent") & ((name == "*") | F.lit(token).startswith(name))
    strength = F.when(fits, F.when(name == "*", 0).otherwise(F.length(name)))
    groups = grouped.withColumn("strength", F.max(strength).over(Window.partitionBy(key, "g"))).filter("strength is not null")
    best = groups.withColumn("best", F.max("strength").over(Window.partitionBy(key))).filter("strength = best")
    delay = F.when((F.col("field") == "crawl-delay") & (F.col("value").try_cast("double") >= 0), F.col("value").try_cast("double"))
    with_delay = best.withColumn("crawl_delay", F.max(delay).over(Window.partitionBy(key)))
    is_rule = F.col("field").isin("allow", "disallow")
    ruled = F.max(is_rule).over(Window.partitionBy(key))
    rules = with_delay.withColumn("ruled", ruled).filter(is_rule | (~F.col("ruled") & (F.col("field") == "crawl-delay")))
    pattern = F.when(is_rule, F.col("value")).otherwise(F.lit(""))
    return rules.select(key, pattern.alias("pattern"), ((F.col("field") == "allow") | (pattern == "")).alias("is_allow"), "crawl_delay")


def decide(requests: DataFrame, rules: DataFrame, request: list[str], origin: str = "origin", path: str = "path") -> DataFrame:
    """requests with allowed: the longest matching pattern decides, Allow wins a tie, no match allows.

    The join is on the origin; patterns (few for each origin) are tested by regular expression after it.
    """
    prepared = rules.filter("pattern <> ''").select(F.col(origin).alias("_o"), urls.rule_regex(F.col("pattern")).alias("_r"), urls.rule_length(F.col("pattern")).alias("_n"), "is_allow")
    met = requests.join(prepared, (F.col(origin) == F.col("_o")) & F.regexp_like(F.col(path), F.col("_r")), "left")
    verdict = F.max_by("is_allow", F.struct("_n", "is_allow"))
    return met.groupBy(*request).agg(F.coalesce(verdict, F.lit(True)).alias("allowed"))
