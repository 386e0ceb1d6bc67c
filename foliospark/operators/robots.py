"""Crawl rules: parsing of robots files and the decision for addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def robots_rules(files: DataFrame, agent: str, site: str = "site", body: str = "body") -> DataFrame:
    """(site, path, allow, specificity, pattern) of the groups that name the agent, else of those for *.

    A group is a run of user-agent lines with the rules after it; only values that begin with / count. Specificity is the
    length in bytes without wildcards. Lines become rows and running counts mark the groups: no driver loop.
    """
    from pyspark.sql import Window

    t = files.select(site, F.posexplode(F.split(F.col(body), r"\r\n|\r|\n")).alias("pos", "line"))
    t = t.withColumn("line", F.regexp_replace("line", "#.*$", "")).where(F.col("line").contains(":"))
    t = t.select(site, "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    t = t.where(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy(site).orderBy("pos")
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    t = t.withColumn("group", F.sum(begins.cast("int")).over(w))
    agents = t.where("field = 'user-agent'").select(site, "group", F.lower("value").alias("agent"))
    named = agents.where(F.col("agent") == agent.lower()).select(site, "group").distinct()
    rest = agents.where("agent = '*'").join(named.select(site).distinct(), site, "left_anti").select(site, "group").distinct()
    rules = t.where("field <> 'user-agent' and value like '/%'").join(named.union(rest), [site, "group"])
    core = F.regexp_replace("value", r"\$$", "")
    quoted = F.array_join(F.transform(F.split(core, r"\*"), lambda s: F.concat(F.lit(r"\Q"), s, F.lit(r"\E"))), ".*")
    pattern = F.concat(F.lit("^"), quoted, F.when(F.col("value").endswith("$"), r"\z").otherwise(""))
    return rules.select(site, F.col("value").alias("path"), (F.col("field") == "allow").alias("allow"), F.octet_length(F.replace(core, F.lit("*"), F.lit(""))).alias("specificity"), pattern.alias("pattern"))


def decide(urls: DataFrame, rules: DataFrame, site: str = "site", path: str = "url_path") -> DataFrame:
    """urls with `allowed`: the most specific matching rule decides, allow wins ties, no match allows. Joined on the site."""
    key = [*urls.columns]
    met = urls.join(rules.select(F.col(site).alias("__site"), "allow", "specificity", "pattern"), F.col(site) == F.col("__site"), "left")
    hit = F.when(F.regexp_like(F.col(path), F.col("pattern")), F.struct("specificity", "allow"))
    return met.groupBy(*key).agg(F.max(hit).alias("m")).select(*key, F.coalesce("m.allow", F.lit(True)).alias("allowed"))
