"""Crawl permission: robots texts to rules, and rules to a decision per URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlight.functions.text import strip
from trawlight.functions.urls import netloc, path_onwards
from trawlight.session import materialise

# Keys that start a group, decide on a path, or only count as rules of their group.
AGENT_KEY = "user-agent"
PATH_KEYS = ["allow", "disallow"]
LIMIT_KEYS = ["crawl-delay", "request-rate"]


def _unquote(text: Column) -> Column:
    """Percent-decoding; a percent sign that starts no escape stays."""
    escaped = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))


def _quote(text: Column) -> Column:
    """Percent-encoding of everything but letters, digits, ``_.-~`` and the slash."""
    quoted = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(found), F.lit(wanted))
    return quoted


def robots_hosts(answers: DataFrame) -> DataFrame:
    """``(netloc, text)``: the first good answer of each host.

    ``answers`` are ``(netloc, seq, status, text)`` in crawl order. Only status 200 counts, so a
    host without a good answer has no row, which means everything is allowed. The scheme is not
    part of the key.
    """
    good = answers.where(F.col("status") == 200)
    return good.groupBy("netloc").agg(F.min_by("text", "seq").alias("text"))


def robots_rules(hosts: DataFrame) -> DataFrame:
    """``(netloc, group_seq, agents, rule_seq, allow, path)`` of every group that has rules.

    A group starts at an agent line unless an agent line came just before; an empty line ends it.
    Rules outside a group are ignored. A rule that limits the rate instead of deciding on a path
    has neither ``allow`` nor ``path``, but makes its group count. Windows stay within one text.
    """
    lines = hosts.select("netloc", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "line"))
    content = strip(F.regexp_replace("line", "(?s)#.*$", ""))
    key = F.lower(strip(F.regexp_extract(content, "(?s)^([^:]*):", 1)))
    value = _unquote(strip(F.regexp_extract(content, "(?s)^[^:]*:(.*)$", 1)))
    numeric = F.when(key == "request-rate", value.rlike(r"^\s*\d+\s*/\s*\d+\s*$")).otherwise(True)
    kind = (
        F.when(F.col("line") == "", "end")
        .when(~content.contains(":"), None)
        .when(key == AGENT_KEY, "agent")
        .when(key.isin(PATH_KEYS + LIMIT_KEYS), "rule")
    )
    events = lines.select(
        "netloc", "line_no", kind.alias("kind"), key.alias("key"), value.alias("value"), numeric.alias("_counts")
    ).where("kind is not null")

    in_order = Window.partitionBy("netloc").orderBy("line_no")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    opener = F.last(F.when(F.col("kind") != "rule", F.col("kind")), ignorenulls=True).over(so_far)
    active = events.withColumn("_opener", opener).where((F.col("kind") != "rule") | (F.col("_opener") == "agent"))
    starts = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(in_order), F.lit("end")) != "agent")
    grouped = (
        active.withColumn("_start", starts.cast("int"))
        .withColumn("group_seq", F.sum("_start").over(so_far))
        .where(F.col("kind") != "end")
    )
    groups = grouped.groupBy("netloc", "group_seq").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "agent", F.struct("line_no", "value")))).alias("_agents"),
        F.array_sort(
            F.collect_list(F.when(F.col("kind") == "rule", F.struct("line_no", "key", "value")))
        ).alias("_rules"),
    )
    decides = F.col("_rule.key").isin(PATH_KEYS)
    return (
        groups.where(F.size("_rules") > 0)
        .select(
            "netloc",
            "group_seq",
            F.transform("_agents", lambda agent: agent["value"]).alias("agents"),
            F.posexplode("_rules").alias("rule_seq", "_rule"),
        )
        .select(
            "netloc",
            "group_seq",
            "agents",
            "rule_seq",
            # An empty disallow permits everything.
            F.when(decides, (F.col("_rule.key") == "allow") | (F.col("_rule.value") == "")).alias("allow"),
            F.when(decides, _quote(F.col("_rule.value"))).alias("path"),
        )
    )


def host_policies(rules: DataFrame, agent: str) -> DataFrame:
    """``(netloc, policy)``: the ordered path rules that hold for one agent on each host.

    The first group naming a part of the agent wins; otherwise the first group with ``*``.
    """
    token = agent.split("/")[0].lower()
    default = F.array_contains("agents", "*")
    named = ~default & F.exists("agents", lambda name: F.contains(F.lit(token), F.lower(name)))
    chosen = (
        rules.where(default | named)
        .groupBy("netloc", "group_seq")
        .agg(
            F.max(default).alias("default"),
            F.array_sort(F.collect_list(F.struct("rule_seq", "allow", "path"))).alias("policy"),
        )
        .groupBy("netloc")
        .agg(F.min_by("policy", F.struct("default", "group_seq")).alias("policy"))
    )
    return chosen


def robots_allowed(urls: DataFrame, policies: DataFrame) -> DataFrame:
    """Add ``allowed``: the first rule whose path starts the URL path decides; none allows.

    Hosts without a policy allow everything. The rules of a host travel as one array, so a URL
    needs one lookup and no row per rule. Give it URLs without their pages. One host may have most of them: a
    policy is one row per host, so adaptive execution may split such a host and repeat the policy.
    """
    decoded = _unquote(F.col("url"))
    target = _quote(path_onwards(decoded))
    keyed = urls.withColumn("_netloc", netloc(F.col("url")))
    joined = keyed.join(policies.select(F.col("netloc").alias("_netloc"), "policy"), "_netloc", "left").withColumn(
        "_target", F.when(target == "", F.lit("/")).otherwise(target)
    )
    applying = F.filter("policy", lambda rule: F.startswith(F.col("_target"), rule["path"]))
    decision = F.coalesce(F.try_element_at(applying, F.lit(1))["allow"], F.lit(True))
    return joined.withColumn("allowed", decision).drop("_netloc", "_target", "policy")


def allowed_only(urls: DataFrame, policies: DataFrame) -> DataFrame:
    """The URLs that may be fetched: well-formed and not disallowed."""
    return robots_allowed(urls, policies).where("allowed").drop("allowed")


def disallowed_urls(urls: DataFrame, policies: DataFrame) -> DataFrame:
    """The distinct URLs that must not be fetched, stored, so that the planner knows how many they are."""
    denied = robots_allowed(urls.select("url"), policies).where(~F.col("allowed"))
    return materialise(denied.select("url").distinct(), "disallowed")
