"""URL filters as a sort-merge range join; DataFrame functions only.

A host's canonical key is its labels reversed, each followed by a point (``www.example.com`` -> ``com.example.www.``), so
the hosts below a rule's host are one interval of keys, ``[com.example., com.example/)``. Intervals of rules nest. Rule
openings, rule closings and the distinct hosts of the pages are sorted together by key and swept once: an opening carries
the stack of rules active from there on, a closing the stack below it, and a host takes the last stack before it. A page
then takes the longest rule of its host's stack whose path starts its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridloom.llm import common

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "://([^/?#]*)([^?#]*)"
_STACK = "array<struct<n:int,host:string,path:string,rule:string,action:string>>"
#: Host stacks are broadcast up to so many rows and rules in all, both counted first; beyond, they are joined by sorting.
BROADCAST_HOSTS, BROADCAST_RULES = 20_000, 100_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Per rule host: key, the stack from its opening on, the stack after its closing; longest rules first.

    Rules with null or empty host fit no page and go; a null path counts as empty; of one (host, path) with both actions,
    block holds.
    """
    one = (
        rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .where("host <> '' and action is not null")
        .groupBy("host", "path")
        .agg(F.max("action").alias("action"))
    )
    entry = F.struct(F.length(F.concat("host", "path")).alias("n"), "host", "path", F.concat("host", "path").alias("rule"), "action")
    hosts = one.groupBy("host").agg(F.collect_list(entry).alias("own")).withColumn("key", canonical_key(F.col("host")))
    labels = F.split(F.expr("left(key, length(key) - 1)"), "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    pairs = hosts.select("key", F.explode(above).alias("above")).join(
        hosts.select(F.col("key").alias("above"), F.col("own").alias("theirs")), "above"
    )
    longest_first = "array_sort(flatten(collect_list({})), (a, b) -> case when a.n <> b.n then b.n - a.n else length(b.host) - length(a.host) end)"
    return pairs.groupBy("key").agg(
        F.expr(longest_first.format("theirs")).cast(_STACK).alias("stack"),
        F.expr(longest_first.format("case when above <> key then theirs end")).cast(_STACK).alias("below"),
    )


def host_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, stack for each distinct host within a rule's interval."""
    stacks = rule_stacks(rules)
    none = F.lit(None)
    events = (
        stacks.select("key", F.lit(1).alias("kind"), "stack", none.cast("string").alias("host"))
        .unionByName(stacks.select(F.expr("left(key, length(key) - 1) || '/'").alias("key"), F.lit(0).alias("kind"), F.col("below").alias("stack"), none.cast("string").alias("host")))
        .unionByName(hosts.distinct().select(canonical_key(F.col("host")).alias("key"), F.lit(2).alias("kind"), none.cast(_STACK).alias("stack"), "host"))
    )
    # Dealt out in ranges of keys and written, so that a range keeps its number; each is swept by itself.
    dealt = common.materialise(events.repartitionByRange("key", "kind", "host").withColumn("range", F.spark_partition_id()), "sweep")
    ranges = dealt.groupBy("range").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.struct("key", "kind"))).alias("last"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = common.materialise(ranges.select("range", F.last("last", ignorenulls=True).over(before).alias("carried")), "carried")
    held = carried.agg(F.count("*").alias("ranges"), F.sum(F.size("carried")).alias("rules")).first()
    small = held.ranges <= BROADCAST_HOSTS and (held.rules or 0) <= BROADCAST_RULES
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
        .where("kind = 2")
        .join(F.broadcast(carried) if small else carried, "range")
        .select("host", F.coalesce("active", "carried").alias("stack"))
        .where("size(stack) > 0")
    )


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict (the rule's, else ``default``).

    A null url, or one without ``://``, has empty host and path and no rule. Every row is judged, repeated rows each;
    other columns are ignored; empty pages or rules give no rows, or the default. Very frequent hosts count once in the
    sweep, and the join back to the pages is split by adaptive execution where it isn't a broadcast of checked size.
    """
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    stacks = common.materialise(host_stacks(split.select("host"), rules), "stacks")
    size = stacks.agg(F.count("*").alias("hosts"), F.sum(F.size("stack")).alias("rules")).first()
    small = size.hosts <= BROADCAST_HOSTS and (size.rules or 0) <= BROADCAST_RULES
    return (
        split.join(F.broadcast(stacks) if small else stacks, "host", "left")
        .withColumn("fit", F.expr("get(filter(stack, r -> startswith(path, r.path)), 0)"))
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", F.lit(default)).alias("verdict"))
    )


#: The rules of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules])
    return spark.range(1).select(F.inline(rows))


def op9(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


OP9_SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(rhost, rpath, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT page_id, host, path,
       (SELECT arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(action, length(rhost || rpath) * 1000 + length(rhost)) FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM parts
"""
