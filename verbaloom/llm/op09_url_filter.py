"""URL filters by a sort-merge range join, in DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains if a url's path starts with the
rule's path; the longest fitting rule wins. Keys are canonical: host labels in reverse order, then
the path. Under one rule host, a path prefix is an interval of keys, and rules nest or are
disjoint. Each rule host's interval borders are swept in order with a stack of active rules, which
gives flat segments that know their innermost rule. Url keys, one for each number of host labels
that some rule has, are then sorted together with the segment borders, and the sweep carries the
last border's rule to every key behind it. A url's longest rule over its keys decides.

Sweeps run by (rule host, salt): a host's urls are counted and dealt over one sweep for each
`rows_per_salt` of them (or four times its rules, if more), to each of which that host's borders are
copied; so there are never more copies than urls. Hosts without urls and keys of no rule's host take
no part.

Null urls and urls without :// have empty host and path and get the default verdict. Repeated rows
repeat. Of rules equal in host and path, block wins. Empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The contract's rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Urls of a sweep; sites that are broadcast; sweeps of the keys of no site, which meet no border.
ROWS_PER_SALT, SITES, SPREAD = 500, 1_000_000, 4096


def host_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.lit(2**31 - 1))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "\\.", -1)), ".")


def segments(rules: DataFrame) -> DataFrame:
    """Flat borders by site (reversed rule host): from `border` on, `active` is the innermost rule
    (null: none). The sweep of a site's sorted borders keeps the stack's depth; no row holds a site's rules."""
    named = rules.select(reversed_host(F.col("host")).alias("site"), F.col("path").cast("binary").alias("from"), F.struct(F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    named = named.groupBy("site", "from").agg(F.max("r").alias("r"))  # block > allow
    # a key with the prefix is below prefix + FF, which no UTF-8 text holds; ends come before starts
    ends = F.concat("from", F.expr("X'FF'"))
    events = F.array(F.struct(F.col("from").alias("border"), F.lit(1).alias("kind"), "r"), F.struct(ends.alias("border"), F.lit(0).alias("kind"), "r"))
    events = named.select("site", F.explode(events).alias("e")).select("site", "e.*")
    swept = Window.partitionBy("site").orderBy("border", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("depth", F.sum(2 * F.col("kind") - 1).over(swept))
    # the top of the stack: of a depth, the last rule that started at it is open as long as the depth is held
    level = Window.partitionBy("site", "depth").orderBy("border", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.last(F.when(F.col("kind") == 1, F.col("r")), ignorenulls=True).over(level)
    return events.select("site", "border", top.alias("active"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """page_id, host, path, rule (null: none), verdict."""
    depths = sorted(r["d"] for r in rules.select(F.size(F.split("host", "\\.", -1)).alias("d")).distinct().collect())
    host, path = host_path("url")
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", "\\.", -1)
    # one key for each label count; the first, of no site, keeps urls that no rule's depth fits
    sites = F.array(F.lit(None).cast("string"), *[F.when(F.size(labels) >= d, F.array_join(F.reverse(F.slice(labels, -d, d)), ".")) for d in depths])
    keys = parsed.select("page_id", "host", "path", F.posexplode(sites).alias("at", "site")).filter("at = 0 or site is not null")
    # sites of rules, with the sweeps that their urls need
    ruled = common.materialize(rules.groupBy(reversed_host(F.col("host")).alias("ruled")).agg(F.count("*").alias("rules")), "rule-sites")
    met = keys.join(common.small(ruled, SITES), F.col("site") == F.col("ruled")).groupBy(F.col("site").alias("met")).agg(F.count("*").alias("n"), F.max("rules").alias("rules"))
    sweep = F.greatest(F.lit(rows_per_salt).cast("long"), 4 * F.col("rules"))
    met = common.materialize(met.select("met", F.ceil(F.col("n") / sweep).cast("int").alias("salts")), "site-salts")
    dealt = keys.join(common.small(met, SITES), F.col("site") == F.col("met"), "left").filter("at = 0 or met is not null")
    salt = F.pmod(F.xxhash64("page_id", "host", "path"), F.coalesce("salts", F.lit(SPREAD)).cast("long")).cast("int")
    keys = dealt.select("site", salt.alias("salt"), F.col("path").cast("binary").alias("border"), F.lit(1).alias("kind"), F.lit(None).cast("struct<active:struct<rule:string,verdict:string>>").alias("seg"), F.struct("page_id", "host", "path", "at").alias("page"))
    borders = segments(rules).join(common.small(met, SITES), F.col("site") == F.col("met"))
    borders = borders.select("site", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "border", F.lit(0).alias("kind"), F.struct("active").alias("seg"), F.lit(None).cast(keys.schema["page"].dataType).alias("page"))
    order = Window.partitionBy("site", "salt").orderBy("border", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = keys.unionByName(borders).withColumn("seg", F.last("seg", ignorenulls=True).over(order)).filter("page is not null")
    # copies of a row have as many keys of place 0 as there are copies
    hit = F.max(F.when(F.col("seg.active").isNotNull(), F.struct(F.length("seg.active.rule").alias("n"), F.col("seg.active.rule").alias("rule"), F.col("seg.active.verdict").alias("verdict"))))
    judged = swept.groupBy("page.page_id", "page.host", "page.path").agg(hit.alias("hit"), F.count_if(F.col("page.at") == 0).cast("int").alias("copies"))
    one = judged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return one.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark, sf_dir) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_filter(common.table(spark, sf_dir, "pages"), rules)
