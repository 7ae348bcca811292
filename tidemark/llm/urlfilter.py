"""URL filters with dated lists: entries become validity intervals, and every capture meets those active when it was fetched.

A list entry is (pattern, action, listed_on). A pattern is `d:` and a domain suffix of two labels or more, `h:` and a
host (a name, an IPv4 address, or an IPv6 address in brackets; addresses have no domains), or `p:`, a host and a path prefix of whole segments. An entry holds from its date until the next entry of
the same pattern, whatever that says; the action `clear` ends an entry without another. A capture takes the action of the most
specific active pattern: the longest path prefix, then the host, then the longest domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage

#: Scheme, user, host (an IPv6 address in brackets), port, path.
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)(?::[0-9]*)?(?:$|([/?#].*))"
_ADDRESS = r"^(?:\[.*|[0-9]{1,3}(?:\.[0-9]{1,3}){3})$"


def host(url: Column) -> Column:
    """The host in lower case without a last dot; null if the text is no absolute URL."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.$", ""), F.lit(""))


def patterns(url: Column) -> Column:
    """All patterns that cover a URL, with how specific each is: array<struct<pattern, specificity>>; null without a host."""
    name = host(url)
    labels = F.split(name, r"\.")
    n = F.size(labels)
    path = F.regexp_extract(F.regexp_extract(url, _URL, 2), "^[^?#]*", 0)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    one = lambda p, s: F.struct(p.alias("pattern"), s.cast("int").alias("specificity"))
    domains = F.when((n > 1) & ~name.rlike(_ADDRESS), F.transform(F.sequence(F.lit(1), n - 1), lambda i: one(F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")), n - i + 1)))
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: one(F.concat(F.lit("p:"), name, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")), 2000 + i)))
    none = F.filter(F.array(one(F.lit(""), F.lit(0))), lambda x: F.lit(False))
    return F.when(name.isNotNull(), F.concat(F.array(one(F.concat(F.lit("h:"), name), F.lit(1000))), F.coalesce(domains, none), F.coalesce(paths, none)))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity of entries (pattern, action, listed_on): adds valid_to (null: still active). Of entries of one pattern and
    date the last action by name counts. Entries with a null pattern, action or date say nothing and are left out."""
    once = entries.where("pattern is not null and action is not null and listed_on is not null").groupBy("pattern", "listed_on").agg(F.max("action").alias("action"))
    until = F.lead("listed_on").over(Window.partitionBy("pattern").orderBy("listed_on"))
    return once.withColumn("valid_to", until).where("action <> 'clear'").withColumnRenamed("listed_on", "valid_from")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Per capture (page_id, url, fetched_at): verdict (an action, `none`, `unparsed` without a host, `undated` without a
    time), the pattern that decided and the date since which it holds. Repeated captures give as many rows.

    The list is stored first, so that Spark knows its size: a small one is broadcast, a large one is
    joined by pattern, and the partitions of a host with many captures can be split, as the join's other side
    has at most one active interval for a pattern and time. Patterns travel with a number of the capture, not with its URL.
    """
    stage = Stage(captures.sparkSession, "urls")
    active = stage.put(intervals(entries), "intervals")
    rows = stage.put(captures.select("page_id", "url", "fetched_at", F.monotonically_increasing_id().alias("_row")), "captures")
    seen = rows.where("fetched_at is not null").select("_row", "fetched_at", F.explode(patterns(F.col("url"))).alias("_p"))
    seen = seen.select("_row", "fetched_at", F.col("_p.pattern").alias("pattern"), F.col("_p.specificity").alias("_s"))
    covered = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = seen.join(active, (seen["pattern"] == active["pattern"]) & covered).select("_row", F.struct(F.col("_s"), "action", active["pattern"].alias("pattern"), "valid_from").alias("_hit"))
    best = hits.groupBy("_row").agg(F.max("_hit").alias("_hit"))
    verdict = F.when(host(F.col("url")).isNull(), "unparsed").when(F.col("fetched_at").isNull(), "undated").otherwise(F.coalesce("_hit.action", F.lit("none")))
    return rows.join(best, "_row", "left").select("page_id", "url", "fetched_at", verdict.alias("verdict"), F.col("_hit.pattern").alias("pattern"), F.col("_hit.valid_from").alias("listed_on"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages name no time of capture; the page's number gives it a day of 2024."""
    day = F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts of the pages, by their names' digests: hosts blocked, cleared and blocked again, domains
    blocked and later allowed, sections of hosts allowed."""
    names = pages.select(host(F.col("url")).alias("h")).where("h is not null").distinct()
    digit = lambda x, at, n: F.conv(F.substring(F.md5(x), at, n), 16, 10).cast("int")
    on = lambda days: F.date_add(F.lit("2024-01-01").cast("date"), days)
    h = F.col("h")
    kind, day = digit(h, 1, 2), digit(h, 3, 2)
    part = names.where(~h.rlike(_ADDRESS)).select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("h")).where("h <> ''").distinct()
    row = lambda pattern, action, date: [pattern.alias("pattern"), F.lit(action).alias("action"), date.alias("listed_on")]
    made = [
        names.where(kind % 4 == 0).select(*row(F.concat(F.lit("h:"), h), "block", on(day))),
        names.where(kind % 4 == 0).select(*row(F.concat(F.lit("h:"), h), "clear", on(day + 60))),
        names.where(kind % 8 == 0).select(*row(F.concat(F.lit("h:"), h), "block", on(day + 90))),
        names.where(kind % 3 == 1).select(*row(F.concat(F.lit("p:"), h, F.lit("/en")), "allow", on(day + 30))),
        part.select(*row(F.concat(F.lit("d:"), h), "block", on(day))),
        part.select(*row(F.concat(F.lit("d:"), h), "allow", on(day + 100))),
    ]
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    return out


SQL = r"""
WITH u AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 365)::INT AS fetched_at,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)(?::[0-9]*)?(?:$|([/?#].*))', 1)), '\.$', ''), '') AS h,
    list_filter(string_split(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)(?::[0-9]*)?(?:$|([/?#].*))', 2), '^[^?#]*'), '/'), lambda x: x <> '') AS parts
  FROM pages),
n AS (SELECT DISTINCT h, ('0x' || substr(md5(h), 1, 2))::INT AS kind, ('0x' || substr(md5(h), 3, 2))::INT AS day FROM u WHERE h IS NOT NULL),
d AS (SELECT DISTINCT h, ('0x' || substr(md5(h), 3, 2))::INT AS day FROM (SELECT regexp_extract(h, '([^.]+\.[^.]+)$', 1) AS h FROM n WHERE NOT regexp_matches(h, '^(?:\[.*|[0-9]{1,3}(?:\.[0-9]{1,3}){3})$')) WHERE h <> ''),
e AS (
  SELECT 'h:' || h AS pattern, 'block' AS action, DATE '2024-01-01' + day AS valid_from FROM n WHERE kind % 4 = 0
  UNION ALL SELECT 'h:' || h, 'clear', DATE '2024-01-01' + day + 60 FROM n WHERE kind % 4 = 0
  UNION ALL SELECT 'h:' || h, 'block', DATE '2024-01-01' + day + 90 FROM n WHERE kind % 8 = 0
  UNION ALL SELECT 'p:' || h || '/en', 'allow', DATE '2024-01-01' + day + 30 FROM n WHERE kind % 3 = 1
  UNION ALL SELECT 'd:' || h, 'block', DATE '2024-01-01' + day FROM d
  UNION ALL SELECT 'd:' || h, 'allow', DATE '2024-01-01' + day + 100 FROM d),
i AS (SELECT *, lead(valid_from) OVER (PARTITION BY pattern ORDER BY valid_from) AS valid_to FROM e),
m AS (
  SELECT u.page_id, u.url, u.fetched_at, u.h, i.action, i.pattern, i.valid_from,
    row_number() OVER (PARTITION BY u.page_id, u.url ORDER BY CASE substr(i.pattern, 1, 2) WHEN 'p:' THEN 2000 WHEN 'h:' THEN 1000 ELSE 0 END + length(i.pattern) DESC NULLS LAST) AS r
  FROM u LEFT JOIN i ON i.action <> 'clear' AND u.fetched_at >= i.valid_from AND (i.valid_to IS NULL OR u.fetched_at < i.valid_to)
    AND (i.pattern = 'h:' || u.h OR (i.pattern LIKE 'd:%' AND NOT regexp_matches(u.h, '^(?:\[.*|[0-9]{1,3}(?:\.[0-9]{1,3}){3})$') AND ('.' || u.h) LIKE '%.' || substr(i.pattern, 3)) OR i.pattern = 'p:' || u.h || '/' || u.parts[1]))
SELECT page_id, url, fetched_at::VARCHAR AS fetched_at, CASE WHEN h IS NULL THEN 'unparsed' WHEN fetched_at IS NULL THEN 'undated' ELSE coalesce(action, 'none') END AS verdict,
  pattern, valid_from::VARCHAR AS listed_on FROM m WHERE r = 1
"""
