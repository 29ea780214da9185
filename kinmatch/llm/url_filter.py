"""URL filters against dated lists: validity intervals and an as-of join, in DataFrame functions only.

List events (kind, pattern, category, action, listed_on) say when a pattern came onto a list (add) or
left it (remove). Per pattern and category they become intervals [from, to) in which the entry is
active; a repeated add or remove changes nothing, and of events on one day the add comes last. A
capture is evaluated against the entries active when it was fetched: its host and every parent
domain (kind ``domain``) and its host with every leading path (kind ``prefix``).

Intervals are dealt out by the months they touch, so a capture meets only the entries of its own
month whatever the length of a pattern's history. Equal captures are one row in the join, so a hot host is
as many rows as it has distinct URLs and times.

Defined cases: a null URL, one without host, or a null fetch time matches nothing; events with a null field
are ignored; repeated captures are kept and decided alike; an empty list blocks nothing, an empty table gives no rows; of
a URL of any length as many path steps are looked up as some listed prefix has; columns of the
captures that bear an added name are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ADDED = ("host", "n_active", "blocked", "categories", "active_since")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))
    return F.when(host != "", host)


def intervals(events: DataFrame) -> DataFrame:
    """(kind, pattern, category, from, to) in which an entry is active; ``to`` null: still active."""
    of_entry = Window.partitionBy("kind", "pattern", "category").orderBy("listed_on", F.col("action") == "add")
    clean = events.select("kind", F.lower("pattern").alias("pattern"), "category", "action", F.col("listed_on").cast("date").alias("listed_on")).dropna()
    turns = clean.withColumn("before", F.lag("action", 1, "remove").over(of_entry)).where("action <> before")
    spans = turns.withColumn("to", F.lead("listed_on").over(of_entry)).where("action = 'add'")
    return spans.select("kind", "pattern", "category", F.col("listed_on").alias("from"), "to").where("to is null or to > from")


def _candidates(captures: DataFrame, deepest: int) -> DataFrame:
    """A row for each pattern that could list a capture; ``deepest``: path steps of the longest listed prefix."""
    labels = F.split("host", F.lit(r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    path = F.regexp_extract("url", r"^[^:]*://[^/?#\\]*([^?#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(
        F.when((F.size(steps) > 0) & (F.lit(deepest) > 0), F.sequence(F.lit(1), F.least(F.size(steps), F.lit(max(1, deepest))))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", F.col("host"), F.array_join(F.slice(steps, 1, i), "/")).alias("pattern")),
    )
    return captures.select("url", "at", F.explode(F.concat(domains, prefixes)).alias("p")).select("url", "at", "p.kind", F.lower("p.pattern").alias("pattern"))


def filter_urls(captures: DataFrame, events: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """Captures with host, n_active, blocked, categories (sorted, by comma) and active_since."""
    named = captures.drop(*[c for c in ADDED if c in captures.columns])
    asked = named.select(F.col(url).alias("url"), F.col(fetched_at).cast("timestamp").alias("at")).dropna().distinct().withColumn("host", host_of(F.col("url"))).where("host is not null")
    months = asked.agg(F.min(F.trunc("at", "MM")).alias("first"), F.max(F.trunc("at", "MM")).alias("last")).first()
    active = intervals(events)
    first, last = F.lit(months["first"]).cast("date"), F.lit(months["last"]).cast("date")
    begin, end = F.greatest(F.trunc("from", "MM"), first), F.least(F.trunc(F.coalesce(F.date_sub("to", 1), last), "MM"), last)
    by_month = active.withColumn("month", F.explode(F.when(begin <= end, F.sequence(begin, end, F.expr("interval 1 month")))))
    deepest = active.where("kind = 'prefix'").agg(F.max(F.size(F.split("pattern", "/"))) - 1).first()[0] or 0
    keyed = _candidates(asked, deepest).withColumn("month", F.trunc("at", "MM"))
    met = keyed.join(by_month, ["kind", "pattern", "month"]).where("at >= from and (to is null or at < to)")
    decided = met.groupBy("url", "at").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.min("from").alias("active_since"))
    own = [x + "_" * max(map(len, captures.columns)) for x in ("url", "at")]  # longer than any name there is
    out = named.withColumn("host", host_of(F.col(url))).withColumn(own[0], F.col(url)).withColumn(own[1], F.col(fetched_at).cast("timestamp"))
    out = out.join(decided.withColumnsRenamed({"url": own[0], "at": own[1]}), own, "left").drop(*own)
    return out.withColumn("n_active", F.coalesce("n_active", F.lit(0))).withColumn("blocked", F.col("n_active") > 0).withColumn("categories", F.coalesce("categories", F.lit("")))


#: The tables have neither fetch times nor lists, so the query derives both: a page is fetched in the
#: 730 days from this date on, by its id; lists are derived of all hosts and first path steps.
FIRST_DAY, DAYS = "2023-01-01", 730


def derived_events(pages: DataFrame) -> DataFrame:
    """List events of hosts and prefixes that the md5 of the pattern selects: on, off, and on again."""
    host = host_of(F.col("url"))
    step = F.regexp_extract("url", r"^[^:]*://[^/?#\\]*/([^/?#]+)", 1)
    patterns = pages.select(F.explode(F.array(F.struct(F.lit("domain").alias("kind"), host.alias("pattern")), F.struct(F.lit("prefix").alias("kind"), F.when(step != "", F.concat(host, F.lit("/"), step)).alias("pattern")))).alias("p")).select("p.*").dropna().distinct()
    n = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")
    chosen = patterns.withColumn("n", n).where("n % 3 = 0").withColumn("category", F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), (F.col("n") % 7 % 3 + 1).cast("int")))
    day = lambda k: F.date_add(F.lit(FIRST_DAY).cast("date"), k.cast("int"))
    on, off = F.col("n") % 500, F.col("n") % 500 + 30 + F.col("n") % 90
    again = F.when(F.col("n") % 2 == 0, "add").otherwise("remove")
    dated = F.array(*[F.struct(action.alias("action"), day(k).alias("listed_on")) for action, k in ((F.lit("add"), on), (F.lit("remove"), off), (again, off + 60))])
    return chosen.select("kind", "pattern", "category", F.explode(dated).alias("e")).select("kind", "pattern", "category", "e.action", "e.listed_on")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as of its fetch time."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(DAYS)).cast("int"))
    out = filter_urls(pages.withColumn("fetched_at", fetched), derived_events(pages))
    return out.select("page_id", "url", "host", F.col("fetched_at").cast("string").alias("fetched_on"), "n_active", "blocked", "categories", F.col("active_since").cast("string").alias("active_since"))


ORACLE_SQL = {
    "op8_url_filter": r"""
with pages1 as (
  select page_id, url, nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')), '') as host,
         regexp_extract(url, '^[^:]*://[^/?#\\]*([^?#]*)', 1) as path, regexp_extract(url, '^[^:]*://[^/?#\\]*/([^/?#]+)', 1) as step,
         date '2023-01-01' + (page_id % 730)::int as seen from pages),
patterns as (select distinct kind, pattern from (
  select 'domain' as kind, host as pattern from pages1 union all
  select 'prefix', host || '/' || nullif(step, '') from pages1) where pattern is not null),
chosen as (select *, case n % 7 % 3 when 0 then 'adult' when 1 then 'malware' else 'spam' end as category
  from (select *, ('0x' || substr(md5(pattern), 1, 6))::bigint as n from patterns) where n % 3 = 0),
events as (
  select kind, lower(pattern) as pattern, category, 'add' as action, date '2023-01-01' + (n % 500)::int as d from chosen union all
  select kind, lower(pattern), category, 'remove', date '2023-01-01' + (n % 500 + 30 + n % 90)::int from chosen union all
  select kind, lower(pattern), category, case when n % 2 = 0 then 'add' else 'remove' end, date '2023-01-01' + (n % 500 + 90 + n % 90)::int from chosen),
asked as (
  select page_id, seen, 'domain' as kind, array_to_string(list_slice(string_split(host, '.'), i, 99), '.') as pattern
  from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as i from pages1 where host is not null) union all
  select page_id, seen, 'prefix', lower(host || '/' || array_to_string(list_slice(s, 1, i), '/'))
  from (select *, unnest(range(1, len(s) + 1)) as i from (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as s from pages1 where host is not null))),
entries as (select distinct kind, pattern, category from events),
state as (
  select a.page_id, e.category, arg_max(v.action, (v.d, v.action = 'add')) as action,
         max(v.d) filter (where v.action = 'add') as since
  from asked a join entries e on a.kind = e.kind and a.pattern = e.pattern
  join events v on v.kind = e.kind and v.pattern = e.pattern and v.category = e.category and v.d <= a.seen
  group by a.page_id, a.kind, a.pattern, e.category),
decided as (select page_id, count(*) as n, array_to_string(list_sort(list_distinct(list(category))), ',') as categories, min(since) as since from state where action = 'add' group by page_id)
select p.page_id, p.url, p.host, p.seen::date::varchar as fetched_on, coalesce(d.n, 0) as n_active, d.n is not null as blocked,
       coalesce(d.categories, '') as categories, d.since::date::varchar as active_since
from pages1 p left join decided d on p.page_id = d.page_id
""",
}
