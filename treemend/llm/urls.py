"""URL filters by a temporal list join, in DataFrame operations.

A list is a log of dated entries: a key is added or dropped on a day. Per key
the log becomes validity intervals. A capture is judged as of its fetch day: a
key matches if it is one of the capture's own keys (its host, a parent domain,
or host and leading path) and an interval of it holds the day. Intervals and
captures meet on (key, month), so a host with a third of all captures spreads
over time, and only distinct (URL, day) pairs are judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treemend.llm.common import prepare

# Path segments after the host in keys that are derived from URLs. Captures are judged with as many as the list's longest key has.
PATH_SEGMENTS = 3
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::\d*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    """Path without query and fragment, no slash at either end."""
    path = F.regexp_extract(url.cast("string"), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r"^/+|/+$", "")


def list_key(key: Column) -> Column:
    """A list's key as ``keys_of`` gives it: the host in lower case, the path after the first slash as it is."""
    host = F.substring_index(key, "/", 1)
    return F.concat(F.lower(host), F.substr(key, F.length(host) + 1))


def keys_of(host: Column, path: Column, most: int = PATH_SEGMENTS) -> Column:
    """Host, parent domains of two labels or more, and host with one to ``most`` leading path segments."""
    labels, segments = F.split(host, r"\."), F.split(path, "/+")
    from_end = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), from_end)
    lead = lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/"))
    paths = F.transform(F.sequence(F.lit(1), F.least(F.size(segments), F.lit(max(1, most)))), lead)
    return F.when(host == "", F.array().cast("array<string>")).when((path == "") | F.lit(most < 1), domains).otherwise(F.array_distinct(F.concat(domains, paths)))


def validity(entries: DataFrame) -> DataFrame:
    """key, category, valid_from, valid_to (exclusive) from (key, category, day, action ``add`` or ``drop``).

    The last entry of a day counts (``drop`` over ``add``); an add while the key
    is listed, or a drop while it is not, changes nothing. Entries with a null
    key, day or action are void; a null category is ''. Keys that differ in
    the case of the host only are one key; paths keep their case.
    """
    log = entries.where("key IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'drop')").groupBy(
        list_key(F.col("key").cast("string")).alias("key"), F.coalesce("category", F.lit("")).alias("category"), F.col("day").cast("date").alias("day")
    ).agg(F.max("action").alias("action"))
    order = Window.partitionBy("key", "category").orderBy("day")
    changes = log.withColumn("_was", F.lag("action").over(order)).where("action <> coalesce(_was, 'drop')")
    spans = changes.withColumn("valid_to", F.coalesce(F.lead("day").over(order), F.lit(FOREVER).cast("date")))
    return spans.where("action = 'add'").select("key", "category", F.col("day").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All columns of ``captures`` in the struct ``row``, with n_hits, reasons and blocked.

    ``captures`` have (url, fetched); reasons are the sorted category:key pairs
    active on the fetch day, comma-joined. Null URLs, URLs without a host and
    captures without a day match nothing and are not blocked. Repeated rows
    get the same verdict each.
    """
    prepare(captures.sparkSession)
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row"), F.col("url").cast("string").alias("_url"), F.col("fetched").cast("date").alias("_day"))
    month = lambda d: F.year(d) * 12 + F.month(d)
    # the longest path of the list: one number
    most = entries.agg(F.max(F.size(F.split(F.col("key").cast("string"), "/+")) - 1)).first()[0] or 0
    distinct = rows.select("_url", "_day").where("_url IS NOT NULL AND _day IS NOT NULL").distinct()
    keyed = distinct.withColumn("_host", host_of(F.col("_url"))).select("_url", "_day", month(F.col("_day")).alias("_month"), F.explode(keys_of(F.col("_host"), path_of(F.col("_url")), most)).alias("key"))
    spans = validity(entries)
    # no interval needs months before the first or after the last capture: two numbers
    ends = captures.agg(F.min("fetched").cast("date").alias("a"), F.max("fetched").cast("date").alias("b")).first()
    spans = spans.where((F.col("valid_from") <= F.lit(ends["b"]).cast("date")) & (F.col("valid_to") > F.lit(ends["a"]).cast("date")))
    first, last = F.greatest("valid_from", F.lit(ends["a"]).cast("date")), F.least("valid_to", F.lit(ends["b"]).cast("date"))
    spans = spans.withColumn("_month", F.explode(F.sequence(month(first), month(last))))
    hits = keyed.join(spans, ["key", "_month"]).where("valid_from <= _day AND _day < valid_to")
    verdict = hits.groupBy("_url", "_day").agg(F.array_sort(F.collect_set(F.concat_ws(":", "category", "key"))).alias("_r"))
    return rows.join(verdict, ["_url", "_day"], "left").select(
        "row", F.coalesce(F.size("_r"), F.lit(0)).alias("n_hits"), F.coalesce(F.array_join("_r", ","), F.lit("")).alias("reasons"),
        F.col("_r").isNotNull().alias("blocked"),
    )
