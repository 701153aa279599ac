"""Web sources as DataFrames: feeds, page snapshots, link targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.storage import broadcast_small


def feed_items(items: DataFrame, keywords: list[str], lookback_days: int) -> DataFrame:
    """Items no older than the look-back whose lower-cased title has any keyword; without keywords all titles pass."""
    recent = items.where(F.col("age_days") <= lookback_days)
    if not keywords:
        return recent
    return recent.where(reduce(lambda a, b: a | b, (F.lower("title").contains(k.lower()) for k in keywords)))


def since_last_check(items: DataFrame, checks: DataFrame, lookback_days: int = 23) -> DataFrame:
    """items (source, published) no older than the look-back before their source's last check (checks: source, last_check);
    a source that was never checked takes those of the look-back before now."""
    start = F.coalesce("last_check", F.localtimestamp()) - F.expr(f"INTERVAL {int(lookback_days)} DAYS")
    met = look_up_left(items, checks, "source")
    return met.where(F.col("published") >= start).select(*items.columns)


def look_up_left(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows with what found says of their key, one row a key, or nulls; Spark splits a key that many rows share."""
    return rows.join(broadcast_small(found), key, "left")


def unescaped(text: Column) -> Column:
    """Text with numeric and the five named character references resolved, each once."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(x?[0-9A-Fa-f]{1,6});"), F.lit(1)))

    def put(value: Column, code: Column) -> Column:
        number = F.when(code.startswith("x"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(F.conv(code, 10, 10)).cast("long")
        known = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF) & (number != 38)
        return F.when(known, F.replace(value, F.concat(F.lit("&#"), code, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))).otherwise(value)

    value = F.aggregate(codes, text, put)
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#38;", "&"), ("&amp;", "&")):
        value = F.replace(value, F.lit(code), F.lit(char))
    return value


def page_changes(snapshots: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Snapshots whose hash differs from the one before; a key's first snapshot is a change from nothing."""
    by = Window.partitionBy(key).orderBy(order)
    hashed = snapshots.withColumn("new_hash", F.sha2(content, 256)).withColumn("old_hash", F.lag("new_hash").over(by))
    return hashed.where(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("new_hash")))


def read_feed(feeds: DataFrame, url: str = "url", xml: str = "xml") -> DataFrame:
    """(url, title, link, published, description, enclosure) of the items of RSS and Atom texts, in order.

    Ampersands that begin no entity are repaired first. An item without text fields has nulls; a text that isn't XML
    gives no items.
    """
    repaired = F.regexp_replace(xml, "&(?!(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z]+);)", "&amp;")
    items = F.regexp_extract_all(repaired, F.lit("(?s)<(?:item|entry)[ >].*?</(?:item|entry)>"), F.lit(0))
    i = feeds.select(F.col(url).alias("url"), F.posexplode(items).alias("place", "item"))

    def text(*tags: str) -> Column:
        found = [F.regexp_extract("item", f"(?s)<{t}(?: [^>]*)?>(?:<!\\[CDATA\\[)?(.*?)(?:\\]\\]>)?</{t}>", 1) for t in tags]
        return unescaped(F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in found]))

    def attribute(tag: str, name: str, with_: str = "") -> Column:
        return unescaped(F.nullif(F.regexp_extract("item", f'<{tag}\\b{with_}[^>]*\\b{name}="([^"]*)"', 1), F.lit("")))

    # an entry's own page, then a link that doesn't say what it is, then any
    page = [attribute("link", "href", w) for w in ('(?=[^>]*\\brel="alternate")', "(?![^>]*\\brel=)", "")]
    return i.select("url", "place", text("title").alias("title"), F.coalesce(text("link"), *page).alias("link"), text("pubDate", "published", "updated").alias("published"), text("description", "summary", "content").alias("description"), attribute("enclosure", "url").alias("enclosure"))
