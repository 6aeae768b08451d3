"""Line dedup by site-relative frequency, with DataFrame functions only.

A line (trimmed) counts once for each page that holds it. Lines whose pages make up more than
``ratio`` of all pages of their host, and at least ``least_pages``, are boilerplate there and are
dropped from its pages; the other lines stay in order, joined as before.

Counts: each page sends a line once, partial sums meet before the shuffle, so a line that a third
of all pages share is one row per task. A host with P pages of L lines on average has at most
L / ratio boilerplate lines; the table of all hosts' lines is broadcast while it has at most
``broadcast_lines`` rows, else pages meet their host's list in a shuffled join. There a host of more
than a ``SPLITS``-th of all pages is dealt out over as many tasks as its share takes, its list copied to each.

Defined results: blank lines are kept and never counted; a null text stays null and has no lines;
a null host is a host of its own; repeated rows are pages of their own; an empty table gives an
empty result; columns of the caller that are called n_lines or n_dropped are replaced. With ``keep_emptied`` a page that consists of boilerplate only stays as it is: such
pages are copies, which copy detection handles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import stored

RATIO = 0.02
LEAST_PAGES = 3
#: A host of more than this part of all pages is dealt out.
SPLITS = 1000


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case without user and port; the empty text if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def html_lines(html: Column) -> Column:
    """Page text, one line for each block: scripts, styles, comments and tags removed."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", "")
    blocks = F.regexp_replace(bare, r"(?i)</?(?:p|div|li|ul|ol|br|h[1-6]|tr|td|th|table|nav|article|section|header|footer|title|head|body|html)(?:\s[^>]*)?/?>", "\n")
    return F.regexp_replace(blocks, r"<[^>]*>", "")


def line_key(line: Column) -> Column:
    """What tells lines apart: 64 and 32 bits of two hash functions, and the length."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"), F.length(line).alias("n"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, key) of boilerplate lines; ``pages``: host and text."""
    named = pages.select(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("nameless"), "text")
    totals = named.groupBy("host", "nameless").agg(F.count("*").alias("pages"))
    lines = F.filter(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x))), lambda x: x != "")
    counts = (
        named.select("host", "nameless", F.explode(F.transform(lines, lambda x: line_key(x))).alias("key"))
        .groupBy("host", "nameless", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    )
    return counts.join(totals, ["host", "nameless"]).where(F.col("n") > ratio * F.col("pages")).select("host", "nameless", "key")


def large_hosts(pages: DataFrame) -> DataFrame:
    """(large_host, salts) of the hosts of more than a SPLITS-th of all pages: fewer than SPLITS rows, whatever the size."""
    counts = stored(pages.groupBy("host").agg(F.count("*").alias("pages")), "host-pages")
    all_pages = counts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    return counts.where(F.col("pages") * SPLITS > all_pages).select(F.col("host").alias("large_host"), F.ceil(F.col("pages") * SPLITS / F.lit(max(1, all_pages))).cast("int").alias("salts"))


def drop_boilerplate(
    pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_lines: int = 200_000, keep_emptied: bool = False
) -> DataFrame:
    """``pages`` (with columns host and text) with text rid of boilerplate, n_lines and n_dropped (of lines not blank)."""
    per_host = boilerplate(pages, ratio, least_pages).groupBy("host", "nameless").agg(F.collect_list("key").alias("keys"))
    per_host = stored(per_host, "boilerplate")
    total = per_host.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    lists = per_host.select(F.col("host").alias("at"), F.col("nameless").alias("no_name"), "keys")
    # The page travels as one column, so none of its names can clash with those made here.
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col("host").alias("page_host"), F.col("text").alias("page_text"))
    same_host = (F.coalesce("page_host", F.lit("")) == F.col("at")) & (F.col("page_host").isNull() == F.col("no_name"))
    if total <= broadcast_lines:
        joined = whole.join(F.broadcast(lists), same_host, "left")
    else:
        salts = large_hosts(pages)
        dealt = whole.join(F.broadcast(salts), F.col("page_host").eqNullSafe(F.col("large_host")), "left").withColumn("salt", F.pmod(F.xxhash64("page_text"), F.coalesce("salts", F.lit(1))).cast("int"))
        copied = lists.join(F.broadcast(salts), F.when(~F.col("no_name"), F.col("at")).eqNullSafe(F.col("large_host")), "left").withColumn("list_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        joined = dealt.drop("large_host", "salts").join(copied.drop("large_host", "salts"), same_host & (F.col("salt") == F.col("list_salt")), "left")
    split = joined.withColumn("all_lines", F.split("page_text", "\n"))
    kept = F.filter("all_lines", lambda x: (F.trim(x) == "") | ~F.array_contains("keys", line_key(F.trim(x))))
    cleaned = split.withColumn("kept_lines", F.when(F.col("keys").isNull(), F.col("all_lines")).otherwise(kept))
    filled = lambda c: F.greatest(F.coalesce(F.size(F.filter(c, lambda x: F.trim(x) != "")), F.lit(0)), F.lit(0)).cast("long")
    counted = cleaned.withColumn("n_lines", filled("all_lines")).withColumn("n_kept", filled("kept_lines"))
    emptied = (F.col("n_kept") == 0) & (F.col("n_lines") > 0) if keep_emptied else F.lit(False)
    out = F.when(emptied, F.col("page_text")).otherwise(F.array_join("kept_lines", "\n"))
    dropped = F.when(emptied, F.lit(0)).otherwise(F.col("n_lines") - F.col("n_kept")).cast("long")
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return counted.select(*[out.alias("text") if c == "text" else F.col(f"page.`{c}`") for c in names], "n_lines", dropped.alias("n_dropped"))


#: DuckDB's form for pages: %(ratio)s and %(least)s are numbers.
PAGES_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:p|div|li|ul|ol|br|h[1-6]|tr|td|th|table|nav|article|section|header|footer|title|head|body|html)(?:\s[^>]*)?/?>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS text
  FROM pages
), r AS (SELECT *, row_number() OVER () AS row FROM p),
l AS (
  SELECT row, host, u.line, u.k FROM r, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k) u
), totals AS (SELECT host, count(*) AS pages FROM r GROUP BY host),
counts AS (SELECT host, trim(line, ' ') AS line, count(DISTINCT row) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL),
bad AS (SELECT host, line FROM counts JOIN totals USING (host) WHERE n >= %(least)s AND n > %(ratio)s * pages),
m AS (SELECT l.*, bad.line IS NOT NULL AS drop FROM l LEFT JOIN bad ON l.host = bad.host AND trim(l.line, ' ') = bad.line),
g AS (
  SELECT row, string_agg(line, chr(10) ORDER BY k) FILTER (NOT drop) AS text, count(*) FILTER (trim(line, ' ') <> '') AS n_lines, count(*) FILTER (drop) AS n_dropped
  FROM m GROUP BY row
)
SELECT page_id, host, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM r LEFT JOIN g USING (row)
"""
