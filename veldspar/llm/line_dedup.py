r"""Line deduplication by site-relative frequency, in DataFrame expressions only.

Pages are grouped by host.  For each line the number of the host's pages that contain it is divided by
the number of the host's pages; lines over RATIO are boilerplate and dropped from every page of that host.  A line of one page only repeats nothing and stays, whatever
the ratio, so a host of one page keeps all.

A page's lines are found once and written.  Its distinct lines are counted once each, pre-aggregated per task by (host, line).  What a host
keeps as boilerplate is bounded: at most (mean distinct lines of a page) / RATIO lines, so its set fits
beside each page; a host with a third of all pages is split by the skew-join rule.  Of that set a page's own part is found by hashing.

Lines of HTML: comments, scripts and styles go, to the page's end if they have none; inline tags go, any other tag and each line break ends a
line; a < with no > after it is text; lines are trimmed of white space (20, 09-0D) and empty ones dropped.  Two lines are the same when their MD5 is.

Cases: null html has no lines; a null or hostless url is the host ''; hosts are lower-cased; repeated rows count as pages;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

RATIO = 0.3
MIN_PAGES = 2
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
INLINE = r"(?i)</?(a|abbr|b|code|em|font|i|mark|q|s|small|span|strong|sub|sup|u)(\s[^>]*)?>"
TAG = r"<[^>]*>"
#: The host of a URL, after a user's name and password.
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]+)"
SPACE = " \t\n\x0b\x0c\r"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def with_lines(pages: DataFrame, html: str) -> DataFrame:
    """pages with `lines` in the place of the column html.

    Every < before the page's last > has an end, and nothing after it has: so no search for an end runs in vain.
    """
    out = pages.withColumn(html, F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n"))
    out = out.withColumn("tail", F.substring_index(html, ">", -1))
    out = out.withColumn("head", F.substring(html, F.lit(1), F.length(html) - F.length("tail")))
    bare = F.concat(F.regexp_replace(F.regexp_replace("head", INLINE, ""), TAG, "\n"), "tail")
    lines = F.transform(F.split(bare, r"[\r\n]+"), lambda x: F.btrim(x, F.lit(SPACE)))
    return out.withColumn("lines", F.filter(lines, lambda x: x != "")).drop(html, "head", "tail")


def key_of(line: Column) -> Column:
    return F.md5(line.cast("binary"))


def boilerplate(lined: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """Of rows (host, keys): host and its boilerplate keys."""
    # Totals and frequent lines are written before they are joined and grouped, so that the join on a very large host can be split.
    pages = materialise(lined.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")), "line-hosts")
    counts = lined.select("host", F.explode(F.array_distinct("keys")).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("on_pages"))
    often = counts.filter(F.col("on_pages") >= min_pages).join(pages, "host").filter(F.col("on_pages") > F.lit(ratio) * F.col("host_pages"))
    often = materialise(often.select("host", "key"), "line-frequent")
    return often.groupBy("host").agg(F.collect_list("key").alias("dropped"))


def line_dedup(pages: DataFrame, *, ratio: float = RATIO, min_pages: int = MIN_PAGES, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """page_id, host, n_lines, n_dropped, text: one row per row of pages; text joins the lines that stay by line breaks."""
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    lined = materialise(with_lines(rows, "html"), "line-lines")
    keys = F.transform("lines", key_of)
    # Written, so that the plan knows its size: small sets are broadcast and pages not shuffled, large ones joined by host.
    common = materialise(boilerplate(lined.select("host", keys.alias("keys")), ratio, min_pages), "line-boilerplate")
    none = F.array().cast("array<string>")
    rows = lined.join(common, "host", "left").withColumn("own", F.array_intersect(keys, F.coalesce("dropped", none)))
    kept = F.when(F.size("own") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("own"), key_of(x))))
    rows = rows.withColumn("kept", kept)
    return rows.select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


ORACLE_SQL = r"""
WITH bare AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]+)', 1)) AS host,
    regexp_replace(coalesce(html, ''), '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', chr(10), 'g') AS html
  FROM pages),
cut AS (SELECT page_id, host, html, CASE WHEN contains(html, '>') THEN len(html) - instr(reverse(html), '>') + 1 ELSE 0 END AS last FROM bare),
lined AS (
  SELECT page_id, host, list_filter(list_transform(regexp_split_to_array(
      regexp_replace(regexp_replace(substr(html, 1, last), '(?i)</?(a|abbr|b|code|em|font|i|mark|q|s|small|span|strong|sub|sup|u)(\s[^>]*)?>', '', 'g'), '<[^>]*>', chr(10), 'g')
      || substr(html, last + 1), '[\r\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS lines
  FROM cut),
hosts AS (SELECT host, count(*) AS n FROM lined GROUP BY host),
often AS (SELECT l.host, l.line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) l JOIN hosts USING (host)
  GROUP BY l.host, l.line, hosts.n HAVING count(*) >= 2 AND count(*) > 0.3 * hosts.n),
sets AS (SELECT host, list(line) AS dropped FROM often GROUP BY host),
kept AS (SELECT l.*, list_filter(lines, lambda x: NOT list_contains(coalesce(dropped, []), x)) AS k FROM lined l LEFT JOIN sets USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(k) AS BIGINT) AS n_dropped, sha256(array_to_string(k, chr(10))) AS kept_sha256 FROM kept
"""
