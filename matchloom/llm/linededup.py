"""Line dedup by site-relative frequency, in DataFrame functions only.

Documents are grouped by host. A line counts once per distinct page text; its frequency is the number of the host's
distinct texts holding it divided by the number of its distinct texts, so copies of a page, however many, count as one page
and are left to document dedup. A line is boilerplate and is dropped where its pages exceed the ratio beyond chance: a count of n
may lie `doubt` x sqrt(n) above what is usual, and the rest must still exceed ratio x total. One law for hosts of all sizes: a
large host needs little more than the ratio, a small one more certainty. Near copies have different texts and count each. A line is compared after trimming white space; lines without a word are never boilerplate.

Distribution: each page's distinct line keys are computed once and kept in the shared folder; of equal pages of a host one
is kept, in each task before the shuffle, so a large group of copies is no hot key. The keys become (host, key) pairs whose
partial aggregation shrinks hot lines before the shuffle, and only pairs on pages enough for any host go on. Pages never
travel by host: counting moves hashes only, and each text moves once, to meet the keys to be dropped from it. The drop list joins the pages' keys (a hot key is split by the adaptive skew join), and only
(page, dropped keys) goes on to meet the text. A key is a 64-bit hash compared within one host only, and a page is found
again by a 64-bit hash of host and text with the length, so no text is shuffled for counting.

Defined results: a null host is a host of its own; a null text stays null with zero lines; an empty text is one empty
line; a page whose lines are all dropped keeps an empty text; a line exactly at the limit stays; a very long text is one row,
read whole; repeated rows are all kept; an empty table gives an empty table. Other columns pass through unchanged, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm._spark import cut, numbered

RATIO = 0.05
DOUBT = 1.5
SPACE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """64-bit key of a trimmed line; null for a line without a word."""
    trimmed = F.btrim(line, F.lit(SPACE))
    return F.when(trimmed != "", F.xxhash64(trimmed))


def page_keys(pages: DataFrame, host: str, text: str) -> DataFrame:
    """(host, row, size, distinct line keys) of each page with a text, computed once. Equal pages of a host have equal rows."""
    keys = F.array_distinct(F.transform(F.split(F.col(text), "\n"), line_key))
    return cut(pages.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(F.col(host), F.col(text)).alias("row"), F.length(text).alias("size"), F.filter(keys, lambda k: k.isNotNull()).alias("keys")))


def boilerplate(keyed: DataFrame, totals: DataFrame, ratio: float = RATIO, doubt: float = DOUBT) -> DataFrame:
    """(host, key, pages, total) of each line above the ratio on its host. `totals`: (host, total)."""
    sure = F.col("pages") - F.lit(doubt) * F.sqrt("pages")
    counts = keyed.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")).where(sure > 0)
    t = totals.withColumnRenamed("host", "_host")
    return counts.join(t, counts["host"].eqNullSafe(t["_host"])).where(sure > F.lit(ratio) * F.col("total")).drop("_host")


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, doubt: float = DOUBT, stats: bool = False) -> DataFrame:
    """Pages with boilerplate lines removed from `text`; with `stats`, also `n_lines` and `n_dropped` (as last columns)."""
    names = pages.columns
    pages, (host, text) = numbered(pages, host, text)
    keyed = page_keys(pages, host, text)
    counted = keyed.dropDuplicates(["host", "row", "size"])
    totals = counted.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    drop = boilerplate(counted, totals, ratio, doubt).select(F.col("host").alias("_host"), F.col("key").alias("_key"))
    lines = keyed.select("host", "row", "size", F.explode("keys").alias("key"))
    hits = lines.join(drop, lines["host"].eqNullSafe(drop["_host"]) & (lines["key"] == drop["_key"])).groupBy("row", "size").agg(F.collect_set("key").alias("gone"))
    out = pages.join(hits, (F.xxhash64(F.col(host), F.col(text)) == hits["row"]) & (F.length(text) == hits["size"]), "left")
    gone = F.col("gone")
    all_lines = F.split(F.col(text), "\n")
    kept = F.filter(all_lines, lambda x: ~F.coalesce(F.array_contains(gone, line_key(x)), F.lit(False)))
    new = F.when(gone.isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    columns = [new.alias(c) if c == text else F.col(c) for c in pages.columns]
    if stats:
        n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(all_lines)).cast("long")
        columns += [n.alias("n_lines"), F.when(gone.isNull(), F.lit(0)).otherwise(F.size(all_lines) - F.size(kept)).cast("long").alias("n_dropped")]
        names = [*names, "n_lines", "n_dropped"]
    return out.select(*columns).toDF(*names)


def visible_text(html: Column) -> Column:
    """Text of an HTML page, a line for each block element; scripts, styles, comments and tags go, common entities are decoded."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"[\n\r]+", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|nav|article|footer|header|title|section|table|tr|td|body|head|html)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def url_host(url: Column) -> Column:
    """Lower-cased host of a URL without port or user; null if there is none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.when(h != "", h)
