"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

Rules are few and become one expression.  The list may be long.  Its canonical URLs are summed up in a split-block
Bloom filter: each URL falls into one block of four 64-bit words and sets one bit in every word.  A page whose bits
are not all set is surely not listed.  The others are joined exactly with the list on the canonical URL, which
removes the false positives.  Only column functions and joins are used.

The filter has ``BITS_PER_URL`` bits a URL.  It is broadcast up to ``BROADCAST_BLOCKS`` blocks, a number known from
the count of the list; a larger one is joined by block.  Blocks are dealt by a hash of the URL, so a frequent
host does not gather; one frequent URL is split by Spark's skew join.

A null URL, or one without "://", has an empty host and path, fits no rule and is not listed.  Repeated rows are
judged each; an empty list blocks nothing; other columns, whatever their names, are left out.  Very long URLs are judged whole.

``later_copies`` makes a list from pages: the URLs of those whose article element an earlier page has already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemeter.session import cut

BITS_PER_URL = 16
#: 250,000 blocks of 40 bytes: ten megabytes at most are broadcast.
BROADCAST_BLOCKS = 250_000
_AFTER_SCHEME = r"(?s)^.*?://"
_LOW, _HIGH = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty without "://"."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _LOW, _HIGH)


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One spelling for URLs that lead to the same page; null without "://".

    Scheme, fragment, a leading "www." or "m.", a closing slash or ".html" and tracking parameters go; the host is in lower
    case, the other parameters are sorted.
    """
    host = F.regexp_replace(host_of(url), r"^(www\.|m\.)+", "")
    path = F.regexp_replace(path_of(url), r"(?s)(\.html|/)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"(?s)^(utm_.*|ref=.*)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, tail))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits; a rule is (verdict, "host/path")."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _bits(url: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """Block and the four words' bits of a URL."""
    spread = F.xxhash64(url, F.lit(1))
    words = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return F.pmod(F.xxhash64(url), F.lit(n_blocks)), words


def bloom(listed: DataFrame, url: str, n_blocks: int) -> DataFrame:
    """``block`` and its four words, for a column of canonical URLs."""
    block, words = _bits(F.col(url), n_blocks)
    return (listed.select(block.alias("block"), *[w.alias(f"w{k}") for k, w in enumerate(words)])
            .groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)]))


def article_of(html: Column) -> Column:
    """What the first article element that ends holds, attributes included; null without one."""
    before = F.substring_index(html, "</article>", 1)
    return F.when(F.contains(html, F.lit("</article>")) & F.contains(before, F.lit("<article")), F.substring_index(before, "<article", -1))


def later_copies(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``url`` of every page whose article is also the article of a page with a smaller key.

    Copies meet only in a minimum, which combines map-side; a page then asks by article and key together whether it is the first, so
    an article on a third of all pages gathers nowhere.  Rows without key or article are left out; rows of one key and article are one page.
    """
    articles = (pages.select(pages[key].alias("key"), pages[url].alias("url"), F.sha2(article_of(pages[html]), 256).alias("article"))
                .filter("key IS NOT NULL AND article IS NOT NULL"))
    firsts = articles.groupBy("article").agg(F.min("key").alias("key"))
    return articles.join(firsts, ["article", "key"], "left_anti").select("url")


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, *, key: str = "page_id", url: str = "url", listed_url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` (the rule's, else block if listed, else allow) and ``listed`` of every page."""
    names = cut(listed.select(canonical(F.col(listed_url)).alias("name")).filter("name is not null").distinct())  # counted, summed up and joined
    n_blocks = max(1, names.count() * BITS_PER_URL // 256)
    filter_ = bloom(names, "name", n_blocks)
    if n_blocks <= BROADCAST_BLOCKS:
        filter_ = F.broadcast(filter_)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    seen = (pages.select(pages[key].alias("key"), pages[url].alias("url"))
            .select("key", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("name"))
            .withColumns({"rule": rule, "said": said}))
    block, words = _bits(F.col("name"), n_blocks)
    seen = seen.withColumns({"block": F.coalesce(block, F.lit(-1).cast("long")), **{f"b{k}": w for k, w in enumerate(words)}})
    hit = F.lit(True)
    for k in range(4):
        hit = hit & (F.col(f"w{k}").bitwiseAND(F.col(f"b{k}")) != 0)
    probed = seen.join(filter_, "block", "left").withColumn("possible", F.coalesce(hit, F.lit(False)))
    out = ("key", "host", "path", "rule", "said")
    surely_not = probed.filter(~F.col("possible")).select(*out, F.lit(False).alias("listed"))
    exact = (probed.filter("possible").join(names.withColumn("there", F.lit(True)), "name", "left")
             .select(*out, F.coalesce("there", F.lit(False)).alias("listed")))
    return surely_not.unionAll(exact).select(
        F.col("key").alias(key), "host", "path", "rule",
        F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
