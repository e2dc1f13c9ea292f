"""URL filter with redirect equivalence.

Rules decide by host and path. Pages that redirect to, or name as their canonical link, another URL are aliases of it, and
connected components over these links are computed by joins. A URL that no rule decides takes the block of an alias, unless
an alias is explicitly allowed; otherwise it is allowed. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xmseq.llm.store import components
from xmseq.storage import pin

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?i)<(?:link|meta)\b[^>]*>"
#: Fixed values of HTML: characters by number and by name. The last is decoded last, so that nothing is decoded twice.
NUMBERED = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(rest: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """A URL without scheme and fragment, its host in lower case; null without `://`."""
    rest = after_scheme(url)
    return F.concat(host_of(rest), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


def decoded(text: Column) -> Column:
    """The text of an attribute with `&amp;`, `&lt;`, `&gt;`, `&quot;`, `&apos;` and numbered ASCII characters decoded, once."""

    def character(mark: Column) -> Column:
        plain, other = F.regexp_extract(mark, r"^&#0*([0-9]{1,3});$", 1), F.regexp_extract(mark, r"^&#[xX]0*([0-9a-fA-F]{1,2});$", 1)
        code = F.coalesce(F.nullif(plain, F.lit("")).cast("int"), F.conv(F.nullif(other, F.lit("")), 16, 10).cast("int"))
        return named_once(code, lambda n: F.when(n == 38, "&amp;").when((n > 0) & (n < 128), F.char(n)).otherwise(mark))

    def plain_text(raw: Column) -> Column:
        found = F.regexp_extract_all(raw, F.lit(NUMBERED), F.lit(0))
        out = F.aggregate(found, raw, lambda s, mark: F.replace(s, mark, character(mark)))
        for mark, letter in NAMED:
            out = F.replace(out, F.lit(mark), F.lit(letter))
        return out

    return named_once(text, plain_text)


def named_once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with `value` worked out once, however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def without_dots(path: Column) -> Column:
    """A path without `.` and `..` segments: the latter takes the one before it along, if there is one."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.lit(""),
        lambda s, part: F.when(part == ".", s).when(part == "..", F.regexp_replace(s, "/[^/]*$", "")).otherwise(F.concat(s, F.lit("/"), part)),
    )
    last = F.element_at(parts, -1)
    tidy = F.concat(kept, F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), tidy).otherwise(path)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or not; empty if the tag has none."""
    pattern = rf"(?i)[\s\"']{name}{VALUE}"
    return decoded(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))


def target_of(tag: Column) -> Column:
    """URL a tag points at: the canonical link, or the target of a refresh; null for other tags."""
    canonical = F.array_contains(F.split(F.lower(F.trim(attribute(tag, "rel"))), r"\s+"), "canonical")
    refresh = F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh"
    later = F.regexp_extract(attribute(tag, "content"), r"""(?i);\s*url\s*=\s*['"]?([^'"]*)""", 1)
    target = F.trim(F.when(canonical, attribute(tag, "href")).when(refresh, later))
    return F.when(target != "", target)


def with_target(links: DataFrame, name: str) -> DataFrame:
    """Add to rows of (url, target) the target as a whole URL, seen from the page and without dot segments.

    Step by step: each one names the last several times.
    """
    target, url = F.col("target"), F.col("url")
    seen = links.withColumn("_rest", after_scheme(url))
    seen = seen.select("*", host_of(F.col("_rest")).alias("_host"), path_of(F.col("_rest")).alias("_path"))
    site = F.concat(F.lit("http://"), "_host")
    folder = F.regexp_extract("_path", r"^(.*/)?", 0)
    whole = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, "_path", target))
        .when(target.startswith("#"), url)
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )
    far = seen.withColumn("_whole", whole).withColumn("_far", after_scheme(F.col("_whole")))
    parts = far.select("*", host_of(F.col("_far")).alias("_to"), path_of(F.col("_far")).alias("_way"))
    more = F.regexp_extract("_far", r"^[^?#]*(.*)$", 1)
    return parts.withColumn(name, F.concat(F.lit("http://"), "_to", without_dots(F.col("_way")), more)).select(*links.columns, name)


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a table, for rules that fit into a query."""
    names = ("verdict", "host", "path")
    rows = [F.struct(*[F.lit(x).alias(c) for c, x in zip(names, r, strict=True)]) for r in rules]
    table = F.array(*rows) if rows else F.array().cast("array<struct<verdict: string, host: string, path: string>>")
    return spark.range(1).select(F.inline(table))


def decided(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: key, host, path, one row per key. Gives those that a rule fits, with rule and verdict of the longest one.

    Rules and URLs meet by host: a host is looked up together with all domains it belongs to, so there may be any number of
    rules. Of rules of one length the first in the order of the alphabet wins, and block before allow.
    """
    # a.b.c belongs to a.b.c, b.c and c.
    labels = F.split("host", r"\.")
    places = F.sequence(F.lit(1), F.size(labels))
    domains = F.transform(places, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("key", "path", F.explode(domains).alias("host"))
    named = rules.select("host", F.col("path").alias("_path"), F.concat("host", "path").alias("rule"), "verdict")
    fits = asked.join(named, "host").where(F.col("path").startswith(F.col("_path")))
    order = F.struct((-F.length("rule")).alias("n"), "rule", (F.col("verdict") != "block").alias("v"), "verdict")
    best = fits.groupBy("key").agg(F.min(order).alias("best"))
    return best.select("key", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, host, path, rule, verdict, alias, the smallest URL of its component.

    rules: verdict (allow or block), host, path. A rule fits its host and all subdomains where the path starts with the
    rule's; the longest wins. Without a rule the verdict is block if an alias is blocked by a rule and none is allowed by
    one, else allow. A url that is null or has no `://` has an empty host and path, no rule and no aliases, and is allowed.
    Null html has no links. Targets are decoded and freed of dot segments, as a browser does. Repeated rows are judged alike; other columns are ignored.
    """
    rest = after_scheme(F.col("url"))
    parts = [host_of(rest).alias("host"), path_of(rest).alias("path"), key_of(F.col("url")).alias("key")]
    targets = F.transform(F.regexp_extract_all("html", F.lit(TAG), F.lit(0)), target_of)
    targets = F.coalesce(F.array_compact(targets), F.array().cast("array<string>"))
    seen = pin(pages.select("page_id", "url", *parts, targets.alias("targets")), "pages")
    named = seen.where("key is not null")
    links = named.select("key", F.explode("targets").alias("target"), "url")
    links = with_target(links, "to")
    links = pin(links.select("key", "to", key_of(F.col("to")).alias("other")).where("other is not null"), "page-links")
    far = after_scheme(F.col("to"))
    nodes = named.select("key", "host", "path").unionByName(
        links.select(F.col("other").alias("key"), host_of(far).alias("host"), path_of(far).alias("path"))
    )
    rule_of = pin(decided(nodes.distinct(), rules), "decided")
    groups = components(links, "key", "other").withColumnRenamed("node", "key")
    groups = pin(groups, "aliases")
    spoken = groups.join(rule_of, "key").groupBy("component").agg(
        F.bool_or(F.col("verdict") == "block").alias("blocked"), F.bool_or(F.col("verdict") == "allow").alias("allowed")
    )
    inherited = groups.join(spoken, "component").where("blocked and not allowed").select("key", F.lit(True).alias("inherits"))
    # Each of these tables grows with the pages.
    rows = seen
    for found in (rule_of, groups, inherited):
        rows = rows.join(found.hint("merge"), "key", "left")
    verdict = F.coalesce("verdict", F.when(F.col("inherits"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "key").alias("alias"))
