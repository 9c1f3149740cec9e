"""URL block and allow rules that hold for a URL's aliases as well, with DataFrame functions only.

A rule (verdict, host, path) fits a URL on its host or a subdomain whose path starts with the rule's; the longest fitting
rule decides (of equally long rules, allow). A URL that no rule fits takes the verdict of its *equivalence class*: the
connected component over

- all redirects (`<meta http-equiv=refresh ... url=...>`) and canonical links (`<link rel=canonical href=...>`, canonical being any of
  rel's tokens) of the pages, resolved against the page's URL or its `<base href>` if they are not absolute.

URLs that differ only in the fragment or in the letter case of scheme and host are the same URL there; query, path and the rest tell
URLs apart. A class with an explicitly allowed member is allowed (allow goes first), else one with a blocked member is blocked, else
its URLs are allowed. Targets that are no pages themselves take part.

A null URL, or one without `://`, has an empty host and path, fits no rule and is allowed. Null or empty html has no
links. Repeated rows are judged each; other columns are ignored. Targets have their character references decoded; targets of a scheme
without `//` (mailto:, data:) and relative ones of a page whose URL is not absolute make no edge. The SQL knows the first canonical
and the first refresh of a page only, and no path-relative targets; on tables without such links, as the given ones, both agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.shared import discard, materialise

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host part long before any other, so that sizes of rules can be compared by text length.
_AUTHORITY = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
#: Tags that can hold a link; a > in a quoted value doesn't end them.
_TAGS = r"""(?is)<(?:link|meta|base)(?=[\s/"'])(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>"""
_ATTRIBUTE = r"""(?s)[^\s=/"'<>]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
_TARGET = r"""(?is)\burl\s*=\s*(?:"([^"]*)|'([^']*)|([^"'].*))"""
_LOOSE_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
_NUMBERED = "(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _AUTHORITY, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def ruled(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Add rule and rule_verdict, null where none fits, to a table with host and path."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))
    rule = verdict = F
    for v, h, p in ranked:
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    if not ranked:
        rule = verdict = F.lit(None).cast("string")
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def _decoded(text: Column) -> Column:
    """The text with its numbered and XML's named character references decoded, once."""

    def put(done: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, "(?i)^&#x?([0-9a-f]+);$", 1)
        code = F.conv(F.when(F.lower(ref).startswith("&#x"), digits).otherwise(F.conv(digits, 10, 16)), 16, 10).cast("long")
        legal = (code > 0) & (code != 38) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(legal, F.replace(done, ref, F.decode(F.unhex(F.lpad(F.hex(F.when(legal, code).otherwise(63)), 8, "0")), "UTF-32"))).otherwise(done)

    out = F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(_NUMBERED), F.lit(0))), text, put)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(out, "(?i)&(?:amp|#0*38|#x0*26);", "&")


def _attribute(tag: str, name: str) -> Column:
    """Value of a tag's first attribute of this name, as written; null without one."""
    first = F.get(F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: a.rlike(rf"(?is)^{name}\s*=")), F.lit(0))
    return F.regexp_replace(F.regexp_replace(first, r"(?s)^[^=]*=\s*", ""), r"""(?s)^(["'])(.*)\1$""", "$2")


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The kept columns and new ones. The explode keeps the optimizer from writing the new expressions out at each of their uses."""
    made = df.select(*keep, F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("made"))
    return made.select(*keep, *(F.col(f"made.{n}") for n in columns))


def _clean(link: Column) -> Column:
    """A link as URL parsers read it: no white space around it, no line ends or tabs in it, spaces as %20."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(link, r"^\s+|\s+$", ""), r"[\t\r\n]", ""), " ", "%20")


def _without_dots(path: Column) -> Column:
    """A path, beginning with a slash, without its . and .. segments."""
    parts = F.split(path, "/")
    held = F.aggregate(parts, F.array().cast("array<string>"), lambda got, x: F.when(x == "..", F.slice(got, F.lit(1), F.greatest(F.size(got) - 1, F.lit(1)))).when(x == ".", got).otherwise(F.concat(got, F.array(x))))
    return F.concat(F.array_join(held, "/"), F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(""))


def _absolute(link: Column, base: Column) -> Column:
    """The link resolved against an absolute URL; null where that can't be."""
    origin = F.regexp_extract(base, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    at, rest = F.regexp_extract(base, _PATH, 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    steps = F.regexp_extract(link, r"(?s)^([^?#]*)", 1)
    folder = F.when(at == "", F.lit("/")).otherwise(F.regexp_extract(at, "(?s)^(.*/)", 1))
    return (
        F.when(link.rlike(_SCHEME + "//"), link)
        .when(link.rlike(_SCHEME) | (origin == ""), F.lit(None))
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, _SCHEME, 0), link))
        .when(link.startswith("/"), F.concat(origin, _without_dots(steps), rest))
        .when(link.startswith("?"), F.concat(origin, at, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "(?s)#.*$", ""), link))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, steps)), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(url, html) to edges (a, b) from all redirects and canonical links."""
    tags = pages.where("url is not null and html is not null").select("url", F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0)).alias("tags")).where("size(tags) > 0")
    first = F.get(F.filter("tags", lambda t: t.rlike(r"(?is)^<base\b.*\shref\s*=")), F.lit(0))
    each = tags.select("url", first.alias("first"), F.explode("tags").alias("tag")).where(r"tag rlike '(?is)^<link.*canonical|^<meta.*refresh'")
    raw = _once(each, ["url"], base=_attribute("first", "href"), rel=F.when(F.col("tag").rlike("(?i)^<link"), _attribute("tag", "rel")), href=_attribute("tag", "href"), equiv=F.when(F.col("tag").rlike("(?i)^<meta"), _attribute("tag", "http-equiv")), content=_attribute("tag", "content"), loose=F.regexp_extract("tag", _LOOSE_TARGET, 1))
    quoted = F.concat(*(F.regexp_extract("content", _TARGET, i) for i in (1, 2, 3)))
    targets = _once(raw, ["url", "rel", "href", "equiv"], base=_decoded(F.col("base")), content=_decoded(F.col("content")), loose=_decoded(F.col("loose")))
    targets = _once(targets, ["url", "rel", "href", "equiv", "base", "loose"], quoted=quoted)
    target = F.when(F.col("quoted") != "", F.col("quoted")).otherwise(F.col("loose"))
    canonical = _decoded(F.col("rel")).rlike(r"(?is)(?:^|\s)canonical(?:\s|$)")
    link = F.when(canonical, _decoded(F.col("href"))).when(F.lower(F.trim(_decoded(F.col("equiv")))) == "refresh", target)
    found = _once(targets, ["url"], base=_clean(F.col("base")), link=_clean(link)).where("link != ''")
    based = _once(found, ["url", "link"], base=F.coalesce(_absolute(F.col("base"), F.col("url")), "url"))
    return _once(based, ["url"], b=_absolute(F.col("link"), F.col("base"))).select(F.col("url").alias("a"), "b").where("b is not null")


def node(url: Column) -> Column:
    """The name under which a URL takes part in classes: without its fragment, A-Z of scheme and host in lower case."""
    whole = F.regexp_replace(url, r"(?s)^(.*?://[^#]*)#.*$", "$1")
    begin = F.regexp_extract(whole, r"(?s)^(.*?://[^/?]*)", 1)
    return F.concat(F.translate(begin, _UPPER, _LOWER), F.substr(whole, F.length(begin) + 1))


def blocked_nodes(links: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Edges (a, b) between URLs to the nodes (node) of the classes that are blocked: with a blocked member and no allowed one."""
    classes = connected_components(links.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    members = ruled(classes.withColumns({"host": host(F.col("node")), "path": path(F.col("node"))}), rules)
    verdicts = members.groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    return classes.join(verdicts.where("blocked and not coalesce(allowed, false)"), "component").select("node")


#: Blocked nodes of up to this number of bytes are broadcast to the pages; more are joined by a shuffle, hot URLs split by Spark.
BROADCAST_BYTES = 32 << 20


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, url, html) to (page_id, url, host, path, rule, verdict), one row per row."""
    links = materialise(link_edges(pages.select("url", "html")), "links")
    blocked = materialise(blocked_nodes(links, rules), "blocked")
    discard(links)
    size = blocked.agg(F.sum(F.octet_length("node") + 32)).first()[0] or 0
    rows = ruled(pages.select("page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}), rules)
    # a URL that a rule judges needs no class, nor does a null one: they have a key of their own each, that is in no class
    key = F.when(F.col("rule_verdict").isNull() & F.col("url").isNotNull(), node(F.col("url"))).otherwise(F.concat(F.lit("#"), F.monotonically_increasing_id()))
    side = blocked.withColumn("inherited", F.lit("block"))
    judged = rows.withColumn("node", key).join(F.broadcast(side) if size <= BROADCAST_BYTES else side, "node", "left")
    return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", "inherited", F.lit("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with recursive p as (select page_id, url, html, position('://' in coalesce(url, '')) as pos from pages),
n as (select page_id, url, html, case when pos > 0 then substr(url, pos + 3) else '' end as rest, case when pos > 0 then substr(url, 1, pos + 2) else '' end as scheme from p),
s as (select page_id, url, html, scheme, regexp_extract(rest, '^[^/?#]*') as authority, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from n),
l as (select url as a, scheme, authority, unnest([regexp_extract(regexp_extract(html, '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
      regexp_extract(regexp_extract(html, '(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) as link from s where html is not null),
links as (select a, case when link like '%://%' then link when link like '//%' then substr(scheme, 1, length(scheme) - 2) || link when link like '/%' then scheme || authority || link end as b from l where a is not null and link <> ''),
e as (select regexp_replace(a, '(?s)^(.*?://[^#]*)#.*$', '\1') as a, regexp_replace(b, '(?s)^(.*?://[^#]*)#.*$', '\1') as b from links where b is not null),
n2 as (select translate(regexp_extract(a, '(?s)^(.*?://[^/?]*)'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(a, length(regexp_extract(a, '(?s)^(.*?://[^/?]*)')) + 1) as a,
       translate(regexp_extract(b, '(?s)^(.*?://[^/?]*)'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(b, length(regexp_extract(b, '(?s)^(.*?://[^/?]*)')) + 1) as b from e),
both_ways as (select a, b from n2 union select b, a from n2),
v as (select a as url, translate(regexp_extract(substr(a, position('://' in a) + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(a, position('://' in a) + 3), '^[^/?#]*([^?#]*)', 1) as path from both_ways where a like '%://%'
      union select url, host, path from s where url like '%://%'),
r as (select url, host, path,
      case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
           when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
           when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
           when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from v),
reach as (select a as node, a as other from both_ways union select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a),
inherited as (select reach.node, max((r.rule in ('example.net/en/', 'org/fr/'))::int) as allowed, max((r.rule in ('net/', 'example.com/de/'))::int) as blocked
      from reach join r on reach.other = r.url group by reach.node),
w as (select page_id, url, host, path, regexp_replace(url, '(?s)^(.*?://[^#]*)#.*$', '\1') as whole from s)
select s.page_id, s.host, s.path, r.rule,
       case when r.rule in ('net/', 'example.com/de/') then 'block' when r.rule is not null then 'allow' when inherited.blocked = 1 and coalesce(inherited.allowed, 0) = 0 then 'block' else 'allow' end as verdict
from w s left join r on r.url = s.url
left join inherited on inherited.node = translate(regexp_extract(s.whole, '(?s)^(.*?://[^/?]*)'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(s.whole, length(regexp_extract(s.whole, '(?s)^(.*?://[^/?]*)')) + 1)
"""
