"""URL columns. Each identity rule is a function of its own, as sources disagree on what makes a page the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import SHARED_HOSTS

_SHAPE = "^(https?)://([^/?#\\\\\\s]+)([^?#]*)(\\?[^#]*)?(#.*)?$"


def part(url: Column, group: int) -> Column:
    """Scheme 1, authority 2, path 3, query with its mark 4, fragment with its mark 5; empty for no web URL."""
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), "(?i)" + _SHAPE, group)


def is_web(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike("(?i)" + _SHAPE), F.lit(False))


def host(url: Column) -> Column:
    """The lower-case host, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), ":\\d*$", ""))


def _params(url: Column) -> Column:
    return F.filter(F.split(F.substring(part(url, 4), 2, (1 << 31) - 1), "&", -1), lambda p: p != "")


def _without_tracking(params: Column) -> Column:
    return F.filter(params, lambda p: ~F.lower(p).rlike("^(?:utm_[^=]*|fbclid|gclid)(?:=|$)"))


def canonical(url: Column) -> Column:
    """Lower scheme and host, no tracking parameters, blank values and fragment kept; null for no web URL.

    Parameters without a value get an empty one. Percent escapes stay as they are.
    """
    kept = F.transform(_without_tracking(_params(url)), lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    fragment = F.when(part(url, 5) == "#", "").otherwise(part(url, 5))
    return F.when(is_web(url), F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, query, fragment))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def split(url: Column) -> Column:
    """A struct of scheme (lower-case), authority, path, query and fragment, each empty where absent (RFC 3986, appendix B)."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^[\\x00-\\x20]+", ""), "[\\t\\r\\n]", "")
    shape = "(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"
    names = ("scheme", "authority", "path", "query", "fragment")
    return let(text, lambda u: F.struct(*((F.lower(F.regexp_extract(u, shape, i)) if n == "scheme" else F.regexp_extract(u, shape, i)).alias(n) for i, n in enumerate(names, 1))))


def unsplit(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    """The URL of its parts; empty ones leave no mark."""
    led = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x)).otherwise("")
    rooted = F.when((authority != "") & (path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), led("//", authority), rooted, led("?", query), led("#", fragment))


def walked(segments: Column) -> Column:
    """Path segments after ``.`` and ``..``: a fold with the segments so far as its stack; ``..`` at the root goes nowhere."""
    none = F.array().cast("array<string>")
    return F.aggregate(
        segments,
        none,
        lambda stack, x: F.when(x == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).when(x == ".", stack).otherwise(F.concat(stack, F.array(x))),
    )


def _joined_path(base: Column, path: Column) -> Column:
    """A path as seen from a base path, without dot segments; empty segments inside go where the path is relative."""
    above = F.split(base, "/", -1)
    above = F.when(F.element_at(above, -1) != "", F.slice(above, F.lit(1), F.size(above) - 1)).otherwise(above)
    both = F.concat(above, F.split(path, "/", -1))
    inner = F.filter(F.slice(both, F.lit(2), F.greatest(F.size(both) - 2, F.lit(0))), lambda x: x != "")
    relative = F.concat(F.slice(both, F.lit(1), F.lit(1)), inner, F.when(F.size(both) > 1, F.slice(both, F.lit(-1), F.lit(1))).otherwise(F.array().cast("array<string>")))
    segments = F.when(F.startswith(path, F.lit("/")), F.split(path, "/", -1)).otherwise(relative)

    def finish(x):
        ends = F.when(F.element_at(x, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(walked(x), ends), "/")

    joined = let(segments, finish)
    return F.when(joined == "", "/").otherwise(joined)


def resolve(base: Column, reference: Column) -> Column:
    """A reference as seen from a base URL (RFC 3986, section 5, references with the base's own scheme counting as relative).

    References with another scheme stay as they are. Empty queries and fragments leave no mark. Null counts as empty.
    """

    def of(x):
        b, r, text = x["b"], x["r"], x["text"]
        same = (r["scheme"] == "") | (r["scheme"] == b["scheme"])
        empty = r["path"] == ""
        query = F.when(empty & (r["query"] == ""), b["query"]).otherwise(r["query"])
        path = F.when(empty, b["path"]).otherwise(_joined_path(b["path"], r["path"]))
        known = b["scheme"].isin("http", "https", "ftp", "file", "")
        return (
            F.when(text == "", x["base"])
            .when(x["base"] == "", text)
            .when(~same | ~known, text)
            .when(r["authority"] != "", unsplit(b["scheme"], r["authority"], r["path"], r["query"], r["fragment"]))
            .otherwise(unsplit(b["scheme"], b["authority"], path, query, r["fragment"]))
        )

    text = F.coalesce(reference, F.lit(""))
    return let(F.struct(split(base).alias("b"), split(text).alias("r"), text.alias("text"), F.coalesce(base, F.lit("")).alias("base")), of)


def absolute(reference: Column, base: Column) -> Column:
    """A link as a web URL, its fragment kept; null for blank links, bare ``#`` and what is no web URL."""
    text = F.trim(F.coalesce(reference, F.lit("")))
    whole = resolve(base, text)
    usable = (text != "") & (text != "#") & ~F.lower(text).rlike("^(?:javascript|mailto|tel|data):")
    return F.when(usable, let(whole, lambda u: F.when(F.lower(u).rlike("^https?:"), u)))


def _plain(x: Column) -> Column:
    """A query part without escapes; where they aren't well formed they stay."""
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


#: Parameters that only say where a visitor came from, beside those that begin with utm_; and a link's words for "not yet".
TRACKING = ("from", "source", "src", "track", "tracking", "spm")
NO_LINK = ("", "#", "即将上线")


def canonical_static(url: Column, base: Column | None = None) -> Column:
    """A static topic's link for comparison: resolved, quotes and fragment gone, host lower-case without user and default port, one
    slash for several, no dot segments, parameters without tracking ones sorted and escaped anew; null for no web link.

    Parameters without a value get an empty one. The five entities of XML are read, no others.
    """
    text = F.btrim(F.trim(F.coalesce(url, F.lit(""))), F.lit("\"'"))
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))

    def of(x):
        authority = F.lower(F.regexp_replace(x["authority"], "^.*@", ""))
        port = F.regexp_replace(F.regexp_extract(authority, ":([^:\\]]*)$", 1), "^0+(?=.)", "")
        default = F.when(x["scheme"] == "https", "443").otherwise("80")
        name = F.regexp_replace(authority, ":[^:\\]]*$", "")
        host = F.when((port == "") | (port == default), name).otherwise(F.concat(name, F.lit(":"), port))
        inner = F.filter(walked(F.filter(F.split(x["path"], "/", -1), lambda s: s != "")), lambda s: s != "")
        ends = F.when((F.substring(x["path"], -1, 1) == "/") & (F.size(inner) > 0), "/").otherwise("")
        path = F.concat(F.lit("/"), F.array_join(inner, "/"), ends)
        parts = F.filter(F.split(x["query"], "&", -1), lambda p: p != "")
        pairs = F.transform(parts, lambda p: F.struct(_plain(F.substring_index(p, "=", 1)).alias("k"), _plain(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
        kept = F.array_sort(F.filter(pairs, lambda p: ~(F.startswith(F.lower(p["k"]), F.lit("utm_")) | F.lower(p["k"]).isin(*TRACKING))))
        query = F.array_join(F.transform(kept, lambda p: F.concat(_escaped(p["k"]), F.lit("="), _escaped(p["v"]))), "&")
        valid = x["scheme"].isin("http", "https") & (name != "") & port.rlike("^\\d{0,5}$")
        return F.when(valid & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535), unsplit(x["scheme"], host, path, query, F.lit("")))

    whole = text if base is None else resolve(base, text)
    return F.when(~text.isin(*NO_LINK), let(split(whole), of))


def article_key(url: Column) -> Column:
    """Host and path only."""
    return F.when(is_web(url), F.concat(host(url), part(url, 3)))


def trimmed(url: Column) -> Column:
    return F.rtrim(F.trim(url), F.lit("/"))


def task_id(url: Column) -> Column:
    return F.substring(F.sha2(canonical(url), 256), 1, 24)


def keys(url: Column) -> Column:
    """The keys under which an application to a page counts: host and path, tenant of a shared host, or own host."""
    name = F.regexp_replace(host(url), "^www\\.", "")
    path = F.lower(F.rtrim(F.regexp_replace(part(url, 3), "/+", "/"), F.lit("/")))
    tenant = F.regexp_extract(path, "/(?:campus_apply|campus-recruitment|social-recruitment)/([^/]+)", 1)
    first = F.regexp_extract(path, "^/([^/]+)", 1)
    own = (
        F.when((name == "app.mokahr.com") & (tenant != ""), F.concat(F.lit("tenant:mokahr:"), tenant))
        .when((name == "wecruit.hotjob.cn") & (first != ""), F.concat(F.lit("tenant:hotjob:"), first))
        .when(~name.isin(*SHARED_HOSTS), F.concat(F.lit("host:"), name))
    )
    return F.when(name != "", F.array_compact(F.array(F.concat(F.lit("exact:"), name, path), own))).otherwise(F.array().cast("array<string>"))


def extract(text: Column) -> Column:
    """Web URLs in a text, without punctuation at their ends."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("https?://[^\\s<>\"']+"), F.lit(0))
    return F.transform(found, lambda u: F.rtrim(u, F.lit("，。；,;)")))


def is_article(url: Column) -> Column:
    return host(url) == "mp.weixin.qq.com"


def preferred(delivery: Column, announcement: Column) -> Column:
    """The URL to acquire and its pool: web delivery, web announcement, then either, then none."""
    d, a = F.trim(F.coalesce(delivery, F.lit(""))), F.trim(F.coalesce(announcement, F.lit("")))
    web = lambda u: is_web(u) & ~is_article(u)
    return (
        F.when(web(d), F.struct(d.alias("url"), F.lit("web").alias("pool")))
        .when(web(a), F.struct(a.alias("url"), F.lit("web").alias("pool")))
        .when(is_web(a), F.struct(a.alias("url"), F.lit("wechat").alias("pool")))
        .when(is_web(d), F.struct(d.alias("url"), F.lit("wechat").alias("pool")))
        .otherwise(F.struct(F.lit("").alias("url"), F.lit("missing").alias("pool")))
    )


def is_detail(url: Column) -> Column:
    """Whether a URL has the shape of one job's page."""
    segment = F.lower(F.regexp_extract(url, "(?i)(?:job|position|vacancy)s?/([^/?#]+)", 1))
    lists = ("list", "listing", "search", "all", "index", "home", "openings", "categories", "category", "campus", "social", "apply", "application")
    return (
        url.rlike("(?i)(?:job|position|vacancy)(?:Id|_id|id)=")
        | url.rlike("(?i)(?:job|position|vacancy|recruitment)[-_/](?:detail|view)(?:[/?.#=]|$)")
        | ((segment != "") & ~segment.isin(*lists) & segment.rlike("\\d|-"))
    )


def redact(url: Column) -> Column:
    """The values of secret parameters replaced."""
    secret = "token|password|secret|authorization|cookie|apikey|api_key|credential|auth|session|sessionid"
    return F.regexp_replace(url, f"(?i)([?&#](?:{secret})=)[^&#]*", "$1REDACTED")
