"""URL columns: canonical form, query pairs, safe links and page links, all as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bound

#: Query keys that only track, and the prefix of more of them.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")
TRACKING_PREFIX = "utm_"
SPECIAL = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_PAIRS = "array<struct<k:string,v:string>>"


def _decoded(part: Column) -> Column:
    plain = F.replace(part, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(F.replace(plain, F.lit(" "), F.lit("%20"))), plain)


def query_pairs(query: Column) -> Column:
    """Ordered (k, v) pairs of a query string; empty segments do not count, a missing ``=`` means an empty value."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]*=(?s)(.*)$", 1)).alias("v")))


def strip_tracking(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith(TRACKING_PREFIX) & ~F.lower(p["k"]).isin(*TRACKING))


def _order(a: Column, b: Column) -> Column:
    left, right = F.collate(a, "UNICODE"), F.collate(b, "UNICODE")
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def sorted_pairs(pairs: Column) -> Column:
    return F.array_sort(pairs, lambda a, b: F.when(a["k"] == b["k"], _order(a["v"], b["v"])).otherwise(_order(a["k"], b["k"])))


def encode_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def _encoded_path(path: Column) -> Column:
    return _percent(path, "\"<>`{}")


def _resolved(path: Column) -> Column:
    """Without dot segments."""
    parts = F.transform(F.split(path, "/"), lambda p: F.when(F.regexp_like(p, F.lit("^(?:\\.|%2[eE]){1,2}$")), F.regexp_replace(p, "%2[eE]", ".")).otherwise(p))
    ends = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), "/").otherwise(""))


def normalize_url(url: Column) -> Column:
    """The canonical form of an absolute URL; null for anything else.

    Scheme and host are lower-cased, the fragment, a default port, tracking pairs and slashes at the path's end go,
    pairs are sorted and encoded as forms are. Hosts of web schemes are written as the URL standard has them: numbers as IPv4
    addresses, other scripts in Punycode; hosts with sharp s, final sigma or joiners, which older rules fold away, are left as they are.
    """
    text = F.regexp_replace(url, f"^(?:{SPACE}|[\\x00-\\x20])+|(?:{SPACE}|[\\x00-\\x20])+$", "")
    parts = bound(F.regexp_replace(text, "[\\t\\r\\n]", ""), _split_scheme)
    return bound(bound(parts, _split_body), _assembled)


def _split_scheme(text: Column) -> Column:
    scheme = F.lower(F.regexp_extract(text, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.struct(scheme.alias("scheme"), scheme.isin(*SPECIAL).alias("special"), F.regexp_replace(F.regexp_replace(text, "^[^:]*:", ""), "(?s)#.*$", "").alias("body"))


def _split_body(p: Column) -> Column:
    slashes = F.regexp_replace(F.regexp_replace(p["body"], "^[/\\\\]*", ""), "\\\\(?=[^?]*(?:\\?|$))", "/")
    flat = F.when(p["special"], F.concat(F.lit("//"), slashes)).otherwise(p["body"])

    def parts(t: Column) -> Column:
        slashed = t.startswith("//")
        path = F.regexp_extract(F.when(slashed, F.regexp_replace(t, "^//[^/?]*", "")).otherwise(t), "(?s)^([^?]*)", 1)
        return F.struct(
            p["scheme"].alias("scheme"), p["special"].alias("special"), slashed.alias("slashed"), F.when(slashed, F.regexp_extract(t, "^//([^/?]*)", 1)).otherwise("").alias("authority"),
            F.when(p["special"] & (path == ""), "/").otherwise(path).alias("path"), F.regexp_extract(t, "(?s)\\?(.*)$", 1).alias("query"),
        )

    return bound(flat, parts)


def _assembled(p: Column) -> Column:
    authority, special, slashed = p["authority"], p["special"], p["slashed"]
    user, h = F.regexp_extract(authority, "^(.*@)", 1), bound(authority, _host_and_port)
    host, port = F.when(special, h["host"]).otherwise(h["plain"]), _port(p["scheme"], h["port"])
    path = bound(F.when(p["path"].contains("/."), _resolved(p["path"])).otherwise(p["path"]), _encoded_path)
    path = F.when(slashed, bound(path, lambda t: F.when(F.length(t) > 1, F.regexp_replace(t, "/+$", "")).otherwise(t))).otherwise(p["path"])
    path = bound(path, lambda t: F.when(special & (t == ""), "/").otherwise(t))
    query = bound(encode_pairs(sorted_pairs(strip_tracking(query_pairs(p["query"])))), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    bad = (p["scheme"] == "") | (special & h["bad"])
    whole = F.concat(p["scheme"], F.lit(":"), F.when(slashed, F.concat(F.lit("//"), user, host, port)).otherwise(""), path, query)
    return F.when(bad, F.lit(None)).otherwise(whole)


def safe_link(url: Column) -> Column:
    """The URL as the URL standard writes it where it is one of http or https, else null; corner cases as in normalize_url()."""
    text = F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\r\\n]", "")

    def written(whole: Column) -> Column:
        fragment = F.when(whole.contains("#"), F.concat(F.lit("#"), _percent(F.regexp_extract(whole, "(?s)#(.*)$", 1), "\"<>`"))).otherwise("")
        query = F.when(F.regexp_like(whole, F.lit("^[^#]*\\?")), F.concat(F.lit("?"), _percent(F.regexp_extract(whole, "(?s)^[^#?]*\\?([^#]*)", 1), "\"<>'"))).otherwise("")

        def joined(p: Column) -> Column:
            host = bound(p["authority"], _host_and_port)
            path = bound(F.when(F.regexp_like(p["path"], F.lit("/(?:\\.|%2[eE])")), _resolved(p["path"])).otherwise(p["path"]), _encoded_path)
            return bound(host, lambda h: F.when(h["bad"] | ~p["scheme"].isin("http", "https"), F.lit(None)).otherwise(F.concat(p["scheme"], F.lit("://"), F.regexp_extract(p["authority"], "^(.*@)", 1), h["host"], _port(p["scheme"], h["port"]), path, query, fragment)))

        return bound(bound(bound(whole, _split_scheme), _split_body), joined)

    return bound(text, written)


def _percent(text: Column, also: str) -> Column:
    """Percent-encoded where it is not visible ASCII, or one of ``also``."""
    odd = F.array_distinct(F.regexp_extract_all(text, F.lit(f"[^\\x21-\\x7E]|[{also}]"), F.lit(0)))
    return F.aggregate(odd, text, lambda acc, c: F.replace(acc, c, F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))))


def _host_and_port(authority: Column) -> Column:
    host = F.lower(F.regexp_extract(authority, "^(?:.*@)?(\\[[^\\]]*\\]|[^:]*)", 1))
    rest = F.regexp_replace(authority, "^.*@|\\[[^\\]]*\\]", "")
    port = F.regexp_extract(rest, ":0*([0-9]*)$", 1)
    wrong = F.regexp_like(rest, F.lit(":.*[^0-9]")) | (F.length(port) > 5) | (F.coalesce(F.try_to_number(F.nullif(port, F.lit("")), F.lit("99999")), F.lit(0)) > 65535)
    number = F.when((port == "") & F.regexp_like(rest, F.lit(":0+$")), "0").otherwise(port)
    odd = wrong | (host == "") | F.regexp_like(host, F.lit("[\\x00-\\x20<>^|%#\\\\]"))
    return bound(F.struct(host.alias("plain"), bound(host, _written_host).alias("host"), number.alias("port"), odd.alias("odd")), lambda h: F.struct(h["plain"].alias("plain"), F.coalesce(h["host"], F.lit("")).alias("host"), h["port"].alias("port"), (h["odd"] | h["host"].isNull()).alias("bad")))


def _written_host(host: Column) -> Column:
    """A host in lower case as web URLs have it; null if it is none."""
    named = F.when(F.regexp_like(host, F.lit("^[\\x00-\\x7F]*$")), host).when(F.regexp_like(host, F.lit("[\\x{DF}\\x{3C2}\\x{200C}\\x{200D}]")), host)
    named = named.otherwise(F.lower(F.try_reflect(F.lit("com.ibm.icu.text.IDNA"), F.lit("convertIDNToASCII"), F.coalesce(host, F.lit("")), F.lit(1))))
    return bound(named, lambda h: F.when(F.regexp_like(h, F.lit("(?:^|[.])(?:[0-9]+|0x[0-9a-f]*)[.]?$")), _address(h)).otherwise(h))


def _address(host: Column) -> Column:
    """The IPv4 address that a host ending in a number stands for, with parts in tens, eights or sixteens and the last one filling up; null if it is none."""
    short = lambda t: F.when(F.length(t) <= 11, t)

    def number(t: Column) -> Column:
        digits = F.when(F.regexp_like(t, F.lit("^0x[0-9a-f]*$")), F.conv(short(F.concat(F.lit("0"), F.substring(t, 3, 99))), 16, 10)).when(F.regexp_like(t, F.lit("^0[0-7]*$")), F.conv(short(t), 8, 10)).when(F.regexp_like(t, F.lit("^[1-9][0-9]*$")), short(t))
        return digits.cast("long")

    def joined(v: Column) -> Column:
        n, last = F.size(v), F.element_at(v, -1)
        first = F.aggregate(F.slice(v, 1, n - 1), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
        room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), n)
        right = ~F.exists(v, lambda x: x.isNull()) & ~F.exists(F.slice(v, 1, n - 1), lambda x: x > 255)
        return F.when(n <= 4, F.when(right & (last < room), bound(first * room + last, lambda ip: F.concat_ws(".", *[F.shiftright(ip, k).bitwiseAND(F.lit(255)) for k in (24, 16, 8, 0)]))))

    return bound(F.transform(F.split(F.regexp_replace(host, "[.]$", ""), "[.]"), number), joined)


def _port(scheme: Column, port: Column) -> Column:
    default = F.coalesce(*[F.when(scheme == s, n) for s, n in SPECIAL.items()], F.lit(""))
    return F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port))


def encode_component(value: Column) -> Column:
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def page_href(section: str | None, value: Column) -> Column:
    return F.concat(F.lit(f"./{section}/?id=" if section else "./?id="), encode_component(value))


def query_param(search: Column, name: str) -> Column:
    """The first value of ``name`` in a location's search string, else empty."""
    found = F.filter(query_pairs(F.regexp_replace(search, "^\\?", "")), lambda p: p["k"] == name)
    return F.coalesce(F.get(found, 0)["v"], F.lit(""))
