"""Addresses: canonical keys, hosts, registrable domains and membership in domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level suffixes under which one more label belongs to the domain (fixed values).
SECOND_LEVEL = ["edu.cn", "ac.cn", "gov.cn", "org.cn", "com.cn", "net.cn", "ac.uk", "co.uk", "edu.au", "ac.jp", "edu.hk", "edu.example", "ac.example", "org.example", "press.example"]

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def host(url: Column) -> Column:
    """The host in lower case, without user, port and dots at its ends; empty where the address has none."""
    h = F.lower(F.regexp_extract(url, _URL, 2))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(h, "^.*@", ""), r":\d*$", ""), r"^\.+|\.+$", "")


def url_key(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no ``utm_`` parameters, the rest sorted, ``/`` for an empty path."""
    scheme, net, path, query = (F.regexp_extract(url, _URL, i) for i in (1, 2, 3, 4))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_")))
    q = F.array_join(kept, "&")
    made = F.concat(F.lower(scheme), F.lit("://"), F.lower(net), F.when(path == "", "/").otherwise(path), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when(net == "", F.trim(url)).otherwise(made)


def page_key(url: Column) -> Column:
    """A weaker key: no scheme, fragment, ``www.``, index page or slash at the end."""
    x = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?i)^https?://(?:www\.)?", ""), "#.*$", "")
    return F.regexp_replace(F.regexp_replace(x, r"/+$", ""), r"(?i)/(?:index|default|main)\.(?:s?html?|jsp|php|aspx?)$", "")


def base_domain(h: Column) -> Column:
    """The registrable domain: two labels, three under a second-level suffix."""
    x = F.regexp_replace(F.lower(h), r"^www\.", "")
    return F.when(F.substring_index(x, ".", -2).isin(SECOND_LEVEL), F.substring_index(x, ".", -3)).otherwise(F.substring_index(x, ".", -2))


def suffixes(h: Column) -> Column:
    """All domains a host lies in, itself first: the keys of an equi-join in place of ``LIKE '%.d'``."""
    n = F.size(F.split(h, r"\."))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", h, F.lit("."), i - n - 1))


def is_public(url: Column) -> Column:
    """http(s), at most 2000 characters, no user, no local or private host."""
    net = F.regexp_extract(url, _URL, 2)
    h = host(url)
    private = h.rlike(r"^(?:localhost|0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|\[?(?:::1|f[cd]|fe80))|\.(?:local|internal|lan|localhost)$")
    return F.coalesce(F.lower(F.regexp_extract(url, _URL, 1)).isin("http", "https") & (F.length(url) <= 2000) & ~net.contains("@") & (h != "") & ~private, F.lit(False))
