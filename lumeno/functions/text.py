"""String and URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that clean_string removes, by code point.
INVISIBLE = "\\f\\n\\r\\t\\x0B\\u200b\\u00a0\\u1680\\u180e\\u2000\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def clean_string(s: Column) -> Column:
    """Without spaces and invisible characters."""
    return F.regexp_replace(s, f"[ {INVISIBLE}]", "")


def cut_invisible(s: Column) -> Column:
    """Without invisible characters; spaces stay."""
    return F.regexp_replace(s, f"[{INVISIBLE}]", "")


def own_text(parts: Column, reverse: bool = True) -> Column:
    """An element's text nodes, trimmed and joined without separator; by default from last to first."""
    trimmed = F.transform(parts, lambda x: F.trim(x))
    return F.array_join(F.reverse(trimmed) if reverse else trimmed, "")


def homepage(url: Column) -> Column:
    """Scheme and host with a closing slash; empty where the URL has, say, a port."""
    return F.regexp_extract(F.concat(url, F.lit("/")), r"(http[s]*://[\w.-]*/|$)", 1)


def url_host(url: Column) -> Column:
    """What stands between :// and the next slash; null without ://."""
    return F.split(F.get(F.split(url, "://"), 1), "/")[0]


def host_from_url(url: Column) -> Column:
    """The host of scheme://host/path, else the whole URL."""
    pattern = r"^(\w+)://([^/]+)/(.*)$"
    return F.when(F.regexp_like(url, F.lit(pattern)), F.regexp_extract(url, pattern, 2)).otherwise(url)


def base_host(host: Column) -> Column:
    """The last two labels, or three where there are more than two and the last but one has at most three letters (co.uk)."""
    parts = F.split(host, "\\.")
    n = F.size(parts)
    take = F.when((n > 2) & (F.length(F.get(parts, n - 2)) <= 3), 3).otherwise(F.least(n, F.lit(2)))
    return F.when(F.coalesce(F.length(host), F.lit(0)) == 0, "").otherwise(F.array_join(F.slice(parts, n - take + 1, take), "."))


def css_url(s: Column) -> Column:
    """What stands in url("..."), or null."""
    pattern = r'url\("(.*?)"\)'
    return F.when(F.regexp_like(s, F.lit(pattern)), F.regexp_extract(s, pattern, 1))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def icon_name(url: Column) -> Column:
    """The last part of the path, [empty] if there is none; of a data URL its type without the first slash."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^\w+://[^/]*", "")
    name = F.element_at(F.split(path, "/"), -1)
    head = F.split(url, ",")[0]
    head = F.concat(F.substring_index(F.split(url, ",")[0], "/", 1), F.regexp_replace(F.split(url, ",")[0], "^[^/]*/?", ""))
    return F.when(F.contains(url, F.lit("data:image")), head).when(name == "", "[empty]").otherwise(name)


def digit_share(s: Column) -> Column:
    """Share of digits among a text's characters; 1 for the empty text."""
    n = F.length(s)
    return F.when(n == 0, 1.0).otherwise((n - F.length(F.regexp_replace(s, "[0-9]", ""))) / n)


def external(link: Column, host: Column) -> Column:
    """Whether a link starts with http and its base host is another one."""
    return F.coalesce(F.startswith(link, F.lit("http")) & (base_host(url_host(link)) != base_host(host)), F.lit(False))


def short_hands(script: Column) -> Column:
    """Script short-hands written out (J10); nothing is ever run."""
    for short, long in (("$$c(", "addCssF("), ("$$r(", "$.remove("), ("$$w(", "$.wait("), ("$$(", "$(")):
        script = F.replace(script, F.lit(short), F.lit(long))
    return script
