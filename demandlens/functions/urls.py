"""URL parsing and resolution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):/*([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_HOST = r"^(?:[^@]*@)?([^:@]+)(?::([0-9]*))?$"
_BAD_HOST = r"[\s<>\[\]^|%\\]"


def _remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    last = F.element_at(parts, -1)

    def push(acc, s):
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s == ".", acc).when(s == "..", up).otherwise(F.array_append(acc, s))

    kept = F.aggregate(parts, F.array().cast("array<string>"), push)
    closed = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(path)


def parse(url: Column) -> Column:
    """struct(scheme, host, origin, path, href, page): NULL when there is no usable host.  ``page`` is href without fragment."""
    scheme = F.lower(F.regexp_extract(url, _PARTS, 1))
    authority = F.regexp_extract(url, _PARTS, 2)
    host, port = F.lower(F.regexp_extract(authority, _HOST, 1)), F.regexp_extract(authority, _HOST, 2)
    default_port = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    origin = F.concat(scheme, F.lit("://"), host, F.when(default_port, "").otherwise(F.concat(F.lit(":"), port)))
    raw_path = F.regexp_extract(url, _PARTS, 3)
    path = F.when(raw_path == "", "/").otherwise(_remove_dots(raw_path))
    page = F.concat(origin, path, F.regexp_extract(url, _PARTS, 4))
    usable = (host != "") & ~host.rlike(_BAD_HOST) & scheme.isin("http", "https")
    return F.when(
        usable,
        F.struct(
            scheme.alias("scheme"), host.alias("host"), origin.alias("origin"), path.alias("path"),
            F.concat(page, F.regexp_extract(url, _PARTS, 5)).alias("href"), page.alias("page"),
        ),
    )


def with_scheme(website: Column) -> Column:
    return F.when(website.rlike("(?i)^https?:"), website).otherwise(F.concat(F.lit("https://"), website))


def resolve(link: Column, base: Column) -> Column:
    """``link`` as an absolute URL text against a ``parse`` struct."""
    folder = F.regexp_replace(base["path"], "[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(base["scheme"], F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(base["origin"], link))
        .when(F.startswith(link, F.lit("?")), F.concat(base["origin"], base["path"], link))
        .when(F.startswith(link, F.lit("#")), F.concat(base["page"], link))
        .otherwise(F.concat(base["origin"], folder, link))
    )
