"""URL expressions, by RFC 3986."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivane.functions.text import let

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def url_scheme(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 1)


def url_host(url: Column) -> Column:
    """Network location, with port and user part if there are any."""
    return F.regexp_extract(url, _URL, 2)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def url_page(url: Column) -> Column:
    """Without fragment and query."""
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def normalize_url(url: Column) -> Column:
    """Comparison form: no fragment or query, host in lower case, no final slash."""
    page = url_page(url)
    host = url_host(page)
    head = F.concat(F.lower(url_scheme(page)), F.lit("://"), F.lower(host))
    return F.rtrim(F.concat(head, url_path(page)), F.lit("/"))


def _remove_dots(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; a final one leaves a slash."""

    def step(acc: Column, seg: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(seg == "..", up).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg)))

    def resolved(segs: Column) -> Column:
        tail = F.when(F.element_at(segs, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
        kept = F.aggregate(F.slice(segs, 2, F.size(segs)), F.slice(segs, 1, 1), step)
        return F.concat(F.array_join(kept, "/"), tail)

    return F.when(path.rlike(r"/\.\.?(/|$)"), let(F.split(path, "/"), resolved)).otherwise(path)


def url_join(base: Column, href: Column) -> Column:
    """``href`` as seen from ``base``."""
    origin = F.concat(url_scheme(base), F.lit("://"), url_host(base))
    folder = F.regexp_extract(url_path(base), r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path = F.when(href.startswith("/"), href).otherwise(F.concat(folder, href))
    rest = F.regexp_extract(path, r"^[^?#]*(.*)$", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href == "", base)
        .when(href.startswith("//"), F.concat(url_scheme(base), F.lit(":"), href))
        .when(href.startswith("#"), F.concat(F.substring_index(base, "#", 1), href))
        .when(href.startswith("?"), F.concat(url_page(base), href))
        .otherwise(F.concat(origin, _remove_dots(url_page(path)), rest))
    )
