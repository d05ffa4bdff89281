"""URL columns: parts, validity, and joining a reference to its base.

Regular expressions are used instead of ``parse_url``: it rejects many URLs that occur on real
pages and drops the port, which belongs to the network location.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scheme, network location, path, query and fragment of a URL reference.
URL_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME, NETLOC, PATH, QUERY, FRAGMENT = range(5)
_MARK = "\ufdd0"  # a code point that no text may contain

# Leading control characters and blanks, and tab or newline anywhere, are dropped.
_DROPPED = r"^[\x00-\x20]+|[\t\r\n]"

# An empty parameter mark at the end of a path.
_EMPTY_PARAMETERS = r"(?s)^((?:.*/)?[^/;]*);$"

# An absolute web address is kept as it was written; the test is case-sensitive.
ABSOLUTE_PREFIX = r"^https?://"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def _parts(url: Column) -> Column:
    """The five parts as an array, found by one match; an absent part is empty."""
    marked = F.regexp_replace(F.regexp_replace(url, _DROPPED, ""), URL_PARTS, _MARK.join(f"${n}" for n in range(1, 6)))
    return F.split(marked, _MARK)


def _part(url: Column, number: int) -> Column:
    return F.regexp_extract(F.regexp_replace(url, _DROPPED, ""), URL_PARTS, number + 1)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, SCHEME))


def netloc(url: Column) -> Column:
    """Host with port and user part, as written."""
    return _part(url, NETLOC)


def path_onwards(url: Column) -> Column:
    """Path, query and fragment; empty queries and fragments leave no mark."""
    return _let(_parts(url), lambda own: F.concat(_path(own), _query_and_fragment(own)))


def is_fetchable(url: Column) -> Column:
    """True when a URL has both a scheme and a network location."""
    return (scheme(url) != "") & (netloc(url) != "")


def is_absolute(href: Column) -> Column:
    return href.rlike(ABSOLUTE_PREFIX)


def _path(parts: Column) -> Column:
    return F.regexp_replace(parts[PATH], _EMPTY_PARAMETERS, "$1")


def _marked(mark: str, part: Column) -> Column:
    return F.when(part != "", F.concat(F.lit(mark), part)).otherwise("")


def _query_and_fragment(parts: Column) -> Column:
    return F.concat(_marked("?", parts[QUERY]), _marked("#", parts[FRAGMENT]))


def _segments(base_path: Column, path: Column) -> Column:
    """Path segments of a non-empty reference path, taken against the folder of the base."""

    def under_base(joined: Column) -> Column:
        middle = F.filter(F.slice(joined, F.lit(2), F.size(joined) - 2), lambda part: part != "")
        return F.concat(F.slice(joined, 1, 1), middle, F.slice(joined, -1, 1))

    folder = F.regexp_replace(base_path, "[^/]+$", "")
    relative = _let(F.split(F.concat(F.regexp_replace(folder, "^$", "/"), path), "/"), under_base)
    return F.when(path.startswith("/"), F.split(path, "/")).otherwise(relative)


def _without_dots(segments: Column) -> Column:
    """Join segments to a rooted path, walking up at double dots."""
    nothing = F.array().cast("array<string>")
    walked = F.aggregate(
        segments,
        nothing,
        lambda done, part: F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    end = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(nothing)
    return F.regexp_replace(F.array_join(F.concat(walked, end), "/"), "^(?!/)", "/")


def base_parts(base: Column) -> Column:
    """The parts of a base URL, to be computed once and shared by all links of a page."""
    return _let(
        _parts(base),
        lambda own: F.struct(
            base.alias("url"),
            F.lower(own[SCHEME]).alias("scheme"),
            F.concat(F.lower(own[SCHEME]), F.lit("://"), own[NETLOC]).alias("site"),
            _path(own).alias("path"),
            own[QUERY].alias("query"),
        ),
    )


def join_to(base: Column, href: Column) -> Column:
    """Join a reference to the parts of an http(s) base URL the way a browser or ``urljoin`` does."""

    def joined(own: Column) -> Column:
        other_scheme = (own[SCHEME] != "") & (F.lower(own[SCHEME]) != base["scheme"])
        return (
            F.when(href == "", base["url"])
            .when(other_scheme, href)
            .when(
                own[NETLOC] != "",
                F.concat(base["scheme"], F.lit("://"), own[NETLOC], _path(own), _query_and_fragment(own)),
            )
            .otherwise(F.concat(base["site"], _let(_path(own), lambda path: on_site(own, path))))
        )

    def on_site(own: Column, path: Column) -> Column:
        query = _marked("?", F.when(own[QUERY] == "", base["query"]).otherwise(own[QUERY]))
        same_page = F.concat(base["path"], query, _marked("#", own[FRAGMENT]))
        resolved = _let(_segments(base["path"], path), _without_dots)
        return F.when(path == "", same_page).otherwise(F.concat(resolved, _query_and_fragment(own)))

    plain = href.rlike(r"^/[\w-][\w/-]*$")
    return F.when(plain, F.concat(base["site"], href)).otherwise(_let(_parts(href), joined))


def url_join(base: Column, href: Column) -> Column:
    return join_to(base_parts(base), href)


def resolve_to(base: Column, href: Column) -> Column:
    """A link target: absolute web addresses verbatim, everything else joined to the page URL."""
    return F.when(is_absolute(href), href).otherwise(join_to(base, href))


def url_resolve(base: Column, href: Column) -> Column:
    return resolve_to(base_parts(base), href)


def absolute_only(hrefs: Column) -> Column:
    """Without a base URL only absolute web addresses can be kept."""
    return F.filter(hrefs, is_absolute)
