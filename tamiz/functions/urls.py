"""Parts of URLs as column expressions; malformed ones give empty parts, as lenient parsers do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: page classes by extension -------------------------------------------------
DYNAMIC = ("php", "asp", "aspx", "jsp", "cgi")
STATIC = ("html", "htm", "pdf", "xml", "json", "txt", "")
# ---------------------------------------------------------------------------------------------


def _c(url: Column | str) -> Column:
    return F.col(url) if isinstance(url, str) else url


def authority(url: Column | str) -> Column:
    """Host with port and user, '' where there is none."""
    return F.coalesce(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def path(url: Column | str) -> Column:
    rest = F.regexp_replace(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?", "")
    return F.regexp_extract(rest, r"^[^?#]*", 0)


def query(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def depth(url: Column | str) -> Column:
    """Non-empty path segments."""
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def extension(url: Column | str) -> Column:
    """Lower-cased text after the last dot of the whole path."""
    return F.lower(F.regexp_extract(path(url), r"\.([^.]*)$", 1))


def page_class(url: Column | str) -> Column:
    e = extension(url)
    return F.when((query(url) != "") | e.isin(*DYNAMIC), "dynamic").when(e.isin(*STATIC), "static").otherwise("unknown")


def web_scheme(url: Column | str) -> Column:
    return _c(url).rlike(r"(?i)^https?:")


def under_seed(url: Column | str, seeds: Column) -> Column:
    """Whether the authority is one of ``seeds`` (array) or a subdomain of one."""
    a = authority(url)
    return F.exists(seeds, lambda s: (a == s) | a.endswith(F.concat(F.lit("."), s)))


_ANCHOR = r"""(?i)<a(?:\s[^>]*)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def hrefs(html: Column | str) -> Column:
    """Targets of anchors in well-formed HTML, quoted or not, in order, repeats kept, the five named entities of markup resolved."""

    def plain(v: Column) -> Column:
        v = F.regexp_replace(v, r"""^(["'])(.*)\1$""", "$2")
        for e, c in _ENTITIES:
            v = F.replace(v, F.lit(e), F.lit(c))
        return v

    return F.transform(F.regexp_extract_all(_c(html), F.lit(_ANCHOR), F.lit(1)), plain)
