"""Links of pages: relative ones resolved as RFC 3986 says, and what may be an address of a page or an image."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of images, parts of paths and parameters of images, parts of pages, hosts of floorplans.
ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".bmp", ".tiff")
IMAGE_PARTS = ("/images/", "/image/", "/img/", "/media/", "/floorplan/", "/floor-plan/", "/floorplans/", "format=jpg", "format=png")
PAGE_PARTS = (".html", ".htm", ".php", ".asp", "/property/", "/listing/")
FLOORPLAN_HOSTS = ("rightmove.co.uk", "zoopla.co.uk", "savills.com", "knightfrank.co.uk", "knightfrank.com", "chestertons.co.uk", "foxtons.co.uk", "homeflow-assets.co.uk", "amazonaws.com", "cloudfront.net", "akamaized.net")
#: Scheme, then what follows it, the host with its slashes, path, query and fragment with their marks.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


NAMES = ("scheme", "slashes", "host", "path", "query", "fragment")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value put in, which is computed once: nested columns would repeat it wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(url: Column) -> Column:
    """Scheme, host with its slashes, host, path, query and fragment with their marks; '' if there is none."""
    return F.struct(*[F.regexp_extract(url, PARTS, i).alias(n) for i, n in enumerate(NAMES, 1)])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def resolved_path(base: Column, path: Column) -> Column:
    """The path of a reference against the base's: a path from the root as it is, another behind the base's folder without empty segments inside; dots are walked."""
    above = F.split(base, "/", -1)
    folder = F.when(F.element_at(above, -1) == "", above).otherwise(F.slice(above, 1, F.size(above) - 1))
    none = F.array().cast("array<string>")

    def without_empty(e: Column) -> Column:
        inner = F.filter(F.slice(e, 2, F.greatest(F.size(e) - 2, F.lit(0))), lambda s: s != "")
        return F.when(F.size(e) > 1, F.concat(F.slice(e, 1, 1), inner, F.array(F.element_at(e, -1)))).otherwise(e)

    def walk(e: Column) -> Column:
        walked = F.aggregate(e, none, lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s)))
        return F.array_join(F.concat(walked, F.when(F.element_at(e, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)), "/")

    every = F.when(F.startswith(path, F.lit("/")), F.split(path, "/", -1)).otherwise(let(F.concat(folder, F.split(path, "/", -1)), without_empty))
    return let(let(every, walk), lambda p: F.when(p == "", "/").otherwise(p))


def join(base: Column, url: Column) -> Column:
    """The reference seen from the base. References of another scheme stay; empty queries and fragments go; tabs and line ends inside don't count.

    Parameters behind a semicolon are part of their segment, and stay if they are empty.
    """
    mark = lambda c: F.when(F.length(c) > 1, c).otherwise("")
    host = lambda h, path: F.concat(F.lit("//"), h, F.when((path != "") & ~F.startswith(path, F.lit("/")), F.lit("/")).otherwise(""), path)

    def put(x: Column) -> Column:
        scheme, other, b, u = F.lower(x["b"]["scheme"]), F.lower(x["u"]["scheme"]), x["b"], x["u"]
        same = host(b["host"], b["path"])
        told = F.when(u["host"] != "", F.concat(host(u["host"], u["path"]), mark(u["query"]))).when(u["path"] == "", F.concat(same, F.when(F.length(u["query"]) > 1, u["query"]).otherwise(mark(b["query"]))))
        moved = let(resolved_path(b["path"], u["path"]), lambda path: F.concat(host(b["host"], path), mark(u["query"])))
        whole = F.concat(scheme, F.lit(":"), F.coalesce(told, moved), mark(u["fragment"]))
        return F.when((other != "") & (other != scheme), x["url"]).otherwise(whole)

    made = let(F.struct(parts(base).alias("b"), parts(F.regexp_replace(url, r"[\t\r\n]", "")).alias("u"), url.alias("url")), put)
    return F.when(F.coalesce(url, F.lit("")) == "", base).otherwise(made)


def valid_url(url: Column, base: Column | None = None) -> Column:
    """The absolute address by http or https, else null: without host, with ``javascript:`` anywhere, with a broken bracket in the host.

    A base (itself such an address) resolves what doesn't begin with http:// or https://. White space around doesn't count.
    """
    plain = stripped(url)
    if base is not None:
        plain = let(plain, lambda p: F.when((p != "") & (F.coalesce(base, F.lit("")) != "") & ~p.rlike("^https?://"), join(base, p)).otherwise(p))

    def check(p: Column) -> Column:
        return let(parts(F.regexp_replace(p, r"[\t\r\n]", "")), lambda r: F.when(F.lower(r["scheme"]).isin("http", "https") & (r["host"] != "") & ~F.contains(F.lower(p), F.lit("javascript:")) & (~r["host"].rlike(r"[\[\]]") | r["host"].rlike(r"^([^\[\]]*@)?\[[0-9A-Fa-f:.]+\](:\d*)?$")), p))

    return let(plain, check)


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(text, F.lit(p))
    return found


def valid_image_url(url: Column, base: Column | None = None) -> Column:
    """A valid address that may be an image: by its ending, a part of its path or a parameter; or by nothing that tells of a page."""
    ending = "(" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")$"

    def check(found: Column) -> Column:
        path = F.regexp_replace(F.lower(F.regexp_extract(F.regexp_replace(found, r"[\t\r\n]", ""), PARTS, 4)), ";[^/]*$", "")
        return let(F.lower(found), lambda low: F.when(path.rlike(ending) | any_of(low, IMAGE_PARTS) | ~any_of(low, PAGE_PARTS), found))

    return let(valid_url(url, base), check)


def trusted_floorplan(url: Column) -> Column:
    """Whether a floorplan's address is of a host that is known for them; others are let pass too."""
    return F.coalesce(any_of(F.lower(url), FLOORPLAN_HOSTS), F.lit(False))
