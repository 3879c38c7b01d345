"""Links against urllib, data of pages against a JSON reader."""

import json
import random
import re
import time
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from lettings.functions import urls as U
from lettings.plans.catalogue import QUERIES
from lettings.sources import records as R


def valid(url, base=None):
    if not url or not url.strip():
        return None
    url = url.strip()
    if base and not url.startswith(("http://", "https://")):
        url = urljoin(base, url)
    try:
        parsed = urlparse(url)
    except ValueError:
        return None
    return url if parsed.scheme in ("http", "https") and parsed.netloc and "javascript:" not in url.lower() else None


def image(url, base=None):
    url = valid(url, base)
    if not url:
        return None
    low = url.lower()
    if urlparse(url).path.lower().endswith(U.ENDINGS) or any(p in low for p in U.IMAGE_PARTS):
        return url
    return None if any(p in low for p in U.PAGE_PARTS) else url


BASES = ["http://a/b/c/d;p?q", "https://example.com", "https://example.com/", "http://h:8080/x/y/", "http://h/x//y", None, "", "http://h/a?b=/c/", "http://h#f"]
LINKS = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "http:g", "HTTP://X/y", "  /a b/c.JPG \n", "javascript:void(0)", "data:image/png;base64,xx", "mailto:a@b", "//", "http://", "https:///x", "/a//b///c", "x?", "x#", "?", "#", "http://[::1]/x", "http://[x", "/img/a.html", "/property/1", "a.png;v=1", "p.php?format=png", "ht\ttp://x/y", "/a\nb", "ftp://x/y.jpg", "1:2", "/floorplan/", "é/ü.webp", None]


def test_links_are_those_of_urllib(spark):
    rng = random.Random(96)
    made = ["".join(rng.choice(["a", "b.jpg", "/", "/", "..", ".", "?", "#", ":", ";", "http:", "x=1", "//", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    pairs = [(u, b) for u in LINKS for b in BASES] + [(u, rng.choice(BASES)) for u in made]
    # Parameters of a segment that is dots, of an empty reference, and empty ones are treated apart by urllib.
    pairs = [(u, b) for u, b in pairs if not (u and b and re.search(r";\s*($|[?#])", u))]
    pairs = [(u, b) for u, b in pairs if not (u and b and ";" in u and (".;" in u or u.strip().split("?")[0].split("#")[0].rpartition("/")[2].startswith(";")))]
    rows = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(pairs)], "i int, u string, b string")
    got = {r["i"]: (r["v"], r["p"]) for r in rows.select("i", U.valid_url(F.col("u"), F.col("b")).alias("v"), U.valid_image_url(F.col("u"), F.col("b")).alias("p")).collect()}
    wrong = [(u, b, got[i], (valid(u, b), image(u, b))) for i, (u, b) in enumerate(pairs) if got[i] != (valid(u, b), image(u, b))]
    assert wrong[:5] == []


def test_links_without_a_base(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(LINKS)], "i int, u string")
    got = {r["i"]: r["v"] for r in rows.select("i", U.valid_url(F.col("u")).alias("v")).collect()}
    assert [(u, got[i], valid(u)) for i, u in enumerate(LINKS) if got[i] != valid(u)] == []


def test_links_of_the_pages(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = QUERIES["fn_validate_url"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all((r["url"], r["image"]) == (valid(r["link"], pages[r["page_id"]]), image(r["link"], pages[r["page_id"]])) for r in rows)


def test_objects_end_at_their_own_brace(spark):
    rng = random.Random(97)

    def made(depth=0):
        kind = rng.randrange(4 if depth < 4 else 2)
        return rng.choice(['a } "b" {', "\\", '\\"', "é{", 5, None]) if kind < 2 else [made(depth + 1) for _ in range(rng.randrange(3))] if kind == 2 else {rng.choice("x{}\"\\"): made(depth + 1) for _ in range(rng.randrange(4))}

    objects = [{"k": made()} for _ in range(300)]
    pages = [f"<p>{{</p>window.PAGE_MODEL  =\n {json.dumps(o)};</script>}}" for o in objects] + ["window.PAGE_MODEL = {", 'window.PAGE_MODEL = {"a": "}', "window.PAGE_MODEL = 5 {}", "none", "", None, 'window.PAGE_MODEL = {"a": {}}']
    got = {r["i"]: r["j"] for r in spark.createDataFrame(list(enumerate(pages)), "i int, t string").select("i", R.balanced_json(F.col("t")).alias("j")).collect()}
    assert [json.loads(got[i]) for i in range(300)] == objects and [got[i] for i in range(300, 307)] == [None] * 6 + ['{"a": {}}']


def test_long_pages_take_time_in_proportion():
    for text in ("window.PAGE_MODEL = " + '{"' * 500_000, 'window.PAGE_MODEL = {"' + '\\"' * 1_000_000, "window.PAGE_MODEL = " + "{" * 1_000_000, "window.PAGE_MODEL = {" + '"a"' * 300_000):
        began = time.process_time()
        assert R.balanced(text, r"window\.PAGE_MODEL\s*=") is None and time.process_time() - began < 5
