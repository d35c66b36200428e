"""Page trees and selectors: nesting, unclosed and void elements, alternatives, attributes, blank and null pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarifa.functions import pagetree
from tarifa.functions.pagetree import Part, css, either
from tarifa.operators import sites

PAGE = """<!DOCTYPE html><html><body class="a b"><div id="x" data-k><p>one <b>two</b><p class="p">three &amp; four</div>
<div id="y" class="b  c"><img src="/1" src="/2"><br/><span class="p">five<script>var p = "<b>no</b>";</script></span></i></div><ul><li class="p">six<li>seven</ul><input class="p"><p class=p>eight"""
SELECTORS = {
    "all": css(Part(cls="p")), "in x": css(Part(id="x"), Part(cls="p")), "in b of body": css(Part("body"), Part(cls="c"), Part("span")), "two": css(Part("p"), Part("b")), "has": css(Part(has="data-k")),
    "either": either(css(Part("li", cls="p")), css(Part("span"))), "holds": css(Part(holds=("class", "c"))), "none": css(Part(id="y"), Part("li")), "image": css(Part("img")), "blank": css(Part("input")),
}


@pytest.fixture(scope="module")
def page(spark):
    d = spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "<b"), (5, "plain")], "id int, html string")
    tree = pagetree.tree(F.col("html"), SELECTORS.values(), ["src"])
    return d.select("id", tree.alias("t")).select("id", *[f(F.col("t"), s).alias(f"{k} {f.__name__}") for k, s in SELECTORS.items() for f in (pagetree.text, pagetree.all_text)], pagetree.attribute(F.col("t"), SELECTORS["image"], "src").alias("src")).orderBy("id").collect()


def test_selectors(page):
    got = page[0]
    assert got["all all_text"] == "three & fourfivesixeight"  # a script's text and elements without an end aren't text
    assert (got["in x text"], got["in b of body text"], got["two text"]) == ("three & four", "five", "two")
    assert got["has text"] == "one twothree & four"
    assert (got["either text"], got["either all_text"], got["holds text"]) == ("five", "fivesix", "five")
    assert got["none text"] is None and got["image text"] is None and got["blank text"] is None and got["src"] == "/1"


def test_pages_without_elements(page):
    assert all(v is None or v == i for r in page[1:] for i in [r["id"]] for v in r)


def test_shop_rules(spark):
    """The rules of the shops where they differ: the first label or the first price, phrases, seller texts, names that are missing."""
    buy = '<div id="corePrice_feature_div"><b class="a-price"><i class="a-offscreen">%s</i></b></div>'
    rows = [
        (1, "amazon", buy % "yok" + '<i id="priceblock_ourprice">12,50 TL</i><b id="productTitle">T</b>'), (2, "amazon", '<b class="a-price"><i class="a-offscreen">9 TL</i></b>'),
        (3, "mediamarkt", '<h1>M</h1><b data-test="product-price">yok</b><b class="price">5 TL</b>'), (4, "pttavm", '<b class="price-current">yok</b><i data-price="7,5">'), (5, "pttavm", ""),
        (6, "hepsiburada", '<script>{"sellingPrice" : 0, "x": 1}</script><script>{"salePrice":12.5}</script>'), (7, "hepsiburada", "<script>" + " " * 200_001 + '{"salePrice":12.5}</script>'), (8, "n11", None), (9, "other", "<h1>x</h1>"),
        (10, "amazon", '<b id="productTitle">T</b><div id="availability">Temin edilemiyor</div><p>' + "x" * 300_000), (11, "n11", '<h1>N</h1><meta property="og:url" content="u?magaza=a%20b">'),
    ]
    got = {r["page_id"]: (r["name"], r["price"], r["source"], r["in_stock"], r["seller"]) for r in sites.products(spark.createDataFrame(rows, "page_id int, site string, html string")).collect()}
    assert got == {
        1: ("T", 12.5, "selector", True, None), 3: ("M", 0.0, None, True, None), 4: ("PTT AVM ürünü", 7.5, "selector", True, None), 5: ("PTT AVM ürünü", 0.0, None, True, None),
        6: ("Hepsiburada ürünü", 12.5, "script", True, None), 10: ("T", 0.0, None, False, None), 11: ("N", 0.0, None, True, "a"),
    }


def test_references_without_semicolon_are_text(spark):
    """Cut-off references stay as they are, whole ones are read, also within attributes."""
    d = spark.createDataFrame([('<h1 id="a&amp;b&copy=1">x &amp;&amp;amp; y&lt;z &ampq; &#x27;&#65 &amp</h1>',)], "html string")
    h1 = pagetree.css(pagetree.Part("h1"))
    page = pagetree.tree(F.col("html"), [h1], {"id"})
    r = d.select(page.alias("page")).select(pagetree.text(F.col("page"), h1).alias("t"), pagetree.attribute(F.col("page"), h1, "id").alias("i")).first()
    assert tuple(r) == ("x &&amp; y<z &ampq; '&#65 &amp", "a&b&copy=1")
