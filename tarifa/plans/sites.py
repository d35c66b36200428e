"""Queries of shops' pages (EXT-02, EXT-04, EXT-06..08, EXT-10, EXT-13, EXT-16), and their SQL, which reads the pages with patterns of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sites
from ..sources import tables as t
from .queries import query

_BLOCKS = ", ".join("'" + b.replace("'", "''") + "'" for b in t.SHOP_BLOCKS)
_PAGES = f"""g AS (SELECT page_id, ['trendyol', 'hepsiburada', 'amazon', 'mediamarkt', 'pttavm', 'n11'][1 + page_id % 6] AS site, html || replace([{_BLOCKS}][1 + page_id % 6 * 4 + page_id // 6 % 4], '%d', (1 + page_id % 9)::VARCHAR) AS html FROM pages)"""


def _one(pattern: str) -> str:
    """The first match, trimmed; null when blank."""
    return f"nullif(trim(regexp_replace(regexp_extract(html, '(?s){pattern}', 1), '<[^>]*>', '', 'g'), ' \n'), '')"


def _tag(attribute: str) -> str:
    return _one(rf"<(?:\w+)[^>]* {attribute}[^>]*>(.*?)</")


def _cls(name: str, inner: str = "(.*?)</") -> str:
    return _one(rf'<\w+[^>]*class="(?:[^"]* )?{name}(?: [^"]*)?"[^>]*>{inner}')


def _num(x: str) -> str:
    y = f"regexp_replace({x}, '[^0-9.,]', '', 'g')"
    return f"nullif(TRY_CAST(CASE WHEN contains({y}, ',') THEN replace(replace({y}, '.', ''), ',', '.') ELSE {y} END AS DOUBLE), 0)"


_FIRST = lambda *x: f"coalesce({', '.join(x)})"
_H1 = _one("<h1[^>]*>(.*?)</h1>")
_OG = _one('<meta property="og:image" content="([^"]*)"')
_BOX = lambda i: _one(rf'id="{i}">(?:<\w+[^>]*class="a-price">)<\w+[^>]*class="a-offscreen">(.*?)</')
_NAMES = {
    "trendyol": _FIRST(_one('class="pr-new-br"><h1>(.*?)</h1>'), _one('<h1[^>]*class="product-name">(.*?)</h1>')),
    "hepsiburada": _FIRST(_one('<h1 id="product-name">(.*?)</h1>'), _H1),
    "amazon": _tag('id="productTitle"'),
    "mediamarkt": _FIRST(_one('<h1 data-test="product-title">(.*?)</h1>'), _one('<h1 data-test="mms-product-name">(.*?)</h1>'), _H1),
    "pttavm": _FIRST(_one('<h1 class="product-name">(.*?)</h1>'), _one('<h1 class="product-title">(.*?)</h1>'), _one('class="[^"]*ProductName[^"]*">(.*?)</'), _H1),
    "n11": _FIRST(_one('<h1 class="proName">(.*?)</h1>'), _H1),
}
_PRICES = {
    "trendyol": _num(_FIRST(_cls("prc-dsc"), _one('class="product-price-container">.*?class="[^"]*prc-slg[^"]*">(.*?)</'))),
    "hepsiburada": _num(_FIRST(*[_tag(f'data-test-id="{x}"') for x in ("price-current-price", "default-price", "price", "offering-price")], _one('data-bind="[^"]*[pP]rice[^"]*">(.*?)</'), _cls("price-value"))),
    "amazon": _FIRST(*[_num(_BOX(x)) for x in ("corePriceDisplay_desktop_feature_div", "corePrice_feature_div", "apex_desktop")], *[_num(_tag(f'id="{x}"')) for x in ("price_inside_buybox", "priceblock_ourprice", "priceblock_dealprice", "sns-base-price")]),
    "mediamarkt": _num(_FIRST(_tag('data-test="branded-price-whole-value"'), _tag('data-test="product-price"'), _one('itemprop="price" content="([^"]*)"'), _cls("price"))),
    "pttavm": _FIRST(_num(_FIRST(_cls("product-price-new"), _cls("(?:price-current|currentPrice|productPrice)"), _one('class="[^"]*(?:Price__current|product-price)[^"]*">(.*?)</'))), _num(_FIRST(_one('data-price="([^"]*)"'), _one('data-product-price="([^"]*)"')))),
    "n11": _num(_FIRST(_one('class="newPrice">(?:<p>)?<ins>(.*?)</ins>'), _one('class="priceContainer"><ins>(.*?)</ins>'))),
}
_SELLERS = {
    "trendyol": _FIRST(_cls("merchant-text"), _cls("seller-name")), "hepsiburada": _FIRST(_tag('data-test-id="merchant-name"'), _tag('data-test-id="seller-name"')),
    "amazon": _FIRST(_tag('id="sellerProfileTriggerId"'), _one('id="merchantInfoFeature_feature_div">Satıcı ([^<]*?)(?:  |<)'), "regexp_replace(" + _tag('id="merchantInfo"') + ", ' +', ' ', 'g')"),
    "mediamarkt": _FIRST(_tag('data-test="marketplace-seller-name"'), _tag('data-test="sold-and-shipped-by"')), "pttavm": "NULL",
    "n11": _FIRST(_one('class="unf-p-sellerInfo"><a>(.*?)</a>'), _one('(?:rel="canonical" href|property="og:url" content)="[^"]*[?&]magaza=([A-Za-z0-9_-]+)')),
}
_IMAGES = {
    "trendyol": _FIRST(_one('class="base-product-image">.*?<img src="([^"]*)"'), _one('<img class="detail-section-img" src="([^"]*)"')),
    "hepsiburada": _FIRST(_one('<img itemprop="image" src="([^"]*)"'), _one('class="product-image">.*?<img src="([^"]*)"'), _OG),
    "amazon": _FIRST(_one('<img id="landingImage" src="([^"]*)"'), _one('id="imgTagWrapperId">.*?<img src="([^"]*)"'), _OG),
    "mediamarkt": _FIRST(_one('<img data-test="product-image" (?:data-)?src="([^"]*)"'), _OG), "pttavm": _OG, "n11": _FIRST(_one('class="imgObj" data-original="([^"]*)"'), _OG),
}
_GONE = {
    "trendyol": "html LIKE '%class=\"out-of-stock-btn\"%'", "hepsiburada": "regexp_matches(low, 'tükendi|tukendi|stokta yok|out-of-stock|\"instock\":false')",
    "amazon": "html LIKE '%id=\"outOfStock\"%' OR contains(low, 'currently unavailable') OR regexp_matches(lower(coalesce(" + _one('id="availability">(.*?)</div>') + ", '')), 'mevcut değil|temin edilemiyor')",
    "mediamarkt": "regexp_matches(low, 'out-of-stock|stokta yok|ürün tükendi')", "pttavm": "regexp_matches(low, 'stokta yok|tükendi|out-of-stock')", "n11": "contains(low, 'stokta yok')",
}
_CASE = lambda x: "CASE site " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in x.items()) + " END"
_PICK = lambda page, ld, nxt: f"CASE WHEN shown THEN coalesce({page}, {ld}) ELSE coalesce({ld}, {nxt}, {page}) END"
_DECODE = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
_SQL = f"""WITH {_PAGES},
    a AS (SELECT *, lower(html) AS low, CASE WHEN json_valid(ld_text) THEN ld_text::JSON END AS ld, CASE WHEN site = 'hepsiburada' AND json_valid(next_text) THEN json_extract(next_text, '$.props.pageProps.product') END AS nx
      FROM (SELECT *, regexp_extract(html, '(?s)<script type="application/ld\\+json">(.*?)</script>', 1) AS ld_text, regexp_extract(html, '(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1) AS next_text FROM g)),
    b AS (SELECT page_id, site, {_DECODE(_CASE(_NAMES))} AS dom_name, {_CASE(_PRICES)} AS dom, {_CASE(_SELLERS)} AS dom_seller, {_CASE(_IMAGES)} AS dom_image, NOT coalesce({_CASE(_GONE)}, false) AS dom_stock,
      json_extract_string(ld, '$.name') AS ld_name, coalesce(json_extract(ld, '$.offers[0]'), json_extract(ld, '$.offers')) AS offer, coalesce(json_extract_string(ld, '$.image[0]'), CASE WHEN json_type(ld, '$.image') = 'VARCHAR' THEN json_extract_string(ld, '$.image') END) AS ld_image,
      json_extract_string(nx, '$.name') AS nx_name, coalesce({", ".join(_num(f"json_extract_string(nx, '$.{p}')") for p in ("price.value", "price.discountedPrice", "price.amount", "price.sellingPrice", "sellingPrice"))}) AS nx_price, json_extract_string(nx, '$.images[0].url') AS nx_image, json_extract_string(nx, '$.merchant.name') AS nx_seller, TRY_CAST(json_extract_string(nx, '$.stock') AS DOUBLE) > 0 AS nx_stock,
      {_num(_one('<meta property="product:price:amount" content="([^"]*)"'))} AS og, TRY_CAST(nullif(regexp_extract(html, '"(?:offeredPrice|salePrice|finalPrice|sellingPrice)"\\s*:\\s*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS script, {_num("nullif(regexp_extract(html, 'name=\"description\" content=\"[^\"]*?([0-9.,]+) TL', 1), '')")} AS told FROM a),
    c AS (SELECT *, {_num("coalesce(json_extract_string(offer, '$.price'), json_extract_string(offer, '$.lowPrice'))")} AS ld_price, ld_name IS NOT NULL AS has_ld, json_extract_string(offer, '$.seller.name') AS ld_seller, CASE WHEN ld_name IS NOT NULL THEN coalesce(contains(json_extract_string(offer, '$.availability'), 'InStock'), true) END AS ld_stock FROM b),
    e AS (SELECT *, site = 'trendyol' AND ld_price IS NULL AS shown, CASE site WHEN 'n11' THEN [{{'p': dom, 's': 'selector'}}, {{'p': ld_price, 's': 'json-ld'}}] WHEN 'pttavm' THEN [{{'p': ld_price, 's': 'json-ld'}}, {{'p': dom, 's': 'selector'}}, {{'p': og, 's': 'meta'}}]
      WHEN 'hepsiburada' THEN [{{'p': ld_price, 's': 'json-ld'}}, {{'p': nx_price, 's': 'next-data'}}, {{'p': dom, 's': 'selector'}}, {{'p': og, 's': 'meta'}}, {{'p': CASE WHEN dom IS NULL AND told IS NULL THEN script END, 's': 'script'}}, {{'p': CASE WHEN dom IS NULL THEN told END, 's': 'description'}}] ELSE [{{'p': ld_price, 's': 'json-ld'}}, {{'p': dom, 's': 'selector'}}] END AS found FROM c),
    f AS (SELECT *, list_filter(found, lambda x: x.p > 0)[1] AS best, CASE WHEN site = 'hepsiburada' THEN trim(regexp_replace(regexp_replace(coalesce(ld_name, nx_name, dom_name), '(?i)\\s*[-–|]\\s*Hepsiburada.*$', ''), '\\s+', ' ', 'g')) ELSE coalesce(ld_name, dom_name) END AS name FROM e)
    SELECT page_id, site, name, coalesce(best.p, 0.0) AS price, best.s AS source, {_PICK("dom_stock", "ld_stock", "nx_stock")} AS in_stock, {_PICK("dom_seller", "ld_seller", "nx_seller")} AS seller, {_PICK("dom_image", "ld_image", "nx_image")} AS image FROM f WHERE name <> '' OR best.p > 0"""


@query(_SQL)
def shop_products(spark, d):
    """EXT-02, EXT-04, EXT-06..08, EXT-10, EXT-14, EXT-16: products of six shops' pages."""
    return sites.products(t.shop_pages(spark, d))


@query(f"""WITH {_PAGES}, r AS (SELECT page_id, {_FIRST(*[_num(_tag(f'data-test-id="{x}"')) for x in ("price-current-price", "default-price", "price")], _num(_cls("prc-dsc")), _num(_cls("product-price")), _num(_cls("price")))} AS price FROM g)
    SELECT page_id, price FROM r WHERE price > 0""")
def selector_prices(spark, d):
    """EXT-13: the seven selectors of the light recovery."""
    pages = t.shop_pages(spark, d).select("page_id", sites.page_tree(F.col("html")).alias("page"))
    return pages.select("page_id", F.inline(F.array(F.struct(sites.recovered(F.col("page")).alias("price"))))).where("price > 0")
