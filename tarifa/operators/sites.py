"""Products of known shops' pages: ordered selector chains, structured data and stock phrases by site (EXT-02, EXT-04, EXT-06..08, EXT-10, EXT-13, EXT-16)."""

from __future__ import annotations

from itertools import chain
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.pagetree import Part, Selector, all_text, any_of, attribute, css, either, text, tree
from ..functions.prices import parse_price_page
from ..functions.text import bind


class Look(NamedTuple):
    """Where to look: the first element's text, all elements' texts, or an attribute of the first."""

    selector: Selector
    attr: str | None = None
    every: bool = False


class Site(NamedTuple):
    """Fixed values of a shop: where its pages hold things, in the order in which they count, and phrases of missing stock."""

    name: tuple[Look, ...]
    price: tuple[tuple[Look, ...], ...]  # of each group the first label counts, also if it holds no price; then the next group
    seller: tuple[Look, ...] = ()
    image: tuple[Look, ...] = ()
    gone: tuple[Selector, ...] = ()
    phrases: tuple[str, ...] = ()


def _by(name: str, value: str) -> Selector:
    return css(Part(attr=(name, value)))


def _cls(name: str, tag: str | None = None) -> Selector:
    return css(Part(tag, cls=name))


_OG_IMAGE = Look(css(Part("meta", attr=("property", "og:image"))), "content")
# Fixed values, in the order in which they are tried
SITES = {
    "trendyol": Site(
        name=(Look(css(Part(cls="pr-new-br"), Part("h1")), every=True), Look(_cls("product-name", "h1"), every=True)),
        price=((Look(_cls("prc-dsc")), Look(css(Part(cls="product-price-container"), Part(cls="prc-slg")), every=True)),),
        seller=(Look(_cls("merchant-text"), every=True), Look(_cls("seller-name"), every=True)),
        image=(Look(css(Part(cls="base-product-image"), Part("img")), "src"), Look(_cls("detail-section-img", "img"), "src")),
        gone=(_cls("out-of-stock-btn"),),
    ),
    "hepsiburada": Site(
        name=(
            Look(css(Part("h1", id="product-name"))), Look(_cls("product-name", "h1")), Look(css(Part("h1", attr=("data-test-id", "title")))), Look(_by("data-test-id", "product-name")),
            Look(css(Part("h1", attr=("itemprop", "name")))), Look(css(Part("h1"))),
        ),
        price=((
            Look(_by("data-test-id", "price-current-price")), Look(_by("data-test-id", "default-price")), Look(_by("data-test-id", "price")), Look(_by("data-test-id", "offering-price")),
            Look(either(css(Part(holds=("data-bind", "price"))), css(Part(holds=("data-bind", "Price"))))), Look(css(Part("span", attr=("itemprop", "price"))), "content"),
            Look(css(Part("span", attr=("itemprop", "price")))), Look(_by("itemprop", "price"), "content"), Look(_cls("product-price")), Look(_cls("price-value")),
            Look(either(css(Part(holds=("class", "price-current"))), css(Part(holds=("class", "priceCurrent"))))), Look(css(Part(holds=("class", "Price-module")))),
        ),),
        seller=(Look(_by("data-test-id", "merchant-name")), Look(_by("data-test-id", "seller-name")), Look(_cls("merchant-name"))),
        image=(Look(css(Part("img", attr=("data-test-id", "product-image"))), "src"), Look(css(Part("img", attr=("itemprop", "image"))), "src"), Look(_cls("product-image", "img"), "src"), Look(css(Part(cls="product-image"), Part("img")), "src"), _OG_IMAGE),
        phrases=("tükendi", "tukendi", "stokta yok", "out-of-stock", '"instock":false'),
    ),
    "amazon": Site(
        name=(Look(css(Part(id="productTitle")), every=True),),
        price=tuple((Look(x),) for x in (
            *(css(Part(id=box), Part(cls="a-price"), Part(cls="a-offscreen")) for box in ("corePriceDisplay_desktop_feature_div", "corePrice_feature_div", "apex_desktop")),
            *(css(Part(id=box)) for box in ("price_inside_buybox", "priceblock_ourprice", "priceblock_dealprice", "sns-base-price")),
        )),
        seller=(Look(css(Part(id="sellerProfileTriggerId")), every=True),),
        image=(Look(css(Part(id="landingImage")), "src"), Look(css(Part(id="imgTagWrapperId"), Part("img")), "src"), _OG_IMAGE),
        gone=(css(Part(id="outOfStock")),),
        phrases=("currently unavailable",),
    ),
    "mediamarkt": Site(
        name=(Look(css(Part("h1", attr=("data-test", "product-title")))), Look(css(Part("h1", attr=("data-test", "mms-product-name")))), Look(css(Part("h1")))),
        price=((Look(_by("data-test", "branded-price-whole-value")), Look(_by("data-test", "product-price")), Look(_by("itemprop", "price"), "content"), Look(_cls("price"))),),
        seller=(Look(_by("data-test", "marketplace-seller-name")), Look(_by("data-test", "sold-and-shipped-by"))),
        image=(Look(css(Part("img", attr=("data-test", "product-image"))), "src"), Look(css(Part("img", attr=("data-test", "product-image"))), "data-src"), _OG_IMAGE),
        phrases=("out-of-stock", "stokta yok", "ürün tükendi"),
    ),
    "pttavm": Site(
        name=(Look(_cls("product-name", "h1")), Look(_cls("product-title", "h1")), Look(css(Part(holds=("class", "ProductName")))), Look(css(Part("h1")))),
        price=(
            (Look(_by("itemprop", "price"), "content"), Look(_cls("product-price-new")), Look(either(_cls("price-current"), _cls("currentPrice"), _cls("productPrice"))),
            Look(either(css(Part(holds=("class", "Price__current"))), css(Part(holds=("class", "product-price")))))),
            (Look(css(Part(has="data-price")), "data-price"), Look(css(Part(has="data-product-price")), "data-product-price")),
        ),
        image=(_OG_IMAGE,),
        phrases=("stokta yok", "tükendi", "out-of-stock"),
    ),
    "n11": Site(
        name=(Look(_cls("proName", "h1"), every=True), Look(css(Part("h1")))),
        price=((Look(css(Part(cls="newPrice"), Part("ins"))), Look(css(Part(cls="priceContainer"), Part("ins")))),),
        seller=(Look(css(Part(cls="unf-p-sellerInfo"), Part("a")), every=True),),
        image=(Look(_cls("imgObj"), "data-original"), _OG_IMAGE),
        phrases=("stokta yok",),
    ),
}
#: Selectors of the light price recovery, for pages of any shop (EXT-13), in order.
RECOVERY = (
    _by("data-test-id", "price-current-price"), _by("data-test-id", "default-price"), _by("data-test-id", "price"), css(Part(cls="product-price"), Part(cls="price")),
    _cls("prc-dsc"), _cls("product-price"), _cls("price"),
)
_MERCHANT, _AVAILABLE, _MERCHANT_INFO = css(Part(id="merchantInfoFeature_feature_div")), css(Part(id="availability")), css(Part(id="merchantInfo"))
_CANONICAL = (Look(css(Part("link", attr=("rel", "canonical"))), "href"), Look(css(Part("meta", attr=("property", "og:url"))), "content"))


def page_tree(html: Column) -> Column:
    """The page's elements for all sites and the recovery."""
    looks = [*[x for s in SITES.values() for x in (*s.name, *chain.from_iterable(s.price), *s.seller, *s.image)], *_CANONICAL]
    selectors = [x.selector for x in looks] + [g for s in SITES.values() for g in s.gone] + [*RECOVERY, _MERCHANT, _AVAILABLE, _MERCHANT_INFO]
    return tree(html, selectors, {x.attr for x in looks if x.attr})


def look(page: Column, x: Look) -> Column:
    return attribute(page, x.selector, x.attr) if x.attr else all_text(page, x.selector) if x.every else text(page, x.selector)


def first_found(page: Column, looks: tuple[Look, ...]) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[look(page, x) for x in looks]) if looks else F.lit(None).cast("string")


def _first_price(labels: list[Column]) -> Column:
    """The first positive price among labels."""
    found = F.transform(F.array(*labels), parse_price_page)
    return F.get(F.filter(found, lambda x: x > 0), F.lit(0))


def first_price(page: Column, groups: tuple[tuple[Look, ...], ...]) -> Column:
    """The first positive price of the groups' first labels."""
    return _first_price([first_found(page, g) for g in groups])


def recovered(page: Column) -> Column:
    """EXT-13: the price of the first selector that has one."""
    return _first_price([text(page, s) for s in RECOVERY])


def next_data(html: Column) -> Column:
    """EXT-04: (name, price, image, seller, in_stock) of the product in a page's next-data, its price candidates in order."""
    at = lambda v, path: F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant
    nested = lambda v: kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY")
    first = lambda values, body: F.get(F.array_compact(F.transform(F.array(*values), body)), F.lit(0))
    text_of = lambda v: F.when(kind(v) == "STRING", v.cast("string"))
    price = lambda v: F.when(kind(v) == "STRING", parse_price_page(v.cast("string"))).when(~nested(v), v.cast("string").try_cast("double"))
    flag = lambda v: F.when(kind(v) == "BOOLEAN", v.cast("string") == "true")
    prices = ["price.value", "price.discountedPrice", "price.amount", "price.sellingPrice", "discountedPrice.value", "discountedPrice", "sellingPrice.value", "sellingPrice", "finalPrice"]
    images = [f"{p}{q}" for p in ("image", "images", "imageUrl") for q in ("", "[0]", ".contentUrl", ".url", "[0].contentUrl", "[0].url")]

    def fields(v: Column) -> Column:
        of = lambda paths: [at(v, f"$.{p}") for p in paths]
        stock = F.when(~nested(at(v, "$.stock")), at(v, "$.stock").cast("string").try_cast("double") > 0)
        return F.struct(
            first(of(["name", "title"]), text_of).alias("name"), first(of(prices), lambda x: bind(price(x), lambda n: F.when(n > 0, n))).alias("price"),
            first(of(images), text_of).alias("image"), first(of(["merchant.name", "seller.name"]), text_of).alias("seller"),
            F.coalesce(first(of(["inStock", "isInStock"]), flag), stock).alias("in_stock"),
        )

    data = F.try_parse_json(F.get(extract.scripts(html, 'id="__NEXT_DATA__"'), F.lit(0)))
    product = first([at(data, f"$.props.pageProps.{p}") for p in ("product", "productData", "initialState.product", "data.product")], lambda v: v)
    return bind(product, fields)


def script_price(html: Column) -> Column:
    """EXT-16: a positive number under one of four keys in a script of at most 200,000 characters, of the first script that has one."""
    scripts = F.filter(extract.scripts(html, ""), lambda s: F.char_length(s) <= 200_000)
    found = F.transform(scripts, lambda s: F.regexp_extract(s, r'"(?:offeredPrice|salePrice|finalPrice|sellingPrice)"\s*:\s*(\d+(?:\.\d+)?)', 1).try_cast("double"))
    return F.get(F.filter(found, lambda x: x > 0), F.lit(0))


def description_price(html: Column) -> Column:
    """EXT-16: an amount before a currency in the description."""
    said = F.coalesce(extract.meta(html, "description"), extract.meta(html, "og:description"))
    return _first_price([F.regexp_extract(said, r"(?i)(\d{1,3}(?:\.\d{3})*(?:,\d{2})?)\s*(?:TL|₺|TRY)", 1)])


def _title(name: Column) -> Column:
    """A shop's own name and the word for prices cut from a title."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?i)\s*[-–|]\s*Hepsiburada.*$", ""), r"(?i)\s*[-–|]\s*Fiyatı.*$", ""), r"\s+", " "))


def products(pages: DataFrame) -> DataFrame:
    """name, price, source (of the price), in_stock, seller and image of pages of known shops, from (page_id, site, html).

    EXT-06: a price comes from the first source that has a positive one, in the site's own order; EXT-07: where the page
    shows one seller's price it goes before the offers' least. Pages without name and price are left out.
    """
    html, page, ld, low, site = (F.col(c) for c in ("html", "page", "ld", "low", "site"))
    by_site = lambda f: _by_site(site, {n: f(s) for n, s in SITES.items()})
    p = pages.select("page_id", "site", "html", extract.ld_product(html).alias("ld"), page_tree(html).alias("page"), F.lower(html).alias("low"))
    merchant = F.regexp_extract(all_text(page, _MERCHANT), r"Satıcı\s+(\S[^\n]*?)(?:\s{2,}|$)", 1)
    info = F.left(F.regexp_replace(all_text(page, _MERCHANT_INFO), r"\s+", " "), F.lit(80))
    shop = F.url_decode(F.nullif(F.regexp_extract(first_found(page, _CANONICAL), r"[?&]magaza=([A-Za-z0-9_-]+)", 1), F.lit("")))
    missing = F.when(site == "amazon", F.lower(all_text(page, _AVAILABLE)).rlike("mevcut değil|temin edilemiyor"))
    gone = by_site(lambda s: _any([any_of(page, g) for g in s.gone] + [F.contains(low, F.lit(x)) for x in s.phrases]))
    p = p.select(
        "page_id", "site", "html", "ld", by_site(lambda s: first_found(page, s.name)).alias("dom_name"), by_site(lambda s: first_price(page, s.price)).alias("dom_price"),
        F.coalesce(by_site(lambda s: first_found(page, s.seller)), F.when(site == "amazon", F.coalesce(F.nullif(F.trim(merchant), F.lit("")), info)), F.when(site == "n11", shop)).alias("dom_seller"),
        by_site(lambda s: first_found(page, s.image)).alias("dom_image"), (~gone & ~F.coalesce(missing, F.lit(False))).alias("dom_stock"),
        F.when(site == "hepsiburada", next_data(html)).alias("next"), F.when(site == "hepsiburada", description_price(html)).alias("described"),
        F.when(site.isin("hepsiburada", "pttavm"), _first_price([extract.meta(html, m) for m in ("product:price:amount", "product:sale_price:amount", "og:price:amount")])).alias("og_price"),
        F.when(site.isin("hepsiburada", "pttavm"), extract.meta(html, "og:title")).alias("og_title"),
    )
    dom, ld_price, next_price = F.col("dom_price"), ld["price"], F.col("next")["price"]
    late = dom.isNull() & F.col("described").isNull()  # scripts are searched only when neither has a price
    told = F.when(dom.isNull(), F.col("described"))
    sources = {
        "trendyol": {"json-ld": ld_price, "selector": dom}, "n11": {"selector": dom, "json-ld": ld_price}, "amazon": {"json-ld": ld_price, "selector": dom}, "mediamarkt": {"json-ld": ld_price, "selector": dom},
        "hepsiburada": {"json-ld": ld_price, "next-data": next_price, "selector": dom, "meta": F.col("og_price"), "script": F.when(late, script_price(html)), "description": told},
        "pttavm": {"json-ld": ld_price, "selector": dom, "meta": F.col("og_price")},
    }
    priced = _by_site(site, {n: F.get(F.filter(F.array(*[F.struct(c.alias("price"), F.lit(k).alias("source")) for k, c in order.items()]), lambda x: x["price"] > 0), F.lit(0)) for n, order in sources.items()})
    shown = (site == "trendyol") & (F.coalesce(ld_price, F.lit(0.0)) == 0)  # there the page overrides data without a price
    pick = lambda from_page, of_ld, of_next=None: F.when(shown, F.coalesce(from_page, of_ld)).otherwise(F.coalesce(*[c for c in (of_ld, of_next, from_page) if c is not None]))
    og_title = F.when(site == "pttavm", F.nullif(F.trim(F.regexp_replace("og_title", r"(?i)\s*[-–|]\s*PTT.*$", "")), F.lit(""))).otherwise(F.col("og_title"))
    # Names of products that have none
    unnamed = F.when(site == "pttavm", "PTT AVM ürünü").when((site == "hepsiburada") & priced.isNotNull(), "Hepsiburada ürünü")
    name = F.coalesce(F.nullif(ld["name"], F.lit("")), F.col("next")["name"], F.col("dom_name"), og_title)
    out = F.struct(
        F.coalesce(F.nullif(F.when(site == "hepsiburada", _title(name)).otherwise(name), F.lit("")), unnamed).alias("name"), priced.alias("priced"), pick(F.col("dom_stock"), ld["in_stock"], F.col("next")["in_stock"]).alias("in_stock"),
        pick(F.col("dom_seller"), ld["seller"], F.col("next")["seller"]).alias("seller"), pick(F.col("dom_image"), ld["image"], F.col("next")["image"]).alias("image"),
    )
    # a generator, so that the filter on its columns isn't pushed below and the parsing done twice
    j = p.select("page_id", "site", F.inline(F.array(out))).where("name <> '' OR priced IS NOT NULL")
    return j.select("page_id", "site", "name", F.coalesce("priced.price", F.lit(0.0)).alias("price"), "priced.source", "in_stock", "seller", "image")


def _by_site(site: Column, values: dict[str, Column]) -> Column:
    out = F
    for name, value in values.items():
        out = out.when(site == name, value)
    return out


def _any(checks: list[Column]) -> Column:
    out = F.lit(False)
    for c in checks:
        out = out | c
    return out
