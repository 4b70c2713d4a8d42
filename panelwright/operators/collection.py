"""From captured listing pages to variant rows: parsing, sizes, flags, pages still missing, and the work left for product pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import text as X
from panelwright.functions.periods import quarter_of, stamp_date
from panelwright.operators.pages import match_handles
from panelwright.operators.quality import price_outliers

_PRODUCTS = "struct<products:array<struct<id:string,type:string,variants:array<struct<id:string,price:string,name:string,public_title:string,sku:string>>>>>"
#: Snapshots before this year are not asked for (a fixed value).
START_YEAR = 2023
CDX = "https://web.archive.org/cdx/search/cdx"


def variant_rows(pages: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """keys, product_id, product_type, product_title, variant_id, variant_title, price_inr, sku: one row per variant of each product in a page's JSON; missing texts are blank, prices in paise become rupees, the product's title is the variant's name without the variant's own ending."""
    products = pages.select(*keys, F.explode(F.from_json(json, _PRODUCTS)["products"]).alias("p"))
    v = products.select(*keys, "p.id", "p.type", F.explode("p.variants").alias("v"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return v.select(*keys, F.col("id").alias("product_id"), blank("type").alias("product_type"), X.product_title(F.col("v.name"), F.col("v.public_title")).alias("product_title"), F.col("v.id").alias("variant_id"), blank("v.public_title").alias("variant_title"), X.paise_to_rupees(F.col("v.price")).alias("price_inr"), blank("v.sku").alias("sku"))


def finish_rows(rows: DataFrame, page_size: Column | None = None, bundle_by_price: Column | None = None, live_grams: Column | None = None) -> DataFrame:
    """rows with size_grams, multipack, size_source, is_coffee_guess and is_bundle.

    A row is a bundle by its title, or by its price (bundle_by_price; such a row gets no size of the page). The
    shipping weight live_grams is the last resort. A bundle that is known to be something else is none.
    """
    priced = F.coalesce(bundle_by_price, F.lit(False)) if bundle_by_price is not None else F.lit(False)
    bundle = X.is_bundle(F.col("product_title")) | priced
    page = F.when(~priced, page_size) if page_size is not None else None
    out = rows.withColumns({"__b": bundle, "__s": X.resolve_size(F.col("variant_title"), F.col("product_title"), page)})
    ship = live_grams.cast("double") if live_grams is not None else F.lit(None).cast("double")
    last = F.col("__s.grams").isNull() & ship.isNotNull()
    out = out.withColumns({"size_grams": F.coalesce(F.col("__s.grams"), ship), "multipack": F.when(last, False).otherwise(F.col("__s.multipack")), "size_source": F.when(last, "live_shipping_grams").otherwise(F.col("__s.source"))})
    out = out.withColumn("is_coffee_guess", X.coffee_guess(F.col("product_title"), F.col("product_type"), F.col("size_grams").isNotNull(), F.col("__b")))
    return out.withColumn("is_bundle", F.col("__b") & ~F.col("is_coffee_guess").eqNullSafe(F.lit(False))).drop("__b", "__s")


def rows_from_page(variants: DataFrame, page: list[str]) -> DataFrame:
    """Finished rows of archived pages, with served_outside_quarter and in_switch_window.

    variants: rows of variant_rows with the columns `page` (the keys of a page) and quarter, served_ts,
    url_switch_window, single_size (the shop sells one size only) and page_size (struct grams, multipack). On
    such shops a product far above the page's median price is a bundle.
    """
    marked = price_outliers(variants, page, "price_inr").withColumn("outlier", F.col("outlier") & F.coalesce("single_size", F.lit(False)))
    done = finish_rows(marked, F.when(F.col("single_size"), F.col("page_size")), F.col("outlier"))
    served = stamp_date(F.col("served_ts"))
    return done.withColumns({"source_type": F.lit("archive"), "served_outside_quarter": quarter_of(served) != F.col("quarter"), "in_switch_window": X.in_switch_window(F.col("url_switch_window"), served), "is_outlier": F.col("outlier")}).drop("outlier", "single_size", "page_size", "url_switch_window")


def uniform_listing_size(html: Column) -> Column:
    """struct(grams, multipack) of the only size that a page's visible text shows; null for none or several."""
    grams = X.single_size(X.visible_text(html))
    return F.when(grams.isNotNull(), F.struct(grams.alias("grams"), F.lit(False).alias("multipack")))


def in_quarter(rows: DataFrame) -> DataFrame:
    """Rows whose capture really falls in their quarter."""
    return rows.where(~F.coalesce("served_outside_quarter", F.lit(False)))


def linked_pages(html: Column, path: Column) -> Column:
    """The sorted page numbers (2 and above) of a listing that a page links to."""
    hrefs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'href="([^"]*[?&]page=\d+[^"]*)"'), F.lit(1))
    whole = lambda h: F.replace(F.when(h.contains("//"), h).otherwise(F.concat(F.lit("https://x"), h)), F.lit("&amp;"), F.lit("&"))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(hrefs, lambda h: X.page_number(whole(h), path)))))


def paged_snapshots(captures: DataFrame, listing: str, path: str, ts: str, url: str) -> DataFrame:
    """listing, page, captures (array of ts and url, in order of ts): the captures of pages 2 and above of each listing."""
    at = captures.withColumn("page", X.page_number(F.col(url), F.col(path))).where("page is not null")
    return at.groupBy(listing, "page").agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(url).alias("url")))).alias("captures"))


def merged_snapshots(captures: DataFrame, by: list[str]) -> DataFrame:
    """by, ts, url: the captures of several addresses of a listing together; of equal times the later address (url_order) counts."""
    return captures.groupBy(*by, "ts").agg(F.max_by("url", F.struct("url_order", "url")).alias("url"))


def host_handles(pages: DataFrame, url: str, html: str) -> DataFrame:
    """host, handle: every product that the pages of a host link to."""
    return pages.select(F.try_parse_url(F.col(url), F.lit("HOST")).alias("host"), F.explode(X.linked_handles(F.lower(html))).alias("handle")).distinct()


def archived_handle(url: Column) -> Column:
    """The handle in the URL of a product page; null for other pages."""
    found = F.lower(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/products/([^/?#]+)/?$", 1))
    return F.when(found != "", found)


def map_handles(rows: DataFrame, live: DataFrame, links: DataFrame) -> DataFrame:
    """roaster, product_id, host, product_title, handle, handle_source of each archived product: the live catalogue's handle, else its title's slug if a listing of its host links to it, else unmapped.

    live: roaster, product_id, handle; links: host, handle. Of a product's rows the first in quarter and variant counts.
    """
    row = F.struct("source_url", "product_title")
    one = rows.where("source_type = 'archive' and product_id is not null").groupBy("roaster", "product_id").agg(F.min_by(row, F.struct("quarter", "variant_id")).alias("r"))
    one = one.select("roaster", "product_id", F.try_parse_url("r.source_url", F.lit("HOST")).alias("host"), "r.product_title", X.slugify(F.col("r.product_title")).alias("slug"))
    got = one.join(live.select("roaster", "product_id", F.col("handle").alias("lh")), ["roaster", "product_id"], "left").join(links.select(F.col("host").alias("h2"), F.col("handle").alias("sh")).distinct(), (F.col("host") == F.col("h2")) & (F.col("slug") == F.col("sh")), "left")
    source = F.when(F.col("lh").isNotNull(), "live").when(F.col("sh").isNotNull(), "title_slug").otherwise("unmapped")
    return got.select("roaster", "product_id", "host", "product_title", F.coalesce("lh", "sh", F.lit("")).alias("handle"), source.alias("handle_source"))


def targets(rows: DataFrame) -> DataFrame:
    """roaster, product_id, quarter, host, product_title, served_ts: the products and quarters whose sizes only a product page can give; sizes that came from one before count as missing, so that the list stays the same when it is made again."""
    bare = F.col("size_grams").isNull() | F.coalesce(F.col("size_source").startswith("product_page"), F.lit(False))
    open_ = in_quarter(rows).where((F.col("source_type") == "archive") & bare & F.coalesce("is_coffee_guess", F.lit(True)))
    row = F.struct(F.try_parse_url("source_url", F.lit("HOST")).alias("host"), "product_title", "served_ts")
    return open_.groupBy("roaster", "product_id", "quarter").agg(F.min_by(row, "variant_id").alias("r")).select("roaster", "product_id", "quarter", "r.*")


def resolve_handles(work: DataFrame, known: DataFrame, archived: DataFrame) -> DataFrame:
    """work with handle and handle_source: the known one, else the one that the host's archived product pages (host, handle) give, else unmapped."""
    w = work.join(known.select("roaster", "product_id", F.col("handle").alias("kh"), F.col("handle_source").alias("ks")), ["roaster", "product_id"], "left").withColumn("slug", X.slugify(F.col("product_title")))
    found = match_handles(w.select("host", "slug").distinct(), archived, "host", "slug").select(F.col("host").alias("fh"), F.col("slug").alias("fs"), F.col("handle").alias("ah"), F.col("handle_source").alias("as_"))
    w = w.join(found, F.col("host").eqNullSafe(F.col("fh")) & (F.col("slug") == F.col("fs")), "left")
    has = F.coalesce("kh", F.lit("")) != ""
    source = F.when(has, F.col("ks")).otherwise(F.when(F.col("as_") == "unmapped", "unmapped").otherwise(F.concat(F.lit("cdx_"), F.col("as_"))))
    return w.select(*work.columns, F.when(has, F.col("kh")).otherwise(F.coalesce("ah", F.lit(""))).alias("handle"), F.coalesce(source, F.lit("unmapped")).alias("handle_source"))


def page_statuses(work: DataFrame, captures: DataFrame, sizes: DataFrame) -> DataFrame:
    """work with product_snapshot_ts and status: unmapped, no_snapshot_in_quarter, no_variant_data or ok.

    captures: host, handle, ts; the one of the work's quarter that is nearest to its listing's date counts, of
    equals the earlier. sizes: host, handle, ts of the captures in which variants were found.
    """
    c = captures.select(F.col("host").alias("ch"), F.col("handle").alias("chd"), "ts").withColumn("cq", quarter_of(stamp_date(F.col("ts"))))
    keys = ["roaster", "product_id", "quarter"]
    near = work.join(c, (F.col("host") == F.col("ch")) & (F.col("handle") == F.col("chd")) & (F.col("quarter") == F.col("cq")))
    gap = F.abs(F.datediff(stamp_date(F.col("ts")), stamp_date(F.col("served_ts"))))
    best = near.groupBy(*keys).agg(F.min_by("ts", F.struct(gap.alias("gap"), "ts")).alias("product_snapshot_ts"))
    has = sizes.select(F.col("host").alias("sh"), F.col("handle").alias("shd"), F.col("ts").alias("sts")).distinct()
    out = work.join(best, keys, "left").join(has, (F.col("host") == F.col("sh")) & (F.col("handle") == F.col("shd")) & (F.col("product_snapshot_ts") == F.col("sts")), "left")
    status = F.when(F.coalesce("handle", F.lit("")) == "", "unmapped").when(F.col("product_snapshot_ts").isNull(), "no_snapshot_in_quarter").when(F.col("sts").isNull(), "no_variant_data").otherwise("ok")
    return out.select(*work.columns, "product_snapshot_ts", status.alias("status"))


def apply_page_sizes(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Archived rows without a size get that of their product page; compare-at prices of product pages count before those of listings; the guess of a row that gets a size is made again.

    pages: roaster, product_id, quarter, variant_id, size_grams, multipack, size_source, compare_at_price_inr; of several the first by source counts.
    """
    keys = ["roaster", "product_id", "quarter", "variant_id"]
    kept = F.struct("size_grams", "multipack", "size_source", "compare_at_price_inr")
    p = pages.where("variant_id is not null").groupBy(*keys).agg(F.min_by(kept, F.struct("size_source", "size_grams")).alias("__p"))
    j = rows.join(p, keys, "left")
    old = F.col("source_type") == "archive"
    fill = old & F.col("size_grams").isNull() & F.col("__p.size_grams").isNotNull()
    guess = X.coffee_guess(F.col("product_title"), F.col("product_type"), F.lit(True), F.coalesce("is_bundle", F.lit(False)))
    new = {"compare_at_price_inr": F.when(old, F.coalesce("__p.compare_at_price_inr", "compare_at_price_inr")).otherwise(F.col("compare_at_price_inr")), "is_coffee_guess": F.when(fill, guess).otherwise(F.col("is_coffee_guess"))}
    new |= {c: F.when(fill, F.col(f"__p.{c}")).otherwise(F.col(c)) for c in ("multipack", "size_source")}
    return j.withColumns(new).withColumn("size_grams", F.when(fill, F.col("__p.size_grams")).otherwise(F.col("size_grams"))).drop("__p").select(*rows.columns)


def work_estimate(rows: DataFrame, handles: DataFrame) -> DataFrame:
    """kind (sizes, sales), rows, product_quarters, products, products_mapped, page_fetches: what product pages would have to be fetched for."""
    archive = rows.where("source_type = 'archive'")
    need = {"sizes": F.col("size_grams").isNull() & F.coalesce("is_coffee_guess", F.lit(True)), "sales": F.coalesce(F.col("sale_suspected") == "candidate", F.lit(False))}
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in need.items()]))
    mapped = handles.where("handle <> ''").select("roaster", "product_id", F.lit(True).alias("mapped")).distinct()
    w = archive.select("roaster", "product_id", "quarter", F.explode(kinds).alias("kind")).join(mapped, ["roaster", "product_id"], "left")
    product, there = F.struct("roaster", "product_id"), F.coalesce("mapped", F.lit(False))
    quarter = F.struct("roaster", "product_id", "quarter")
    return w.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(quarter).alias("product_quarters"), F.countDistinct(product).alias("products"), F.count_distinct(F.when(there, product)).alias("products_mapped"), F.count_distinct(F.when(there, quarter)).alias("page_fetches"))


def valid_products_json(body: Column) -> Column:
    """Whether a text is a catalogue: a list of products of which the first has a variant with a price."""
    keys = F.json_object_keys(F.get_json_object(body, "$.products[0].variants[0]"))
    return F.coalesce(F.array_contains(keys, "price"), F.lit(False))


def live_roasters(final: DataFrame, counted: DataFrame) -> DataFrame:
    """final with archive_urls (the addresses that were counted, in order) and live_url (the last listing address, which is the current one)."""
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), lambda u: F.trim(u)), lambda u: u != "")
    out = final.join(counted.select("roaster", "archive_urls_counted"), "roaster")
    return out.withColumns({"archive_urls": parts("archive_urls_counted"), "live_url": F.try_element_at(parts("archive_listing_urls"), F.lit(-1))}).drop("archive_urls_counted")


def _query(params: dict[str, Column | str]) -> Column:
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(v if isinstance(v, Column) else F.lit(v))) for k, v in params.items()]
    return F.concat(F.lit(f"{CDX}?"), F.concat_ws("&", *pairs))


def cdx_query_url(target: Column, prefix: bool) -> Column:
    """Address of the list of a page's captures; with prefix, of the page with any query."""
    return _query({"url": target, "from": str(START_YEAR), "output": "json", "fl": "timestamp,original", "filter": "statuscode:200"} | ({"matchType": "prefix"} if prefix else {}))


def discovery_url(host: Column) -> Column:
    """Address of the list of all product pages of a host that were ever captured."""
    return _query({"url": F.concat(host, F.lit("/products/")), "matchType": "prefix", "from": str(START_YEAR), "output": "json", "fl": "original", "collapse": "urlkey", "filter": "statuscode:200"})


def live_page_url(live_url: Column, page: Column | int) -> Column:
    """Address of a page of a live catalogue."""
    part = lambda name: F.try_parse_url(live_url, F.lit(name))
    return F.concat(part("PROTOCOL"), F.lit("://"), part("HOST"), F.coalesce(part("PATH"), F.lit("")), F.lit("/products.json?limit=250&page="), (page if isinstance(page, Column) else F.lit(page)).cast("string"))
