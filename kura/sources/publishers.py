"""Book records from publishers' pages: (publisher, url, html) rows in, records out, by one reader a kind of page.

A reader looks only at its own page, so pages are read by tasks on their own; what joins pages (schedules with product pages, first of
repeated articles) is joins and windows below. Fixed values - labels, patterns and keys that results depend on - stand in the readers'
tables. A page that isn't of the expected form gives no record."""

from __future__ import annotations

import hashlib
import html
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date
from urllib.parse import parse_qs, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .markup import parse, spaced, table_rows

RECORD = "publisher_code string, source_key string, title string, media_type string, author string, isbn string, cover_url string, list_price long, release_date date, release_precision string, release_date_source string, source_url string"
KINDS = [("publisher_code", pa.string()), ("source_key", pa.string()), ("title", pa.string()), ("media_type", pa.string()), ("author", pa.string()), ("isbn", pa.string()), ("cover_url", pa.string()), ("list_price", pa.int64()), ("release_date", pa.date32()), ("release_precision", pa.string()), ("release_date_source", pa.string()), ("source_url", pa.string())]

# The fields of product pages, the announcement's form, and rating labels.
SPP_FIELDS = {"number": r"書\s*號：\s*([A-Za-z0-9-]+)", "author": r"作\s*者：\s*(.+?)(?=\s+(?:譯\s*者|繪\s*者|書\s*系|規\s*格|等\s*級|上市日)：)", "isbn": r"條\s*碼：\s*([0-9Xx-]{8,24})", "date": r"上市日：\s*(20\d{2}/\d{1,2}/\d{1,2})"}
TOHAN_FIELDS = {"author": r"^作者\s+(.+?)\s+(?:譯者|ISBN)", "isbn": r"ISBN\s+([0-9Xx-]{8,20})", "date": r"出版日期\s+(\d{4}-\d{2}-\d{2})", "price": r"定價\s+NT\$\s*([0-9,]+)"}
KADOKAWA_FIELDS = {"author": r"(?:作者資訊：|作者：)\s*(.+?)(?=\s+(?:上市日期：|ISBN：|條碼：|NT\$|\{\{))", "date": r"上市日期：\s*(20\d{2}/\d{1,2}/\d{1,2})", "isbn": r"(?:ISBN|條碼)：\s*([0-9Xx-]{8,24})", "price": r"NT\$\s*([0-9,]+)"}
CHINGWIN_ENTRY = r"類別：\s*(漫畫|小說|輕小說)\s+書名：\s*(.+?)\s+作者：\s*(.+?)\s+書系：\s*(.*?)\s+定價：\s*([0-9,]+)\s+首刷附錄：\s*(.*?)\s*電子書：\s*(.*?)(?=類別：|會員服務|$)"
SPP_MARK = 'SalePageIndexViewModel"] = '
RATINGS = {"普": "general", "普遍級": "general", "限制級": "restricted_18", "保護級": "protected_6", "輔12級": "guidance_12", "輔15級": "guidance_15"}
RATING_LABELS = {"kadokawa": r"^(?:🔞\s*)?(普遍級|限制級|保護級|輔12級|輔15級)\s*$", "tohan": r"級別\s*[:：]\s*([^\s<]+)", "spp": r"等\s*級\s*[:：]\s*([^\s<]+)", "tongli": r"圖書分級\s*[:：]\s*([^\s<]+)"}
BL_LABELS = ["BL", "BL漫畫", "BL小說", "耽美漫畫", "耽美小說", "耽夢文庫"]


def flat(markup: str) -> str:
    return spaced(parse(markup)[0])


def fields(rules: dict[str, str], text: str) -> dict[str, str | None]:
    """What each rule finds first in a text."""
    return {name: (m[1].strip() or None) if (m := re.search(rule, text)) else None for name, rule in rules.items()}


def day(value: str | None) -> date | None:
    """A date of year, month and day in digits, null for none."""
    try:
        return date(*map(int, re.split(r"[/-]", value))) if value else None
    except (TypeError, ValueError):
        return None


def number(value: str | None) -> int | None:
    digits = (value or "").replace(",", "")
    return int(digits) if digits.isdigit() else None


def sha1(*parts: str) -> str:
    return hashlib.sha1("|".join(parts).encode()).hexdigest()


def record(code: str, url: str, key: str, title: str, media: str, on: date | None = None, source: str = "unknown", precision: str = "day", **more) -> dict:
    return {"publisher_code": code, "source_key": key, "title": title, "media_type": media, "release_date": on, "release_precision": precision if on else "unknown", "release_date_source": source if on else "unknown", "source_url": url} | more


def egmanga(url: str, markup: str) -> Iterator[dict]:
    """A monthly announcement: a table of month/day rows; the year is that of the article, across the turn of the year the next or the last."""
    if not (posted := re.search(r"(20\d{2})[-/]([01]?\d)[-/][0-3]?\d", flat(markup))):
        return
    year, month = map(int, posted.groups())
    for row in table_rows(markup):
        if len(row) < 6 or not re.fullmatch(r"\d{1,2}/\d{1,2}", row[0]) or row[1] not in ("漫畫", "小說") or not row[2]:
            continue
        own = int(row[0].split("/")[0])
        turn = (month >= 11 and own <= 2) - (month <= 2 and own >= 11)
        yield record("egmanga", url, sha1(*row[1:4]), row[2], "novel" if row[1] == "小說" else "manga", day(f"{year + turn}/{row[0]}"), author=row[3] or None, list_price=number(row[5]))


def tongli_planned(url: str, markup: str) -> Iterator[dict]:
    """A list of planned books without dates."""
    for row in table_rows(markup):
        title = re.sub(r"^#+\s*", "", row[0]) if len(row) >= 5 else ""
        if title and title not in ("書名／集數", "書名/集數"):
            yield record("tongli", url, f"planned:{sha1('planned', title, row[1], row[2])}", title, "novel" if "小說" in row[2] else "manga", author=row[1] or None, list_price=number(row[4]))


def spp_schedule(url: str, markup: str) -> Iterator[dict]:
    """The table of an official schedule: date, title, other title, number."""
    for row in table_rows(markup):
        on = day(row[0]) if len(row) >= 4 and re.fullmatch(r"20\d{2}/\d{1,2}/\d{1,2}", row[0]) else None
        title = (row[1] or row[2]) if on else ""
        if title and row[3]:
            novel = re.match(r"[【〖]輕小說[】〗]\s*", title)
            yield record("spp", url, row[3], title[novel.end() :] if novel else title, "novel" if re.search(r"[【〖]輕小說[】〗]", title) else "manga", on)


def embedded(markup: str) -> dict:
    """The object that a product page of spp holds in a script; {} where there is none."""
    _, mark, rest = markup.partition(SPP_MARK)
    try:
        found = json.JSONDecoder().raw_decode(rest.replace("\\'", "'").lstrip())[0] if mark else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def spp_product(url: str, markup: str) -> Iterator[dict]:
    data = embedded(markup)
    kind = {"漫畫": "manga", "輕小說": "novel"}.get(str((data.get("CategoryLevelName") or {}).get("Level1_ShopCategory_Name", "")).strip())
    title, own = str(data.get("Title", "")).strip(), str(data.get("Id", "")).strip()
    if not (kind and title and own):
        return
    found = fields(SPP_FIELDS, flat(str(data.get("ShortDescription", ""))))
    cover = str((data.get("ImageList") or [{}])[0].get("PicUrl", "")).strip()
    price = data.get("SuggestPrice")
    yield record(
        "spp", url, found["number"] or own, title, kind, day(found["date"]), "product", author=found["author"], isbn=re.sub(r"[^0-9Xx]", "", found["isbn"]) if found["isbn"] else None,
        cover_url=("https:" + cover if cover.startswith("//") else cover) or None, list_price=int(price) if isinstance(price, int | float) else None,
    )


def tohan_product(url: str, markup: str) -> Iterator[dict]:
    text, _, meta = parse(markup)
    head = text.split("\n", 1)[0]
    above = re.search(r"(?:^|\n)([^\n]{2,200})\n+作者\n", text)
    names = [meta.get("og:title", "").split("_")[0].strip(), re.split(r"[_|]", head)[0].strip(), above[1].strip() if above else ""]
    title = next((n for n in names[:2] if n not in ("", "書名", "台灣東販")), names[2])
    key = parse_qs(urlsplit(url).query).get("id", [""])[0]
    if title and key:
        start = text.rfind("\n作者\n")  # the last such label is the product's
        found = fields(TOHAN_FIELDS, spaced(text[start + 1 :] if start >= 0 else text))
        media = "novel" if "小說" in f"{head} {title}" else "manga"
        isbn = found["isbn"] and found["isbn"].replace("-", "")
        yield record("tohan", url, key, title, media, day(found["date"]), "product", author=found["author"], isbn=isbn, cover_url=meta.get("og:image"), list_price=number(found["price"]))


def kadokawa_product(url: str, markup: str) -> Iterator[dict]:
    text, _, meta = parse(markup)
    text, title = spaced(text), re.sub(r"\s*[|｜].*$", "", meta.get("og:title", "")).strip()
    key = urlsplit(url).path.rstrip("/").rsplit("/", 1)[-1]
    if not (title and key):
        return
    places = [m.start() for m in re.finditer(re.escape(title), text)]
    dated = [p for p in places if "上市日期：" in text[p : p + 2500]]  # the product's own block, not a recommendation
    at = (dated or places or [max(0, text.rfind("上市日期：") - 800)])[-1]
    found, before = fields(KADOKAWA_FIELDS, text[at : at + 2500]), text[max(0, at - 450) : at]
    novel, manga = before.rfind("輕小說"), before.rfind("漫畫")
    media = "novel" if novel > manga else "manga" if manga >= 0 else "unknown"
    isbn = found["isbn"] and found["isbn"].replace("-", "")
    yield record("kadokawa", url, key, title, media, day(found["date"]), "product", author=found["author"], isbn=isbn, cover_url=meta.get("og:image"), list_price=number(found["price"]))


def chingwin_article(url: str, markup: str) -> Iterator[dict]:
    """A monthly announcement: entries of labelled fields, dated by month."""
    text, _, meta = parse(markup)
    text = spaced(text)
    months = (re.search(r"(20\d{2})年\s*(\d{1,2})月", t) for t in (meta.get("og:title") or text[:300], text))
    on = next((day(f"{m[1]}/{m[2]}/1") for m in months if m), None)
    for kind, title, author, _, price, _, _ in re.findall(CHINGWIN_ENTRY, text) if on else ():
        if title.strip() not in ("", "書名"):
            yield record("chingwin", url, sha1(url, kind, title.strip(), author), title.strip(), "manga" if kind == "漫畫" else "novel", on, "schedule", "month", author=author.strip(), list_price=number(price))


def chingwin_catalog(url: str, markup: str) -> Iterator[dict]:
    """A listing whose linked data has a Book and a Product of each title; a title's last product counts."""
    objects = []
    for raw in re.findall(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", markup):
        try:
            objects.append(json.loads(html.unescape(raw).strip()))
        except ValueError:
            continue
    named = [(str(o.get("@type", "")).lower(), spaced(str(o.get("name", ""))), o) for o in objects if isinstance(o, dict)]
    products = {name: o for kind, name, o in named if kind == "product" and name}
    for kind, title, book in named:
        product = products.get(title, {})
        key = str(product.get("sku", "")).strip()
        if kind == "book" and title and key:
            writers = (book.get("author") or {}).get("name") if isinstance(book.get("author"), dict) else None
            writers = writers[0] if isinstance(writers, list) and writers else writers
            offer = product.get("offers") if isinstance(product.get("offers"), dict) else {}
            image = book.get("image") or product.get("image")
            image = image[0] if isinstance(image, list) and image else image
            cover = urljoin(url, image.strip()) if isinstance(image, str) and image.strip() else None
            yield record("chingwin", urljoin(url, f"/product-detail/{key}"), key, title, "unknown", day(str(book.get("datePublished", ""))[:10]), author=str(writers).strip() if writers else None, isbn=re.sub(r"[^0-9Xx]", "", str(book.get("isbn", ""))) or None, cover_url=cover, list_price=number(str(offer.get("price", ""))))


READERS: dict[str, Callable[[str, str], Iterator[dict]]] = {
    "egmanga": egmanga, "tongli_planned": tongli_planned, "spp_schedule": spp_schedule, "spp_product": spp_product, "tohan_product": tohan_product,
    "kadokawa_product": kadokawa_product, "chingwin_article": chingwin_article, "chingwin_catalog": chingwin_catalog,
}


def records(pages: DataFrame, reader: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The records of all pages, with page_order where pages has it. Null pages have none."""
    order = [c for c in ("page_order",) if c in pages.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = READERS[reader]
        for batch in batches:
            rows = [(r, i) for i, (u, m) in enumerate(zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True)) if m for r in read(u or "", m)]
            columns = [pa.array([r.get(n) for r, _ in rows], k) for n, k in KINDS]
            more = [batch[c].take(pa.array([i for _, i in rows], pa.int64())) for c in order]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*(n for n, _ in KINDS), *order])

    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"), *[F.col(c).cast("long").alias(c) for c in order])
    return rows.mapInArrow(run, RECORD + "".join(f", {c} long" for c in order))


def first_records(found: DataFrame) -> DataFrame:
    """Of records with equal keys that of the first page in page_order."""
    first = F.row_number().over(Window.partitionBy("publisher_code", "source_key").orderBy("page_order", "title"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n", "page_order")


def enriched(schedule: DataFrame, details: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Scheduled books with what their product pages give: a dated page as it is, an undated one with the schedule's date; pages that no
    schedule names come in if their date isn't older than days."""
    names = [n for n, _ in KINDS if n != "source_key"]
    s, d = (df.select("source_key", F.struct(*names).alias(side)) for df, side in ((schedule, "s"), (details, "d")))
    both = s.join(d, "source_key", "full_outer").where(F.col("s").isNotNull() | (F.col("d.release_date") >= F.date_sub(today, days)))
    dated = F.col("d.release_date").isNotNull()

    def pick(n: str) -> Column:
        if n in ("release_date", "release_precision"):
            return F.when(dated, F.col(f"d.{n}")).otherwise(F.col(f"s.{n}"))
        if n == "release_date_source":
            return F.when(dated, F.col("d.release_date_source")).when(F.col("d").isNotNull(), "unknown").otherwise(F.col("s.release_date_source"))
        return F.when(F.col("d").isNotNull(), F.col(f"d.{n}")).otherwise(F.col(f"s.{n}"))

    return both.select("source_key", *[pick(n).alias(n) for n in names])


# ---- ratings and categories of product pages ----


def _rated(code: str, url: str, markup: str, key: str, isbn: str | None) -> str:
    """The text of a page in which its one rating label is looked for, '' where the page is another book's."""
    text = parse(markup)[0]
    if code == "kadokawa":
        badges = re.findall(r"(?is)<p\b[^>]*class=[\"'][^\"']*\bProduct-summary\b[^\"']*[\"'][^>]*>(.*?)</p>", markup)
        return flat(badges[0]) if len(badges) == 1 else ""
    if code == "tohan":
        body = re.split("相關推薦|訂購需知|訂購須知", text)[0]
        own = re.split(r"(?:^|\n)作者\n", body)
        out, rule = spaced(own[-1]) if len(own) > 1 else "", r"ISBN\s*[:：]?\s*([0-9Xx-]{8,24})"
    elif code == "spp":
        data = embedded(markup)
        out, rule = flat(data.get("ShortDescription") or ""), r"條\s*碼[:：]\s*([0-9Xx-]{8,24})"
        own_number = re.search(r"書\s*號[:：]\s*([A-Za-z0-9-]+)", out)
        if str(data.get("Id")) != urlsplit(url).path.rstrip("/").rsplit("/", 1)[-1] or key != (own_number[1] if own_number else str(data.get("Id"))):
            return ""
    elif code == "tongli":
        name = re.search(r"(?:漫畫|小說)書籍資料\s*\n([^\n]+)\n原文書名：", text)
        one = spaced(text)
        start = one.find(name[1].strip()) if name else -1
        out, rule = (one[start : one.find("內容簡介", start)] if start >= 0 and one.find("內容簡介", start) >= 0 else ""), r"ISBN[:：]\s*([0-9Xx-]{8,24})"
    else:
        return ""
    given = re.search(rule, out)
    return "" if isbn and given and given[1].replace("-", "") != isbn.replace("-", "") else out


def rating_of(code: str, url: str, markup: str, key: str, isbn: str | None = None) -> str:
    """The rating that a product page states in exactly one label, else unknown."""
    labels = re.findall(RATING_LABELS.get(code, r"$^"), unicodedata.normalize("NFKC", _rated(code, url, markup, key, isbn)))
    return RATINGS.get(labels[0].strip(), "unknown") if len(labels) == 1 else "unknown"


def bl_label(value) -> str | None:
    own = re.sub(r"\s+", "", unicodedata.normalize("NFKC", value)).casefold() if isinstance(value, str) else ""
    return next((x for x in BL_LABELS if x.casefold() == own), None)


def bl_of(code: str, url: str, markup: str, key: str) -> str | None:
    """The BL category that a product page gives: its own category fields, the last crumb of its path, or what its description says, unless that
    denies it."""
    text, links, meta = parse(markup)
    if code == "chingwin" and ((own := re.search(r"產品編號\s*[:：]\s*([A-Za-z0-9_-]+)", spaced(text))) is None or own[1] != key):
        return None
    if code == "spp":
        data = embedded(markup)
        if not data or str(data.get("Id")) != urlsplit(url).path.rstrip("/").rsplit("/", 1)[-1]:
            return None
        levels, seo = (data.get(n) if isinstance(data.get(n), dict) else {} for n in ("CategoryLevelName", "SEOTag"))
        named = [data.get("CategoryName"), *(v for k, v in levels.items() if k.endswith("_Name")), *re.split(r"[,，;；|]", str(seo.get("Keywords") or ""))]
        if found := next(filter(None, map(bl_label, named)), None):
            return found
    crumbs = re.findall(r"(?is)<(?:nav|ol|ul|div)\b[^>]*(?:class|aria-label)=[\"'][^\"']*breadcrumb[^\"']*[\"'][^>]*>(.*?)</(?:nav|ol|ul|div)>", markup)
    labels = [x for c in crumbs for t in parse(c)[0].split("\n") if (x := bl_label(t))]
    if labels:
        return labels[-1]
    about = meta.get("og:description", "")
    said = re.search(r"(?i)(?<![A-Za-z])BL\s*(漫畫|小說)", about) if code == "tohan" and not re.search(r"(?i)(?:不是|並非|非)\s*BL", about) else None
    return "BL" + said[1] if said else None


def classified(pages: DataFrame) -> DataFrame:
    """pages (publisher_code, url, html, source_key, isbn) without html, with rating and bl_category."""
    keep = [f for f in pages.schema.fields if f.name not in ("html", "rating", "bl_category")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in ("publisher_code", "url", "html", "source_key", "isbn")), strict=True))
            rated = [rating_of(c or "", u or "", m or "", k or "", i) for c, u, m, k, i in rows]
            bl = [bl_of(c or "", u or "", m or "", k or "") for c, u, m, k, _ in rows]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(rated, pa.string()), pa.array(bl, pa.string())], names=[*names, "rating", "bl_category"])

    fields_sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return pages.mapInArrow(run, fields_sql + ", rating string, bl_category string")
