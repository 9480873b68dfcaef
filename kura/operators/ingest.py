"""What a write does to the catalog: precedence of old and new fields, identity, merges of duplicates, queues and follow rows.

Merge rules take the old and the new row as Columns by name (o and n: functions from a field to a Column) and give the field's
value; they are pure, so a batch applies them in one select. None of them collects rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kura.functions import titles
from kura.functions.text import fold_key, isbn_valid

from .identity import tokens

Row = Callable[[str], Column]
# Parser versions, fields that move together, and limits.
PARSER_VERSIONS = {"chingwin": "chingwin_rating_v2", "spp": "spp_rating_v1", "tongli": "tongli_rating_v1", "kadokawa": "kadokawa_rating_v1", "tohan": "tohan_rating_v2"}
RATING_FIELDS = ["content_rating", "rating_raw", "rating_source", "rating_confidence", "rating_checked_at", "rating_parser_version"]
RELEASE_FIELDS = ["release_date", "release_precision", "release_status", "release_date_source", "release_checked_at"]
SPARSE_FIELDS = ["author", "isbn", "cover_url", "list_price", "series_title", "series_key", "volume_label"]
PRODUCT_FIELDS = ["title", "normalized_title", "series_title", "series_key", "volume_label", "edition_type", "source_url", "isbn", "cover_url", "list_price"]
NULLABLE_FIELDS = ["series_title", "series_key", "volume_label", "author", "isbn", "cover_url", "list_price", "release_date"]
UNKNOWN_FIELDS = ["media_type", "release_precision", "release_status"]
URL_STARTS = {
    "kadokawa": ["https://www.kadokawa.com.tw/products/", "https://kadokawa.com.tw/products/"],
    "chingwin": ["https://www.ching-win.com.tw/product-detail/"],
    "spp": ["https://www.spp.com.tw/SalePage/Index/", "https://www.spp.com.tw/v2/official/SalePage/Index/"],
    "tongli": ["https://www.tongli.com.tw/BooksDetail.aspx?"],
    "tohan": ["https://www.tohan.com.tw/product.php?"],
}
MOST_CANDIDATES = 200
FAN_PARTS, FANS_LISTED, BOOKS_LISTED = 8, 64, 512
MEDIA_PREFIX = r"^(?:輕小說\s*|(?:小說|漫畫)\s+)"


def true(test: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(test, F.lit(False))


def empty(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def unknown(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown")) == "unknown"


# ---- which value stays ----


def keeps_release(o: Row, n: Row) -> Column:
    """Whether the old release fields stay: no date never erases one; the product's date beats any other; of two product dates the
    later check wins, at equal times the old one."""
    old_product = o("release_date_source") == "product"
    new_product = (n("release_date_source") == "product") & n("release_checked_at").isNotNull()
    second = lambda c: F.date_trunc("second", c)
    return (
        (n("release_date").isNull() & o("release_date").isNotNull()) | true(old_product) & ~true(new_product)
        | true(old_product & new_product & (second(n("release_checked_at")) <= second(o("release_checked_at"))))
    )


def keeps_rating(o: Row, n: Row) -> Column:
    """Whether the old rating fields stay: locked ones; known ones against unknown, unless a fresh look by a known parser takes a general
    one back; those checked later; and an adult rating against a general one that isn't strictly newer."""
    old_time, new_time = (F.date_trunc("second", r("rating_checked_at")) for r in (o, n))
    fresh = true((n("content_rating") == "unknown") & new_time.isNotNull() & n("rating_parser_version").isin(*PARSER_VERSIONS.values()) & (old_time.isNull() | (new_time >= old_time)))
    against_unknown = unknown(n("content_rating")) & ~unknown(o("content_rating")) & ~(true(o("content_rating") == "general") & fresh)
    older = old_time.isNotNull() & (new_time.isNull() | true(new_time < old_time))
    adult = true((o("content_rating") == "restricted_18") & (n("content_rating") == "general")) & ~true(new_time > old_time)
    return true(o("rating_locked")) | against_unknown | older | adult


def crawled(o: Row, n: Row, fields: list[str]) -> dict[str, Column]:
    """The row a crawler writes: release and rating fields by their rules; a BL category is never cleared."""
    stays = {f: keeps_release(o, n) for f in RELEASE_FIELDS} | {f: keeps_rating(o, n) for f in RATING_FIELDS}
    out = {f: F.when(stays[f], o(f)).otherwise(n(f)) if f in stays else n(f) for f in fields}
    if "source_url" in fields:  # a verified product link isn't replaced by an announcement
        out["source_url"] = F.when(keeps_release(o, n) & true(o("release_date_source") == "product") & ~empty(o("source_url")), o("source_url")).otherwise(n("source_url"))
    if "bl_category" in fields:
        out["bl_category"] = F.when(empty(n("bl_category")), F.coalesce(F.nullif(o("bl_category"), F.lit("")), n("bl_category"))).otherwise(n("bl_category"))
    return out


def synced(o: Row, n: Row, fields: list[str]) -> dict[str, Column]:
    """The row a peer's upload writes: as crawled, and sparse values never erase richer ones; an equal rating keeps the higher confidence."""
    out = crawled(o, n, fields)
    for f in fields:
        if f in NULLABLE_FIELDS:
            out[f] = F.when(empty(out[f]) & ~empty(o(f)), o(f)).otherwise(out[f])
        if f in UNKNOWN_FIELDS:
            out[f] = F.when((out[f] == "unknown") & ~empty(o(f)) & ~unknown(o(f)), o(f)).otherwise(out[f])
    if {"content_rating", "rating_confidence"} <= set(fields):
        most = F.greatest(F.coalesce(out["rating_confidence"], F.lit(0)), F.coalesce(o("rating_confidence"), F.lit(0)))
        out["rating_confidence"] = F.when(out["content_rating"].eqNullSafe(o("content_rating")), most).otherwise(out["rating_confidence"])
    return out


def richer(o: Row, n: Row, fields: list[str]) -> dict[str, Column]:
    """The row of a publisher with product and schedule pages: empty values are filled; a schedule row doesn't replace what a product
    page gave; authors stay where the new ones are among them."""
    old_kind, new_kind = source_kind(o("source_url")), source_kind(n("source_url"))
    product = (old_kind == "product") & (new_kind != "product")
    dated = product & o("release_date").isNotNull() & true((o("release_precision") == "day") | (o("release_date_source") == "product"))
    out = {}
    for f in fields:
        v = F.when(empty(n(f)), o(f)).otherwise(n(f)) if f in SPARSE_FIELDS else n(f)
        if f in PRODUCT_FIELDS:
            v = F.when(product & ~empty(o(f)), o(f)).otherwise(v)
        if f in RELEASE_FIELDS:
            v = F.when(dated, o(f)).otherwise(v)
        if f == "author":
            old, new = tokens(o(f)), tokens(n(f))
            within = (F.size(new) > 0) & (F.size(F.array_except(new, old)) == 0)
            grown = (F.size(old) > 0) & (F.size(F.array_except(old, new)) == 0)
            v = F.when(within | (product & ~grown), o(f)).otherwise(v)
        out[f] = v
    return out


# ---- identity ----


def source_kind(url: Column) -> Column:
    """product, schedule or other, by the form of a page's address."""
    on = r"^(?i:https?)://(?i:(?:www\.)?ching-win\.com\.tw)(?::[0-9]*)?"
    kind = lambda path: F.coalesce(url, F.lit("")).rlike(on + path + r"/?(?:[?#].*)?$")
    return F.when(kind("/product-detail/[^/?#]+"), "product").when(kind("/about-news-detail/[0-9]+"), "schedule").otherwise("other")


def product_id(url: Column) -> Column:
    return F.when(source_kind(url) == "product", F.regexp_extract(url, r"/product-detail/([^/?#]+)", 1)).otherwise("")


def identity_title(title: Column) -> Column:
    """A title without campaign marks, media words, leading zeros of its number, case and white space."""
    out = F.regexp_replace(fold_key(F.coalesce(title, F.lit(""))), r"^\(?預購\)?\s*", "")
    out = F.regexp_replace(F.regexp_replace(out, MEDIA_PREFIX, ""), r"\(\s*0{0,2}([0-9]{1,3})\s*\)", "($1)")
    return F.regexp_replace(out, r"(?U)\s+", "")


def identity_edition(title: Column, edition: Column) -> Column:
    found = F.lit(None).cast("string")
    for marker, kind in reversed(titles.EDITION_MARKERS):
        found = F.when(F.contains(title, F.lit(marker)), kind).otherwise(found)
    found = F.when(F.contains(title, F.lit("電子書")), "digital").otherwise(found)
    return F.coalesce(found, F.nullif(edition, F.lit("")), F.lit("standard"))


def identity_volume(volume: Column, title: Column) -> Column:
    value = fold_key(F.coalesce(F.nullif(volume, F.lit("")), titles.extract_volume(title), F.lit("")))
    return F.when(value.rlike("^[0-9]+$"), F.regexp_replace(value, "^0+(?=[0-9])", "")).otherwise(value)


def clean_isbn(isbn: Column) -> Column:
    """The digits of a valid ISBN, '' for any other."""
    return F.when(isbn_valid(isbn), F.upper(F.regexp_replace(isbn, "[- ]", ""))).otherwise("")


def identity_keys(books: DataFrame) -> DataFrame:
    """books with kind, product, shape (what must be equal), title key, author tokens, raw and valid ISBN."""
    c = F.col
    return books.withColumns({
        "_kind": source_kind(c("source_url")), "_product": product_id(c("source_url")), "_edition": identity_edition(c("title"), c("edition_type")), "_volume": identity_volume(c("volume_label"), c("title")),
        "_title": identity_title(c("title")), "_authors": tokens(c("author")), "_raw_isbn": F.upper(F.regexp_replace(F.coalesce("isbn", F.lit("")), r"[\s-]", "")), "_isbn": clean_isbn(c("isbn")),
    })


SHAPE = ["publisher_id", "media_type", "_edition", "_volume"]


def related(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (l, r) of keyed rows of equal shape that share a product, a valid ISBN, or a title and an author, and whose ISBNs, if both
    are given, are equal; by_product, by_isbn and by_title say how."""
    one = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in ("id", "source_key", *SHAPE, "_kind", "_product", "_title", "_authors", "_raw_isbn", "_isbn")])
    l, r = one(left, "l"), one(right, "r")  # noqa: E741
    shape = reduce(lambda a, b: a & b, [F.col(f"l{c}") == F.col(f"r{c}") for c in SHAPE])
    ways = [
        (F.col("l_product") == F.col("r_product")) & (F.col("l_product") != ""), (F.col("l_isbn") == F.col("r_isbn")) & (F.col("l_isbn") != ""), F.col("l_title") == F.col("r_title"),
    ]
    pairs = reduce(DataFrame.unionByName, [l.join(r, shape & way) for way in ways]).dropDuplicates(["lid", "rid"])
    agree = (F.col("l_raw_isbn") == "") | (F.col("r_raw_isbn") == "") | (F.col("l_raw_isbn") == F.col("r_raw_isbn"))
    by = {"by_product": ways[0], "by_isbn": ways[1], "by_title": ways[2] & F.arrays_overlap("l_authors", "r_authors")}
    pairs = pairs.where(agree & F.col("lmedia_type").isin("manga", "novel")).withColumns(by)
    return pairs.where("by_product or by_isbn or by_title")


def find_matches(incoming: DataFrame, books: DataFrame) -> DataFrame:
    """id and matched_id of incoming rows: the only catalog row that is the same book. Two product pages are the same by product id alone;
    where another product page has the same ISBN, or title and author, a match with a row that is no product page isn't safe. A row
    with more than MOST_CANDIDATES rows of its title or ISBN has none."""
    left, right = identity_keys(incoming), identity_keys(books)
    pairs = related(left.where("_kind <> 'other'"), right.where("_kind <> 'other'"))
    both = (F.col("l_kind") == "product") & (F.col("r_kind") == "product")
    pairs = pairs.withColumns({"_match": ~both & (F.col("by_isbn") | F.col("by_title")) | both & F.col("by_product"), "_conflict": both & ~F.col("by_product")})
    found = pairs.groupBy("lid").agg(F.count_if("_match").alias("n"), F.count(F.lit(1)).alias("all"), F.min(F.when(F.col("_match"), F.col("rid"))).alias("matched_id"), F.max("_conflict").alias("conflict"), F.max(F.col("_match") & (F.col("r_kind") != "product")).alias("loose"))
    ok = (F.col("n") == 1) & (F.col("all") <= MOST_CANDIDATES) & ~(F.col("conflict") & F.col("loose"))
    return incoming.select("id").join(found.select(F.col("lid").alias("id"), F.when(ok, F.col("matched_id")).alias("matched_id")), "id", "left")


def duplicates(books: DataFrame) -> DataFrame:
    """old_id, canonical_id, proof of each row that is the same book as exactly one row under its own product key; ambiguous rows, which
    are the same as several, have no pair and canonical_id null.

    No pairs are made: what a row can be found by (product, valid ISBN, or title and one author, each with the shape) leads to the least and the
    largest id found by it. An ISBN goes with its own kind or, where a side gives none, with every one."""
    keyed = identity_keys(books).where(F.col("media_type").isin("manga", "novel"))
    own = (F.col("_kind") == "product") & (F.col("source_key") == F.col("_product"))
    way = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), parts[0].alias("value"), (parts[1] if len(parts) > 1 else F.lit("")).alias("author"))
    product = F.when(F.col("_product") != "", F.array(way("product", F.col("_product"))))
    isbn = F.when(F.col("_isbn") != "", F.array(way("isbn", F.col("_isbn"))))
    title = F.transform("_authors", lambda a: way("title", F.col("_title"), a))
    none = F.array().cast("array<struct<kind:string,value:string,author:string>>")
    free, given = F.lit("*"), F.concat(F.lit("="), F.col("_raw_isbn"))
    each = lambda df, ways, looks, *more: df.withColumn("_way", F.explode(ways)).select(*SHAPE, "_way.*", F.explode(looks).alias("look"), *more)
    there = each(keyed.where(own), F.concat(F.coalesce(product, none), F.coalesce(isbn, none), title), F.array(free, given), F.struct("id", "source_key").alias("r"))
    there = there.groupBy(*SHAPE, "kind", "value", "author", "look").agg(F.min("r").alias("least"), F.max("r.id").alias("most"))
    ways = F.when(F.col("_kind") == "product", F.coalesce(product, none)).when(F.col("_kind") == "schedule", F.concat(F.coalesce(isbn, none), title)).otherwise(none)
    looks = F.when(F.col("_raw_isbn") == "", F.array(free)).otherwise(F.array(F.lit("="), given))
    here = each(keyed.where(~own), ways, looks, F.col("id").alias("old_id"), F.col("source_key").alias("_old"))
    found = here.join(there, [*SHAPE, "kind", "value", "author", "look"]).groupBy("old_id").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("_old").alias("_old"))
    proof = F.sha2(F.concat_ws("|", F.col("old_id").cast("string"), F.col("_old"), F.col("least.id").cast("string"), F.col("least.source_key")), 256)
    sole = F.col("least.id") == F.col("most")
    return found.select("old_id", F.when(sole, F.col("least.id")).alias("canonical_id"), F.when(sole, proof).alias("proof"))


def blocked(pairs: DataFrame, references: DataFrame, private: list[str]) -> DataFrame:
    """Pairs (old_id, canonical_id) whose references disagree: some user has rows of both books that differ in a private column."""
    old = references.select("user_id", F.col("book_id").alias("old_id"), *[F.col(c).alias(f"_o_{c}") for c in private])
    new = references.select("user_id", F.col("book_id").alias("canonical_id"), *[F.col(c).alias(f"_n_{c}") for c in private])
    differ = reduce(lambda a, b: a | b, [~empty(F.col(f"_o_{c}")) & ~empty(F.col(f"_n_{c}")) & ~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")) for c in private])
    return pairs.join(old, "old_id").join(new, ["canonical_id", "user_id"]).where(differ).select("old_id", "canonical_id").distinct()


def moved(references: DataFrame, pairs: DataFrame) -> DataFrame:
    """references with the book of each pair in place of the old one; where a user has both, the row of the canonical book stays."""
    out = references.join(pairs.select(F.col("old_id").alias("book_id"), "canonical_id"), "book_id", "left")
    out = out.withColumns({"_old": F.col("canonical_id").isNotNull(), "book_id": F.coalesce("canonical_id", "book_id")}).drop("canonical_id")
    first = F.row_number().over(Window.partitionBy("user_id", "book_id").orderBy("_old"))
    return out.withColumn("_n", first).where("_n = 1").drop("_n", "_old")


def rewritten(deliveries: DataFrame, pairs: DataFrame) -> DataFrame:
    """deliveries (id, channel, event_key) with the ids of merged books in their keys replaced; one whose new key is there already goes."""
    parts = F.split("event_key", ":")
    keyed = deliveries.withColumn("_parts", parts).withColumn("_book", F.when(F.get("_parts", F.lit(0)).isin("release", "followed-series"), F.get("_parts", F.lit(2))))
    names = pairs.select(F.col("old_id").cast("string").alias("_book"), F.col("canonical_id").cast("string").alias("_new"))
    keyed = keyed.join(names, "_book", "left").withColumn("_key", F.array_join(F.concat(F.slice("_parts", 1, 2), F.array("_new"), F.slice("_parts", 4, 1 << 20)), ":"))
    out = keyed.select("id", "channel", F.when(F.col("_new").isNull(), F.col("event_key")).otherwise(F.col("_key")).alias("event_key"), F.col("_new").isNotNull().cast("int").alias("_moved"))
    first = F.row_number().over(Window.partitionBy("channel", "event_key").orderBy("_moved", "id"))
    return out.withColumn("_n", first).where("_moved = 0 or _n = 1").drop("_n", "_moved")


# ---- follows, wishes, checks and queues ----


def _lists(rows: DataFrame, keys: list[str], by: str, size: int, items: Column, name: str) -> DataFrame:
    """Rows of keys and the array that items aggregates, each of size rows with these keys, in the order of by."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(by))
    return rows.withColumn("_list", F.floor((number - 1) / size)).groupBy(*keys, "_list").agg(items.alias(name)).drop("_list")


def fanned(fans: DataFrame, books: DataFrame, keys: list[str]) -> DataFrame:
    """user_id, book_id for each row of books (book_id, keys) that shares keys with a row of fans (user_id, keys, held) and isn't in held, an array.
    The pairs are made where they are returned and never dealt out: fans are dealt by keys and part, and lists of books copied to each of the parts.
    A list of books is gone through for one user after the other, so that ids come back after few rows: written pairs are small only so.
    Fans stand in lists too, and are taken out by transform, which Spark does not fuse with the join: it would hold all rows of a list of books."""
    n, on = int(fans.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "_part"]
    part = lambda c: F.pmod(F.hash(c), F.lit(FAN_PARTS)).alias("_part")
    dealt = _lists(fans.select("user_id", *keys, "held", part("user_id")).repartition(n, *on), on, "user_id", FANS_LISTED, F.collect_list(F.struct("user_id", "held")), "_fans")
    nulls = F.array_repeat(F.lit(None).cast(books.schema["book_id"].dataType), (F.count(F.lit(1)) - F.count("book_id")).cast("int"))  # not in collect_list
    lists = _lists(books.select("book_id", *keys, part("book_id")), on, "book_id", BOOKS_LISTED, F.concat(F.collect_list("book_id"), nulls), "_books")
    copies = lists.select(*keys, "_books", F.explode(F.sequence(F.lit(0), F.lit(FAN_PARTS - 1))).alias("_part")).repartition(n, *on)
    each = copies.join(dealt.hint("merge"), on).select(F.inline(F.transform("_fans", lambda f: F.struct(f["user_id"].alias("user_id"), f["held"].alias("held"), F.col("_books").alias("_books")))))
    pairs = each.select("user_id", "held", F.explode("_books").alias("book_id"))
    return pairs.where(~F.coalesce(F.array_contains("held", F.col("book_id")), F.lit(False))).select("user_id", "book_id")


def fanned_once(fans: DataFrame, books: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of fanned over keys and more, each once. fans has a row for each user and keys, so only ids that stand under several keys can come twice."""
    own, key = Window.partitionBy("book_id"), F.struct(*keys)
    books = books.select("book_id", *keys, *more).repartition("book_id").distinct().withColumn("_several", F.min(key).over(own) != F.max(key).over(own))
    return fanned(fans, books.where(~F.col("_several")), [*keys, *more]).union(fanned(fans, books.where("_several"), [*keys, *more]).distinct())


def follow_wishes(follows: DataFrame, books: DataFrame, wishlist: DataFrame, owned: DataFrame) -> DataFrame:
    """user_id, book_id of the wishes that follows add: future takes scheduled books, all what isn't cancelled; never what a user owns or
    has wished for already. A user who follows a series both ways has it by all, which has the books of future in it."""
    keys = ["publisher_id", "series_key", "media_type"]
    fans = follows.withColumnRenamed("normalized_series", "series_key").groupBy("user_id", *keys).agg(F.max(~F.col("follow_scope").eqNullSafe("future")).alias("_all"))
    held = owned.select("user_id", "book_id").union(wishlist.select("user_id", "book_id")).groupBy("user_id").agg(F.collect_set("book_id").alias("held"))
    books = books.withColumnRenamed("id", "book_id")
    taken = books.where("release_status = 'scheduled'").withColumn("_all", F.lit(False)).unionByName(books.where("release_status <> 'cancelled'").withColumn("_all", F.lit(True)))
    return fanned_once(fans.join(held, "user_id", "left"), taken, keys, ("_all",))


def purchased(requests: DataFrame, collection: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """The wishes and the owned rows that requests (user_id, book_id, state, owned_format, purchased_at) make: purchased becomes an owned row and
    the wish stays wanted. A purchase date is the requested one, else the existing one, else today."""
    wishes = requests.select("user_id", "book_id", F.when(F.col("state") == "purchased", "wanted").otherwise(F.col("state")).alias("state"))
    old = collection.where("book_id is not null").select("user_id", "book_id", F.col("owned_format").alias("_format"), F.col("purchased_at").alias("_date"))
    new = requests.where("state = 'purchased'").join(old, ["user_id", "book_id"], "left")
    return wishes, new.select("user_id", "book_id", F.coalesce("owned_format", "_format", F.lit("paper")).alias("owned_format"), F.coalesce("purchased_at", "_date", today).alias("purchased_at"))


def manual_rating(books: DataFrame, choices: DataFrame) -> DataFrame:
    """books with the ratings of choices (id, rating) set and locked, and changed: whether any field differs."""
    out = books.join(choices, "id", "left")
    new = {"content_rating": F.col("rating"), "rating_source": F.lit("manual"), "rating_confidence": F.lit(100), "rating_locked": F.lit(True)}
    changed = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(v) for f, v in new.items()])
    out = out.withColumn("changed", F.col("rating").isNotNull() & changed)
    return out.withColumns({f: F.when(F.col("rating").isNotNull(), v).otherwise(F.col(f)) for f, v in new.items()}).drop("rating")


def rating_checks(results: DataFrame, now: Column) -> DataFrame:
    """results (rating, error, locked, changed, bl_category) with the checkpoint's status and retry_after: a day after an error, a week after
    an unknown rating. A rating that was taken back is revoked, or classified where a BL category came instead."""
    known = F.col("rating") != "unknown"
    status = F.when(F.col("error").isNotNull(), "error").when(known, "confirmed").otherwise("unknown")
    status = F.when((status == "unknown") & F.col("changed"), F.when(empty(F.col("bl_category")), "revoked").otherwise("classified")).otherwise(status)
    retry = F.when(~known, F.when(F.col("error").isNotNull(), F.date_add(now, 1)).otherwise(F.date_add(now, 7)))
    return results.withColumns({"status": F.when(F.col("locked"), "locked").otherwise(status), "retry_after": F.when(~F.col("locked"), retry)})


def users(old: DataFrame, logins: DataFrame) -> DataFrame:
    """old with the rows of logins (id, name, role) put over; an administrator stays one."""
    both = old.alias("o").join(logins.alias("n"), "id", "full_outer")
    role = F.when((F.col("o.role") == "admin") | (F.col("n.role") == "admin"), "admin").otherwise(F.coalesce("n.role", "o.role"))
    return both.select("id", F.coalesce("n.name", "o.name").alias("name"), role.alias("role"))


def on_product_page(code: Column, url: Column) -> Column:
    """Whether an address begins as the publisher's product pages do."""
    secure = F.replace(url, F.lit("http://"), F.lit("https://"))
    tests = [(code == name) & reduce(lambda a, b: a | b, [F.startswith(secure, F.lit(s)) for s in starts]) for name, starts in URL_STARTS.items()]
    return true(reduce(lambda a, b: a | b, tests))


def due_rechecks(books: DataFrame, checks: DataFrame, now: Column, today: Column, per_publisher: int) -> DataFrame:
    """The release pages to look at again, per_publisher of each: scheduled or within thirty days of today, due, not looked at for a day, on a
    product page. The longest untried come first, among them what is overdue."""
    rows = books.join(checks.select(F.col("book_id").alias("id"), "attempted_at", "next_check_at"), "id", "left")
    overdue = true((F.col("release_status") == "scheduled") & (F.col("release_date") < today))
    rows = rows.where(
        F.col("media_type").isin("manga", "novel") & ((F.col("release_status") == "scheduled") | F.col("release_date").between(F.date_sub(today, 30), F.date_add(today, 30)))
        & (F.col("next_check_at").isNull() | (F.col("next_check_at") <= now)) & (F.col("release_checked_at").isNull() | (F.col("release_checked_at") <= now - F.expr("interval 1 day")))
        & on_product_page(F.col("publisher_code"), F.col("source_url"))
    )
    order = [F.coalesce("attempted_at", F.lit("1970-01-01").cast("timestamp_ntz")), overdue.cast("int").desc(), F.col("id")]
    place = F.row_number().over(Window.partitionBy("publisher_code").orderBy(*order))
    return rows.withColumn("position", place).where(F.col("position") <= per_publisher)


def due_ratings(books: DataFrame, checks: DataFrame, versions: dict[str, str], now: Column, today: Column, recent_days: int) -> DataFrame:
    """Books whose rating page is to be read: not locked, on a product page, near today or new without a date, and never checked, checked by another
    parser version, or due again."""
    version = F.try_element_at(F.create_map(*[F.lit(x) for pair in versions.items() for x in pair]), F.col("publisher_code"))
    rows = books.join(checks.select(F.col("book_id").alias("id"), F.col("parser_version").alias("_version"), "retry_after", F.lit(True).alias("_checked")), "id", "left")
    since = F.date_sub(today, recent_days)
    near = F.col("release_date").between(since, F.date_add(today, 90)) | F.col("release_date").isNull() & (F.col("first_seen") >= since)
    due = F.col("_checked").isNull() | (F.col("_version") != version) | (F.col("retry_after") <= now)
    return rows.where(~F.col("rating_locked") & F.col("media_type").isin("manga", "novel") & on_product_page(F.col("publisher_code"), F.col("source_url")) & true(near) & true(due)).drop("_version", "_checked")


def claimed(queue: DataFrame, used: DataFrame, now: Column, budget: int) -> DataFrame:
    """queue after a round of claims: of each publisher the pending rows that are due, oldest first, as many as the day's budget has left after
    used (publisher_code, used). A claimed row has one attempt more and a lease of an hour as its next attempt."""
    due = (F.col("status") == "pending") & (F.col("next_attempt_at") <= now)
    place = F.row_number().over(Window.partitionBy("publisher_code", due).orderBy("next_attempt_at", "first_seen_at", "url_hash"))
    rows = queue.join(used, "publisher_code", "left").withColumn("claimed", due & (place + F.coalesce("used", F.lit(0)) <= budget)).drop("used")
    return rows.withColumns({"attempts": F.col("attempts") + F.col("claimed").cast("int"), "next_attempt_at": F.when(F.col("claimed"), now + F.expr("interval 1 hour")).otherwise(F.col("next_attempt_at"))})


def finished(queue: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """queue with the results (url_hash, error, ignored) of claimed rows: done, ignored, or pending again after min(2 ** min(attempts - 1, 3), 7) days."""
    rows = queue.join(results.withColumn("_came", F.lit(True)), "url_hash", "left")
    wait = F.make_dt_interval(F.least(F.pow(F.lit(2), F.least(F.col("attempts") - 1, F.lit(3))), F.lit(7)).cast("int"))
    status = F.when(F.col("error").isNotNull(), "pending").when(F.col("ignored"), "ignored").otherwise("done")
    return rows.withColumns({"status": F.when(F.col("_came"), status).otherwise(F.col("status")), "next_attempt_at": F.when(F.col("_came"), now + wait).otherwise(F.col("next_attempt_at"))}).drop("_came", "error", "ignored")


def enqueued(queue: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """queue with urls (publisher_code, url_hash, error) put in: new rows are due now, or after an error tomorrow; a new error opens a done row
    again and leaves a pending one its time."""
    asked = urls.dropDuplicates(["publisher_code", "url_hash"]).withColumnRenamed("error", "_error")
    tomorrow = now + F.expr("interval 1 day")
    both = queue.withColumn("_old", F.lit(True)).join(asked.withColumn("_new", F.lit(True)), ["publisher_code", "url_hash"], "full_outer")
    failed = F.col("_error").isNotNull()
    reopened = F.col("_old") & failed
    next_at = F.when(F.col("_old").isNull(), F.when(failed, tomorrow).otherwise(now)).when(reopened & (F.col("status") == "done"), tomorrow).otherwise(F.col("next_attempt_at"))
    status = F.when(F.col("_old").isNull() | reopened, "pending").otherwise(F.col("status"))
    return both.select("publisher_code", "url_hash", status.alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("first_seen_at", now).alias("first_seen_at"), next_at.alias("next_attempt_at"))


def check_summary(publishers: DataFrame, rows: DataFrame, start: Column, undated: str) -> DataFrame:
    """Of each publisher, also those without rows, the checks since start: attempted, confirmed, undated, failed, and incomplete, what is left of
    them. rows has code, attempted_at, last_error, release_checked_at and release_date_source."""
    now = F.col("attempted_at") >= start
    confirmed = now & (F.col("release_checked_at") >= F.col("attempted_at")) & (F.col("release_date_source") == "product") & F.col("last_error").isNull()
    out = publishers.join(rows, "code", "left").groupBy("code").agg(
        F.count_if(now).alias("attempted"), F.count_if(confirmed).alias("confirmed"), F.count_if(now & (F.col("last_error") == undated)).alias("undated"),
        F.count_if(now & (F.col("last_error") != undated)).alias("failed"), F.max("attempted_at").alias("last_attempt_at"),
    )
    return out.withColumn("incomplete", F.greatest(F.lit(0), F.col("attempted") - F.col("confirmed") - F.col("undated") - F.col("failed")).cast("long"))


def short(text: Column, limit: int = 90) -> Column:
    """White space collapsed, and an ellipsis where the text is longer than limit."""
    one = normalize_space(text)
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.left(one, F.lit(limit - 1)), F.lit("…")))


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def release_label(date: Column, precision: Column, none: str = "日期未定") -> Column:
    return F.when(date.isNull(), none).when(precision == "month", F.date_format(date, "yyyy/MM")).otherwise(F.date_format(date, "yyyy/MM/dd"))


