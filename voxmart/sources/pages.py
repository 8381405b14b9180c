"""Reviews and complaints out of landed HTML pages.

Pages that embed their data as JSON need no HTML parsing. Card layouts are read by the
standard library's parser inside the tasks: a page is one row, its cards come out as rows,
and everything after that is column work.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmart.config import BRAND, Brand
from voxmart.functions import dates, gates, numbers, text
from voxmart.sources.mappers import one_per_id
from voxmart.sources.payload import Doc, each, joined, posts

# What runs inside tasks travels with them, whether or not the workers have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 2000  # cards handed over at once
NEXT_DATA = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'


def embedded(pages: DataFrame, *containers: str) -> DataFrame:
    """One row per element of the list inside the page's embedded JSON."""
    blob = pages.withColumn("payload", F.nullif(F.regexp_extract("html", NEXT_DATA, 1), F.lit("")))
    return each(blob.drop("html"), *containers)


def employee_reviews(pages: DataFrame, brand: Brand = BRAND) -> DataFrame:
    """Pros and cons with the overall stars; gated on the page's company, not on each review.

    The featured review is pinned to every page, hence one row per id. Wall clock is IST.
    """
    rows = embedded(pages, "$.props.pageProps.reviewsData")
    d = Doc(F.col("_item"))
    pros, cons = d.text("$.likesText"), d.text("$.disLikesText")
    said = F.concat_ws(". ", F.regexp_replace(d.text("$.reviewTitle"), r"\.+$", ""), F.concat(F.lit("Pros: "), pros), F.concat(F.lit("Cons: "), cons))
    stars = F.greatest(F.coalesce(d.count("$.overallCompanyRating"), F.lit(0)), F.lit(0))
    rows = rows.filter(d.text("$.id").isNotNull() & gates.on_brand(d.text("$.companyName"), brand) & (pros.isNotNull() | cons.isNotNull()))
    out = posts(rows, "ambitionbox", date=d.text("$.created"),
                created_at=dates.local_to_utc(d.text("$.created"), "yyyy-MM-dd HH:mm:ss"),
                source_id=F.concat(F.lit("ambitionbox:"), d.text("$.id")), author=d.text("$.userName", default="Anonymous"),
                text=F.when(stars > 0, F.format_string("[%d★] %s", stars, said)).otherwise(said), url=d.text("$.url"),
                rating=F.when(stars > 0, stars), engagement=F.greatest(F.coalesce(d.count("$.helpfulCount"), F.lit(0)), F.lit(0)),
                reply_count=F.when(d.flag("$.isEmployerResponded"), 1).otherwise(0), lang=F.lit("en"))
    return one_per_id(out)


def consumer_reviews(pages: DataFrame) -> DataFrame:
    """Review pages of the brand itself with stars, dates and text in the embedded JSON."""
    rows = embedded(pages, "$.props.pageProps.reviews")
    d = Doc(F.col("_item"))
    said = joined(". ", d.text("$.title"), d.text("$.text"))
    stars = F.coalesce(d.count("$.rating"), F.lit(0))
    rows = rows.filter(d.text("$.id").isNotNull() & (F.length(said) > 0))
    return one_per_id(posts(rows, "trustpilot", date=d.text("$.dates.publishedDate"),
                            source_id=F.concat(F.lit("trustpilot:"), d.text("$.id")), author=d.text("$.consumer.displayName", default="anonymous"),
                            text=F.when(stars > 0, F.format_string("[%d★] %s", stars, said)).otherwise(said),
                            rating=F.when(stars > 0, stars), engagement=F.coalesce(d.count("$.likes"), F.lit(0)), lang=F.lit("en")))


@dataclass(frozen=True)
class Cards:
    """Where a site's cards and their fields are: class of the box, then field -> (class, attribute or text).

    An attribute of ``"*"`` counts the elements (filled stars).
    """

    box: str
    fields: dict[str, tuple[str, str]] = field(default_factory=dict)


VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _CardParser(HTMLParser):
    def __init__(self, spec: Cards):
        super().__init__(convert_charrefs=True)
        self.spec, self.cards, self.depth, self.box_at, self.open = spec, [], 0, None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag not in VOID:
            self.depth += 1
        if self.box_at is None and self.spec.box in classes:
            self.box_at = self.depth
            self.cards.append({})
            return
        if self.box_at is None:
            return
        for name, (cls, what) in self.spec.fields.items():
            if cls not in classes:
                continue
            card = self.cards[-1]
            if what == "*":
                card[name] = str(int(card.get(name, "0")) + 1)
            elif what != "text":
                card.setdefault(name, a.get(what) or "")
            elif name not in card and tag not in VOID:
                card[name] = ""
                self.open.append((name, self.depth))

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        self.open = [(n, d) for n, d in self.open if d < self.depth]
        if self.box_at is not None and self.depth <= self.box_at:
            self.box_at = None
        self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.box_at is not None:
            for name, _ in self.open:
                self.cards[-1][name] += data


def cards(pages: DataFrame, spec: Cards, key: str = "url") -> DataFrame:
    """(key, pos, fields): one row per card of each page. A task holds one page and BATCH cards as Python objects, whatever the number of
    pages that come in at once."""
    def batch_of(rows):
        of = lambda at, kind: pa.array([r[at] for r in rows], kind)
        return pa.RecordBatch.from_arrays([of(0, pa.string()), of(1, pa.int32()), of(2, pa.map_(pa.string(), pa.string()))],
                                          names=[key, "pos", "fields"])

    def found(batch):
        for k, html in zip(batch.column(0), batch.column(1)):
            parser = _CardParser(spec)
            parser.feed(html.as_py() or "")
            for i, card in enumerate(parser.cards):
                yield k.as_py(), i, [(n, " ".join(v.split())) for n, v in card.items()]

    def run(batches):
        for batch in batches:
            rows = found(batch)
            while part := list(islice(rows, BATCH)):
                yield batch_of(part)

    return pages.select(key, "html").mapInArrow(run, f"{key} string, pos int, fields map<string,string>")


# Class names of the card layouts.
COMPLAINT_CARDS = Cards("complaint-box-results", {
    "href": ("complaint-box-results__title", "href"), "title": ("complaint-box-results__title", "text"),
    "body": ("complaint-box-results__text", "text"), "author": ("author-box__user_bold", "text"), "date": ("author-box__date", "text")})
NEWS_CARDS = Cards("cardlist", {"href": ("smallcard-title", "href"), "title": ("smallcard-title", "text"),
                                "blurb": ("bookreview-title", "text"), "stamp": ("updt-on", "text")})
REVIEW_CARDS = Cards("review-article", {"href": ("review-title", "href"), "title": ("review-title", "text"), "body": ("reviewdata", "text"),
                                        "author": ("user-ms-name", "text"), "stars": ("rated-star", "*"), "date": ("review-date", "text"),
                                        "likes": ("divlike", "text"), "views": ("rated-view", "text")})
FORUM_CARDS = Cards("message", {"id": ("message-anchor", "href"), "author": ("message-name", "text"), "body": ("bbWrapper", "text"),
                                "date": ("u-dt", "datetime"), "reactions": ("reactionsBar-link", "text")})
BRANCH_CARDS = Cards("place-card", {"href": ("place-link", "href"), "title": ("place-name", "text"), "stars": ("place-rating", "text")})


def _f(name: str) -> Column:
    return F.nullif(F.col("fields")[name], F.lit(""))


def complaints(pages: DataFrame, brand: Brand = BRAND, site: str = "") -> DataFrame:
    """Complaint boxes; without a stable id in the link a box cannot be deduplicated and is dropped."""
    cid = F.regexp_extract(_f("href"), r"(?:-c|#get-cl)(\d+)\b", 1)
    said = joined(". ", _f("title"), _f("body"))
    rows = cards(pages, COMPLAINT_CARDS).withColumn("_id", cid).filter((F.col("_id") != "") & gates.on_brand(said, brand))
    return one_per_id(posts(rows, "consumercomplaints", date=_f("date"), source_id=F.concat(F.lit("consumercomplaints:"), "_id"),
                            author=_f("author"), text=said, url=F.concat(F.lit(site), _f("href")), engagement=F.lit(0), reply_count=F.lit(0),
                            lang=F.lit("en")))


def news_cards(pages: DataFrame, as_of: Column, brand: Brand = BRAND, source: str = "businessstandard") -> DataFrame:
    """Headlines of 25 characters and more; date from the stamp, else from the story id. Undated cards
    come back with a NULL ``created_at`` for ``dropped_undated`` to count."""
    href = F.coalesce(_f("href"), F.lit(""))
    story = F.regexp_extract(href, r"-(1\d{11})(?:_\d+)?\.html", 1)
    path = F.regexp_replace(F.regexp_replace(href, r"^https?://[^/]+|[?#].*$", ""), "/+$", "")
    ident = F.when(story != "", story).otherwise(F.concat(F.lit("u"), F.substring(F.sha1(path.cast("binary")), 1, 16)))
    said = joined(". ", _f("title"), _f("blurb"))
    rows = cards(pages, NEWS_CARDS).filter((F.length(_f("title")) >= 25) & gates.on_brand(said, brand) & (href != ""))
    made = F.coalesce(dates.stamp_to_utc(F.coalesce(_f("stamp"), F.lit(""))), dates.date_from_story_id(story, as_of))
    return one_per_id(posts(rows, source, date=_f("stamp"), created_at=made, source_id=F.concat(F.lit(f"{source}:"), ident),
                            author=F.lit(source), text=said, url=href, engagement=F.lit(0), reply_count=F.lit(0), lang=F.lit("en")))


def dropped_undated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dated rows, number of undated ones per source)."""
    undated = rows.filter(F.col("created_at").isNull()).groupBy("source").agg(F.count(F.lit(1)).alias("undated"))
    return rows.filter(F.col("created_at").isNotNull()), undated


def product_reviews(pages: DataFrame, as_of: Column, brand: Brand = BRAND) -> DataFrame:
    """Star-rated review cards; gated on permalink and text together."""
    said = joined(". ", _f("title"), _f("body"))
    href = F.coalesce(_f("href"), F.lit(""))
    slug = F.substring_index(F.regexp_replace(href, "/+$", ""), "/", -1)
    plain = F.regexp_replace(F.lower(F.coalesce(_f("title"), F.lit(""))), "[^a-z0-9]+", "-")
    ident = F.coalesce(F.nullif(slug, F.lit("")), F.regexp_replace(F.substring(plain, 1, 40), "^-+|-+$", ""))
    stars = F.coalesce(_f("stars").cast("int"), F.lit(0))
    rows = cards(pages, REVIEW_CARDS).filter((F.length(said) > 0) & (gates.on_brand(F.concat_ws(" ", href, said), brand)))
    return one_per_id(posts(rows, "mouthshut", date=_f("date"),
                            created_at=F.coalesce(dates.ago(F.coalesce(_f("date"), F.lit("")), as_of), dates.parse_datetime(_f("date"))),
                            source_id=F.concat(F.lit("mouthshut:"), ident), author=F.coalesce(_f("author"), F.lit("anonymous")),
                            text=F.when(stars > 0, F.format_string("[%d★] %s", stars, said)).otherwise(said), url=href,
                            rating=F.when(stars > 0, stars), engagement=numbers.whole(F.regexp_extract(_f("likes"), r"(\d[\d,]*)", 1)),
                            view_count=numbers.measured(F.regexp_replace(F.regexp_extract(_f("views"), r"(\d[\d,]*)", 1), ",", "")), lang=F.lit("en")))


def forum_replies(pages: DataFrame) -> DataFrame:
    """Thread pages: reactions are the names shown plus "and N others"."""
    said = _f("body")
    shown = F.coalesce(_f("reactions"), F.lit(""))
    others = F.coalesce(F.regexp_extract(shown, r"and (\d+) others?", 1).try_cast("int"), F.lit(0))
    names = F.size(F.filter(F.split(F.regexp_replace(shown, r"(?:,? ?and) (\d+) others?", ""), r",| and "), lambda n: F.trim(n) != ""))
    ident = F.substring_index(F.regexp_replace(_f("id"), r"^.*#", ""), "-", -1)
    rows = cards(pages, FORUM_CARDS).filter(said.isNotNull() & ident.isNotNull())
    return one_per_id(posts(rows, "technofino", date=_f("date"), source_id=F.concat(F.lit("technofino:"), ident), author=_f("author"), text=said,
                            url=F.concat(F.col("url"), F.lit("#post-"), ident), conversation_id=F.col("url"), engagement=(names + others).cast("bigint"),
                            lang=F.lit("en")))


def branch_ratings(pages: DataFrame, brand: Brand = BRAND) -> DataFrame:
    """Branch cards that show a rating but no review text."""
    stars = numbers.rating(_f("stars"))
    rows = cards(pages, BRANCH_CARDS).filter(gates.on_brand(_f("title"), brand) & (stars > 0))
    return one_per_id(posts(rows, "gmaps", source_id=text.stable_id("gmaps:", _f("href"), _f("title")), author=F.lit("aggregate"),
                            text=F.format_string("[%s★] %s", stars.cast("string"), _f("title")), url=_f("href"), rating=stars, lang=F.lit("en")))
