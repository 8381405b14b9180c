"""One mapper per kind of landed payload: JSON or markup in, raw_posts rows out.

Mappers are plain projections, so they run unchanged on a batch read and on a stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmart.config import BRAND, THRESHOLDS, Brand
from voxmart.functions import dates, gates, numbers, text
from voxmart.session import cut_lineage
from voxmart.sources.payload import Doc, each, joined, once, parsed, posts



def _handle(name: Column) -> Column:
    return text.at_handle(name)


# ---------------------------------------------------------------- microblog posts
def tweets(payloads: DataFrame) -> DataFrame:
    """One post object per payload. All paths to the same post share the id ``x:<id>``."""
    d = Doc(F.col("_doc"))
    user, tid = d.text("$.username"), d.text("$.id", "$.id_str")
    rows = parsed(payloads).filter(tid.isNotNull())
    return posts(
        rows, "twitter", date=d.text("$.created_at"), source_id=F.concat(F.lit("x:"), tid), author=_handle(user),
        author_name=d.text("$.user_name"), text=d.text("$.full_text", "$.text"),
        url=F.when(user.isNotNull(), F.concat(F.lit("https://x.com/"), user, F.lit("/status/"), tid)),
        lang=d.text("$.lang", default="en"), engagement=d.count("$.favorite_count"), reply_count=d.count("$.reply_count"),
        retweet_count=d.count("$.retweet_count"), quote_count=d.count("$.quote_count"), view_count=d.count("$.view_count"),
        bookmark_count=d.count("$.bookmark_count"), conversation_id=d.text("$.conversation_id"), raw_json=F.col("payload"))


def crawled_tweets(payloads: DataFrame) -> DataFrame:
    """Crawled cards: the counters stand in one label, engagement is their sum."""
    d = Doc(F.col("_doc"))
    figures = F.transform(F.regexp_extract_all(d.text("$.label", default=""), F.lit(r"(\d[\d,.]*)"), F.lit(1)),
                          lambda n: F.regexp_replace(n, r"\D", "").cast("bigint"))
    return posts(parsed(payloads), "twitter", date=d.text("$.dt"), source_id=F.concat(F.lit("x:"), d.text("$.id")),
                 author=_handle(d.text("$.handle")), text=d.text("$.text"), url=d.text("$.href"), lang=F.lit("en"),
                 engagement=F.aggregate(figures, F.lit(0).cast("bigint"), lambda a, b: a + b))


def hydrate(found: DataFrame, hydrated: DataFrame) -> DataFrame:
    """Hydrated fields win over discovered ones; an unmeasured metric stays NULL."""
    h = hydrated.select("id", F.struct(*[c for c in hydrated.columns if c != "id"]).alias("h"))
    rows = found.join(h, "id", "left")
    pick = lambda c: F.coalesce(F.nullif(F.col(f"h.{c}"), F.lit("")), F.col(c))
    made = F.coalesce(dates.parse_datetime(F.col("h.created_at")), dates.parse_datetime(F.col("created_at")))
    author = pick("author")
    metrics = {c: F.col(f"h.{c}") for c in ("engagement", "reply_count", "retweet_count", "quote_count", "view_count")
               if c in hydrated.columns}
    return posts(rows, "twitter", date=pick("created_at"), created_at=made, source_id=F.concat(F.lit("x:"), "id"),
                 author=_handle(author), text=pick("text"),
                 url=F.concat(F.lit("https://x.com/"), F.coalesce(author, F.lit("i")), F.lit("/status/"), "id"),
                 conversation_id=F.coalesce("h.conversation_id", "id") if "conversation_id" in hydrated.columns else F.col("id"),
                 **metrics)


def bluesky_events(events: DataFrame, brand: Brand = BRAND, match_all: bool = False) -> DataFrame:
    """Firehose commits: created posts with text that name an alias."""
    d = Doc(F.col("_doc"))
    body = d.text("$.commit.record.text")
    keep = ((d.text("$.commit.operation") == "create") & (d.text("$.commit.collection") == "app.bsky.feed.post")
            & body.isNotNull())
    if not match_all:
        keep = keep & gates.mentions_alias(body, brand)
    did, key = d.text("$.did", default=""), d.text("$.commit.rkey", default="")
    return posts(parsed(events).filter(keep), "bluesky", date=d.text("$.commit.record.createdAt"),
                 source_id=F.concat(F.lit("bsky:"), did, F.lit("/"), key), author=did, text=body,
                 url=F.concat(F.lit("https://bsky.app/profile/"), did, F.lit("/post/"), key), engagement=F.lit(0), lang=F.lit("en"))


def _fediverse_id(uri: Column, fallback: Column, home: str) -> Column:
    """Global id from the status URI: the number on the home server, host and number (or a digest) elsewhere."""
    host = F.lower(F.coalesce(F.parse_url(uri, F.lit("HOST")), F.lit(home)))
    path = F.regexp_replace(F.coalesce(F.parse_url(uri, F.lit("PATH")), F.lit("")), "/+$", "")
    last = F.substring_index(path, "/", -1)
    ident = F.when(last.rlike(r"^\d+$"), last).otherwise(
        F.when(uri.isNotNull(), F.substring(F.sha1(uri.cast("binary")), 1, 16)).otherwise(fallback))
    return F.concat(F.lit("mastodon:"), F.when(host == home, F.lit("")).otherwise(F.concat(host, F.lit(":"))), ident)


def mastodon_statuses(payloads: DataFrame, brand: Brand = BRAND, home: str = "mastodon.social",
                      gate: bool = True) -> DataFrame:
    """Statuses: boosts unwrapped, one row per URI, text = warning + content + link card."""
    boosted = Doc(F.col("_doc")).text("$.reblog.id").isNotNull()
    rows = once(parsed(payloads), _s=F.when(boosted, F.try_variant_get("_doc", "$.reblog", "variant")).otherwise(F.col("_doc")))
    d = Doc(F.col("_s"))
    uri = d.text("$.uri", "$.url")
    rows = once(rows, _t=text.squeeze(text.unescape_html(F.concat_ws(
        " ", d.text("$.spoiler_text"), F.regexp_replace(d.text("$.content"), text.HTML_TAG, " "), d.text("$.card.title"),
        d.text("$.card.description")))))
    body = F.col("_t")
    tags = F.transform(d.items("$.tags"), lambda t: F.try_variant_get(t, "$.name", "string"))
    lang = d.text("$.language", default="en")
    acct = d.text("$.account.acct")
    keep = F.length(body) > 0
    if gate:
        keep = keep & gates.tagged(body, tags, brand)
    out = posts(rows.filter(keep), "mastodon", date=d.text("$.created_at"), source_id=_fediverse_id(uri, d.text("$.id", default=""), home),
                author=_handle(acct), author_name=d.text("$.account.display_name"), text=body, url=d.text("$.url", "$.uri"),
                engagement=F.coalesce(d.count("$.favourites_count"), F.lit(0)), reply_count=d.count("$.replies_count"),
                retweet_count=d.count("$.reblogs_count"), lang=F.when(lang.isin("und", "unknown"), "en").otherwise(lang))
    return one_per_id(out)


def mastodon_stream(lines: DataFrame, brand: Brand = BRAND) -> DataFrame:
    """Server-sent lines (column ``value``): ``data:`` payloads of statuses that name an alias."""
    data = lines.filter(F.col("value").startswith("data:")).select(
        F.trim(F.substring("value", 6, 2147483647)).alias("payload"))
    d = Doc(F.col("_doc"))
    body = F.col("_t")
    rows = once(parsed(data), _t=text.html_to_text(d.text("$.content")))
    rows = rows.filter((F.length(body) > 0) & gates.mentions_alias(body, brand))
    return posts(rows, "mastodon", date=d.text("$.created_at"), source_id=F.concat(F.lit("mastodon:"), d.text("$.id")),
                 author=_handle(d.text("$.account.acct")), text=body, url=d.text("$.url"), engagement=F.lit(0), lang=F.lit("en"))


def one_per_id(rows: DataFrame) -> DataFrame:
    """One row per id; of equal ids the one with the greatest content decides, combining map-side."""
    fields = [c for c in rows.columns if c != "source_id"]
    return rows.groupBy("source_id").agg(F.max(F.struct(*fields)).alias("_b")).select(
        "source_id", *[F.col(f"_b.{c}").alias(c) for c in fields]).select(*rows.columns)


# ---------------------------------------------------------------- forums
def hackernews_hits(payloads: DataFrame, brand: Brand = BRAND, gate: bool = True) -> DataFrame:
    """Search hits: title and body, date rebuilt from the epoch where it is missing."""
    d = Doc(F.col("_item"))
    clean = lambda c: text.strip_edges(text.unescape_html(F.regexp_replace(F.coalesce(c, F.lit("")), text.HTML_TAG, "")))
    title, body = clean(d.text("$.title")), clean(d.text("$.comment_text", "$.story_text"))
    rows = once(each(payloads, "$.hits"), _title=title, _body=body, _story=clean(d.text("$.story_title")))
    both = F.concat_ws("\n", F.nullif(F.col("_title"), F.lit("")), F.nullif(F.col("_body"), F.lit("")))
    said = F.coalesce(F.nullif(both, F.lit("")), F.col("_story"))
    hay = F.lower(F.concat_ws(" ", *[d.text(f"$.{k}") for k in ("title", "story_title", "story_text", "comment_text", "url")]))
    oid = d.text("$.objectID")
    keep = F.length(said) > 0
    if gate:
        keep = keep & gates.on_brand(hay, brand)
    out = posts(rows.filter(keep), "hackernews", date=d.text("$.created_at", "$.created_at_i"),
                source_id=F.concat(F.lit("hackernews:"), oid), author=d.text("$.author", default=""), text=said,
                url=F.coalesce(d.text("$.url"), F.concat(F.lit("https://news.ycombinator.com/item?id="), oid)),
                engagement=F.coalesce(d.count("$.points"), F.lit(0)), reply_count=d.count("$.num_comments"),
                conversation_id=F.coalesce(d.text("$.story_id"), oid), lang=F.lit("en"))
    return one_per_id(out)


REMOVED = ("[deleted]", "[removed]")


def reddit_submissions(payloads: DataFrame, brand: Brand = BRAND, gate: bool = True) -> DataFrame:
    """Submissions. The gate sees the text as stored, that is after truncation."""
    d = Doc(F.col("_doc"))
    body = F.when(d.text("$.selftext").isin(*REMOVED), F.lit("")).otherwise(d.text("$.selftext", default=""))
    rows = once(parsed(payloads), _t=text.strip_edges(F.concat(d.text("$.title", default=""), F.lit("\n"), body)))
    said = F.col("_t")
    pid = d.text("$.id")
    keep = pid.isNotNull() & (F.length(said) > 0)
    if gate:
        keep = keep & gates.three_tier(said, brand)
    out = posts(rows.filter(keep), "reddit", date=d.text("$.created_utc"), source_id=F.concat(F.lit("reddit:"), pid),
                author=d.text("$.author"), author_name=d.text("$.author"), text=said,
                url=F.concat(F.lit("https://reddit.com"), F.coalesce(d.text("$.permalink"), F.concat(
                    F.lit("/r/"), d.text("$.subreddit"), F.lit("/comments/"), pid, F.lit("/")))),
                engagement=F.coalesce(d.count("$.score"), F.lit(0)), reply_count=F.coalesce(d.count("$.num_comments"), F.lit(0)),
                conversation_id=pid, lang=F.lit("en"))
    return one_per_id(out)


def reddit_comments(payloads: DataFrame, threads: DataFrame) -> DataFrame:
    """Comments of the given submissions; they inherit the thread's brand pass."""
    d = Doc(F.col("_doc"))
    body, cid = d.text("$.body"), d.text("$.id")
    parent = F.regexp_replace(d.text("$.link_id"), "^t3_", "")
    rows = parsed(payloads).filter(cid.isNotNull() & body.isNotNull() & ~body.isin(*REMOVED))
    out = posts(rows, "reddit", date=d.text("$.created_utc"), source_id=F.concat(F.lit("reddit:c_"), cid), author=d.text("$.author"),
                author_name=d.text("$.author"), text=body,
                url=F.concat(F.lit("https://reddit.com"), d.text("$.permalink", default="")),
                engagement=F.coalesce(d.count("$.score"), F.lit(0)), conversation_id=parent, lang=F.lit("en"))
    return one_per_id(out).join(threads.select("conversation_id"), "conversation_id", "left_semi").select(*out.columns)


def first_non_empty(*paths: DataFrame) -> DataFrame:
    """The first path that delivered anything (keyed, then mirror, then feed)."""
    for rows in paths[:-1]:
        if not rows.isEmpty():
            return rows
    return paths[-1]


def discourse_posts(payloads: DataFrame, brand: Brand = BRAND, site: str = "https://forum.example", gate: bool = True,
                    source: str = "valuepickr") -> DataFrame:
    """Search answers: each post with its topic, looked up within the same payload."""
    topics = F.transform(Doc(F.col("_doc")).items("$.topics"), lambda t: F.struct(
        *[Doc(t).text(f"$.{c}").alias(f"_{c}") for c in ("id", "title", "slug")]))
    rows = once(parsed(payloads), _topics=topics).select(
        "_topics", F.posexplode(Doc(F.col("_doc")).items("$.posts")).alias("_pos", "_item"))
    d = Doc(F.col("_item"))
    rows = once(rows, _id=d.text("$.topic_id"))
    # Of topics with the same id the greatest title and slug count.
    rows = once(rows, _t=F.array_max(F.filter("_topics", lambda t: t["_id"] == F.col("_id")))).drop("_topics")
    said = joined(". ", F.col("_t._title"), text.squeeze(d.text("$.blurb", default="")))
    keep = F.length(said) > 0
    if gate:
        keep = keep & gates.on_brand(said, brand)
    link = F.concat_ws("/", F.lit(f"{site}/t"), F.coalesce("_t._slug", F.lit("t")), F.col("_id"), d.text("$.post_number", default="1"))
    return one_per_id(posts(rows.filter(keep), source, date=d.text("$.created_at"), source_id=F.concat(F.lit(f"{source}:"), d.text("$.id")),
                            author=d.text("$.username", "$.name", default=""), text=said, url=link,
                            engagement=F.coalesce(d.count("$.like_count"), F.lit(0)), reply_count=F.lit(0), lang=F.lit("en")))


# ---------------------------------------------------------------- app stores
def appstore_reviews(payloads: DataFrame, as_of: Column, max_age_days: int = 365) -> DataFrame:
    """Feed entries of one brand app per payload (``app_id``, ``app_name`` beside it): no gate per review."""
    rows = each(payloads, "$.feed.entry")
    d = Doc(F.col("_item"))
    rid = F.trim(F.substring_index(d.text("$.id.label", default=""), "/", -1))
    said = F.when(d.text("$.title.label").isNotNull(), joined(". ", d.text("$.title.label"), d.text("$.content.label"))
                  ).otherwise(d.text("$.content.label", default=""))
    rows = rows.filter((rid != "") & (F.length(said) > 0))
    stars = d.text('$["im:rating"].label', default="")
    out = posts(rows, "appstore", date=d.text("$.updated.label"), source_id=F.concat(F.lit("appstore:"), rid),
                author=d.text("$.author.name.label"), author_name=d.text("$.author.name.label"),
                text=F.format_string("[%s] [%s★] %s", F.col("app_name"), stars, said), rating=numbers.rating(stars),
                url=F.concat(F.lit("https://apps.apple.com/app/id"), "app_id"),
                engagement=F.coalesce(d.count('$["im:voteCount"].label'), F.lit(0)), lang=F.lit("en"))
    fresh = F.col("created_at").isNull() | (F.col("created_at") >= as_of - F.make_interval(days=F.lit(max_age_days)))
    return one_per_id(out.filter(fresh))


def play_reviews(payloads: DataFrame) -> DataFrame:
    d = Doc(F.col("_doc"))
    stars = d.text("$.score", default="")
    return posts(parsed(payloads), "play", date=d.text("$.at"), source_id=F.concat(F.lit("play:"), d.text("$.reviewId")),
                 author=d.text("$.userName"), author_name=d.text("$.userName"), rating=numbers.rating(stars),
                 text=F.format_string("[%s★] %s", stars, d.text("$.content", default="")),
                 engagement=F.coalesce(d.count("$.thumbsUpCount"), F.lit(0)), lang=F.lit("en"))


# ---------------------------------------------------------------- news
def rss_items(feeds: DataFrame, tag: str = "item", xml: str = "xml") -> DataFrame:
    """(feed, pos, title, link, guid, author, published, summary) of every item of every feed document."""
    def inner(*names: str) -> Column:
        found = []
        for n in names:
            raw = F.regexp_extract("_block", rf"(?s)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1)
            raw = F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
            found.append(F.nullif(raw, F.lit("")))
        return F.coalesce(*found) if len(found) > 1 else found[0]

    blocks = F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    rows = feeds.select("*", F.posexplode(blocks).alias("pos", "_block"))
    href = F.nullif(F.regexp_extract("_block", r'<link[^>]*href="([^"]*)"', 1), F.lit(""))
    names = {"title": ("title",), "link": ("link",), "guid": ("guid", "id"), "author": ("dc:creator", "author"),
             "published": ("pubDate", "published", "updated"), "summary": ("description", "summary", "content")}
    raw = once(rows, **{f"_{k}": inner(*v) for k, v in names.items()}, _href=href)
    # Feeds escape their markup once more: decode, then read the markup.
    plain = once(raw, **{f"u_{k}": text.unescape_html(F.col(f"_{k}")) for k in names})
    tidy = once(plain, **{k: text.html_to_text(F.col(f"u_{k}")) for k in names})
    return tidy.select(*[c for c in feeds.columns if c != xml], "pos", *[
        F.coalesce(F.nullif(F.col(k), F.lit("")), *([F.col("_href")] if k == "link" else [])).alias(k) for k in names])


def rss_tweets(items: DataFrame) -> DataFrame:
    """Feed mirrors of posts: id out of the link, reply prefix stripped, one row per post."""
    tid = F.regexp_extract("link", r"(?i)/status(?:es)?/(\d+)", 1)
    author = F.regexp_replace("author", "^@+", "")
    said = F.regexp_replace("title", r"^R to @\w+:\s*", "")
    rows = items.withColumn("_id", tid).filter(F.col("_id") != "")
    return one_per_id(posts(rows, "twitter", date=F.col("published"), source_id=F.concat(F.lit("x:"), "_id"), author=_handle(author),
                            text=said, url=F.concat(F.lit("https://x.com/"), F.coalesce(author, F.lit("i")), F.lit("/status/"), "_id")))


def fresh_feeds(items: DataFrame, as_of: Column, max_age_days: int = THRESHOLDS.feed_max_age_days) -> DataFrame:
    """Drop whole feeds whose newest entry is too old or undated (frozen feeds). The items are stored, as they are needed twice."""
    dated = cut_lineage(items.withColumn("_at", dates.parse_datetime(F.col("published"))), "feed-items")
    alive = dated.groupBy("feed").agg(F.max("_at").alias("_newest")).filter(
        F.unix_timestamp(as_of) - F.unix_timestamp("_newest") <= max_age_days * 86400)
    return dated.join(alive.select("feed"), "feed", "left_semi").drop("_at")


def rss_news(items: DataFrame, brand: Brand = BRAND, source: str = "rssnews", gate: bool = True) -> DataFrame:
    said = text.strip_edges(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit(""))))
    rows = items.withColumn("_t", said)
    if gate:
        rows = rows.filter(gates.brand_word(F.col("_t"), brand))
    key = F.coalesce("guid", "link", "_t")
    return one_per_id(posts(rows, source, date=F.col("published"),
                            source_id=F.concat(F.lit(f"{source}:"), F.substring(F.md5(key), 1, 12)), author=F.col("feed"),
                            text=F.col("_t"), url=F.col("link"), engagement=F.lit(0), lang=F.lit("en")))


# Language names as the news index spells them.
LANGUAGES = {"english": "en", "hindi": "hi", "tamil": "ta", "telugu": "te", "marathi": "mr", "bengali": "bn", "gujarati": "gu",
             "kannada": "kn", "malayalam": "ml", "punjabi": "pa", "urdu": "ur"}


def gdelt_articles(payloads: DataFrame) -> DataFrame:
    rows = each(payloads, "$.articles")
    d = Doc(F.col("_item"))
    title, link = d.text("$.title", default=""), d.text("$.url")
    name = F.lower(d.text("$.language", default=""))
    codes = F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv])
    stamp = F.try_to_timestamp(d.text("$.seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return one_per_id(posts(rows, "gdelt", date=d.text("$.seendate"), created_at=stamp,
                            source_id=F.concat(F.lit("gdelt:"), F.substring(F.md5(F.coalesce(link, title)), 1, 12)),
                            author=d.text("$.domain", default="gdelt"), text=title, url=link, engagement=F.lit(0),
                            lang=F.coalesce(F.element_at(codes, name), F.nullif(F.substring(name, 1, 8), F.lit("")), F.lit("en"))))


# ---------------------------------------------------------------- video
def youtube_videos(payloads: DataFrame, brand: Brand = BRAND, gate: bool = True) -> DataFrame:
    d = Doc(F.col("_doc"))
    said = joined(". ", d.text("$.title"), d.text("$.desc"))
    keep = F.length(said) > 0
    if gate:
        keep = keep & gates.brand_word(F.concat_ws(" ", said, d.text("$.channel")), brand)
    lang = F.when(said.rlike(text.DEVANAGARI), "hi").otherwise("en")
    return posts(parsed(payloads).filter(keep), "youtube", date=d.text("$.published"), source_id=F.concat(F.lit("yt:v_"), d.text("$.vid")),
                 author=d.text("$.channel"), author_name=d.text("$.channel"), text=said,
                 url=F.concat(F.lit("https://www.youtube.com/watch?v="), d.text("$.vid")), lang=lang,
                 engagement=F.coalesce(d.count("$.views"), F.lit(0)), reply_count=F.lit(0), conversation_id=d.text("$.vid"))


def youtube_comments(payloads: DataFrame, as_of: Column, brand: Brand = BRAND) -> DataFrame:
    """Comments with enough content, gated per thread; dates are approximate ("2 weeks ago")."""
    d = Doc(F.col("_doc"))
    body = d.text("$.text", default="")
    when = d.text("$.published")
    rows = once(parsed(payloads), _t=body)
    body = F.col("_t")
    rows = rows.filter(d.text("$.id").isNotNull() & text.has_min_content(body))
    out = posts(rows, "youtube", date=when, created_at=F.coalesce(dates.relative(when, as_of), dates.parse_datetime(when)),
                source_id=F.concat(F.lit("yt:"), d.text("$.id")), author=d.text("$.author"),
                author_name=F.regexp_replace(d.text("$.author"), "^@+", ""), text=body,
                url=F.concat(F.lit("https://www.youtube.com/watch?v="), d.text("$.vid"), F.lit("&lc="), d.text("$.id")),
                lang=F.when(body.rlike(text.DEVANAGARI), "hi").otherwise("en"),
                engagement=numbers.magnitude(d.text("$.likes")), reply_count=numbers.magnitude(d.text("$.replies")),
                conversation_id=d.text("$.vid"))
    return thread_gate(one_per_id(out), "conversation_id", gates.brand_word(F.col("text"), brand))


def thread_gate(rows: DataFrame, thread: str, named: Column) -> DataFrame:
    """Whole thread if it is demonstrably about the brand, else only the rows that name it."""
    marked = rows.withColumn("_named", F.coalesce(named, F.lit(False)))
    counts = marked.groupBy(thread).agg(F.count_if("_named").alias("k"), F.count(F.lit(1)).alias("n"))
    t = THRESHOLDS
    dense = counts.filter((F.col("k") >= t.thread_min_named) & (F.col("k") / F.col("n") >= t.thread_min_ratio)).select(
        thread, F.lit(True).alias("_dense"))
    return marked.join(dense, thread, "left").filter(F.col("_named") | F.col("_dense")).drop("_named", "_dense")


def round_robin(legs: DataFrame, leg: str, rank: str, key: str) -> DataFrame:
    """Interleave ranked lists: first of every list, then the second …; a key counts once, at its best place."""
    best = legs.groupBy(key).agg(F.min(F.struct(rank, leg)).alias("b"))
    return best.select(key, F.col(f"b.{rank}").alias(rank), F.col(f"b.{leg}").alias(leg)).orderBy(rank, leg)


# ---------------------------------------------------------------- drifting shapes
# Per source, where its list may be and which names each field has had.
SHAPES: dict[str, dict[str, tuple[str, ...]]] = {
    "tiktok": {
        "items": ("$.data.videos", "$.data.items", "$.data.aweme_list", "$.data", "$.videos", "$.items", "$.aweme_list", "$.results", "$"),
        "id": ("$.id", "$.video_id", "$.aweme_id"),
        "author": ("$.author.uniqueId", "$.author.unique_id", "$.author_unique_id", "$.username", "$.author"),
        "author_name": ("$.author.nickname", "$.author_name", "$.nickname"),
        "text": ("$.desc", "$.description", "$.text", "$.title"),
        "engagement": ("$.stats.diggCount", "$.digg_count", "$.likes", "$.like_count"),
        "view_count": ("$.stats.playCount", "$.play_count", "$.views", "$.view_count"),
        "reply_count": ("$.stats.commentCount", "$.comment_count", "$.reply_count"),
        "date": ("$.createTime", "$.create_time", "$.date", "$.created_at"), "url": ("$.url", "$.share_url", "$.webVideoUrl")},
    "linkedin": {
        "items": ("$.data.posts", "$.data.items", "$.data", "$.posts", "$.items", "$.results", "$"), "id": ("$.urn", "$.id", "$.post_id"),
        "author": ("$.author.name", "$.author_name", "$.author"), "author_name": ("$.author.name", "$.author_name", "$.author"),
        "text": ("$.text", "$.commentary", "$.content", "$.description"),
        "engagement": ("$.stats.likes", "$.num_likes", "$.likes", "$.like_count", "$.reactions"),
        "reply_count": ("$.stats.comments", "$.num_comments", "$.comments", "$.comment_count"),
        "retweet_count": ("$.stats.shares", "$.num_shares", "$.shares", "$.reposts"),
        "date": ("$.posted_at", "$.date", "$.created_at", "$.published_at"), "url": ("$.url", "$.post_url", "$.link")},
    "trustpilot": {
        "items": ("$.reviews", "$.items", "$.results", "$"), "author": ("$.author", "$.name"), "title": ("$.title",), "text": ("$.body", "$.text"),
        "rating": ("$.rating", "$.stars"), "date": ("$.date", "$.published"), "url": ("$.url", "$.link")},
    "consumercomplaints": {
        "items": ("$.complaints", "$.items", "$.results", "$"), "author": ("$.author", "$.user"), "title": ("$.title",), "text": ("$.text", "$.body"),
        "date": ("$.date", "$.posted"), "url": ("$.url", "$.link")},
    "mouthshut": {
        "items": ("$.reviews", "$.items", "$.results", "$"), "author": ("$.author", "$.reviewer"), "title": ("$.title",), "text": ("$.review", "$.body", "$.text"),
        "rating": ("$.rating", "$.stars"), "date": ("$.date",), "url": ("$.url", "$.link")},
    "gmaps": {
        "items": ("$.reviews", "$.items", "$.results", "$"), "author": ("$.author", "$.reviewer_name"), "title": ("$.branch", "$.place"),
        "text": ("$.text", "$.review"), "rating": ("$.rating", "$.stars"), "date": ("$.date", "$.time"), "url": ("$.url", "$.link")},
    "facebook": {
        "items": ("$.data.posts", "$.posts", "$.items", "$.results", "$"), "id": ("$.post_id", "$.id"), "author": ("$.author", "$.page"),
        "text": ("$.text", "$.message", "$.content"), "engagement": ("$.likes", "$.reactions"), "reply_count": ("$.comments",),
        "retweet_count": ("$.shares",), "date": ("$.date", "$.created_time"), "url": ("$.url", "$.link")},
    "instagram": {
        "items": ("$.data.posts", "$.posts", "$.items", "$.results", "$"), "id": ("$.shortcode", "$.id"), "author": ("$.author", "$.username"),
        "text": ("$.caption", "$.text"), "engagement": ("$.likes", "$.like_count"), "reply_count": ("$.comments", "$.comment_count"),
        "date": ("$.date", "$.taken_at"), "url": ("$.url", "$.link")},
}


def drifting(payloads: DataFrame, source: str, shape: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Any source of the shape table: the list under whichever key, each field under whichever name.

    Without a native id the id is a digest of url and title (or title and text); a rating is
    kept as a rating, never as engagement.
    """
    spec = shape or SHAPES[source]
    d = Doc(F.col("_item"))
    fields = {c: d.text(*paths) for c, paths in spec.items() if c in ("id", "author", "author_name", "title", "text", "rating", "date", "url")}
    rows = once(each(payloads, *spec["items"]), **{f"_{c}": v for c, v in fields.items()})
    get = lambda c: F.col(f"_{c}") if c in fields else F.lit(None).cast("string")
    rows = once(rows, _body=F.concat_ws(" ", get("title"), get("text")),
                _stars=numbers.rating(get("rating")) if "rating" in spec else F.lit(None).cast("double"))
    rows = rows.filter(F.length("_body") > 0)
    shown = F.regexp_replace(F.col("_stars").cast("string"), r"\.0$", "")
    said = F.when(F.col("_stars") > 0, F.concat(F.lit("["), shown, F.lit("] "), "_body")).otherwise(F.col("_body"))
    key = F.when(get("url").isNotNull(), F.concat_ws("|", get("url"), get("title"))).otherwise(
        F.concat_ws("|", get("title"), get("text")))
    ident = F.coalesce(get("id"), F.substring(F.md5(key), 1, 12))
    counts = {c: d.count(*spec[c]) for c in ("engagement", "view_count", "reply_count", "retweet_count") if c in spec}
    social = source in ("tiktok", "facebook", "instagram")
    author = _handle(get("author")) if social else F.coalesce(get("author"), F.lit("anonymous"))
    return one_per_id(posts(rows, source, date=get("date"), source_id=F.concat(F.lit(f"{source}:"), ident), author=author,
                            author_name=F.coalesce(get("author_name"), get("author")), text=said, url=get("url"), lang=F.lit("en"),
                            rating=F.when(F.col("_stars") > 0, F.col("_stars")), **counts))


# ---------------------------------------------------------------- metrics
# Per source, which field carries which common metric.
METRICS = {"reddit": {"likes": "$.score", "comments": "$.num_comments"}, "hackernews": {"likes": "$.score", "comments": "$.descendants"},
           "mastodon": {"likes": "$.favourites_count", "reshares": "$.reblogs_count", "comments": "$.replies_count"},
           "twitter": {"likes": "$.engagement", "comments": "$.reply_count", "reshares": "$.retweet_count", "views": "$.view_count"}}


def metrics(payloads: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source_id, likes, reshares, comments, views): unknown stays NULL.

    ``payloads`` holds (source, ref, payload); ``ref`` is the post's full id or the part after the
    prefix, so it is expanded to both spellings before the join on the id.
    """
    d = Doc(F.col("_doc"))

    def metric(name: str) -> Column:
        cases = [(s, m[name]) for s, m in METRICS.items() if name in m]
        chain = reduce(lambda c, sm: c.when(F.col("source") == sm[0], d.count(sm[1])), cases[1:],
                       F.when(F.col("source") == cases[0][0], d.count(cases[0][1])))
        return chain.alias(name)

    kids = F.when(F.col("source") == "hackernews", F.nullif(F.size(d.items("$.kids")), F.lit(0))).cast("bigint")
    rows = parsed(payloads).select("source", "ref", metric("likes"), metric("reshares"), F.coalesce(
        F.when(kids > 0, kids), metric("comments")).alias("comments"), metric("views"))
    ids = wanted.select("source_id", "source", F.explode(F.array_distinct(F.array(
        F.col("source_id"), F.substring_index("source_id", ":", -1)))).alias("ref"))
    hit = ids.join(rows, ["source", "ref"])
    exact = F.struct((F.col("ref") == F.col("source_id")).alias("full"), "likes", "reshares", "comments", "views")
    return hit.groupBy("source_id").agg(F.max(exact).alias("m")).select(
        "source_id", "m.likes", "m.reshares", "m.comments", "m.views")
