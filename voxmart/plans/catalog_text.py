"""Cleaning, masking, gates, dates and numbers, sentiment, categories."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from voxmart import adapters as A
from voxmart.adapters import with_ctes
from voxmart.config import BRAND
from voxmart.functions import dates, gates, labels, numbers, pii, text
from voxmart.operators import categories, cleaning, scoring
from voxmart.plans.catalog_facts import base
from voxmart.plans.registry import query

# The oracle's regular expressions know only ASCII classes; these spell out the wide ones.
SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
W = r"[\p{L}\p{N}\p{M}_]"
CLEAN = rf"""cp AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+',
 '', 'g'), '^{SP}*RT\b[:,]?', ''), '[\x{{200b}}\x{{feff}}]', '', 'g'), '{SP}+', ' ', 'g')) AS clean FROM posts),
 ch AS (SELECT *, md5(regexp_replace(lower(clean), '[^a-z0-9\x{{900}}-\x{{97f}} ]', '', 'g')) AS text_hash FROM cp)"""
# Luhn over a list of digits, doubling every second one from the right.
LUHN = """list_sum([CASE WHEN (len(ds) - i) % 2 = 1 THEN CASE WHEN 2 * d > 9 THEN 2 * d - 9 ELSE 2 * d END ELSE d END
 for d, i in ds]) % 10 = 0"""


def docs(spark, sf):
    return A.posts(spark, sf)


@query("clean_text", with_ctes("posts") + f", {CLEAN} SELECT source_id, md5(clean) AS clean_md5, length(clean) AS n, text_hash FROM ch")
def _(spark, sf):
    return cleaning.clean(docs(spark, sf)).select(
        "source_id", F.md5("clean_text").alias("clean_md5"), F.length("clean_text").cast("bigint").alias("n"), "text_hash")


@query("clean_text_links", """WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ': ' ELSE '' END AS head,
 event_type || CASE WHEN event_id % 5 > 0 THEN ' and' ELSE '' END AS body FROM events)
SELECT event_id, event_id % 5 AS n_urls, body AS clean, md5(body) AS text_hash FROM e""")
def _(spark, sf):
    links = F.repeat(F.concat(F.lit("  https://t.example/"), F.col("event_type"), F.lit("?q=1\t")), F.col("event_id").cast("int") % 5)
    prefix = F.when(F.col("event_id") % 2 == 0, " RT: ").otherwise("​")
    raw = F.concat(prefix, F.col("event_type"), F.when(F.col("event_id") % 5 > 0, F.lit(" \n and")).otherwise(""), links)
    return cleaning.clean(A.table(spark, sf, "events").select("event_id", raw.alias("text"))).select(
        "event_id", F.col("n_urls").cast("bigint").alias("n_urls"), F.col("clean_text").alias("clean"), "text_hash")


DUP = """cd AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY text_hash ORDER BY created_date, source_id) = 1 THEN 0 ELSE 1 END
 AS is_duplicate FROM ch)"""


@query("duplicates", with_ctes("posts") + f", {CLEAN}, {DUP} SELECT source_id, text_hash, is_duplicate FROM cd")
def _(spark, sf):
    return cleaning.duplicates(docs(spark, sf))


@query("duplicates_incremental", with_ctes("posts") + f""", {CLEAN}, old AS (SELECT DISTINCT text_hash FROM ch WHERE doc_id % 3 = 0),
 new AS (SELECT * FROM ch WHERE doc_id % 3 <> 0)
SELECT source_id, CASE WHEN text_hash IN (SELECT text_hash FROM old) THEN 1 WHEN row_number() OVER (PARTITION BY text_hash
 ORDER BY created_date, source_id) = 1 THEN 0 ELSE 1 END AS is_duplicate FROM new""")
def _(spark, sf):
    posts = docs(spark, sf)
    stored = cleaning.transform_posts(posts.filter("doc_id % 3 = 0"))
    return cleaning.transform_posts(posts, stored).select("source_id", "is_duplicate")


@query("not_yet_processed", with_ctes("posts") + "SELECT source_id FROM posts WHERE doc_id % 3 <> 0")
def _(spark, sf):
    posts = docs(spark, sf)
    return cleaning.not_yet(posts, posts.filter("doc_id % 3 = 0")).select("source_id")


PROMO_SQL = " OR ".join(f"contains(lower(clean), '{w}')" for w in text.PROMO)
HINGLISH_SQL = "[" + ", ".join(f"'{w}'" for w in text.HINGLISH) + "]"
FLAGS = rf"""cf AS (SELECT *, CASE WHEN regexp_matches(clean, '[\x{{900}}-\x{{97f}}]') THEN 'hi' WHEN len(list_intersect(list_distinct(
 regexp_extract_all(lower(clean), '[a-z]+')), {HINGLISH_SQL})) >= 2 THEN 'hi-en' ELSE 'en' END AS det,
 CASE WHEN len(regexp_extract_all(text, 'https?://')) >= 3 OR {PROMO_SQL}
  OR len(regexp_extract_all(clean, '[\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}]')) >= 6
  OR len(list_filter(list_distinct(string_split(clean, '')), lambda c: c <> '' AND contains(clean, repeat(c, 7)))) > 0
  THEN 1 ELSE 0 END AS spam FROM cd)"""


# Cases the documents do not contain: every branch of the language and spam rules.
_CASES = ("paise nahi mile yaar", "नमस्ते bank", "hello there", "click here to win", "call me yessssssss",
          "\U0001F600\U0001F600\U0001F600\U0001F600\U0001F600\U0001F600 wow", "no problem ho", "plain post")


@query("language_and_spam", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'hi-en' WHEN 1 THEN 'hi' ELSE 'en' END AS lang,
 CASE WHEN event_id % 8 IN (3, 4, 5) OR event_id % 3 = 0 THEN 1 ELSE 0 END AS spam FROM events""")
def _(spark, sf):
    case = F.element_at(F.array(*[F.lit(c) for c in _CASES]), (F.col("event_id") % 8 + 1).cast("int"))
    urls = F.when(F.col("event_id") % 3 == 0, 3).otherwise(2)
    return A.table(spark, sf, "events").select(
        "event_id", text.detect_language(case).alias("lang"), text.spam_flag(case, urls).alias("spam"))


PII = rf"""m1 AS (SELECT doc_id, text, regexp_replace(text, '\b[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{{2,}}\b', '[EMAIL]', 'g') AS p1 FROM documents),
 m2 AS (SELECT *, regexp_replace(p1, '\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\b', '[PAN]', 'g') AS p2 FROM m1),
 m3 AS (SELECT *, regexp_extract_all(p2, '(?i)\b(otp|cvv|pin|code)\b[^\d]{{0,10}}(\d{{3,6}})\b', 1) AS kw,
  regexp_replace(p2, '(?i)\b(otp|cvv|pin|code)\b[^\d]{{0,10}}(\d{{3,6}})\b', '\1 [REDACTED]', 'g') AS p3 FROM m2),
 m4 AS (SELECT *, regexp_split_to_array(p3, '\b\d(?:[ \-]?\d){{8,21}}\b') AS gaps,
  [regexp_replace(r, '\D', '', 'g') for r in regexp_extract_all(p3, '\b\d(?:[ \-]?\d){{8,21}}\b')] AS runs FROM m3),
 m5 AS (SELECT *, [CASE WHEN length(r) BETWEEN 13 AND 19 AND luhn_ok(r) THEN 'card' WHEN length(r) = 12 THEN 'aadhaar_or_account'
  WHEN length(r) = 10 THEN 'phone' ELSE 'account' END for r in runs] AS kinds FROM m4),
 m6 AS (SELECT *, [CASE kinds[i] WHEN 'card' THEN 'XXXX-XXXX-XXXX-' || r[-4:] WHEN 'aadhaar_or_account' THEN 'XXXX-XXXX-' || r[-4:]
  WHEN 'phone' THEN 'XXXXXXXX' || r[-2:] ELSE repeat('X', length(r) - 4) || r[-4:] END for r, i in runs] AS masks FROM m5),
 m7 AS (SELECT doc_id, array_to_string([g || coalesce(masks[i], '') for g, i in gaps], '') AS masked,
  list_concat(list_concat(CASE WHEN p1 <> text THEN ['email'] ELSE [] END, CASE WHEN p2 <> p1 THEN ['pan'] ELSE [] END),
   list_concat([lower(k) for k in kw], kinds)) AS found FROM m6)""".replace(
    "luhn_ok(r)", """(list_sum([CASE WHEN (length(r) - i) % 2 = 1 THEN CASE WHEN CAST(d AS INT) > 4 THEN 2 * CAST(d AS INT) - 9
  ELSE 2 * CAST(d AS INT) END ELSE CAST(d AS INT) END for d, i in string_split(r, '')]) % 10 = 0)""")


KINDS = "array_to_string([f for f, i in found if list_position(found, f) = i], ',')"
CLEANED = f"""{{posts}}, {CLEAN}, {DUP}, {FLAGS}, {PII.replace("FROM documents", "FROM (SELECT doc_id, clean AS text FROM cf)")},
 finished AS (SELECT cf.*, md5(masked) AS clean_md5, {KINDS} AS pii_types FROM cf JOIN m7 USING (doc_id))""".replace("{posts}", with_ctes("posts"))


@query("clean_posts", CLEANED + " SELECT source_id, clean_md5, det AS lang, text_hash, is_duplicate, spam AS spam_flag, pii_types FROM finished")
def _(spark, sf):
    return cleaning.transform_posts(docs(spark, sf)).select(
        "source_id", F.md5("clean_text").alias("clean_md5"), "lang", "text_hash", "is_duplicate", "spam_flag", "pii_types")


@query("transform_stats", CLEANED + """
SELECT 'rows' AS metric, count(*) AS n FROM finished UNION ALL SELECT 'duplicates', count(*) FILTER (is_duplicate = 1) FROM finished
UNION ALL SELECT 'spam', count(*) FILTER (spam = 1) FROM finished UNION ALL SELECT 'with_pii', count(*) FILTER (pii_types <> '') FROM finished
UNION ALL SELECT 'lang:' || det, count(*) FROM finished GROUP BY det""")
def _(spark, sf):
    return cleaning.transform_stats(cleaning.transform_posts(docs(spark, sf)))


@query("pii_masked", f"""WITH {PII} SELECT doc_id, md5(masked) AS masked_md5, length(masked) AS n,
 CASE WHEN len(found) > 0 THEN 1 ELSE 0 END AS pii_present,
 array_to_string([f for f, i in found if list_position(found, f) = i], ',') AS pii_types FROM m7""")
def _(spark, sf):
    out = pii.masked_fields(A.table(spark, sf, "documents"), "text")
    return out.select("doc_id", F.md5("text_masked").alias("masked_md5"), F.length("text_masked").cast("bigint").alias("n"),
                      "pii_present", "pii_types")


@query("pii_kinds", r"""WITH e AS (SELECT event_id, event_id % 7 AS k, lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS two FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'mail [EMAIL] now' WHEN 1 THEN 'tax [PAN] id' WHEN 2 THEN 'OTP [REDACTED] sent'
 WHEN 3 THEN 'call XXXXXXXX' || two WHEN 4 THEN 'id XXXX-XXXX-90' || two WHEN 5 THEN 'acct XXXXX67' || two ELSE 'room 1234567' || two[1:1] END AS masked,
 CASE k WHEN 0 THEN 'email' WHEN 1 THEN 'pan' WHEN 2 THEN 'otp' WHEN 3 THEN 'phone' WHEN 4 THEN 'aadhaar_or_account' WHEN 5 THEN 'account'
 ELSE '' END AS kinds FROM e""")
def _(spark, sf):
    two = F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")
    k = F.col("event_id") % 7
    raw = (F.when(k == 0, F.concat(F.lit("mail a."), two, F.lit("@x-y.example now")))
           .when(k == 1, F.concat(F.lit("tax ABCDE12"), two, F.lit("F id")))
           .when(k == 2, F.concat(F.lit("OTP is : 98"), two, F.lit(" sent")))
           .when(k == 3, F.concat(F.lit("call 98-7654 32"), two)).when(k == 4, F.concat(F.lit("id 1234 5678 90"), two))
           .when(k == 5, F.concat(F.lit("acct 1234567"), two)).otherwise(F.concat(F.lit("room 1234567"), F.substring(two, 1, 1))))
    out = pii.masked_fields(A.table(spark, sf, "events").select("event_id", raw.alias("text")), "text")
    return out.select("event_id", F.col("text_masked").alias("masked"), F.col("pii_types").alias("kinds"))


@query("content_blocklist", rf"""WITH n AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '{SP}+', ' ', 'g'))) AS h FROM documents)
SELECT doc_id FROM n WHERE h NOT IN (SELECT h FROM n WHERE doc_id % 11 = 0)""")
def _(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "text")
    refused = d.filter("doc_id % 11 = 0").select(text.content_fingerprint(F.col("text")).alias("fingerprint")).distinct()
    return cleaning.blocklisted(d, refused).select("doc_id")


@query("min_content", r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 400")
def _(spark, sf):
    return A.table(spark, sf, "documents").filter(text.has_min_content(F.col("text"), 400)).select("doc_id")


@query("page_text", rf"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', ' ', 'g') AS t FROM pages),
 b AS (SELECT page_id, regexp_replace(t, '<[^>]+>', ' ', 'g') AS t FROM a),
 c AS (SELECT page_id, replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') AS t FROM b),
 d AS (SELECT page_id, trim(regexp_replace(t, '{SP}+', ' ', 'g')) AS t FROM c)
SELECT page_id, md5(t) AS text_md5, length(t) AS n FROM d""")
def _(spark, sf):
    t = text.page_to_text(F.col("html"))
    return A.table(spark, sf, "pages").select("page_id", t.alias("t")).select(
        "page_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n"))


@query("stable_ids", """SELECT o_orderkey, 'tp:' || substr(md5(concat_ws('|', nullif(o_orderpriority, ''), o_orderstatus)), 1, 12) AS a,
 'u' || substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 16) AS b FROM orders""")
def _(spark, sf):
    return A.table(spark, sf, "orders").select(
        "o_orderkey", text.stable_id("tp:", F.col("o_orderpriority"), F.lit(""), F.col("o_orderstatus")).alias("a"),
        text.stable_id("u", F.col("o_orderkey").cast("string"), length=16, algorithm="sha1").alias("b"))


@query("handles", "SELECT c_custkey, lower(c_name) AS handle FROM customer")
def _(spark, sf):
    raw = F.concat(F.repeat(F.lit("@"), (F.col("c_custkey") % 3).cast("int")), F.col("c_name"))
    return A.table(spark, sf, "customer").select("c_custkey", text.normalise_handle(raw).alias("handle"))


# ---------------------------------------------------------------- dates and numbers
@query("date_formats", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 OR (o_orderkey % 9 = 6 AND epoch(o_orderdate) + 37230 < 1e9) THEN NULL ELSE strftime(o_orderdate + CASE WHEN o_orderkey % 9 IN
 (0, 1, 2, 4, 6) THEN INTERVAL 37230 SECOND ELSE INTERVAL 0 SECOND END - CASE WHEN o_orderkey % 9 = 2 THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END,
 '%Y-%m-%d %H:%M:%S') END AS at FROM orders""")
def _(spark, sf):
    t = F.col("o_orderdate").cast("timestamp") + F.expr("interval 37230 seconds")
    day = F.col("o_orderdate").cast("timestamp")
    f = lambda c, p: F.date_format(c, p)
    shapes = [f(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), f(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), f(t, "yyyy-MM-dd HH:mm:ss'+05:30'"),
              f(day, "yyyy-MM-dd"), f(t, "EEE MMM dd HH:mm:ss '+0000' yyyy"), f(day, "MMM d, yyyy"),
              F.unix_timestamp(t).cast("string"), f(day, "d MMMM yyyy"), F.lit("last tuesday")]
    raw = F.element_at(F.array(*shapes), (F.col("o_orderkey") % 9 + 1).cast("int"))
    parsed = dates.parse_datetime(raw)
    return A.table(spark, sf, "orders").select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("date_quality", """SELECT o_orderpriority AS source, count(*) AS posts, count(*) FILTER (o_orderkey % 4 <> 3) AS with_date,
 count(*) FILTER (o_orderkey % 4 = 2) AS unparseable FROM orders GROUP BY 1""")
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "d MMM yyyy")).when(k == 2, "soon")
    rows = A.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), raw.alias("raw_created_at"))
    return cleaning.date_quality(rows.withColumn("created_at", dates.parse_datetime(F.col("raw_created_at"))))


@query("relative_dates", """SELECT event_id, strftime(TIMESTAMP '2024-02-01 10:00:00' - INTERVAL (event_id % 30) HOUR - INTERVAL (event_id % 50) MINUTE,
 '%Y-%m-%d %H:%M:%S') AS ago, strftime(TIMESTAMP '2024-02-01 10:00:30' - INTERVAL ((event_id % 20 + 1) * CASE event_id % 3 WHEN 0 THEN 2629800
 WHEN 1 THEN 31557600 ELSE 604800 END) SECOND, '%Y-%m-%d %H:%M:%S') AS rel FROM events WHERE event_id % 30 + event_id % 50 > 0""")
def _(spark, sf):
    e, as_of = F.col("event_id"), F.lit("2024-02-01 10:00:30").cast("timestamp")
    s = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    raw = F.concat((e % 30).cast("string"), F.lit(" hrs "), (e % 50).cast("string"), F.lit(" mins ago"))
    unit = F.when(e % 3 == 0, "months").when(e % 3 == 1, "years").otherwise("weeks")
    rel = F.concat((e % 20 + 1).cast("string"), F.lit(" "), unit, F.lit(" ago (edited)"))
    return A.table(spark, sf, "events").select("event_id", s(dates.ago(raw, as_of)).alias("ago"),
                                               s(dates.relative(rel, as_of)).alias("rel")).filter("ago is not null")


@query("local_clock_dates", """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 14 HOUR - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS wall,
 strftime(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 673 MINUTE - INTERVAL 330 MINUTE ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') AS stamp,
 strftime(CASE WHEN year(o_orderdate) >= 2000 THEN o_orderdate END, '%Y-%m-%d') AS from_id FROM orders""")
def _(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    s = lambda c, p="yyyy-MM-dd HH:mm:ss": F.date_format(c, p)
    stamp = F.concat(F.lit("Updated On : "), F.date_format(d, "d MMM yyyy"), F.when(F.col("o_orderkey") % 2 == 0, " | 11:13 AM IST").otherwise(""))
    story = F.when(F.year(d) >= 2000, F.concat(F.lit("1"), F.date_format(d, "yyMMdd"), F.lit("00140")))
    return A.table(spark, sf, "orders").select(
        "o_orderkey", s(dates.local_to_utc(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 14:00:00")), "yyyy-MM-dd HH:mm:ss")).alias("wall"),
        s(dates.stamp_to_utc(stamp)).alias("stamp"),
        s(dates.date_from_story_id(story, F.lit("2024-01-01").cast("timestamp")), "yyyy-MM-dd").alias("from_id"))


@query("number_coercion", """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * CASE l_linenumber % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END AS big,
 CAST(l_linenumber AS DOUBLE) AS stars, CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 1000 + 234 END AS whole FROM lineitem""")
def _(spark, sf):
    q, n = F.col("l_quantity").cast("bigint").cast("string"), F.col("l_linenumber")
    big = F.concat(q, F.when(n % 3 == 0, "K").when(n % 3 == 1, ".0m").otherwise(""))
    stars = F.concat(n.cast("string"), F.when(n % 2 == 0, F.lit("/5")).otherwise(" out of 5 stars"))
    whole = F.when(n == 7, "n/a").otherwise(F.concat(q, F.lit(",234")))
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.magnitude(big).alias("big"),
                                                 numbers.rating(stars).alias("stars"), numbers.whole(whole).alias("whole"))


# ---------------------------------------------------------------- gates
# The documents name no bank, so frequent words of theirs play the brand.
TEXT_BRAND = replace(BRAND, word="les", aliases=("les ", "der "), tags=("src1", "src2"), strong=(r"\bder[\s._-]*un", r"@les\w*"),
                     homonyms=(r"\bles\s+que\b", r"\bdes\s+les\b"), context=(r"\b(?:pour|avec|dans|est)\b",))
_B, _E = rf"(^|[^\p{{L}}\p{{N}}\p{{M}}_])", rf"($|[^\p{{L}}\p{{N}}\p{{M}}_])"
GATE = rf"""gt AS (SELECT doc_id, source, regexp_matches(lower(text), '{_B}les{_E}') AS word,
 regexp_matches(lower(text), '[@#]les|{_B}les{SP}*bank{_E}') AS handle, regexp_matches(lower(text), '{_B}der[\s\p{{Z}}._-]*un|@les') AS strong,
 regexp_matches(lower(text), '{_B}les{SP}+que{_E}|{_B}des{SP}+les{_E}') AS homonym,
 regexp_matches(lower(text), '{_B}(pour|avec|dans|est){_E}') AS context,
 contains(lower(text), 'les ') OR contains(lower(text), 'der ') AS alias FROM documents)"""


@query("brand_gates", f"""WITH {GATE} SELECT doc_id, word, word OR handle AS on_brand, alias,
 CASE WHEN strong THEN true WHEN NOT word THEN false WHEN homonym THEN false ELSE context END AS three_tier,
 CASE WHEN strong THEN true WHEN homonym THEN false WHEN source IN ('src1', 'src2') THEN true ELSE word AND context END AS tagged FROM gt""")
def _(spark, sf):
    t = F.col("text")
    return A.table(spark, sf, "documents").select(
        "doc_id", gates.brand_word(t, TEXT_BRAND).alias("word"), gates.on_brand(t, TEXT_BRAND).alias("on_brand"),
        gates.mentions_alias(t, TEXT_BRAND).alias("alias"), gates.three_tier(t, TEXT_BRAND).alias("three_tier"),
        gates.tagged(t, F.array(F.concat(F.lit("#"), F.col("source"))), TEXT_BRAND).alias("tagged"))


@query("thread_density_gate", rf"""WITH c AS (SELECT *, regexp_matches(lower(text), '{_B}les{_E}') AS named FROM conversations),
 t AS (SELECT conv_id, count(*) FILTER (named) AS k, count(*) AS n FROM c GROUP BY conv_id)
SELECT conv_id, turn FROM c JOIN t USING (conv_id) WHERE named OR (k >= 3 AND k / n >= 0.30)""")
def _(spark, sf):
    from voxmart.sources.mappers import thread_gate
    return thread_gate(A.table(spark, sf, "conversations"), "conv_id", gates.brand_word(F.col("text"), TEXT_BRAND)).select("conv_id", "turn")


@query("reply_types", with_ctes("mentions") + """, p AS (SELECT source_id, CAST(substr(source_id, 4) AS BIGINT) % 6 AS k FROM mentions)
SELECT source_id, CASE k WHEN 0 THEN 'refund' WHEN 1 THEN 'escalated' WHEN 2 THEN 'apology' WHEN 3 THEN 'info' WHEN 4 THEN 'escalated'
 ELSE 'responded' END AS kind FROM p""")
def _(spark, sf):
    said = ("Amount CREDITED back, sorry", "Please send a DM, sorry", "We regret this", "Kindly share details", "the admin will see", "Thanks")
    k = F.expr("CAST(substring(source_id, 4) AS BIGINT) % 6")
    line = F.element_at(F.array(*[F.lit(s) for s in said]), (k + 1).cast("int"))
    return base(spark, sf).select("source_id", labels.reply_type(line).alias("kind"))


@query("influence_tiers", with_ctes("mentions") + """SELECT source_id, CASE WHEN coalesce(view_count, 0) >= 10000 THEN 'macro'
 WHEN coalesce(view_count, 0) >= 1000 THEN 'mid' WHEN coalesce(view_count, 0) >= 100 THEN 'micro' ELSE 'nano' END AS tier,
 CASE WHEN score >= 0.15 THEN 'positive' WHEN score <= -0.15 THEN 'negative' ELSE 'neutral' END AS stance FROM mentions""")
def _(spark, sf):
    return base(spark, sf).select("source_id", labels.influence_tier(F.col("view_count")).alias("tier"),
                                  labels.stance(F.col("score")).alias("stance"))


# ---------------------------------------------------------------- sentiment
# A lexicon drawn from the benchmark's own words: the valence follows the word's length.
LEX = r"""lw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}'']+')) AS term FROM benchmark),
 lex AS (SELECT term, CAST(length(term) % 9 - 4 AS DOUBLE) / 2 AS valence FROM lw WHERE length(term) >= 3)"""


def lexicon(spark, sf):
    words = A.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(f"({scoring.WORD})"), F.lit(1))).alias("term")).distinct()
    return words.filter(F.length("term") >= 3).select("term", ((F.length("term") % 9 - 4).cast("double") / 2).alias("valence"))


_list = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
SCORES = rf"""ws AS (SELECT source_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']+') AS w,
  least(len(regexp_extract_all(text, '!')), 4) * 292 * 1000 AS bangs FROM posts),
 tk AS (SELECT source_id, w[i] AS term, coalesce(w[i-1] IN {_list(scoring.BOOSTERS)} AND i > 1, false) AS up,
  coalesce(w[i-1] IN {_list(scoring.DAMPENERS)} AND i > 1, false) AS down,
  coalesce(i > 1 AND w[i-1] IN {_list(scoring.NEGATIONS)}, false) OR coalesce(i > 2 AND w[i-2] IN {_list(scoring.NEGATIONS)}, false)
  OR coalesce(i > 3 AND w[i-3] IN {_list(scoring.NEGATIONS)}, false) AS neg FROM (SELECT source_id, w, unnest(range(1, len(w) + 1)) AS i FROM ws)),
 sm AS (SELECT source_id, sum(CASE WHEN neg THEN r * -740 ELSE r * 1000 END) AS micro FROM (SELECT source_id, neg, v + CASE WHEN up THEN sign(v) * 293
  WHEN down THEN -sign(v) * 293 ELSE 0 END AS r FROM (SELECT tk.*, CAST(round(valence * 1000) AS BIGINT) AS v FROM tk JOIN lex USING (term))) GROUP BY 1),
 sc AS (SELECT source_id, (coalesce(micro, 0) + sign(coalesce(micro, 0)) * bangs) / 1e6::DOUBLE AS e FROM ws LEFT JOIN sm USING (source_id)),
 scores AS (SELECT source_id, round(e / sqrt(e * e + 15.0::DOUBLE), 3) + 0.0 AS score FROM sc)"""


@query("lexicon_sentiment", with_ctes("posts") + f", {LEX}, {SCORES} SELECT source_id, score, CASE WHEN score >= 0.05 THEN 'positive' "
       "WHEN score <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment FROM scores")
def _(spark, sf):
    out = scoring.lexicon_scores(docs(spark, sf), lexicon(spark, sf))
    return out.withColumn("sentiment", scoring.tone(F.col("score")))


def baseline(spark, sf):
    posts = docs(spark, sf)
    return scoring.baseline_rows(posts, scoring.lexicon_scores(posts, lexicon(spark, sf)))


_has = lambda ws: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + ")"
BASE = f"""bl AS (SELECT source_id, score, CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment,
 {_has(scoring.RISK_WORDS)} AS risky, {_has(scoring.FRAUD_WORDS)} AS fraud FROM scores JOIN posts USING (source_id)),
 br AS (SELECT source_id, sentiment, CASE WHEN sentiment = 'positive' THEN 'joy' WHEN sentiment = 'negative' AND risky THEN 'anger' ELSE 'neutral' END AS emotion,
 CASE WHEN sentiment = 'negative' THEN 3 ELSE 2 END AS emotion_intensity, CASE sentiment WHEN 'positive' THEN 'praise' WHEN 'negative' THEN 'complaint'
 ELSE 'other' END AS intent, CASE WHEN sentiment = 'negative' THEN CASE WHEN risky THEN 'high' ELSE 'medium' END ELSE 'low' END AS urgency,
 CASE WHEN fraud THEN 1 ELSE 0 END AS fraud_signal, CASE WHEN fraud THEN 'suspected' ELSE 'none' END AS fraud_type FROM bl)"""


@query("baseline_analysis", with_ctes("posts") + f", {LEX}, {SCORES}, {BASE} SELECT * FROM br")
def _(spark, sf):
    return baseline(spark, sf).select("source_id", "sentiment", "emotion", "emotion_intensity", "intent", "urgency", "fraud_signal", "fraud_type")


@query("needs_depth", with_ctes("posts") + f", {LEX}, {SCORES}, {BASE} SELECT source_id, sentiment FROM br WHERE sentiment <> 'positive'")
def _(spark, sf):
    return scoring.needs_depth(baseline(spark, sf)).select("source_id", "sentiment")


@query("depth_split", with_ctes("mentions") + "SELECT CASE WHEN sentiment = 'positive' THEN 'light' ELSE 'deep' END AS part, count(*) AS n FROM mentions GROUP BY 1")
def _(spark, sf):
    light, deep = scoring.split_by_depth(base(spark, sf))
    tally = lambda d, n: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n")
    return tally(light, "light").unionByName(tally(deep, "deep")).filter("n > 0")


@query("model_output_coercion", """SELECT 'm' || event_id AS source_id, CASE event_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'mixed' END AS sentiment,
 CASE WHEN event_id % 2 = 0 THEN 'critical' ELSE 'low' END AS urgency, least(greatest(CAST(event_id % 7 - 3 AS DOUBLE), -1.0), 1.0) AS score,
 CASE WHEN event_id % 5 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS fraud_signal,
 CASE WHEN event_id % 2 = 0 THEN 'cards' ELSE 'other' END AS aspect, 'unspecified' AS product FROM events""")
def _(spark, sf):
    e = F.col("event_id")
    item = F.to_json(F.struct(
        F.when(e % 2 == 0, F.concat(F.lit("m"), e.cast("string"))).alias("source_id"),
        F.when(e % 3 == 0, "negative").when(e % 3 == 1, "furious").otherwise("mixed").alias("sentiment"),
        F.when(e % 2 == 0, "critical").alias("urgency"), (e % 7 - 3).cast("string").alias("score"),
        F.when(e % 5 == 0, F.lit("high")).otherwise("3.5").alias("confidence"), (e % 4 == 0).alias("fraud_signal"),
        F.array(F.struct(F.when(e % 2 == 0, "cards").otherwise("hats").alias("aspect"), F.lit("negative").alias("sentiment"))).alias("aspects")))
    # Records arrive bare, in a list, under a known key, or fenced; ids only on half of them.
    shape = (F.when(e % 4 == 0, item).when(e % 4 == 1, F.concat(F.lit("["), item, F.lit("]")))
             .when(e % 4 == 2, F.concat(F.lit('{"results": ['), item, F.lit("]}")))
             .otherwise(F.concat(F.lit("```json\n["), item, F.lit("]\n```"))))
    answers = A.table(spark, sf, "events").select(shape.alias("output"), F.array(F.concat(F.lit("m"), e.cast("string"))).alias("ids"))
    return scoring.coerce_outputs(answers).select(
        "source_id", "sentiment", "urgency", "score", "confidence", "fraud_signal", F.col("aspects")[0]["aspect"].alias("aspect"), "product")


@query("depth_merge", with_ctes("mentions") + """SELECT source_id, CASE WHEN lang = 'hi' THEN 'mixed' ELSE sentiment END AS sentiment,
 CASE WHEN lang = 'hi' THEN -0.5::DOUBLE ELSE score END AS score, CASE WHEN lang = 'hi' THEN 'big-model' ELSE model END AS model,
 CASE WHEN lang = 'hi' AND fraud_signal = 1 THEN 1 ELSE pii_present END AS pii_present FROM mentions""")
def _(spark, sf):
    m = base(spark, sf).select("source_id", "sentiment", "score", "model", "pii_present", "lang", "fraud_signal")
    deep = m.filter("lang = 'hi'").select("source_id", F.lit("mixed").alias("sentiment"), F.lit(-0.5).alias("score"),
                                          F.col("fraud_signal").alias("pii_present"))
    return scoring.merge_depth(m.drop("lang", "fraud_signal"), deep, "big-model")


@query("fraud_verdicts", with_ctes("mentions") + """SELECT source_id, CASE WHEN (fraud_signal = 1 OR urgency = 'critical') AND source = 'twitter'
 THEN 0 ELSE fraud_signal END AS fraud_signal FROM mentions""")
def _(spark, sf):
    m = base(spark, sf).select("source_id", "urgency", "fraud_signal", "source")
    return scoring.apply_verdicts(m, m.filter("source = 'twitter'").select("source_id", F.lit(0).alias("fraud_signal"))).select(
        "source_id", "fraud_signal")


# ---------------------------------------------------------------- categories
# One sentence per rule, chosen by the event's number; the oracle names the rule it must hit.
SENTENCES = (
    ("this is a scam do not click", "scam", "text matches scam/impersonation"),
    ("amount debited without my knowledge", "fraud", "text matches fraud/unauthorised"),
    ("the share price fell again", "market_news", "text matches market/investor coverage"),
    ("i worked at acme for years", "employee", "first-person employment at the brand"),
    ("the notice period at good old acme is long", "employee", "first-person employment at the brand"),
    ("the format of the queue is odd", "branch", "text or aspect matches branch/ATM"),
    ("still waiting for someone", "response_gap", "text matches no-response/waiting"),
    ("app crashes daily", "technical_issue", "text matches technical failure"),
    ("they missold me a policy", "mis_selling", "text matches mis-selling"),
    ("hidden charges everywhere", "charges_dispute", "text matches charges/fees"),
    ("my refund is delayed", "service_delay", "text matches delay/pending"),
    ("a scamper through formats", "other", "no rule matched"),
)
_RULES = "r(k, cat, why) AS (VALUES " + ", ".join(f"({i}, '{c}', '{w}')" for i, (_t, c, w) in enumerate(SENTENCES)) + ")"


@query("issue_category", with_ctes("mentions") + f""", {_RULES}, n AS (SELECT source_id, intent, fraud_type, fraud_signal,
  CAST(substr(source_id, 4) AS BIGINT) AS id FROM mentions), j AS (SELECT n.*, cat, why, id % 17 = 16 AS cards FROM n JOIN r ON k = id % 12)
SELECT source_id, CASE WHEN id % 13 = 12 THEN 'branch' WHEN fraud_type IN ('phishing', 'impersonation') THEN 'scam' WHEN cat = 'scam' THEN 'scam'
  WHEN intent = 'fraud_report' OR fraud_signal = 1 THEN 'fraud' WHEN cat = 'market_news' AND intent IN ('complaint', 'churn_threat') THEN
  CASE WHEN cards THEN 'technical_issue' ELSE 'other' END
  WHEN cat = 'other' THEN CASE WHEN cards THEN 'technical_issue' WHEN intent = 'praise' THEN 'praise' ELSE 'other' END ELSE cat END AS issue_category,
 CASE WHEN id % 13 = 12 THEN 'source=gmaps' WHEN fraud_type IN ('phishing', 'impersonation') THEN 'fraud_type=' || fraud_type WHEN cat = 'scam' THEN why
  WHEN intent = 'fraud_report' OR fraud_signal = 1 THEN 'intent=fraud_report or fraud_signal set'
  WHEN cat = 'market_news' AND intent IN ('complaint', 'churn_threat') THEN CASE WHEN cards THEN 'aspect=mobile_app' ELSE 'no rule matched' END
  WHEN cat = 'other' THEN CASE WHEN cards THEN 'aspect=mobile_app' WHEN intent = 'praise' THEN 'intent=praise' ELSE why END ELSE why END AS category_reason FROM j""")
def _(spark, sf):
    return categories.categorise(sentence_posts(spark, sf)).select("source_id", "issue_category", "category_reason")


def sentence_posts(spark, sf):
    n = F.expr("CAST(substring(source_id, 4) AS BIGINT)")
    line = F.element_at(F.array(*[F.lit(s) for s, _c, _w in SENTENCES]), (n % 12 + 1).cast("int"))
    aspects = F.when(n % 17 == 16, F.array(F.lit("loans"), F.lit("mobile_app"))).otherwise(F.array())
    return base(spark, sf).withColumns({
        "text": F.when(n % 2 == 0, line), "text_masked": F.when(n % 2 == 1, line).otherwise(""),
        "source": F.when(n % 13 == 12, "gmaps").otherwise(F.col("source")), "aspect_list": aspects}).drop("issue_category")


@query("category_documents", rf"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '{_B}(branch|atm|cdm|passbook|teller|queue|counter|locker){_E}') THEN 'branch'
 WHEN regexp_matches(t, '{_B}(error|bug|maintenance|glitch|timeout|downtime){_E}') THEN 'technical_issue'
 WHEN regexp_matches(t, '{_B}(charge[sd]?|fees?|amc|mab){_E}') THEN 'charges_dispute' WHEN regexp_matches(t, '{_B}pending{_E}') THEN 'service_delay'
 ELSE 'other' END AS issue_category FROM d""")
def _(spark, sf):
    rows = A.table(spark, sf, "documents").withColumns({c: F.lit(None).cast("string") for c in ("text_masked", "intent", "fraud_type")})
    rows = rows.withColumns({"fraud_signal": F.lit(0), "aspect_list": F.expr("cast(array() as array<string>)")})
    return categories.categorise(rows).select("doc_id", "issue_category")


@query("category_relabel", with_ctes("mentions") + """SELECT CASE WHEN issue_category IS NULL THEN CASE WHEN intent = 'fraud_report' OR fraud_signal = 1
 THEN CASE WHEN fraud_type IN ('phishing', 'impersonation') THEN 'scam' ELSE 'fraud' END WHEN contains(text, 'error') THEN 'technical_issue' WHEN intent = 'praise'
 THEN 'praise' ELSE 'other' END ELSE issue_category END AS issue_category, count(*) AS posts FROM mentions GROUP BY 1""")
def _(spark, sf):
    rows = base(spark, sf).withColumns({"aspect_list": F.expr("cast(array() as array<string>)"), "category_reason": F.lit(None).cast("string"),
                                        "text_masked": F.lit("")})
    return categories.category_counts(categories.relabel(rows))


@query("aspect_shapes", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'cards,loans' WHEN 1 THEN 'cards' WHEN 2 THEN 'mobile_app' WHEN 3 THEN 'loans'
 WHEN 6 THEN 'upi_payments' ELSE '' END AS names FROM events""")
def _(spark, sf):
    shapes = ('[{"aspect":"cards","sentiment":"negative"},{"name":"loans"}]', '{"aspect":"cards"}', '"mobile_app"', '[{"aspect":"","name":"loans"}]',
              "not json", "[]", '["upi_payments"]')
    raw = F.element_at(F.array(*[F.lit(s) for s in shapes]), (F.col("event_id") % 7 + 1).cast("int"))
    return A.table(spark, sf, "events").select("event_id", F.array_join(categories.aspect_names(raw), ",").alias("names"))
