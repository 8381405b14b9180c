"""Column functions on small literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from voxmart.functions import dates, gates, labels, numbers, pii, text
from voxmart.operators import categories, cleaning


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,masked,kinds", [
    ("card 4111 1111 1111 1111 charged", "card XXXX-XXXX-XXXX-1111 charged", "card"),
    ("card 4111 1111 1111 1112", "card XXXXXXXXXXXX1112", "account"),
    ("pan ABCDE1234F", "pan [PAN]", "pan"), ("id 1234 5678 9012", "id XXXX-XXXX-9012", "aadhaar_or_account"),
    ("call 9876543210 or 9876543211", "call XXXXXXXX10 or XXXXXXXX11", "phone"),
    ("OTP is 123456, cvv: 123", "OTP [REDACTED], cvv [REDACTED]", "otp,cvv"),
    ("a.b@c-d.co and 123456789", "[EMAIL] and XXXXX6789", "email,account"),
    ("only 12345678 here", "only 12345678 here", ""), ("", "", ""), (None, "", ""),
])
def test_masking(spark, raw, masked, kinds):
    df = spark.createDataFrame([(raw,)], "text string")
    once = pii.masked_fields(df)
    row = once.first()
    assert (row["text_masked"], row["pii_types"], row["pii_present"]) == (masked, kinds, int(bool(kinds)))
    again = pii.mask_pii(once.select(F.col("text_masked").alias("t")), "t").first()
    assert again["text_masked"] == masked and again["pii_type_list"] == []


@pytest.mark.parametrize("raw,clean", [
    ("RT @a: see https://x.co/1  now​", "@a: see now"), ("  RT: hello\n\tworld ", "hello world"), ("ARTful RT", "ARTful RT"), (None, "")])
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, text.clean_text) == clean


def test_same_text_same_hash(spark):
    f = lambda c: text.dedup_key(text.clean_text(c))
    assert one(spark, "Hello, World! https://a.b", f) == one(spark, "hello world", f)


@pytest.mark.parametrize("raw,lang", [("नमस्ते", "hi"), ("paisa nahi mila", "hi-en"), ("paisa paisa", "en"), ("fine", "en")])
def test_language(spark, raw, lang):
    assert one(spark, raw, text.detect_language) == lang


@pytest.mark.parametrize("raw,when", [
    ("2026-07-01T10:00:00+05:30", "2026-07-01 04:30:00"), ("Mon, 29 Jun 2026 12:05:00 GMT", "2026-06-29 12:05:00"),
    ("Mon Aug 10 07:28:08 +0000 2026", "2026-08-10 07:28:08"), ("2026-07-02", "2026-07-02 00:00:00"), ("1751364000", "2025-07-01 10:00:00"),
    ("1751364000000", "2025-07-01 10:00:00"), ("20260805T123000Z", "2026-08-05 12:30:00"), ("Jul 3, 2026", "2026-07-03 00:00:00"),
    ("31 Feb 2026", None), ("not a date", None), ("", None), (None, None)])
def test_dates(spark, raw, when):
    got = one(spark, raw, lambda c: F.date_format(dates.parse_datetime(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == when


def test_relative_and_encoded_dates(spark):
    now = F.lit("2026-07-01 10:00:30").cast("timestamp")
    s = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    assert one(spark, "17 hrs 27 mins ago", lambda c: s(dates.ago(c, now))) == "2026-06-30 16:33"
    assert one(spark, "a month ago", lambda c: s(dates.ago(c, now))) == "2026-06-01 10:00"
    assert one(spark, "2 days ago, a year ago", lambda c: s(dates.ago(c, now, first_only=True))) == "2026-06-29 10:00"
    assert one(spark, "126072100140", lambda c: s(dates.date_from_story_id(c, now))) == "2026-07-21 00:00"
    assert one(spark, "129932100140", lambda c: s(dates.date_from_story_id(c, now))) is None
    assert one(spark, "21 Jul 2026 | 11:13 AM IST", lambda c: s(dates.stamp_to_utc(c))) == "2026-07-21 05:43"


@pytest.mark.parametrize("raw,n", [("1.2K", 1200), ("3M", 3000000), ("1,234", 1234), ("", 0), ("many", 0)])
def test_magnitudes(spark, raw, n):
    assert one(spark, raw, numbers.magnitude) == n


def test_html(spark):
    assert one(spark, "<p>it&#x27;s &amp;lt; &#8377;5 &middot; &nope; </p>", text.html_to_text) == "it's &lt; ₹5 · &nope;"


@pytest.mark.parametrize("said,ok", [
    ("AcmeBank rocks", True), ("my acme card", True), ("acme rockets and my card", False), ("acme everywhere", False), ("no brand bank", False)])
def test_three_tiers(spark, said, ok):
    assert one(spark, said, gates.three_tier) is ok


@pytest.mark.parametrize("said,kind", [("your refund is done", "refund"), ("Please DM us", "escalated"), ("so sorry", "apology"),
                                       ("happy to assist", "info"), ("hello", "responded"), (None, "responded")])
def test_reply_types(spark, said, kind):
    assert one(spark, said, labels.reply_type) == kind


BASE = dict(text="", text_masked="", source="twitter", intent="complaint", fraud_type="none", fraud_signal=0, aspect_list=[])


@pytest.mark.parametrize("changes,category", [
    (dict(text="the format changed"), "other"), (dict(text="the atm ate it"), "branch"), (dict(text="staff was rude"), "other"),
    (dict(text="I work at Infosys, can I get an acme card?"), "other"), (dict(text="I worked at Acme"), "employee"),
    (dict(text="my appraisal " + "x" * 70 + " acme"), "other"), (dict(source="ambitionbox", text="app crashes"), "employee"),
    (dict(text="nifty falls", intent="other"), "market_news"), (dict(text="nifty falls"), "other"),
    (dict(text="phishing sms"), "scam"), (dict(text="ok", fraud_signal=1), "fraud"), (dict(text="bad", aspect_list=["fees_charges"]), "charges_dispute"),
    (dict(text="nice", intent="praise"), "praise"), (dict(text="scam", text_masked="branch"), "branch")])
def test_categories(spark, changes, category):
    row = {**BASE, **changes}
    schema = ("text string, text_masked string, source string, intent string, fraud_type string, fraud_signal int, "
              "aspect_list array<string>")
    got = categories.categorise(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert got["issue_category"] == category and got["category_reason"]


def test_earliest_dated_copy_is_canonical(spark):
    d = dt.datetime
    rows = [("a", "Same text", None), ("b", "same text!", d(2026, 7, 2)), ("c", "SAME TEXT", d(2026, 7, 1)), ("d", "other", None)]
    posts = spark.createDataFrame(rows, "source_id string, text string, created_at timestamp")
    got = {r["source_id"]: r["is_duplicate"] for r in cleaning.transform_posts(posts).collect()}
    assert got == {"a": 1, "b": 1, "c": 0, "d": 0}
    stored = cleaning.transform_posts(posts.filter("source_id = 'c'"))
    later = {r["source_id"]: r["is_duplicate"] for r in cleaning.transform_posts(posts, stored).collect()}
    assert later == {"a": 1, "b": 1, "d": 0}
