"""Text normalisation, language, spam and id columns (all JVM-side).

Patterns use ``(?U)`` because the metric definitions count words, digits and white space of
every script, not only ASCII.
"""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmart.config import THRESHOLDS

# Patterns and word lists of the text rules.
# White space of every script as one explicit class: much faster than a Unicode-aware \\s.
BLANK = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
URL = rf"https?://[^{BLANK}]+"
RETWEET_PREFIX = r"(?U)^[\s\x1c-\x1f]*RT\b[:,]?"
WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
         "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
ZERO_WIDTH = "[\u200b\ufeff]"
HASH_DROP = "[^a-z0-9\u0900-\u097f ]+"
DEVANAGARI = "[\u0900-\u097f]"
EMOJI = "[\\x{1F000}-\\x{1FAFF}\u2600-\u27bf]"
LONG_REPEAT = r"(.)\1{6,}"
HINGLISH = ("hai", "nahi", "nahin", "kar", "karo", "kyun", "kyu", "mera", "meri", "paisa",
            "paise", "atak", "raha", "rahi", "ho", "kaise", "bhai", "yaar", "kab", "chal")
PROMO = ("subscribe", "giveaway", "buy now", "limited offer", "click here", "join now",
         "t.me/", "whatsapp +", "dm for", "promo code", "earn money", "free recharge")
HTML_TAG = r"<[^>]+>"
# Named character references of HTML 4, as the standard library lists them.
ENTITIES = {f"&{name};": chr(code) for name, code in {**name2codepoint, "apos": 39}.items()}


def contains_any(text: Column, needles) -> Column:
    """Literal substring test against a short list, as one OR chain."""
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    # Line feeds are the usual white space besides blanks, and a literal replacement is cheap; the pattern is for what is left.
    lines = F.replace(text, F.lit("\n"), F.lit(" "))
    rest = "  |[" + BLANK.replace("\\x1c- ", "\\x1c-\\x1f") + "]"
    return F.trim(F.when(lines.rlike(rest), F.regexp_replace(lines, f"[{BLANK}]+", " ")).otherwise(lines))


def strip_edges(text: Column) -> Column:
    """Trim white space of every kind from both ends, keeping the inside."""
    return F.trim(text, F.lit(WHITE))


def blank_to_null(text: Column) -> Column:
    return F.when(strip_edges(text) != "", text)


def url_count(text: Column) -> Column:
    return F.when(text.contains("://"), F.regexp_count(text, F.lit(URL))).otherwise(0)


def clean_text(text: Column) -> Column:
    """Text without links, retweet prefix and zero-width marks, white space collapsed."""
    raw = F.coalesce(text, F.lit(""))
    t = F.when(raw.contains("://"), F.regexp_replace(raw, URL, "")).otherwise(raw)
    t = F.regexp_replace(t, RETWEET_PREFIX, "")
    for mark in ZERO_WIDTH:
        t = F.replace(t, F.lit(mark), F.lit(""))
    return squeeze(t)


def dedup_key(cleaned: Column) -> Column:
    """md5 of the lower-cased letters, digits and blanks (blanks are not collapsed again)."""
    return F.md5(F.regexp_replace(F.lower(cleaned), HASH_DROP, ""))


def detect_language(cleaned: Column) -> Column:
    # Only the listed words are pulled out, as whole runs of a-z. The character before one is part of the match: where there is
    # none, the search goes on at once, without trying the words.
    listed = "(?:^|[^a-z])(" + "|".join(HINGLISH) + ")(?![a-z])"
    hinglish = F.size(F.array_distinct(F.regexp_extract_all(F.lower(cleaned), F.lit(listed), F.lit(1))))
    return F.when(_beyond_latin(cleaned) & cleaned.rlike(DEVANAGARI), "hi").when(hinglish >= 2, "hi-en").otherwise("en")


def _beyond_latin(text: Column) -> Column:
    """False for texts whose characters take two bytes at most, as all below U+0800 do. Cheap, and rules nearly all texts out
    before their characters are looked at."""
    return F.octet_length(text) > F.length(text) + F.length(F.regexp_replace(text, "[\\x00-\\x7f]+", ""))


def spam_flag(cleaned: Column, n_urls: Column) -> Column:
    spam = ((n_urls >= 3) | contains_any(F.lower(cleaned), PROMO)
            | (_beyond_latin(cleaned) & (F.regexp_count(cleaned, F.lit(EMOJI)) >= 6)) | cleaned.rlike(LONG_REPEAT))
    return F.when(spam, 1).otherwise(0)


def has_min_content(text: Column, minimum: int = THRESHOLDS.comment_min_word_chars) -> Column:
    """True when at least ``minimum`` letters or digits are left without punctuation."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")) >= minimum


def normalise_handle(handle: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(handle, F.lit("")), "^@+", ""))


def at_handle(handle: Column) -> Column:
    """``name`` -> ``@name``; empty stays empty."""
    return F.when(blank_to_null(handle).isNull(), F.lit("")).otherwise(
        F.concat(F.lit("@"), F.regexp_replace(handle, "^@+", "")))


def stable_id(prefix: str, *parts: Column, length: int = 12, algorithm: str = "md5") -> Column:
    """``prefix:`` + digest of the non-empty parts joined by a bar, truncated."""
    joined = F.concat_ws("|", *[F.when(p != "", p) for p in parts])
    digest = {"md5": F.md5, "sha1": F.sha1}[algorithm](joined.cast("binary"))
    return F.concat(F.lit(prefix), F.substring(digest, 1, length))


def content_fingerprint(text: Column) -> Column:
    """First 16 hex digits of sha256 over the lower-cased, squeezed text (blocklist key)."""
    return F.substring(F.sha2(squeeze(F.lower(F.coalesce(text, F.lit("")))), 256), 1, 16)


def unescape_html(text: Column) -> Column:
    """Decode named, decimal and hexadecimal character references.

    References are split off once and mapped one by one, so ``&amp;lt;`` yields ``&lt;``.
    """
    ref = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);"
    # Folded into one constant map when planned; a map read from JSON would be read again for every reference.
    named = F.map_from_arrays(*[F.split(F.lit("\x01".join(x)), "\x01") for x in (ENTITIES.keys(), ENTITIES.values())])

    def decode(mark: Column) -> Column:
        digits = F.regexp_extract(mark, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(mark.rlike("^&#[xX]"), digits).otherwise(F.conv(digits, 10, 16))
        point = F.conv(code, 16, 10).cast("bigint")
        # Valid code points only; surrogates have no character of their own.
        valid = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.when(~mark.startswith("&#"), F.coalesce(F.element_at(named, mark), mark)).when(
            valid, char).otherwise(mark)

    between = F.split(text, ref, -1)
    refs = F.regexp_extract_all(text, F.lit(f"({ref})"), F.lit(1))
    return F.when(text.contains("&"), F.array_join(
        F.zip_with(between, F.concat(F.transform(refs, decode), F.array(F.lit(""))),
                   lambda gap, mark: F.concat(gap, F.coalesce(mark, F.lit("")))), "")).otherwise(text)


def html_to_text(markup: Column, tag_becomes: str = " ") -> Column:
    """Tags dropped, references decoded, white space collapsed."""
    return squeeze(unescape_html(F.regexp_replace(F.coalesce(markup, F.lit("")), HTML_TAG, tag_becomes)))


def page_to_text(html: Column) -> Column:
    """Readable text of a whole page: script, style and comments go before the tags."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")),
                            r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", " ")
    return html_to_text(body)
