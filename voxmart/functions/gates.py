"""Is this post about the brand? Gates are regular expressions built from the brand's config."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmart.config import BRAND, Brand
from voxmart.functions.text import contains_any


def _any(alternatives) -> str:
    return "(?iU)" + "|".join(f"(?:{a})" for a in alternatives)


def _safe(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def brand_word(text: Column, brand: Brand = BRAND) -> Column:
    """The floor: the bare word between word boundaries."""
    return _safe(text).rlike(rf"(?iU)\b{re.escape(brand.word)}\b")


def brand_handle(text: Column, brand: Brand = BRAND) -> Column:
    """Handle, hashtag or compound: @acme…, #acme…, acme bank."""
    w = re.escape(brand.word)
    return _safe(text).rlike(rf"(?iU)[@#]{w}\w*|\b{w}\s*bank\b")


def on_brand(text: Column, brand: Brand = BRAND) -> Column:
    return brand_word(text, brand) | brand_handle(text, brand)


def three_tier(text: Column, brand: Brand = BRAND) -> Column:
    """Strong form wins; otherwise the word is needed, homonyms veto, context decides."""
    t = _safe(text)
    return (F.when(t.rlike(_any(brand.strong)), True)
            .when(~brand_word(t, brand), False)
            .when(t.rlike(_any(brand.homonyms)), False)
            .otherwise(t.rlike(_any(brand.context))))


def tagged(text: Column, tags: Column, brand: Brand = BRAND) -> Column:
    """As ``three_tier``, but a brand hashtag also counts once homonyms are excluded."""
    t = _safe(text)
    norm = F.transform(F.coalesce(tags, F.expr("cast(array() as array<string>)")),
                       lambda x: F.lower(F.regexp_replace(x, "^#+", "")))
    return (F.when(t.rlike(_any(brand.strong)), True)
            .when(t.rlike(_any(brand.homonyms)), False)
            .when(F.arrays_overlap(norm, F.array(*[F.lit(x) for x in brand.tags])), True)
            .otherwise(brand_word(t, brand) & t.rlike(_any(brand.context))))


def mentions_alias(text: Column, brand: Brand = BRAND) -> Column:
    return contains_any(F.lower(_safe(text)), [a.lower() for a in brand.aliases])


def is_service_account(handle: Column, name: Column | None = None, brand: Brand = BRAND) -> Column:
    """The brand's own account, by normalised handle (and by display name where given)."""
    from voxmart.functions.text import normalise_handle

    own = normalise_handle(handle).isin(*brand.service_handles)
    if name is not None and brand.service_names:
        own = own | F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(*[n.lower() for n in brand.service_names])
    return own
