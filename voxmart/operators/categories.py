"""Issue category and the reason it was given, by one ordered rule table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmart.config import BRAND, Brand

# Category -> label.
CATEGORY_LABELS = {
    "scam": "Scam / impersonation", "fraud": "Fraud / unauthorised debit",
    "employee": "Employee & workplace", "branch": "Branch & ATM", "response_gap": "Response gap",
    "technical_issue": "Technical issue", "charges_dispute": "Charges & fees",
    "mis_selling": "Mis-selling", "service_delay": "Service delay",
    "market_news": "Market & investor news", "praise": "Praise", "other": "Other",
}
# Word patterns per topic, matched between word boundaries, case ignored.
TOPIC_PATTERNS = {
    "scam": ("scam", r"scamm?er", r"impersonat\w*", r"phish\w*", "fake (call|sms|link|app|site)",
             "fraud ?call", "lottery", r"kyc (update|expir\w+) (link|sms)", "otp share"),
    "fraud": ("fraud", "unauthoris?zed", "unauthorised", "debited without", "money (stolen|deducted)",
              "cyber ?crime", "chargeback", r"siphon\w*", "hacked"),
    "market_news": ("target price", "brokerage", "buy|sell|hold rating", "q[1-4] result", "net profit",
                    "nifty", "sensex", "share price", "stock[s]?", "market cap", "earnings", "analyst",
                    "bse|nse", "shareholder", "dividend"),
    "branch": ("branch", "atm", "cash ?deposit machine", "cdm", "passbook", "teller", "queue", "counter",
               "locker"),
    "response_gap": ("no (response|reply|revert|update|resolution)", "still waiting",
                     "no one (called|responded)", r"day \d+", "days? (now|later)", "follow ?up",
                     "ticket .{0,12}(open|pending|unresolved)", r"nobody (is )?respond\w*",
                     "worst (service|support)"),
    "technical_issue": (r"app (crash\w*|not working|down|stuck|hang\w*|freez\w*)",
                        "server (down|error|issue)", "not working", "error", "failed transaction",
                        r"login (issue|fail\w*|problem)", r"otp not (receiv\w+|com\w+)", "downtime",
                        "maintenance", "glitch", "bug", "timeout"),
    "mis_selling": ("mis ?sold", "mis ?selling", "forced", "without (my )?consent",
                    r"auto ?debit\w* insurance", "sold me", r"trick\w+ (me|into)", "did ?n.?t (ask|want)"),
    "charges_dispute": ("charge[sd]?", "fee[s]?", r"penalt\w+", r"deduct\w+ .{0,15}(charge|fee)", "amc",
                        "annual fee", "hidden (charge|cost)", "minimum balance", "mab"),
    "service_delay": (r"delay\w*", "pending", "not (yet )?(credited|disbursed|processed|received)",
                      "taking (too )?long", r"since \d+ (day|week|month)", "still not"),
}
# Who counts as an employee, how near the brand has to stand, what a source or an aspect alone decides, and the
# kinds of scam.
WORKPLACE = (r"(\bmy (?:appraisal|team ?lead|employer|workplace)\b"
             r"|\bwork[ -]?life balance\b|\btoxic (?:culture|workplace|management)\b"
             r"|\b(?:ex[- ]?)?employee of\b|\bworked (?:here|there)\b"
             r"|\bsalary (?:hike|revision)\b|\bappraisal cycle\b"
             r"|\bresigned from\b|\bnotice period\b|\bonboarding process\b"
             r"|\bhr (?:policy|team|department)\b)")
EMPLOYED_AT = r"\bi (?:work|worked|am working|was working|used to work)\s+(?:at|for|in|with)\s+(?:the\s+|@)?"
NEAR = 60
SOURCE_CATEGORY = {"ambitionbox": "employee", "gmaps": "branch"}
ASPECT_CATEGORY = {"branch_atm": "branch", "fraud_security": "fraud", "fees_charges": "charges_dispute",
                   "mobile_app": "technical_issue", "internet_banking": "technical_issue"}
SCAM_KINDS = ("impersonation", "phishing", "scam-report")
COMPLAINING = ("complaint", "fraud_report", "churn_threat", "legal_threat")


@dataclass(frozen=True)
class Rule:
    """``when`` decides; ``category`` and ``reason`` are what the post is then given."""

    when: Column
    category: Column | str
    reason: Column | str


def topic_pattern(topic: str) -> str:
    return r"(?iU)\b(" + "|".join(TOPIC_PATTERNS[topic]) + r")\b"


def workplace_pattern(brand: Brand = BRAND) -> str:
    """Workplace talk with the whole brand word at most ``NEAR`` characters away."""
    gap = f".{{0,{NEAR - len(brand.word)}}}"
    return rf"(?isU){EMPLOYED_AT}{brand.word}|{brand.word}{gap}{WORKPLACE}|{WORKPLACE}{gap}{brand.word}"


def aspect_names(raw: Column) -> Column:
    """Aspect names out of whatever shape was stored: list, object, bare string or junk."""
    s = F.trim(raw)
    items = F.from_json(F.when(s.startswith("["), s).otherwise(F.concat(F.lit("["), s, F.lit("]"))),
                        "array<string>")

    def name(item: Column) -> Column:
        pick = lambda key: F.nullif(F.get_json_object(item, f"$.{key}"), F.lit(""))
        return F.when(item.startswith("{"), F.coalesce(pick("aspect"), pick("name"))).otherwise(item)

    return F.coalesce(F.array_compact(F.transform(items, name)), F.expr("cast(array() as array<string>)"))


def rules(brand: Brand = BRAND) -> list[Rule]:
    """First match wins. Needs text_masked, text, intent, source, fraud_type, fraud_signal
    and ``aspect_list`` (array of names)."""
    text = F.coalesce(F.nullif(F.col("text_masked"), F.lit("")), F.col("text"), F.lit(""))
    intent, kind = F.coalesce("intent", F.lit("")), F.coalesce("fraud_type", F.lit(""))
    aspects = F.coalesce("aspect_list", F.expr("cast(array() as array<string>)"))
    says = lambda topic: text.rlike(topic_pattern(topic))
    known = F.get(F.filter(aspects, lambda a: a.isin(*ASPECT_CATEGORY)), 0)
    by_aspect = F.element_at(F.create_map(*[F.lit(v) for kv in ASPECT_CATEGORY.items() for v in kv]), known)
    table = [Rule(F.col("source") == s, c, f"source={s}") for s, c in SOURCE_CATEGORY.items()]
    table += [
        Rule(kind.isin(*SCAM_KINDS), "scam", F.concat(F.lit("fraud_type="), kind)),
        Rule(says("scam"), "scam", "text matches scam/impersonation"),
        Rule((intent == "fraud_report") | (F.col("fraud_signal") == 1), "fraud",
             "intent=fraud_report or fraud_signal set"),
        Rule(says("fraud"), "fraud", "text matches fraud/unauthorised"),
        Rule(says("market_news") & ~intent.isin(*COMPLAINING), "market_news",
             "text matches market/investor coverage"),
        Rule(text.rlike(workplace_pattern(brand)), "employee", "first-person employment at the brand"),
        Rule(says("branch") | F.array_contains(aspects, "branch_atm"), "branch",
             "text or aspect matches branch/ATM"),
        Rule(says("response_gap"), "response_gap", "text matches no-response/waiting"),
        Rule(says("technical_issue"), "technical_issue", "text matches technical failure"),
        Rule(says("mis_selling"), "mis_selling", "text matches mis-selling"),
        Rule(says("charges_dispute"), "charges_dispute", "text matches charges/fees"),
        Rule(says("service_delay"), "service_delay", "text matches delay/pending"),
        Rule(known.isNotNull(), by_aspect, F.concat(F.lit("aspect="), known)),
        Rule(intent == "praise", "praise", "intent=praise"),
    ]
    return table


def categorise(rows: DataFrame, brand: Brand = BRAND) -> DataFrame:
    """Add ``issue_category`` and ``category_reason``; both come out of one CASE expression."""
    def verdict(category, reason) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(as_col(category).alias("issue_category"), as_col(reason).alias("category_reason"))

    table = rules(brand)
    chain = reduce(lambda c, r: c.when(r.when, verdict(r.category, r.reason)), table[1:],
                   F.when(table[0].when, verdict(table[0].category, table[0].reason)))
    return (rows.withColumn("_verdict", chain.otherwise(verdict("other", "no rule matched")))
            .select(*[c for c in rows.columns if c not in ("issue_category", "category_reason")], "_verdict.*"))


def relabel(analysed: DataFrame, recompute: bool = False, brand: Brand = BRAND) -> DataFrame:
    """Label what has no category yet; ``recompute`` labels everything again."""
    if recompute or "issue_category" not in analysed.columns:
        return categorise(analysed, brand)
    fresh = categorise(analysed.filter(F.col("issue_category").isNull()), brand)
    return analysed.filter(F.col("issue_category").isNotNull()).unionByName(fresh)


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("issue_category").agg(F.count(F.lit(1)).alias("posts"))
