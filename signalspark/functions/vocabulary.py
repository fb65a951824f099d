"""Fixed values of signal extraction: the words, phrases and number forms that mark a signal.

They must match word for word for a signal to come out the same, so each list is kept whole and in
its natural order. Phrases are regular expressions without groups; ``any_of`` joins them.
"""

from __future__ import annotations

import re

# The version of the rules, and the windows and reaches, in characters.
VERSION = "1.4.2"
HERO_WINDOW, PLAIN_WINDOW, LOGO_WINDOW, SUBHEAD_REACH, ANCHOR_REACH = 120_000, 300_000, 14_000, 6_000, 2_500

# Headings that are no headline, and texts that are no subhead.
HEADLINE_JUNK = ("home", "menu", "navigation", "skip to (?:main )?content", "search", "log ?in", "sign ?up", "cookie", "welcome")
SUBHEAD_JUNK = ("by (?:clicking|signing)", "we use cookies", "terms", "privacy")
HIDDEN_CLASS = ("sr-only", "sronly", "visually-?hidden", "screen-?reader(?:-only)?", "a11y-only", "hidden")

# Nouns that name a category (the first that fits wins), words that end a noun phrase,
# and nouns that say nothing alone.
CATEGORY_PHRASES = (
    "customer data platform", "customer engagement platform", "revenue intelligence platform", "developer experience platform",
    "application development platform", "system of record", "system of action", "source of truth", "operating system", "command center",
    "command centre", "control plane", "data warehouse", "data cloud", "knowledge base", "design tool", "work management platform",
    "single source of truth", "connected workspace", "all-in-one platform", "developer platform", "data platform", "automation platform",
    "engagement platform", "intelligence platform", "collaboration platform", "lakehouse", "warehouse", "infrastructure", "marketplace",
    "workspace", "framework", "helpdesk", "copilot", "assistant", "teammate", "notebook", "directory", "dashboard", "automation", "toolkit",
    "platform", "database", "registry", "planner", "tracker", "whiteboard", "workbench", "repository", "pipeline", "gateway", "runtime",
    "sandbox", "canvas", "studio", "console", "ledger", "cloud", "graph", "mesh", "fabric", "desk", "browser", "builder", "network",
    "service", "software", "solution", "suite", "system", "engine", "editor", "inbox", "layer", "stack", "agent", "agents", "tool", "tools",
    "app", "apps", "hub", "os", "wiki", "crm", "erp", "cdp", "cms", "ide", "api", "sdk",
)
PHRASE_ENDS = frozenset(
    "the a an your our their its my this that these those is are was be been and or but with without from to of in on at by for as "
    "into onto we you they it build built meet introducing welcome get try use using".split()
)
WEAK_ALONE = frozenset(
    "agent agents tool tools app apps software solution service system suite engine layer stack hub network framework builder editor "
    "inbox api sdk os automation".split()
)

# What introduces a wall of customer logos, and what an image name is when it names no company.
LOGO_LEADS = (
    "trusted by", "powering", "used by", "loved by", r"join(?:ed by)?\s+(?:over\s+)?[\d,]+", "our customers", "customers include",
    "companies (?:that|of all)", "built for teams at", "works with", "the best teams", "teams at", "from startups to", "backed by",
)
LOGO_MARKS = ("logo", "customer", "client", "partner", "brand")
NO_COMPANY = frozenset(
    "icon icons arrow arrows star stars chevron check checkmark close menu hamburger search avatar avatars placeholder image img photo "
    "picture hero background bg banner screenshot illustration pattern shape blob gradient divider quote quotes play pause video thumbnail "
    "thumb header footer nav card logo logos logotype brand brands customer customers client clients partner partners company companies "
    "wordmark mark symbol graphic asset sprite spacer pixel dot line grid blur light dark white black grey gray color colour mono default "
    "undefined null untitled group frame vector union ellipse rectangle path layer mask clip fill stroke desktop mobile tablet small "
    "medium large new old temp".split()
)
NO_COMPANY_WORDS = frozenset(
    "hero background banner icon arrow screenshot illustration placeholder avatar thumbnail thumb pattern gradient spacer divider sprite "
    "blob shape graphic wordmark favicon og header footer nav menu button badge sticker emoji".split()
)
DECORATION = (
    "logo(?:type|mark)?s?", "wordmark", "icon", "colou?r(?:ed)?", "white", "black", "dark", "light", "mono(?:chrome)?", "grey", "gray",
    "red", "blue", "green", "yellow", "orange", "purple", "inverted", "full", "primary", "secondary", "small", "large", "new", "final",
    "copy", "vector", "svg", "png", "webp", "transparent", "2x", "3x", r"v\d+",
)
CALLS = (
    "read", "learn", "see", "view", "watch", "get", "try", "start", "click", "open", "download", "explore", "discover", "book", "request",
    "contact", "sign", "log", "join", "go", "find", "browse", "shop", "buy", "play", "listen", "subscribe", "follow", "share", "next", "prev",
    "previous", "back", "close", "expand", "collapse", "show", "hide", "more", "all",
)

# What is counted in a scale claim, what a gain is said to do, and what no claim says.
COUNT_NOUNS = (
    "teams", "companies", "customers", "users", "developers", "businesses", "organi[sz]ations", "brands", "engineers", "hours", "people",
    "merchants", "creators", "stores", "enterprises", "employees", "websites", "apps", "requests", "events", "records", "leads", "deals",
    "integrations", "downloads", "installs", "projects", "repositories", "workflows", "messages", "transactions", "queries", "models",
    "agents", "sites", "accounts", "seats", "members",
)
CLAIM_VERBS = (
    "faster", "slower", "quicker", "fewer", "more", "less", "higher", "lower", "better", "cheaper", "greater", "larger", "smaller",
    "increase", "decrease", "reduction", "growth", "uplift", "improvement", "savings", "saved", "reduced", "increased", "improved", "boost",
    "lift", "roi", "return", "accuracy", "uptime", "coverage", "adoption", "efficiency", "productivity", "cut", "cuts", "save", "saves",
    "slash", "slashes", "speed", "accelerate", "shorten", "shrink", "eliminate", "grow", "grew", "scale", "convert", "retain", "close", "win",
    "resolve", "deflect", "automate",
)
NO_CLAIM = ("copyright", "all rights reserved", "®", "privacy policy", "cookie")
# Families of claims: kind, what comes first, what follows, and whether the two are
# told in the other order.
_GAIN = rf"(?:{'|'.join(CLAIM_VERBS)})"
CLAIM_FAMILIES = (
    ("multiplier", r"\d{1,4}(?:[.,]\d+)?\s*[x×]", rf"\s+{_GAIN}(?:\s+[a-z][a-z-]{{1,18}}){{0,2}}", False),
    ("percent", r"\d{1,3}(?:[.,]\d{1,3})?\s*%", rf"\s+{_GAIN}(?:\s+[a-z][a-z-]{{1,18}}){{0,2}}", False),
    ("percent-trailing", rf"{_GAIN}(?:\s+[a-z][a-z-]{{1,18}}){{0,3}}\s+by\s+", r"\d{1,3}(?:[.,]\d{1,2})?\s*%", True),
    ("percent-trailing", r"(?:[a-z][a-z-]{2,18}\s+){1,3}by\s+", r"\d{1,3}(?:[.,]\d{1,2})?\s*%", True),
    ("count", r"(?:\d{1,3}(?:[,.]\d{3})+|\d{1,4}(?:\.\d)?\s*(?:k|m|bn?)\b|\d{2,6})\s*\+?", rf"\s+(?:{'|'.join(COUNT_NOUNS)})\b", False),
    ("money", r"[$€£]\s?\d{1,3}(?:[,.]\d+)*\s*(?:k|m|bn?|billion|million|trillion)?\+?", r"\s+(?:in\s+)?(?:[a-z][a-z-]{1,18}\s*){1,3}", False),
    ("time", r"(?:in|under|within|less than)\s+\d{1,3}", r"\s+(?:seconds?|minutes?|hours?|days?|weeks?)\b", False),
    ("rank", r"(?:fortune\s?(?:100|500)|g2\s+(?:leader|#1)|#\s?1\s+(?:rated\s+)?[a-z][a-z\s-]{2,24})", "", False),
)

# Currencies, and what a price, its period and its unit look like.
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
PRICE_FORMS = (
    r"(?P<sign>[$€£¥₹])\s?(?P<after>\d{1,3}(?:[,.\u202f ]\d{3})*(?:[.,]\d{1,2})?(?!\d)|\d{1,6}(?:[.,]\d{1,2})?)",
    r"(?P<before>\d{1,3}(?:[,.]\d{3})*(?:[.,]\d{1,2})?)\s?(?P<tail>[€£])",
    r"\b(?P<code>USD|EUR|GBP)\s?(?P<coded>\d{1,6}(?:[.,]\d{1,2})?)",
)
MONTHLY, YEARLY = (r"/\s*mo(?:nth)?\b", r"per\s+month\b", r"\bmonthly\b", r"\ba\s+month\b"), (r"/\s*(?:yr|year)\b", r"per\s+year\b", r"\bannually\b", r"\byearly\b", r"\ba\s+year\b")
SEAT_UNITS = ("user", "seat", "member", "agent", "licen[cs]e", "contact", "editor", "host", "admin")
# Words of a plan's name, badges that aren't part of it, and classes that mark one.
TIER_WORDS = (
    "free", "freemium", "starter", "start", "basic", "essential", "essentials", "standard", "core", "lite", "light", "plus", "pro",
    "professional", "premium", "advanced", "team", "teams", "business", "growth", "scale", "company", "organisation", "organization",
    "enterprise", "ultimate", "unlimited", "custom", "individual", "personal", "solo", "startup", "developer", "developers", "hobby",
    "community", "cloud", "dedicated", "suite", "max", "ultra", "launch", "build", "grow", "expert", "elite", "plan",
)
TIER_BADGES = ("recommended", "popular", r"best\s+value", "new", "beta", r"coming\s+soon", r"current\s+plan", r"save\s+\d+%?")
TIER_CLASS = r"(?:plan|tier|package|pricing)[-_]?(?:name|title|heading|label)"
# What sends a buyer to the sales team, what says that a plan is free, for certain or
# loosely, and how a least number of seats is told.
CONTACT_SALES = ("contact (?:us|sales)", "talk to (?:us|sales|an expert)", "get (?:a )?(?:quote|demo)", "custom pricing", "let'?s talk", "request pricing", "book a demo")
FREE_PHRASES = ("free forever", "free plan", "free tier", "always free", "free for(?:ever)?", "start(?:s|ing)? (?:for )?free", "no cost")
FREE_FOR_CERTAIN = ("free forever", "forever free", "free plan", "free tier", "always free")
FREE_TITLES = ("free", "freemium", "free plan", "free tier")
SEAT_MINIMUMS = (
    r"\bminimum(?:\s+of)?\s+(\d{1,4})\s+(seat|user|licen[cs]e|member|employee)s?\b",
    r"\b(\d{1,4})\s+(seat|user|licen[cs]e|member)s?\s+minimum\b",
    r"\bstarts?\s+at\s+(\d{1,4})\s+(seat|user|licen[cs]e)s?\b",
    r"\bbilled\s+for\s+(?:a\s+minimum\s+of\s+)?(\d{1,4})\s+(seat|user)s?\b",
    r"\brequires?\s+(?:a\s+)?minimum\s+(?:of\s+)?(\d{1,4})\s+(seat|user)s?\b",
)

# What a section's words say of its type.
SECTION_TYPES = ("hero", "logos", "proof", "testimonial", "pricing", "faq", "comparison", "integrations", "features", "product", "resources", "awards", "events", "security", "cta", "media", "other")
ACTIONS = (
    "get started", "start (?:free|now|building)", "try (?:it|for)", "book a", "request a", "talk to", "contact sales", "sign up", "see (?:a )?demo",
    "watch (?:a )?demo", "learn more", "read (?:the )?docs",
)
MONEY = r"[$€£¥]|\b(?:USD|EUR|GBP|per\s+(?:month|user|seat)|/mo\b)"
PRICE_TALK = ("free", "plan", "pricing", "per month", "per user")
QUANTITY = r"\b\d[\d.,]{0,40}\s*(?:x\b|%|k\b|m\b|bn\b|billion|million|hours?|days?|weeks?|customers?|teams?|companies|users?)"
INTEGRATIONS = r"\bintegrat(?:e|es|ion|ions)\b|\bconnectors?\b|\bworks with\b|\bapp (?:centre|center|directory|marketplace|store)\b|\bplug-?ins?\b"
TESTIMONY = r"(?:^|[\s(\[—-])[\"“](?=\w)|[\"”]\s*[—–-]\s*\w|\bsays?\b|\bCEO\b|\bCTO\b|\bCFO\b|\bVP of\b|\bHead of\b|\bDirector of\b"
TESTIMONY_STEMS = ('"', "\u201c", "\u201d", "say", "ceo", "cto", "cfo", "vp of", "head of", "director of")
TESTIMONIAL_HEADINGS = (
    "customer (?:stor(?:y|ies)|reviews?|success)", "case stud(?:y|ies)", "what (?:our )?customers say", "don.t just take our word", "real stories",
    "loved by", "success stories", "why (?:teams|companies|customers) choose", "hear (?:from|what)", "deliver impact", "win with", "do better with",
    "innovators win", "companies (?:trust|succeed)",
)
AWARDS = ("magic quadrant", "forrester wave", "gartner", "g2", "leader in", "recognized (?:as|by)", "award", "badge", "named a leader", "top rated")
EVENTS = ("webinar", "conference", "summit", "register now", "save the date", "join us (?:on|at)", r"\d{1,2}(?:st|nd|rd|th)? [A-Z][a-z]+ 20\d\d")
SECURITY = ("SOC ?2", "ISO ?27001", "GDPR", "HIPAA", "PCI[- ]DSS", "FedRAMP", "compliance", "encryption", "security standards", "trust cent(?:er|re)", "penetration test")
RESOURCES = (
    "blog", "ebook", "whitepaper", "white paper", "documentation", "tutorials?", "case stud(?:y|ies)", "newsletter", "changelog", "help articles",
    "resources", "latest (?:research|news|insights|from)", "in the spotlight", "read the (?:guide|docs|story|report)", "download the report",
    "level up", "product launches", "explore what you can do", "getting started",
)
OVERVIEWS = (
    "platform", "all[- ]in[- ]one", "our products", "everything you need", "single source of truth", "unified", "one (?:place|system|tool)",
    "why (?:choose|use)", "meet the", "the only", "complete solution",
)


class Phrases:
    """Any of the phrases as whole words; the expression is only tried on a text that holds the
    literal beginning of one of them, which is much faster to look for."""

    def __init__(self, phrases, flags: int = re.I, words: bool = True, stems=None):
        self.regex = re.compile(rf"\b(?:{'|'.join(phrases)})\b" if words else "|".join(phrases), flags)
        self.stems = tuple(stems or dict.fromkeys(literal_start(p) for p in phrases))

    def search(self, text: str, low: str | None = None) -> re.Match[str] | None:
        low = text.lower() if low is None else low
        return self.regex.search(text) if any(s in low for s in self.stems) else None

    def finditer(self, text: str, low: str | None = None):
        low = text.lower() if low is None else low
        return self.regex.finditer(text) if any(s in low for s in self.stems) else iter(())

    def places(self, text: str, low: str):
        """Where a phrase begins, in order; ``low`` is as long as the text."""
        found = set()
        for stem in self.stems:
            at = low.find(stem)
            while at >= 0:
                if self.regex.match(text, at):
                    found.add(at)
                at = low.find(stem, at + 1)
        return sorted(found)


def literal_start(phrase: str) -> str:
    """The characters before the first that may vary, in lower case."""
    head = re.match(r"(?:[\w #-](?![?*{]))*", phrase)[0]
    return head.lower() if head else ""


def any_of(phrases, flags: int = re.I) -> Phrases:
    return Phrases(phrases, flags)

# The named entities that are decoded; others stay as they are.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "trade": "™", "reg": "®", "copy": "©", "middot": "·", "bull": "•", "deg": "°", "euro": "€", "pound": "£", "yen": "¥",
    "cent": "¢", "times": "×", "divide": "÷", "laquo": "«", "raquo": "»", "shy": "", "zwnj": "", "zwj": "", "thinsp": " ", "ensp": " ", "emsp": " ",
}
