"""Patterns, word lists and limits that results depend on.

Every value in this module is a fixed value: results are right only with exactly these.  They are
written for Java's regular expressions.  ``B`` stands for a word boundary between ASCII word
characters, because Java's own is Unicode-aware, and ``S`` for the white space of ECMAScript.
"""

from __future__ import annotations

B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
S = f"[{SPACES}]"
#: A word boundary before a word character, which is cheaper to look for.
W = r"(?<![A-Za-z0-9_])"

# Limits of the model input, in characters.
MAX_CHARS = 18000
MAX_BLOCK_CHARS = 4000
CHUNK_CHARS = 1400
CHUNK_MIN_SIGNALS = 6
PRE_CONTEXT_CHARS = 900
POST_CONTEXT_CHARS = 95
SIGNAL_SCORE = 8
SCORELESS_LEAD_CHARS = 800
PRIORITY_LEADS = 3
LEADS = 18
CSV_MAX_CHARS = 12000
CELL_CHARS = 240
SIGNAL_CAPS = {"date": 16, "time": 12, "detail": 8}

# By what lengths and scores the rendered text is preferred to the page's markdown.
HTML_SCORE = 16
SOURCE_CHOICE = {
    "chrome_many": 6, "chrome_share": 0.45, "chrome_some": 2, "chrome_growth": 1.5, "chrome_lead": 8,
    "details_score": 12, "details_lines": 2, "accordion_chars": 4000, "accordion_growth": 3, "accordion_less": 15,
    "clusters": 2, "fit_score": 8, "fit_less": 10, "lead_score": 16, "lead_more": 12,
    "near_limit": 1.35, "near_share": 0.75, "near_score": 16, "near_lead": 12, "sparse_chars": 1200, "sparse_growth": 3,
    "richer_growth": 1.6, "richer_more": 12, "broader_growth": 2.5, "broader_score": 10, "broader_less": 6, "bulky_growth": 2.5, "bulky_score": 12,
}

# Fixed value: what stands before a shortened text.
TRUNCATION_NOTICE = "[Context shortened: source page exceeded the scan budget. Some events or details may be omitted.]"

# Names of the months.
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

# Dates, times and zones in expected events.
MONTH_NAME = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DAY_NUMBER = "[0-9]{1,2}"
CLOCK = rf"[0-9]{{1,2}}(?:[:.][0-9]{{2}})?{S}*(?:[ap](?:\.?m\.?)?)?"
ZONE_WORD = rf"(?:{S}*[a-z]{{2,5}})?"

# Dates and times.
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?"
DAY = r"[0-9]{1,2}(?:st|nd|rd|th)?"
DAY_WITH_YEAR = rf"{DAY}(?:,?{S}*[0-9]{{4}})?"
DATE = "(?i)" + W + "(?:" + "|".join(
    [
        rf"(?:Mon|Tue|Tues|Wed|Thu|Thur|Thurs|Fri|Sat|Sun)(?:day)?{B}",
        rf"(?:today|tonight|tomorrow|yesterday|this{S}+(?:morning|afternoon|evening|week|weekend)|next{S}+(?:week|weekend)){B}",
        rf"{MONTH}{S}+{DAY}{S}*(?:-|\u2013|\u2014|to|through){S}*{MONTH}{S}+{DAY}(?:,{S}*[0-9]{{4}})?{B}",
        rf"{MONTH}{S}+{DAY}(?:,{S}*[0-9]{{4}})?{B}",
        rf"{DAY}{S}+{MONTH}(?:{S}+[0-9]{{4}})?{B}",
        rf"[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}{B}",
        rf"[0-9]{{1,2}}[/-][0-9]{{1,2}}(?:[/-][0-9]{{2,4}})?{B}",
    ]
) + ")"
TIME = rf"(?i){W}(?:[0-9]{{1,2}}(?::[0-9]{{2}})?{S}*(?:am|pm){B}|[0-9]{{1,2}}:[0-9]{{2}}{B})"
STANDALONE_MONTH = rf"(?i)^{MONTH}\z"
STANDALONE_DAY = rf"(?i)^{DAY_WITH_YEAR}\z"
CONTEXT_LABEL = r"(?i)^(?:date|time|when|where|venue|location|event date|event time|category|type|details|info|information)\z"


def any_of(words: str) -> str:
    return f"(?i){W}(?:{words}){B}"


# Words that speak for or against a block.
EVENT_WORDS = any_of("event|calendar|ticket|tickets|rsvp|registration|doors|admission|presented|live|music|webinar|workshop|concert|screening|festival|meetup|lecture|panel|class|session|conference|show|performance|tour")
PLACE_WORDS = any_of(r"venue|location|where|address|room|auditorium|hall|street|st\.|avenue|ave\.|road|rd\.")
DETAIL_WORDS = any_of(r"event|calendar|ticket|tickets|rsvp|registration|doors|admission|presented|live|music|webinar|workshop|concert|screening|festival|meetup|lecture|panel|class|session|conference|show|performance|tour|venue|location|where|address|room|auditorium|hall|street|st\.|avenue|ave\.|road|rd\.")
PLACE_DETAILS = any_of(r"venue|location|where|address|room|auditorium|hall|street|st\.|avenue|ave\.|road|rd\.|studio|theater|theatre|centre|center")
TITLE_EVENTS = any_of("event|workshop|concert|screening|festival|meetup|lecture|panel|class|session|conference|show|performance|tour|market|opera|jazz|theater|theatre|film|movie|comedy|dance|night|party|gala|fair")
CHROME_WORDS = any_of("cookie|privacy policy|terms of use|terms and conditions|subscribe|newsletter|login|signin|signup|account|cart|copyright|all rights reserved|skip to content")
NOISE_WORDS = any_of("manage cookies?|cookies?|privacy policy|terms of use|terms and conditions|subscribe|newsletter|login|signin|signup|account|cart|copyright|all rights reserved|skip to content|navigation")
COMPACT_NOISE = any_of("manage cookies?|cookies?|privacy policy|terms of use|subscribe|newsletter|login|account|copyright|navigation")
TITLE_CHROME = any_of("privacy policy|terms of use|terms and conditions|newsletter|login|signin|signup|account|cart|copyright|all rights reserved|skip to content|navigation")
DETAIL_CHROME = any_of("view details|show details|event details|see details|learn more|read more|more info(?:rmation)?")
COLLAPSED = any_of("expand all|collapse all|accordion panels?|accordion")

# Elements and attribute parts that are dropped from a page.
DROPPED_TAGS = ["script", "style", "noscript", "template", "iframe", "canvas", "svg", "picture", "source", "object", "embed", "form", "input", "select", "textarea", "button", "link", "meta", "aside"]
NOISY_ATTRIBUTES = [
    "nav", "navbar", "header", "footer", "sidebar", "menu", "breadcrumbs", "breadcrumb", "pagination", "pager",
    "cookie", "consent", "subscribe", "newsletter", "ad-", "ads", "advert", "promo", "banner", "brand", "logo",
    "share", "social", "search", "login", "signin", "signup", "account", "cart", "sticky", "floating", "related", "comments",
]

# Abbreviations of time zones.
ZONES = {
    "PST": "America/Los_Angeles", "PDT": "America/Los_Angeles", "PT": "America/Los_Angeles",
    "MST": "America/Denver", "MDT": "America/Denver", "MT": "America/Denver",
    "CST": "America/Chicago", "CDT": "America/Chicago", "CT": "America/Chicago",
    "EST": "America/New_York", "EDT": "America/New_York", "ET": "America/New_York",
    "AKST": "America/Anchorage", "AKDT": "America/Anchorage", "HST": "Pacific/Honolulu",
    "GMT": "Etc/GMT", "UTC": "UTC", "BST": "Europe/London", "CET": "Europe/Paris", "CEST": "Europe/Paris",
    "JST": "Asia/Tokyo", "AEST": "Australia/Sydney", "AEDT": "Australia/Sydney", "IST": "Asia/Kolkata", "PKT": "Asia/Karachi",
}

# Names of model providers.
PROVIDERS = {"anthropic": "Anthropic", "openai": "OpenAI", "google": "Google", "meta-llama": "Meta Llama", "mistralai": "Mistral AI", "deepseek": "DeepSeek", "cohere": "Cohere", "microsoft": "Microsoft", "amazon": "Amazon", "qwen": "Qwen"}

# Where on a page an event is marked.
MARK_PREFIX = 15
MARK_LEAST = 3
MARK_SKIP = ["script", "style", "noscript", "template", "iframe"]
MARK_TITLES = ["h1", "h2", "h3", "h4", "h5", "h6", "a", "span", "strong", "b", "em"]
MARK_BOXES = ["article", "section", "div", "li", "tr", "td"]

# Fixed value: names of reports that lie beside captured pages.
REPORT_FILE = r"^(?:report|llm-report|old-new-(?:llm|static)-report)(?:-[^.]+)?\.json$"
