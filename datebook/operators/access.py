"""Which pages may be scanned, and what kind of failure a scan met."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Messages, protocols and parts of error messages.
CHROME_PAGE = "Chrome pages cannot be scanned."
WEB_STORE = "Chrome Web Store pages cannot be scanned."
PROTECTED_PAGE = "This page cannot be scanned."
PROTOCOLS = ["about", "chrome", "chrome-extension", "devtools", "edge"]
ACCESS_ERRORS = ["cannot access contents of url", "cannot access a chrome", "cannot be scripted", "extensions gallery cannot be scripted", "page cannot be scripted"]
RATE_LIMITS = ["rate limit", "quota", "daily limit"]


def scan_block_reason(url: Column) -> Column:
    """Why a page cannot be scanned; null where it can, or where the url is none."""
    scheme = F.lower(F.regexp_extract(url, r"^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    store = (host == "chromewebstore.google.com") | ((host == "chrome.google.com") & path.startswith("/webstore"))
    return F.when(store & scheme.isin("http", "https"), WEB_STORE).when(scheme.isin(PROTOCOLS), CHROME_PAGE)


def required_scan_block_reason(url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", PROTECTED_PAGE).otherwise(scan_block_reason(url))


def injection_failure(url: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    known = F.exists(F.array(*map(F.lit, ACCESS_ERRORS)), lambda p: F.contains(low, p))
    return F.coalesce(scan_block_reason(url), F.when(known, PROTECTED_PAGE))


def has_input(model_input: Column, images: Column) -> Column:
    """Whether there is anything to send; a scan of nothing succeeds with no events."""
    return (F.coalesce(F.trim(model_input), F.lit("")) != "") | (F.size(F.coalesce(images, F.array().cast("array<string>"))) > 0)


def is_rate_limit(kind: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.coalesce(kind == "RATE_LIMIT", F.lit(False)) | F.exists(F.array(*map(F.lit, RATE_LIMITS)), lambda p: F.contains(low, p))


def scan_error_kind(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    slow = F.contains(low, F.lit("timeout")) | F.contains(low, F.lit("timed out"))
    return F.when(slow, "timeout").when(F.contains(low, F.lit("network")) | F.contains(low, F.lit("fetch")), "network").otherwise("generic")
