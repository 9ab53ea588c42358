"""Rule lists that steer the enrichment, and the ``Rules`` bundle that carries them.

Every list can be replaced: ``Rules(blocked_domains=(...,))``. The defaults below are small and of
fixed size, so they travel inside column expressions as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------------------------
# Fixed values. These must be exactly what they are for results to be right.
# --------------------------------------------------------------------------------------------

# Names of the canonical input columns and the header spellings accepted for each.
SERVICE_NAME = "Service Name"
SERVICE_WEBSITE = "Service Website"
POSTCODE = "Postcode"
TOWN = "Town"

COLUMN_ALIASES = {
    SERVICE_NAME: (
        "service name", "servicename", "service", "provider name", "providername",
        "provider", "company", "company name", "organisation", "organization",
    ),
    SERVICE_WEBSITE: (
        "service website", "servicewebsite", "service_website", "provider website", "website",
        "company website", "organisation website", "organization website",
    ),
    POSTCODE: ("postcode", "post code", "postal code", "zip", "zip code"),
    TOWN: ("town", "town/city", "city", "location", "town / city"),
}

# Cell texts that a delimited file uses for "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Result columns, in output order.
CATEGORIES = (
    "HR Email", "Recruitment Email", "Careers Email", "Manager Email", "Info Email",
    "General Email",
)
STATUS = "Status"
FAILURE_REASON = "Failure Reason"
ENRICHED_COLUMNS = (SERVICE_NAME, SERVICE_WEBSITE, *CATEGORIES, STATUS, FAILURE_REASON)
SUCCESS_COLUMNS = (SERVICE_NAME, SERVICE_WEBSITE, *CATEGORIES)
FAILED_COLUMNS = (SERVICE_NAME, SERVICE_WEBSITE, STATUS, FAILURE_REASON)

# Second-last host labels that make a registrable domain three labels long.
SECOND_LEVEL_LABELS = ("co", "org", "me", "gov", "net", "ac", "com", "ltd", "sch")

# Hosts under these suffixes (or equal to the bare suffix) are never an official website.
BLOCKED_SUFFIXES = (
    ".gov.uk", ".nhs.uk", ".gov.scot", ".gov.wales", ".nhs.scot", ".nhs.wales",
)

# Hosts equal to or under these domains are never an official website.
BLOCKED_DOMAINS = (
    # inspectorates and regulators
    "cqc.org.uk", "careinspectorate.scot", "careinspectorate.com", "careinspectorate.wales",
    "ciw.wales", "rqia.org.uk", "ofsted.gov.uk", "healthcareimprovementscotland.org",
    "ihub.scot",
    # government and registries
    "gov.uk", "service.gov.uk", "companieshouse.gov.uk",
    "find-and-update.company-information.service.gov.uk", "nhs.uk", "nhs.net",
    "england.nhs.uk", "wales.nhs.uk", "nhsinform.scot", "mygov.scot", "gov.wales", "gov.scot",
    # care directories
    "carehome.co.uk", "yourcarehome.co.uk", "carechoices.co.uk", "homecare.co.uk",
    "housingcare.org", "ukcareguide.co.uk", "caredirectory.org.uk", "lgo.org.uk",
    "carehomeselect.com", "caresearch.co.uk", "councilfordisabledchildren.org.uk",
    # business directories and search engines
    "yell.com", "yelp.com", "yelp.co.uk", "thomsonlocal.com", "cylex-uk.co.uk",
    "hotfrog.co.uk", "scoot.co.uk", "192.com", "google.com", "google.co.uk", "bing.com",
    # reviews and jobs
    "trustpilot.com", "glassdoor.com", "glassdoor.co.uk", "indeed.com", "indeed.co.uk",
    "totaljobs.com", "reed.co.uk", "cwjobs.co.uk", "wikipedia.org", "bloomberg.com", "dnb.com",
    "companies-in-uk.com",
    # social media
    "facebook.com", "linkedin.com", "instagram.com", "x.com", "twitter.com", "youtube.com",
    "pinterest.com", "tiktok.com", "reddit.com",
)

# A link is worth following when its text or path holds one of these.
LINK_WORDS = (
    "contact", "contact-us", "about", "about-us", "careers", "career", "jobs", "vacancies",
    "recruitment", "join-us", "team", "people", "staff", "our-team", "get-in-touch", "join",
    "work-with-us",
)

# A link is never followed when its path holds one of these.
PATH_STOP_WORDS = (
    "blog", "blogs", "news", "gallery", "galleries", "photo", "photos", "privacy",
    "privacy-policy", "terms", "terms-of-use", "terms-and-conditions", "cookie", "cookies",
    "testimonial", "testimonials", "review", "reviews", "press", "event", "events", "post",
    "posts", "article", "articles",
)

# Paths tried on every site after its own links.
COMMON_PATHS = (
    "/contact", "/contact-us", "/about", "/about-us", "/careers", "/career", "/jobs",
    "/vacancies", "/recruitment", "/team",
)

# Distinct canonical URLs a site may use up where a visit has a budget (Rules.max_pages).
MAX_PAGES = 10

# Addresses: shape, and the punctuation cut from both ends.
ADDRESS_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
ADDRESS_STRIP = ".,;:\"'()[]"

PLACEHOLDER_ADDRESSES = (
    "example@example.com", "test@example.com", "user@example.com", "info@example.com",
    "admin@example.com", "name@example.com", "yourname@example.com",
)
ASSET_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".css", ".js")
AUTOMATED_LOCAL_PARTS = ("noreply", "no-reply", "unsubscribe")
IGNORED_LOCAL_PREFIXES = (
    "referrals", "complaints", "supporter", "pricing", "campaigning", "media", "feedback",
    "customerservices", "creditcontrol",
)
TECHNICAL_DOMAINS = (
    "sentry.io", "sentry-next.wixpress.com", "sentry.wixpress.com", "wixpress.com",
    "mysite.com", "wix.com", "schema.org", "wordpress.org", "wordpress.com", "elementor.com",
    "gravatar.com", "github.com", "google.com", "googlemail.com", "google-analytics.com",
    "google-analytics", "googleanalytics.com", "facebook.com", "facebook", "twitter.com",
    "twitter", "instagram.com", "instagram", "linkedin.com", "linkedin", "youtube.com",
    "youtube", "example.com", "domain.com",
)
REGULATOR_DOMAINS = (
    "nhs.net", "nhs.uk", "cqc.org.uk", "careinspectorate.scot", "careinspectorate.com",
    "careinspectorate.wales", "ciw.wales", "rqia.org.uk", "ofsted.gov.uk",
    "healthcareimprovementscotland.org", "ihub.scot", "gov.uk", "service.gov.uk",
    "companieshouse.gov.uk", "mygov.scot", "gov.wales", "gov.scot",
)
GOVERNMENT_SUFFIXES = (".gov.uk", ".nhs.uk", ".nhs.scot")

# Words in the local part that decide the category; first category that matches wins, "Info" by
# prefix, the rest is "General".
CATEGORY_WORDS = {
    "HR Email": ("hr", "humanresources", "people"),
    "Recruitment Email": ("recruitment", "recruiter", "hiring", "talent"),
    "Careers Email": ("career", "careers", "jobs", "vacancy", "vacancies"),
    "Manager Email": (
        "manager", "director", "owner", "administrator", "admin", "managingdirector",
    ),
}
INFO_PREFIX = "info"

# Page parts.
HIDDEN_TAGS = ("script", "style", "noscript", "svg", "canvas", "iframe", "template")
PRIORITY_TAGS = ("footer", "header", "main", "address")
PRIORITY_CLASSES = (
    "contact", "contact-us", "contact-info", "contact-details", "footer", "site-footer",
    "header",
)
PRIORITY_IDS = ("contact", "footer", "contact-us")
LINK_ZONE_TAGS = ("nav", "header", "footer")
HIDDEN_STYLES = ("display:none", "visibility:hidden")
HIDDEN_ATTRIBUTE, HIDDEN_ARIA = "hidden", "aria-hidden"

# Texts that appear in results.
SUCCESS = "Success"
FAILED = "Failed"
REASON_NO_WEBSITE = "Official website not found"
REASON_UNREACHABLE = "Website not reachable"
REASON_DNS = "Website not reachable (DNS lookup failed)"
REASON_TIMEOUT = "Website connection timed out"
REASON_REFUSED = "Website refused connection"
REASON_FORBIDDEN = "Homepage returned HTTP 403"
REASON_ACCEPTED = "Homepage returned HTTP 202"
REASON_NOT_FOUND = "Website pages not found (404)"
REASON_NO_ADDRESS = "No email found"
SEARCH_PHRASE = "official website"

# Words in the error of a page load that tell its reason; first reason that matches wins.
ERROR_WORDS = {
    REASON_DNS: ("err_name_not_resolved", "getaddrinfo", "dns"),
    REASON_TIMEOUT: ("timeout", "timed out", "err_connection_timed_out"),
    REASON_REFUSED: ("err_connection_refused", "connection refused"),
}

# Why an address is not used; {} is the name that matches.
IGNORED_FORMAT = "Invalid email format"
IGNORED_PATTERN = "Failed standard regex validation"
IGNORED_PLACEHOLDER = "Matched dummy/test email blocklist"
IGNORED_ASSET = "Static asset extension ({})"
IGNORED_AUTOMATED = "Automated no-reply address"
IGNORED_PREFIX = "Username starts with ignored keyword ('{}')"
IGNORED_TECHNICAL = "Technical / analytics / social domain ('{}')"
IGNORED_REGULATOR = "Regulator / NHS / Gov domain ('{}')"
IGNORED_GOVERNMENT = "Government or NHS domain suffix"

# --------------------------------------------------------------------------------------------
# End of fixed values.
# --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """The replaceable lists. Give other tuples to change a rule for one run."""

    blocked_suffixes: tuple[str, ...] = BLOCKED_SUFFIXES
    blocked_domains: tuple[str, ...] = BLOCKED_DOMAINS
    link_words: tuple[str, ...] = LINK_WORDS
    path_stop_words: tuple[str, ...] = PATH_STOP_WORDS
    common_paths: tuple[str, ...] = COMMON_PATHS
    max_pages: int | None = None
    placeholder_addresses: tuple[str, ...] = PLACEHOLDER_ADDRESSES
    asset_extensions: tuple[str, ...] = ASSET_EXTENSIONS
    automated_local_parts: tuple[str, ...] = AUTOMATED_LOCAL_PARTS
    ignored_local_prefixes: tuple[str, ...] = IGNORED_LOCAL_PREFIXES
    technical_domains: tuple[str, ...] = TECHNICAL_DOMAINS
    regulator_domains: tuple[str, ...] = REGULATOR_DOMAINS
    government_suffixes: tuple[str, ...] = GOVERNMENT_SUFFIXES
    category_words: tuple[tuple[str, tuple[str, ...]], ...] = tuple(CATEGORY_WORDS.items())
    info_prefix: str = INFO_PREFIX
    hidden_tags: tuple[str, ...] = HIDDEN_TAGS
    hidden_styles: tuple[str, ...] = HIDDEN_STYLES
    priority_tags: tuple[str, ...] = PRIORITY_TAGS
    priority_classes: tuple[str, ...] = PRIORITY_CLASSES
    priority_ids: tuple[str, ...] = PRIORITY_IDS
    link_zone_tags: tuple[str, ...] = LINK_ZONE_TAGS
    column_aliases: tuple[tuple[str, tuple[str, ...]], ...] = tuple(
        (name, tuple(aliases)) for name, aliases in COLUMN_ALIASES.items())


DEFAULT_RULES = Rules()


def longest_first(words: tuple[str, ...]) -> list[str]:
    """A fixed order for "which of several matching names is quoted": longest, then A to Z."""
    return sorted(words, key=lambda w: (-len(w), w))
