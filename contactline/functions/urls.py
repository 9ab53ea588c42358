"""URL functions as column expressions (generic syntax, lenient like a browser's address bar)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactline.functions.text import any_of, ends_with_domain, once, strip
from contactline.rules import DEFAULT_RULES, SECOND_LEVEL_LABELS, Rules

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_NETLOC_RX = rf"\A(?:{_SCHEME}:)?//([^/?#]*)"
_PATH_RX = rf"\A(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)"
_PARAMS_RX = r"(?s)\A((?:.*/)?[^/;]*);([^/]*)\z"
_PARTS_RX = rf"(?s)\A(?:({_SCHEME}):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
# Schemes whose paths may end in ;parameters.
_WITH_PARAMS = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips",
    "mms", "sftp", "tel",
)
# Schemes under which a link may leave out what its page's address has.
_RELATIVE = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero",
    "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)
# Signs that compatibility forms make a delimiter of: no host may have them.
_DELIMITING = "".join(
    chr(c) for c in range(0x80, 0xFFFF)
    if not 0xD800 <= c < 0xE000 and set(unicodedata.normalize("NFKC", chr(c))) & set("/?#@:"))
# A bracketed host: an IPv6 address (a dotted end counts as two groups), or a later version.
_GROUP = r"[0-9A-Fa-f]{1,4}"
_IPV6 = (
    rf"(?:(?:{_GROUP}:){{7}}{_GROUP}"
    rf"|(?=(?:[^:]*:){{2,7}}[^:]*\z)(?:{_GROUP}(?::{_GROUP})*)::(?:{_GROUP}(?::{_GROUP})*)"
    rf"|(?=(?:[^:]*:){{2,8}}[^:]*\z)(?:::(?:{_GROUP}(?::{_GROUP})*)?|{_GROUP}(?::{_GROUP})*::))"
)
_BRACKETED = rf"\A(?:v[0-9A-Fa-f]+\..+|{_IPV6})\z"
_ROOT_RX = rf"(?:[^.]*\.(?:{any_of(SECOND_LEVEL_LABELS)})\.[^.]*|[^.]*\.[^.]*|[^.]*)\z"


def _tidy(url: Column) -> Column:
    """Leading control characters and blanks go, and line breaks and tabs anywhere."""
    return F.regexp_replace(url, r"\A[\x00-\x20]+|[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_tidy(url), rf"\A({_SCHEME}):", 1))


def netloc(url: Column) -> Column:
    """Host part with user and port, as written; empty without ``//``."""
    return F.regexp_extract(_tidy(url), _NETLOC_RX, 1)


def path(url: Column) -> Column:
    """Path without query and fragment, also without ``;parameters`` where the scheme has them."""
    whole = F.regexp_extract(_tidy(url), _PATH_RX, 1)
    return F.when(
        scheme(url).isin(*_WITH_PARAMS), F.regexp_replace(whole, _PARAMS_RX, "$1")
    ).otherwise(whole)


def host_or_first_segment(url: Column) -> Column:
    def pick(u: Column) -> Column:
        host = netloc(u)
        return F.when(host != "", host).otherwise(F.split_part(path(u), F.lit("/"), F.lit(1)))

    return once(url, pick)


def bare_host(host: Column) -> Column:
    """Lower case, cut at the first colon, no outer dots."""
    return F.trim(F.split_part(F.lower(host), F.lit(":"), F.lit(1)), F.lit("."))


def root_domain(host: Column) -> Column:
    """Registrable domain of a host: its last two labels, three under a second-level label."""
    return F.regexp_extract(bare_host(host), _ROOT_RX, 0)


def site_key(url: Column, by: str = "root_domain") -> Column:
    """Key under which pages and services of one site meet; ``by`` is root_domain or host."""
    host = host_or_first_segment(url)
    if by == "root_domain":
        return root_domain(host)
    if by == "host":
        return bare_host(host)
    raise ValueError(f"site key must be 'root_domain' or 'host', not {by!r}")


def with_scheme(url: Column) -> Column:
    """Stripped URL, with https:// in front unless it starts with http:// or https://."""
    s = strip(url)
    return F.when(s.rlike(r"\Ahttps?://"), s).otherwise(F.concat(F.lit("https://"), s))


def canonical(url: Column) -> Column:
    """Form under which two spellings count as the same page; query and fragment stay."""
    return F.lower(F.rtrim(url, F.lit("/")))


def homepage(url: Column) -> Column:
    """scheme://host/ of a URL, https when it names no scheme or no host. One that cannot be parsed
    stays as it is."""
    def complete(u: Column) -> Column:
        return F.when((scheme(u) != "") & (netloc(u) != ""), u).otherwise(
            F.concat(F.lit("https://"), u)
        )

    def front(u: Column) -> Column:
        return F.concat(scheme(u), F.lit("://"), netloc(u), F.lit("/"))

    def of(u: Column) -> Column:
        whole = once(complete(u), lambda c: F.when(~unparsable(c), front(c)))
        return F.when((u == "") | unparsable(u), u).otherwise(F.coalesce(whole, u))

    return once(url, of)


def host_for_blocklist(url: Column) -> Column:
    """Host of a URL, also when it is written without a scheme; port removed."""
    def pick(u: Column) -> Column:
        host = netloc(u)
        host = F.when(host != "", host).otherwise(netloc(F.concat(F.lit("http://"), u)))
        return F.split_part(F.lower(host), F.lit(":"), F.lit(1))

    return once(url, pick)


def unparsable(url: Column) -> Column:
    """Square brackets in the host that are not a pair, or whose first pair does not hold an IP
    address of version 6 or later, or signs in it that stand for delimiters: such a URL cannot be
    parsed."""
    def judge(host: Column) -> Column:
        inner = F.regexp_extract(host, r"\[([^\]]*)", 1)
        inner = F.regexp_replace(inner, r"(?<=:)\d{1,3}(?:\.\d{1,3}){3}(?=%|\z)", "0:0")
        inner = F.when(inner.startswith("v"), inner).otherwise(
            F.regexp_replace(inner, r"%[^%]+\z", ""))
        opened, closed = host.contains("["), host.contains("]")
        odd = host.rlike(f"[{_DELIMITING}]")
        return (opened != closed) | (opened & ~inner.rlike(_BRACKETED)) | odd

    return once(netloc(url), judge)


def _split(url: Column, scheme_of_page: Column) -> Column:
    """All parts of a URL, absent ones empty; without a scheme it has that of its page."""
    def of(u: Column) -> Column:
        own = F.lower(F.regexp_extract(u, _PARTS_RX, 1))
        return once(F.when(own != "", own).otherwise(scheme_of_page), lambda s: parts(u, s))

    def parts(u: Column, s: Column) -> Column:
        whole = F.regexp_extract(u, _PARTS_RX, 3)
        with_params = s.isin(*_WITH_PARAMS)
        return F.struct(
            s.alias("scheme"),
            F.regexp_extract(u, _PARTS_RX, 2).alias("netloc"),
            F.when(with_params, F.regexp_replace(whole, _PARAMS_RX, "$1")).otherwise(whole).alias("path"),
            F.when(with_params, F.regexp_extract(whole, _PARAMS_RX, 2)).otherwise("").alias("params"),
            F.regexp_extract(u, _PARTS_RX, 4).alias("query"),
            F.regexp_extract(u, _PARTS_RX, 5).alias("fragment"),
        )

    return once(_tidy(url), of)


def _step(done: Column, segment: Column) -> Column:
    return (
        F.when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(segment == ".", done)
        .otherwise(F.concat(done, F.array(segment)))
    )


def _merged(page: Column, path: Column) -> Column:
    """A link's path under the folder of its page's path, dot segments resolved in a fold over the
    segments."""
    own = F.split(path, "/")
    folder = once(F.split(page, "/"), lambda p: F.when(
        F.element_at(p, -1) == "", p).otherwise(F.slice(p, 1, F.size(p) - 1)))
    below = once(F.concat(folder, own), lambda both: F.filter(
        both, lambda s, i: (s != "") | (i == 0) | (i == F.size(both) - 1)))

    def resolved(segments: Column) -> Column:
        dots = F.exists(segments, lambda s: s.isin(".", ".."))
        folded = F.aggregate(segments, F.expr("cast(array() as array<string>)"), _step)
        ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.expr("cast(array() as array<string>)"))
        return F.array_join(F.when(dots, F.concat(folded, ends)).otherwise(segments), "/")

    joined = once(F.when(path.startswith("/"), own).otherwise(below), resolved)
    return once(joined, lambda j: F.when(j == "", "/").otherwise(j))


def _joined(b: Column, r: Column) -> Column:
    """Parts of a link in place of those of its page."""
    own = r.netloc != ""
    same_page = (r.path == "") & (r.params == "")
    path = F.when(own, r.path).when(same_page, b.path).otherwise(_merged(b.path, r.path))
    params = F.when(~own & same_page, b.params).otherwise(r.params)
    query = F.when(~own & same_page & (r.query == ""), b.query).otherwise(r.query)

    def given(mark: str, part: Column) -> Column:
        return once(part, lambda p: F.when(p != "", F.concat(F.lit(mark), p)).otherwise(""))

    def behind_host(host: Column, tail: Column) -> Column:
        rooted = (tail == "") | tail.startswith("/")
        return (
            F.when(host != "", F.concat(F.lit("//"), host, F.when(rooted, "").otherwise("/"), tail))
            .when(tail.startswith("//") | ((r.scheme != "") & rooted), F.concat(F.lit("//"), tail))
            .otherwise(tail)
        )

    whole = once(F.concat(path, given(";", params)), lambda tail: behind_host(
        F.when(own, r.netloc).otherwise(b.netloc), tail))
    front = F.when(r.scheme != "", F.concat(r.scheme, F.lit(":"))).otherwise("")
    return F.concat(front, whole, given("?", query), given("#", r.fragment))


def resolve(page: Column, link: Column) -> Column:
    """Absolute form of a link on a page; null where page, link or result cannot be parsed.

    A page without address leaves links as they are, and an empty link is the page. Links of another
    scheme, or of one that is never relative, stay as written.
    """
    def of(x: Column) -> Column:
        def join(b: Column, r: Column) -> Column:
            relative = (r.scheme == b.scheme) & r.scheme.isin(*_RELATIVE)
            return F.when(relative, _joined(b, r)).otherwise(x.link)

        known = once(_split(x.page, F.lit("")), lambda b: once(
            _split(x.link, b.scheme), lambda r: join(b, r)))
        whole = F.when(x.page == "", x.link).when(x.link == "", x.page).when(
            ~unparsable(x.page) & ~unparsable(x.link), known)
        return once(whole, lambda u: F.when(~unparsable(u), u))

    both = F.struct(F.coalesce(page, F.lit("")).alias("page"), F.coalesce(link, F.lit("")).alias("link"))
    return once(both, of)


def is_blocked(url: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """True for an absent or unparsable URL and for hosts of the blocklist."""
    listed = [s.lstrip(".") for s in rules.blocked_suffixes] + list(rules.blocked_domains)

    def judge(u: Column) -> Column:
        known = ends_with_domain(host_for_blocklist(u), listed) if listed else F.lit(False)
        bare = F.concat(F.lit("http://"), u)
        broken = unparsable(u) | ((netloc(u) == "") & unparsable(bare))
        return F.coalesce((u == "") | broken | known, F.lit(True))

    return once(url, judge)


def host_suffixes(host: Column) -> Column:
    """All dot-bounded suffixes of a host, the host itself first."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
