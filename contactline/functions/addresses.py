"""E-mail address functions: find, de-obfuscate, clean, judge, categorise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactline import rules as r
from contactline.functions.text import SPACE, any_of, once, strip
from contactline.rules import (
    ADDRESS_PATTERN,
    ADDRESS_STRIP,
    CATEGORIES,
    DEFAULT_RULES,
    Rules,
    longest_first,
)

_LOCAL = r"[A-Za-z0-9._%+-]"
# Word characters are letters, numbers of any kind and "_"; the edge of a word is spelled out, since
# Java's own counts combining marks and joiners as word characters and leaves out signs like "½".
_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_DOMAIN = ADDRESS_PATTERN.split("@")[1].removesuffix(r"\b") + rf"(?!{_WORD})"

# Finds what ADDRESS_PATTERN finds, in linear time. A run of local-part characters can only lead
# to an address from its first word boundary (what follows the run is the same for all of them),
# so each run is entered once: at its start, or where the last match stopped (\G).
_FIND = rf"(?U)(?={_LOCAL})(?:(?<!{_LOCAL})|\G)(?>{_LOCAL}*?{_EDGE})({_LOCAL}++@{_DOMAIN})"

_AT = rf"(?:\[{SPACE}*+at{SPACE}*+\]|\({SPACE}*+at{SPACE}*+\))"
_DOT = rf"(?:\[{SPACE}*+dot{SPACE}*+\]|\({SPACE}*+dot{SPACE}*+\))"


def _with_blanks(core: str) -> str:
    """The core with all blanks around it. A run of blanks is tried once: from its start."""
    return rf"(?:{SPACE}(?<!{SPACE}{SPACE}){SPACE}*+{core}|{core}){SPACE}*+"


def find_addresses(text: Column) -> Column:
    """All addresses in a text, as written, in order."""
    return once(text, _plain)


def _plain(text: Column) -> Column:
    return F.when(
        text.contains("@"), F.regexp_extract_all(text, F.lit(_FIND), F.lit(1))
    ).otherwise(F.array().cast("array<string>"))


def may_hold_address(text: Column) -> Column:
    """An address needs an ``@``, or an ``[at]`` that stands for one."""
    return text.contains("@") | text.rlike(rf"(?Ui){_AT}")


# Characters that an address or one of its spellings can have, blanks included. Nothing below
# reaches across any other character, so a stretch of these without an "@" or a bracket holds no
# address and can go; the characters around the other stretches stay.
_STRETCH = r"A-Za-z0-9._%+\-\s\x1c-\x1f\])\u017f\u212a\u0130\u0131"
_NO_ADDRESS = rf"(?U)(?<![{_STRETCH}@\[(])[{_STRETCH}]++(?![@\[(])"


def spell_out(text: Column) -> Column:
    """Text with ``[at]``/``(dot)`` spellings resolved and blanks around ``@`` and ``.`` removed."""
    resolved = F.regexp_replace(
        text,
        rf"(?Ui)(?<={_LOCAL}){SPACE}*+{_AT}{SPACE}*([A-Za-z0-9._%+\-\s\x1c-\x1f\[\]()]+)",
        "@$1",
    )
    resolved = F.regexp_replace(resolved, rf"(?Ui){_with_blanks(_DOT)}", ".")
    # most texts have no brackets
    bracketed = text.contains("[") | text.contains("(")
    text = F.when(bracketed, resolved).otherwise(text)
    text = F.regexp_replace(text, rf"(?U){_with_blanks('@')}", "@")
    return F.regexp_replace(text, rf"(?U){_with_blanks('[.]')}", ".")


def find_obfuscated(text: Column) -> Column:
    """Addresses of the spelled-out text, cleaned."""
    return once(text, _spelled_out)


def _spelled_out(text: Column) -> Column:
    relevant = F.regexp_replace(text, _NO_ADDRESS, "")
    found = F.regexp_extract_all(once(relevant, spell_out), F.lit(_FIND), F.lit(1))
    return F.when(may_hold_address(text), F.transform(found, clean)).otherwise(
        F.array().cast("array<string>")
    )


def find_in_text(text: Column) -> Column:
    """Addresses of a visible text: spelled-out ones, then plain ones."""
    return once(text, lambda t: F.concat(_spelled_out(t), _plain(t)))


def mailto_address(href: Column) -> Column:
    """Address of a ``mailto:`` link: after the scheme, before ``?``, percent-decoded."""
    value = strip(F.split_part(F.substr(strip(href), F.lit(8)), F.lit("?"), F.lit(1)))
    # url_decode reads "+" as a blank and rejects a stray "%": spell both so that they survive.
    safe = F.regexp_replace(F.replace(value, F.lit("+"), F.lit("%2B")),
                            r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(safe)


def clean(address: Column) -> Column:
    return F.trim(F.lower(address), F.lit(ADDRESS_STRIP))


def local_part(address: Column) -> Column:
    return F.split_part(address, F.lit("@"), F.lit(1))


def domain_part(address: Column) -> Column:
    return F.split_part(address, F.lit("@"), F.lit(2))


def _among(c: Column, words) -> Column:
    return c.isin(*words) if words else F.lit(False)


def _matches(c: Column, words, shape: str) -> Column:
    return c.rlike(shape.format(any_of(words))) if words else F.lit(False)


def _quoting(text: str, words, fits) -> Column:
    """A reason that quotes the first of the words that fits. Looked up only for rejected rows."""
    options = F.array(*(F.lit(w) for w in words)) if words else F.array(F.lit(""))
    before, after = text.split("{}")
    return F.concat(F.lit(before), F.get(F.filter(options, fits), F.lit(0)), F.lit(after))


def ignore_reason(email: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Why a cleaned address is not used; null for a valid one. The first rule that applies
    answers. Where several names of a list fit, the longest is quoted."""
    return once(
        F.struct(email.alias("email"), local_part(email).alias("user"),
                 domain_part(email).alias("domain")),
        lambda e: _reason(e.email, e.user, e.domain, rules),
    )


def _reason(email: Column, user: Column, domain: Column, rules: Rules) -> Column:
    return (
        F.when(F.coalesce(~email.contains("@"), F.lit(True)), r.IGNORED_FORMAT)
        .when(~email.rlike(rf"(?U)\A{ADDRESS_PATTERN}\z"), r.IGNORED_PATTERN)
        .when(_among(email, rules.placeholder_addresses), r.IGNORED_PLACEHOLDER)
        .when(
            _matches(email, rules.asset_extensions, r"(?:{})\z"),
            _quoting(r.IGNORED_ASSET, rules.asset_extensions, email.endswith),
        )
        .when(_among(user, rules.automated_local_parts), r.IGNORED_AUTOMATED)
        .when(
            _matches(user, rules.ignored_local_prefixes, r"\A(?:{})"),
            _quoting(r.IGNORED_PREFIX,
                     rules.ignored_local_prefixes, user.startswith),
        )
        .when(
            _matches(domain, rules.technical_domains, r"{}"),
            _quoting(r.IGNORED_TECHNICAL,
                     longest_first(rules.technical_domains), domain.contains),
        )
        .when(
            _matches(domain, rules.regulator_domains, r"(?:\A|\.)(?:{})\z"),
            _quoting(r.IGNORED_REGULATOR, longest_first(rules.regulator_domains),
                     lambda d: (domain == d) | domain.endswith(F.concat(F.lit("."), d))),
        )
        .when(
            _matches(domain, rules.government_suffixes, r"(?:{})\z"),
            r.IGNORED_GOVERNMENT,
        )
    )


def category(address: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """Category of an address by its local part."""
    def by_words(user: Column) -> Column:
        steps = F
        for name, words in rules.category_words:
            if words:
                steps = steps.when(user.rlike(any_of(words)), name)
        return steps.when(user.startswith(rules.info_prefix), CATEGORIES[4]).otherwise(CATEGORIES[5])

    return once(local_part(F.lower(address)), by_words)
