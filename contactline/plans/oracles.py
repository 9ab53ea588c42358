"""SQL that computes what the registered queries compute, for a second engine to check.

Written from the rules, not from the column functions: hosts are cut with list functions where
those use patterns, own domains and first pages with joins and windows where those use minima.
"""

from __future__ import annotations

from contactline import rules as r
from contactline.plans import inputs
from contactline.plans.inputs import in_sql


def _lits(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _list(words) -> str:
    return f"[{_lits(words)}]"


_STRIP = "'.,;:\"''()[]'"
_ADDRESS_FULL = rf"'\A{r.ADDRESS_PATTERN}\z'"

# ---------------------------------------------------------------- pieces


def _scheme(u: str) -> str:
    return rf"lower(regexp_extract({_tidy(u)}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def _tidy(u: str) -> str:
    return f"ltrim({u}, ' ')"


def _netloc(u: str) -> str:
    return rf"regexp_extract({_tidy(u)}, '^([A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 2)"


def _path(u: str) -> str:
    return rf"regexp_extract({_tidy(u)}, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)', 3)"


def _host_of(u: str) -> str:
    return f"CASE WHEN {_netloc(u)} <> '' THEN {_netloc(u)} ELSE split_part({_path(u)}, '/', 1) END"


def _root(host: str) -> str:
    """Registrable domain by counting labels."""
    bare = f"trim(split_part(lower({host}), ':', 1), '.')"
    labels = f"string_split({bare}, '.')"
    return (
        f"CASE WHEN len({labels}) <= 2 THEN {bare} "
        f"WHEN list_contains({_list(r.SECOND_LEVEL_LABELS)}, {labels}[-2]) "
        f"THEN array_to_string({labels}[-3:], '.') ELSE array_to_string({labels}[-2:], '.') END"
    )


def _homepage(u: str) -> str:
    whole = (
        f"CASE WHEN {_scheme(u)} <> '' AND {_netloc(u)} <> '' THEN {u} ELSE 'https://' || {u} END"
    )
    return (
        f"CASE WHEN {u} = '' THEN '' ELSE {_scheme(f'({whole})')} || '://' || "
        f"{_netloc(f'({whole})')} || '/' END"
    )


def _under(host: str, domains) -> str:
    """Host equals or lies under one of the domains."""
    return (
        f"len(list_filter({_list(domains)}, lambda d: {host} = d "
        f"OR ends_with({host}, '.' || d))) > 0"
    )


_BLOCKED = [s.lstrip(".") for s in r.BLOCKED_SUFFIXES] + list(r.BLOCKED_DOMAINS)


def _block_host(u: str) -> str:
    return (
        f"split_part(lower(CASE WHEN {_netloc(u)} <> '' THEN {_netloc(u)} "
        f"ELSE {_netloc(f"('http://' || {u})")} END), ':', 1)"
    )


def _clean(raw: str) -> str:
    return f"trim(lower({raw}), {_STRIP})"


def _lit(text: str) -> str:
    return _lits([text])


def _reason(e: str) -> str:
    user, domain = f"split_part({e}, '@', 1)", f"split_part({e}, '@', 2)"
    out = ["CASE", f"WHEN {e} IS NULL OR position('@' IN {e}) = 0 THEN {_lit(r.IGNORED_FORMAT)}",
           f"WHEN NOT regexp_matches({e}, {_ADDRESS_FULL}) THEN {_lit(r.IGNORED_PATTERN)}",
           f"WHEN {e} IN ({_lits(r.PLACEHOLDER_ADDRESSES)}) THEN {_lit(r.IGNORED_PLACEHOLDER)}"]
    for x in r.ASSET_EXTENSIONS:
        out.append(f"WHEN ends_with({e}, '{x}') THEN {_lit(r.IGNORED_ASSET.format(x))}")
    out.append(f"WHEN {user} IN ({_lits(r.AUTOMATED_LOCAL_PARTS)}) THEN {_lit(r.IGNORED_AUTOMATED)}")
    for w in r.IGNORED_LOCAL_PREFIXES:
        out.append(f"WHEN starts_with({user}, '{w}') THEN {_lit(r.IGNORED_PREFIX.format(w))}")
    for d in r.longest_first(r.TECHNICAL_DOMAINS):
        out.append(f"WHEN contains({domain}, '{d}') THEN {_lit(r.IGNORED_TECHNICAL.format(d))}")
    for d in r.longest_first(r.REGULATOR_DOMAINS):
        out.append(f"WHEN {domain} = '{d}' OR ends_with({domain}, '.{d}') "
                   f"THEN {_lit(r.IGNORED_REGULATOR.format(d))}")
    for s in r.GOVERNMENT_SUFFIXES:
        out.append(f"WHEN ends_with({domain}, '{s}') THEN {_lit(r.IGNORED_GOVERNMENT)}")
    return "\n".join(out) + " END"


def _category(e: str) -> str:
    user = f"split_part({e}, '@', 1)"
    out = ["CASE"]
    for name, words in r.CATEGORY_WORDS.items():
        tests = " OR ".join(f"contains({user}, '{w}')" for w in words)
        out.append(f"WHEN {tests} THEN '{name}'")
    out.append(f"WHEN starts_with({user}, '{r.INFO_PREFIX}') THEN 'Info Email' ELSE 'General Email' END")
    return " ".join(out)


_BLANKS = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"
_AT_MARK = r"'(?i)(?:\[\s*at\s*\]|\(\s*at\s*\))'"
_DOT_MARK = r"'(?i)(?:\[\s*dot\s*\]|\(\s*dot\s*\))'"


def _closed_up(pieces: str, joint: str) -> str:
    """Pieces joined without blanks next to the joints. What this does to the text's own ends does
    not matter: no address has blanks."""
    return f"array_to_string(list_transform({pieces}, lambda p: trim(p, {_BLANKS})), '{joint}')"


def _spell_out(t: str) -> str:
    """Text with spelled-out addresses written plainly.

    The text is cut at every ``[at]`` and put together again from left to right. A mark becomes "@"
    if a character of an address stands before it (blanks aside), something that a domain may be
    spelled with follows, and it does not itself belong to the spelled domain of an earlier mark.
    """
    part = "{{'text': {0}, 'mark': {1}, 'more': {2}, 'in_domain': false}}"
    marks = f"regexp_extract_all({t}, {_AT_MARK})"
    cut = (
        f"list_transform(list_zip(regexp_split_to_array({t}, {_AT_MARK}), "
        f"list_prepend('', {marks})), "
        f"lambda z, i: {part.format('z[1]', 'z[2]', f'i <= len({marks})')})"
    )
    spelled = r"'^[A-Za-z0-9._%+\-\s\[\]()]+$'"
    before = rf"regexp_matches(trim(so_far.text, {_BLANKS}), '[A-Za-z0-9._%+-]$')"
    # brackets are among the characters that may follow, so those of another mark are too
    after = (r"(regexp_matches(part.text, '^[A-Za-z0-9._%+\-\s\[\]()]') "
             "OR part.text = '' AND part.more)")
    makes = f"(NOT so_far.in_domain AND {before} AND {after})"
    at = f"rtrim(so_far.text, {_BLANKS}) || '@' || ltrim(part.text, {_BLANKS})"
    joined = (
        f"list_reduce({cut}, lambda so_far, part: {{'text': CASE WHEN {makes} THEN {at} "
        f"ELSE so_far.text || part.mark || part.text END, 'mark': '', 'more': true, "
        f"'in_domain': (so_far.in_domain OR {makes}) AND "
        f"(part.text = '' OR regexp_matches(part.text, {spelled}))}}).text"
    )
    dots = _closed_up(f"regexp_split_to_array({joined}, {_DOT_MARK})", ".")
    return _closed_up(f"string_split({_closed_up(f'string_split({dots}, {chr(39)}@{chr(39)})', '@')}, '.')", ".")


def _find(t: str) -> str:
    """All addresses of a text.

    The engine's word boundary knows ASCII letters only. So accented letters are first written as
    a mark of word characters that no domain can hold, and what a match has up to such a mark, with
    the word it is part of, is cut off again.
    """
    marked = rf"regexp_replace({t}, '[À-ÖØ-öø-ɏ]', '__0__', 'g')"
    return (
        rf"list_filter(list_transform(regexp_extract_all({marked}, '{r.ADDRESS_PATTERN}'), "
        r"lambda m: regexp_replace(m, '^.*__0__[A-Za-z0-9_]*', '')), "
        r"lambda m: NOT starts_with(m, '@'))"
    )


def _absent(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('', 'nan') THEN NULL ELSE trim({c}) END"


# ---------------------------------------------------------------- shared common table expressions

_MAPPED = f"raw_services AS ({in_sql(inputs.SERVICES_RAW)})"
_SERVICES = f"""{_MAPPED},
services AS (
  SELECT row_number() OVER (ORDER BY c_custkey) AS service_num, c_custkey,
         trim(name) AS service_name, website AS service_website, postcode, segment
  FROM raw_services WHERE {_absent('name')} IS NOT NULL)"""
_RESULTS = f"""results AS (
  SELECT service_num, rank, link FROM ({in_sql(inputs.SEARCH_RESULTS)}) l
  JOIN services ON o_custkey = c_custkey)"""


def _located(services: str = "services") -> str:
    """Website and site key of each service, from ``services`` and ``results``."""
    # each URL part is a column of its own, so that it is worked out once per row
    return f"""result_hosts AS (
  SELECT service_num, rank, link, {_block_host('link')} AS host FROM results WHERE link <> ''),
listed_hosts AS (
  SELECT host FROM (SELECT DISTINCT host FROM result_hosts) WHERE {_under('host', _BLOCKED)}),
best AS (
  SELECT service_num, link,
         row_number() OVER (PARTITION BY service_num ORDER BY rank) AS rn
  FROM result_hosts WHERE host NOT IN (SELECT host FROM listed_hosts)),
found AS (SELECT service_num, {_homepage('link')} AS website FROM best WHERE rn = 1),
websites AS (
  SELECT s.service_num, s.service_name, coalesce({_absent('s.service_website')}, f.website) AS website
  FROM {services} s LEFT JOIN found f ON s.service_num = f.service_num),
website_hosts AS (SELECT *, {_host_of('website')} AS host FROM websites),
located AS (
  SELECT service_num, service_name, website, nullif({_root('host')}, '') AS site_key
  FROM website_hosts),
sites AS (
  SELECT site_key, CASE WHEN regexp_matches(trim(website), '^https?://') THEN trim(website)
                        ELSE 'https://' || trim(website) END AS base_url
  FROM (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY service_num) AS rn
        FROM located WHERE site_key IS NOT NULL) WHERE rn = 1)"""


_LOCATED = f"{_SERVICES},\n{_RESULTS},\n{_located()}"

_JUDGED = f"""judged AS (
  SELECT *, {_reason('email')} AS ignore_reason
  FROM (SELECT *, {_clean('raw')} AS email FROM ({in_sql(inputs.PAGE_ADDRESSES)}) a) b)"""

# own-domain rule on valid(site_key, email) and domains(site_key, root_domain)
_KEPT = f"""flagged AS (
  SELECT DISTINCT v.site_key, v.email, {_category('v.email')} AS category, v.root_domain,
         d.root_domain IS NOT NULL AS is_own
  FROM (SELECT site_key, email, {_root("split_part(email, '@', 2)")} AS root_domain FROM valid) v
  LEFT JOIN (SELECT DISTINCT site_key, root_domain FROM domains) d
    ON v.site_key = d.site_key AND v.root_domain = d.root_domain),
kept AS (
  SELECT *, is_own OR NOT bool_or(is_own) OVER (PARTITION BY site_key) AS kept FROM flagged)"""

_CONTACTS = """contacts AS (
  SELECT site_key, {lists}, count(*) AS n_addresses
  FROM kept WHERE kept GROUP BY site_key)""".format(lists=", ".join(
    f"coalesce(string_agg(email, ', ' ORDER BY email) FILTER (WHERE category = '{c}'), '') AS \"{c}\""
    for c in r.CATEGORIES))

def _in_parts(rows: str, keys: str, value: str, size: int) -> str:
    """Parts of cells: values by the half part in which they begin, halves numbered anew."""
    return f"""begun AS (
  SELECT {keys}, {value} AS entry,
         coalesce(sum(strlen({value}) + 2) OVER (PARTITION BY {keys} ORDER BY {value}
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_byte
  FROM {rows}),
halves AS (
  SELECT {keys}, at_byte // {size // 2} AS half, min(at_byte) AS start, count(*) AS n,
         string_agg(entry, ', ' ORDER BY entry) AS text
  FROM begun GROUP BY ALL)
SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY half) AS part, start, n, text FROM halves"""


_VALID_JUDGED = f"""valid AS (SELECT DISTINCT site_key, email FROM judged WHERE ignore_reason IS NULL),
domains AS (SELECT DISTINCT site_key, {_root(_host_of('url'))} AS root_domain FROM judged)"""


def _records(reasons: str) -> str:
    """Site records from ``contacts`` and a relation of (site_key, reason)."""
    cats = ", ".join(f"coalesce(c.\"{c}\", '') AS \"{c}\"" for c in r.CATEGORIES)
    return f"""records AS (
  SELECT s.site_key, {cats}, coalesce(n_addresses, 0) AS n_addresses,
         CASE WHEN n_addresses > 0 THEN 'Success' ELSE 'Failed' END AS "Status",
         CASE WHEN n_addresses > 0 THEN '' ELSE coalesce(s.reason, 'No email found') END AS "Failure Reason"
  FROM {reasons} s LEFT JOIN contacts c ON s.site_key = c.site_key)"""


def _navigation(e: str) -> str:
    steps = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({e}), {_lit(w)})' for w in words)} THEN {_lit(reason)}"
        for reason, words in r.ERROR_WORDS.items())
    return f"CASE {steps} ELSE coalesce({e}, '') END"


def _homes() -> str:
    """Homepage outcomes from ``fetches`` (one row per load) and ``sites``."""
    return f"""loads AS (
  SELECT * FROM (
    SELECT *, lower(rtrim(requested_url, '/')) AS page_key,
           row_number() OVER (PARTITION BY site_key, lower(rtrim(requested_url, '/')), attempt
                              ORDER BY fetch_id) AS copy
    FROM fetches) WHERE copy = 1),
tries AS (
  SELECT s.site_key, s.base_url, a.fetch_id AS id1, a.final_url AS url1, a.status AS st1,
         coalesce(a.has_html, false) AS h1, {_navigation('a.error')} AS e1,
         b.fetch_id AS id2, b.final_url AS url2, b.status AS st2,
         coalesce(b.has_html, false) AS h2, {_navigation('b.error')} AS e2
  FROM sites s
  LEFT JOIN loads a ON a.site_key = s.site_key AND a.attempt = 1
                   AND a.page_key = lower(rtrim(s.base_url, '/'))
  LEFT JOIN loads b ON b.site_key = s.site_key AND b.attempt = 2
                   AND b.page_key = lower(rtrim(s.base_url, '/'))),
used AS (
  SELECT *, (NOT h1 OR e1 <> '') AND (h2 OR st2 IS NOT NULL) AS second,
         coalesce(st1, CASE WHEN h1 THEN 200 END) AS first_status FROM tries),
homes AS (
  SELECT site_key, base_url,
         CASE WHEN second THEN id2 ELSE id1 END AS fetch_id,
         CASE WHEN second THEN url2 ELSE url1 END AS final_url,
         CASE WHEN second THEN h2 ELSE h1 END AS has_html,
         CAST(coalesce(CASE WHEN second THEN coalesce(st2, first_status) ELSE first_status END, 200)
              AS INTEGER) AS status,
         CASE WHEN second THEN e2 ELSE e1 END AS reason
  FROM used)"""


_REASONS = f"""reasons AS (
  SELECT h.site_key,
         CASE WHEN NOT h.has_html AND h.reason <> '' THEN h.reason
              WHEN NOT h.has_html THEN '{r.REASON_UNREACHABLE}'
              WHEN h.status = 403 THEN '{r.REASON_FORBIDDEN}'
              WHEN h.status = 202 THEN '{r.REASON_ACCEPTED}'
              WHEN v.all_404 THEN '{r.REASON_NOT_FOUND}'
              WHEN h.reason <> '' THEN h.reason ELSE '{r.REASON_NO_ADDRESS}' END AS reason
  FROM homes h LEFT JOIN (SELECT site_key, bool_and(status = 404) AS all_404
                          FROM visited GROUP BY site_key) v ON h.site_key = v.site_key)"""

_EVENT_LOADS = f"""fetches AS ({in_sql(inputs.LOADS)}),
event_sites AS (SELECT DISTINCT site_key, 'https://' || site_key AS base_url FROM fetches),
{_homes().replace('FROM sites s', 'FROM event_sites s')},
visited AS (
  SELECT site_key, status FROM homes WHERE has_html
  UNION ALL
  SELECT site_key, coalesce(status, CASE WHEN has_html THEN 200 ELSE 404 END) FROM loads
  WHERE NOT ends_with(page_key, '.co.uk')),
{_REASONS}"""

_ENRICHED_COLUMNS = ", ".join(f"coalesce(r.\"{c}\", '') AS \"{c}\"" for c in r.CATEGORIES)
_ENRICHED = f"""enriched AS (
  SELECT l.service_num, l.service_name AS "Service Name", coalesce(l.website, '') AS "Service Website",
         {_ENRICHED_COLUMNS}, coalesce(r."Status", 'Failed') AS "Status",
         CASE WHEN l.website IS NULL THEN '{r.REASON_NO_WEBSITE}'
              ELSE coalesce(r."Failure Reason", '{r.REASON_UNREACHABLE}') END AS "Failure Reason"
  FROM located l LEFT JOIN records r ON l.site_key = r.site_key)"""
_FROM_TABLES = f"""WITH {_LOCATED},
{_JUDGED},
{_VALID_JUDGED},
{_KEPT},
{_CONTACTS},
{_EVENT_LOADS},
{_records('reasons')},
{_ENRICHED}"""

# ---------------------------------------------------------------- pages by pattern

# The given pages have regular markup, so patterns can stand in for a parser.
_ANCHORS = """anchors AS (
  SELECT fetch_id, base, body, tag, pos - 1 AS pos,
         regexp_extract(tag, 'href="([^"]*)"', 1) AS href,
         regexp_replace(regexp_replace(tag, '^<a [^>]*>', ''), '</a>$', '') AS inner_html
  FROM (SELECT fetch_id, base, body, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos
        FROM (SELECT fetch_id, base, body,
                     regexp_extract_all(body, '<a [^>]*>.*?</a>', 0, 's') AS tags FROM bodies)))"""
# An anchor is in a link zone if it stands between the start and end of one.
_ZONE = """(contains(regexp_extract(body, '<nav>.*?</nav>', 0, 's'), tag)
          OR contains(regexp_extract(body, '<footer>.*', 0, 's'), tag))"""


def _shown(html: str) -> str:
    """Text of regular markup: without scripts, styles, comments, tags; known entities decoded."""
    t = (rf"regexp_replace({html}, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<[^>]*>',"
         r" ' ', 'gs')")
    for entity, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    return t


_SITE_BODIES = f"""fetched AS ({in_sql(inputs.SITE_PAGES)}),
fetches AS (SELECT * EXCLUDE (html), html, html <> '' AS has_html FROM fetched),
bodies AS (SELECT fetch_id, requested_url AS base, html AS body FROM fetches),
{_ANCHORS},
raw_found AS (
  SELECT fetch_id, 'mailto' AS source,
         url_decode(replace(trim(split_part(substr(href, 8), '?', 1)), '+', '%2B')) AS raw
  FROM anchors WHERE starts_with(lower(href), 'mailto:')
  UNION
  SELECT fetch_id, 'html', unnest({_find('body')}) FROM bodies
  UNION
  SELECT fetch_id, source, unnest(list_concat(
           list_transform({_find(_spell_out('shown'))},
                          lambda x: {_clean('x')}),
           {_find('shown')}))
  FROM (SELECT fetch_id, 'text' AS source, {_shown('body')} AS shown FROM bodies
        UNION ALL
        SELECT fetch_id, 'priority',
               {_shown("regexp_extract(body, '<footer>.*?</footer>', 0, 's')")} FROM bodies)),
page_found AS (
  SELECT *, {_reason('email')} AS ignore_reason
  FROM (SELECT f.*, {_clean('raw')} AS email FROM raw_found f WHERE raw <> ''))"""


def _has_word(c: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains(lower({c}), w))) > 0"


_KEY = "lower(rtrim({}, '/'))"
_RESOLVED = (
    f"CASE WHEN starts_with(href, '/') THEN {_scheme('base')} || '://' || {_netloc('base')} || href "
    "ELSE href END"
)


# Links of ``links`` (link_id, base, href) resolved: parts by position of the delimiters, then the
# segments of the path one after the other.
_WITHOUT_SCHEME = "regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*:', '')"
_TAIL = "regexp_replace({0}, '^//[^/?#]*', '')"


def _cut_up(name: str, url: str) -> str:
    """Columns ``<name>_s`` (scheme), ``_h`` (host), ``_p`` (path and parameters), ``_q`` and ``_f``."""
    rest = _WITHOUT_SCHEME.format(url)
    tail = _TAIL.format(rest)
    before = f"split_part({tail}, '#', 1)"
    return f"""lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS {name}_s,
         regexp_extract({rest}, '^//([^/?#]*)', 1) AS {name}_h,
         split_part({before}, '?', 1) AS {name}_p,
         CASE WHEN contains({before}, '?') THEN substr({before}, position('?' IN {before}) + 1) ELSE '' END AS {name}_q,
         CASE WHEN contains({tail}, '#') THEN substr({tail}, position('#' IN {tail}) + 1) ELSE '' END AS {name}_f"""


_FULL_URLS = f"""cut_up AS (SELECT link_id, href, {_cut_up('b', 'base')}, {_cut_up('r', 'href')} FROM links),
dirs AS (
  SELECT *, regexp_extract(b_p, '^(.*/)', 1) AS dir,
         regexp_extract(r_p, ';[^/;]*$', 0) AS r_params,
         CASE WHEN contains(r_p, ';') THEN regexp_replace(r_p, '^((?:.*/)?[^/;]*);[^/]*$', '\\1') ELSE r_p END AS r_path
  FROM cut_up),
raw AS (
  SELECT *, string_split(CASE WHEN starts_with(r_path, '/') THEN r_path
                              ELSE CASE WHEN dir = '' AND b_h <> '' THEN '/' ELSE dir END || r_path END, '/') AS given
  FROM dirs),
kept AS (
  SELECT *, CASE WHEN starts_with(r_path, '/') THEN given
                 ELSE [given[i] FOR i IN range(1, len(given) + 1) IF given[i] <> '' OR i IN (1, len(given))] END AS segments
  FROM raw),
walked AS (
  SELECT *, list_reduce(list_transform(segments, lambda s: [s]),
              lambda a, x: CASE WHEN x[1] = '..' THEN a[:-2] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END,
              []::VARCHAR[]) AS path_parts
  FROM kept),
paths AS (
  SELECT *, array_to_string(CASE WHEN segments[-1] IN ('.', '..') THEN list_append(path_parts, '') ELSE path_parts END, '/') AS path
  FROM walked),
full_urls AS (
  SELECT link_id,
         CASE WHEN r_s NOT IN ('', b_s) THEN href
              WHEN r_h <> '' THEN b_s || '://' || r_h || r_p ELSE b_s || '://' || b_h
                || CASE WHEN r_p = '' THEN b_p
                        ELSE CASE WHEN starts_with(path, '/') THEN '' ELSE '/' END || path
                             || CASE WHEN r_params = ';' THEN '' ELSE r_params END END END
         || CASE WHEN r_s NOT IN ('', b_s) THEN ''
                 ELSE CASE WHEN r_q <> '' THEN '?' || r_q WHEN r_h = '' AND r_p = '' AND b_q <> '' THEN '?' || b_q ELSE '' END
                      || CASE WHEN r_f <> '' THEN '#' || r_f ELSE '' END END AS full_url
  FROM paths)"""


def _candidates(homes: str) -> str:
    """Ranked candidates of ``homes`` (fetch_id, base_url, final_url)."""
    return f"""links AS (
  SELECT fetch_id, base, pos, {_ZONE} AS in_zone, {_RESOLVED} AS url, {_shown('inner_html')} AS text
  FROM anchors
  WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(lower(href), 'javascript:')
    AND NOT starts_with(lower(href), 'mailto:') AND NOT starts_with(lower(href), 'tel:')),
staged AS (
  SELECT fetch_id, CASE WHEN in_zone THEN 1 ELSE 2 END AS stage, pos, url FROM links
  WHERE ({_root(_netloc('url'))}) = ({_root(_netloc('base'))})
    AND NOT ({_has_word(_path('url'), r.PATH_STOP_WORDS)})
    AND (({_has_word('text', r.LINK_WORDS)}) OR ({_has_word(_path('url'), r.LINK_WORDS)}))
  UNION ALL
  SELECT fetch_id, 3, pos - 1, {_scheme('base')} || '://' || {_netloc('base')} || path
  FROM (SELECT fetch_id, base, unnest({_list(r.COMMON_PATHS)}) AS path,
               generate_subscripts({_list(r.COMMON_PATHS)}, 1) AS pos FROM bodies)),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY fetch_id, page_key ORDER BY stage, pos) AS seen
  FROM (SELECT s.*, {_KEY.format('s.url')} AS page_key FROM staged s)),
planned AS (
  SELECT f.fetch_id, row_number() OVER (PARTITION BY f.fetch_id ORDER BY stage, pos) AS rank,
         f.url, f.page_key
  FROM firsts f JOIN {homes} h ON f.fetch_id = h.fetch_id
  WHERE seen = 1 AND f.page_key <> {_KEY.format('h.base_url')}
    AND f.page_key <> {_KEY.format('h.final_url')})"""


_STEPS = f"""page_loads AS (
  SELECT site_key, page_key, fetch_id, final_url, status, has_html
  FROM (SELECT *, row_number() OVER (PARTITION BY site_key, page_key ORDER BY attempt, fetch_id) AS n
        FROM loads) WHERE n = 1),
steps AS (
  SELECT h.site_key, p.rank, p.url, p.page_key, l.fetch_id, l.final_url,
         coalesce(l.has_html, false) AS has_html,
         CAST(coalesce(l.status, CASE WHEN l.has_html THEN 200 ELSE 404 END) AS INTEGER) AS status
  FROM homes h JOIN planned p ON h.fetch_id = p.fetch_id
  LEFT JOIN page_loads l ON l.site_key = h.site_key AND l.page_key = p.page_key
  WHERE h.has_html)"""

# A visit step by step: one round per candidate, with the list of canonical URLs used so far.
_VISIT = f"""{_STEPS},
walk AS (
  SELECT site_key, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS page_seq, true AS taken,
         list_distinct([{_KEY.format('final_url')}, {_KEY.format('base_url')}]) AS used
  FROM homes WHERE has_html
  UNION ALL
  SELECT w.site_key, s.rank,
         w.page_seq + CASE WHEN list_contains(w.used, s.page_key) THEN 0 ELSE 1 END,
         NOT list_contains(w.used, s.page_key),
         CASE WHEN list_contains(w.used, s.page_key) THEN w.used
              ELSE list_distinct(w.used || [s.page_key,
                   CASE WHEN s.has_html THEN {_KEY.format('s.final_url')} ELSE s.page_key END]) END
  FROM walk w JOIN steps s ON s.site_key = w.site_key AND s.rank = w.rank + 1
  WHERE len(w.used) < {r.MAX_PAGES}),
within_budget AS (
  SELECT site_key, CAST(0 AS BIGINT) AS page_seq, fetch_id, base_url AS url, final_url, status, has_html
  FROM homes WHERE has_html
  UNION ALL
  SELECT w.site_key, w.page_seq, s.fetch_id, s.url, s.final_url, s.status, s.has_html
  FROM walk w JOIN steps s ON s.site_key = w.site_key AND s.rank = w.rank WHERE w.taken AND w.rank > 0)"""


def _first_complete(rows: str, doms: str) -> str:
    """First page after which all categories are filled: the rule on every prefix of pages.

    ``rows`` is (site_key, page_seq, email), ``doms`` (site_key, root_domain, page_seq).
    """
    return f"""prefixes AS (
  SELECT p.site_key, p.page_seq AS upto, a.email, {_category('a.email')} AS category,
         EXISTS (SELECT 1 FROM {doms} d WHERE d.site_key = p.site_key AND d.page_seq <= p.page_seq
                 AND d.root_domain = {_root("split_part(a.email, '@', 2)")}) AS is_own
  FROM (SELECT DISTINCT site_key, page_seq FROM {rows}
        UNION SELECT DISTINCT site_key, page_seq FROM {doms}) p
  JOIN {rows} a ON a.site_key = p.site_key AND a.page_seq <= p.page_seq),
complete AS (
  SELECT site_key, min(upto) AS last_seq FROM (
    SELECT site_key, upto FROM (
      SELECT *, is_own OR NOT bool_or(is_own) OVER (PARTITION BY site_key, upto) AS kept FROM prefixes)
    WHERE kept GROUP BY site_key, upto HAVING count(DISTINCT category) = {len(r.CATEGORIES)})
  GROUP BY site_key)"""


_SEEN = f"""{_REASONS},
valid AS (
  SELECT DISTINCT v.site_key, f.email FROM visited v JOIN page_found f ON f.fetch_id = v.fetch_id
  WHERE v.has_html AND f.ignore_reason IS NULL),
domains AS (
  SELECT DISTINCT site_key, {_root(_host_of('final_url'))} AS root_domain
  FROM visited WHERE has_html),
{_KEPT},
{_CONTACTS},
{_records('reasons')}"""
_PAGE_SITES = f"""{_SITE_BODIES},
sites AS (SELECT DISTINCT site_key, 'https://' || site_key || '/' AS base_url FROM fetches)"""
# All candidates are visited.
_WHOLE = f"""{_homes()},
{_candidates('homes')},
{_STEPS},
visited AS (
  SELECT site_key, fetch_id, base_url AS url, final_url, status, has_html FROM homes WHERE has_html
  UNION ALL
  SELECT site_key, fetch_id, url, final_url, status, has_html FROM steps),
{_SEEN}"""
_BUDGETED = f"""WITH RECURSIVE {_PAGE_SITES},
{_homes()},
{_candidates('homes')},
{_VISIT},
budget_addresses AS (
  SELECT DISTINCT b.site_key, b.page_seq, f.email FROM within_budget b
  JOIN page_found f ON f.fetch_id = b.fetch_id WHERE b.has_html AND f.ignore_reason IS NULL),
budget_domains AS (
  SELECT site_key, page_seq, {_root(_host_of('final_url'))} AS root_domain
  FROM within_budget WHERE has_html),
{_first_complete('budget_addresses', 'budget_domains')},
visited AS (
  SELECT b.* FROM within_budget b LEFT JOIN complete c ON b.site_key = c.site_key
  WHERE c.last_seq IS NULL OR b.page_seq <= c.last_seq)"""

_PAGE_LOCATED = f"""services AS ({in_sql(inputs.PAGE_SERVICES)}),
results AS ({in_sql(inputs.PAGE_RESULTS)}),
{_located()}"""

# ---------------------------------------------------------------- the statements

ORACLES: dict[str, str] = {
    "url_parts": f"""
WITH u AS ({in_sql(inputs.URLS)})
SELECT page_id, {_scheme('url')} AS scheme, {_netloc('url')} AS netloc, {_path('url')} AS path,
       {_root(_netloc('url'))} AS root_domain, {_root(_host_of('url'))} AS site_key,
       CASE WHEN starts_with(trim(url), 'http://') OR starts_with(trim(url), 'https://')
            THEN trim(url) ELSE 'https://' || trim(url) END AS full_url,
       lower(rtrim(url, '/')) AS canonical, {_homepage('url')} AS homepage
FROM u""",
    "site_pages": f"""
SELECT site_key, count(*) AS n_pages, {_root('site_key')} AS root_domain
FROM (SELECT lower({_netloc('url')}) AS site_key FROM pages) GROUP BY site_key""",
    "blocked_hosts": f"""
WITH u AS ({in_sql(inputs.PROBED_URLS)})
SELECT page_id, {_block_host('url')} AS host,
       url = '' OR {_under(_block_host('url'), _BLOCKED)} AS blocked FROM u""",
    "allowed_hosts": f"""
WITH l AS ({in_sql(inputs.SEARCH_RESULTS)}),
h AS (SELECT o_custkey, rank, link, {_block_host('link')} AS host FROM l WHERE link IS NOT NULL),
listed AS (SELECT DISTINCT 'care' || s_suppkey || '.co.uk' AS domain FROM supplier),
hit AS (SELECT DISTINCT host FROM (
          SELECT host, unnest(list_transform(range(1, len(string_split(host, '.')) + 1),
                 lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS domain
          FROM (SELECT DISTINCT host FROM h)) s JOIN listed USING (domain))
SELECT o_custkey, rank, link FROM h WHERE host NOT IN (SELECT host FROM hit)""",
    "mapped_services": f"""
WITH {_SERVICES}
SELECT service_num, c_custkey, service_name, service_website, postcode, segment FROM services""",
    "csv_services": f"""
WITH {_SERVICES}
SELECT c_custkey, service_name, CASE WHEN postcode = 'nan' THEN NULL ELSE postcode END AS postcode,
       'Zürich, "alt" ' || c_custkey AS town FROM services""",
    "csv_line_breaks": in_sql(inputs.NOTES),
    "listed_words": f"""
SELECT DISTINCT address_id, word
FROM ({in_sql(inputs.PAGE_ADDRESSES)}) a JOIN ({in_sql(inputs.LISTED_WORDS)}) w
  ON contains(lower(a.raw), w.word) WHERE w.word <> ''""",
    "load_summary": f"""
WITH {_SERVICES}
SELECT count(*) AS total, count({_absent('service_website')}) AS with_website,
       count(*) - count({_absent('service_website')}) AS without_website,
       count(*) - count(DISTINCT service_name) AS duplicates,
       (SELECT count(*) FROM raw_services) - count(*) AS invalid_skipped FROM services""",
    "rejected_rows": f"""
WITH {_MAPPED}
SELECT c_custkey, website AS service_website, postcode FROM raw_services
WHERE {_absent('name')} IS NULL""",
    "duplicate_names": f"""
WITH {_SERVICES}
SELECT service_num, service_name,
       row_number() OVER (PARTITION BY service_name ORDER BY service_num) > 1 AS duplicate
FROM services""",
    "search_query": f"""
WITH {_MAPPED}
SELECT c_custkey, coalesce(trim(name), '-') || coalesce(' ' || ({_absent('postcode')}), '')
       || ' official website' AS query FROM raw_services""",
    "search_responses": f"""
WITH s AS ({in_sql(inputs.SEARCH_RESPONSES)}),
o AS (SELECT service_num, response, unnest(range(CAST(json_array_length(response, '$.organic') AS BIGINT))) AS i
      FROM s)
SELECT service_num, i + 1 AS rank,
       json_extract_string(response, '$.organic[' || i || '].link') AS link FROM o""",
    "pick_website": f"""
WITH {_LOCATED}
SELECT service_num, service_name, website, site_key FROM located""",
    "page_emails_raw": f"""
WITH t AS (
  SELECT 'document' AS kind, doc_id AS id, text FROM ({in_sql(inputs.DOCUMENT_TEXTS)}) d
  UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations
  UNION ALL SELECT 'page', page_id, html FROM pages),
f AS (SELECT kind, id, unnest({_find('text')}) AS raw FROM t)
SELECT kind, id, raw, {_clean('raw')} AS email FROM f""",
    "deobfuscate": f"""
WITH f AS (SELECT doc_id, unnest({_find(_spell_out('text'))}) AS raw
           FROM ({in_sql(inputs.DOCUMENT_TEXTS)}) d)
SELECT doc_id, {_clean('raw')} AS email FROM f""",
    "mailto_values": f"""
SELECT address_id, url_decode(replace(trim(split_part(substr(trim(href), 8), '?', 1)), '+', '%2B')) AS raw
FROM ({in_sql(inputs.MAILTOS)}) m""",
    "judge_emails": f"""
WITH {_JUDGED}
SELECT address_id, email, ignore_reason IS NULL AS is_valid, ignore_reason FROM judged""",
    "categorize_emails": f"""
WITH {_JUDGED}
SELECT address_id, email, {_category('email')} AS category FROM judged WHERE ignore_reason IS NULL""",
    "page_report": f"""
WITH {_JUDGED},
once AS (SELECT DISTINCT site_key, page_seq, url, email, ignore_reason FROM judged)
SELECT site_key, page_seq, url,
       coalesce(string_agg(email, ', ' ORDER BY email) FILTER (WHERE ignore_reason IS NULL), '') AS found,
       coalesce(string_agg('''' || email || ''' (' || ignore_reason || ')', ', '
                ORDER BY '''' || email || ''' (' || ignore_reason || ')')
                FILTER (WHERE ignore_reason IS NOT NULL), '') AS ignored,
       count(*) FILTER (WHERE ignore_reason IS NULL) AS n_found,
       count(*) FILTER (WHERE ignore_reason IS NOT NULL) AS n_ignored
FROM once GROUP BY site_key, page_seq, url""",
    "page_report_parts": f"""
WITH {_JUDGED},
entries AS (
  SELECT DISTINCT site_key, page_seq, url, ignore_reason IS NULL AS valid,
         CASE WHEN ignore_reason IS NULL THEN email
              ELSE '''' || email || ''' (' || ignore_reason || ')' END AS value
  FROM judged),
{_in_parts('entries', 'site_key, page_seq, url, valid', 'value', 120)}""",
    "site_contact_parts": f"""
WITH {_JUDGED},
{_VALID_JUDGED},
{_KEPT},
shown AS (SELECT site_key, category, email FROM kept WHERE kept),
{_in_parts('shown', 'site_key, category', 'email', 200)}""",
    "site_contact_counts": f"""
WITH {_JUDGED},
{_VALID_JUDGED},
{_KEPT}
SELECT site_key, {', '.join(f"count(*) FILTER (WHERE category = '{c}') AS {chr(34)}{c}{chr(34)}" for c in r.CATEGORIES)},
       count(*) AS n_addresses
FROM kept WHERE kept GROUP BY site_key""",
    "own_domain_priority": f"""
WITH {_JUDGED},
{_VALID_JUDGED},
{_KEPT}
SELECT site_key, email, category, root_domain, is_own, kept FROM kept""",
    "site_contacts": f"""
WITH {_JUDGED},
{_VALID_JUDGED},
{_KEPT},
{_CONTACTS},
all_sites AS (SELECT DISTINCT site_key, CAST(NULL AS VARCHAR) AS reason FROM judged),
{_records('all_sites')}
SELECT *, {' AND '.join(f'"{c}" <> {chr(39) * 2}' for c in r.CATEGORIES)} AS all_categories
FROM records""",
    "complete_pages": f"""
WITH {_JUDGED},
adr AS (SELECT DISTINCT site_key, page_seq, email FROM judged WHERE ignore_reason IS NULL),
dom AS (SELECT DISTINCT site_key, page_seq, {_root(_netloc('url'))} AS root_domain FROM judged),
{_first_complete('adr', 'dom')}
SELECT site_key, last_seq FROM complete""",
    "page_links": f"""
WITH bodies AS (SELECT page_id AS fetch_id, base, html AS body FROM ({in_sql(inputs.LINKED_PAGES)}) p),
{_ANCHORS},
links AS (SELECT row_number() OVER () AS link_id, * FROM anchors
          WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(lower(href), 'mailto:')),
{_FULL_URLS}
SELECT fetch_id AS page_id, pos, {_ZONE} AS in_zone, href, full_url, {_shown('inner_html')} AS text
FROM links JOIN full_urls USING (link_id)""",
    "visible_text": rf"""
SELECT page_id, trim(regexp_replace({_shown('html')}, '\s+', ' ', 'g')) AS visible_text,
       trim(regexp_replace({_shown("regexp_extract(html, '<footer>.*?</footer>', 0, 's')")},
            '\s+', ' ', 'g')) AS priority_text
FROM pages""",
    "other_page_parts": rf"""
WITH p AS (SELECT page_id, regexp_replace(html, '<footer>.*?(</footer>|$)', ' ', 's') AS body FROM pages),
f AS (SELECT page_id, body, list_aggregate(regexp_extract_all(body,
        '<nav>.*?</nav>|<div class="ad">.*?</div>|<h1>.*?</h1>', 0, 's'), 'string_agg', ' ') AS first
      FROM p)
SELECT page_id, trim(regexp_replace({_shown('body')}, '\s+', ' ', 'g')) AS visible_text,
       trim(regexp_replace({_shown("coalesce(first, '')")}, '\s+', ' ', 'g')) AS priority_text
FROM f""",
    "page_addresses": f"""
WITH {_SITE_BODIES}
SELECT p.fetch_id, f.site_key, p.source, p.raw, p.email, p.ignore_reason IS NULL AS is_valid,
       p.ignore_reason
FROM page_found p JOIN fetches f ON p.fetch_id = f.fetch_id""",
    "candidates": f"""
WITH {_SITE_BODIES},
as_homes AS (SELECT fetch_id, requested_url AS base_url, final_url FROM fetches WHERE has_html),
{_candidates('as_homes')}
SELECT fetch_id, rank, url, page_key FROM planned""",
    "fetch_outcome": f"""
WITH {_EVENT_LOADS}
SELECT h.site_key, fetch_id, has_html, status, h.reason, r.reason AS site_reason
FROM homes h JOIN reasons r ON h.site_key = r.site_key""",
    "replay_crawl": f"""{_BUDGETED}
SELECT site_key, page_seq, fetch_id, url, final_url, status, has_html FROM visited""",
    "replay_contacts": f"""WITH {_PAGE_SITES},
{_WHOLE}
SELECT * FROM records""",
    "domain_reuse": f"""
WITH {_LOCATED}
SELECT l.service_num, l.website, l.site_key, s.base_url
FROM located l LEFT JOIN sites s ON l.site_key = s.site_key""",
    "enriched": f"{_FROM_TABLES}\nSELECT * FROM enriched",
    "success": f"""{_FROM_TABLES}
SELECT service_num, {', '.join(f'"{c}"' for c in r.SUCCESS_COLUMNS)} FROM enriched
WHERE "Status" = 'Success'""",
    "failed": f"""{_FROM_TABLES}
SELECT service_num, {', '.join(f'"{c}"' for c in r.FAILED_COLUMNS)} FROM enriched
WHERE "Status" = 'Failed'""",
    "run_counts": f"""{_FROM_TABLES}
SELECT count(*) AS total_rows, count(*) FILTER (WHERE "Status" = 'Success') AS success_rows,
       count(*) FILTER (WHERE "Status" = 'Failed') AS failed_rows FROM enriched""",
    "sparse_results": f"""
WITH {_SERVICES}
SELECT service_num, CASE WHEN service_num % 3 = 0 THEN 'success' ELSE 'failed' END AS result,
       CAST({len(r.ENRICHED_COLUMNS)} AS BIGINT) AS n_columns, CAST(2 AS BIGINT) AS n_filled
FROM services WHERE service_num % 3 < 2""",
    "guarded_inputs": f"""
WITH {_SERVICES},
named AS (SELECT count(*) AS n FROM services)
SELECT * FROM (
  SELECT unnest(['whole', 'parquet']) AS input, 'read' AS verdict, n FROM named
  UNION ALL SELECT unnest(['no rows', 'no names', 'no name column', 'other type']), 'refused', 0
  UNION ALL SELECT 'missing', 'missing', 0)""",
    "enriched_from_pages": f"""WITH {_PAGE_LOCATED},
{_SITE_BODIES},
{_WHOLE},
{_ENRICHED}
SELECT * FROM enriched""",
    "incremental_enrich": f"""
WITH {_SITE_BODIES}
SELECT DISTINCT f.site_key, p.email
FROM page_found p JOIN fetches f ON p.fetch_id = f.fetch_id WHERE p.ignore_reason IS NULL""",
    "incremental_sites": f"""
WITH {_LOCATED}
SELECT DISTINCT site_key FROM located WHERE site_key IS NOT NULL""",
    "snapshot_results": f"""WITH {_PAGE_LOCATED},
{_SITE_BODIES},
{_WHOLE},
{_ENRICHED}
SELECT * EXCLUDE (service_num) FROM enriched""",
    "page_reader": f"""
SELECT fetch_id, site_key, requested_url, CAST(attempt AS INTEGER) AS attempt, final_url,
       CAST(status AS INTEGER) AS status, error, CAST(strlen(html) AS BIGINT) AS html_bytes
FROM ({in_sql(inputs.SITE_PAGES)}) p""",
    "written_results": f"""{_FROM_TABLES},
numbered AS (
  SELECT 'enriched' AS result, service_num, "Service Name" AS name, "Service Website" AS site FROM enriched
  UNION ALL SELECT 'success', service_num, "Service Name", "Service Website" FROM enriched WHERE "Status" = 'Success'
  UNION ALL SELECT 'failed', service_num, "Service Name", "Service Website" FROM enriched WHERE "Status" = 'Failed')
SELECT result, row_number() OVER (PARTITION BY result ORDER BY service_num) AS position,
       name AS service_name, nullif(site, '') AS service_website FROM numbered""",
}
