"""Inputs of the registered queries, derived from the given tables.

The given tables hold no organisations, search results or page loads, so these statements make
them: every row of the source table becomes a row of the input, and only its values are rewritten.
The SQL is portable, so that both Spark and the check run it; what is under test is not in here.
Tables appear as ``{name}``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LOCALS = (
    "hr,christina,humanresources.team,people.ops,recruitment,recruiter1,hiring,talent,career,"
    "jobs,vacancies,manager,Director,owner,admin,info,information,Info.desk,reception,sales,"
    "enquiries,noreply,no-reply,unsubscribe,media,mediation,referrals,feedback,-lead,a b,test"
)
# "*" is the site's own domain
DOMAINS = (
    "*,gmail.com,*,partner-homes.org,*,example.com,www.*,mydomain.com,*,mytwitterfans.co.uk,*,"
    "surgery.nhs.uk,*,b.nhs.scot,office.*,x.gov.uk,cqc.org.uk,2x.png,site.js,nhs.net,"
    "sentry.wixpress.com,nodot,careinspectorate.wales"
)
N_LOCALS = LOCALS.count(",") + 1
N_DOMAINS = DOMAINS.count(",") + 1
PATHS = "/contact,/contact-us,/about,/about-us,/careers,/career,/jobs,/vacancies,/recruitment,/team"


def _pick(words: str, index: str) -> str:
    return f"split_part('{words}', ',', CAST({index} AS INT) + 1)"


def _div(value: str, by: int) -> str:
    return f"CAST(FLOOR({value} / {by}.0) AS BIGINT)"


_SITE = f"CAST({_div('o_custkey', 10)} AS STRING)"
_ORDER_DOMAIN = (
    f"replace({_pick(DOMAINS, f'{_div('o_orderkey', N_LOCALS)} % {N_DOMAINS}')}, '*', "
    f"'care' || {_SITE} || '.co.uk')"
)
_ORDER_LOCAL = _pick(LOCALS, f"o_orderkey % {N_LOCALS}")

# One raw address per order, on one of ten pages of the site of its customer.
PAGE_ADDRESSES = f"""
SELECT o_orderkey AS address_id,
       'care' || {_SITE} || '.co.uk' AS site_key,
       CAST(o_orderkey % 10 AS INT) AS page_seq,
       CASE WHEN {_div('o_custkey', 10)} % 5 = 0 THEN 'https://other' || {_SITE} || '.org/p'
            ELSE 'https://www.Care' || {_SITE} || '.co.uk:443/p' END
         || CAST(o_orderkey % 10 AS STRING) AS url,
       CASE o_orderkey % 37
            WHEN 0 THEN '(' || upper({_ORDER_LOCAL}) || '@' || {_ORDER_DOMAIN} || ').'
            WHEN 1 THEN {_ORDER_LOCAL}
            ELSE {_ORDER_LOCAL} || '@' || {_ORDER_DOMAIN} END AS raw
FROM {{orders}}
"""

# Organisations with loosely named columns, one per customer.
SERVICES_RAW = f"""
SELECT c_custkey,
       CASE c_custkey % 20 WHEN 0 THEN '' WHEN 1 THEN ' NaN ' WHEN 3 THEN NULL
            WHEN 2 THEN '  ' || c_name || ' ' WHEN 4 THEN 'Oak Care' WHEN 5 THEN ' Oak Care'
            ELSE c_name END AS name,
       CASE c_custkey % 6
            WHEN 0 THEN 'https://www.care' || CAST({_div('c_custkey', 10)} AS STRING) || '.co.uk/home'
            WHEN 1 THEN ' care' || CAST({_div('c_custkey', 10)} AS STRING) || '.co.uk'
            WHEN 2 THEN NULL WHEN 3 THEN ' nan ' WHEN 4 THEN ''
            ELSE 'http://WWW.Care' || CAST({_div('c_custkey', 10)} AS STRING) || '.co.uk:8080/x?y'
       END AS website,
       CASE c_custkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN ' ' || n_name ELSE n_name END AS postcode,
       c_mktsegment AS segment
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
"""

# Cells that hold line breaks, quotes and delimiters, one row per customer.
NOTES = """
SELECT c_custkey, c_name AS name,
       CASE c_custkey % 5
            WHEN 0 THEN c_mktsegment
            WHEN 1 THEN c_name || ',' || chr(10) || 'c/o "' || c_mktsegment || '"'
            WHEN 2 THEN '"' || chr(10) || chr(10) || c_name || '"'
            WHEN 3 THEN c_name || ' "' || chr(10)
            ELSE 'a, "b"' || chr(10) || ',' END AS note
FROM {customer}
"""

# Words to look for in addresses: a name for each customer, and whole addresses' ends.
LISTED_WORDS = f"""
SELECT 'care' || CAST(c_custkey AS STRING) || '.' AS word FROM {{customer}}
UNION ALL SELECT 'e' || CAST(c_custkey % 100 AS STRING) FROM {{customer}}
UNION ALL SELECT {_pick(LOCALS, f'c_custkey % {N_LOCALS}')} FROM {{customer}}
UNION ALL SELECT substr({_pick(DOMAINS, f'c_custkey % {N_DOMAINS}')}, 1, 3) FROM {{customer}}
"""

# One search result per order of the customer; the order number is its rank.
SEARCH_RESULTS = f"""
SELECT o_custkey, o_orderkey AS rank,
       CASE o_orderkey % 9
            WHEN 0 THEN 'https://www.yell.com/biz/' || CAST(o_orderkey AS STRING)
            WHEN 1 THEN NULL WHEN 2 THEN ''
            WHEN 3 THEN 'https://www.Care' || {_SITE} || '.co.uk:8443/homes/1?x=2'
            WHEN 4 THEN 'https://town.gov.uk/homes'
            WHEN 5 THEN 'care' || {_SITE} || '.co.uk/about'
            WHEN 6 THEN 'http://en.wikipedia.org/wiki/Care'
            WHEN 7 THEN 'https://facebook.com:443/care'
            ELSE 'https://notyell.com/' || CAST(o_orderkey AS STRING) END AS link
FROM {{orders}}
"""

# One search response per order.
SEARCH_RESPONSES = """
SELECT o_orderkey AS service_num,
       CASE o_orderkey % 5
            WHEN 0 THEN '{{"credits": 1}}'
            WHEN 1 THEN '{{"organic": []}}'
            WHEN 2 THEN '{{"organic": [{{"title": "x"}}, {{"link": "https://a' || CAST(o_custkey AS STRING) || '.org/"}}]}}'
            ELSE '{{"organic": [{{"link": "https://a.org/' || CAST(o_orderkey AS STRING)
                 || '", "position": 1}}, {{"link": null}}, {{"link": ""}}, {{"link": "b' || CAST(o_custkey AS STRING) || '.com"}}]}}'
       END AS response
FROM {orders}
"""

# The URL of each page as given, and one of another spelling.
URLS = """
SELECT page_id, url FROM {pages}
UNION ALL
SELECT page_id,
       CASE page_id % 12
            WHEN 0 THEN replace(replace(url, 'https://', ''), 'http://', '')
            WHEN 1 THEN upper(url)
            WHEN 2 THEN replace(url, '.example.com', '.example.co.uk:8080')
            WHEN 3 THEN replace(url, '.example.', '.me.')
            WHEN 4 THEN replace(url, '://', '://user:pw@')
            WHEN 5 THEN url || '/a/b//'
            WHEN 6 THEN ''
            WHEN 7 THEN 'localhost:' || CAST(page_id AS STRING) || '/x'
            WHEN 8 THEN replace(replace(url, 'https:', ''), 'http:', '')
            WHEN 9 THEN '  ' || url || ' '
            ELSE url END AS url
FROM {pages}
"""

_BLOCK_PROBES = (
    "www.yell.com,notyell.com,netflix.com,council.gov.uk,gov.uk,a.nhs.wales,nhs.wales,"
    "yell.com:443,WWW.Facebook.com,x.com,find-and-update.company-information.service.gov.uk,"
    "care.example.org,nhs.net,mynhs.net,a.b.c.trustpilot.com,uk"
)
# The URL of each page as given, and one that a blocklist is tried on.
PROBED_URLS = f"""
SELECT page_id, url FROM {{pages}}
UNION ALL
SELECT page_id,
       CASE page_id % 3
            WHEN 0 THEN 'https://' || {_pick(_BLOCK_PROBES, 'page_id % 16')} || '/' || CAST(page_id AS STRING)
            WHEN 1 THEN {_pick(_BLOCK_PROBES, 'page_id % 16')} || '/x'
            ELSE '' END AS url
FROM {{pages}}
"""

# Page loads from events: four pages per user's site, the first loaded in two attempts.
LOADS = """
SELECT event_id AS fetch_id,
       'care' || CAST(user_id AS STRING) || '.co.uk' AS site_key,
       'https://care' || CAST(user_id AS STRING) || '.co.uk/'
         || CASE event_id % 4 WHEN 0 THEN '' ELSE 'p' || CAST(event_id % 4 AS STRING) END AS requested_url,
       CASE WHEN event_id % 8 = 4 THEN 2 ELSE 1 END AS attempt,
       'https://care' || CAST(user_id AS STRING) || '.co.uk/' AS final_url,
       CASE WHEN user_id % 10 = 0 THEN 404 WHEN event_type = 'error' THEN NULL
            WHEN event_type = 'signup' THEN 403 WHEN event_type = 'click' THEN 202
            ELSE 200 END AS status,
       CASE event_type
            WHEN 'error' THEN split_part('net::ERR_NAME_NOT_RESOLVED|Timeout 20000ms exceeded|net::ERR_CONNECTION_REFUSED|Connection refused by DNS|getaddrinfo failed|Page crashed', '|', CAST(event_id % 6 AS INT) + 1)
            ELSE CASE WHEN event_id % 9 = 0 THEN 'Navigation timed out' ELSE NULL END END AS error,
       value > 8 AND (event_type <> 'error' OR event_id % 5 = 0) AS has_html
FROM {events}
"""

# Page bodies with two more links, of every form that a link may have.
LINKS = (
    "..|.|./|../|../..|../../../x/|?q=1|?|;p|a;p/../b;q?r#s|a/./b/..|/../x//y/./|//other.org|"
    "//other.org/a/../b|HTTP://x.org/..|https:a/b|x//y/|./?x=../y|g;x=1/./y|.../..a/.b|contact#top|"
    "/|ftp://x/a/..|../team;t?u=/./#v|mail:to/../x"
)
N_LINKS = LINKS.count("|") + 1


def _link(index: str) -> str:
    return f"split_part('{LINKS}', '|', CAST({index} AS INT) + 1)"


LINKED_PAGES = f"""
SELECT page_id,
       CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '/a/b;c'
            WHEN 2 THEN replace(replace(url, '?', '/d/?'), '#', '/e/#') ELSE url || '&f=/g/../h' END AS base,
       replace(html, '<footer>', '<footer><a href="' || {_link(f'page_id % {N_LINKS}')}
            || '">one</a> <a href="' || {_link(f'(page_id * 7 + 3) % {N_LINKS}')} || '">two</a> ') AS html
FROM {{pages}}
"""

# Page bodies with addresses in their footer and links to pages worth a visit. Every 17th site has a
# namesake that cannot be reached.
_PAGE_HOST = "replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), 'example.', '')"
_PAGE_ROOT = f"regexp_extract({_PAGE_HOST}, '([^.]*[.][^.]*)$', 1)"
_PAGE_LOCAL = _pick(LOCALS, f"page_id % {N_LOCALS}")
_PAGE_LOCAL2 = _pick(LOCALS, f"(page_id * 7 + 3) % {N_LOCALS}")
_PAGE_DOMAIN = f"replace({_pick(DOMAINS, f'page_id % {N_DOMAINS}')}, '*', {_PAGE_ROOT})"
SITE_PAGES = f"""
SELECT page_id AS fetch_id, {_PAGE_ROOT} AS site_key,
       'https://' || {_PAGE_ROOT} || CASE WHEN page_id % 12 < 2 THEN '/'
            ELSE {_pick(PATHS, 'CASE WHEN page_id % 12 < 2 THEN 0 ELSE page_id % 12 - 2 END')} END AS requested_url,
       CASE WHEN page_id % 12 = 1 THEN 2 ELSE 1 END AS attempt,
       CASE page_id % 7
            WHEN 0 THEN 'https://www.' || {_PAGE_ROOT} || '/r' || CAST(page_id AS STRING)
            WHEN 3 THEN 'https://' || {_PAGE_ROOT} || '/about'
            WHEN 5 THEN 'https://care' || CAST(page_id % 3 AS STRING) || '.org/'
            ELSE 'https://' || {_PAGE_ROOT} || CASE WHEN page_id % 12 < 2 THEN '/'
                 ELSE {_pick(PATHS, 'CASE WHEN page_id % 12 < 2 THEN 0 ELSE page_id % 12 - 2 END')} END
            END AS final_url,
       CASE page_id % 13 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN NULL ELSE 200 END AS status,
       replace(replace(html, 'href="/t', 'href="/team-t'),
            '<footer>', '<footer><p>' || {_PAGE_LOCAL} || ' [at] ' || {_PAGE_DOMAIN}
            || '</p><a href="mailto:' || {_PAGE_LOCAL2} || '%40' || {_PAGE_DOMAIN}
            || '?subject=Hi">write</a><b>' || {_PAGE_LOCAL2} || '</b>@' || {_PAGE_ROOT} || '<!-- x --> ')
         AS html,
       CASE page_id % 17 WHEN 5 THEN 'Timeout 20000ms exceeded' ELSE NULL END AS error
FROM {{pages}}
UNION ALL
SELECT -page_id - 1, 'gone' || {_PAGE_ROOT}, 'https://gone' || {_PAGE_ROOT} || '/', 1,
       'https://gone' || {_PAGE_ROOT} || '/', NULL, '', 'net::ERR_NAME_NOT_RESOLVED'
FROM {{pages}} WHERE page_id % 17 = 0
"""

# Services whose site is one of the page sites, one per page.
PAGE_SERVICES = f"""
SELECT page_id + 1 AS service_num, 'Service ' || CAST(page_id AS STRING) AS service_name,
       CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN {_PAGE_HOST} WHEN 2 THEN 'https://nowhere' || CAST(page_id AS STRING) || '.org'
            ELSE 'https://' || {_PAGE_ROOT} || '/' END AS service_website,
       CAST(NULL AS STRING) AS postcode
FROM {{pages}}
"""
PAGE_RESULTS = f"""
SELECT page_id + 1 AS service_num, page_id AS rank,
       CASE page_id % 4 WHEN 0 THEN 'https://www.yell.com/' ELSE url END AS link
FROM (SELECT page_id, 'https://' || {_PAGE_ROOT} || '/x/y' AS url FROM {{pages}}) p
"""

# Texts with addresses on real-looking domains, plain and spelled out.
DOCUMENT_TEXTS = """
SELECT doc_id, lang,
       CASE doc_id % 3
            WHEN 0 THEN text
            WHEN 1 THEN replace(text, '.example.com', '.homes.org')
            ELSE replace(replace(replace(text, '@mail', ' [at] mail'), '.example.com', ' (dot) homes [dot] org'), ' ', ' ') END
         AS text
FROM {documents}
"""

MAILTOS = f"""
SELECT o_orderkey AS address_id,
       CASE o_orderkey % 6
            WHEN 0 THEN 'mailto:a+' || {_ORDER_LOCAL} || '%40' || {_ORDER_DOMAIN} || '?subject=Hi%20all'
            WHEN 1 THEN ' MAILTO: ' || {_ORDER_LOCAL} || '@' || {_ORDER_DOMAIN} || ' '
            WHEN 2 THEN 'mailto:' || {_ORDER_LOCAL} || '%2B1%40' || {_ORDER_DOMAIN} || '?'
            WHEN 3 THEN 'mailto:?subject=none'
            ELSE 'mailto:' || {_ORDER_LOCAL} || '@' || {_ORDER_DOMAIN} END AS href
FROM {{orders}}
"""


def tables_of(statement: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", statement)))


def in_spark(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(statement)}
    return spark.sql(statement, **tables)


def in_sql(statement: str) -> str:
    return statement.format(**{t: t for t in tables_of(statement)}).strip()
