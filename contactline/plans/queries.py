"""The registered queries: each runs operators over whole tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactline.functions import addresses as ad
from contactline.functions import urls
from contactline.functions.html import links_parser, texts_parser
from contactline.functions.text import SPACE, strip
from contactline.operators import contacts as ct
from contactline.operators import crawl as cr
from contactline.operators import ingest as ig
from contactline.operators import listed
from contactline.operators import pages as pg
from contactline.operators import websites as ws
from contactline.operators.cells import write_parts
from contactline.operators.skew import hot_key_left_join
from contactline.plans import inputs
from contactline.plans.enrich import (
    assemble,
    enrich,
    replay,
    sites_of,
    until_complete,
    visited_pages,
    with_site_key,
)
from contactline.plans.inputs import in_spark
from contactline.rules import (
    DEFAULT_RULES, ENRICHED_COLUMNS, MAX_PAGES, SERVICE_NAME, STATUS, Rules,
)
from contactline.runtime import bounded_batches, materialise, new_folder
from contactline.sources import results as rs
from contactline.sources.results import CSV_WRITE
from contactline.sources.pages import read_page_fetches, stream_page_fetches
from contactline.sources.search import search_results
from contactline.sources.services import read_csv, read_services
from contactline.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def registered(fn: Query) -> Query:
    REGISTERED[fn.__name__] = fn
    return fn


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- URLs and sites


@registered
def url_parts(spark, sf_dir):
    """Parts, site key, canonical form and homepage of URLs of many spellings."""
    u = F.col("url")
    return in_spark(spark, sf_dir, inputs.URLS).select(
        "page_id",
        urls.scheme(u).alias("scheme"),
        urls.netloc(u).alias("netloc"),
        urls.path(u).alias("path"),
        urls.root_domain(urls.netloc(u)).alias("root_domain"),
        urls.site_key(u).alias("site_key"),
        urls.with_scheme(u).alias("full_url"),
        urls.canonical(u).alias("canonical"),
        urls.homepage(u).alias("homepage"),
    )


@registered
def site_pages(spark, sf_dir):
    """Pages and own domains per host."""
    pages = _table(spark, sf_dir, "pages").select(
        urls.site_key(F.col("url"), "host").alias("site_key"), "url"
    )
    counts = pages.groupBy("site_key").agg(F.count("*").alias("n_pages"))
    return counts.join(ct.site_domains(pages), "site_key")


@registered
def blocked_hosts(spark, sf_dir):
    """Whether the blocklist covers a URL."""
    return in_spark(spark, sf_dir, inputs.PROBED_URLS).select(
        "page_id", urls.host_for_blocklist(F.col("url")).alias("host"),
        urls.is_blocked(F.col("url")).alias("blocked"),
    )


@registered
def allowed_hosts(spark, sf_dir):
    """Search results that a blocklist table (one domain per supplier) lets through."""
    listed = _table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("care"), "s_suppkey", F.lit(".co.uk")).alias("domain")
    )
    links = in_spark(spark, sf_dir, inputs.SEARCH_RESULTS).where("link IS NOT NULL")
    return ws.without_listed_hosts(links, "link", listed)


# ---------------------------------------------------------------- services


def _mapped(spark, sf_dir) -> DataFrame:
    """Customers under the headers of a loosely labelled file, mapped."""
    raw = in_spark(spark, sf_dir, inputs.SERVICES_RAW)
    headers = {
        "name": "Provider_Name", "website": " ServiceWebsite ", "postcode": "Post  Code",
        "segment": "Segment",
    }
    return ig.map_headers(raw.withColumnsRenamed(headers))


def _services(spark, sf_dir) -> DataFrame:
    """Numbered valid services, with the customer key."""
    numbered = ig.number_by_key(ig.valid_services(_mapped(spark, sf_dir)), "c_custkey")
    return ig.as_services(numbered, "c_custkey")


def _results(spark, sf_dir, services) -> DataFrame:
    links = in_spark(spark, sf_dir, inputs.SEARCH_RESULTS)
    return links.join(
        services.select("service_num", F.col("c_custkey").alias("o_custkey")), "o_custkey"
    ).select("service_num", "rank", "link")


@registered
def mapped_services(spark, sf_dir):
    """Header mapping, row check, name trimming and numbering."""
    return ig.number_by_key(ig.valid_services(_mapped(spark, sf_dir)), "c_custkey").select(
        "service_num", "c_custkey", F.col("Service Name").alias("service_name"),
        F.col("Service Website").alias("service_website"), F.col("Postcode").alias("postcode"),
        F.col("Segment").alias("segment"),
    )


@registered
def csv_services(spark, sf_dir):
    """The same services written to delimited files in two encodings and read back."""
    out = new_folder(spark, "services-csv")
    mapped = _mapped(spark, sf_dir)
    for encoding, part in (("UTF-8", "segment = 'MACHINERY'"), ("ISO-8859-1", "segment <> 'MACHINERY'")):
        (
            mapped.where(part)
            .withColumn("Town", F.concat(F.lit("Zürich, \"alt\" "), "c_custkey"))
            .write.mode("append").options(**CSV_WRITE, encoding=encoding).csv(out)
        )
    return read_services(spark, out).select(
        F.col("c_custkey").cast("long").alias("c_custkey"),
        F.col("Service Name").alias("service_name"),
        F.col("Postcode").alias("postcode"), F.col("Town").alias("town"),
    )


@registered
def csv_line_breaks(spark, sf_dir):
    """Services with line breaks, quotes and commas in their cells, written to one delimited file and
    read back in pieces."""
    out = new_folder(spark, "services-csv")
    in_spark(spark, sf_dir, inputs.NOTES).coalesce(1).write.options(**CSV_WRITE).csv(out)
    return read_csv(spark, out).select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "name", "note")


@registered
def load_summary(spark, sf_dir):
    return ig.load_summary(_mapped(spark, sf_dir))


@registered
def rejected_rows(spark, sf_dir):
    return ig.rejected_services(_mapped(spark, sf_dir)).select(
        "c_custkey", F.col("Service Website").alias("service_website"),
        F.col("Postcode").alias("postcode"),
    )


@registered
def duplicate_names(spark, sf_dir):
    """Services with a flag for a name that an earlier one has; all rows stay."""
    services = ig.number_by_key(ig.valid_services(_mapped(spark, sf_dir)), "c_custkey").select(
        "service_num", F.col("Service Name").alias("service_name")
    )
    first = services.groupBy("service_name").agg(F.min("service_num").alias("service_num"))
    return services.join(
        first.select("service_num", F.lit(False).alias("_again")), "service_num", "left"
    ).select("service_num", "service_name", F.coalesce("_again", F.lit(True)).alias("duplicate"))


@registered
def search_query(spark, sf_dir):
    """Search text of every customer: name and, where there is one, postcode."""
    return in_spark(spark, sf_dir, inputs.SERVICES_RAW).select(
        "c_custkey", ws.search_query(F.coalesce(strip(F.col("name")), F.lit("-")),
                                     F.col("postcode")).alias("query"),
    )


@registered
def search_responses(spark, sf_dir):
    """Ranked links out of JSON search responses."""
    return search_results(in_spark(spark, sf_dir, inputs.SEARCH_RESPONSES)).select(
        "service_num", F.col("rank").cast("long").alias("rank"), "link"
    )


@registered
def pick_website(spark, sf_dir):
    """Website of every service: its own, else the first allowed search result."""
    services = _services(spark, sf_dir)
    chosen = ws.choose_websites(services, _results(spark, sf_dir, services))
    return with_site_key(chosen).select("service_num", "service_name", "website", "site_key")


# ---------------------------------------------------------------- addresses


def _long_texts(spark, sf_dir) -> DataFrame:
    documents = in_spark(spark, sf_dir, inputs.DOCUMENT_TEXTS).select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    talks = _table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    pages = _table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return documents.unionByName(talks).unionByName(pages)


@registered
def page_emails_raw(spark, sf_dir):
    """Plain addresses in all documents, conversations and page sources."""
    return _long_texts(spark, sf_dir).select(
        "kind", "id", F.explode(ad.find_addresses(F.col("text"))).alias("raw")
    ).select("kind", "id", "raw", ad.clean(F.col("raw")).alias("email"))


@registered
def deobfuscate(spark, sf_dir):
    """Addresses in all documents after resolving [at] and (dot) spellings."""
    return in_spark(spark, sf_dir, inputs.DOCUMENT_TEXTS).select(
        "doc_id", F.explode(ad.find_obfuscated(F.col("text"))).alias("email")
    )


@registered
def mailto_values(spark, sf_dir):
    return in_spark(spark, sf_dir, inputs.MAILTOS).select(
        "address_id", ad.mailto_address(F.col("href")).alias("raw")
    )


def _judged(spark, sf_dir) -> DataFrame:
    return pg.judge(in_spark(spark, sf_dir, inputs.PAGE_ADDRESSES))


@registered
def judge_emails(spark, sf_dir):
    return _judged(spark, sf_dir).select("address_id", "email", "is_valid", "ignore_reason")


@registered
def categorize_emails(spark, sf_dir):
    return _judged(spark, sf_dir).where("is_valid").select(
        "address_id", "email", ad.category(F.col("email")).alias("category")
    )


@registered
def page_report(spark, sf_dir):
    """Valid and ignored addresses of each page."""
    report = pg.page_report(_judged(spark, sf_dir), ["site_key", "page_seq", "url"])
    return report.withColumns({n: F.col(n).cast("long") for n in ("n_found", "n_ignored")})


@registered
def page_report_parts(spark, sf_dir):
    """The same in numbered parts of at most 120 bytes, as cells of any length are written, read back."""
    folder = new_folder(spark, "report-parts")
    keys = ["site_key", "page_seq", "url"]
    write_parts(pg.page_report_parts(_judged(spark, sf_dir), keys, 120), [*keys, "valid"], folder)
    return spark.read.parquet(folder)


@registered
def listed_words(spark, sf_dir):
    """Words of a list that is a table (names of sites, words of documents) in raw addresses."""
    addresses = in_spark(spark, sf_dir, inputs.PAGE_ADDRESSES).select(
        "address_id", F.lower("raw").alias("email"))
    return listed.listed_words(
        addresses, "address_id", "email", in_spark(spark, sf_dir, inputs.LISTED_WORDS))


# ---------------------------------------------------------------- contacts


def _flagged(spark, sf_dir) -> DataFrame:
    judged = _judged(spark, sf_dir)
    return ct.flag_own_domain(judged.where("is_valid"), ct.site_domains(judged))


@registered
def own_domain_priority(spark, sf_dir):
    """Every address of a site, and whether the own-domain rule keeps it."""
    return ct.own_domain_first(_flagged(spark, sf_dir))


@registered
def site_contacts(spark, sf_dir):
    """Six category columns, status and reason of every site."""
    sites = in_spark(spark, sf_dir, inputs.PAGE_ADDRESSES).select("site_key").distinct()
    records = ct.site_records(
        sites.withColumn("reason", F.lit(None).cast("string")),
        ct.contacts_by_site(_flagged(spark, sf_dir)),
    )
    return records.withColumn("all_categories", ct.all_categories_found())


@registered
def site_contact_parts(spark, sf_dir):
    """The category cells of every site in numbered parts of at most 200 bytes."""
    return ct.contact_parts(_flagged(spark, sf_dir), 200)


@registered
def site_contact_counts(spark, sf_dir):
    """Number of addresses by site and category, without any list."""
    return ct.contact_counts(_flagged(spark, sf_dir))


@registered
def complete_pages(spark, sf_dir):
    """The page after which a site has all six categories."""
    judged = _judged(spark, sf_dir)
    domains = (
        judged.groupBy("site_key", urls.root_domain(urls.netloc(F.col("url"))).alias("root_domain"))
        .agg(F.min("page_seq").alias("first_seq"))
    )
    return ct.first_complete_page(
        judged.where("is_valid").select("site_key", "page_seq", "email"), domains
    )


# ---------------------------------------------------------------- pages and visits


def _site_pages(spark, sf_dir) -> DataFrame:
    return in_spark(spark, sf_dir, inputs.SITE_PAGES)


@registered
def page_links(spark, sf_dir):
    """Every anchor of every page that can lead to a page, links of all relative forms among them."""
    bounded_batches(spark)
    pages = in_spark(spark, sf_dir, inputs.LINKED_PAGES)
    links = pages.select("page_id", "base", F.inline(links_parser()("html")))
    return links.where(pg.is_page_href(F.col("href"))).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "in_zone", "href",
        urls.resolve(F.col("base"), F.col("href")).alias("full_url"), "text"
    )


def _texts(pages: DataFrame, rules: Rules) -> DataFrame:
    bounded_batches(pages.sparkSession)
    parsed = pages.select("page_id", texts_parser(rules)("html").alias("p"))
    flat = lambda c: strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))
    return parsed.select(
        "page_id", flat(F.col("p.visible_text")).alias("visible_text"),
        flat(F.col("p.priority_text")).alias("priority_text"),
    )


@registered
def visible_text(spark, sf_dir):
    """Visible and priority text of every page, blanks collapsed."""
    return _texts(_table(spark, sf_dir, "pages"), DEFAULT_RULES)


@registered
def other_page_parts(spark, sf_dir):
    """The same where a run has other page parts: footers hidden, navigation and titles first."""
    rules = replace(
        DEFAULT_RULES, hidden_tags=(*DEFAULT_RULES.hidden_tags, "footer"),
        priority_tags=("nav", "h1"), priority_classes=("ad",), priority_ids=())
    return _texts(_table(spark, sf_dir, "pages"), rules)


@registered
def page_addresses(spark, sf_dir):
    """Addresses of every page by source: mailto links, source text, priority parts, text."""
    parsed = pg.parse_pages(_site_pages(spark, sf_dir))
    return pg.page_addresses(parsed).select(
        "fetch_id", "site_key", "source", "raw", "email", "is_valid", "ignore_reason"
    )


@registered
def candidates(spark, sf_dir):
    """Pages to visit from every page, taken as a homepage: own links, then common paths."""
    parsed = pg.parse_pages(_site_pages(spark, sf_dir)).where("has_html")
    homes = parsed.select(
        F.col("fetch_id").cast("string").alias("site_key"),
        F.col("requested_url").alias("base_url"), "final_url", "links",
    )
    return cr.candidates(homes).select(
        F.col("site_key").cast("long").alias("fetch_id"),
        F.col("rank").cast("long").alias("rank"), "url", "page_key",
    )


def _loads(spark, sf_dir):
    """Loads, sites, homepage outcomes and all pages taken as visited."""
    loads = in_spark(spark, sf_dir, inputs.LOADS)
    sites = loads.select(
        "site_key", F.concat(F.lit("https://"), "site_key").alias("base_url")
    ).distinct()
    index = cr.fetch_index(loads)
    homes = cr.home_outcome(index, sites)
    others = index.where(~F.col("page_key").endswith(".co.uk")).select(
        "site_key", cr.page_status(F.col("status"), F.col("has_html"), 404).alias("status")
    )
    visited = homes.where("has_html").select("site_key", "status").unionByName(others)
    return homes, visited.withColumn("broken", F.lit(False))


@registered
def fetch_outcome(spark, sf_dir):
    """What opening each homepage led to, and the reason a site without addresses would get."""
    homes, visited = _loads(spark, sf_dir)
    return homes.drop("base_url", "final_url").join(cr.site_reasons(visited, homes)
        .withColumnRenamed("reason", "site_reason"), "site_key")


def _replay_inputs(spark, sf_dir):
    fetches = materialise(pg.parse_pages(_site_pages(spark, sf_dir)), "fetches")
    sites = fetches.select(
        "site_key", F.concat(F.lit("https://"), "site_key", F.lit("/")).alias("base_url")
    ).distinct()
    return sites, fetches


@registered
def replay_crawl(spark, sf_dir):
    """Pages visited on every site within the page budget, up to the page that completes it."""
    sites, fetches = _replay_inputs(spark, sf_dir)
    rules = replace(DEFAULT_RULES, max_pages=MAX_PAGES)
    _, within_budget = visited_pages(sites, fetches, rules)
    visited, _, _ = until_complete(within_budget, fetches, rules)
    return visited.select(
        "site_key", F.col("page_seq").cast("long").alias("page_seq"), "fetch_id", "url",
        "final_url", "status", "has_html",
    )


@registered
def replay_contacts(spark, sf_dir):
    """Record of every site from all loads that its candidates lead to."""
    return replay(*_replay_inputs(spark, sf_dir))


# ---------------------------------------------------------------- results


@registered
def domain_reuse(spark, sf_dir):
    """Services that share a site, and the one whose website stands for it."""
    services = _services(spark, sf_dir)
    chosen = ws.choose_websites(services, _results(spark, sf_dir, services))
    located = materialise(with_site_key(chosen), "located")
    return hot_key_left_join(located, sites_of(located), ["site_key"], ["service_num"]).select(
        "service_num", "website", "site_key", "base_url"
    )


def _enriched(spark, sf_dir) -> DataFrame:
    services = _services(spark, sf_dir)
    chosen = ws.choose_websites(services, _results(spark, sf_dir, services))
    located = materialise(with_site_key(chosen), "located")
    homes, visited = _loads(spark, sf_dir)
    contacts = ct.contacts_by_site(_flagged(spark, sf_dir))
    return assemble(located, ct.site_records(cr.site_reasons(visited, homes), contacts))


@registered
def enriched(spark, sf_dir):
    """All services with website, contacts, status and reason."""
    return _enriched(spark, sf_dir)


@registered
def success(spark, sf_dir):
    return rs.success_table(_enriched(spark, sf_dir))


@registered
def failed(spark, sf_dir):
    return rs.failed_table(_enriched(spark, sf_dir))


@registered
def run_counts(spark, sf_dir):
    """Rows of a run as counted while its tables are written."""
    counts = rs.write_results(
        materialise(_enriched(spark, sf_dir), "enriched"), new_folder(spark, "results"))
    return spark.range(1).select(*(F.lit(n).cast("long").alias(name) for name, n in counts.items()))


@registered
def sparse_results(spark, sf_dir):
    """Result rows of a table that lacks most columns: these are there, and empty."""
    lacking = _services(spark, sf_dir).select(
        "service_num", F.col("service_name").alias(SERVICE_NAME),
        F.when(F.col("service_num") % 3 == 0, " SUCCESS ").when(F.col("service_num") % 3 == 1, "failed")
        .alias(STATUS))
    full = rs.enriched_table(lacking)
    filled = sum((F.when(F.col(f"`{c}`") != "", 1).otherwise(0) for c in ENRICHED_COLUMNS), F.lit(0))
    return rs.success_table(full).select("service_num", F.lit("success").alias("result")).unionByName(
        rs.failed_table(full).select("service_num", F.lit("failed").alias("result"))
    ).join(full.select("service_num", F.lit(len(full.columns) - 1).cast("long").alias("n_columns"),
                       filled.cast("long").alias("n_filled")), "service_num")


@registered
def guarded_inputs(spark, sf_dir):
    """What the reader says of files of several kinds, made of the services of each segment."""
    mapped = _mapped(spark, sf_dir)
    unnamed = mapped.withColumn(SERVICE_NAME, F.lit(None).cast("string"))
    tables = [
        ("whole", mapped, "csv", ".csv"),
        ("parquet", mapped, "parquet", ".parquet"),
        ("no rows", mapped.limit(0), "csv", ".csv"),
        ("no names", unnamed, "csv", ".csv"),
        ("no name column", mapped.drop(SERVICE_NAME), "csv", ".csv"),
        ("other type", mapped, "csv", ".xlsx"),
        ("missing", None, "csv", ".csv"),
    ]
    verdicts = []
    for name, rows, fmt, suffix in tables:
        path = new_folder(spark, "guarded") + suffix
        if rows is not None:
            rows.coalesce(1).write.format(fmt).options(**(CSV_WRITE if fmt == "csv" else {})).save(path)
        try:
            n, verdict = read_services(spark, path, "c_custkey").count(), "read"
        except (ValueError, AnalysisException) as refusal:
            n, verdict = 0, "missing" if isinstance(refusal, AnalysisException) else "refused"
        verdicts.append(F.struct(
            F.lit(name).alias("input"), F.lit(verdict).alias("verdict"), F.lit(n).cast("long").alias("n")))
    return spark.range(1).select(F.inline(F.array(*verdicts)))


@registered
def enriched_from_pages(spark, sf_dir):
    """The whole run from services, search results and page bodies."""
    return enrich(
        in_spark(spark, sf_dir, inputs.PAGE_SERVICES),
        in_spark(spark, sf_dir, inputs.PAGE_RESULTS),
        _site_pages(spark, sf_dir),
    )


# ---------------------------------------------------------------- streaming


#: Page loads that a file of the stream holds at most, and batches of a stream of many files, about.
FILE_LOADS, BATCHES = 1000, 4


def _page_stream(spark, sf_dir) -> DataFrame:
    """The page loads as a stream of several batches. Their number does not grow with the tables, as
    each batch goes through what its sites have brought before; the files of a batch do, so that all
    tasks have some."""
    source = new_folder(spark, "stream-source")
    pages = _site_pages(spark, sf_dir)
    most = max(1, min(pages.count() // 4, FILE_LOADS))
    pages.write.option("maxRecordsPerFile", most).parquet(source)
    files = len(spark.read.parquet(source).inputFiles())
    return stream_page_fetches(spark, source, max(2, -(-files // BATCHES)))


@registered
def incremental_enrich(spark, sf_dir):
    """Distinct valid addresses per site, from page loads read as a stream."""
    out = new_folder(spark, "stream-out")
    stream = incremental.site_addresses(_page_stream(spark, sf_dir))
    incremental.append_new(stream, out, new_folder(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@registered
def incremental_sites(spark, sf_dir):
    """Sites in the order in which a stream of services names them, each once."""
    services = _services(spark, sf_dir)
    chosen = with_site_key(ws.choose_websites(services, _results(spark, sf_dir, services)))
    source, out = new_folder(spark, "stream-source"), new_folder(spark, "stream-out")
    located = materialise(chosen.select("service_num", "site_key"), "located")
    located.write.option("maxRecordsPerFile", max(1, located.count() // 4)).parquet(source)
    stream = spark.readStream.schema(located.schema).option("maxFilesPerTrigger", 2).parquet(source)
    incremental.append_new(
        incremental.named_sites(stream), out, new_folder(spark, "stream-checkpoint")
    ).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@registered
def snapshot_results(spark, sf_dir):
    """Result tables of a streamed run: renewed after every second batch, and at the end."""
    located = materialise(with_site_key(ws.choose_websites(
        in_spark(spark, sf_dir, inputs.PAGE_SERVICES), in_spark(spark, sf_dir, inputs.PAGE_RESULTS))),
        "located")
    out = new_folder(spark, "snapshots")
    incremental.run_with_snapshots(
        _page_stream(spark, sf_dir), located, new_folder(spark, "stream-run"), out, 2)
    return spark.read.parquet(f"{out}/services_enriched")


# ---------------------------------------------------------------- readers and sinks


@registered
def page_reader(spark, sf_dir):
    """Page loads written as Parquet and read back under the reader's schema."""
    folder = new_folder(spark, "page-fetch")
    _site_pages(spark, sf_dir).write.parquet(folder)
    return read_page_fetches(spark, folder).select(
        "fetch_id", "site_key", "requested_url", "attempt", "final_url", "status", "error",
        F.octet_length("html").cast("long").alias("html_bytes"),
    )


@registered
def written_results(spark, sf_dir):
    """The three result tables written as delimited files and read back, in their order."""
    folder = new_folder(spark, "results")
    rs.write_results(materialise(_enriched(spark, sf_dir), "enriched"), folder, "csv")
    tables = []
    for name in ("enriched", "success", "failed"):
        rows = read_csv(spark, f"{folder}/services_{name}").withColumn(
            "_row", F.monotonically_increasing_id())
        tables.append(ig.number_by_file_position(rows, "position").select(
            F.lit(name).alias("result"), "position", F.col("Service Name").alias("service_name"),
            F.col("Service Website").alias("service_website")))
    return tables[0].unionByName(tables[1]).unionByName(tables[2])
