"""Search and read a table of web pages: the offline stand-in for a provider's search and extract tools."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators.answers import cap_text
from millrace.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks carry the code

# What is not text on a page: scripts and styles with their content, comments, tags.
NOT_TEXT = r"<(?:(?i:script|style)[^>]*>(?s:.*?)</(?i:script|style)>|!--(?s:.*?)-->|[^>]*>)"
SPACES = r"[ \t\r\n]+"
TITLE = r"(?is)<title>(.*?)</title>"
WORD = r"[\p{L}\p{N}]+"

# Named entities; the ampersand comes last, so that decoded text is not decoded again.
ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&copy;": "©",
    "&reg;": "®",
    "&trade;": "™",
    "&middot;": "·",
    "&hellip;": "…",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&euro;": "€",
    "&amp;": "&",
}
TOP_PAGES = 2
SNIPPET_BEFORE, SNIPPET_WORDS = 5, 20
#: Phrases that go to every task, pages of a site searched by one task beyond that, and sites that are named in a filter.
BROADCAST_PHRASES, PAGES_PER_TASK, _FEW_SITES = 200_000, 50_000, 1_000


def host_of(url: Column) -> Column:
    return F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))


def _decoded(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_text(html: Column) -> Column:
    """The readable text of a page on one line."""
    return F.trim(F.regexp_replace(_decoded(F.regexp_replace(html, NOT_TEXT, " ")), SPACES, " "))


def page_title(html: Column) -> Column:
    return _decoded(F.regexp_extract(html, TITLE, 1))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pages_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", host_of(F.col("url")).alias("host"), page_title(F.col("html")).alias("title"),
                        page_text(F.col("html")).alias("text"))


class SitePhrases:
    """The phrases of one site as an Aho-Corasick automaton over text whose words stand between single spaces."""

    def __init__(self, phrases: Iterable[str]) -> None:
        self.found = ahocorasick.Automaton()
        for phrase in phrases:
            self.found.add_word(f" {phrase} ", phrase)
        self.found.make_automaton()

    def hits(self, text: str) -> dict[str, list[int]]:
        """Per phrase that the text holds: how often, and the word at which it starts first, counted from one."""
        spaced, out = f" {text} ", {}
        if not text or not len(self.found):
            return out
        for end, phrase in self.found.iter(spaced):
            if phrase in out:
                out[phrase][0] += 1
            else:
                out[phrase] = [1, spaced.count(" ", 0, end - len(phrase))]
        return out


_HITS = "domain string, phrase string, page_id bigint, hits bigint, at int"


def _phrase_hits(pages: DataFrame, phrases: DataFrame, broadcast_phrases: int = BROADCAST_PHRASES, pages_per_task: int = PAGES_PER_TASK) -> DataFrame:
    """(domain, phrase, page_id) with the number of hits and the first place.

    Each page passes through the automaton of its site once, so no page is compared with a phrase that it does not hold
    and no place of a page is shuffled. Phrases go to every task if there are at most ``broadcast_phrases`` of them, and no
    page moves. Beyond that pages and phrases meet by site, a site of many pages in several parts.
    """
    located = pages.withColumn("domain", host_of(F.col("url"))).where("domain is not null")
    phrases = cut_lineage(phrases)
    text = F.array_join(words(page_text(F.col("html"))), " ").alias("text")
    if phrases.count() <= broadcast_phrases:
        table = phrases.toArrow()
        by_site: dict[str, list[str]] = {}
        for domain, phrase in zip(table.column("domain").to_pylist(), table.column("phrase").to_pylist()):
            by_site.setdefault(domain, []).append(phrase)
        shared = pages.sparkSession.sparkContext.broadcast(by_site)
        asked = located.where(F.col("domain").isin(list(by_site))) if len(by_site) <= _FEW_SITES else located
        return asked.select(F.col("page_id").cast("bigint").alias("page_id"), "domain", text).mapInArrow(_over_sites(shared), _HITS)
    sites = phrases.select("domain").distinct()
    located = located.join(sites, "domain", "left_semi").select(F.col("page_id").cast("bigint").alias("page_id"), "domain", "html")
    parts = located.groupBy("domain").agg(F.ceil(F.count("*") / pages_per_task).cast("int").alias("parts"))
    salt = F.pmod(F.xxhash64("page_id"), F.col("parts")).cast("int")
    rows = located.join(parts, "domain").select("page_id", "domain", text, salt.alias("salt"))
    each = phrases.join(parts, "domain").select("domain", "phrase", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return rows.groupBy("domain", "salt").cogroup(each.groupBy("domain", "salt")).applyInArrow(_of_site, _HITS)


def _rows(made: list[tuple]) -> pa.Table:
    columns = list(zip(*made)) or [()] * 5
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("domain", "phrase", "page_id", "hits", "at"), columns, kinds)})


def _of_site(rows: pa.Table, phrases: pa.Table) -> pa.Table:
    """The pages of a site, or of a part of it, with the phrases asked of that site."""
    site = SitePhrases(phrases.column("phrase").to_pylist())
    made = []
    for page, domain, text in zip(*(rows.column(c).to_pylist() for c in ("page_id", "domain", "text"))):
        made += [(domain, phrase, page, n, at) for phrase, (n, at) in site.hits(text).items()]
    return _rows(made)


def _over_sites(shared):
    """Any pages, each with the phrases of its site; a task builds the automata of the sites it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[str, SitePhrases] = {}
        for batch in batches:
            made = []
            for page, domain, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", "domain", "text"))):
                if domain not in built:
                    built[domain] = SitePhrases(shared.value.get(domain, ()))
                made += [(domain, phrase, page, n, at) for phrase, (n, at) in built[domain].hits(text).items()]
            yield from _rows(made).to_batches()

    return run


def site_search(requests: DataFrame, pages: DataFrame, top: int = TOP_PAGES) -> DataFrame:
    """The best pages for each request (request_id, domain, phrases) on the request's own site.

    A page that holds an earlier phrase of the request beats one that holds a later one; then more hits, then
    the lower page id. The best pages are found once per site and phrase, however many requests share it: a
    page among the best of a request is among the best of the phrase that puts it there. Hits are counted per
    page, and cut to the best on the map side, before a phrase gathers in one place: one that stands on a
    third of all pages is a few rows by then.
    """
    asked = requests.select("request_id", "domain", F.posexplode("phrases").alias("place", "text"))
    asked = asked.select("request_id", "domain", "place", F.array_join(words(F.col("text")), " ").alias("phrase"))
    asked = asked.where(F.col("phrase") != "")
    hits = _phrase_hits(pages, asked.select("domain", "phrase").distinct())
    best = Window.partitionBy("domain", "phrase").orderBy(F.col("hits").desc(), F.col("page_id").asc())
    best_pages = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("rank")
    found = asked.join(best_pages, ["domain", "phrase"])
    by_page = found.groupBy("request_id", "page_id").agg(
        F.min(F.struct("place", (-F.col("hits")).alias("fewer"), "at")).alias("m")
    )
    order = Window.partitionBy("request_id").orderBy("m.place", "m.fewer", "page_id")
    ranked = by_page.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("request_id", "rank", "page_id", (-F.col("m.fewer")).alias("hits"), F.col("m.at").alias("at"))


def _found_pages(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Only pages that a search found have their text extracted."""
    return pages.join(found.select("page_id").distinct(), "page_id", "left_semi")


def with_snippets(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Search results with the page address and the words around the first hit."""
    found = cut_lineage(found)  # used twice
    text = _found_pages(found, pages).select("page_id", "url", words(page_text(F.col("html"))).alias("words"))
    start = F.greatest(F.col("at") - SNIPPET_BEFORE, F.lit(1))
    snippet = F.array_join(F.slice("words", start, F.lit(SNIPPET_WORDS)), " ")
    return found.join(text, "page_id").select("request_id", "rank", "page_id", "url", "hits", snippet.alias("snippet"))


def context(found: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """What a provider would read for a request: the text of its best pages, best first, each cut to ``limit`` if given."""
    whole = page_text(F.col("html"))
    found = cut_lineage(found)  # used twice
    text = _found_pages(found, pages).select("page_id", (whole if limit is None else cap_text(whole, limit)).alias("text"))
    per_request = found.join(text, "page_id").groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("best")  # no more rows than the search keeps
    )
    return per_request.select("request_id", F.array_join("best.text", "\n\n").alias("context"))


def title_requests(pages: DataFrame) -> DataFrame:
    """Every page asks its own site for its title, else for the first two words of it."""
    title = F.col("title")
    start = F.array_join(F.slice(words(title), 1, 2), " ")
    return pages_text(pages).select(F.col("page_id").alias("request_id"), F.col("host").alias("domain"), F.array(title, start).alias("phrases"))
