"""Articles in XML and pages in HTML as rows."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: parts of a body that hold no paragraphs, parts of which only the caption counts, and the years' order
SKIPPED = {"title", "label", "ref-list", "ack", "fn-group", "app-group", "back", "glossary", "def", "xref"}
CAPTIONED = {"table-wrap", "fig", "supplementary-material"}
YEAR_ORDER = ("epub", "ppub", "collection")
LEAST_ABSTRACT, FALLBACK, LEAST_PARAGRAPH, LEAST_CAPTION = 50, 500, 30, 20
ARTICLE = "pmc_id string, pmid string, doi string, title string, journal string, pub_year long, article_type string, abstract string, body string, paragraphs array<struct<pos: int, text: string, section_title: string, section_path: string>>"


def full_text(node) -> str:
    return "" if node is None else "".join(node.itertext()).strip()


def plain_title(title: str) -> str:
    """Without a leading number; as it is if nothing else is in it."""
    return re.sub(r"^\d+(\.\d+)*\.?\s+", "", title).strip() or title


def body_paragraphs(node, noise, path: tuple[str, ...] = (), out: list | None = None) -> list[tuple[str, str, str]]:
    """(text, section title, section path) in reading order; ``noise`` says which titles to leave out."""
    out = [] if out is None else out
    for part in node:
        if part.tag == "sec":
            title = plain_title(full_text(part.find("title")))
            if not noise(title):
                body_paragraphs(part, noise, (*path, title) if title else path, out)
        elif part.tag in CAPTIONED:
            if len(caption := full_text(part.find(".//caption"))) > LEAST_CAPTION:
                out.append((f"[{'Table' if part.tag == 'table-wrap' else 'Figure'}] {caption}", path[-1] if path else "", " > ".join(path)))
        elif part.tag not in SKIPPED and len(text := full_text(part)) > LEAST_PARAGRAPH:
            out.append((text, path[-1] if path else "", " > ".join(path)))
    return out


def year_of(root) -> int | None:
    """Of the first date of each kind, in YEAR_ORDER; else of the first date that has a year."""
    kinds = (root.find(f".//pub-date[@pub-type='{kind}']") for kind in YEAR_ORDER)
    found = [d.findtext("year") for d in kinds if d is not None] + [root.findtext(".//pub-date/year")]
    return next((int(y) for y in found if y and y.isascii() and y.isdigit()), None)


def parse_article(xml: bytes | str, noise) -> tuple | None:
    """The fields of ARTICLE; None if it can't be parsed or holds neither abstract nor body."""
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, ValueError, TypeError):
        return None
    ids = {i.get("pub-id-type"): full_text(i) for i in root.iter("article-id")}
    body = root.find(".//body")
    abstract, text = full_text(root.find(".//abstract")), full_text(body)
    if not text and len(abstract) < LEAST_ABSTRACT:
        return None
    rows = [] if body is None else body_paragraphs(body, noise)
    own = [{"pos": i, "text": t, "section_title": s, "section_path": p} for i, (t, s, p) in enumerate(rows)]
    return (ids.get("pmc"), ids.get("pmid"), ids.get("doi"), full_text(root.find(".//article-title")), full_text(root.find(".//journal-title")), year_of(root), root.get("article-type") or "other", abstract, text, own)


AT_ONCE = 256  # articles that a task holds in pieces


def read_articles(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """One row an article: abstract or the start of its body, paragraphs, the journal's usual name, a PMID only if valid, and source_url."""

    def noise(title: str) -> bool:
        return any(word in title.lower() for word in T.NOISE)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in ARTICLE.split(", ") if not c.strip().startswith(("text", "section"))]
        for frame in frames:
            for i in range(0, len(frame), AT_ONCE):
                some = frame.iloc[i : i + AT_ONCE]
                found = [(p, *a) for p, x in zip(some[path], some[content]) if (a := parse_article(x, noise)) is not None]
                yield pd.DataFrame(found, columns=["path", *names])

    rows = files.select(path, content).mapInPandas(run, f"path string, {ARTICLE}")
    short = F.length("abstract") < LEAST_ABSTRACT
    return rows.withColumns({"abstract_source": F.when(short, "body_fallback").otherwise("original"), "abstract": F.when(short, F.substring("body", 1, FALLBACK)).otherwise(F.col("abstract"))}).withColumns(
        {"journal": T.journal_name(F.nullif(F.col("journal"), F.lit(""))), "pmid": T.valid_pmid(F.trim("pmid")), "source_url": T.source_url(F.trim("pmid"), F.col("doi"), F.col("pmc_id")), "body_chars": F.length("body")}
    )


PROFILED = "pmid string, pmc_id string, doi string, title string, journal string, dates array<struct<year: string, month: string, day: string>>, abstract string, body_chars int, keywords array<string>, article_type string"


def profiled(xml: bytes | str) -> tuple | None:
    """The fields of PROFILED; None if it can't be parsed or has no front."""
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, ValueError, TypeError):
        return None
    if root.find(".//front") is None:
        return None
    ids = {i.get("pub-id-type"): (i.text or "").strip() or None for i in root.iter("article-id")}
    kinds = (root.find(f".//pub-date[@pub-type='{kind}']") for kind in YEAR_ORDER)
    dates = [{part: d.findtext(part) for part in ("year", "month", "day")} for d in kinds if d is not None]
    words = [full_text(k) for k in root.iter("kwd")]
    whole = lambda path: full_text(root.find(path)) or None
    return (ids.get("pmid"), ids.get("pmc"), ids.get("doi"), whole(".//article-title"), whole(".//journal-title"), dates, whole(".//abstract"), len(full_text(root.find(".//body"))), [w for w in words if w] or None, root.get("article-type"))


def profile_articles(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """For a profile of a collection, one row an article, no rules applied: ids, title, journal, pub_date (of the first kind of date that has a year, in YEAR_ORDER), abstract,
    body_chars, keywords, article_type."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "pmid", "pmc_id", "doi", "title", "journal", "dates", "abstract", "body_chars", "keywords", "article_type"]
        for frame in frames:
            found = [(p, *a) for p, x in zip(frame[path], frame[content]) if (a := profiled(x)) is not None]
            yield pd.DataFrame(found, columns=names)

    rows = files.select(path, content).mapInPandas(run, f"path string, {PROFILED}")
    first = F.get(F.filter("dates", lambda d: F.trim(d["year"]) != ""), F.lit(0))
    return rows.withColumn("pub_date", T.composed_date(first["year"], first["month"], first["day"])).drop("dates")


def article_paragraphs(articles: DataFrame) -> DataFrame:
    """doc_id (the PMC id, or else the path), pos, text, section_title, section_path of every body paragraph."""
    return articles.select(F.coalesce("pmc_id", "path").alias("doc_id"), F.explode("paragraphs").alias("p")).select("doc_id", "p.*")


class _Paragraphs(HTMLParser):
    """Text of paragraphs and headings, whatever is left open."""

    STARTS = {"p", "h1", "h2", "h3", "li", "div", "article", "td"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.hidden = [], [], 0

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.STARTS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.STARTS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.held.append(data)


def html_paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, text of each page's paragraphs."""

    @F.pandas_udf("array<string>")
    def parse(series: pd.Series) -> pd.Series:
        def one(x):
            parser = _Paragraphs()
            parser.feed(x or "")
            parser.close()
            parser.flush()
            return parser.out

        return series.map(one)

    return pages.select(key, F.posexplode(parse(F.col(html))).alias("pos", "text"))


def sections_of(xml: bytes | str) -> list[tuple[str, str]]:
    """(title, text) of every section of the body at any depth: text inside an inner section counts for the outer one too."""
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, ValueError, TypeError):
        return []
    return [(full_text(sec.find("title")), full_text(sec)) for body in root.iter("body") for sec in body.iter("sec")]


def flat_sections(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """path, pos, title, text of every section; articles that can't be parsed have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(p, i, t, x) for p, c in zip(frame[path], frame[content]) for i, (t, x) in enumerate(sections_of(c))]
            yield pd.DataFrame(found, columns=["path", "pos", "title", "text"])

    return files.select(path, content).mapInPandas(run, "path string, pos int, title string, text string")
