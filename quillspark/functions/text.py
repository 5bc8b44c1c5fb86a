"""Text rules as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no weight in ranking
STOPWORDS = (
    "a an the of in on at to for and or is are was were be been being this that these those with by from as it its we our "
    "their which study studies results result using used between among also than then not no yes have has had such can may "
    "might one two during after before into over significant significantly"
).split()
# fixed values: a section's kind by words in its title, tried in this order
IMRAD = {
    "introduction": "introduction background objective aim rationale hypothesis overview".split(),
    "methods": "method material patient cohort procedure protocol design participant subject experiment statistical statistic analys".split(),
    "results": "result finding outcome observation".split(),
    "discussion": "discussion conclusion interpretation implication limitation future suggest recommend".split(),
}
# fixed values: sections that are no content
NOISE = ["reference", "acknowledge", "conflict", "competing", "funding", "author contribution", "supplementary", "appendix", "abbreviation", "declaration", "ethical approval", "data availability", "supporting information", "additional file"]
# fixed values: article types that are left out
DROPPED_TYPES = ["correction", "retraction", "editorial", "letter", "book-review", "news", "reply", "article-commentary", "discussion", "abstract", "product-review", "meeting-report"]
# fixed values: spellings of a journal
JOURNAL_ALIASES = {"PLOS One": "PLoS ONE", "PLOS ONE": "PLoS ONE", "Plos One": "PLoS ONE"}
# fixed values: what a ranking term is, and a word of any script
TOKEN = r"[a-zA-Z][a-zA-Z0-9\-]{1,}"
WORD = r"[\p{L}\p{N}_]+"


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.expr("cast(array() as array<string>)")


def tokens(text: Column, stopwords=STOPWORDS) -> Column:
    """Ranking terms, repeats included: lower-cased Latin words of two characters or more that aren't stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def text_tokens(text: str | None, stopwords=STOPWORDS) -> list[str]:
    """``tokens`` of one string in Python."""
    return [t for t in re.findall(TOKEN, (text or "").lower()) if t not in stopwords]


def words(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    """Distinct lower-cased words of letters, digits and underscores, in any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def clean_title(title: Column) -> Column:
    """Without a leading number like 2.1; as it is if nothing else is in it."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(title, r"^\d+(\.\d+)*\.?\s+", "")), F.lit("")), title)


def _holds_any(text: Column, parts) -> Column:
    return F.exists(strings(parts), lambda p: F.contains(text, p))


def imrad(title: Column) -> Column:
    low, out = F.lower(clean_title(title)), None
    for kind, parts in IMRAD.items():
        out = F.when(_holds_any(low, parts), kind) if out is None else out.when(_holds_any(low, parts), kind)
    return out.otherwise("other")


def is_noise(title: Column) -> Column:
    return _holds_any(F.lower(clean_title(title)), NOISE)


def valid_pmid(pmid: Column) -> Column:
    """Digits, but not 0; anything else is null."""
    return F.when(pmid.rlike("^[0-9]+$") & (pmid != "0"), pmid)


def source_url(pmid: Column, doi: Column, pmc: Column) -> Column:
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), valid_pmid(pmid), F.lit("/")),
        F.concat(F.lit("https://doi.org/"), filled(doi)),
        F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), filled(pmc), F.lit("/")),
    )


def journal_name(journal: Column) -> Column:
    out = journal
    for alias, name in JOURNAL_ALIASES.items():
        out = F.when(journal == alias, name).otherwise(out)
    return out


def composed_date(year: Column, month: Column, day: Column) -> Column:
    """Year-month-day as text; a month or day that is missing or no number is the first, without a year there is none."""
    number = lambda c: F.coalesce(F.trim(c).try_cast("int"), F.lit(1))
    return F.when(F.trim(year) != "", F.format_string("%s-%02d-%02d", F.trim(year), number(month), number(day)))


def kept_type(kind: Column) -> Column:
    return ~F.lower(F.coalesce(kind, F.lit("other"))).isin(DROPPED_TYPES)


def not_retracted(flag: Column) -> Column:
    """Everything but yes; a missing flag stays."""
    return ~F.lower(flag).eqNullSafe("yes")


def preview(text: Column, most: int = 200) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def rouge_tokens(text: Column) -> Column:
    """What overlap is counted in: characters of a text that holds Chinese ones, else words."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.rlike("[\\x{4e00}-\\x{9fff}]"), F.filter(F.split(t, ""), lambda c: ~c.rlike(r"^\s*$"))).otherwise(words(t))


def language(query: Column) -> Column:
    return F.when(query.rlike("[\\x{4e00}-\\x{9fff}]"), "zh").otherwise("en")


# fixed value: how an answer cites a source
CITATION = r"\[来源\s*(\d+)\]"


def citations(text: Column) -> Column:
    """Numbers of the citations in a text, repeats included; one too long for a long is the greatest long, which no source has."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1)), lambda n: F.coalesce(n.try_cast("bigint"), F.lit(2**63 - 1)))


def cache_key(parts: Column) -> Column:
    """SHA-256 of a map's entries, sorted and joined, so order doesn't matter."""
    entries = F.array_sort(F.transform(F.map_entries(parts), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.sha2(F.array_join(entries, "\u001f"), 256)


# fixed values: abbreviations, labels of a structured abstract, and words that speak for one of its parts
ABBREVIATION = r"(?<![\p{L}\p{N}_])([A-Z]{2,6}(?:[/-][A-Z]{1,4})?)(?![\p{L}\p{N}_])"
STRUCTURED = r"(?i)(?:^|\n)\s*(BACKGROUND|INTRODUCTION|OBJECTIVE|AIM|PURPOSE|METHODS?|MATERIALS?\s+AND\s+METHODS?|RESULTS?|FINDING|CONCLUSIONS?|SUMMARY)\s*[:\.]"
PARTS = {
    "background": r"(?i)\b(background|introduction|objective|aims?|purpose|previously|recent(?:ly)?)\b",
    "methods": r"(?i)\b(method|material|patient|subject|design|procedure|protocol|cohort|trial|enrol)\b",
    "results": r"(?i)\b(result|finding|outcome|observ|show|found|demonstrated|revealed)\b",
    "conclusion": r"(?i)\b(conclusion|suggest|indicate|implicat|recommend|therefore|thus)\b",
}


def abbreviations(text: Column) -> Column:
    """Words of two to six capitals, repeats included."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ABBREVIATION), F.lit(1))


def structure(text: Column) -> Column:
    """struct(structured, background, methods, results, conclusion): explicit labels, and words for each part."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(t.rlike(STRUCTURED).alias("structured"), *(t.rlike(p).alias(name) for name, p in PARTS.items()))


def tool_key(tool: Column, arguments: Column) -> Column:
    """SHA-256 of a tool's name and its arguments as JSON, sorted by name, so order doesn't matter."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(arguments)))
    return F.sha2(F.concat(tool, F.lit("\u001f"), F.to_json(ordered)), 256)


def abstract_or_body(abstract: Column, body: Column, least: int = 50, most: int = 500) -> Column:
    """struct(text, source): the abstract, or the start of the body where it is missing or shorter than ``least``; null without a body then."""
    filled = F.nullif(F.trim(body), F.lit(""))
    fallback = F.when(filled.isNotNull(), F.struct(F.substring(body, 1, most).alias("text"), F.lit("body_fallback").alias("source")))
    return F.when(F.length(F.coalesce(abstract, F.lit(""))) < least, fallback).otherwise(F.struct(abstract.alias("text"), F.lit("original").alias("source")))


def truncate_at_sentence(text: Column, share: float = 0.1) -> Column:
    """Up to the last full stop in the last tenth of a text; all of it if there is none."""
    start = F.floor(F.length(text) * F.lit(1 - share)).cast("int")
    tail = F.substring(text, start + 1, F.length(text))

    def last(mark: str) -> Column:
        back = F.locate(mark[::-1], F.reverse(tail))
        return F.when(back > 0, F.length(tail) - back - len(mark) + 1).otherwise(-1)

    cut = F.greatest(last("。"), last(". "), last(".\n"))
    return F.when(cut < 0, text).otherwise(F.regexp_replace(F.substring(text, F.lit(1), start + cut + 1), r"\s+$", ""))
