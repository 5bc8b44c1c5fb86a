"""Understanding queries with vocabularies that the caller supplies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strings
from . import dictionary

# fixed values: hints that a query wants a kind of section, in the order in which ties are settled
HINTS = {
    "mechanism": "methods", "protocol": "methods", "how to": "methods", "procedure": "methods", "technique": "methods",
    "result": "results", "outcome": "results", "finding": "results", "efficacy": "results", "effect": "results", "association": "results",
    "background": "introduction", "review": "introduction", "discuss": "discussion", "implication": "discussion", "conclusion": "discussion",
}

# fixed values: what the embedding model wants before a query
PREFIX = "Represent this question for searching relevant passages: "
NO_MAP = "cast(map() as map<string, array<string>>)"


def clean(query: Column) -> Column:
    """White space runs as one space, Chinese punctuation as a space, nothing at the ends."""
    spaced = F.regexp_replace(F.regexp_replace(query, r"(?U)\s+", " "), "[。？！，、；：]", " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def translate(query: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replaces each term in the order given, as it stands: an earlier short term can pre-empt a longer one, and neighbours may touch."""
    for term, english in pairs:
        query = F.replace(query, F.lit(term), F.lit(english))
    return query


def entities(query: Column, patterns: dict[str, str]) -> Column:
    """A map from class to the distinct lower-cased matches of its pattern; classes without a match are left out."""
    found = [F.struct(F.lit(name).alias("key"), F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(f"(?iU)\\b({p})\\b"), F.lit(1)), F.lower)).alias("value")) for name, p in patterns.items()]
    return F.map_from_entries(F.filter(F.array(*found), lambda e: F.size(e["value"]) > 0))


def abbreviations(queries: DataFrame, vocabulary: DataFrame, query: str = "query_id", text: str = "query") -> DataFrame:
    """(query, term, expansions): a query's words that the vocabulary (term, expansions) knows."""
    own = queries.select(query, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0)))).alias("term"))
    return own.join(vocabulary.select("term", "expansions"), "term").select(query, "term", "expansions")


def synonyms(queries: DataFrame, vocabulary: DataFrame, query: str = "query_id", text: str = "query") -> DataFrame:
    """(query, term, expansions): vocabulary terms that are in the query's text, also inside words.  An automaton finds them, whatever the size of the vocabulary."""
    found = dictionary.matches(queries, vocabulary, query, text).select(query, F.col("term").alias("_found"))
    return found.join(vocabulary.select("term", "expansions"), F.lower("term") == F.col("_found")).select(query, "term", "expansions")


def find_entities(queries: DataFrame, vocabulary: DataFrame, query: str = "query_id", text: str = "query") -> DataFrame:
    """(query, entities): a map from class to the distinct terms of a vocabulary (term, class) in a query, lower-cased and in order; at each place the longest term, and only
    whole words.  Queries without any are left out."""
    found = dictionary.longest_matches(queries, vocabulary, query, text).select(query, "term").distinct()
    named = found.join(vocabulary.select(F.lower("term").alias("term"), F.col("class").alias("kind")).distinct(), "term")
    lists = named.groupBy(query, "kind").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return lists.groupBy(query).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "terms")))).alias("entities"))


def time_range(query: Column, year: int) -> Column:
    """struct(lo, hi) of the first rule that the query meets, or null.  The current year is a parameter; a number of years beyond a
    long leaves lo null."""
    number = lambda p, g=1: F.regexp_extract(query, p, g)
    rule = lambda p, lo, hi: F.when(query.rlike(p), F.struct(lo.try_cast("int").alias("lo"), hi.try_cast("int").alias("hi")))
    now, n = F.lit(year), lambda p, g=1: F.least(number(p, g).try_cast("bigint"), F.lit(10**12))
    # fixed values: the patterns of the rules, in their order
    last, past, since, after = r"(?i)last\s+(\d+)\s+years?", r"(?i)past\s+(\d+)\s+years?", r"(?i)since\s+(20\d{2})", r"(?i)after\s+(20\d{2})"
    before, between, within, recent = r"(?i)before\s+(20\d{2})", r"(?i)between\s+(20\d{2})\s+and\s+(20\d{2})", r"(?i)in\s+(20\d{2})", r"(?i)recent(?:ly)?"
    return F.coalesce(
        rule(last, now - n(last), now), rule(past, now - n(past), now), rule(since, n(since), now), rule(after, n(after) + 1, now),
        rule(before, F.lit(1900), n(before) - 1), rule(between, n(between), n(between, 2)), rule(within, n(within), n(within)), rule(recent, now - 5, now),
    )


def time_filter(lo: Column, hi: Column, field: str = "pub_year") -> Column:
    """A time range as a filter dictionary in JSON, as ``filters.compile_filter`` takes it: one year, or from and to; null without a range."""
    bound = lambda op, v: F.concat(F.lit(f'{{"{field}": {{"{op}": '), v.cast("string"), F.lit("}}"))
    both = F.concat(F.lit('{"$and": ['), bound("$gte", lo), F.lit(", "), bound("$lte", hi), F.lit("]}"))
    return F.when(lo == hi, bound("$eq", lo)).otherwise(both)


def section_votes(queries: DataFrame, hints: dict[str, str] | None = None, query: str = "query_id", text: str = "query") -> DataFrame:
    """(query, section, votes): the kind of section that most hints in the query speak for, ties to the one listed first."""
    listed = list((hints or HINTS).items())
    entries = F.array(*(F.struct(F.lit(word).alias("word"), F.lit(kind).alias("section"), F.lit(i).alias("ord")) for i, (word, kind) in enumerate(listed)))
    hits = queries.select(query, F.explode(F.filter(entries, lambda e: F.contains(F.lower(F.col(text)), e["word"]))).alias("e"))
    votes = hits.groupBy(query, "e.section").agg(F.count("*").alias("votes"), F.min("e.ord").alias("ord"))
    best = Window.partitionBy(query).orderBy(F.desc("votes"), "ord")
    return votes.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(query, "section", "votes")


def keyword_query(cleaned: Column, expansions: Column) -> Column:
    """The cleaned query and the distinct expansions that aren't in it yet."""
    more = F.filter(F.array_distinct(F.coalesce(expansions, strings([]))), lambda x: ~F.contains(F.lower(cleaned), F.lower(x)))
    return F.array_join(F.concat(F.array(cleaned), more), " ")


def merge_vocabularies(base: DataFrame, more: DataFrame) -> DataFrame:
    """(term, expansions) of both, terms lower-cased; expansions that are only written differently aren't repeated."""
    b = base.select(F.lower("term").alias("term"), F.col("expansions").alias("b"))
    m = more.select(F.lower("term").alias("term"), F.col("expansions").alias("m"))
    none = strings([])
    own, new = F.coalesce("b", none), F.coalesce("m", none)
    fresh = F.filter(new, lambda x: ~F.exists(own, lambda y: F.lower(y) == F.lower(x)))
    return b.join(m, "term", "full_outer").select("term", F.concat(own, fresh).alias("expansions"))


def understand(queries: DataFrame, short: DataFrame, alike: DataFrame, year: int, chinese: list[tuple[str, str]] = (), patterns: dict[str, str] | None = None, prefix: str = PREFIX, query: str = "query_id", text: str = "query") -> DataFrame:
    """All of it at once, in this order: translate, clean, entities, abbreviations, synonyms (also of the abbreviations' full forms), time
    range, section, queries for both paths.  One row each: query, cleaned, language, entities, abbreviations and synonyms (maps),
    expanded_terms, vector_query, keyword_query, lo, hi, section.

    short and alike: term, expansions, a row a term.  Abbreviations come in the text's order; then synonyms of the text's terms, then those of
    full forms, each by term.  The vector query is the prefix and the text as it was asked.
    """
    from ..functions.text import language

    own = queries.select(query, F.col(text).alias("_raw"), clean(translate(F.col(text), list(chinese))).alias("cleaned"))
    place = F.array_position(F.regexp_extract_all(F.lower("cleaned"), F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0)), F.col("term"))
    full = abbreviations(own, short, query, "cleaned").join(own.select(query, "cleaned"), query).withColumn("_at", place)
    direct = synonyms(own, alike, query, "cleaned").withColumn("_at", F.lit(0).cast("long"))
    forms = full.select(query, F.explode("expansions").alias("term")).join(alike.select("term", "expansions"), "term").withColumn("_at", F.lit(1).cast("long"))
    same = direct.unionByName(forms).groupBy(query, "term").agg(F.min("_at").alias("_at"), F.first("expansions").alias("expansions"))
    listed = lambda rows, name: rows.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("_at", "term", "expansions"))).alias(name))
    votes = section_votes(own, None, query, "cleaned").select(query, "section")
    out = own.join(listed(full, "_a"), query, "left").join(listed(same, "_s"), query, "left").join(votes, query, "left")
    as_map = lambda c: F.coalesce(F.map_from_entries(F.transform(c, lambda e: F.struct(e["term"], e["expansions"]))), F.expr(NO_MAP))
    terms = lambda c: F.coalesce(F.flatten(F.transform(c, lambda e: e["expansions"])), strings([]))
    out = out.withColumn("expanded_terms", F.array_distinct(F.concat(terms("_a"), terms("_s")))).withColumn("_t", time_range(F.col("cleaned"), year))
    return out.select(
        query, "cleaned", language(F.col("_raw")).alias("language"), (entities(F.col("cleaned"), patterns) if patterns else F.expr(NO_MAP)).alias("entities"), as_map("_a").alias("abbreviations"), as_map("_s").alias("synonyms"),
        "expanded_terms", F.concat(F.lit(prefix), "_raw").alias("vector_query"), keyword_query(F.col("cleaned"), F.col("expanded_terms")).alias("keyword_query"), F.col("_t.lo").alias("lo"), F.col("_t.hi").alias("hi"), "section",
    )
