"""Choosing and arranging text for an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, truncate_at_sentence, word_set, words
from ..sources.tables import written


def drop_near_duplicates(hits: DataFrame, least: float = 0.85, query: str = "query_id", key: str = "chunk_id", score: str = "final_score", text: str = "text") -> DataFrame:
    """Hits in order of score, each kept only if its word set isn't ``least`` similar to one kept before: the hits of one query
    are a short list, folded as an array."""
    hits = hits.withColumn("_words", word_set(F.col(text)))
    lists = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col("_words").alias("w")))).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda got, x: F.when(F.exists(got, lambda g: jaccard(g["w"], x["w"]) >= least), got).otherwise(F.concat(got, F.array(x))))
    names = lists.select(query, F.explode(kept).alias("x")).select(query, F.col("x.k").alias(key))
    return hits.drop("_words").join(names, [query, key], "left_semi")


def similar_pairs(hits: DataFrame, least: float, query: str = "query_id", key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Pairs of one query's hits whose word sets are ``least`` similar, ``least`` over 0: query, key, other_id (the greater key), similarity.

    Two sets as alike as that share a word among the rarest of each: of n words it is enough to look at the n - ceil(least n) + 1 rarest.  So hits meet by their rare
    words, not each with all others, and only those that meet are compared whole.
    """
    slack = least - 1e-6  # similarities are rounded to six digits
    own = hits.select(query, key, word_set(F.col(text)).alias("w")).where("size(w) > 0")
    words_ = own.select(query, key, F.explode("w").alias("word"))
    rarity = words_.groupBy(query, "word").agg(F.count("*").alias("df"))
    sorted_ = words_.join(rarity, [query, "word"]).groupBy(query, key).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("w"))
    n = F.size("w")
    rare = sorted_.select(query, key, F.explode(F.slice("w", F.lit(1), n - F.ceil(n * slack).cast("int") + 1)).alias("word"))
    met = rare.join(rare.select(query, F.col(key).alias("other_id"), "word"), [query, "word"]).where(F.col(key) < F.col("other_id")).select(query, key, "other_id").distinct()
    pairs = met.join(own, [query, key]).join(own.select(query, F.col(key).alias("other_id"), F.col("w").alias("v")), [query, "other_id"])
    pairs = pairs.withColumn("similarity", F.round(jaccard(F.col("w"), F.col("v")), 6))
    return pairs.where(F.col("similarity") >= least).select(query, key, "other_id", "similarity")


def drop_near_duplicates_by_links(hits: DataFrame, least: float = 0.85, query: str = "query_id", key: str = "chunk_id", score: str = "final_score", text: str = "text", most_rounds: int = 100) -> DataFrame:
    """``drop_near_duplicates`` for lists of any length: pairs come from ``similar_pairs``, and the choice runs over them alone.

    In each round a hit all of whose better neighbours are out stays, and its neighbours below go.  A round decides at least the best undecided hit of every
    cluster; each is written to the shared folder, so a lost executor costs a round.  Keys are unique within a query.
    """
    spark = hits.sparkSession
    order = hits.select(query, key, F.struct((-F.col(score)).alias("s"), F.col(key).alias("k")).alias("at"))
    pairs = similar_pairs(hits, least, query, key, text)
    both = pairs.join(order, [query, key]).join(order.select(query, F.col(key).alias("other_id"), F.col("at").alias("other_at")), [query, "other_id"])
    first = F.col("at") < F.col("other_at")
    links = written(both.select(query, F.when(first, F.col(key)).otherwise(F.col("other_id")).alias("better"), F.when(first, F.col("other_id")).otherwise(F.col(key)).alias("worse")), "links")
    out = []
    for _ in range(most_rounds):
        if links.isEmpty():
            gone = out[0] if out else None
            for o in out[1:]:
                gone = gone.unionByName(o)
            return hits if gone is None else hits.join(gone, [query, key], "left_anti")
        stay = links.select(query, F.col("better").alias(key)).distinct().join(links.select(query, F.col("worse").alias(key)).distinct(), [query, key], "left_anti")
        lost = written(links.join(stay.withColumnRenamed(key, "better"), [query, "better"], "left_semi").select(query, F.col("worse").alias(key)).distinct(), "lost")
        out.append(lost)
        left = links.join(lost.withColumnRenamed(key, "worse"), [query, "worse"], "left_anti").join(lost.withColumnRenamed(key, "better"), [query, "better"], "left_anti")
        links = written(left, "links")
    raise RuntimeError(f"near duplicates were not settled in {most_rounds} rounds")


def diversify(hits: DataFrame, most: int = 2, query: str = "query_id", source: str = "source", order=("final_score", "chunk_id")) -> DataFrame:
    """A new place in the list: the first ``most`` hits of each source by score, then the rest by score."""
    by = [F.desc(order[0]), F.col(order[1])]
    nth = F.row_number().over(Window.partitionBy(query, source).orderBy(*by))
    later = hits.withColumn("source_rank", nth).withColumn("_late", (F.col("source_rank") > most).cast("int"))
    return later.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("_late", *by))).drop("_late")


def within_budget(hits: DataFrame, budget: int = 3000, least_left: int = 50, query: str = "query_id", place: str = "place", text: str | Column = "text") -> DataFrame:
    """Hits in order of place while their tokens fit; the first that doesn't is cut if more than ``least_left`` tokens are left, then the list ends.
    Adds tokens, used (before it), is_cut and citation_id; ``cut`` does the cutting."""
    sized = hits.withColumn("tokens", F.size(words(F.col(text) if isinstance(text, str) else text)))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(query).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sized.withColumn("used", before).withColumn("is_cut", F.col("used") + F.col("tokens") > budget)
    fits = sized.where(~F.col("is_cut") | ((F.col("used") <= budget) & (budget - F.col("used") > least_left)))
    return fits.withColumn("citation_id", F.row_number().over(Window.partitionBy(query).orderBy(place)))


def cut(text: Column, tokens: Column, left: Column) -> Column:
    """As many characters of a text as its share of ``left`` tokens allows, ended at a sentence if one ends in the last tenth; then no
    more words than are left, where the share by characters has too many."""
    part = truncate_at_sentence(F.substring(text, F.lit(1), F.floor(F.length(text) * F.try_divide(left, tokens)).cast("int")))
    return F.when(F.size(words(part)) <= left, part).otherwise(F.array_join(F.slice(words(part), F.lit(1), F.greatest(left, F.lit(0)).cast("int")), " "))
