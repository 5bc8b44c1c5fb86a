"""Which terms of a large vocabulary stand in which texts: one automaton over all terms, built once a worker."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20  # terms that one automaton holds; an automaton takes some thirty times as much
_built: dict = {}


def automaton(terms):
    """The automaton of a broadcast block of terms; a worker keeps the last one."""
    if terms.id not in _built:
        import ahocorasick

        found = ahocorasick.Automaton()
        for t in terms.value:
            found.add_word(t, t)
        found.make_automaton()
        _built.clear()
        _built[terms.id] = found
    return _built[terms.id]


class Held:
    """A broadcast with a name that survives pickling."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def edge(text: str, i: int) -> bool:
    """Whether no letter, digit or underscore stands at i."""
    return not 0 <= i < len(text) or not (text[i].isalnum() or text[i] == "_")


def spans(found, text: str, words: bool) -> list[tuple[int, int, str]]:
    """All places of terms: start, end, term; with ``words`` those between word edges."""
    if not len(found):
        return []
    every = ((end + 1 - len(t), end + 1, t) for end, t in found.iter(text))
    return [s for s in every if not words or edge(text, s[0] - 1) and edge(text, s[1])]


def longest(every: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those that stay when the text is read from the left and the longest term at each place is taken."""
    out, at = [], 0
    for start, end, t in sorted(every, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out.append((start, end, t))
            at = end
    return out


def _matches(terms: Held, words: bool, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(terms)
        for batch in batches:
            at, hit, start = [], [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text:
                    every = spans(found, text, words)
                    for s, _, t in every if places else [(None, None, t) for t in dict.fromkeys(t for _, _, t in every)]:
                        at.append(i)
                        hit.append(t)
                        start.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hit, pa.string()), pa.array(start, pa.int32())], names=["key", "term", "start"])

    return run


def matches(rows: DataFrame, vocabulary: DataFrame, key: str, text: str, term: str = "term", words: bool = False, places: bool = False) -> DataFrame:
    """(key, term, start): the lower-cased terms of a vocabulary that stand in a row's lower-cased text.

    With ``words`` only where no letter, digit or underscore touches them; with ``places`` every time, at their start in code points, else once a row and ``start``
    null.  Null and empty texts and terms match nothing; rows that repeat a key each have their matches.

    Terms are dealt by hash into blocks of BLOCK_BYTES, mostly one; each is broadcast and built into an automaton that passes once over each text, so
    the work grows with the texts and what is found, not with texts times terms, and a larger vocabulary only means more passes.
    """
    spark = rows.sparkSession
    terms = vocabulary.select(F.lower(F.col(term)).alias("t")).where("t <> ''").distinct()
    size = terms.agg(F.coalesce(F.sum(F.octet_length("t") + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    own = rows.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text"))
    schema, out = f"key {own.schema['key'].dataType.simpleString()}, term string, start int", None
    for b in range(blocks):
        part = terms.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b) if blocks > 1 else terms
        held = spark.sparkContext.broadcast(part.toArrow().column("t").to_pylist())
        found = own.mapInArrow(_matches(Held(held, f"{spark.sparkContext.applicationId}-{held._jbroadcast.id()}"), words, places), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("key", key)


def longest_matches(rows: DataFrame, vocabulary: DataFrame, key: str, text: str, term: str = "term") -> DataFrame:
    """(key, term, start): word-bounded terms as a reader from the left takes them, the longest at each place and none within another.  Keys are unique."""
    every = matches(rows, vocabulary, key, text, term, words=True, places=True).withColumn("end", F.col("start") + F.length("term"))
    listed = every.groupBy(key).agg(F.collect_list(F.struct("start", "end", "term")).alias("all"))

    @F.pandas_udf("array<struct<start: int, end: int, term: string>>")
    def chosen(lists):
        return lists.map(lambda found: [dict(zip(("start", "end", "term"), s)) for s in longest([(e["start"], e["end"], e["term"]) for e in found])])

    return listed.select(key, F.explode(chosen("all")).alias("e")).select(key, "e.term", "e.start")
