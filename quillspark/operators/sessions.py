"""Sessions, caches, registries and call statistics as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean(value: str, digits: int = 4) -> Column:
    """The mean by decimal sums (six digits a value), so halves round up whatever the order of rows; null for what is no number."""
    return F.round(F.avg(F.col(value).try_cast("decimal(28,6)")), digits).cast("double")


def turns(messages: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A user's message with the assistant's that follows: session, turn, query, answer."""
    order = Window.partitionBy(session).orderBy(turn)
    pairs = messages.withColumns({"_next": F.lead("text").over(order), "_role": F.lead("role").over(order)})
    return pairs.where("role = 'user' and _role = 'assistant'").select(session, turn, F.col("text").alias("query"), F.col("_next").alias("answer"))


def last_turns(rows: DataFrame, n: int, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    order = Window.partitionBy(session).orderBy(F.desc(turn))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def context_prefix(rows: DataFrame, n: int = 3, answer_chars: int = 300, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n turns of each session as one text, answers cut."""
    line = F.concat(F.lit("Q: "), F.col("query"), F.lit("\nA: "), F.substring("answer", 1, answer_chars))
    ordered = last_turns(rows, n, session, turn).groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l")))).alias("ls"))
    return ordered.select(session, F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("prefix"))


def active(events: DataFrame, now: Column, idle_seconds: int, session: str = "user_id", ts: str = "ts") -> DataFrame:
    """Each session's turns and last activity, and whether it is idle for no more than ``idle_seconds``."""
    last = events.groupBy(session).agg(F.count("*").alias("n_turns"), F.max(ts).alias("last_active"))
    return last.withColumn("is_active", F.unix_timestamp(now) - F.unix_timestamp("last_active") <= idle_seconds)


def call_stats(calls: DataFrame, failed: Column, latency: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Calls, successes, failures, success rate and mean latency; rates are 0 without calls."""
    out = calls.groupBy(*by).agg(F.count("*").alias("n_calls"), F.count_if(~failed).alias("n_ok"), F.count_if(failed).alias("n_failed"), mean(latency).alias("_mean"))
    rate = F.coalesce(F.try_divide(F.col("n_ok"), F.col("n_calls")), F.lit(0.0))
    return out.select(*by, "n_calls", "n_ok", "n_failed", F.round(rate, 4).alias("success_rate"), F.coalesce("_mean", F.lit(0.0)).alias("mean_latency"))


def live_entries(entries: DataFrame, now: Column, ttl_seconds: int, most: int, ts: str = "last_access", key: str = "cache_key") -> DataFrame:
    """Cache entries that aren't too old, the ``most`` used last."""
    order = Window.orderBy(F.desc(ts), key)
    fresh = entries.where(F.unix_timestamp(now) - F.unix_timestamp(ts) <= ttl_seconds)
    return fresh.orderBy(F.desc(ts), key).limit(most).withColumn("recency", F.row_number().over(order))


def merge_seen(seen: DataFrame, new: DataFrame, session: str = "session_id", key: str = "chunk_id", score: str = "score") -> DataFrame:
    """The registry after a batch: the best score of each chunk in each session, and whether the batch saw it for the first time."""
    both = seen.select(session, key, score, F.lit(True).alias("_old")).unionByName(new.select(session, key, score, F.lit(False).alias("_old")))
    return both.groupBy(session, key).agg(F.max(score).alias(score), (~F.bool_or("_old")).alias("is_new"))


def seen_ids(seen: DataFrame, session: str = "session_id", key: str = "chunk_id") -> DataFrame:
    """Each session's seen keys as one sorted list."""
    return seen.groupBy(session).agg(F.array_sort(F.collect_set(key)).alias("seen"))


def clear_seen(seen: DataFrame, gone: DataFrame | None = None, session: str = "session_id") -> DataFrame:
    """The registry without the sessions of ``gone``, or empty if none are named."""
    return seen.limit(0) if gone is None else seen.join(gone.select(session).distinct(), session, "left_anti")


def cacheable(temperature: Column, most: float = 0.2) -> Column:
    """Only answers of a generator that hardly varies are remembered; a missing temperature isn't."""
    return F.coalesce(temperature <= most, F.lit(False))


def first_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key wasn't there earlier."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def terminated(elapsed: Column, timeout: int, iterations: Column, most: int) -> Column:
    """Why a run ends: the time-out counts first; null if it goes on."""
    return F.when(elapsed > timeout, "timeout").when(iterations >= most, "max_iterations")


def flatten_traces(rows: DataFrame, session: str, turn: str, trace: str, step: str | None = None) -> DataFrame:
    """One row a step of every turn's trace, with its place; only steps of that name if one is given."""
    flat = rows.select(session, turn, F.posexplode(trace).alias("pos", "_s")).select(session, turn, "pos", "_s.*")
    return flat.where(F.col("step") == step) if step else flat


def memo_hits(calls: DataFrame, key: list[str], order: list[str], ts: str, ttl_seconds: int) -> DataFrame:
    """Whether each call would find its key remembered: a call, found or not, keeps a key for ``ttl_seconds`` more."""
    before = F.lag(ts).over(Window.partitionBy(*key).orderBy(*order))
    return calls.withColumn("hit", F.coalesce(F.unix_timestamp(ts) - F.unix_timestamp(before) <= ttl_seconds, F.lit(False)))


def hit_rate(calls: DataFrame, hit: str = "hit", by: tuple[str, ...] = ()) -> DataFrame:
    """hits, misses and their rate, 0 without calls."""
    out = calls.groupBy(*by).agg(F.count_if(F.col(hit)).alias("hits"), F.count_if(~F.col(hit)).alias("misses"))
    return out.withColumn("hit_rate", F.round(F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)), 4))


def wall_stats(calls: DataFrame, failed: Column, seconds: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Errors, and the least, mean and longest time of a batch's calls."""
    return calls.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_errors"), F.min(seconds).alias("least"), mean(seconds).alias("mean"), F.max(seconds).alias("most"))
