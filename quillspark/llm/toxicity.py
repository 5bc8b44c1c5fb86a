"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_names, cut, map_texts

WORD = re.compile(r"[^\W_]+")
STARTS = (3, 4, 5, 6)
SAMPLE_ROWS = 4000
CACHED = 300_000
NORM = 0.7
#: Voters written down: word starts that insult, by kind and language.
LEXICONS = {
    "stupid": {"en": "idiot stupid moron imbecil dumb fool dunce halfwit", "de": "idiot dumm blöd depp trottel schwachkopf", "fr": "idiot stupid imbécil bête crétin débil abruti", "es": "idiot estúpid tonto imbécil necio bobo"},
    "worth": {"en": "worthless loser trash scum garbage pathetic useless clown", "de": "nutzlos wertlos abschaum versager clown erbärmlich", "fr": "ordure déchet perdant clown nullité minable", "es": "basura escoria perdedor payaso inútil patétic"},
    "disgust": {"en": "disgust gross vile filth nasty repuls", "de": "ekel widerlich abartig schmutz", "fr": "dégoût répugn immonde crasse", "es": "asqueros repugnan suci inmund"},
    "hate": {"en": "hate despise loathe kill vermin", "de": "hass haine töten verreck stirb", "fr": "haine tuer crever détest", "es": "odio odia matar muere despreci"},
}
#: Voters written down: how insults, threats and shouting look.
PATTERNS = {
    "address en": re.compile(r"\byou(?:'re| are)? (?:an? |such an? |all )?(?:idiot|stupid|moron|loser|clown|trash|pathetic|worthless)", re.I),
    "address de": re.compile(r"\b(?:du|ihr) (?:bist |seid )?(?:ein(?:e)? )?(?:idiot|dumm|trottel|versager|abschaum)", re.I),
    "address fr": re.compile(r"\b(?:tu es|vous êtes|espèce d[e'’]) ?(?:une? )?(?:idiot|imbécile|crétin|ordure|minable)", re.I),
    "address es": re.compile(r"\b(?:eres|sois) (?:una? )?(?:idiota|estúpid|imbécil|basura|payaso)", re.I),
    "away": re.compile(r"\b(?:shut up|go to hell|halt(?:'s| die) (?:maul|klappe)|ta gueule|ferme-la|cállate|vete al infierno)\b", re.I),
    "threat": re.compile(r"\b(?:i(?:'ll| will) (?:kill|hurt|find) you|ich bring dich um|je vais te tuer|te voy a matar)\b", re.I),
    "shout": re.compile(r"\b[A-ZÄÖÜÉÈÊÇÑ]{4,}!{2,}"),
    "marks": re.compile(r"[!?]{3,}|[#$%&*]{3,}"),
}
_STARTS = [tuple(words.split()) for kind in LEXICONS.values() for words in kind.values()]


def features(word: str) -> list[str]:
    """A word, and its first letters; both lower-cased already."""
    return [word, *(f"{word[:n]}^" for n in STARTS if len(word) > n)]


def counted(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    scale: float
    shift: float

    def word(self, w: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(w))

    def score(self, text: str, cache: dict[str, float]) -> float:
        """The chance of label 1: linear in the shares that features have of a text's words."""
        words = WORD.findall(text.lower())
        got = [cache.get(w) for w in words]
        if None in got:
            for i, w in enumerate(words):
                if got[i] is None:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[w] = got[i] = self.word(w)
        margin = self.bias + (sum(got) / norm(len(words)) if words else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale * margin + self.shift))))


def norm(n: float) -> float:
    """Counts are shares of the words, but for longer texts a little more than that, times a constant."""
    return n**NORM / 30


def dunning(n0: float, n1: float, total0: int, total1: int) -> float:
    """The log-likelihood ratio G² of being held by n1 of total1 texts of label 1 and n0 of total0 of label 0."""
    both, share = n0 + n1, (n0 + n1) / (total0 + total1)
    part = lambda n, total, p: sum(x * math.log(x / e) for x, e in ((n, total * p), (total - n, total * (1 - p))) if x > 0 and e > 0)
    return 2 * (part(n0, total0, share) + part(n1, total1, share)) if both else 0.0


def apart(ranked: list[str], most: int) -> list[str]:
    """The first features of which none is the start of another."""
    out: list[str] = []
    for f in ranked:
        stem = f.rstrip("^")
        if not any(stem.startswith(o.rstrip("^")) or o.startswith(stem) for o in out):
            out.append(f)
            if len(out) == most:
                break
    return out


def written_votes(text: str, words: Counter) -> list[int]:
    """Of each lexicon and pattern written down: 1 toxic, 0 silent."""
    n = max(1, words.total())
    return [int(sum(k for w, k in words.items() if w.startswith(starts)) > 0.004 * n) for starts in _STARTS] + [int(bool(p.search(text))) for p in PATTERNS.values()]


def mined_votes(hits: np.ndarray, n: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Of each mined term: 1 where its share of the words is beyond that in 19 of 20 texts of label 0."""
    share = hits / np.maximum(1, n)[:, None]
    limits = np.quantile(share[clean], 0.95, axis=0) if clean.any() else np.zeros(hits.shape[1])
    return (share > limits).astype(np.int8)


def clean_votes(written: np.ndarray, mined: np.ndarray) -> np.ndarray:
    """Voters for label 0, -1 where all voters of a sort are silent: the written ones, the mined ones."""
    return -np.stack((~written.any(axis=1), ~mined.any(axis=1)), axis=1).astype(np.int8)


def _counts(onehot: np.ndarray, post: np.ndarray) -> np.ndarray:
    """(label, voter, vote, voter, vote): how many texts hold both votes, by the chance of each label."""
    n, m, _ = onehot.shape
    flat = onehot.reshape(n, m * 3)
    return np.stack([(flat * p[:, None]).T @ flat for p in (1 - post, post)]).reshape(2, m, 3, m, 3)


def dependencies(onehot: np.ndarray, post: np.ndarray, free: np.ndarray, least: float = 20.0) -> np.ndarray:
    """For each voter the one that it depends on given the label, or itself: the spanning forest with the most information.

    Edges are pairs of voters whose mutual information given the label is beyond chance (2 n I over ``least``); ``free`` ones have none."""
    n, m, _ = onehot.shape
    both = _counts(onehot, post) + 1e-9
    total = both.sum(axis=(2, 4))[:, :, None, :, None]
    own = both.sum(axis=4, keepdims=True)
    other = both.sum(axis=2, keepdims=True)
    information = (both * np.log(both * total / (own * other))).sum(axis=(0, 2, 4)) / n
    information[free] = information[:, free] = 0
    np.fill_diagonal(information, 0)
    parent, inside = np.arange(m), np.zeros(m, bool)
    best, through = np.full(m, -1.0), np.arange(m)
    for _ in range(m):  # Prim's algorithm
        j = int(np.where(inside, -np.inf, best).argmax())
        inside[j] = True
        if 2 * n * best[j] > least:
            parent[j] = through[j]
        closer = ~inside & (information[j] > best)
        best[closer], through[closer] = information[j][closer], j
    return parent


def conditional(onehot: np.ndarray, post: np.ndarray, parent: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """P(vote | vote of the voter it depends on, label) as (voter, label, vote, vote of the other); drawn towards P(vote | label)."""
    m = len(parent)
    single = np.stack([np.einsum("nja,n->ja", onehot, p) for p in (1 - post, post)], axis=1) + 0.5  # (voter, label, vote)
    single = single / single.sum(axis=2, keepdims=True)
    other = onehot[:, parent]
    both = np.stack([np.einsum("nja,njb->jab", onehot * p[:, None, None], other) for p in (1 - post, post)], axis=1)
    out = both + strength * single[..., None]  # (voter, label, vote, other's vote)
    out = out / out.sum(axis=2, keepdims=True)
    alone = parent == np.arange(m)
    out[alone] = single[alone][..., None]
    return out


def belief(onehot: np.ndarray, parent: np.ndarray, tables: np.ndarray, prior: float) -> np.ndarray:
    """Each text's chance of label 1: the product over voters that vote of P(vote | vote of the other, label)."""
    ratio = np.log(tables[:, 1] / tables[:, 0])
    ratio[:, 1] = 0  # a silent voter says nothing
    evidence = sum((onehot[:, j] @ ratio[j] * onehot[:, parent[j]]).sum(axis=1) for j in range(len(parent)))
    return 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + evidence, -30, 30)))


def label_model(votes: np.ndarray, prior: float, start: np.ndarray | None = None, free: np.ndarray | None = None, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A generative model of the votes: each text's chance of label 1, each voter's table P(vote | label), and correlations.

    Expectation-maximisation over a hidden label.  Votes are not independent given it: every voter may depend on one other
    (a forest, the one that holds the most mutual information given the label), and its factor in the likelihood is
    P(vote | vote of that other, label).  So a voter that only repeats another adds nothing.  Silence counts for nothing.  ``start``
    holds first beliefs; without it the texts with the most votes for label 1 start as such.  Voters marked in ``free`` depend on none
    and none depends on them: those that are made of others' silence, which would take their evidence away, and whoever
    labelled.  Correlations are those of two voters' votes given the label.
    """
    m = votes.shape[1]
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    if start is None:
        alike = np.nan_to_num(np.corrcoef(votes.astype(float), rowvar=False).reshape(m, m)) if len(votes) > 1 and m > 1 else np.eye(m)
        order = np.argsort(-votes @ (1 / np.maximum(1, (alike > 0.75).sum(axis=1))), kind="stable")  # near copies of a voter share one voice
        start = np.full(len(votes), 0.05)
        start[order[: max(1, round(prior * len(votes)))]] = 0.95
    post, parent = start, np.arange(m)
    for k in range(rounds):
        if k in (0, 3, 8):  # first only what is all but a copy, as beliefs are rough; then twice by chance
            parent = dependencies(onehot, post, np.zeros(m, bool) if free is None else free, 20.0 if k else 0.2 * len(votes))
        before, post = post, belief(onehot, parent, conditional(onehot, post, parent), prior)
        if k > 8 and np.abs(before - post).max() < 1e-5:
            break
    table = np.stack([(onehot * p[:, None, None]).sum(axis=0) + 0.5 for p in (1 - post, post)])
    table /= table.sum(axis=2, keepdims=True)
    covariance = np.zeros((m, m))
    for y, p in enumerate((1 - post, post)):
        rest = votes - table[y] @ np.array([-1.0, 0.0, 1.0])
        covariance += (rest * p[:, None]).T @ rest / len(votes)
    size = np.sqrt(np.diag(covariance)) + 1e-9
    return post, table, covariance / size[:, None] / size[None]


def logistic(x: np.ndarray, targets: np.ndarray, ridge: float, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by Newton steps, on values of mean 1 where they aren't 0."""
    scale = float(np.abs(x[x != 0]).mean()) if x.any() else 1.0
    full = np.hstack((x / scale, np.ones((len(x), 1))))
    penalty = np.full(full.shape[1], ridge * len(x))
    penalty[-1] = 1e-6
    share = float(np.clip(targets.mean(), 1e-3, 1 - 1e-3))
    w = np.zeros(full.shape[1])
    w[-1] = math.log(share / (1 - share))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p) + 1e-6)[:, None]).T @ full + np.diag(penalty), full.T @ (targets - p) - penalty * w)
        w += step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / scale, float(w[-1])


@dataclass(frozen=True)
class Example:
    """What is learnt from one labelled text: counts of the chosen features, its number of words, the written voters' votes."""

    label: int
    words: int
    features: np.ndarray
    written: np.ndarray


def fit(examples: list[Example], chosen: list[str], terms: list[str], *, ridge: float = 1e-3, by: str = "posterior") -> Model:
    """Label model and classifier from labelled texts.

    ``chosen`` are the classifier's features, ``terms`` those of them that are mined voters.  Whoever labelled is a
    voter like others, who may err.  Labels start the label model and set the final scale; what the classifier learns from are
    the label model's posteriors (or the plain labels: ``by`` "labels", to compare).  Without any text of either
    label all scores are the share of label 1.
    """
    y = np.array([e.label for e in examples], float)
    if not len(y) or y.min() == y.max():
        return Model({}, 0.0, 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    counts = np.stack([e.features for e in examples]).astype(float)
    n = np.array([e.words for e in examples])
    written = np.stack([e.written for e in examples])
    where = {f: i for i, f in enumerate(chosen)}
    mined = mined_votes(counts[:, [where[f] for f in terms]], n, y == 0)
    votes = np.hstack((written, mined, clean_votes(written, mined), np.where(y == 1, 1, -1).astype(np.int8)[:, None])).astype(np.int8)
    used = (votes != 0).any(axis=0)
    votes, free = votes[:, used], (np.arange(votes.shape[1]) >= votes.shape[1] - 3)[used]
    post = label_model(votes, float(np.clip(y.mean(), 0.01, 0.99)), np.where(y == 1, 0.95, 0.05), free)[0] if by == "posterior" else y
    x = counts / norm(np.maximum(1, n))[:, None]
    w, b = logistic(x, post, ridge)
    a, c = logistic((x @ w + b)[:, None], y, 1e-4)
    return Model({f: float(w[i]) for i, f in enumerate(chosen)}, b, float(a[0]), c)


def choose(found: list[tuple[str, int, int]], total0: int, total1: int, *, n_features: int = 400, n_terms: int = 64, least_ratio: float = 4.0, least_g: float = 24.0) -> tuple[list[str], list[str]]:
    """The classifier's features and the mined voters' terms, from (feature, texts of label 0, of label 1 that hold it)."""
    ranked = []
    for f, n0, n1 in found:
        if (n1 + 0.5) / (total1 + 1) >= least_ratio * (n0 + 0.5) / (total0 + 1) and (g := dunning(n0, n1, total0, total1)) >= least_g:
            ranked.append((-g, f))
    chosen = [f for _, f in sorted(ranked)[:n_features]]
    return chosen, apart(chosen, n_terms)


def held_out(key):
    """The rows that are never learnt from: the CRC-32 of the key as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, learn, rows: int) -> DataFrame:
    """At most ``rows`` labelled texts, whole, chosen by a hash of the key: label, text.

    A key with both labels counts as toxic; of rows that repeat a key the one with the least hash of its text is learnt from."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("known"), F.col(label).cast("int").alias("label")).where(learn(F.col("known")))
    some = known.groupBy("known").agg(F.max("label").alias("label")).orderBy(F.xxhash64("known"), "known").limit(rows)
    texts = docs.select(F.col(key).alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(some), F.col("own") == F.col("known"))
    return cut(found.groupBy("known", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text"))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature, how many texts of label 0 and 1 hold it."""
    sums: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own: set[str] = set()
            for w in set(WORD.findall(text.as_py().lower())):
                own.update(features(w))
            sums[y].update(own)
            if len(sums[0]) + len(sums[1]) > CACHED:
                yield _sums(sums)
                sums = (Counter(), Counter())
    yield _sums(sums)


def _sums(sums: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = list(sums[0].keys() | sums[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in sums)], names=["f", "n0", "n1"])


def _examples(chosen: list[str]):
    where = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: dict[str, list[int]] = {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words, counts = counted(text), np.zeros(len(chosen), np.int32)
                for w, k in words.items():
                    if (own := inside.get(w)) is None:
                        if len(inside) >= CACHED:
                            inside.clear()
                        own = inside[w] = [where[f] for f in features(w) if f in where]
                    counts[own] += k
                for o, x in zip(out, (y, words.total(), counts.tobytes(), bytes(written_votes(text, words)))):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["label", "words", "counts", "written"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, candidates: int = 2000, least: int = 8, **how) -> Model:
    """The model learnt from at most ``sample_rows`` labelled texts that aren't held out.

    Whole texts are counted on the executors; the driver gets ``candidates`` features with their counts, and for each
    text a vector of counts and votes, of the same size however long the text."""
    some = sample(docs, labels, key=key, text=text, label=label, learn=lambda k: ~held_out(k), rows=sample_rows)
    total = {r["label"]: r["n"] for r in some.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total0, total1 = total.get(0, 0), total.get(1, 0)
    if not total0 or not total1:
        return fit([Example(y, 0, np.zeros(0), np.zeros(0)) for y, n in total.items() for _ in range(n)], [], [])
    each = some.mapInArrow(_held, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = (F.col("n1") / total1) / (F.col("n0") / total0 + 0.5 / total0)
    best = each.where((F.col("n1") >= least) & (ratio >= 2)).orderBy(F.desc(F.col("n1") - F.col("n0") * total1 / total0), "f").limit(candidates)
    chosen, terms = choose([(r["f"], r["n0"], r["n1"]) for r in best.collect()], total0, total1)  # candidates rows
    rows = some.mapInArrow(_examples(chosen), "label int, words long, counts binary, written binary").collect()  # sample_rows rows of one size
    return fit([Example(r["label"], r["words"], np.frombuffer(r["counts"], np.int32), np.frombuffer(r["written"], np.int8)) for r in sorted(rows, key=lambda r: tuple(r))], chosen, terms, **how)


def score(docs: DataFrame, model: Model, *, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the chance that a text is toxic, over its whole text; null and empty texts get the bias alone.  A column of that
    name is replaced."""
    rows = docs.select(*(c for c in docs.columns if c != column))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            at = batch.schema.names.index(text)
            found = pa.array([model.score(t.as_py() or "", cache) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, column])

    return map_texts(rows, run, f"{schema}, `{column}` double")


def report(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3, **how) -> DataFrame:
    """Scores of all documents: key, held_out, score, predicted.

    Null keys and texts keep their row (a null key is not held out); repeated rows score alike; labels that are null or
    neither 0 nor 1 are not learnt from; an empty table gives no rows; other columns are ignored, whatever their names."""
    rows = docs.select(F.col(key).alias("own"), F.col(text).alias("text"))
    scored = score(rows, train(docs, labels, key=key, text=text, **how), text="text", column="score")
    return scored.select(F.col("own").alias(key), held_out(F.col("own")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; all columns stay, whatever their names.

    Null and empty texts get the bias alone as their score, rows with null keys and repeated rows are judged like others, and an
    empty table gives none; without labels of both kinds every score is the share of label 1."""
    model = train(docs, labels, key=key, text=text, **how)
    return any_names(docs, lambda rows, t: score(rows, model, text=t, column="score").where(F.col("score") < threshold), text)
