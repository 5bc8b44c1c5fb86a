"""Secret scans: keywords by Aho-Corasick, anchored patterns near their hits, embedded checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_names, map_texts

BASE = ("assign", "access", "hex")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = {c: c + 32 for c in range(65, 91)}


def base62_crc(body: str, check: str) -> bool:
    """Do six base-62 digits hold the CRC-32 of the characters before them?"""
    n = zlib.crc32(body.encode())
    digits = ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits == check


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    return sum(digits[-1::-2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2]) % 10


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?:gh[opsur]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CARD = re.compile(r"(?i:card)[^\n0-9]{0,24}?((?:[0-9][ -]?){12,18}[0-9])(?![0-9])", re.ASCII)
IBAN = re.compile(r"(?i:iban)[^\nA-Z0-9]{0,8}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.ASCII)
#: Keyword, lower-cased: the kind of span that may start at it.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked", "card": "card", "iban": "iban",
}
KINDS = (*BASE, "checked", "card", "iban")
#: Letters and digits of an IBAN by its country, as registered; a country not listed here may have any length.
IBAN_SIZES = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22,
    IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SE=24, SI=19, SK=24,
    SM=27, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
_automata: list = []


def automaton():
    if not _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def shorter(run: str, good, sizes) -> int:
    """Where the longest start of a run ends that passes its checksum, 0 if none does.

    ``sizes`` are the numbers of letters and digits it may have; it ends where a group ends, at the run's end or before a space or hyphen.
    """
    ends = [i for i in range(len(run), 0, -1) if run[i - 1] not in " -" and (i == len(run) or run[i] in " -")]
    return next((i for i in ends if sum(c not in " -" for c in run[:i]) in sizes and good(run[:i])), 0)


def iban_sizes(run: str):
    return (IBAN_SIZES[run[:2]],) if run[:2] in IBAN_SIZES else range(15, 35)


def scan(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, by start and then by kind as listed in KINDS.

    One automaton pass finds the keywords; a kind's pattern is tried at their places only, and not
    within a match of the same kind, which is what a scan from the left gives.  Runs of hexadecimal digits have no keyword;
    their length is the test.  Tokens, card numbers and account numbers count only if their checksums hold.  Of a run of
    digit groups or words whose checksum fails, the longest start that is a number of 13 to 19 digits or an account
    number of its country's length counts.
    """
    found: list[tuple[int, int, str]] = []
    low = text.lower() if text.isascii() else text.translate(LOWER)
    free = dict.fromkeys(KINDS, 0)
    hits = sorted((end - n + 1, kind) for end, (n, kind) in automaton().iter(low))
    for at, kind in hits:
        if at < free[kind]:
            continue
        pattern = {"assign": ASSIGN, "access": ACCESS, "checked": TOKEN, "card": CARD, "iban": IBAN}[kind]
        if m := pattern.match(text, at):
            span, good = m.span(), True
            if kind == "assign":
                good = len(m[1]) >= 6
            elif kind == "access":
                good = len(m[0]) >= 20
            elif kind == "checked":
                good = base62_crc(m[1], m[2])
            elif kind == "card":
                n = len(m[1]) if luhn(m[1]) else shorter(m[1], luhn, range(13, 20))
                span, good = (m.start(1), m.start(1) + n), n > 0
            else:
                n = len(m[1]) if mod97(m[1]) else shorter(m[1], mod97, iban_sizes(m[1]))
                span, good = (m.start(1), m.start(1) + n), n > 0
            if good or kind in BASE:
                free[kind] = span[1]
            if good:
                found.append((*span, kind))
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def find_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets in each text: key, spans (array of start, end, kind).

    Null and empty texts have none; null keys, repeated rows and empty tables are passed through; other
    columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[key, "spans"])

    return map_texts(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, spans array<struct<start: int, end: int, kind: string>>")


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests of ``find_secrets``: key, n_assign, n_access, n_hex, base_sha256, spans (as text)."""
    spans = find_secrets(docs, key=key, text=text)
    own = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [number(k).alias(f"n_{k}") for k in BASE]
    return spans.select(key, *counts, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: str, mark: str = "[secret]") -> str:
    out, at = [], 0
    for s, e, _ in scan(text):
        if e > at:
            out += [text[at:s], mark] if s >= at else []
            at = e
    return "".join((*out, text[at:])) if out else text


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``find_secrets`` replaced by ``mark``; overlapping spans are replaced once; null texts stay null.

    Rows are treated one by one: null keys and repeated rows like others, an empty table gives none, other columns stay whatever their names."""

    def run(name: str):
        def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i = batch.schema.names.index(name)
                new = pa.array([None if (t := x.as_py()) is None else redacted(t, mark) for x in batch.column(i)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:i], new, *batch.columns[i + 1 :]], names=batch.schema.names)

        return replaced

    return any_names(docs, lambda rows, t: map_texts(rows, run(t), rows.schema), text)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(listed([s for s in spans if s[2] in BASE]).encode()).hexdigest()
