"""SentencePiece BPE encoding by backtracking, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SPACE = "▁"
CACHED, CACHED_CHARS = 250_000, 48  # words whose ids a worker remembers, and their length


class Codec:
    """Encodes exactly as merges would, without merging.

    The longest piece is taken at each place, found for all places by one Aho-Corasick pass.  A
    piece may follow another only if merging their joined text gives back these two; if not, shorter prefixes
    are tried, and places from which nothing fits are marked in a bitfield and never tried again.
    A sequence whose neighbours are all compatible is the one that merging gives.
    """

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and the identity normalizer are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.piece = [p.piece for p in proto.pieces]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = [b"" if p.type == kinds.CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else proto.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.real = {p for p in self.id if self.merge(p) == [p]}  # pieces that merging can give
        self.automaton = ahocorasick.Automaton()
        for p in self.real:
            self.automaton.add_word(p, (len(p), self.id[p]))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known = re.compile("[" + "".join(re.escape(p) for p in self.real if len(p) == 1) + "]+|.", re.DOTALL)
        # No piece holds a space mark after another character: words are then encoded each by itself.
        words = all(SPACE not in p.lstrip(SPACE) or not p.strip(SPACE) for p in self.real)
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if words else ".+", re.DOTALL)
        self.words = words and self.prefix
        self.cache: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: the neighbours whose joined piece has the best score, the leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = max(((score.get(parts[i] + parts[i + 1], -float("inf")), -i) for i in range(len(parts) - 1)))
            if best[0] == -float("inf"):
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _shorter(self, token: int) -> int | None:
        piece = self.piece[token]
        found = next((self.id[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.real), None)
        self.shorter[token] = found
        return found

    def _fits(self, pair: tuple[int, int]) -> bool:
        a, b = self.piece[pair[0]], self.piece[pair[1]]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[pair] = found = self.merge(a + b) == [a, b]
        return found

    def _run(self, s: str) -> list[int]:
        longest: dict[int, int] = {}
        for end, (n, token) in self.automaton.iter(s):
            longest[end - n + 1] = token
        piece, shorter, fits, n = self.piece, self.shorter, self.fits, len(s)
        failed, tokens, at, token = bytearray(n + 1), [], 0, longest[0]
        while at < n:
            end = at + len(piece[token])
            last = tokens[-1] if tokens else None
            if not failed[end] and (last is None or ((last, token) in fits and fits[last, token]) or ((last, token) not in fits and self._fits((last, token)))):
                tokens.append(token)
                at = end
                token = longest.get(at)
                continue
            token = shorter[token] if token in shorter else self._shorter(token)
            if token is None:
                failed[at] = 1
                token = tokens.pop()
                at -= len(piece[token])
        return tokens

    def _unit(self, s: str) -> bytes:
        ids: list[int] = []
        for part in self.known.findall(s):
            if part[0] in self.real:
                ids += self._run(part)
            else:
                ids += [self.byte[b] for b in part.encode("utf-8", "surrogatepass")]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with begin and end."""
        cache, found = self.cache, []
        if text:
            if self.words and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
                units = text.split(" ")  # each has one mark before it
                mark = SPACE
            else:
                units, mark = self.units.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE)), ""
            found = [cache.get(u) for u in units] if mark else [None] * len(units)
            if None in found:
                for i, (u, got) in enumerate(zip(units, found)):
                    if got is None:
                        found[i] = ids = self._unit(mark + u)
                        if mark and len(u) <= CACHED_CHARS:
                            if len(cache) >= CACHED:
                                cache.clear()
                            cache[u] = ids
        return b"".join((array("I", [self.bos]).tobytes(), *found, array("I", [self.eos]).tobytes()))

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.text.__getitem__, array("I", ids)))
        first = next((i for i in array("I", ids[:64]) if i not in (self.bos, self.eos)), None)
        if self.prefix and text[:1] == b" " and first is not None and self.piece[first][:1] == SPACE:
            text = text[1:]
        return text.decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One a worker."""
    if (found := _codecs.get(hash(model))) is None:
        found = _codecs[hash(model)] = Codec(model)
    return found


def encode(docs: DataFrame, model_path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids``: the text's ids with begin and end, as little-endian unsigned 32-bit integers.

    The model file is read on the driver and sent along, half a megabyte.  A null or empty text has the begin and end ids only; texts may be of any
    length; a column of that name is replaced; rows that repeat and empty tables need no care.
    """
    model = Path(model_path).read_bytes()
    kept = [c for c in docs.columns if c not in (ids, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = codec(model).encode
        for batch in batches:
            found = pa.array([do(t.as_py() or "") for t in batch.column(len(kept))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*kept, text, ids])

    rows = docs.select(*kept, text)
    return map_texts(rows, run, f"{_ddl(rows)}, `{ids}` binary")


def decode(rows: DataFrame, model_path: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the column ``decoded``: the text of the ids.  Null or empty ids give an empty text; a column of that name is
    replaced."""
    model = Path(model_path).read_bytes()
    kept = [c for c in rows.columns if c not in (ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = codec(model).decode
        for batch in batches:
            found = pa.array([do(t.as_py() or b"") for t in batch.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*kept, ids, decoded])

    rows = rows.select(*kept, ids)
    return map_texts(rows, run, f"{_ddl(rows)}, `{decoded}` string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def digests(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids and round trip of each text as digests: key, n_tokens, ids_sha256, decoded_sha256."""
    encoded = encode(docs.select(key, text), model_path, text=text, ids="_ids").select(key, "_ids")
    both = decode(encoded, model_path, ids="_ids", decoded="_decoded")
    return both.select(key, F.expr("cast(octet_length(_ids) / 4 as long)").alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"), F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"))
