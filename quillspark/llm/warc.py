"""WARC archives: a Spark data source that writes and reads one gzip member a record, by the same sequential framing."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK, LONGEST_HEADER, BATCH_ROWS, BATCH_BYTES = 1 << 16, 1 << 20, 2000, 16 << 20
SUFFIX = ".warc.gz"

# fixed values: names and formats of the WARC 1.1 standard
VERSION, INFO, HTTP, END = b"WARC/1.1", "application/warc-fields", "application/http; msgtype=response", b"\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_length long, payload_digest string, payload binary, fields map<string,string>"
FOUND = SCHEMA + ", verified boolean, archive string, offset long, size long"
NAMED = {"warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-refers-to", "warc-payload-digest", "warc-block-digest", "warc-profile", "content-type", "content-length"}
ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_length", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())), ("verified", pa.bool_()), ("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64()),
])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the folder's path there; every store that pyarrow knows will do."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def digest(hexadecimal: str) -> str:
    """A SHA-1 as the standard labels it."""
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def plain(value: str) -> str:
    """A header value on one line: control characters and what would end the line are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value).strip()


# Writing


def record(fields: list[tuple[str, str | None]], block: list[bytes], level: int = 6) -> bytes:
    """One record as one gzip member; fields that are None are left out."""
    own = hashlib.sha1()
    for part in block:
        own.update(part)
    fields = [*fields, ("WARC-Block-Digest", digest(own.hexdigest())), ("Content-Length", str(sum(map(len, block))))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {plain(v)}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([*(deflate.compress(part) for part in (head, *block, END)), deflate.flush()])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    """A task writes archives under names of its own; only those of tasks that Spark commits get their final names."""

    def __init__(self, path: str, options: dict, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.most, self.level = int(options.get("maxarchivebytes", 1 << 30)), int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = opened(self.path)
        store.create_dir(f"{folder}/_writing", recursive=True)
        out, room, files = None, 0, []
        for batch in iterator:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if room <= 0:
                    if out:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}{SUFFIX}")
                    out, room = store.open_output_stream(f"{folder}/_writing/{files[-1]}", compression=None), self.most
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", at["date"][i].as_py()), ("WARC-Filename", files[-1]), ("Content-Type", INFO)]
                    out.write(record(info, [b"format: WARC File Format 1.1\r\n"], self.level))
                member = self._member({name: column[i].as_py() for name, column in at.items()})
                out.write(member)
                room -= len(member)
        if out:
            out.close()
        return Written(files)

    def _member(self, row: dict) -> bytes:
        revisit = row["record_type"] == "revisit"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
        fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", digest(row["payload_digest"])), ("Content-Type", HTTP)]
        fields += [("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", SAME_PAYLOAD)] if revisit else []
        return record([*fields, *(row["fields"] or [])], [http] if revisit else [http, row["payload"] or b""], self.level)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        if self.overwrite:
            for old in archives(self.path):
                store.delete_file(old)
        for name in (f for m in messages if m for f in m.files):
            store.move(f"{folder}/_writing/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What tasks that failed or ran twice have left goes."""
        store, folder = opened(self.path)
        if store.get_file_info(f"{folder}/_writing").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/_writing")


# Reading


class Member:
    """The bytes of one gzip member, inflated step by step, never more than asked for and one step."""

    def __init__(self, raw, ahead: bytes):
        self.raw, self.ahead, self.inflate, self.out, self.used = raw, ahead, zlib.decompressobj(31), bytearray(), 0

    def more(self) -> bool:
        """Inflates another step; False at the member's end."""
        if self.inflate.eof:
            return False
        given = self.inflate.unconsumed_tail or self.ahead or self.raw.read(CHUNK)
        if not given:
            raise ValueError("an archive ends within a record")
        if not self.inflate.unconsumed_tail:
            self.ahead, self.used = b"", self.used + len(given)
        self.out += self.inflate.decompress(given, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes:
        """All up to ``mark``, which is taken off as well."""
        begun = 0
        while (at := self.out.find(mark, begun)) < 0:
            begun = max(0, len(self.out) - len(mark) + 1)
            if len(self.out) > LONGEST_HEADER or not self.more():
                raise ValueError("a record's header has no end")
        found = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in parts."""
        while n:
            if not self.out and not self.more():
                raise ValueError("a record is shorter than its content length")
            part = bytes(self.out[:n])
            del self.out[:n]
            n -= len(part)
            if part:
                yield part

    def close(self) -> bytes:
        """What follows the member; there must be nothing left but the record's end."""
        while len(self.out) <= len(END) and self.more():
            pass
        if bytes(self.out) != END or not self.inflate.eof:
            raise ValueError("a record is longer than its content length")
        rest = self.inflate.unused_data
        self.used -= len(rest)
        return rest + self.ahead


def parsed(lines: bytes) -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and found:  # a folded line goes on with the last value
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif colon:
            found.append((name.strip(), value.strip()))
    return found


def bare(value: str | None) -> str | None:
    """A labelled SHA-1, in base 32 or hexadecimal, as bare lower-case hexadecimal digits; any other label as it stands."""
    label, _, text = (value or "").partition(":")
    if label.lower() != "sha1":
        return value
    return base64.b32decode(text.upper()).hex() if len(text) == 32 else text.lower()


def read_record(member: Member, payloads: bool) -> dict:
    """The record that a member holds.  Without ``payloads`` the block only passes through the digests."""
    first, _, rest = member.until(END).partition(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("a member doesn't start with a WARC record")
    listed = parsed(rest)
    named = {k.lower(): v for k, v in listed}
    left, whole, own = int(named["content-length"]), hashlib.sha1(), hashlib.sha1()
    length, http = None, named.get("content-type", "").startswith("application/http")
    if http and left:
        head = member.until(END) + END
        left -= len(head)
        if left < 0:
            raise ValueError("a record's HTTP header is longer than its content length")
        whole.update(head)
        length = {k.lower(): v for k, v in parsed(head)}.get("content-length")
    kept, size = [], left
    for part in member.take(left):
        whole.update(part)
        own.update(part)
        if payloads:
            kept.append(part)
    revisit, said = named.get("warc-type") == "revisit", bare(named.get("warc-payload-digest"))
    block = bare(named.get("warc-block-digest"))
    good = block in (None, whole.hexdigest()) and (revisit or said in (None, own.hexdigest()) and length in (None, str(size)))
    return {
        "record_id": named.get("warc-record-id"), "record_type": named.get("warc-type"), "target_uri": named.get("warc-target-uri"), "date": named.get("warc-date"), "refers_to": named.get("warc-refers-to"),
        "payload_length": int(length) if revisit and length else size, "payload_digest": said or own.hexdigest(), "payload": b"".join(kept) if payloads and not revisit else None,
        "fields": [(k, v) for k, v in listed if k.lower() not in NAMED], "verified": good,
    }


def read_archive(raw, payloads: bool = True) -> Iterator[dict]:
    """All records of one archive in order, with the place of each one's member."""
    rest, offset = b"", 0
    while rest or (rest := raw.read(CHUNK)):
        member = Member(raw, rest)
        found = read_record(member, payloads)
        rest = member.close()
        yield found | {"offset": offset, "size": member.used}
        offset += member.used


def archives(path: str) -> list[str]:
    """The archives of a folder, or the one archive that ``path`` names."""
    store, folder = opened(path)
    if store.get_file_info(folder).type == fs.FileType.File:
        return [folder]
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(SUFFIX))


@dataclass
class Archive(InputPartition):
    file: str


class Reader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.payloads = path, options.get("payloads", "true").lower() == "true"

    def partitions(self) -> list[Archive]:
        return [Archive(f) for f in archives(self.path)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        rows, held = [], 0
        with opened(self.path)[0].open_input_stream(partition.file, compression=None) as raw:
            for found in read_archive(raw, self.payloads):
                rows.append(found | {"archive": partition.file.rsplit("/", 1)[-1]})
                held += len(found["payload"] or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcSource(DataSource):
    """``format("warc")``.  Reading: option ``payloads`` (true).  Writing: ``maxArchiveBytes`` (1 GiB), ``level`` (6)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def _options(self) -> tuple[str, dict]:
        options = {k.lower(): v for k, v in self.options.items()}
        return options["path"], options

    def schema(self) -> str:
        return FOUND

    def reader(self, schema) -> Reader:
        return Reader(*self._options())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(*self._options(), overwrite)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder, one task an archive: record_id, record_type, target_uri, date, refers_to, payload_length,
    payload_digest, payload, fields (all other named fields), verified, archive, offset, size.

    A record that breaks the framing ends the job with its reason; one whose digests or lengths differ is a row with ``verified`` false.
    Without ``payloads`` that column is null, and a task holds no more than a step of a record however long it is.  A revisit has the length
    and digest of the full payload, and none itself.  A folder without archives gives no rows.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def page_records(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Pages as records to write.  Of equal payloads of ``least`` bytes or more that with the largest key is a response, the others revisit
    it; shorter ones are all responses.

    A null html is an empty payload, a null url no target; null keys are below all others and are written without one; rows that repeat the largest
    key and its payload are all responses.  Columns by other names are ignored.  An empty table gives no rows.

    One aggregation with map-side combine finds the payloads that repeat; then pages meet them by their SHA-256 in one shuffle, which
    adaptive execution splits where a payload is hot.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_length": F.octet_length("payload").cast("long"), "same": F.sha2("payload", 256)})
    rows = rows.withColumn("unique", F.md5(F.to_json(F.struct("key", "target_uri", "same"), {"ignoreNullFields": "false"})))
    groups = rows.where(F.col("payload_length") >= least).groupBy("same").agg(F.count("*").alias("n"), F.max(F.struct("key", "unique")).alias("top")).where("n > 1")
    joined = rows.join(groups.select("same", "top"), "same", "left")
    revisit = F.col("top").isNotNull() & ~F.col("key").eqNullSafe(F.col("top.key"))
    named = lambda c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.overlay(F.overlay(c, F.lit("8"), 13), F.lit("a"), 17), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    fields = F.map_filter(F.create_map(F.lit("X-Row-Key"), F.col("key").cast("string"), F.lit("X-Refers-To-Key"), F.when(revisit, F.col("top.key").cast("string"))), lambda _, v: v.isNotNull())
    return joined.select(
        named(F.col("unique")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"), F.when(revisit, named(F.col("top.unique"))).alias("refers_to"),
        "payload_length", F.sha1("payload").alias("payload_digest"), F.when(~revisit, F.col("payload")).alias("payload"), fields.alias("fields"),
    )


def write(records: DataFrame, path: str, *, most_bytes: int = 1 << 30, level: int = 6) -> None:
    """Writes records (the columns of SCHEMA) as archives into the folder ``path``, replacing those there; a task that is run twice leaves one copy."""
    records.sparkSession.dataSource.register(WarcSource)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    records.select(*columns).write.format("warc").mode("overwrite").option("maxArchiveBytes", most_bytes).option("level", level).save(path)


def page_report(records: DataFrame, *, key: str = "page_id") -> DataFrame:
    """What was read back of ``page_records``: key, payload_bytes, payload_digest, record_type, refers_to (the key of the response).  A record that isn't
    as its digests say is an error."""
    sound = F.when(F.col("verified"), F.col("payload_length")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.coalesce("record_id", F.lit("?")))).cast("long"))
    return records.where("record_type <> 'warcinfo'").select(
        F.col("fields")["X-Row-Key"].cast("long").alias(key), sound.alias("payload_bytes"), "payload_digest", "record_type", F.col("fields")["X-Refers-To-Key"].cast("long").alias("refers_to"),
    )


def revisited(records: DataFrame) -> DataFrame:
    """Revisits with what they refer to: record_id, refers_to, found (a response by that id, of the same digest, is there), payload."""
    have = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("theirs"), F.col("payload").alias("full")).dropDuplicates(["refers_to"])
    own = records.where("record_type = 'revisit'").select("record_id", "refers_to", "payload_digest")
    found = F.coalesce(F.col("theirs") == F.col("payload_digest"), F.lit(False))
    return own.join(have, "refers_to", "left").select("record_id", "refers_to", found.alias("found"), F.when(found, F.col("full")).alias("payload"))
