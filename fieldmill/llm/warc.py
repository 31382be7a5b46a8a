"""A content-addressed archive of web records in WARC files.

write_warc writes one record a page in gzip members of their own: a response with the payload, or,
where a page of a smaller key has the same payload, a revisit that refers to it. store keeps what
such files hold as two tables of an archive's folder:

``headers``   a row a record: the exact bytes of its WARC header and of its HTTP header, where it
              stands in which file, and the SHA-256 of its payload;
``payloads``  each payload once, under its SHA-256, which is computed from the bytes and must be
              the one that the record declares.

restore joins the two by digest into the original records, byte by byte, and their full payloads.

Files are written by pyarrow's file systems, under names of their own task attempt; the manifest,
a table that Spark commits, names those that count, so an attempt that was lost leaves no record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, mapped, pieces, scratch, sifted
from .token_store import filesystem, qualified

#: Payloads of fewer bytes are always stored with their own record.
LEAST = 100
#: A file ends after the record that brings it to so many bytes.
ROLL = 128 << 20
#: A digest of more than one in so many of the rows that share a digest counts as hot: there are fewer of these than so.
HOT = 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
_PLACE = "file string, offset long, length long, place int"
_HEADERS = f"{_PLACE}, record_id string, record_type string, target_uri string, refers_to string, digest string, warc_header binary, http_header binary"


# records


def record_id(key: str | None) -> str:
    return f"<urn:page:{quote(key or '', safe='')}>"


def key_of(record: Column) -> Column:
    """The key in a record's id; null for an id without one, or of another kind."""
    return F.url_decode(F.nullif(F.regexp_extract(record, r"^<urn:page:(.*)>$", 1), F.lit("")))


def record_bytes(key: str | None, url: str | None, payload: bytes, digest: str, first: str | None, date: str = DATE) -> bytes:
    """A record with its payload, or, where first names another page, one that revisits it. White
    space and control characters of a url are escaped, as a header is one line."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(quote(c) if c <= " " or "\x7f" <= c <= "\xa0" else c for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if first is not None:
        fields += [("WARC-Refers-To", record_id(first)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + END


def parsed(data: bytes) -> Iterator[tuple[bytes, dict[str, str], bytes, bytes]]:
    """WARC header, its fields by lower-case name, HTTP header and payload of the records in data."""
    at = 0
    while at < len(data):
        stop = data.find(END, at)
        if stop < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError("no WARC record where one should begin")
        head = data[at : stop + 4]
        lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}
        body = stop + 4
        at = body + int(fields["content-length"])
        if data[at : at + 4] != END:
            raise ValueError("a WARC record has another length than its header says")
        http = data.find(END, body, at) + 4 if fields.get("content-type", "").lower().startswith("application/http") else body
        http = body if http < body else http
        yield head, fields, data[body:http], data[http:at]
        at += 4


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the gzip members of a stream, one in memory at a time. A stream
    that isn't compressed is one member."""
    chunk, at = stream.read(size), 0
    if chunk and chunk[:2] != b"\x1f\x8b":
        rest = stream.read()
        yield 0, len(chunk) + len(rest), chunk + rest
        return
    while chunk:
        unzip, out, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not chunk:
                raise ValueError("a WARC file ends inside a record")
            out.append(unzip.decompress(chunk))
            used += len(chunk) - len(unzip.unused_data)
            chunk = unzip.unused_data or (b"" if unzip.eof else stream.read(size))
        yield at, used, b"".join(out)
        at += used
        chunk = chunk or stream.read(size)


def verified(fields: dict[str, str], payload: bytes) -> str | None:
    """The SHA-256 of a record's payload, which must be the declared one; of a revisit, which has no
    payload, the declared one (null where another kind of digest is declared)."""
    kind, _, told = fields.get("warc-payload-digest", "").partition(":")
    told = told.strip().lower() if kind.strip().lower() in ("sha256", "sha-256") else None
    if fields.get("warc-type") == "revisit":
        return told
    found = hashlib.sha256(payload).hexdigest()
    if told not in (None, found):
        raise ValueError(f"the payload of {fields.get('warc-record-id')} has not the digest that its record declares")
    return found


# writing


def _hot(groups: DataFrame) -> DataFrame:
    """digest, n and slots (into how many parts its rows are dealt) of the hot ones of groups (digest,
    n): less than HOT rows, as each has more than one in HOT of all, and at most HOT slots each."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return groups.filter(F.col("n") * HOT > total).withColumn("slots", F.ceil(F.col("n") * HOT / F.lit(max(total, 1))).cast("int"))


def elected(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """rows (key, url, payload, digest, n_bytes) with first: the smallest key that has the payload, for
    rows that don't have it themselves and whose payload is of least bytes or more; else null.

    Groups are counted from digests and keys alone. Only rows whose digest may be in several rows are
    shuffled with their payload, and of these not the hot ones, which meet a broadcast of bounded size.
    """
    groups, _ = kept(rows.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("key").alias("least")).filter("n > 1 AND least IS NOT NULL"), "digests")
    hot = _hot(groups).select("digest", F.col("least").alias("hot"))
    cold = groups.join(F.broadcast(hot), "digest", "left_anti").select("digest", "least")
    named = rows.join(F.broadcast(hot), "digest", "left")
    out = named.withColumn("least", F.col("hot"))
    if not cold.isEmpty():
        many = cold.select("digest")
        alone = sifted(named, "digest", many, outside=True).withColumn("least", F.col("hot"))
        out = alone.unionByName(sifted(named, "digest", many).join(cold, "digest", "left").withColumn("least", F.coalesce("hot", "least")).select(*alone.columns))
    return out.withColumn("first", F.when(~F.col("least").eqNullSafe(F.col("key")), F.col("least"))).select(*rows.columns, "first")


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, roll: int = ROLL) -> None:
    """Write a record of every row of pages in gzipped WARC files under folder, and their manifest.

    A null payload counts as empty. Of the rows with equal payloads of at least ``least`` bytes, the one
    of the smallest key is a response (each such row, where the key is repeated), the others, those
    with a null key among them, are revisits; where all keys are null, all are responses. An empty
    table gives a manifest without files. Other columns are left out, whatever their names.
    """
    folder = qualified(pages.sparkSession, folder)
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload"))
    rows = elected(rows, least).select(F.col("key").cast("string"), "url", "payload", "digest", F.col("first").cast("string"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(f"{root}/warc", recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        out, size, many, number = None, 0, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{number:03d}.warc.gz"]), pa.array([many]), pa.array([size])], names=["file", "n_records", "n_bytes"])

        for batch in batches:
            for part in pieces(batch, 2):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    out = out or fs.open_output_stream(f"{root}/warc/{name}-{number:03d}.warc.gz", compression=None)
                    zipper = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = zipper.compress(record_bytes(*row)) + zipper.flush()
                    out.write(member)
                    size, many = size + len(member), many + 1
                    if size >= roll:
                        yield done()
                        out, size, many, number = None, 0, 0, number + 1
        if out:
            yield done()

    rows.transform(mapped, write, "file string, n_records long, n_bytes long").write.parquet(f"{folder}/manifest")


# the archive


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """A row a record of the WARC files that folder's manifest (column file) names, each file read as a
    stream: place, id, type, exact headers, and the digest of the payload, verified."""
    folder = qualified(spark, folder)
    files = spark.read.parquet(f"{folder}/manifest").select("file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        schema = ["file", "offset", "length", "place", "record_id", "record_type", "target_uri", "refers_to", "digest", "warc_header", "http_header"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.binary(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=schema)

        rows = []
        for names in batches:
            for file in names.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/warc/{file}", compression=None) as stream:
                    for offset, length, data in members(stream):
                        for place, (head, fields, http, payload) in enumerate(parsed(data)):
                            rows.append((file, offset, length, place, *map(fields.get, ("warc-record-id", "warc-type", "warc-target-uri", "warc-refers-to")), verified(fields, payload), head, http))
                        if len(rows) >= 2000:
                            yield batch(rows)
                            rows = []
        if rows:
            yield batch(rows)

    return files.repartition(max(1, files.count())).transform(mapped, read, _HEADERS)


def read_payloads(places: DataFrame, folder: str) -> DataFrame:
    """digest and payload of the records at places (digest and where each stands), read one by one in
    the order of each file; a payload of another digest is an error."""
    folder = qualified(places.sparkSession, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, root), now, opened = filesystem(folder), None, None
        for batch in batches:
            digests, payloads, size = [], [], 0
            for digest, file, offset, length, place in zip(*(c.to_pylist() for c in batch.columns)):
                if file != now:
                    now, opened = file, fs.open_input_file(f"{root}/warc/{file}")
                data = opened.read_at(length, offset)
                data = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
                payload = next(p for i, (_, _, _, p) in enumerate(parsed(data)) if i == place)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{file} at {offset} holds another payload than {digest}")
                digests.append(digest)
                payloads.append(payload)
                size += len(payload)
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(payloads, type=pa.binary())], names=["digest", "payload"])
                    digests, payloads, size = [], [], 0
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(payloads, type=pa.binary())], names=["digest", "payload"])

    files = max(1, places.sparkSession.read.parquet(f"{folder}/manifest").count())
    rows = places.select("digest", "file", "offset", "length", "place").repartition(files, "file").sortWithinPartitions("file", "offset", "place")
    return rows.transform(mapped, read, "digest string, payload binary")


def store(spark: SparkSession, folder: str) -> None:
    """Make the archive's tables from the WARC files under folder. Payloads of records that share a
    digest are read from the first of them alone, and none is shuffled."""
    read_headers(spark, folder).write.parquet(f"{folder}/headers")
    headers = spark.read.parquet(f"{folder}/headers")
    place = F.struct("file", "offset", "place", "length")
    first = headers.filter("record_type <> 'revisit'").groupBy("digest").agg(F.min(place).alias("at")).select("digest", "at.*")
    read_payloads(first, folder).write.option("compression", "zstd").parquet(f"{folder}/payloads")


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of an archive: its headers, payload (null for a revisit whose payload isn't there),
    payload_bytes and payload_digest, computed from the stored bytes, and record, the original bytes.

    Headers meet payloads by digest. Of a hot digest the headers are dealt to several slots, and its
    payload goes to each of these; there are less than 2 * HOT of such copies in all.
    """
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    groups = headers.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1 AND digest IS NOT NULL")
    hot, _ = kept(_hot(groups).select("digest", "slots"), "slots")
    dealt = headers.join(F.broadcast(hot), "digest", "left").withColumn("slot", F.coalesce(F.pmod(F.xxhash64("file", "offset", "place"), F.col("slots")), F.lit(0).cast("long")).cast("int")).drop("slots")
    told = payloads.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    copies = told.join(F.broadcast(hot), "digest", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
    own = F.when(F.col("record_type") != "revisit", F.col("payload")).otherwise(F.lit(b""))
    return dealt.join(copies, ["digest", "slot"], "left").drop("slot").withColumn("record", F.concat("warc_header", "http_header", own, F.lit(END)))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record of every page, store and read the archive back."""
    folder = scratch(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    store(spark, folder)
    number = lambda c: key_of(F.col(c)).try_cast("long")
    return restore(spark, folder).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
