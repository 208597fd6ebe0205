"""WARC archives with a Zstandard dictionary.

Each task gathers records up to a size, builds a dictionary from them, and writes an archive: a skippable
frame (0x184D2A5D) with the dictionary, then one frame per record.  An archive is written under a name of its
own and only counts once its task has reported it in the manifest table, so tasks can be run again.

Records with equal payloads of at least ``least_bytes`` refer to the one with the smallest id.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import shared_dir, small_side, written

DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


# ---- records --------------------------------------------------------------------------------------------

def record(page_id: str | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or without its payload a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of an uncompressed stream."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if len(block) != int(headers["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('WARC-Record-ID')} is cut off")
        yield headers, block


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD; a response's payload is held against its digest."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    name = lambda key: headers[key].removeprefix("<urn:page:").removesuffix(">") or None if key in headers else None
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {headers['WARC-Record-ID']} does not hold its payload")
    url = headers.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return name("WARC-Record-ID"), url, length, digest, kind, name("WARC-Refers-To"), payload


# ---- archives -------------------------------------------------------------------------------------------

def dictionary(found: list[bytes], size: int, sample_bytes: int):
    """A Zstandard dictionary from records spread evenly over ``found``, at most ``sample_bytes`` of them; None
    where there is too little to learn from."""
    import zstandard

    total = sum(map(len, found))
    step = max(1, -(-total // sample_bytes))
    sample = found[::step]
    if len(sample) < 16 or sum(map(len, sample)) < 8 * size:
        return None
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8)
    except zstandard.ZstdError:
        return None


def write_archive(out, found: list[bytes], level: int, dictionary_bytes: int, sample_bytes: int) -> None:
    import zstandard

    learned = dictionary(found, dictionary_bytes, sample_bytes)
    if learned:
        inner = zstandard.ZstdCompressor(level=19).compress(learned.as_bytes())
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(inner)) + inner)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=learned, write_checksum=True)
    for one in found:
        out.write(compressor.compress(one))


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    import zstandard

    head, learned = source.read(8), None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        inner = source.read(struct.unpack("<I", head[4:])[0])
        learned = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(inner) if inner[:4] == b"\x28\xb5\x2f\xfd" else inner)
        head = b""

    class Rest(io.RawIOBase):
        def readable(self):
            return True

        def readinto(self, into):
            nonlocal head
            got, head = (head, b"") if head else (source.read(len(into)), b"")
            into[: len(got)] = got
            return len(got)

    plain = zstandard.ZstdDecompressor(dict_data=learned).stream_reader(Rest(), read_across_frames=True)
    yield from records(io.BufferedReader(plain, 1 << 20))


# ---- tables ---------------------------------------------------------------------------------------------

def revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("n"), F.sha2(payload, 256).alias("digest"))
    shared = written(rows.filter(F.col("n") >= least_bytes).groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1 and first is not null")
        .select(F.col("digest").alias("digest2"), "first"), "warc-shared")
    joined = rows.join(small_side(shared, shared.count()), F.col("digest") == F.col("digest2"), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select(
        F.col("id").cast("string").alias("id"), "url", F.when(again, F.lit("")).otherwise(F.col("payload")).alias("payload"),
        "n", "digest", F.when(again, F.col("first").cast("string")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least_bytes: int = 100, archive_bytes: int = 32 << 20, level: int = 3, dictionary_bytes: int = 32 << 10,
               sample_bytes: int = 2 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages`` to archives of about ``archive_bytes`` uncompressed bytes in ``folder``
    and returns the manifest (path, records).

    The payload is ``payload_col`` in UTF-8, null: empty.  Of rows with equal payloads of at least
    ``least_bytes`` those with the smallest id are responses (a repeated row repeats its response); rows with a
    null id are revisits if an id is known for their payload.  No rows give an empty manifest.  Other columns
    are ignored."""
    def wrote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        held: list[bytes] = []

        def close() -> pd.DataFrame:
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(path) as out:
                write_archive(out, held, level, dictionary_bytes, sample_bytes)
            n = len(held)
            held.clear()
            return pd.DataFrame({"path": [path], "records": [n]})

        size = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                refers_to = None if row.refers_to is None or row.refers_to != row.refers_to else row.refers_to
                page = None if row.id is None or row.id != row.id else row.id
                held.append(record(page, row.url, (row.payload or "").encode(), int(row.n), row.digest, refers_to, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    size = 0
        if held:
            yield close()

    return written(revisits(pages, id_col, url_col, payload_col, least_bytes).mapInPandas(wrote, "path string, records long"), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives as rows of RECORD, without the payloads if not wanted (they are read
    and checked all the same).  A revisit has an empty payload and the length and digest of the whole one."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                rows, size = [], 0
                with store.open_input_stream(path) as source:
                    for headers, block in read_archive(source):
                        row = parsed(headers, block)
                        rows.append(row if payloads else (*row[:-1], b""))
                        size += len(row[-1]) * payloads + 200
                        if size >= 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    n = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("path").repartition(n, "path").mapInPandas(read, RECORD)


def archived(pages: DataFrame, id_col: str = "page_id", **how) -> DataFrame:
    """Writes the archives to the shared folder and reads them back: rows of RECORD without payloads, with the ids
    in their own type."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    kind = pages.schema[id_col].dataType.simpleString()
    back = read_warc(write_warc(pages, folder, id_col, **how), folder, payloads=False).drop("payload")
    return back.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).withColumnRenamed("page_id", id_col)
