"""WARC archives: writing, reading, and a global capture index by external merge."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nichespark.runtime import HOT_SHARE, LEAST, new_path, settle

#: A row of the writer has records of so many compressed bytes or one record, and a file so many rows.
CHUNK, CHUNKS = 1 << 20, 64
#: Entries of a range of the merge, on average.
RANGE = 50_000
#: The first and last second that a WARC date can tell; times beyond are these.
FIRST, LAST = -62_135_596_800, 253_402_300_799
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "page_id long, url string, url_key string, fetched long, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"
KINDS = {"page_id": pa.int64(), "url": pa.string(), "url_key": pa.string(), "fetched": pa.int64(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64()}


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels turned round, then path and query, in lower case; scheme, user, `www.`, usual ports and fragment go."""
    if not url:
        return ""
    try:
        s = urlsplit(url.strip())
        host, port = (s.hostname or "").lower(), s.port
    except ValueError:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    turned = ",".join(reversed(host.split("."))) if host else ""
    tail = f":{port}" if port and (s.scheme, port) not in {("http", 80), ("https", 443)} else ""
    return f"{turned}{tail}){(s.path or '/').lower()}" + (f"?{s.query.lower()}" if s.query else "")


def record_id(page_id: int | None, url: str | None, fetched: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{fetched}')}>"


def make_record(page_id: int | None, url: str | None, fetched: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to given) has the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, url, fetched)}",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        f"WARC-Date: {(EPOCH + timedelta(seconds=fetched)).isoformat().removesuffix('+00:00')}Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def pack(record: bytes) -> bytes:
    """The gzip member of a record. Its last byte is the top of the record's length modulo 2**32."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def filler(seed: str) -> bytes:
    """A short warcinfo record, which ends a chunk whose last record is of 16 MB or more, so that the chunk ends in 0."""
    body = b"software: nichespark\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return pack(head.encode() + body + b"\r\n\r\n")


def chunks(members: Iterator[bytes]) -> Iterator[bytes]:
    """Members in rows of CHUNK bytes or so, without the 0 that each ends with."""
    held, size = [], 0
    for m in members:
        held.append(m)
        size += len(m)
        if size >= CHUNK:
            yield _closed(held)
            held, size = [], 0
    if held:
        yield _closed(held)


def _closed(held: list[bytes]) -> bytes:
    if held[-1][-1]:
        held.append(filler(hashlib.sha1(held[-1]).hexdigest()))
    return b"".join(held)[:-1]


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, header and body of each record of an archive of gzip members, one by one."""
    view, at = memoryview(data), 0
    while at < len(data):
        start, raw, need = at, b"", None
        while need is None or len(raw) < need:
            if at >= len(data):
                raise ValueError("the archive is cut off")
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                window = view[at : at + (1 << 16)]
                if not len(window):
                    raise ValueError("the archive is cut off")
                parts.append(z.decompress(window))
                at += len(window) - len(z.unused_data)
            raw += b"".join(parts)
            if need is None and (end := raw.find(b"\r\n\r\n")) >= 0:
                lines = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                head = dict(x.split(": ", 1) for x in lines[1:])
                need = end + 4 + int(head["Content-Length"]) + 4
        yield start, at - start, head, raw[end + 4 : need - 4]


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str = "fetched", least_bytes: int = 1000) -> str:
    """Write every page as a record of gzipped WARC files in the shared folder; the folder.

    Payload: the html as UTF-8 (null: empty). Of pages with equal payloads of least_bytes or more
    the one with the largest id is a response, the others revisit it (rows that repeat the
    largest id are responses too); smaller payloads, and those of groups without an id, are
    responses. Groups are found by SHA-1 and length, and only groups of two or more are joined back; the
    groups with more than a thousandth of the grouped rows (a thousand at most) by broadcast, so that a hot payload
    is no hot task. Each record is one gzip member, and a file has CHUNKS rows of CHUNK bytes (or one longer
    record each). Spark's text writer is the sink, with the last byte of a row, which is 0, as
    its line separator. Null times are 1970, times outside the years 1 to 9999 their ends; other columns are ignored.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.greatest(F.least(F.coalesce(F.unix_seconds(F.col(time_col).cast("timestamp")), F.lit(0)), F.lit(LAST)), F.lit(FIRST)).alias("fetched"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html")})
    key = F.concat_ws("-", "digest", "size")
    grouped = rows.where(F.col("size") >= least_bytes).groupBy(key.alias("group")).agg(F.max("page_id").alias("chosen"), F.count("*").alias("n"))
    repeated = settle(grouped.where("n > 1 and chosen is not null"))
    limit = max((repeated.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE, LEAST)
    hot = repeated.where(F.col("n") > limit).select(F.col("group").alias("hot_group"), F.col("chosen").alias("hot_chosen"))
    rows = rows.withColumn("group", key)
    if not hot.isEmpty():
        rows = rows.join(F.broadcast(hot), F.col("group") == F.col("hot_group"), "left")
        # rows of hot groups are done, and are spread over the tasks of the other join
        rows = rows.withColumn("group", F.when(F.col("hot_chosen").isNull(), F.col("group")).otherwise(F.concat(F.lit("done "), F.xxhash64("page_id", "url").cast("string"))))
    else:
        rows = rows.withColumn("hot_chosen", F.lit(None).cast("long"))
    joined = rows.join(repeated.where(F.col("n") <= limit).drop("n"), "group", "left").withColumn("chosen", F.coalesce("hot_chosen", "chosen"))
    revisit = F.when(F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen")), F.col("chosen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[bytes]:
            for whole in batches:
                for i in range(0, whole.num_rows, 256):
                    for p, u, t, h, d, r in zip(*[c.to_pylist() for c in whole.slice(i, 256).columns], strict=True):
                        yield pack(make_record(p, u, t, h.encode("utf-8", "surrogatepass"), d, r))

        for chunk in chunks(members()):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.binary())], names=["value"])

    folder = new_path(spark, "warc")
    written = joined.select("page_id", "url", "fetched", "html", "digest", revisit.alias("refers_to")).mapInArrow(run, "value binary")
    written.select(F.col("value").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", CHUNKS).text(folder)
    return folder


def _batch(entries: list[tuple], with_payload: bool) -> pa.RecordBatch:
    arrays = [pa.array([x[c] for x in entries], k) for c, k in enumerate(KINDS.values())]
    if with_payload:
        arrays.append(pa.array([x[-1] for x in entries], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=[*KINDS, "payload"] if with_payload else list(KINDS))


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Index entries of all records, in a run for each archive sorted by (url_key, fetched, page_id).

    With payloads too, if asked for: then in the archive's order, one by one.

    payload_bytes and payload_digest are those of the full payload: of responses from the payload
    itself, which is checked against the header's digest, of revisits from the headers.
    """
    kinds = ENTRY + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = []
                for offset, length, head, body in records(data.as_py()):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = body.partition(b"\r\n\r\n")
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if head["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"{name} is damaged at {offset}")
                    url, refers = head.get("WARC-Target-URI"), head.get("X-Refers-To-Page-Id")
                    page = head.get("X-Page-Id")
                    fetched = (datetime.fromisoformat(head["WARC-Date"]) - EPOCH) // timedelta(seconds=1)
                    entry = (None if page is None else int(page), url, url_key(url), fetched, head["WARC-Type"], size, digest, None if refers is None else int(refers), name, offset, length)
                    if with_payload:
                        yield _batch([(*entry, payload)], with_payload)
                    else:
                        found.append(entry)
                found.sort(key=_place)
                for i in range(0, len(found), 4096):
                    yield _batch(found[i : i + 4096], False)

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")
    return files.mapInArrow(run, kinds)


def _place(entry: tuple) -> tuple:
    """The order of captures: URL key, time, page (null first), then place in the archives."""
    return entry[2].encode("utf-8", "surrogatepass"), entry[3], entry[0] is not None, entry[0] or 0, entry[8], entry[9]


class LoserTree:
    """Merges k sorted runs: each inner node holds the loser of its match, the top the winner."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.key = [(_place(r[0]), i) if r else None for i, r in enumerate(runs)]
        self.losers = [-1] * self.k
        for i in range(len(runs)):
            self._play(i, filling=True)

    def _beats(self, a: int, b: int) -> bool:
        return self.key[a] is not None and (self.key[b] is None or self.key[a] < self.key[b])

    def _play(self, run: int, filling: bool = False) -> None:
        node, winner = (run + self.k) // 2, run
        while node:
            if filling and self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.key[w := self.losers[0]] is not None:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.key[w] = (_place(self.runs[w][self.at[w]]), w) if self.at[w] < len(self.runs[w]) else None
            self._play(w)


def natural_runs(entries: Iterator[tuple]) -> Iterator[list[tuple]]:
    """The entries in runs, cut where an entry comes before the one ahead of it."""
    run: list[tuple] = []
    last = None
    for entry in entries:
        place = _place(entry)
        if last is not None and place < last:
            yield run
            run = []
        run.append(entry)
        last = place
    if run:
        yield run


def capture_history(index: DataFrame) -> DataFrame:
    """The entries in global order of (url_key, fetched, page_id), with `place`, their number in it from 0.

    Runs are cut at the borders of key ranges (range partitions over the whole key, so that a URL
    of very many captures is cut too), of RANGE entries on average. The shuffle hands each range its pieces of all k
    runs one after the other, each in order; a range merges them with a loser tree, in log k
    comparisons an entry, and holds its own entries (no payloads) only. Nulls: a missing URL has the key ''.
    """
    index = settle(index.select(*KINDS))
    ranges = max(8, -(-index.count() // RANGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, held = TaskContext.get().partitionId(), 0, []

        def batch() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([*_batch(held, False).columns, pa.array([part] * n, pa.int32()), pa.array(range(place - n, place), pa.int64())], names=[*KINDS, "merge_part", "merge_place"])

        for entry in LoserTree(list(natural_runs(e for b in batches for e in zip(*[c.to_pylist() for c in b.columns], strict=True)))):
            held.append(entry)
            place += 1
            if len(held) == 4096:
                yield batch()
                held = []
        if held:
            yield batch()

    ranged = index.repartitionByRange(ranges, F.encode("url_key", "UTF-8"), "fetched", F.col("page_id").isNotNull(), "page_id", "file", "offset")
    merged = settle(ranged.mapInArrow(run, f"{ENTRY}, merge_part int, merge_place long"))
    # one row a range
    sizes = merged.groupBy("merge_part").agg(F.count("*").alias("n"))
    ahead = sizes.select("merge_part", (F.sum("n").over(Window.orderBy("merge_part")) - F.col("n")).alias("ahead"))
    return merged.join(ahead, "merge_part").withColumn("place", F.col("ahead") + F.col("merge_place")).drop("merge_part", "merge_place", "ahead")
