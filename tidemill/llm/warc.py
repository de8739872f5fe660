"""Operator 1: WARC archives with a two-level capture index.

Archives hold one gzip member per record. Captures are sorted by reversed-host key into index
shards; a shard is a run of compressed blocks of lines and ends in its block directory (the
first key and place of each block). Above the shards stands the list of their first keys. A
lookup searches that list, then the shard's directory, reads one block by its range, finds the
line, and reads the record by its range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, pick, shared_dir, stored, table

URN = "urn:tidemill:page:"
BLOCK_LINES = 1024
#: Records read by a task on average; bytes of an archive read by one task.
READS, SPAN = 8192, 32 << 20
DATE = "1970-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Reversed-host key: com,example)/path?query; what has no host keeps its spelling; null gives "-"."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe="/:?&=%,.;@+$!*'()~#-_[]")
    if not host:
        return quote(url, safe="/:?&=%,.;@+$!*'()~#-_[]")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(key, safe="/:?&=%,.;@+$!*'()~#-_[]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(lines.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit of refers_to, whose HTTP head keeps the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="/:?&=%,.;@+$!*'()~#-_[]")),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    return _member(head, http if refers_to is not None else http + payload)


def parse(member: bytes) -> dict:
    """Fields of a record read back; a response's digest and length come from its payload."""
    raw = zlib.decompress(member, 31)
    end = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    split = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:split].decode().split("\r\n")[1:])
    payload = block[split + 4 :]
    own = head["WARC-Record-ID"][1 + len(URN) : -1]
    out = {"page_id": int(own) if own else None, "record_type": head["WARC-Type"], "url": head["WARC-Target-URI"]}
    if head["WARC-Type"] == "revisit":
        return out | {"payload_bytes": int(http["Content-Length"]), "payload_digest": head["WARC-Payload-Digest"][5:], "refers_to": int(head["WARC-Refers-To"][1 + len(URN) : -1]), "payload": None}
    if f"sha1:{base32_sha1(payload)}" != head["WARC-Payload-Digest"]:
        raise ValueError("payload differs from its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": base32_sha1(payload), "refers_to": None, "payload": payload}


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of the shared folder, by its address, and the folder."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes one archive per task; returns (key, page_id, archive, offset, length) of each record.

    Of rows with equal payloads of at least least_bytes bytes, those with the largest page_id
    are responses and the others revisits. Null html is empty; a null page_id is smaller than
    any other, and equal payloads without any page_id are all responses; repeated rows are
    records of their own. Names hold a fresh id, so a repeated task never touches a file that
    rows already point to.
    """
    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    copies = stored(groups.where("n > 1 and last is not null"))
    # payloads with very many copies are few: total / most of them, with most a thousandth of all
    total = copies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = copies.where(F.col("n") > max(10_000, total // 1000)).drop("n")
    rest = copies.where(F.col("n") <= max(10_000, total // 1000)).drop("n")
    joined = rows.join(rest, "sha", "left")
    if not hot.isEmpty():
        joined = rows.join(F.broadcast(hot), "sha").unionByName(rows.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(rest, "sha", "left"))
    revisit = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = joined.select("page_id", "url", "html", revisit.alias("refers_to"))

    def make():
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)
        state = {"at": 0, "out": None}

        def write(raw: bytes) -> tuple[int, int]:
            state["out"].write(raw)
            at, state["at"] = state["at"], state["at"] + len(raw)
            return at, len(raw)

        def run(batch):
            out = {k: [] for k in ("key", "page_id", "archive", "offset", "length")}
            if batch is None:
                if state["out"]:
                    state["out"].close()
                return None
            if state["out"] is None:
                state["out"] = fs.open_output_stream(f"{path}/{name}", compression=None)
                write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"software: tidemill\r\nformat: WARC File Format 1.1\r\n"))
            for page, url, html, refers in zip(*[c.to_pylist() for c in batch.columns]):
                at, length = write(record(page, url, html.encode(), refers))
                for k, v in zip(out, (surt(url), page, name, at, length)):
                    out[k].append(v)
            return out

        return run

    return _with_end(rows, "key string, page_id long, archive string, offset long, length long", make)


def _with_end(df: DataFrame, schema: str, make) -> DataFrame:
    """per_batch whose function is called once more, with None, at the end of the task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct, prefers_large_types=False)

    def run(batches):
        f = make()
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(arrow.names, arrow.types)], schema=arrow)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                yield pack(f(batch.slice(i, 512)))
        if (out := f(None)) is not None:
            yield pack(out)

    return df.mapInArrow(run, struct)


def write_index(captures: DataFrame, folder: str, shards: int) -> list[tuple[str, int, str]]:
    """Writes index shards; returns their first keys: [(key, page_id or -1, file)], sorted.

    The list has an entry for each shard, of which there are at most `shards`.
    """
    order = ["key", F.coalesce("page_id", F.lit(-1)), "archive", "offset"]
    ranged = captures.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def make():
        fs, path = _store(folder)
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdxj"
        state = {"lines": [], "blocks": [], "out": None, "at": 0, "first": None}

        def flush():
            if state["lines"]:
                if state["out"] is None:
                    fs.create_dir(path, recursive=True)
                    state["out"] = fs.open_output_stream(f"{path}/{name}", compression=None)
                raw = zlib.compress("\n".join(line for _, _, line in state["lines"]).encode(), 6)
                state["out"].write(raw)
                state["blocks"].append([*state["lines"][0][:2], state["at"], len(raw)])
                state["at"] += len(raw)
                state["lines"] = []

        def run(batch):
            if batch is not None:
                for key, page, archive, at, length in zip(*[c.to_pylist() for c in batch.columns]):
                    page = -1 if page is None else page
                    state["lines"].append((key, page, f"{key} {page} " + json.dumps({"filename": archive, "offset": at, "length": length})))
                    if len(state["lines"]) >= BLOCK_LINES:
                        flush()
                return {"key": [], "page": [], "file": []}
            flush()
            if state["out"] is None:
                return None
            directory = zlib.compress(json.dumps(state["blocks"]).encode())
            state["out"].write(directory + len(directory).to_bytes(8, "little"))
            state["out"].close()
            return {"key": [state["blocks"][0][0]], "page": [state["blocks"][0][1]], "file": [name]}

        return run

    made = _with_end(ranged.select("key", "page_id", "archive", "offset", "length"), "key string, page long, file string", make)
    return sorted((r["key"], r["page"], r["file"]) for r in stored(made).collect())


class Shard:
    """An index shard: its directory, and the block read last."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.blocks = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))
        self.firsts = [(k, p) for k, p, _, _ in self.blocks]
        self.last, self.lines = None, []

    def _block(self, i: int) -> list[tuple[str, int, dict]]:
        if i != self.last:
            _, _, at, length = self.blocks[i]
            rows = [line.split(" ", 2) for line in zlib.decompress(self.file.read_at(length, at)).decode().split("\n")]
            self.lines, self.last = [(k, int(p), raw) for k, p, raw in rows], i
        return self.lines

    def find(self, key: str, page: int) -> list[dict]:
        """Captures of the key and page, over as many blocks as they fill."""
        i = max(0, bisect_right(self.firsts, (key, page)) - 1)
        while i > 0 and self.firsts[i] == (key, page):
            i -= 1
        out = []
        while i < len(self.blocks) and (i == 0 or self.firsts[i] <= (key, page)):
            lines = self._block(i)
            j = bisect_right(lines, (key, page))
            while j < len(lines) and lines[j][:2] == (key, page):
                out.append(json.loads(lines[j][2]))
                j += 1
            i += 1
        return out


def lookup(wanted: DataFrame, index: list[tuple[str, int, str]], folder: str) -> DataFrame:
    """(archive, offset, length) of wanted distinct (key, page), by the two-level index."""
    firsts = [(k, p) for k, p, _ in index]

    def route():
        def run(batch):
            keys, pages = batch[0].to_pylist(), batch[1].to_pylist()
            spans = [range(_before(firsts, (k, p)), max(1, bisect_right(firsts, (k, p)))) for k, p in zip(keys, pages)]
            return {"key": [k for k, s in zip(keys, spans) for _ in s], "page": [p for p, s in zip(pages, spans) for _ in s], "shard": [i for s in spans for i in s]}

        return run

    def make():
        fs, path = _store(folder)
        state = {"shard": None, "open": None}

        def run(batch):
            out = {"archive": [], "offset": [], "length": []}
            for key, page, shard in zip(*[c.to_pylist() for c in batch.columns]):
                if shard != state["shard"]:
                    state.update(shard=shard, open=Shard(fs, f"{path}/{index[shard][2]}"))
                for hit in state["open"].find(key, page):
                    for k, v in zip(out, (hit["filename"], hit["offset"], hit["length"])):
                        out[k].append(v)
            return out

        return run

    routed = per_batch(wanted, "key string, page long, shard int", route)
    return per_batch(routed.repartition(len(index), "shard").sortWithinPartitions("shard", "key", "page"), "archive string, offset long, length long", make)


def _before(firsts: list, want: tuple) -> int:
    """The first shard that may hold `want`: rows with equal keys may span shards."""
    i = max(0, bisect_right(firsts, want) - 1)
    while i > 0 and firsts[i] == want:
        i -= 1
    return i


FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(places: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records at (archive, offset, length), each read by its range; with their payloads if asked for."""

    def make():
        fs, path = _store(folder)
        state = {"name": None, "file": None}

        def run(batch):
            rows = []
            for name, at, length in zip(*[c.to_pylist() for c in batch.columns]):
                if name != state["name"]:
                    state.update(name=name, file=fs.open_input_file(f"{path}/{name}"))
                rows.append(parse(state["file"].read_at(length, at)))
            return {k: [r[k] for r in rows] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}

        return run

    return per_batch(places.select("archive", "offset", "length"), FIELDS + (", payload binary" if payloads else ""), make)


def round_trip(pages: DataFrame, least_bytes: int = 0, shards: int | None = None) -> DataFrame:
    """Writes pages to archives and their index, then finds and reads every capture by it.

    An empty table gives no rows. See write_archives() for nulls, ties and repeated rows.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)
    captures = stored(write_archives(pages, folder, least_bytes))
    shards = shards or max(1, -(-captures.count() // 100_000))
    index = write_index(captures, folder, shards)
    if not index:
        return spark.createDataFrame([], FIELDS)
    wanted = captures.select("key", F.coalesce("page_id", F.lit(-1)).alias("page")).distinct()
    places = lookup(wanted, index, folder)
    # a fixed number of tasks: the pointers are small, but what they read is not
    tasks = max(1, -(-captures.count() // READS))
    return read_records(places.repartition(tasks, "archive", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("archive", "offset"), folder)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """round_trip() of the whole table pages."""
    return round_trip(table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""
