"""WARC: writing captures as archives, reading them back, and assembling transactions.

A capture is a response (or revisit), a request and a metadata record; the latter two name the former in
WARC-Concurrent-To. Assembly joins them through those identifiers, however long the chain, into one nested row per capture.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, components, durable, table

CRLF = "\r\n"
#: Payloads of at least so many bytes may be stored once and revisited.
LEAST_REVISIT = 100
#: Captures of one archive file, which bounds what a reader holds.
CAPTURES_A_FILE = 2_000
DATE = "2024-01-01T00:00:00Z"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record without its closing blank lines, as a string column that holds the exact bytes."""
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    fields = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.lit("WARC/1.1" + CRLF)] + [F.when(lit(v).isNotNull(), F.concat(F.lit(f"{k}: "), lit(v), F.lit(CRLF))).otherwise(F.lit("")) for k, v in fields]
    return F.concat(*lines, F.lit(CRLF), block)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, payload (string of UTF-8 bytes), digest, revisit_of: the response's id, null for responses; and alone:
    for the rows of a digest that revisits name, whether just one row has that response's id.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, the smallest id is the response. Rows that
    repeat that id and payload are responses, too. Null payloads are empty, null urls stay null; a null id
    is never a response that others revisit.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    each = base.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest", "id").agg(F.count(F.lit(1)).alias("times"))
    first = each.groupBy("digest").agg(F.min("id").alias("first"), F.min_by("times", "id").alias("times"), F.sum("times").alias("k")).where("k > 1 and first is not null").drop("k")
    met = base.join(first, "digest", "left")
    return met.select("id", "url", "payload", "digest", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("revisit_of"), F.coalesce(F.col("times") == 1, F.lit(False)).alias("alone"))


def write_warc(caps: DataFrame, path: str, captures_a_file: int = CAPTURES_A_FILE) -> None:
    """Writes three records a capture as gzipped WARC/1.1 files under `path` with Spark's own writer.

    A record's line separator is the two blank lines that close a record, so the files hold exactly the
    records' bytes, and any store that Spark can write to will do. (Spark names the files part-*.txt.gz, and a file is one gzip
    member.) Record ids are unique; a response that revisits name has one that follows from its id and digest, and
    they name it in WARC-Refers-To. Where several rows repeat that response, revisits leave it to the payload's
    digest, as the profile allows.
    """
    c = caps.withColumn("seq", F.monotonically_increasing_id().cast("string")).withColumn("is_revisit", F.col("revisit_of").isNotNull())
    ident = F.coalesce(F.col("id").cast("string"), F.lit(""))
    named = F.col("alone") & ~F.col("is_revisit")
    c = c.withColumn("rid", _uuid(F.lit("response"), ident, F.col("digest"), F.when(named, F.lit("")).otherwise(F.col("seq"))))
    told = F.when(F.col("is_revisit") & F.col("alone"), _uuid(F.lit("response"), F.col("revisit_of").cast("string"), F.col("digest"), F.lit("")))
    uri = ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(F.col("is_revisit"), http).otherwise(F.concat(http, F.col("payload")))
    main = _record(
        F.when(F.col("is_revisit"), "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", F.col("rid")), uri, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(F.col("is_revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", told), ("WARC-Refers-To-Date", F.when(F.col("is_revisit"), DATE)), ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )
    path_of = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*([^#\r\n]*)", 1)
    request = _record("request", [("WARC-Record-ID", _uuid(F.lit("request"), F.col("rid"))), uri, ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), F.when(path_of.startswith("/"), path_of).otherwise(F.concat(F.lit("/"), path_of)), F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    notes = F.concat(F.lit("page-id: "), ident, F.lit(CRLF))
    metadata = _record("metadata", [("WARC-Record-ID", _uuid(F.lit("metadata"), F.col("rid"))), uri, ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", "application/warc-fields")], notes)
    records = c.select(F.concat(request, F.lit(CRLF * 2), main, F.lit(CRLF * 2), metadata).alias("value"))
    records.write.mode("errorifexists").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", captures_a_file).text(path)


_RECORDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("block_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
_RECORDS_DDL = "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, payload_digest string, block_bytes long, payload binary, fields map<string,string>"
#: Compressed bytes that are inflated at once.
_STEP = 1 << 18


class _Inflated:
    """An archive's bytes (gzip members one after another, or plain) as a buffer that is filled as it is read."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.zipped, self.member = memoryview(data), 0, bytearray(), data[:2] == b"\x1f\x8b", None

    def more(self) -> bool:
        """Whether further bytes could be had."""
        if self.at >= len(self.data):
            if self.member is not None:
                raise ValueError("gzip member is cut short")
            return False
        piece = self.data[self.at : self.at + _STEP]
        self.at += len(piece)
        if not self.zipped:
            self.held += piece
            return True
        while len(piece):
            self.member = self.member or zlib.decompressobj(31)
            self.held += self.member.decompress(piece)
            piece = self.member.unused_data
            if self.member.eof:
                self.member = None
                if len(piece) and not piece.strip(b"\0"):  # padding
                    break
        return True

    def until(self, mark: bytes) -> int:
        """Place of `mark` in the buffer, -1 if it doesn't come."""
        seen = 0
        while (k := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self.more():
                return -1
        return k

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(data: bytes):
    """The records of an archive (gzip members or plain), one at a time: (headers, block).

    Headers are a dict of lists by lower-case name, as WARC-Concurrent-To may repeat. Only the record at hand is inflated.
    Raises ValueError where a record is cut short or doesn't begin with a WARC version line.
    """
    stream, done = _Inflated(data), 0
    while True:
        head = stream.take(2)
        if not head:
            return
        if head == b"\r\n":
            done += 2
            continue
        stream.held[:0] = head
        end = stream.until(b"\r\n\r\n")
        if end < 0 or not stream.held.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {done}")
        lines = stream.take(end + 4).decode("utf-8", "replace").split("\r\n")
        fields: dict[str, list[str]] = {}
        last = None
        for line in lines[1:]:
            if line[:1] in (" ", "\t") and last:  # a folded header goes on
                fields[last][-1] += " " + line.strip()
                continue
            k, _, v = line.partition(":")
            last = k.strip().lower()
            fields.setdefault(last, []).append(v.strip())
        try:
            n = int(fields["content-length"][0])
        except (KeyError, ValueError):
            raise ValueError(f"no length of the record at byte {done}") from None
        block = stream.take(n)
        if len(block) != n:
            raise ValueError("record is cut short")
        yield fields, block
        done += end + 4 + n


def _read(it):
    def flush(rows):
        return pa.RecordBatch.from_pydict(rows, schema=_RECORDS)

    for b in it:
        for content in b.column(0).to_pylist():
            rows, held = {n: [] for n in _RECORDS.names}, 0
            for head, block in parse(content):
                first = {k: v[0] for k, v in head.items()}
                kind = first.get("warc-type", "")
                http = kind in ("response", "request") and first.get("content-type", "").startswith("application/http")
                body = block.partition(b"\r\n\r\n")[2] if http else b"" if kind == "revisit" else block
                fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x) if kind == "metadata" else {}
                one = (first.get("warc-record-id"), kind, head.get("warc-concurrent-to", []), first.get("warc-refers-to"), first.get("warc-target-uri"), first.get("warc-payload-digest"), len(block), body, list(fields.items()))
                for n, v in zip(_RECORDS.names, one, strict=True):
                    rows[n].append(v)
                held += len(body)
                if len(rows["record_id"]) >= 500 or held >= 1 << 24:
                    yield flush(rows)
                    rows, held = {n: [] for n in _RECORDS.names}, 0
            if rows["record_id"]:
                yield flush(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives at or under `path`, gzipped or plain and of any name (but for those that Spark
    takes for hidden, which begin with _ or .): identifiers, payload, metadata fields.

    A revisit's payload is empty; a response's is the entity body. Damaged archives raise. Spark's binary source
    limits a file to 2 GB, the usual size of an archive being 1 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return files.select("content").mapInArrow(_read, _RECORDS_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, requests, metadata, others.

    records: record_id, record_type, concurrent_to (a list, may be null) and any other columns, which are carried.
    A capture is what WARC-Concurrent-To links connect, in either direction and however long the chain. Its response is
    the response or revisit record of least id; further ones, and records of other types, are `others`.
    Records whose references lead to no response make a capture with a null response, so nothing is lost; a
    response that nothing refers to has empty lists. Repeated records of one id share a capture; all are
    listed, but the response once. Records without an id make one capture. Empty table: empty result.

    Most records name a response that names nothing itself: those need no more than a grouping by the name. Only
    longer chains, and records that name several others, go through connected components.
    """
    carried = [c for c in records.columns if c != "concurrent_to"]
    main = F.col("record_type").isin("response", "revisit")
    names = F.filter(F.array_distinct(F.coalesce("concurrent_to", F.array().cast("array<string>"))), lambda x: x != F.col("record_id"))
    records = records.withColumn("__to", names)
    thin = records.select("record_id", main.alias("main"), "__to")
    ends = thin.where(F.col("main") & (F.size("__to") == 0)).select(F.col("record_id").alias("end")).distinct()
    links = thin.select(F.col("record_id").alias("a"), "main", F.size("__to").alias("n"), F.explode("__to").alias("b"))
    plain = ~F.col("main") & (F.col("n") == 1)
    odd = links.where(~plain).select("a", "b").unionByName(links.where(plain).join(ends, F.col("b") == F.col("end"), "left_anti").select("a", "b"))
    odd = durable(odd.distinct())
    if odd.isEmpty():
        labelled = records.withColumn("__label", F.coalesce(F.get("__to", F.lit(0)), F.col("record_id")))
    else:
        nodes = odd.select(F.col("a").alias("a")).union(odd.select("b")).distinct()
        labels = components(odd.unionByName(links.where(plain).select("a", "b").join(nodes, "a", "left_semi")))
        of = labels.select(F.col("node").alias("__node"), F.col("label").alias("__l"))
        met = records.withColumn("__name", F.when(main | (F.size("__to") != 1), F.col("record_id")).otherwise(F.col("__to")[0]))
        labelled = met.join(of, F.col("__name") == F.col("__node"), "left").withColumn("__label", F.coalesce("__l", "__name"))
    row = F.struct(*carried)
    by_id = lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    pick = lambda kept: F.array_sort(F.collect_list(F.when(kept, row)), by_id)
    kind = F.coalesce("record_type", F.lit(""))
    out = labelled.groupBy("__label").agg(
        F.min_by(F.when(main, row), F.when(main, F.col("record_id"))).alias("response"),
        pick(kind == "request").alias("requests"), pick(kind == "metadata").alias("metadata"), pick(~kind.isin("request", "metadata")).alias("__others"),
        F.min("record_id").alias("__least"),
    )
    others = F.filter("__others", lambda x: ~x["record_id"].eqNullSafe(F.col("response.record_id")))
    return out.select(F.coalesce("response.record_id", "__least").alias("capture_id"), "response", "requests", "metadata", others.alias("others"))


def archive_and_assemble(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes `pages` as archives, reads them, and returns page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A revisit's size and digest are those of the response that it names by record id, else by payload digest (then of least
    page_id). Nulls and repeated rows as in captures; an empty table gives an empty result.
    """
    write_warc(captures(pages, id_col, url_col, payload_col), path)
    records = read_warc(pages.sparkSession, path)
    thin = records.select("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("read_digest"), "fields")
    caps = assemble(durable(thin))  # narrow; the archives are read once
    rows = caps.select(
        F.col("metadata")[0]["fields"]["page-id"].try_cast("long").alias("page_id"),
        F.col("response.record_id").alias("rid"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to").alias("told"),
        F.col("response.payload_bytes").alias("own_bytes"),
        F.col("response.read_digest").alias("own_digest"),
        F.regexp_replace(F.col("response.payload_digest"), "^sha256:", "").alias("told_digest"),
        F.col("response.target_uri").alias("url"),
    )
    rows = durable(rows)
    responses, revisits = rows.where("record_type = 'response'"), rows.where("record_type = 'revisit'")
    named = responses.join(revisits.select(F.col("told").alias("wanted")).distinct(), F.col("rid") == F.col("wanted"), "left_semi").select(F.col("rid").alias("told"), F.col("page_id").alias("of"), F.col("own_bytes").alias("bytes"), F.col("own_digest").alias("digest"))
    by_id = revisits.where("told is not null").join(named, "told", "left")
    unnamed = revisits.where("told is null")
    alike = responses.join(unnamed.select(F.col("told_digest").alias("d")).distinct(), F.col("own_digest") == F.col("d"), "left_semi").groupBy(F.col("own_digest").alias("told_digest")).agg(F.min("page_id").alias("of"), F.min("own_bytes").alias("bytes"), F.min("own_digest").alias("digest"))
    found = by_id.unionByName(unnamed.join(alike, "told_digest", "left"))
    told = found.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("of").alias("refers_to"), "url")
    own = responses.select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "url")
    return own.unionByName(told)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives; nulls, empties and
    repeats as in captures. The archives stay in the checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return archive_and_assemble(table(spark, sf_dir, "pages"), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
  CASE WHEN f.first IS NULL OR f.first = q.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first = q.page_id THEN NULL ELSE f.first END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
"""
