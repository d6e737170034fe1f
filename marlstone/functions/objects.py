"""Column functions of keyed objects: sizes, tags, types, byte ranges, chunks, lifetimes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content types by file extension.
MIME_TYPES = {
    ".html": "text/html",
    ".htm": "text/html",
    ".css": "text/css",
    ".js": "application/javascript",
    ".mjs": "application/javascript",
    ".json": "application/json",
    ".xml": "application/xml",
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".md": "text/markdown",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".svg": "image/svg+xml",
    ".webp": "image/webp",
    ".ico": "image/x-icon",
    ".pdf": "application/pdf",
    ".zip": "application/zip",
    ".gz": "application/gzip",
    ".tar": "application/x-tar",
    ".mp3": "audio/mpeg",
    ".mp4": "video/mp4",
    ".webm": "video/webm",
    ".woff": "font/woff",
    ".woff2": "font/woff2",
    ".ttf": "font/ttf",
    ".otf": "font/otf",
    ".wasm": "application/wasm",
}
DEFAULT_TYPE = "application/octet-stream"
#: Bytes of a chunk when a reader names none.
CHUNK = 64 * 1024


def etag(data: Column) -> Column:
    """Quoted md5 of the bytes."""
    return F.concat(F.lit('"'), F.md5(data), F.lit('"'))


def guess_type(key: Column) -> Column:
    """Content type by the text from a key's last dot, whatever its case."""
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    extension = F.lower(F.regexp_extract(key, r"(\.[^.]*)$", 1))
    return F.coalesce(F.try_element_at(table, extension), F.lit(DEFAULT_TYPE))


def content_type(stored: Column, key: Column, option: str | None = None) -> Column:
    """The stored type, else the caller's, else a guess."""
    return F.coalesce(stored, F.lit(option).cast("string"), guess_type(key))


def size(data: Column) -> Column:
    return F.coalesce(F.octet_length(data), F.lit(0)).cast("long")


def byte_range(data: Column, start: Column | int, end: Column | int | None = None) -> Column:
    """Bytes from start to before end; end stops at the data's end, an empty range is empty.
    Negative starts count as 0."""
    start = F.greatest(_column(start), F.lit(0))
    stop = F.octet_length(data) if end is None else F.least(_column(end), F.octet_length(data))
    return data.substr((start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))


def _column(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def http_range(header: Column, length: Column) -> Column:
    """A Range header against a length: struct(status, start, end). One range of bytes=a-b is
    understood (206, or 416 when it holds nothing); any other text means the whole (200)."""
    grammar = r"^bytes=([0-9]+)-([0-9]*)$"
    known = F.coalesce(header.rlike(grammar), F.lit(False))
    start = F.regexp_extract(header, grammar, 1).try_cast("long")
    given = F.regexp_extract(header, grammar, 2).try_cast("long")
    last = F.least(F.coalesce(given, length - 1), length - 1)
    bad = known & ((start > last) | (start >= length))
    status = F.when(~known, 200).when(bad, 416).otherwise(206)
    return F.struct(
        status.alias("status"),
        F.when(bad, F.lit(None)).when(known, start).otherwise(F.lit(0)).cast("long").alias("start"),
        F.when(bad, F.lit(None)).when(known, last + 1).otherwise(length).cast("long").alias("end"),
    )


def chunks(data: Column, chunk: int = CHUNK) -> Column:
    """Array of struct(no, bytes): the data in pieces, in order; empty data has none."""
    n = F.ceil(F.octet_length(data) / chunk).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct(i.alias("no"), byte_range(data, i * chunk, (i + 1) * chunk).alias("bytes")))


def concat_chunks(no: Column, data: Column) -> Column:
    """Aggregate: the bytes of chunks in order of their numbers."""
    ordered = F.array_sort(F.collect_list(F.struct(no.alias("no"), data.alias("data"))))
    return F.aggregate(ordered, F.lit(b""), lambda acc, x: F.concat(acc, x["data"]))


def expires_at(now_ms: Column | int, seconds: Column) -> Column:
    """Deadline in epoch milliseconds; none for null or 0 seconds; negative seconds have passed."""
    now = _column(now_ms).cast("double")
    return F.when(seconds.isNotNull() & (seconds != 0), (now + seconds * 1000).cast("long"))


def live(deadline: Column, now_ms: Column | int) -> Column:
    """Whether an object has not expired: it has no deadline, or it is not past it."""
    return deadline.isNull() | (_column(now_ms) <= deadline)
