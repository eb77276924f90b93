"""A paged REST source and sink as Python data sources; the transport is given by the user.

Reading: `fetch(kind, query)` returns {"rows": [...], "total": n or None, "next": cursor or None}. Where pages go by index
and a total is reported, every range of `partition_rows` rows is a partition; else a kind is one, read until an empty page
or the last cursor. Filters on `kind` and `last_modified` are pushed to the requests of sources that `paged_source` makes.

Writing: `send(operations)` or `send(key, operations)` takes one request of (kind, id, body); key names it and its content.
With a ledger, a folder that driver and executors share, what a lost or repeated task has sent isn't sent again.

fetch and send are functions named by options ("package.module:function"), or closed over by `paged_source`.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
import json
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType, TimestampType

from rillstone.sources.files import Capabilities

MOST_PAGES = 100_000
OVERLAP = timedelta(seconds=60)
#: Rows of a partition where the total is known.
PARTITION_ROWS = 10_000


def page_query(start: int | None = None, count: int = 100, cursor: str | None = None, filter_text: str | None = None, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> dict[str, str]:
    """Parameters of one page: by index (from 1) or by cursor."""
    q = {"count": str(count)}
    if cursor is not None:
        q["cursor"] = cursor
    elif start is not None:
        q["startIndex"] = str(start)
    if filter_text:
        q["filter"] = filter_text
    if without:
        q["excludedAttributes"] = ",".join(without)
    if only:
        q["attributes"] = ",".join(only)
    return q


def delta_query(mark: datetime | None, supports_filter: bool) -> str | None:
    """The filter of a delta read; None means a full scan."""
    return f'meta.lastModified gt "{mark:%Y-%m-%dT%H:%M:%SZ}"' if mark is not None and supports_filter else None


def next_mark(provider_clock: datetime) -> datetime:
    """The watermark of a run that began at the provider's time, with an overlap."""
    return provider_clock - OVERLAP


def _load(fn: str | Callable) -> Callable:
    if not isinstance(fn, str):
        return fn
    module, _, name = fn.partition(":")
    return getattr(importlib.import_module(module), name)


def _time(text: str | None) -> datetime | None:
    at = datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None
    return at if at is None or at.tzinfo else at.replace(tzinfo=timezone.utc)


class Pages(InputPartition):
    """Rows first to last of a kind, by index from 1; without a last one all that there are."""

    def __init__(self, kind: str, first: int = 1, last: int | None = None):
        self.kind, self.first, self.last = kind, first, last


class PagedReader(DataSourceReader):
    """Rows by the columns of the schema: kind, id, body (the row as JSON), last_modified, and others by their names."""

    def __init__(self, fetch: str | Callable, options: dict, schema: StructType):
        self.fetch, self.schema = fetch, schema
        self.kinds = options["kinds"].split(",")
        self.count, self.by_cursor = int(options.get("count", "100")), options.get("paging", "index") == "cursor"
        self.rows = max(self.count, int(options.get("partition_rows", str(PARTITION_ROWS))))
        self.given, self.filters = options.get("filter"), options.get("supports_filter", "false").lower() == "true"
        own = {"kind", "id", "body", "last_modified"}
        # a schema without the whole body is a projection: only its attributes are asked for
        self.only = () if "body" in schema.names else tuple(n for n in schema.names if n not in own)
        self.since: list[tuple[datetime, bool]] = []  # lower bounds of last_modified, and whether the bound itself counts

    def filter_text(self) -> str | None:
        since = f'meta.lastModified ge "{max(t for t, _ in self.since):%Y-%m-%dT%H:%M:%SZ}"' if self.since else None
        return " and ".join(filter(None, (self.given, since))) or None

    def wanted(self, r: dict) -> bool:
        if not self.since:
            return True
        at = _time((r.get("meta") or {}).get("lastModified"))
        return at is not None and all(at >= t if equal else at > t for t, equal in self.since)

    def query(self, start: int | None, count: int, cursor: str | None = None) -> dict[str, str]:
        return page_query(None if self.by_cursor else start, count, cursor, self.filter_text(), only=self.only)

    def partitions(self) -> list[Pages]:
        out = []
        for kind in self.kinds:
            total = None if self.by_cursor else _load(self.fetch)(kind, self.query(1, 1)).get("total")
            if total is None:
                out.append(Pages(kind))
                continue
            if total > MOST_PAGES * self.count:
                raise ValueError(f"more than {MOST_PAGES} pages of {kind}")
            out += [Pages(kind, i, min(i + self.rows - 1, total)) for i in range(1, total + 1, self.rows)]
        return out or [Pages("", 1, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fetch, start, cursor = _load(self.fetch), partition.first, None
        for _ in range(MOST_PAGES):
            left = self.count if partition.last is None else min(self.count, partition.last - start + 1)
            if left <= 0:
                return
            page = fetch(partition.kind, self.query(start, left, cursor))
            yield from (self.row(partition.kind, r) for r in page["rows"][:left] if self.wanted(r))
            start, cursor = start + len(page["rows"]), page.get("next")
            if not page["rows"] or (self.by_cursor and cursor is None):
                return
        raise ValueError(f"more than {MOST_PAGES} pages of {partition.kind}")

    def row(self, kind: str, r: dict) -> tuple:
        def value(field):
            if field.name in ("kind", "id", "body"):
                return {"kind": kind, "id": str(r["id"]), "body": json.dumps(r, sort_keys=True)}[field.name]
            x = (r.get("meta") or {}).get("lastModified") if field.name == "last_modified" else r.get(field.name)
            return _time(x) if isinstance(field.dataType, TimestampType) and isinstance(x, str) else x

        return tuple(map(value, self.schema))


class PushedReader(PagedReader):
    """A reader that takes filters; Spark allows it only with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Kinds are picked here. Of times, requests ask for all since the second of the latest bound; read looks closer."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("kind",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.kinds = [k for k in self.kinds if k in wanted]
            elif self.filters and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("last_modified",) and isinstance(f.value, datetime):
                self.since.append((f.value.astimezone(timezone.utc), isinstance(f, GreaterThanOrEqual)))
            else:
                yield f


class Ledger:
    """What has been sent, in a shared folder (any address pyarrow knows): a file a request, written after it went out."""

    def __init__(self, uri: str, run: str):
        self.uri, self.run = uri, run

    def at(self, name: str) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.uri)
        return system, f"{path.rstrip('/')}/{self.run}/{name}"

    def has(self, name: str) -> bool:
        system, path = self.at(name)
        return system.get_file_info(path).type != fs.FileType.NotFound

    def put(self, name: str, content: dict) -> None:
        """Whole or not at all, and the same if put twice."""
        system, path = self.at(name)
        system.create_dir(path.rpartition("/")[0])
        part = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(content).encode())
        system.move(part, path)


class Sent(WriterCommitMessage):
    def __init__(self, sent: int, refused: int, requests: int, skipped: int):
        self.sent, self.refused, self.requests, self.skipped = sent, refused, requests, skipped


class BatchWriter(DataSourceWriter):
    """Rows (kind, id, body) in requests of at most max_operations and max_bytes each.

    An operation that is larger than a request may be is refused: it is written to the ledger and counted. A request's key
    is made of the run's name and its operations, so that a task that is run again makes the same requests of the same rows:
    those that the ledger has are skipped, and a target can tell one that went out without being noted. commit notes
    the run's counts; a run that is noted sends nothing any more. abort notes that it broke off; it may be done again.
    """

    def __init__(self, send: str | Callable, options: dict):
        self.send = send
        self.most, self.most_bytes = int(options.get("max_operations", "1000")), int(options.get("max_bytes", "1000000"))
        self.run = options.get("run") or uuid.uuid4().hex
        self.ledger = Ledger(options["ledger"], self.run) if "ledger" in options else None
        self.done = self.ledger is not None and self.ledger.has("committed")

    def requests(self, rows: Iterator) -> Iterator[tuple[list[tuple], list[tuple]]]:
        """(operations, refused ones) of one request after the other."""
        batch, refused, size = [], [], 0
        for r in rows:
            n = len(r["body"].encode()) if r["body"] is not None else 0
            if n > self.most_bytes:
                refused.append((r["kind"], r["id"], n))
                continue
            if batch and (len(batch) >= self.most or size + n > self.most_bytes):
                yield batch, refused
                batch, refused, size = [], [], 0
            batch.append((r["kind"], r["id"], r["body"]))
            size += n
        if batch or refused:
            yield batch, refused

    def write(self, rows: Iterator) -> Sent:
        if self.done:
            return Sent(0, 0, 0, sum(1 for _ in rows))
        send, sent, refused, requests, skipped = _load(self.send), 0, 0, 0, 0
        keyed = len(inspect.signature(send).parameters) > 1
        for batch, too_large in self.requests(rows):
            key = hashlib.sha256(json.dumps([self.run, batch, too_large]).encode()).hexdigest()
            refused += len(too_large)
            if self.ledger and self.ledger.has(f"sent/{key}"):
                skipped += len(batch)
                continue
            if batch:
                send(key, batch) if keyed else send(batch)
            if self.ledger:
                self.ledger.put(f"sent/{key}", {"operations": len(batch), "refused": too_large})
            sent, requests = sent + len(batch), requests + 1
        return Sent(sent, refused, requests, skipped)

    def _note(self, name: str, messages: list[Sent | None]) -> None:
        if self.ledger and not self.done:
            got = [m for m in messages if m]
            self.ledger.put(name, {k: sum(getattr(m, k) for m in got) for k in ("sent", "refused", "requests", "skipped")})

    def commit(self, messages: list[Sent | None]) -> None:
        self._note("committed", messages)

    def abort(self, messages: list[Sent | None]) -> None:
        self._note("aborted", messages)


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").options(fetch=..., kinds="users,groups").load()"""

    #: Closed over by paged_source; else the options name them.
    fetch: Callable | None = None
    send: Callable | None = None
    read_by: type = PagedReader

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "kind string, id string, body string"

    def reader(self, schema) -> PagedReader:
        return type(self).read_by(type(self).fetch or self.options["fetch"], self.options, schema)

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(type(self).send or self.options["send"], self.options)


def paged_source(spark: SparkSession, fetch: Callable | None = None, send: Callable | None = None) -> str:
    """Register a source with this transport and give its format's name. Filters are pushed to its requests."""
    for module in {__name__, *(f.__module__ for f in (fetch, send) if f)}:
        cloudpickle.register_pickle_by_value(sys.modules[module])  # workers may lack these modules
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own = f"paged_{uuid.uuid4().hex}"
    parts = {"read_by": PushedReader, "fetch": staticmethod(fetch) if fetch else None, "send": staticmethod(send) if send else None, "name": classmethod(lambda cls: own)}
    spark.dataSource.register(type("OwnSource", (PagedSource,), parts))
    return own


#: What a paged service can do, unless it says otherwise.
SERVICE = Capabilities(delta_import=True, export=True, paging=True, parallel_export=True, watermark=True)


def send_all(operations: DataFrame, form: str, run: str, ledger: str, parts: int, capabilities: Capabilities = SERVICE, **options: str) -> None:
    """Send operations (kind, id, body), dealt and ordered by what they are: a run of the same name makes the same requests."""
    capabilities.check("export" if parts == 1 else "parallel export")
    rows = operations.select("kind", "id", "body").repartition(parts, "kind", "id").sortWithinPartitions("kind", "id", "body")
    rows.write.format(form).options(run=run, ledger=ledger, **options).mode("append").save()
