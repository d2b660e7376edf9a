"""The upstream service as a Spark data source, in batches and as a stream.

``spark.read.format("meeting_service")`` asks for one ``kind``. Kinds that come in one answer make one row. Transcripts
and panels are asked for by document: ids lie in a queue of numbered Parquet folders (``enqueue``), which tasks read
by themselves, ``documents`` of them a partition, so ids don't pass the driver and a lost task asks for its own part again.
As a stream, an offset is the number of the queue's next folder: each folder is one step, made again after a failure.

A request that meets 429, 5xx or no answer is made again after a growing pause (or the one that the service names), at
most ``attempts`` times. What fails is a row with a status (``not_found`` for 404 and for an empty answer, else
``error``) and a detail; 401 fails the job, since it holds for all.

Options: url, token, kind, queue, documents (100), attempts (5), pause and longest_pause (seconds: 0.5, 30), timeout (30).
"""

from __future__ import annotations

import http.client
import json
import random
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillspan.sources.files import numbered, opened, settle

ANSWER = "document_id string, kind string, status string, detail string, attempts int, body string"
# The service's paths.
PATHS = {
    "documents": "v2/get-documents",
    "people": "v1/get-people",
    "calendars": "v1/get-selected-calendars",
    "events": "v1/refresh-calendar-events",
    "templates": "v1/get-panel-templates",
    "recipes": "v1/get-recipes",
    "transcript": "v1/get-document-transcript",
    "panels": "v1/get-document-panels",
}
BY_DOCUMENT = {"transcript": "utterances", "panels": "panels"}  # and the landing folder of each


class Unauthorized(RuntimeError):
    """The service takes no request with this token."""


@dataclass
class Slice(InputPartition):
    """Ids of one row group of a file of the queue; no file for a kind that comes in one answer."""

    file: str | None = None
    group: int = 0
    first: int = 0
    count: int = 0


class Client:
    def __init__(self, options: dict[str, str]):
        self.url, self.token, self.kind = options["url"].rstrip("/"), options.get("token"), options["kind"]
        if self.kind not in PATHS:
            raise ValueError(f"kind is one of {', '.join(PATHS)}")
        self.attempts = max(1, int(options.get("attempts", 5)))
        self.pause, self.longest, self.timeout = (float(options.get(k, d)) for k, d in (("pause", 0.5), ("longest_pause", 30), ("timeout", 30)))

    def once(self, body: dict) -> tuple[int, str, str | None]:
        """HTTP status (0: no answer), text and the pause that the service asks for."""
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.token}"} if self.token else {})}
        request = urllib.request.Request(f"{self.url}/{PATHS[self.kind]}", json.dumps(body).encode(), headers, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            return e.code, e.read(500).decode("utf-8", "replace"), e.headers.get("Retry-After")
        except (OSError, http.client.HTTPException) as e:  # refused, reset, timed out, cut short
            return 0, str(e), None

    def wait(self, made: int, named: str | None) -> float:
        """Seconds before the next attempt: as named, else doubling with a random part, so tasks don't come back together."""
        if named is not None and named.strip().isdigit():
            return min(self.longest, float(named))
        return min(self.longest, self.pause * 2 ** (made - 1)) * random.uniform(0.5, 1)

    def ask(self, document: str | None) -> tuple:
        """One row of ``ANSWER``."""
        code, text, made = 0, "", 0
        while made < self.attempts:
            code, text, named = self.once({} if document is None else {"document_id": document})
            made += 1
            if code not in (0, 429) and code < 500:
                break
            if made < self.attempts:
                time.sleep(self.wait(made, named))
        if code == 401:
            raise Unauthorized(f"{self.url} answers 401 to {self.kind}")
        if code == 404:
            return document, self.kind, "not_found", "404", made, None
        if code != 200:
            return document, self.kind, "error", f"{code} {text[:200]}".strip(), made, None
        try:
            value = json.loads(text)
        except ValueError as e:
            return document, self.kind, "error", f"not JSON: {e}", made, None
        if document is not None and not isinstance(value, list):
            return document, self.kind, "error", "not a list", made, None
        if document is not None and not value:
            return document, self.kind, "not_found", "empty", made, None
        return document, self.kind, None, None, made, text


def _slices(folder: str, per: int) -> list[Slice]:
    """The parts of a folder of the queue, from the files' footers."""
    files, path = opened(folder)
    out = []
    for info in sorted(files.get_file_info(pafs.FileSelector(path, recursive=True)), key=lambda i: i.path):
        if info.type != pafs.FileType.File or not info.base_name.endswith(".parquet") or info.base_name.startswith(("_", ".")):
            continue
        with files.open_input_file(info.path) as f:
            footer = pq.ParquetFile(f).metadata
            rows = [footer.row_group(g).num_rows for g in range(footer.num_row_groups)]
        where = folder[: len(folder) - len(path)] + info.path if folder.endswith(path) else info.path
        out += [Slice(where, g, first, min(per, n - first)) for g, n in enumerate(rows) for first in range(0, n, per)]
    return out


def _folders(queue: str) -> list[int]:
    files, path = opened(queue)
    infos = files.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(int(i.base_name) for i in infos if i.base_name.isdigit())


class _Asking:
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.client = Client(self.options)
        self.per = max(1, int(self.options.get("documents", 100)))
        if self.client.kind in BY_DOCUMENT and "queue" not in self.options:
            raise ValueError(f"{self.client.kind} are asked for by document: name a queue of ids")

    def _parts(self, numbers: list[int]) -> list[Slice]:
        return [s for n in numbers for s in _slices(f"{self.options['queue'].rstrip('/')}/{n:012d}", self.per)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if partition.file is None:
            yield self.client.ask(None)
            return
        files, path = opened(partition.file)
        with files.open_input_file(path) as f:
            ids = pq.ParquetFile(f).read_row_group(partition.group, columns=["document_id"]).slice(partition.first, partition.count)
        for document in ids.column(0).to_pylist():
            yield self.client.ask(document)


class ServiceReader(_Asking, DataSourceReader):
    def partitions(self) -> list[Slice]:
        if self.client.kind not in BY_DOCUMENT:
            return [Slice(None)]
        return self._parts(_folders(self.options["queue"])) or [Slice(None, count=-1)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return iter(()) if partition.count < 0 else super().read(partition)


class ServiceStream(_Asking, DataSourceStreamReader):
    """Documents as they are put into the queue."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if self.client.kind not in BY_DOCUMENT:
            raise ValueError("only what is asked for by document can be streamed")

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": max(_folders(self.options["queue"]), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return self._parts([n for n in _folders(self.options["queue"]) if start["next"] <= n < end["next"]])

    def commit(self, end: dict) -> None:
        """Folders stay: they say what was asked for and when."""


class ServiceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meeting_service"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema) -> ServiceReader:
        return ServiceReader(self.options)

    def streamReader(self, schema) -> ServiceStream:
        return ServiceStream(self.options)


def enqueue(spark: SparkSession, ids: DataFrame, queue: str) -> int:
    """Put document ids (a column ``document_id``; nulls and repeats are left out) into the queue; the folder's number."""
    aside = f"{queue.rstrip('/')}/.aside-{uuid.uuid4().hex}"
    ids.filter("document_id is not null").select("document_id").distinct().write.parquet(aside)
    while True:
        n = max(numbered(spark, queue), default=-1) + 1
        if settle(spark, aside, f"{queue.rstrip('/')}/{n:012d}", keep=True):
            return n


def answers(spark: SparkSession, kind: str, url: str, token: str | None = None, queue: str | None = None, stream: bool = False, **options: object) -> DataFrame:
    """``ANSWER`` rows of one kind."""
    spark.dataSource.register(ServiceSource)
    given = {"kind": kind, "url": url, "token": token, "queue": queue, **options}
    reader = (spark.readStream if stream else spark.read).format("meeting_service")
    return reader.options(**{k: str(v) for k, v in given.items() if v is not None}).load()


def land(rows: DataFrame, root: str, kind: str) -> None:
    """Write the answers of one kind into a landing zone: bodies a line each, and in ``fetched`` what was asked for.

    They are written aside first, so nothing is asked for twice. A kind that comes in one answer is an error if it failed.
    """
    aside = f"{root.rstrip('/')}/answers/{kind}-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    kept = rows.sparkSession.read.schema(ANSWER).parquet(aside)
    if kind not in BY_DOCUMENT and (failed := kept.filter("status is not null").first()) is not None:
        raise RuntimeError(f"{kind}: {failed['status']}, {failed['detail']}")
    one_line = F.regexp_replace("body", "[\r\n]+", " ")  # JSON holds no line ends inside strings
    kept.filter("status is null").select(one_line.alias("value")).write.mode("append").text(f"{root}/{BY_DOCUMENT.get(kind, kind)}")
    if kind in BY_DOCUMENT:
        kept.select("document_id", "kind", "status").write.mode("append").json(f"{root}/fetched")
