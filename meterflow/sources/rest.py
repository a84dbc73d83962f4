"""A paged REST source as a Spark data source, for a batch and for a stream.

``spark.dataSource.register(PagedSource)`` and then ``spark.read.format("paged")`` with options
``requests`` (JSON list of requests) and ``transport``: an Arrow batch per page. The driver asks each request for
its total alone and deals its pages to tasks, ``pages_per_task`` each (more where that makes over ``tasks`` tasks);
a request's last task reads on until a page is short. A task has ``pool`` calls under way, so that their waits and
pauses overlap; a policy that makes one call at a time reads each request in one task, page after page.
The transport ``replay:<folder>`` answers from recorded pages below any address that pyarrow opens (each a
line per try, so that failures replay, too); ``http:<address>`` fetches. Failed tasks are tried again by
Spark, single calls by the reader as the source's ``policy`` says; ``wait=none`` leaves the waiting out. All
pages of a request are read: ``most`` bounds the records only if it is set, and then a longer request fails
unless ``on_most`` is ``stop``.

``spark.readStream.format("paged")`` takes the same options for requests whose records are only ever added
to, in order of period. An offset is the number of records of each request; the driver asks each request for its
total alone, and tasks read what lies between two offsets, dealt as in a batch, so that a restart
reads from where the last committed batch ended and every record comes once. A request that has become
shorter fails the stream.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.parse
import urllib.request
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import open_path

PAGE = 2500


@dataclass(frozen=True)
class Policy:
    """How calls are tried again: which answers, after how long, growing by how much, at most ``cap`` seconds."""

    tries: int = 3
    pause: float = 0.3
    codes: tuple[int, ...] = (429, 500, 502, 503, 504)
    limited: float = 2.0  # growth of the pause after 429, before it is waited
    other: float = 2.0  # growth after anything else, once it was waited
    cap: float = 60.0
    before: float = 0.0  # seconds before every call
    pool: int = 32  # calls that a task has under way


#: The first source: pooled calls; the second: spaced calls, long pauses, HTTP errors other than 429 are final.
POLICIES = {"pooled": Policy(), "spaced": Policy(pause=5.0, codes=(429,), other=1.5, before=3.0, pool=1)}

ENDPOINTS = {"demand": "electricity/rto/region-data/data", "generation": "electricity/rto/fuel-type-data/data"}


def parameters(data_type: str, regions: list[str], start: str, end: str) -> dict[str, str]:
    """Facets, range, order and columns of one request."""
    if data_type not in ENDPOINTS:
        raise ValueError(f"unknown data type {data_type}")
    out = {"frequency": "hourly", "data[0]": "value", "start": start, "end": end, "sort[0][column]": "period", "sort[0][direction]": "asc"}
    if len(regions) == 1:
        out["facets[respondent][]"] = regions[0]
    else:
        out |= {f"facets[respondent][{i}]": r for i, r in enumerate(regions)}
    return out | ({"facets[type][]": "D"} if data_type == "demand" else {})


class TooManyRecords(RuntimeError):
    """A request has more records than ``most``."""


def pages(fetch: Callable[[dict], dict], params: dict, most: int | None = None, page: int = PAGE, on_most: str = "fail", offset: int = 0) -> Iterator[list[dict]]:
    """Successive pages until one is short. Beyond ``most`` records it fails, or ends with ``on_most="stop"``."""
    while True:
        if most is not None and offset > most:
            if on_most == "stop":
                return
            raise TooManyRecords(f"more than {most} records: narrow the request, raise most, or set on_most=stop")
        rows = fetch(params | {"offset": str(offset), "length": str(page)})["response"]["data"]
        if rows:
            yield rows
        if len(rows) < page:
            return
        offset += page


def retried(call: Callable[[], dict], policy: Policy = POLICIES["pooled"], sleep: Callable[[float], None] = time.sleep) -> dict:
    pause = policy.pause
    for i in range(policy.tries):
        if policy.before:
            sleep(policy.before)
        try:
            return call()
        except OSError as e:
            code = getattr(e, "code", None)
            if i == policy.tries - 1 or (code is not None and code not in policy.codes):
                raise
            if code == 429 and policy.before:
                pause = min(policy.cap, pause * policy.limited)
                sleep(pause)
            else:
                sleep(min(policy.cap, pause))
                pause *= policy.other
    raise AssertionError("unreachable")


def ahead(call: Callable, asked: Iterable, pool: int) -> Iterator:
    """``call`` of all that is asked, in its order: ``pool`` under way, so that pauses overlap, and at most four times as many results held."""
    held: deque = deque()
    with ThreadPoolExecutor(pool) as threads:
        try:
            for x in asked:
                if len(held) >= (4 * pool if pool > 1 else 1):
                    yield held.popleft().result()
                held.append(threads.submit(call, x))
            while held:
                yield held.popleft().result()
        finally:
            for waiting in held:
                waiting.cancel()


class Refused(OSError):
    """An answer that is an HTTP error."""

    def __init__(self, code: int):
        super().__init__(f"HTTP {code}")
        self.code = code


def page_name(endpoint: str, regions: str, start: str, offset: str | int) -> str:
    """File name of a recorded page."""
    return f"{endpoint.split('/')[-2]}_{regions}_{start}_{offset}.json"


class Replay:
    """Recorded pages of ``page`` records; a call may ask for a part of one page."""

    def __init__(self, where: str, endpoint: str, page: int):
        self.fs, self.top = open_path(where)
        self.endpoint, self.page, self.tried = endpoint, page, Counter()
        self.ends, self.listing = None, threading.Lock()

    def _name(self, params: dict, offset: int | str) -> str:
        regions = [v for k, v in sorted(params.items()) if k.startswith("facets[respondent]")]
        return page_name(self.endpoint, "-".join(regions), params["start"], offset)

    def __call__(self, params: dict) -> dict:
        offset, length = int(params["offset"]), int(params["length"])
        first = offset // self.page * self.page
        name = f"{self.top}/{self._name(params, first)}"
        try:
            with self.fs.open_input_stream(name) as file:
                answers = file.read().decode().splitlines()
        except FileNotFoundError:
            return {"response": {"data": []}}
        answer = json.loads(answers[min(self.tried[name], len(answers) - 1)])  # a line for each try
        self.tried[name] += 1
        if "status" in answer:
            raise Refused(answer["status"])
        rows = answer["response"]["data"][offset - first : offset - first + length]
        return {"response": answer["response"] | {"data": rows}}

    def _ends(self) -> dict[str, int]:
        """The largest offset of each request by the begin of its names; the folder is listed once for all requests."""
        with self.listing:
            if self.ends is None:
                self.ends = {}
                for x in self.fs.get_file_info(pyarrow.fs.FileSelector(self.top, allow_not_found=True)):
                    begin, _, offset = x.base_name.removesuffix(".json").rpartition("_")
                    if x.base_name.endswith(".json") and offset.isdigit():
                        self.ends[begin] = max(int(offset), self.ends.get(begin, 0))
            return self.ends

    def total(self, params: dict) -> int:
        """Records of a request, from its last page."""
        last = self._ends().get(self._name(params, "").removesuffix("_.json"))
        if last is None:
            return 0
        with self.fs.open_input_stream(f"{self.top}/{self._name(params, last)}") as file:
            answer = json.loads(file.read().decode().splitlines()[-1])
        if "status" in answer:
            raise Refused(answer["status"])
        return last + len(answer["response"]["data"])


class Http:
    def __init__(self, where: str, endpoint: str):
        self.address = f"{where}/{endpoint}"

    def __call__(self, params: dict) -> dict:
        with urllib.request.urlopen(f"{self.address}?{urllib.parse.urlencode(params)}", timeout=30) as answer:  # noqa: S310
            found = json.load(answer)
        if "response" not in found:
            raise ValueError("the answer has no response")
        return found

    def total(self, params: dict) -> int | None:
        """Records of a request, as the source counts them, if it does."""
        found = self(params | {"offset": "0", "length": "1"})["response"].get("total")
        return None if found is None else int(found)


def transport(spec: str, endpoint: str, page: int = PAGE) -> Replay | Http:
    kind, _, where = spec.partition(":")
    if kind == "replay":
        return Replay(where, endpoint, page)
    if kind == "http":
        return Http(where, endpoint)
    raise ValueError(f"unknown transport {kind}")


#: Columns of a record and their names at the source.
FIELDS = {"period": "period", "respondent": "respondent", "fueltype": "fueltype", "type_name": "type-name", "value": "value", "value_units": "value-units"}


def as_batch(data_type: str, rows: list[dict]) -> pa.RecordBatch:
    """One page as an Arrow batch of text columns."""
    text = lambda x: None if x is None else x if isinstance(x, str) else str(x)
    columns = [pa.array([data_type] * len(rows), pa.string())]
    columns += [pa.array([text(r.get(k)) for r in rows], pa.string()) for k in FIELDS.values()]
    return pa.RecordBatch.from_arrays(columns, ["data_type", *FIELDS])


class Request(InputPartition):
    def __init__(self, value: dict):
        super().__init__(value)


class Calls:
    """The options of a source, and calls as its policy says."""

    def __init__(self, options: dict):
        self.requests = json.loads(options["requests"])
        self.spec = options["transport"]
        self.page = int(options.get("page", PAGE))
        self.policy = POLICIES[options.get("policy", "pooled")]
        self.pool = int(options.get("pool", self.policy.pool))
        self.pages_per_task, self.tasks = int(options.get("pages_per_task", 20)), int(options.get("tasks", 200))
        self.sleep = {"sleep": time.sleep, "none": _no_wait}[options.get("wait", "sleep")]

    def of(self, request: dict) -> tuple[Replay | Http, dict]:
        """The transport of a request and its parameters."""
        found = transport(self.spec, ENDPOINTS[request["data_type"]], self.page)
        return found, parameters(request["data_type"], request["regions"], request["start"], request["end"])

    def retried(self, call: Callable[[], dict]) -> dict:
        return retried(call, self.policy, self.sleep)

    def totals(self) -> list[int | None]:
        """Records of each request; None where the source does not tell."""
        fetches = {t: transport(self.spec, ENDPOINTS[t], self.page) for t in {r["data_type"] for r in self.requests}}

        def total(request: dict) -> int | None:
            return self.retried(lambda: fetches[request["data_type"]].total(self.of(request)[1]))

        with ThreadPoolExecutor(8) as threads:
            return list(threads.map(total, self.requests))

    def step(self, spans: list[tuple[int, int]]) -> int:
        """Records of a task, so that these spans of records need about ``tasks`` tasks at most."""
        n = sum(-(-(last - at) // self.page) for at, last in spans)
        return self.page * max(self.pages_per_task, -(-n // self.tasks))

    def between(self, request: dict, at: int, last: int) -> Iterator[pa.RecordBatch]:
        """The pages between two offsets, in order."""
        fetch, params = self.of(request)

        def batch(span: tuple[int, int]) -> pa.RecordBatch:
            asked = params | {"offset": str(span[0]), "length": str(span[1] - span[0])}
            rows = self.retried(lambda: fetch(asked))["response"]["data"]
            if len(rows) != span[1] - span[0]:
                raise Shrunk(f"{request}: {len(rows)} of {span[1] - span[0]} records from {span[0]} on")
            return as_batch(request["data_type"], rows)

        cuts = [at, *range((at // self.page + 1) * self.page, last, self.page)]
        return ahead(batch, zip(cuts, [*cuts[1:], last]) if at < last else [], self.pool)


def _no_wait(seconds: float) -> None:
    pass


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.calls = Calls(options)
        self.most = int(options["most"]) if options.get("most") else None
        self.on_most = options.get("on_most", "fail")

    def partitions(self) -> list[Request]:
        page, most = self.calls.page, self.most
        totals = self.calls.totals() if self.calls.pool > 1 else [None] * len(self.calls.requests)
        # whole pages are dealt; the last task of a request reads on from their end, and meets ``most`` there
        full = [(n if most is None else min(n, most)) // page * page if n else 0 for n in totals]
        step, out = self.calls.step([(0, n) for n in full]), []
        for request, n in zip(self.calls.requests, full):
            for at in range(0, max(n, 1), step):
                out.append(Request(request | {"from": at, "to": min(n, at + step), "on": at + step >= n}))
        return out

    def read(self, partition: Request) -> Iterator[pa.RecordBatch]:
        request = partition.value
        yield from self.calls.between(request, request["from"], request["to"])
        if request["on"]:
            fetch, params = self.calls.of(request)
            for rows in pages(lambda p: self.calls.retried(lambda: fetch(p)), params, self.most, self.calls.page, self.on_most, request["to"]):
                yield as_batch(request["data_type"], rows)


class Shrunk(RuntimeError):
    """A request has fewer records than were read from it."""


class PagedStreamReader(DataSourceStreamReader):
    """Offsets: records of each request, by its JSON text."""

    def __init__(self, options: dict):
        self.calls = Calls(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = dict(zip(map(_key, self.calls.requests), self.calls.totals()))
        if None in found.values():
            raise ValueError("the source does not tell how many records a request has")
        return found

    def partitions(self, start: dict, end: dict) -> list[Request]:
        spans = [(start.get(k, 0), end.get(k, 0)) for k in map(_key, self.calls.requests)]
        for request, (at, last) in zip(self.calls.requests, spans):
            if last < at:
                raise Shrunk(f"{request}: {at} records were read, now there are {last}")
        out, step = [], self.calls.step(spans)
        for request, (at, last) in zip(self.calls.requests, spans):
            while at < last:
                till = min(last, at // step * step + step)
                out.append(Request(request | {"from": at, "to": till}))
                at = till
        return out

    def read(self, partition: Request) -> Iterator[pa.RecordBatch]:
        request = partition.value
        return self.calls.between(request, request["from"], request["to"])

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _key(request: dict) -> str:
    return json.dumps(request, sort_keys=True)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "data_type string, " + ", ".join(f"{c} string" for c in FIELDS)

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStreamReader:
        return PagedStreamReader(self.options)
