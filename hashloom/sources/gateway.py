"""Objects behind an HTTP gateway: a data source to read and write, and a lookup for tables of ids.

    spark.dataSource.register(GatewaySource)
    spark.read.format("cas_gateway").option("gateway", url).option("ids", "f0155...,f0155...").load()
    objects.write.format("cas_gateway").option("rpc", url).mode("append").save()

Reading needs spark.sql.python.filterPushdown.enabled, so that a filter on cid can
name the objects; without ids and such a filter it is an error, as a gateway does
not list what it has. It asks GET <gateway>/ipfs/<cid>, with a Range header for
parts; writing posts to <rpc>/api/v0/add, and ``save_remote`` gives the ids that
come back. Each task keeps up to ``concurrency`` requests in flight. Options
``headers`` (a JSON object), ``user`` and ``password`` (basic authentication) go
along with every request. A whole object whose id is a SHA-256 of its bytes is
checked against it, read or written. Time-outs and connection errors are
tried again with growing pauses; an HTTP status error is raised at once, except that Spark may
run the task again, which is safe as content decides the id.
"""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import socket
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from urllib.parse import quote, urlencode

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from hashloom.operators.objects import CHUNKER

SCHEMA = "cid string, data binary"
_RAW = "f01551220"  # of the id of raw bytes by SHA-256, in base16
GATEWAY, RPC = "http://127.0.0.1:8080", "http://127.0.0.1:5001"
_CHUNKER = re.compile(rf"({CHUNKER})\Z")


def tried_again(call: Callable[[], bytes], retries: int = 3, pause: float = 1.0, factor: float = 2.0) -> bytes:
    """The call's result; after time-outs and connection errors up to ``retries`` further tries."""
    if retries < 0 or pause <= 0 or factor < 1:
        raise ValueError("retries are not negative, pauses positive, factors 1 or more")
    for turn in range(retries + 1):
        try:
            return call()
        except urllib.error.HTTPError:
            raise
        except (urllib.error.URLError, TimeoutError, socket.timeout, ConnectionError):
            if turn == retries:
                raise
            time.sleep(pause * factor**turn * random.uniform(0.95, 1.05))
    raise AssertionError


def range_header(offset: int | None = None, length: int | None = None, suffix: int | None = None) -> str | None:
    """The Range header for a part; None for all, or where no byte is asked for."""
    if suffix is not None:
        return f"bytes=-{suffix}" if suffix else None
    if offset is None and length is None:
        return None
    begin = offset or 0
    return f"bytes={begin}-" if length is None else f"bytes={begin}-{begin + length - 1}" if length else None


def with_authentication(headers: dict[str, str] | None = None, user: str | None = None, password: str = "") -> dict[str, str]:
    """Headers of every request: those given, and basic authentication for a user."""
    out = dict(headers or {})
    if user is not None:
        out["Authorization"] = "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()
    return out


def hex_id(cid: str) -> str:
    """An id in base16, as this library writes ids; one in another base than 32 or 16 stays as it is."""
    if cid.startswith("b") and re.fullmatch(r"b[a-z2-7]+", cid):
        return "f" + base64.b32decode(cid[1:].upper() + "=" * (-len(cid[1:]) % 8)).hex()
    return cid


def checked(cid: str, data: bytes) -> bytes:
    """The data; an error if the id is that of raw bytes with another SHA-256."""
    if (own := hex_id(cid)).startswith(_RAW) and own != _RAW + hashlib.sha256(data).hexdigest():
        raise ValueError(f"the content of {cid} has another hash")
    return data


def in_flight(call: Callable, items: Iterable, concurrency: int) -> Iterator:
    """The calls' results in order, with so many of them under way at most."""
    if concurrency < 1:
        raise ValueError("one request at least is in flight")
    items = iter(items)
    with ThreadPoolExecutor(concurrency) as pool:
        while some := list(islice(items, concurrency)):
            yield from pool.map(call, some)


def fetch(gateway: str, cid: str, offset: int | None = None, length: int | None = None, suffix: int | None = None, timeout: float = 60, headers: dict[str, str] | None = None, **again) -> bytes:
    if suffix == 0 or length == 0:
        return b""
    part = range_header(offset, length, suffix)
    request = urllib.request.Request(f"{gateway.rstrip('/').removesuffix('/ipfs')}/ipfs/{quote(cid)}", headers=(headers or {}) | ({"Range": part} if part else {}))

    def call() -> bytes:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return response.read()

    data = tried_again(call, **again)
    return data if part else checked(cid, data)


def add(rpc: str, data: bytes, hasher: str = "sha2-256", chunker: str = "size-1048576", pin: bool = False, timeout: float = 60, headers: dict[str, str] | None = None, **again) -> str:
    """Write an object; the id that comes back, in base16 where it is in base 32."""
    if not _CHUNKER.match(chunker):
        raise ValueError(f"not a chunker: {chunker}")
    mark = uuid.uuid4().hex
    body = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="blob"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode() + data + f"\r\n--{mark}--\r\n".encode()
    where = f"{rpc.rstrip('/')}/api/v0/add?{urlencode({'hash': hasher, 'chunker': chunker, 'pin': str(pin).lower()})}"
    request = urllib.request.Request(where, data=body, headers=(headers or {}) | {"Content-Type": f"multipart/form-data; boundary={mark}"}, method="POST")

    def call() -> bytes:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return response.read()

    answer = json.loads(tried_again(call, **again))
    if not isinstance(answer, dict) or not answer.get("Hash"):
        raise ValueError(f"no id came back: {str(answer)[:200]}")
    checked(answer["Hash"], data)
    return hex_id(answer["Hash"])


def _settings(options: dict[str, str]) -> dict:
    """Keyword arguments of requests from string options."""
    return {
        "timeout": float(options.get("timeout", "60")), "retries": int(options.get("retries", "3")), "pause": float(options.get("pause", "1")),
        "headers": with_authentication(json.loads(options.get("headers", "{}")), options.get("user"), options.get("password", "")),
    }


class GatewaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cas_gateway"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


class _Ids(InputPartition):
    def __init__(self, ids: list[str]):
        super().__init__(None)
        self.ids = ids


class _Reader(DataSourceReader):
    """The ids in option ``ids`` (comma-separated), or those that filters ask for, or those in both."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        given = [x for x in options.get("ids", "").split(",") if x]
        self.ids: list[str] | None = given or None  # None: not restricted yet

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("cid",):
                asked = list(dict.fromkeys([f.value] if isinstance(f, EqualTo) else f.value))
                self.ids = asked if self.ids is None else [i for i in self.ids if i in asked]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.ids is None:
            raise ValueError("name the objects to read: option ids, or a filter on cid (spark.sql.python.filterPushdown.enabled)")
        size = int(self.options.get("perpartition", "32"))
        return [_Ids(self.ids[k : k + size]) for k in range(0, len(self.ids), size)] or [_Ids([])]

    def read(self, partition: _Ids) -> Iterator[tuple[str, bytes]]:
        gateway, more = self.options.get("gateway", GATEWAY), _settings(self.options)
        yield from in_flight(lambda cid: (cid, fetch(gateway, cid, **more)), partition.ids, int(self.options.get("concurrency", "32")))


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options
        if not _CHUNKER.match(options.get("chunker", "rabin")):
            raise ValueError(f"not a chunker: {options['chunker']}")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        o, more = self.options, _settings(self.options)
        call = lambda row: add(o.get("rpc", RPC), bytes(row["data"]), o.get("hasher", "sha2-256"), o.get("chunker", "size-1048576"), o.get("pin", "false") == "true", **more)
        for _ in in_flight(call, rows, int(o.get("concurrency", "32"))):
            pass
        return WriterCommitMessage()


def save_remote(objects: DataFrame, rpc: str = RPC, hasher: str = "sha2-256", chunker: str = "size-1048576", pin: bool = False, concurrency: int = 32, **more) -> DataFrame:
    """(cid, remote_id): writes the objects when the rows are asked for, with the id that came back for each; ``more``: timeout, headers, retries, pause."""
    if not _CHUNKER.match(chunker):
        raise ValueError(f"not a chunker: {chunker}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = in_flight(lambda data: add(rpc, bytes(data), hasher, chunker, pin, **more), frame["data"], concurrency)
            yield pd.DataFrame({"cid": frame["cid"], "remote_id": list(found)})

    return objects.select("cid", "data").mapInPandas(run, "cid string, remote_id string")


def load_remote(requests: DataFrame, gateway: str = GATEWAY, concurrency: int = 32, **more) -> DataFrame:
    """(cid, data) for a table of ids of any size; columns offset, length and suffix, where there are any, ask for parts."""
    parts = [c for c in ("offset", "length", "suffix") if c in requests.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            call = lambda r: fetch(gateway, r["cid"], **{p: int(r[p]) for p in parts if pd.notna(r[p])}, **more)
            yield pd.DataFrame({"cid": frame["cid"], "data": list(in_flight(call, frame.to_dict("records"), concurrency))})

    return requests.select("cid", *parts).mapInPandas(run, SCHEMA)
