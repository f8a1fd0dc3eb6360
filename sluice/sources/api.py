"""Paged HTTP API as a Spark Python Data Source (``format("sluice_api")``).

Every endpoint (``location`` may list several, separated by ``|``) is one
input partition, so many endpoints or shards are fetched in parallel by
executors; pages of one endpoint are fetched in sequence because a cursor
is only known after the previous page. Each output row is one element of
the response array (JSON text), its row number within the endpoint, the
endpoint and the page. Parse the JSON with ``from_json`` afterwards.

Pagination NONE / CURSOR / OFFSET, page size, filter parameter, GET or POST
body, BEARER / BASIC / API_KEY / NONE auth, timeout and a retry with
backoff on 5xx only follow the reference. The HTTP call is pluggable
(``fetcher`` = ``module:function``) so tests serve pages without a network.
"""

from __future__ import annotations

import base64
import importlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

OUTPUT_SCHEMA = "record string, row_number long, endpoint string, page long"


class Options(dict):
    """Case-insensitive option lookup (data source options are lower-cased)."""

    def __init__(self, data):
        super().__init__({str(k).lower(): v for k, v in dict(data).items()})

    def get(self, key, default=None):
        return super().get(str(key).lower(), default)

    def __getitem__(self, key):
        return super().__getitem__(str(key).lower())

    def __contains__(self, key):
        return super().__contains__(str(key).lower())


class ApiError(RuntimeError):
    def __init__(self, status: int, url: str):
        super().__init__(f"API extraction failed with HTTP status {status} for {url}")
        self.status = status


def http_fetch(url: str, method: str, headers: dict, body: str | None, timeout_s: float) -> tuple[int, str]:
    data = body.encode("utf-8") if body is not None else None
    req = urllib.request.Request(url, data=data, method=method, headers=headers)
    try:
        with urllib.request.urlopen(req, timeout=timeout_s) as resp:  # noqa: S310 - configured endpoint
            return resp.status, resp.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def _resolve(spec: str | None):
    if not spec:
        return http_fetch
    mod, fn = spec.split(":", 1)
    return getattr(importlib.import_module(mod), fn)


def _secret(opts: dict, key: str) -> str | None:
    if opts.get(key):
        return opts[key]
    env = opts.get(key + "Env")
    return os.environ.get(env) if env else None


def auth_headers(opts: dict) -> dict:
    opts = Options(opts)
    kind = (opts.get("authType") or "NONE").upper()
    if kind == "BEARER":
        tok = _secret(opts, "authToken")
        if not tok:
            raise ValueError("authType=BEARER requires authToken or authTokenEnv")
        return {"Authorization": f"Bearer {tok}"}
    if kind == "BASIC":
        user = _secret(opts, "authUsername") or _secret(opts, "username")
        pw = _secret(opts, "authPassword") or _secret(opts, "password")
        if not user or pw is None:
            raise ValueError("authType=BASIC requires authUsername and authPassword")
        return {"Authorization": "Basic " + base64.b64encode(f"{user}:{pw}".encode()).decode()}
    if kind == "API_KEY":
        name = opts.get("apiKeyHeader")
        val = _secret(opts, "apiKeyValue")
        if not name or not val:
            raise ValueError("authType=API_KEY requires apiKeyHeader and apiKeyValue or apiKeyValueEnv")
        return {name: val}
    if kind != "NONE":
        raise ValueError(f"Unsupported authType: {kind}")
    return {}


def dotted(node, path: str):
    for part in path.split("."):
        if not isinstance(node, dict):
            return None
        node = node.get(part)
    return node


def fetch_page(opts: dict, endpoint: str, extra: dict, fetch=None) -> dict:
    opts = Options(opts)
    fetch = fetch or _resolve(opts.get("fetcher"))
    params = {opts.get("pageSizeParam", "size"): opts.get("pageSize", "200")}
    if opts.get("filterParam") and opts.get("filterValue") is not None:
        params[opts["filterParam"]] = opts["filterValue"]
    params.update(extra)
    url = endpoint + ("&" if "?" in endpoint else "?") + urllib.parse.urlencode(params)
    method = (opts.get("method") or "GET").upper()
    headers = {"Accept": "application/json", **auth_headers(opts)}
    body = opts.get("requestBody") if method == "POST" else None
    if body is not None:
        headers["Content-Type"] = "application/json"
    retries = int(opts.get("maxRetries", "2"))
    timeout_s = int(opts.get("timeoutMs", "30000")) / 1000.0
    attempt = 0
    while True:
        status, text = fetch(url, method, headers, body, timeout_s)
        if 200 <= status < 300:
            return json.loads(text)
        if status >= 500 and attempt < retries:
            time.sleep(0.2 * (2 ** attempt))
            attempt += 1
            continue
        raise ApiError(status, url)


def pages(opts: dict, endpoint: str, fetch=None):
    """Yield (page_no, items) for one endpoint following its pagination."""
    opts = Options(opts)
    path = opts["responseArrayPath"]
    kind = (opts.get("paginationType") or "NONE").upper()

    def items_of(root):
        arr = dotted(root, path)
        if not isinstance(arr, list):
            raise ValueError(f"Response path '{path}' is not an array")
        return arr

    if kind == "CURSOR":
        cursor, page = None, 0
        while True:
            extra = {opts.get("cursorParam", "cursor"): cursor} if cursor else {}
            root = fetch_page(opts, endpoint, extra, fetch)
            yield page, items_of(root)
            nxt = dotted(root, opts.get("cursorField", "meta.next_cursor"))
            cursor = None if nxt is None else str(nxt)
            page += 1
            if not cursor or not cursor.strip():
                return
    elif kind == "OFFSET":
        page = int(opts.get("pageStart", "0"))
        while True:
            arr = items_of(fetch_page(opts, endpoint, {opts.get("pageParam", "page"): str(page)}, fetch))
            if not arr:
                return
            yield page, arr
            page += 1
    else:
        yield 0, items_of(fetch_page(opts, endpoint, {}, fetch))


class _Endpoint(InputPartition):
    def __init__(self, endpoint: str, page: int | None = None, onwards: bool = False):
        self.endpoint = endpoint
        self.page = page
        self.onwards = onwards


class PagedApiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = Options(options)

    def partitions(self):
        endpoints = [e.strip() for e in self.options["location"].split("|") if e.strip()]
        kind = (self.options.get("paginationType") or "NONE").upper()
        expected = self.options.get("expectedPages") or self.options.get("maxPages")
        if kind == "OFFSET" and expected:
            # a page each for the pages expected; the last task reads on to the first empty page
            start = int(self.options.get("pageStart", "0"))
            end = start + max(1, int(expected))
            return [_Endpoint(e, p, p == end - 1) for e in endpoints for p in range(start, end)]
        return [_Endpoint(e) for e in endpoints]

    def read(self, partition):
        if partition.page is not None:
            # rows numbered as if pages were read in order (full pages of pageSize)
            size = int(self.options.get("pageSize", "200"))
            start = int(self.options.get("pageStart", "0"))
            opts = self.options
            page = partition.page
            while True:
                root = fetch_page(opts, partition.endpoint, {opts.get("pageParam", "page"): str(page)})
                arr = dotted(root, opts["responseArrayPath"])
                if not isinstance(arr, list):
                    raise ValueError(f"Response path '{opts['responseArrayPath']}' is not an array")
                for i, item in enumerate(arr):
                    yield (json.dumps(item), (page - start) * size + i + 1, partition.endpoint, page)
                if not (arr and partition.onwards):
                    return
                page += 1
        row = 1
        for page_no, items in pages(self.options, partition.endpoint):
            for item in items:
                yield (json.dumps(item), row, partition.endpoint, page_no)
                row += 1


class PagedApiSource(DataSource):
    @classmethod
    def name(cls):
        return "sluice_api"

    def schema(self):
        return OUTPUT_SCHEMA

    def reader(self, schema):
        return PagedApiReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(PagedApiSource)


def read_api(spark, location: str, props: dict, item_schema: str | None = None):
    """Records of a paged API as a DataFrame with ``_row`` and ``_source``;
    fields parsed with ``item_schema`` (DDL) or kept as JSON text."""
    from pyspark.sql import functions as F

    register(spark)
    df = spark.read.format("sluice_api").options(**{**props, "location": location}).load()
    out = df.select(F.col("record"), F.col("row_number").alias("_row"), F.col("endpoint").alias("_source"))
    if item_schema:
        out = out.select(F.from_json("record", item_schema).alias("_r"), "_row", "_source").select("_r.*", "_row", "_source")
    return out
