"""Offline page server for the paged-API source tests.

The endpoint URL names a JSON file: ``fake:///path/pages.json?...``. The
file maps a cursor (``""`` for the first page) or ``page=N`` to a response
body, plus optional ``fail_first`` (5xx answers before success) and
``status`` (a fixed error status).
"""

import json
import os
import urllib.parse

CALLS = {}


def fetch(url, method, headers, body, timeout_s):
    parsed = urllib.parse.urlparse(url)
    path = parsed.path
    q = dict(urllib.parse.parse_qsl(parsed.query))
    with open(path, encoding="utf-8") as fh:
        spec = json.load(fh)
    CALLS[path] = CALLS.get(path, 0) + 1
    log = spec.get("log")
    if log:
        with open(log, "a", encoding="utf-8") as fh:
            fh.write(json.dumps({"q": q, "auth": headers.get("Authorization")}) + "\n")
    if "status" in spec:
        return spec["status"], "{}"
    if CALLS[path] <= spec.get("fail_first", 0):
        return 503, "{}"
    key = q.get("cursor", "") if "page" not in q else f"page={q['page']}"
    page = spec["pages"].get(key)
    if page is None:
        return 200, json.dumps({"items": [], "customers": []})
    return 200, json.dumps(page)


def calls(path):
    return CALLS.get(path, 0)


def log_lines(path):
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as fh:
        return [json.loads(x) for x in fh]
