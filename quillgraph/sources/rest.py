"""REST wikis and issue trackers as a Python data source: one partition a space or project.

Executors page through the service themselves; requests are retried with full-jitter
backoff and honour numeric ``Retry-After`` headers.  Credentials are options of the read
and appear in no row.
"""

from __future__ import annotations

import base64
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = {429, 502, 503, 504}
ISSUE_FIELDS = "summary,description,updated,labels,project,issuetype,status,priority,reporter,assignee,parent,subtasks,issuelinks,comment"


@dataclass(frozen=True)
class Auth:
    user: str = ""
    token: str = ""

    def headers(self) -> dict[str, str]:
        """Basic with a user, Bearer without, none without a token."""
        if not self.token:
            return {}
        if self.user:
            return {"Authorization": "Basic " + base64.b64encode(f"{self.user}:{self.token}".encode()).decode()}
        return {"Authorization": f"Bearer {self.token}"}


class Http:
    def __init__(self, auth: Auth, rate: float = 10, retries: int = 3, base: float = 0.5, cap: float = 30, sleep=time.sleep):
        self.auth, self.gap, self.retries, self.base, self.cap, self.sleep = auth, 1 / rate if rate else 0, retries, base, cap, sleep
        self.last = 0.0

    def request(self, url: str, body: dict | None = None) -> dict:
        for n in range(self.retries + 1):
            if (wait := self.last + self.gap - time.monotonic()) > 0:
                self.sleep(wait)
            self.last = time.monotonic()
            asked = urllib.request.Request(url, json.dumps(body).encode() if body is not None else None, {"Accept": "application/json", "Content-Type": "application/json", **self.auth.headers()})
            pause = random.uniform(0, min(self.cap, self.base * 2**n))
            try:
                with urllib.request.urlopen(asked, timeout=60) as got:
                    return json.loads(got.read())
            except urllib.error.HTTPError as e:
                after = e.headers.get("Retry-After", "")
                if e.code not in RETRIED or n == self.retries:
                    raise
                pause = float(after) if after.replace(".", "", 1).isdigit() else pause
            except (urllib.error.URLError, TimeoutError):
                if n == self.retries:
                    raise
            self.sleep(pause)
        raise RuntimeError("unreachable")


def paginate(http: Http, base: str, path: str) -> Iterator[dict]:
    """Results of all pages; each next link carries its own query."""
    url: str | None = base + path
    while url:
        page = http.request(url)
        yield from page.get("results") or []
        nxt = (page.get("_links") or {}).get("next")
        url = urllib.parse.urljoin(base + "/", nxt) if nxt else None


EPOCH = "1970-01-01T00:00:00+00:00"


def cloud_pages(http: Http, base: str, space: str) -> Iterator[tuple]:
    found = http.request(f"{base}/wiki/api/v2/spaces?{urllib.parse.urlencode({'keys': space})}").get("results") or []
    if not found:
        raise LookupError(f"no space {space}")
    for p in paginate(http, base, f"/wiki/api/v2/spaces/{found[0]['id']}/pages?body-format=storage&limit=250"):
        version = p.get("version") or {}
        labels = [x.get("name") for x in (p.get("labels") or {}).get("results") or []]
        yield str(p["id"]), space, p.get("title"), version.get("number"), version.get("createdAt") or EPOCH, labels, p.get("parentId"), ((p.get("body") or {}).get("storage") or {}).get("value") or ""


def server_pages(http: Http, base: str, space: str) -> Iterator[tuple]:
    for p in paginate(http, base, f"/rest/api/space/{space}/content/page?expand=body.storage,version,ancestors,metadata.labels&start=0&limit=100"):
        version = p.get("version") or {}
        labels = [x.get("name") for x in ((p.get("metadata") or {}).get("labels") or {}).get("results") or []]
        above = [a["id"] for a in p.get("ancestors") or [] if a.get("id") is not None]
        yield str(p["id"]), space, p.get("title"), version.get("number"), version.get("when") or EPOCH, labels, str(above[-1]) if above else None, ((p.get("body") or {}).get("storage") or {}).get("value") or ""


def cloud_issues(http: Http, base: str, project: str) -> Iterator[tuple]:
    token = None
    while True:
        body = {"jql": f'project = "{project}"', "fields": ISSUE_FIELDS.split(","), "maxResults": 100} | ({"nextPageToken": token} if token else {})
        page = http.request(f"{base}/rest/api/3/search/jql", body)
        for issue in page.get("issues") or []:
            yield project, json.dumps(_flat(issue)), "adf"
        token = page.get("nextPageToken")
        if page.get("isLast", True) or not token:
            return


def server_issues(http: Http, base: str, project: str) -> Iterator[tuple]:
    at = 0
    while True:
        query = urllib.parse.urlencode({"jql": f'project = "{project}"', "fields": ISSUE_FIELDS, "startAt": at, "maxResults": 100})
        page = http.request(f"{base}/rest/api/2/search?{query}")
        issues = page.get("issues") or []
        for issue in issues:
            yield project, json.dumps(issue), "wiki"
        at += len(issues)
        if not issues or at >= page.get("total", 0):
            return


def _flat(issue: dict) -> dict:
    """Rich-text bodies as JSON text."""
    fields = dict(issue.get("fields") or {})
    if isinstance(fields.get("description"), dict):
        fields["description"] = json.dumps(fields["description"])
    comments = (fields.get("comment") or {}).get("comments") or []
    fields["comment"] = {"comments": [c | {"body": json.dumps(c["body"]) if isinstance(c.get("body"), dict) else c.get("body")} for c in comments]}
    return issue | {"fields": fields}


READERS = {("pages", "cloud"): cloud_pages, ("pages", "server"): server_pages, ("issues", "cloud"): cloud_issues, ("issues", "server"): server_issues}
SCHEMAS = {"pages": "id string, space string, title string, version long, updated_at string, labels array<string>, parent string, body string", "issues": "project string, json string, format string"}


@dataclass
class Scope(InputPartition):
    name: str


class RestReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[Scope]:
        return [Scope(x.strip()) for x in self.options["scopes"].split(",") if x.strip()]

    def read(self, partition: Scope) -> Iterator[tuple]:
        o = self.options
        http = Http(Auth(o.get("user", ""), o.get("token", "")), float(o.get("rate_limit", 10)), int(o.get("max_retries", 3)))
        yield from READERS[o.get("kind", "pages"), o.get("tier", "cloud")](http, o["url"].rstrip("/"), partition.name)


class RestSource(DataSource):
    """Options: kind (pages, issues), tier (cloud, server), url, scopes, user, token, rate_limit, max_retries."""

    @classmethod
    def name(cls) -> str:
        return "rest_corpus"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "pages")]

    def reader(self, schema) -> RestReader:
        return RestReader(self.options)
