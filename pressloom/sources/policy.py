"""Configuration and fetching policy, driver-side: environment expansion, robots, gaps, cookie scopes, retries."""

from __future__ import annotations

import os
import re
import threading
import time
import urllib.robotparser
from collections.abc import Callable, Mapping
from dataclasses import fields
from pathlib import Path
from typing import Any

# Prefixes of public APIs that robots rules do not cover, with the least seconds between requests.
API_GAPS = [
    ("http://export.arxiv.org/api/", 3.0),
    ("https://export.arxiv.org/api/", 3.0),
    ("https://oauth.reddit.com/", 1.0),
    ("https://www.reddit.com/api/v1/access_token", 1.0),
    ("http://hn.algolia.com/api/", 0.0),
    ("https://hn.algolia.com/api/", 0.0),
]
RETRY = {408, 429}
VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def read_env_file(path: str | Path, env: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines into ``env`` (default: the process's); what is set already stays."""
    env = os.environ if env is None else env
    p = Path(path)
    for row in p.read_text(encoding="utf-8").splitlines() if p.is_file() else []:
        found = re.match(r"\s*([^#=\s][^=]*?)\s*=\s*(.*?)\s*$", row)
        if found and found[1] not in env:
            env[found[1]] = found[2].strip('"').strip("'")
    return dict(env)


def expand(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """${NAME} and ${NAME:-default} in every string of a nested value; an empty variable counts as unset."""
    env = os.environ if env is None else env
    if isinstance(value, Mapping):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [expand(v, env) for v in value]
    return VARIABLE.sub(lambda m: env.get(m[1]) or m[2] or "", value) if isinstance(value, str) else value


def build(kind: type, given: Mapping[str, Any]) -> tuple[Any, list[str]]:
    """A dataclass from a mapping: unknown names are returned, None is left out, whole numbers and switches are coerced."""
    known = {f.name: f for f in fields(kind)}
    args = {}
    for k, v in given.items():
        if k not in known or v is None:
            continue
        want = str(known[k].type)
        if want.startswith("int") and not isinstance(v, bool):
            v = int(v)
        elif want.startswith("bool") and isinstance(v, str):
            v = v.strip().lower() in ("1", "true", "yes", "on")
        args[k] = v
    return kind(**args), [k for k in given if k not in known]


def api_gap(url: str) -> float | None:
    return next((gap for prefix, gap in API_GAPS if url.startswith(prefix)), None)


class Robots:
    """Verdicts by host; a host whose rules cannot be had allows all."""

    def __init__(self, fetch: Callable[[str], tuple[int, str]], agent: str):
        self.fetch, self.agent, self.known = fetch, agent, {}

    def allows(self, url: str) -> bool:
        if api_gap(url) is not None:
            return True
        root = "/".join(url.split("/", 3)[:3])
        if root not in self.known:
            rules = urllib.robotparser.RobotFileParser()
            status, text = self.fetch(root + "/robots.txt")
            rules.parse(text.splitlines() if status == 200 else [])
            self.known[root] = rules
        return self.known[root].can_fetch(self.agent, url)


class Throttle:
    """At least a gap between two requests to a host: 60 over the rate, or the API's own if larger."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = 60 / per_minute, clock, sleep
        self.lock, self.last = threading.Lock(), {}

    def wait(self, url: str) -> float:
        host = url.split("/", 3)[2].lower()
        with self.lock:
            due = self.last.get(host, float("-inf")) + max(self.gap, api_gap(url) or 0.0)
            pause = max(0.0, due - self.clock())
            if pause:
                self.sleep(pause)
            self.last[host] = self.clock()
        return pause


def in_scope(host: str, domain: str) -> bool:
    h, d = host.lower(), domain.lower().lstrip(".")
    return h == d or h.endswith("." + d)


def cookies_for(url: str, jar: str, scopes: list[str]) -> dict[str, str]:
    """Cookies of a Netscape-format file that a request may carry: only to hosts within ``scopes``, by cookie domain."""
    host = url.split("/", 3)[2].split(":")[0]
    if not any(in_scope(host, s) for s in scopes):
        return {}
    rows = (r.split("\t") for r in jar.splitlines() if r and not (r.startswith("#") and not r.startswith("#HttpOnly_")))
    return {r[5]: r[6] for r in rows if len(r) == 7 and in_scope(host, r[0].removeprefix("#HttpOnly_"))}


def fetch(url: str, get: Callable[[str], tuple[int, Mapping[str, str], str]], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The text of a page. Busy and server errors are tried again (Retry-After up to 60 s, else 2, 4, 8 ... 15 s); other errors give None;
    what is no text gives ''."""
    for n in range(1, attempts + 1):
        status, headers, text = get(url)
        if status in RETRY or status >= 500:
            if n < attempts:
                told = headers.get("Retry-After", "")
                sleep(min(60, int(told)) if told.isdigit() else min(2**n, 15))
            continue
        if status >= 400:
            return None
        kind = headers.get("Content-Type", "text/html")
        return text if any(t in kind for t in ("text", "xml", "json", "html")) else ""
    return None
