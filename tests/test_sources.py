import json
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from pressloom.sources import policy
from pressloom.sources.readers import SourceConfig, available_types, collect, read_message, register

since = lambda: F.lit("2026-01-01").cast("timestamp")
RSS = """<?xml version="1.0"?><rss><channel><title>feed</title>
<item><title>New chips</title><link>https://a.example/1</link><pubDate>Tue, 03 Mar 2026 10:00:00 +0100</pubDate><description>&lt;p&gt;A &lt;b&gt;teaser&lt;/b&gt;&lt;/p&gt;</description></item>
<item><title>Old</title><link>https://a.example/2</link><pubDate>Tue, 04 Mar 2025 10:00:00 GMT</pubDate></item>
<item><title>Undated</title><link>https://a.example/3</link></item><item><description>neither</description></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title> A  paper </title><id>http://arxiv.example/1</id><published>2026-02-01T00:00:00Z</published>
<summary>We study models.</summary><author><name>A</name></author><author><name>B</name></author><category term="cs.LG"/><link href="https://arxiv.example/1" rel="alternate"/></entry>
<entry><title>Other</title><id>http://arxiv.example/2</id><published>2026-02-02T00:00:00Z</published><summary>Plain.</summary><author><name>C</name></author></entry></feed>"""


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


@pytest.fixture
def payloads(tmp_path):
    hit = lambda i, p, **k: {"objectID": i, "title": f"t{i}", "points": p, "num_comments": 3, "created_at_i": 1770000000, "url": "https://h.example/" + i} | k
    post = lambda t, s, **k: {"data": {"title": t, "score": s, "permalink": "/r/x/" + t, "num_comments": 2, "created_utc": 1770000000.0, "subreddit": "x"} | k}
    mail = EmailMessage()
    mail["From"], mail["Subject"], mail["Date"] = "Letter <l@n.example>", "Issue é 1", "Tue, 03 Mar 2026 10:00:00 +0000"
    mail.set_content("plain text")
    mail.add_alternative('<p>Hello <a href="https://n.example/a">link</a></p>', subtype="html")
    mail.add_attachment(b"secret", maintype="text", subtype="plain", filename="x.txt")
    box = tmp_path / "mail"
    box.mkdir()
    (box / "1.eml").write_bytes(bytes(mail))
    blank = EmailMessage()
    blank["From"] = "l@n.example"
    blank.set_content("  ")
    (box / "2.eml").write_bytes(bytes(blank))
    return {
        "rss": put(tmp_path / "rss", "f.xml", RSS),
        "atom": put(tmp_path / "atom", "f.xml", ATOM),
        "hackernews": put(tmp_path / "hn", "r.json", json.dumps({"query_no": 0, "hits": [hit("1", 100), hit("2", 900, url=None), hit("1", 500), hit("3", 10), hit("", 999)]})),
        "reddit": put(tmp_path / "rd", "r.json", json.dumps({"data": {"children": [post("a", 60), post("b", 10), post("c", 90)]}})),
        "imap": str(box),
        "websearch": put(tmp_path / "ws", "r.json", json.dumps({"query_no": 0, "results": [
            {"url": "https://a.example/1", "title": "one", "page_age": "March 3, 2026"}, {"url": "https://a.example/1", "title": "again", "page_age": None},
            {"url": "https://sub.b.example/2", "title": "two", "page_age": "2 days ago"}, {"url": "", "title": "none"}]})),
    }


def rows(spark, cfg):
    df, errors = collect(spark, [cfg], since())
    assert not errors
    return df.orderBy("ord").collect()


def test_feeds(spark, payloads):
    got = rows(spark, SourceConfig("A", "rss", options={"path": payloads["rss"]}))
    assert [r.title for r in got] == ["New chips", "Undated"] and got[0].summary == "A\nteaser" and got[0].published.hour == 9
    assert [r.title for r in rows(spark, SourceConfig("A", "rss", options={"path": payloads["rss"], "include": ["CHIP"]}))] == ["New chips"]
    got = rows(spark, SourceConfig("A", "rss", options={"path": payloads["atom"]}))
    assert got[0].url == "https://arxiv.example/1" and got[0].author == "A, B"
    got = rows(spark, SourceConfig("P", "paywalled", options={"path": payloads["rss"], "domain": "a.example"}))
    assert (got[0].subscription, got[0].authenticated, got[0].source_type) == ("a.example", False, "paywalled")
    got = rows(spark, SourceConfig("X", "arxiv", options={"path": payloads["atom"], "keywords": ["MODEL"]}))
    assert len(got) == 1 and got[0].author == "A, B" and got[0].categories == ["cs.LG"] and got[0].title == "A paper"


def test_listings(spark, payloads):
    got = rows(spark, SourceConfig("HN", "hackernews", options={"path": payloads["hackernews"]}))
    assert [(r.title, r.points) for r in got] == [("t2", 900), ("t1", 100)] and got[0].url.endswith("id=2") and "900 points" in got[0].summary
    got = rows(spark, SourceConfig("R", "reddit", options={"path": payloads["reddit"]}))
    assert [(r.source, r.title) for r in got] == [("R: r/x", "c"), ("R: r/x", "a")]
    got = rows(spark, SourceConfig("R", "reddit", max_items=1, options={"path": payloads["reddit"]}))
    assert [r.title for r in got] == ["a"]
    got = rows(spark, SourceConfig("W", "websearch", options={"path": payloads["websearch"]}))
    assert [(r.title, r.published is None) for r in got] == [("one", False), ("two", True)]
    got = rows(spark, SourceConfig("W", "websearch", options={"path": payloads["websearch"], "allowed_domains": ["b.example"]}))
    assert [r.title for r in got] == ["two"]


def test_mail(spark, payloads):
    got = rows(spark, SourceConfig("L", "imap", options={"path": payloads["imap"]}))
    assert len(got) == 1 and got[0].title == "Issue é 1" and got[0].url == "https://n.example/a" and "secret" not in got[0].text
    assert rows(spark, SourceConfig("L", "imap", options={"path": payloads["imap"], "senders": ["other"]})) == []
    assert read_message(b"no headers at all")[0] == ""


def test_collect_isolates_failures(spark, payloads):
    @register("broken")
    def broken(spark, cfg, since):
        raise RuntimeError("no")

    sources = [
        SourceConfig("A", "rss", options={"path": payloads["rss"]}), SourceConfig("B", "broken", options={"path": "x"}), SourceConfig("C", "nonsense", options={"path": "x"}),
        SourceConfig("D", "rss"), SourceConfig("E", "rss", enabled=False), SourceConfig("F", "hackernews", options={"path": payloads["hackernews"]}),
    ]
    df, errors = collect(spark, sources, since())
    assert set(errors) == {"B", "C", "D"} and "rss" in errors["C"] and "path" in errors["D"]
    assert [r.source for r in df.orderBy("ord").collect()] == ["A", "A", "F", "F"]
    assert "rss" in available_types() and collect(spark, [], since())[0].count() == 0


def test_policy(tmp_path):
    env = {"A": "1", "EMPTY": ""}
    assert policy.expand({"x": ["${A}", "${B:-two}", "${EMPTY:-d}", "${B}", 3]}, env) == {"x": ["1", "two", "d", "", 3]}
    (tmp_path / ".env").write_text("# c\nA=2\nK = 'v'\nbad\n")
    assert policy.read_env_file(tmp_path / ".env", dict(env)) == {"A": "1", "EMPTY": "", "K": "v"}
    cfg, unknown = policy.build(SourceConfig, {"name": "n", "type": "rss", "enabled": "yes", "max_items": None, "odd": 1})
    assert cfg.enabled is True and cfg.max_items is None and unknown == ["odd"]
    r = policy.Robots(lambda u: (200, "User-agent: *\nDisallow: /private") if "a.example" in u else (500, ""), "bot")
    assert [r.allows(u) for u in ("https://a.example/x", "https://a.example/private/x", "https://b.example/private", "https://export.arxiv.org/api/query")] == [True, False, True, True]
    now, slept = [0.0], []
    t = policy.Throttle(20, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for u in ("https://a.example/1", "https://a.example/2", "https://b.example/1"):
        t.wait(u)
    assert slept == [3.0]
    jar = "a.example\tTRUE\t/\tTRUE\t0\tsid\t1\n.b.example\tTRUE\t/\tTRUE\t0\tx\t2\n#HttpOnly_a.example\tTRUE\t/\tTRUE\t0\th\t3"
    assert policy.cookies_for("https://www.a.example/p", jar, ["a.example"]) == {"sid": "1", "h": "3"} and policy.cookies_for("https://nota.example/", jar, ["a.example"]) == {}
    answers = [(503, {"Retry-After": "90"}, ""), (429, {}, ""), (200, {"Content-Type": "text/html"}, "ok")]
    waits = []
    assert policy.fetch("https://a.example", lambda u: answers.pop(0), 3, waits.append) == "ok" and waits == [60, 4]
    assert policy.fetch("u", lambda u: (404, {}, "x")) is None and policy.fetch("u", lambda u: (200, {"Content-Type": "image/png"}, "x")) == ""


def test_search_stops_and_mail_is_capped_before_the_filters(spark, tmp_path):
    hits = lambda ids: [{"objectID": i, "title": "t", "url": "https://x.example/" + i, "points": int(i), "num_comments": 1, "created_at_i": 1780000000} for i in ids]
    put(tmp_path / "hn2", "a.json", json.dumps({"query_no": 0, "hits": hits(["100", "101"])}))
    put(tmp_path / "hn2", "b.json", json.dumps({"query_no": 1, "hits": hits(["900", "100"])}))
    at = lambda n: {r.points for r in rows(spark, SourceConfig("HN", "hackernews", max_items=n, options={"path": str(tmp_path / "hn2")}))}
    assert at(2) == {100, 101} and at(3) == {900, 101, 100}
    for k in range(5):
        put(tmp_path / "box2", f"{k}.eml", f"Subject: s{k}\nFrom: {'wanted' if k < 2 else 'other'}@x.example\nDate: Mon, 1 Jun 2026 00:00:00 +0000\n\nbody\n")
    box = lambda n: [r.title for r in rows(spark, SourceConfig("L", "imap", max_items=n, options={"path": str(tmp_path / "box2"), "senders": ["wanted"]}))]
    assert box(1) == [] and box(2) == ["s1", "s0"]
