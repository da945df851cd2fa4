import datetime as dt

from pyspark.sql import functions as F

from pressloom.functions import scoring, text, urls
from pressloom.functions.html import Page, looks_paywalled, read_html

LX = scoring.Lexicon()
NOW = dt.datetime(2026, 3, 5)


def one(spark, column, **values):
    kinds = {str: "string", int: "long", dt.datetime: "timestamp", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_urls(spark):
    n = lambda u: one(spark, urls.normalize_url(F.col("u")), u=u)
    assert n("https://WWW.Example.com/story/?utm_source=nl&id=7&fbclid=xyz") == "https://example.com/story?id=7"
    assert (n(None), n(""), n("/just/a/path")) == ("", "", "/just/a/path")
    assert n("http://a.example:80/x//#top") == "https://a.example/x"
    assert n("https://a.example?y&b=a%20b+c~*") == "https://a.example/?y=&b=a+b+c~%2A"
    assert n(" https://a.example:443/p?q=%zz ") == n("https://a.example/p?q=%zz")
    keys = {one(spark, urls.item_key(F.col("u"), F.lit("rss"), F.lit("t")), u=u) for u in ("https://www.a.example/s/", "http://a.example/s?utm_medium=x")}
    assert len(keys) == 1 and len(keys.pop()) == 16
    assert [one(spark, urls.within_domain(F.col("h"), F.lit("nytimes.com")), h=h) for h in ("nytimes.com", "www.nytimes.com", "github.com", "notnytimes.com")] == [True, True, False, False]


def test_text(spark):
    words = "word " * 200
    cut = one(spark, text.excerpt(F.col("b"), 50), b=words)
    assert cut.startswith("word word") and cut.endswith("[…truncated from 1000 chars]") and len(cut) < 100
    assert one(spark, text.excerpt(F.col("b"), 0), b=words) == words
    s = lambda t: one(spark, text.first_sentence(F.col("t")), t=t)
    assert s("One thing. Two thing.") == "One thing." and s("") == "" and s(None) == "" and s(words).endswith("…")
    assert one(spark, text.age_days(F.col("p"), F.lit("2026-01-03 12:00:00").cast("timestamp")), p=dt.datetime(2026, 1, 1, 12)) == 2
    assert one(spark, text.week_label(F.col("p")), p=dt.datetime(2026, 3, 3)) == "2026-W10"
    assert one(spark, text.collapse(F.col("t")), t="  a \t b\n\n\n\nc\n d ") == "a b\n\nc\nd"
    assert sorted(one(spark, text.title_tokens(F.col("t")), t="The new GPT-6 model is how big? Big!")) == ["big", "gpt", "model"]
    assert one(spark, text.no_space(F.col("t")), t=" ab cd\xa0ef\n") == "abcdef"
    assert one(spark, text.clean_folder(F.col("t")), t=" A\xa0B ") == "A B"
    assert one(spark, text.plural(F.col("n"), "story", "stories"), n=1) == "1 story"
    assert one(spark, text.date_span(F.to_date(F.lit("2026-02-25")), F.to_date(F.lit("2026-03-03")))
               , n=1) == "Feb 25 – Mar 03, 2026"


def test_scores(spark):
    rel = lambda t, s="", src="Wire", k="rss": one(spark, scoring.related(F.col("t"), F.lit(s), F.lit(src), F.lit(k), LX), t=t)
    assert not rel("Retailer says AI helped holiday sales")
    assert rel("Nvidia chips power new data center")
    assert rel("Chip supply tightens", src="TechCrunch AI") and rel("Anything", k="arxiv")
    assert not rel("GPT-6-like rumours") and one(spark, scoring.distinct_terms(F.col("t"), LX.strong), t="large language model, language model, LLM") == 3
    imp = lambda t, p, also: one(
        spark, scoring.importance(F.col("t"), F.lit("A large language model from OpenAI"), F.lit(p), F.lit(also), F.lit("2026-03-03").cast("timestamp"), F.lit(NOW), LX), t=t
    )
    assert imp("OpenAI launches GPT", 900, 2) == 5 and imp("Best of the week", 0, 0) == 2
    top = lambda t, k="rss": one(spark, scoring.topic(F.col("t"), F.lit(k), LX), t=t)
    assert [top("A new lawsuit"), top("Startup hires"), top("quiet day"), top("x", "arxiv")] == ["policy-and-regulation", "business-and-funding", "other", "research"]


HTML = """<html><head><title>Site</title><meta property="og:title" content="Real title"></head><body><nav>Menu</nav><script>x()</script>
<article><p>The first paragraph of the article is long enough to be kept here.</p><p>Subscribe to our newsletter today, it is free and good
<p>A third paragraph without closing tags, which is also long enough to stay.</article><footer>end</footer>
<a href="https://a.example/1">1</a><a href="/rel">r</a><a href="https://a.example/1">again</a><a href="http://b.example/2">2</a></body></html>"""


def test_html(spark):
    got = one(spark, read_html("h"), h=HTML)
    assert got.title == "Real title" and got.links == ["https://a.example/1", "http://b.example/2"]
    assert "first paragraph" in got.article and "third paragraph" in got.article and "Subscribe" not in got.article
    assert "Menu" not in got.text and "x()" not in got.text
    assert one(spark, read_html("h"), h=None).text == ""
    assert Page("<p>unclosed <b>text").article() == "" and Page("just words").text == ["just words"]
    stub = "Short. " * 200 + "Already a subscriber? Log in"
    assert [one(spark, looks_paywalled(F.col("t")), t=t) for t in ("", "short", stub, "word " * 400)] == [True, True, True, False]
