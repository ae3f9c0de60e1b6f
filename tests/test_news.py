import json

import duckdb
import pytest
from pyspark.sql import functions as F

from presswire import queries, service
from presswire.errors import NUMERIC_TITLE, SINGLE_CATEGORY, BadRequest, NoCategory, UnknownCategories
from presswire.functions import readability
from presswire.functions.readability import extract
from presswire.functions.summary import MOST_WORDS, ChatClient, extractive, parse_answer, parse_answers, rules, summarize
from presswire.functions.text import pub_date, trim, url_key
from presswire.operators import match
from presswire.operators.request import NewsRequest, parse_json, parse_requests, response
from presswire.plans.news import get_news
from presswire.settings import Settings
from presswire.sources import catalogue, http, rss

WORLD, PRESS, SPORT = (catalogue.FEEDS["en"][c] for c in ("world", "press", "sport"))


def test_catalogue(spark):
    links = lambda c: catalogue.category_links(spark, c)
    assert links(["world"]) == WORLD == links(["technology", "World"])
    assert links(["world", "press", "sport"]) == WORLD + PRESS + SPORT and len(WORLD + PRESS + SPORT) == 8
    with pytest.raises(UnknownCategories, match="^None of theses categories were found: technology, art$"):
        links(["technology", "art"])
    with pytest.raises(NoCategory, match="^No categories selected, please select a category.$"):
        links([])


def item(title, categories="", rest=""):
    return f"<item><title>{title}</title><link>https://n.test/{title.replace(' ', '-')}</link><pubDate>Sat, 07 Feb 2026 01:01:16 +0000</pubDate>{categories}{rest}</item>"


def feed(*items):
    return '<rss xmlns:media="http://search.yahoo.com/mrss/" version="2.0"><channel>' + "".join(items) + "</channel></rss>"


FEEDS = [
    feed(item("Plain Vote", "<category>Politics</category><category>World</category>"), item("Domain vote", '<category domain="d">Politics</category><category domain="d">x</category>'), item("No category vote")),
    feed(item("Single", "<category>Sport</category>", '<media:content url="a"/><media:content url="b"/>')),
    feed(),
    "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>t</title></entry></feed>",
    "<rss><channel><item>",
    None,
]


@pytest.fixture
def items(spark):
    return rss.items(spark.createDataFrame([(f,) for f in FEEDS], "body string"))


def titles(df):
    return sorted(r.title for r in df.collect())


def test_rss(items, spark):
    got = {r.title: r for r in items.collect()}
    assert set(got) == {"Plain Vote", "Domain vote", "No category vote", "Single"}
    assert got["Single"].thumbnail == "b" and got["No category vote"].category is None
    assert "Single" not in titles(rss.items(spark.createDataFrame([(f,) for f in FEEDS], "body string"), mode="compat"))


def test_match(items):
    assert titles(match.keyword_match(items, ["VOTE"])) == ["Domain vote", "No category vote", "Plain Vote"]
    assert titles(match.keyword_match(items, ["vote"], "compat")) == ["Domain vote", "Plain Vote"]
    assert titles(match.keyword_match(items, ["politics"], "compat")) == ["Plain Vote"]
    assert titles(match.keyword_match(items, ["politics"])) == ["Domain vote", "Plain Vote"]
    assert titles(match.keyword_match(items, [" ", "vote"])) == []
    assert titles(match.keyword_match(items, ["zz", ""])) == [] and len(titles(match.keyword_match(items, ["zz", ""], "compat"))) == 3
    many = [f"w{i}" for i in range(50)] + ["sport"]
    assert titles(match.keyword_match(items, many)) == ["Single"]
    assert "LeftSemi" in match.keyword_match(items, many)._jdf.queryExecution().toString()
    assert match.gate(items, match.keyword_match(items, ["zz"])).count() == 0 and match.gate(items, match.keyword_match(items, ["sport"])).count() == 4


def test_multiplicity(spark):
    def plain(title, cats, words):
        n = 0
        for k in words:
            n += sum(k in c for c in cats)
            n = n or int(k in title)
        return n

    cases = [("a b", ["a", "ab"], ["a", "b"]), ("b", ["c"], ["c", "b"]), ("b", ["x"], ["b", "x"]), ("q", [], ["q", "q"])]
    for title, cats, words in cases:
        df = spark.createDataFrame([(title, cats)], "title string, v array<string>")
        assert df.select(match.multiplicity(F.col("title"), F.col("v"), words)).first()[0] == plain(title, cats, words)


def test_request():
    ok = NewsRequest.parse({"keywords": ["a"], "categories": ["world"]})
    assert ok.category == ["world"]
    for body in (None, {"keywords": ["a"]}, {"category": ["a"]}, {"keywords": [], "category": ["a"]}, {"keywords": "abc", "category": ["a"]}, {"keywords": [1], "category": ["a"]}, {"keywords": ["a"], "category": ["a"], "q": 1}):
        with pytest.raises(BadRequest):
            NewsRequest.parse(body)
    with pytest.raises(BadRequest):
        NewsRequest.parse({"keywords": ["a"], "categories": ["world"]}, mode="compat")


def test_text(spark):
    df = spark.createDataFrame([(" \t x y ﻿", "HTTPS://A.test/b/?utm_source=q&z=1&a=2#f", "Sat, 07 Feb 2026 01:01:16 GMT")], "a string, u string, d string")
    got = df.select(trim(F.col("a")), url_key(F.col("u")), pub_date(F.col("d")).cast("string")).first()
    assert tuple(got) == ("x y", "https://a.test/b?a=2&z=1", "2026-02-07 01:01:16")


def test_readability():
    page = '<html lang="en"><head><title>T</title></head><body><nav>menu menu</nav><script>var x="</p>";</script><article><p>' + "Long text, really. " * 20 + "<p>More <b>bold words here, and on.</article><footer>foot</footer></body></html>"
    got = extract(page)
    assert got["title"] == "T" and got["lang"] == "en" and "bold words" in got["textContent"]
    assert not any(x in got["textContent"] for x in ("menu", "foot", "var x"))
    assert extract("") is None and extract(None) is None and extract("<p></p>") is None


def test_summary():
    long = " ".join(f"Sentence number {i} speaks of apples." for i in range(200))
    assert 100 < len(extractive(long).split()) <= MOST_WORDS and extractive("short one.") == "short one."


def test_http(spark):
    calls = []

    def transport(url, timeout):
        calls.append(url)
        if "bad" in url:
            raise OSError("down")
        return f"body of {url}"

    assert http.get("bad", transport) == (None, "OSError: down") and len(calls) == 2
    good, failed = http.split_failures(http.fetch(spark.createDataFrame([("http://a.test/x#1",), ("http://a.test/x",), ("http://bad.test",)], "url string"), transport, tasks=2))
    assert good.count() == 1 and failed.count() == 1
    spark.dataSource.register(http.source(transport))
    assert spark.read.format("presswire_http").option("urls", "http://a.test\nhttp://bad.test").load().where("error is null").count() == 1


def test_get_news(spark):
    feeds = spark.createDataFrame([(WORLD[0], FEEDS[0]), (SPORT[0], FEEDS[1])], "url string, body string")
    html = "<html lang='en'><title>{}</title><body><article><p>" + "Words of a story, told at length. " * 10 + "</p></article></body></html>"
    pages = spark.createDataFrame([(f"https://n.test/{t}", html.format(t)) for t in ("Plain-Vote", "Domain-vote", "No-category-vote")], "url string, html string")
    ask = {"keywords": ["politics"], "category": ["world"]}
    assert get_news(spark, ask, feeds, pages)["totalResults"] == 2
    assert get_news(spark, ask, feeds, pages, mode="compat")["totalResults"] == 3  # a gate: all linked items
    assert get_news(spark, {**ask, "undesiredTopics": ["plain"]}, feeds, pages)["totalResults"] == 1
    assert get_news(spark, {**ask, "timeframe": {"start": "2026-03-01T00:00:00Z"}}, feeds, pages)["totalResults"] == 0
    assert get_news(spark, {"keywords": ["zz"], "category": ["world"]}, feeds, pages) == []
    assert "summary" in get_news(spark, ask, feeds, pages, summary=True)["news"][0]


def test_stream(spark, tmp_path):
    from presswire.streaming import feeds as stream

    (tmp_path / "a.xml").write_text(FEEDS[0])
    (tmp_path / "b.xml").write_text(FEEDS[0])
    q = stream.alerts(stream.read_feeds(spark, str(tmp_path)), ["vote"]).select("title").writeStream.format("memory").queryName("alerts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("alerts").count() == 3


HTML = "<html lang='en'><title>{}</title><body><article><p>" + "Words of a story, told at length. " * 10 + "</p></article></body></html>"


def test_get_news_fetches(spark):
    """Feeds and pages as a network would give them; one feed and one page are down."""

    def transport(url, timeout):
        if url == WORLD[0]:
            return FEEDS[0]
        if url.startswith("https://n.test/") and "Domain" not in url:
            return HTML.format(url)
        raise OSError("down")

    ask = {"keywords": ["vote"], "category": ["world"]}
    got = get_news(spark, ask, transport=transport)
    assert got["totalResults"] == 2 and {a["url"] for a in got["news"]} == {"https://n.test/Plain-Vote", "https://n.test/No-category-vote"}
    some = get_news(spark, ask, transport=transport, most=1)
    assert some["totalResults"] == 2 and len(some["news"]) == 1
    assert get_news(spark, ask, transport=lambda u, t: 1 / 0) == []


def test_find_articles_by_key(spark):
    """Items find pages by URL key; of equal keys the choice is defined; tags of a region count as the language."""
    items = spark.createDataFrame(
        [("vote a", None, "HTTPS://n.test/a/?utm_source=x#top"), ("vote b", "t2", "https://n.test/a"), ("vote c", "t1", "https://n.test/a"), ("vote d", "t", "https://n.test/d?b=1&a=2"), ("vote e", "t", ""), ("vote f", "t", "https://n.test/none")],
        "title string, thumbnail string, link string",
    ).selectExpr("*", "cast(null as string) as pubDate", "cast(null as array<struct<_VALUE:string,_domain:string>>) as category")
    pages = spark.createDataFrame([("https://n.test/a", HTML.format("A")), ("https://n.test/a/", HTML.format("B")), ("https://n.test/d?a=2&b=1", HTML.replace("'en'", "'EN-gb'").format("D"))], "url string, html string")
    from presswire.plans.news import find_articles

    got = lambda **k: sorted((r.url, r.title, r.thumbnail) for r in find_articles(items, pages, NewsRequest(["vote"], ["world"], **k)).collect())
    a = ("HTTPS://n.test/a/?utm_source=x#top", "A", None)
    d = ("https://n.test/d?b=1&a=2", "D", "t")
    assert got() == got(language="en") == [a, d] and got(language="fr") == []


def test_service(spark):
    feeds = spark.createDataFrame([(WORLD[0], FEEDS[0])], "url string, body string")
    pages = spark.createDataFrame([("https://n.test/Plain-Vote", HTML.format("P"))], "url string, html string")
    ask = lambda body, **k: service.handle(spark, "POST", "/api/news", body if isinstance(body, str) else json.dumps(body), feeds, pages, **k)
    status, text = ask({"keywords": ["politics"], "category": ["world"]})
    assert status == 200 and json.loads(text)["news"][0]["title"] == "P"
    assert ask({"keywords": ["zz"], "category": ["world"]}) == (200, "[]")
    for body, message in (
        ({"category": ["world"]}, "No keywords were inserted, please enter at least one."),
        ({"keywords": [], "category": ["world"]}, "No keywords were inserted, please enter at least one."),
        ({"keywords": ["a"]}, "No categories selected, please select at least one category."),
        ({"keywords": ["a"], "category": []}, "No categories selected, please select at least one category."),
        ({"keywords": ["a"], "category": ["art"]}, "None of theses categories were found: art"),
        ({"keywords": ["a"], "category": ["world"], "page": 1}, "Filter page is not authorized."),
    ):
        assert ask(body) == (400, json.dumps({"error": message}))
    assert ask("{broken")[0] == ask("")[0] == 400
    single = spark.createDataFrame([(WORLD[0], feed(item("a", '<category domain="d">x</category>'), item("b")))], "url string, body string")
    number = spark.createDataFrame([(WORLD[0], feed(item("2024", "<category>x</category>"), item("b")))], "url string, body string")
    for bad, message in ((single, SINGLE_CATEGORY), (number, NUMERIC_TITLE)):
        body = json.dumps({"keywords": ["x"], "category": ["world"]})
        assert service.handle(spark, "POST", "/api/news", body, bad, pages, "compat") == (500, json.dumps({"error": message}))
        assert service.handle(spark, "POST", "/api/news", body, bad, pages)[0] == 200
    assert service.handle(spark, "GET", "/healthcheck") == (200, '{"status": "ok"}')
    assert set(json.loads(service.handle(spark, "GET", "/docs")[1])) >= {"request", "response", "article"}
    assert service.handle(spark, "GET", "/else")[0] == 404


def test_server(spark):
    import threading
    import urllib.request

    s = service.server(spark, Settings(port=0))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{s.server_address[1]}/healthcheck", timeout=60) as r:
        assert r.status == 200 and json.load(r) == {"status": "ok"}
    s.shutdown()
    s.server_close()


def test_settings():
    s = Settings.of({"PORT": "80", "PRESSWIRE_CHAT_KEY": "secret", "PRESSWIRE_TIMEOUT": ""})
    assert s.port == 80 and s.timeout == Settings().timeout and s.chat_key == "secret" and "secret" not in repr(s)


def test_request_messages():
    for body, message in (({"keywords": ["a"], "category": ["w"], "language": 1}, "language must be a string."), ({"keywords": ["a"], "category": "w"}, "category must be an array of strings."), ({"keywords": ["a"], "category": ["w"], "timeframe": []}, None), ({"keywords": ["a"], "category": ["w"], "timeframe": "x"}, 'timeframe must be an object with "start" and "end".')):
        if message is None:
            assert NewsRequest.parse(body).start is None
        else:
            with pytest.raises(BadRequest, match=f"^{message}$"):
                NewsRequest.parse(body)
    for language in ("en", "fr", "es", "ch", "ru", "", None):
        assert NewsRequest.parse({"keywords": ["a"], "category": ["w"], "language": language}, check_language=True).language == language
    with pytest.raises(BadRequest, match="^Language de is not authorized.$"):
        NewsRequest.parse({"keywords": ["a"], "category": ["w"], "language": "de"}, check_language=True)
    with pytest.raises(BadRequest):
        parse_json("{")
    assert parse_json('{"a": 1}') == {"a": 1} and parse_json("") is parse_json(None) is None


def test_json_requests(spark):
    bodies = ['{"keywords": ["a", "b"], "timeframe": {"start": "s"}}', "{", None, "", "[]", '{"keywords": "a"}']
    got = parse_requests(spark.createDataFrame(list(enumerate(bodies)), "i int, body string")).orderBy("i").collect()
    assert got[0].request.keywords == ["a", "b"] and got[0].request.timeframe.start == "s" and got[0].request.language is None
    assert [r.request for r in got[1:4]] == [None] * 3 and got[5].request.keywords is None


def test_response(spark):
    a = spark.createDataFrame([("u",) * 9] * 5, ", ".join(f"{c} string" for c in ("url", "thumbnail", "source", "publishedAt", "title", "author", "lang", "description", "content")))
    r = response(a, most=2).first()
    assert r.totalResults == 5 and len(r.news) == 2
    r = response(a.limit(0)).first()
    assert r.totalResults == 0 and r.news == []


def test_description(items, spark):
    df = spark.createDataFrame([("t", "about a Vote", None)], "title string, description string, category array<struct<_VALUE:string,_domain:string>>")
    assert match.keyword_match(df, ["vote"]).count() == 0 and match.keyword_match(df, ["vote"], description=True).count() == 1
    assert match.keyword_match(df, ["vote"] + [f"w{i}" for i in range(40)], description=True).count() == 1
    with pytest.raises(BadRequest):
        match.keyword_match(df, ["w"] * (match.MOST_KEYWORDS + 1))


def test_language_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(x,) for x in ("en", "EN", "en-GB", "En-us", "enm", "fr", None)], "lang string").write.parquet(str(tmp_path / "l"))
    df = match.in_language(spark.read.parquet(str(tmp_path / "l")), "en")
    assert sorted(r.lang for r in df.collect()) == ["EN", "En-us", "en", "en-GB"]
    assert "StringStartsWith" in df._jdf.queryExecution().executedPlan().toString()
    assert match.in_language(df, "english").count() == 0


def test_crawl_requests(items):
    got = match.crawl_requests(items).where("url like '%Single'").first()
    assert got.url == "https://n.test/Single" and got.userData.thumbnail == "b"


def test_pages_that_cannot_be_read(spark, monkeypatch):
    pages = [("u1", HTML.format("A")), ("u2", "<p>" + "<div>" * 3000 + "deep text, long enough to be read as content" + "</div>" * 3000), ("u3", None)]
    got = {r.url for r in readability.articles(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got == {"u1", "u2"}
    monkeypatch.setattr(readability, "extract", lambda h: 1 / 0)
    assert readability._extracted("x") is None


def test_http_limits(monkeypatch):
    assert [http.workers(n) for n in (1, 2, 10, 50, 100)] == [50, 25, 5, 1, 1]

    class Slow:
        headers = type("H", (), {"get_content_charset": lambda self: None})()
        __enter__, __exit__ = lambda self: self, lambda self, *a: None
        read1 = lambda self, n: b"x"

    monkeypatch.setattr(http.urllib.request, "urlopen", lambda url, timeout: Slow())
    assert http.get("u", retries=0, timeout=0.05)[1].startswith("TimeoutError")


def test_chat(spark):
    sent = []

    def send(url, body, headers, timeout):
        sent.append((url, json.loads(body), headers, timeout))
        return json.dumps({"message": {"content": json.dumps({"summary": "Short. 01.02.2026."})}})

    client = ChatClient(Settings(chat_host="http://c.test", chat_key="k", timeout=7), send)
    assert client("some text") == "Short. 01.02.2026."
    url, body, headers, timeout = sent[0]
    assert url == "http://c.test/api/chat" and body["messages"][1]["content"] == "some text" and body["format"] == "json" and headers["Authorization"] == "Bearer k" and timeout == 7
    assert parse_answer('{"a": ["x", {"b": "y"}], "n": 1}') == "x\n\ny"
    df = spark.createDataFrame([('{"summary": "s"}',), ("no json",), (None,)], "content string")
    assert [r.summary for r in parse_answers(df).collect()] == ["s", None, None]

    def failing():
        return lambda text: 1 / 0

    assert [r.summary for r in summarize(df, make=failing).collect()] == [None] * 3


def test_summary_rules(spark):
    good = " ".join(["word"] * 199) + " 07.02.2026"
    cases = {good: (True, True, True), "too short": (False, True, True), good + "\n\nb\n\nc": (True, False, True), good + " 2026-02-07": (True, True, False), good + " 7/2/26": (True, True, False), good + " 7.2.2026": (True, True, False), " ".join(["w"] * 251): (False, True, True), "": (False, False, True)}
    df = spark.createDataFrame([(c,) for c in cases], "s string").select("s", rules(F.col("s")).alias("r"))
    assert {r.s: tuple(r.r) for r in df.collect()} == cases


def test_summary_without_marks():
    text = " ".join(["filler"] * 250 + ["apple", "pear"] * 300)
    got = extractive(text).split()
    assert 200 < len(got) <= MOST_WORDS and "apple" in got and got.count("apple") > got.count("filler")


def test_stream_counts(spark, tmp_path):
    from presswire.streaming import feeds as stream

    spark.sql("select timestamp'2026-01-01 00:10:00' as ts, 'a' as event_type union all select timestamp'2026-01-01 00:50:00', 'a' union all select timestamp'2026-01-01 01:10:00', 'b'").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = stream.counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.event_type, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def same_as_sql(spark, folder, name, **tables):
    """The rows of a query over ``tables``, which must be those of its SQL."""
    for n, t in tables.items():
        t.write.mode("overwrite").parquet(f"{folder}/{n}.parquet")
    duck = duckdb.connect()
    for n in tables:
        duck.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{folder}/{n}.parquet/*.parquet')")
    got = sorted(map(tuple, queries.QUERIES[name](spark, str(folder)).collect()), key=repr)
    assert got == sorted(duck.execute(queries.SQL[name]).fetchall(), key=repr)
    return got


def pages_table(spark, *rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_link_present_repeats(spark, tmp_path):
    """Pages that share a URL are one row each."""
    pages = pages_table(spark, (1, "https://n.test/a", ""), (2, "https://n.test/a", ""), (4, "https://n.test/a", ""), (6, "", ""), (7, None, ""), (8, "https://n.test/b", ""))
    assert [r[0] for r in same_as_sql(spark, tmp_path, "link_present", pages=pages)] == [1, 2, 4, 8]


PAGE = '<!DOCTYPE html><html lang="en"><head><title>{0}</title></head><body><nav>menu</nav><article><h1>{0}</h1><p><b>{1}</b><br><p>{2}</p></article><footer>foot</footer></body></html>'
LONG = "Words, and more words of a text that is long enough to be read as content."
#: Titles cut inside a reference, and whole references.
CUT = ["a &amp;&amp", "b &am", "c &lt", "d &copy", "e &amp;amp;", "f &quot;&lt;x&gt;&quot; &amp;lt; &copy; &middot;", "g &amp;amp", "h & &; &nosuch; &ampx;"]


def test_close_references():
    closed = readability.close_references
    assert closed("&amp;&amp &copy &#39; &#x27; &#39 &nosuch; &ampx; & &copy;") == "&amp;&amp;amp &amp;copy &#39; &#x27; &amp;#39 &amp;nosuch; &amp;ampx; &amp; &copy;"
    assert closed(None) is None and closed("") == "" and closed("<a href='/?a=1&copy=2'>") == "<a href='/?a=1&amp;copy=2'>"
    assert extract(PAGE.format("a &amp", LONG, LONG))["title"] == "a &"


def test_html_title_lang_references(spark, tmp_path):
    pages = pages_table(spark, *[(i, f"https://n.test/{i}", PAGE.format(t, LONG, LONG)) for i, t in enumerate(CUT)])
    got = same_as_sql(spark, tmp_path, "html_title_lang", pages=pages)
    assert [r[1] for r in got][:4] == ["a &&amp", "b &am", "c &lt", "d &copy"]


def test_article_extract_references(spark, tmp_path):
    """References in titles, first paragraphs and others."""
    pages = pages_table(spark, *[(i, f"https://n.test/{i}", PAGE.format(t, f"{LONG} {t}", f"{LONG} {t}")) for i, t in enumerate(CUT)])
    got = same_as_sql(spark, tmp_path, "article_extract", pages=pages)
    assert got[0][4] == "a &&amp" and got[0][7] == f"{LONG} a &&amp" and got[0][8].endswith(f"{LONG} a &&amp")


def test_item_page_join_forms(spark, tmp_path):
    """Pages whose URLs differ in a parameter, in case or in white space are pages of their own; those that differ in the
    fragment or in slashes at the end of the path are one."""
    a = "https://n.test/a"
    urls = [a, f"{a}?utm_source=feed", f"{a}?utm_source=feed&utm_source=feed", f"{a}/", f"{a}//#top", f"{a}/?utm_source=feed#x", f"{a}?utm_source=feed#x", "https://N.test/a", f" {a}"]
    urls += [f"{a}?x=1&b=2", f"{a}?b=2&x=1", f"{a}?", f"{a}?b=2/", f"{a}/b//?c=/", "https://n.test/c", "https://n.test/c", "https://n.test/d", "", None]
    titles = [f"{i:02d} &amp{';' * (i % 2)}" for i in range(len(urls))]
    pages = pages_table(spark, *[(i, u, PAGE.format(t, LONG, LONG)) for i, (u, t) in enumerate(zip(urls, titles, strict=True))])
    part = spark.createDataFrame([(i, "zzz" if u == "https://n.test/d" else "An item", "x", "y") for i, u in enumerate(urls)], "p_partkey long, p_name string, p_type string, p_brand string")
    got = same_as_sql(spark, tmp_path, "item_page_join", pages=pages, part=part)
    assert len(got) == 12 and {a + "?utm_source=feed&utm_source=feed", "https://N.test/a", a + "?x=1&b=2", a + "?b=2&x=1"} <= {r[0] for r in got}
