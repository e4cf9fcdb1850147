from datetime import datetime

from pyspark.sql import functions as F

from tidewire.sources import feeds, tables

RSS = """<?xml version="1.0"?><rss><channel><title>Feed</title>
<item><title>One &amp; two</title><link>http://e.org/1</link><category>a</category><category>b</category>
  <pubDate>Mon, 02 Jan 2006 15:04:05 +0300</pubDate><description>long</description></item>
<item><title> </title><link>http://e.org/2</link><pubDate>Mon, 02 Jan 2006 15:04:05 GMT</pubDate></item>
<item><title>Three</title><link>http://e.org/3</link></item></channel></rss>"""
TIMES = {"Mon, 02 Jan 06 15:04 GMT": 15, "02 Jan 06 15:04:05 EST": 20, "02 January 2006 15:04 GMT": 15, "2 Jan 2006 15:04:05 Z": 15, "2006-01-02T15:04Z": 15,
         "Mon, 02 Jan 2006 15:04:05 +0300": 12, "2006-01-02T15:04:05+01:00": 14, "yesterday": None}
ATOM = """<?xml version="1.0"?><feed><title>Feed</title>
<entry><title>A</title><link rel="self" href="http://e.org/x"/><link rel="alternate" href="http://e.org/a"/><category term="t"/>
  <published>2006-01-02T15:04:05Z</published></entry>
<entry><title>B</title><link href="http://e.org/b"/><updated>2006-01-03T00:00:00+01:00</updated></entry></feed>"""


def test_rss(spark, tmp_path):
    (tmp_path / "one.xml").write_text(RSS)
    rows = {r.link: r for r in feeds.read_feeds(spark, str(tmp_path)).collect()}
    assert len(rows) == 3
    first = rows["http://e.org/1"]
    assert (first.title, first.categories, first.published) == ("One & two", ["a", "b"], datetime(2006, 1, 2, 12, 4, 5))
    assert rows["http://e.org/3"].published is None and rows["http://e.org/3"].categories == []
    valid = tables.valid_items(feeds.read_feeds(spark, str(tmp_path)))
    assert {r.link for r in valid.collect()} == {"http://e.org/1", "http://e.org/3"}


def test_times(spark, tmp_path):
    items = "".join(f"<item><title>{i}</title><link>l</link><{tag}>{t}</{tag}></item>" for i, t in enumerate(TIMES) for tag in ("pubDate", "dc:date"))
    (tmp_path / "f.xml").write_text(f'<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>{items}</channel></rss>')
    got = [(r.title, r.published and r.published.hour) for r in feeds.read_feeds(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[0]) == [(str(i), hour) for i, hour in enumerate(TIMES.values()) for _ in range(2)]


def test_atom(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(ATOM)
    rows = {r.title: (r.link, r.categories, r.published) for r in feeds.read_feeds(spark, str(tmp_path), feeds.ATOM).collect()}
    assert rows == {"A": ("http://e.org/a", ["t"], datetime(2006, 1, 2, 15, 4, 5)), "B": ("http://e.org/b", [], datetime(2006, 1, 2, 23))}


def test_broken_feed_is_skipped(spark, tmp_path):
    (tmp_path / "good.xml").write_text(RSS)
    (tmp_path / "bad.xml").write_text("<rss><channel><item><title>x</titl></item></channel>")
    (tmp_path / "junk.xml").write_bytes(bytes(range(256)))
    got = {r.link for r in feeds.read_feeds(spark, str(tmp_path)).collect()}
    assert got == {"http://e.org/1", "http://e.org/2", "http://e.org/3"}


def test_links_of_sources(spark, tmp_path):
    for name in ("a/1", "a/2", "b", "nobody"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "f.xml").write_text(RSS.replace("e.org/", f"e.org/{name}/"))
    base = f"file:{tmp_path}"
    sources = spark.createDataFrame([("A.x", [f"{base}/a/1", f"{base}/a/2"]), ("B.x", [f"{tmp_path}/b/f.xml"])], "name string, links array<string>")
    rows = feeds.of_sources(feeds.read_feeds(spark, str(tmp_path)), sources)
    counts = {r.src: r["count"] for r in rows.groupBy("src").count().collect()}
    assert counts == {"A.x": 6, "B.x": 3}
