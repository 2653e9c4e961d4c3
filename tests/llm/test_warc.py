import pytest
from pyspark.sql import functions as F

from tallyframe.llm import warc


def test_plain_text_and_links(spark, tmp_path):
    html = (
        '<!DOCTYPE html><html lang="en"><head><title>A  &amp; B\n</title><script>x("</p>")</script></head><body><!-- no -->'
        "<h1>Head</h1><p>One <b>bold</b> &lt;tag&gt;<br>two</p><STYLE>p{}</STYLE><a href='/x'>link</a> <a href='/y'>é</a></body></html>"
    )
    pages = spark.createDataFrame(
        [(1, "http://a.example/", html, "z"), (2, None, None, "z"), (3, "http://b.example/", "", "z"), (3, "http://b.example/", "", "z")],
        "page_id long, url string, html string, block string",
    )
    responses = warc.responses_from_pages(pages)
    rows = warc.derive(responses).collect()
    assert len(rows) == 8
    by = {(r.page_id, r.record_type): r for r in rows}
    assert by[1, "conversion"].block == "Head\nOne bold <tag>\ntwo\nlink é"
    assert "title: A &amp; B\r\nlanguage: en\r\noutlinks: 2\r\n" in by[1, "metadata"].block
    assert by[2, "conversion"].block == by[3, "conversion"].block == ""
    source = {r.page_id: r for r in responses.collect()}
    for (page, _), r in by.items():
        assert r.refers_to == source[page].record_id and r.payload_digest == source[page].payload_digest
        assert r.http_headers == source[page].http_headers and f"WARC-Refers-To: <{r.refers_to}>" in r.headers
    assert len({r.record_id for r in rows}) == 6
    assert warc.derive(responses.limit(0)).count() == 0


def test_captures_of_one_url_have_ids_of_their_own(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.example/", "one"), (1, "http://a.example/", "two"), (1, "http://a.example/", "two"), (None, "http://a.example/", "one")],
        "page_id long, url string, html string",
    )
    assert len({r.record_id for r in warc.responses_from_pages(pages).collect()}) == 3
    assert len({r.record_id for r in warc.derive(warc.responses_from_pages(pages)).collect()}) == 6


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", f"<p>Text {i} é</p>\r\n\r\n<p>more</p>") for i in range(40)], "page_id long, url string, html string")
    records = warc.derive(warc.responses_from_pages(pages.repartition(3)))
    path = str(tmp_path / "out")
    warc.write_warc(records, path, compression)
    back = warc.read_warc(spark, path)
    assert back.where(~F.col("whole")).count() == 0
    cols = ["record_type", "record_id", "refers_to", "target_uri", "date", "headers", "block"]
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*cols).collect())
    assert key(back) == key(records)


def test_plain_entities_are_replaced_without_patterns(spark):
    plan = str(warc.plain_text(F.col("x")))
    assert plan.count("regexp_replace") == len(warc.TEXT_STEPS) - 5
    texts = ["a&nbsp;b &amp;lt; &lt;i&gt; &quot;q&quot; &#39;&apos; &AMP; &amp;amp;", "&amp", "", "é&lt;ß&gt;"]
    got = [r.t for r in spark.createDataFrame([(x,) for x in texts], "x string").select(warc.plain_text(F.col("x")).alias("t")).collect()]
    assert got == ["a b &lt; <i> \"q\" '' &AMP; &amp;", "&amp", "", "é<ß>"]
