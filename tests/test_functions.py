import pytest
from pyspark.sql import functions as F

from plumeline.functions import feedxml as X
from plumeline.functions import text as T
from plumeline.functions import times as TM
from plumeline.functions import urls as U


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("HTTPS://Example.com:443/News/Item/?utm_source=x&b=2&a=1#part", "https://example.com/News/Item?a=1&b=2"), ("http://example.com", "http://example.com/"), ("http://example.com:8080/a//", "http://example.com:8080/a"),
        ("https://e.com/?q=a+b&q=%7E", "https://e.com/?q=%7E&q=a+b"), ("https://e.com/?FBCLID=1&gclid=2&mc_cid=3", "https://e.com/"), ("https://e.com/a/../b/./c", "https://e.com/b/c"), ("https://e.com/a b", "https://e.com/a%20b"),
        ("http://0x7f.1/", "http://127.0.0.1/"), ("http://2130706433/a", "http://127.0.0.1/a"), ("http://0300.168.257", "http://192.168.1.1/"), ("http://1.2.3.4./", "http://1.2.3.4/"), ("http://1.2.3.256/", None), ("http://1.2.3.4.5/", None), ("http://a.09/", None),
        ("http://4294967296/", None), ("http://1.2.3.4a/", "http://1.2.3.4a/"), ("https://Bücher.example/ü", "https://xn--bcher-kva.example/%C3%BC"), ("https://日本語。jp:443", "https://xn--wgv71a119e.jp/"), ("x://0x7f.1/a", "x://0x7f.1/a"),
        ("mailto:a@b.example", "mailto:a@b.example"), ("/relative", None), ("not a url", None), ("", None), ("  ", None), (None, None), ("http://", None), ("http://e.com:x/", None), ("https://e.com/é?k=%zz", "https://e.com/%C3%A9?k=%25zz"),
    ],
)
def test_normalize_url(spark, value, want):
    got = one(spark, value, U.normalize_url)
    assert got == want
    assert one(spark, got, U.normalize_url) == got  # once is enough


@pytest.mark.parametrize(
    ("value", "want"),
    [("&amp;lt;", "&lt;"), ("&amp;#39;", "'"), ("<![CDATA[a <b>]]>", "a <b>"), ("&#x41;&#66;&#128512;", "AB\U0001f600"), ("a &lt;b&gt; &quot;c&quot; &apos;d&apos;", "a <b> \"c\" 'd'"), ("&#38;#66;", "&#66;"), (None, None)],
)
def test_decode_entities(spark, value, want):
    assert one(spark, value, T.decode_entities) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("<p>Hello&nbsp;<b>big</b> world , ok</p>", "Hello&nbsp; big world, ok"), ("a<script>x<y</script>b<STYLE a='1'>c</style>d", "a b d"), ("  　", None), ("a &lt; b &gt; c", "a c"), ("", None), ("x<br/>y", "x y")],
)
def test_display_text(spark, value, want):
    assert one(spark, value, T.display_text) == want


def test_slug_and_compare_key(spark):
    assert one(spark, "技術 / 開発 ニュース", T.slugify) == "技術-開発-ニュース"
    assert one(spark, "ＡＢ_c.d!", T.slugify) == "ab-c-d"
    assert one(spark, "  Ｋubernetes  Ops ", T.compare_key) == "kubernetes ops"
    assert one(spark, None, T.compare_key) is None and one(spark, "", T.compare_key) == ""
    for a, b in (("STRASSE", "Straße"), ("ſun", "Sun"), ("ΌΔΟΣ", "όδος"), ("ﬁne", "FINE"), ("e\u0301", "É"), ("①", "1")):
        assert one(spark, a, T.compare_key) == one(spark, b, T.compare_key), (a, b)


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Sat, 07 Mar 2026 09:00:00 +0900", "2026-03-07T00:00:00.000Z"), ("7 Mar 2026 09:00:00 GMT", "2026-03-07T09:00:00.000Z"), ("2026-03-07T09:00:00+09:00", "2026-03-07T00:00:00.000Z"), ("2026-03-07", "2026-03-07T00:00:00.000Z"),
        ("soon", None), ("", None), (None, None), ("Mar 7, 2026", "2026-03-07T00:00:00.000Z"), ("2026/03/07", "2026-03-07T00:00:00.000Z"), ("2026-03", "2026-03-01T00:00:00.000Z"), ("2026", "2026-01-01T00:00:00.000Z"),
        ("7 Mar 26 09:00:00 GMT", "2026-03-07T09:00:00.000Z"), ("7 Mar 69", "1969-03-07T00:00:00.000Z"), ("10 March 2026", "2026-03-10T00:00:00.000Z"), ("March 10, 2026 5:04 PM", "2026-03-10T17:04:00.000Z"), ("Saturday, March 7, 2026 12:05 am EST", "2026-03-07T05:05:00.000Z"),
        ("03/07/2026 10:00", "2026-03-07T10:00:00.000Z"), ("2026 Mar 7 10:00:01.5 +0230", "2026-03-07T07:30:01.500Z"), ("Feb 30 2026", "2026-03-02T00:00:00.000Z"), ("Sat Mar 07 2026 09:00:00 GMT+0900 (Japan Standard Time)", "2026-03-07T00:00:00.000Z"),
        ("March 2026", "2026-03-01T00:00:00.000Z"), ("7-Mar-2026 01:02:03 -05:00", "2026-03-07T06:02:03.000Z"), ("7 March 2026 at noon", None), ("13/13/2026", None), ("7 Mar 2026 25:00", None), ("item 12345678901234567890", None),
    ],
)
def test_parse_date(spark, value, want):
    assert one(spark, value, lambda v: TM.iso(TM.parse_date(v))) == want


def test_links_and_escapes(spark):
    assert one(spark, "javascript:alert(1)", U.safe_link) is None
    assert one(spark, "HTTPS://E.com", U.safe_link) == "https://e.com/"
    assert one(spark, "<a & 'b' \"c\">", T.escape_html) == "&lt;a &amp; &#39;b&#39; &quot;c&quot;&gt;"
    assert one(spark, "a b/é!", lambda v: U.page_href("sources", v)) == "./sources/?id=a%20b%2F%C3%A9!"
    assert one(spark, "?x=1&id=a+b&id=c", lambda v: U.query_param(v, "id")) == "a b"
    assert one(spark, "", lambda v: U.query_param(v, "id")) == ""


def test_xml_parts(spark):
    links = "<link rel='self' href='s'/><link href=' '/><link rel='Alternate' href='a&amp;b'/>"
    assert one(spark, links, X.atom_link) == "a&b"
    assert one(spark, "<link rel='self' href='s'/><link rel='edit' href='e'/>", X.atom_link) == "s"
    assert one(spark, "<media:content type='x'/><media:thumbnail url='t'/>", X.image_url) == "t"
    assert one(spark, "<enclosure url=\"audio.mp3\"></enclosure>", X.image_url) == "audio.mp3"
    assert one(spark, "<p>", X.image_url) is None
    assert one(spark, "<titles>no</titles><title> </title><name>n</name>", lambda v: X.first_text(v, ["title", "name"])) == "n"
    assert one(spark, "a='1' a=\"2\" b=''", lambda v: X.attribute(v, "a")) == "2"
    assert [one(spark, x, X.document_kind) for x in (" ", "<x><RSS v='2'>", "<feed>", "<feeds>", "<rdf:RDF>", None)] == ["blank", "rss", "atom", "unknown", "unknown", "blank"]


def test_links_as_the_url_standard_writes_them(spark):
    cases = {
        "HTTP://A.com:80/a/../b": "http://a.com/b", "https:\\\\a.com\\x": "https://a.com/x", "https://a.com/a b/\u00e9?q=\u00e9 x'#f g": "https://a.com/a%20b/%C3%A9?q=%C3%A9%20x%27#f%20g", "http://a.com:99999/": None, "http://a.com:65535/": "http://a.com:65535/",
        "https://a.com": "https://a.com/", "  https://u:p@A.com:0443?x=1&utm_source=b#": "https://u:p@a.com/?x=1&utm_source=b#", "javascript:alert(1)": None, "mailto:a@b": None, "https://": None, "": None, "https://a.com/%2e%2E/x/./y/..": "https://a.com/x/", "ftp://a.com/": None,
    }
    for url, want in cases.items():
        assert one(spark, url, U.safe_link) == want, url


def test_numeric_entities_in_one_pass(spark):
    assert one(spark, "&&#35;65;&#65;", T.decode_entities) == "&#65;A"
    assert one(spark, "&#x26;#65; &#38;#66; &#x1F600;&#65;", T.decode_entities) == "A &#66; \U0001f600A"


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("a&#1114111;b", "a\U0010ffffb"), ("a&#1114112;b", "a\ufffdb"), ("&#99999999999;", "\ufffd"), ("&#xD800;&#xdfff;&#xE000;", "\ufffd\ufffd\ue000"), ("&#x0000000000000000041;", "A"), ("&#" + "9" * 400 + ";", "\ufffd"),
        ("&#x110000;", "\ufffd"), ("&#0;", "\x00"), ("&#xFFFFFFFFFFFFFFFFF;x", "\ufffdx"),
    ],
)
def test_numbers_that_are_no_characters(spark, value, want):
    assert one(spark, value, T.decode_entities) == want


def test_byte_order_mark_by_number(spark):
    assert one(spark, "a&#65279;b&#xFEFF;&#xfeff;c", T.decode_entities) == "a\ufeffb\ufeff\ufeffc"
    assert one(spark, "&#xFEFF;", T.decode_entities) == "\ufeff"


def test_every_number_in_unicode_and_beyond(spark):
    """Each number from 0 to beyond Unicode, by both bases, is the character that Python has for it."""
    rows = spark.range(0, 0x110100, 1, 4).select("id", T.decode_entities(F.concat(F.lit("<&#"), F.col("id").cast("string"), F.lit(";&#x"), F.hex("id"), F.lit(";>"))).alias("shown"))
    char = lambda n: "\ufffd" if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)
    assert [n for n, shown in rows.collect() if shown != f"<{char(n) * 2}>"] == []
