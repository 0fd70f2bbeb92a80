"""Input/output tables for the column library, each in one DataFrame."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from presslake.functions import counts, dates, fingerprints, names, text, urls
from presslake.functions.variants import number_text


def check(spark, cases, apply, in_type=None):
    rows = [(i, c[0], c[1]) for i, c in enumerate(cases)]
    schema = T.StructType([
        T.StructField("i", T.IntegerType()),
        T.StructField("given", in_type or T.StringType()),
        T.StructField("want", T.StringType()),
    ])
    got = apply(spark.createDataFrame(rows, schema)).select("i", "given", "want", F.col("got").cast("string")).collect()
    wrong = [(r.given, r.want, r.got) for r in got if r.got != r.want]
    assert not wrong, wrong


def cleaned(df):
    return text.with_clean_text(df, {"got": "given"})


# Entities are decoded once; elements that break a line become a space, others vanish.
CLEAN = [
    (None, None), ("", None), ("  \n", None), ("<tr></tr>", None), ("no markup, 5 < 6", "no markup, 5 < 6"),
    ("kelp　 \tforest", "kelp forest"), ("a\u0085b", "a\u0085b"), ("tide﻿ pool", "tide pool"),
    ("<h2>Low</h2>water<br/>mark", "Low water mark"), ("<em>spring</em><em>tide</em>", "springtide"), ("<figure-x>eel</figure-x>", "eel"),
    ("<section-a>x</section-a>y", "x y"),
    ("net<template><p>hidden</p></template>s", "net s"), ("<noscript >x</noscript >oar", "oar"), ("<styles>kept</styles>", "kept"),
    ("<script>never closed <i>x</i>", "never closed x"), ("<STYLE media=a>z</Style\n>hull", "hull"),
    ("<!-- alone -->", "<!-- alone -->"), ("<u>a</u><!-- b --> c", "a c"), ("<!DOCTYPE x><u>a</u>", "<!DOCTYPE x>a"),
    ("salt &AMP; wind", "salt & wind"), ("&ldquo;ahoy&rdquo; &hellip;", "“ahoy” …"), ("&NBSP;x&nbsp;", "x"), ("&sect; &eacute;", "&sect; &eacute;"),
    ("&amp;gt; &amp;#62;", "&gt; &#62;"), ("&quot;&apos;", "\"'"),
    ("&#0122;&#x7A;", "zz"), ("&#X7A;", "&#X7A;"), ("&#zz;", "&#zz;"), ("&#122q;x", "&#122q;x"), ("&#122ab;x", "zx"), ("&#9973;", "⛵"), ("&#xD83D;&#xDEA2;", "🚢"),
    ("&#xDEA2;", "�"), ("&#x120000;", "&#x120000;"), ("&#88888888888888888888;", "&#88888888888888888888;"),
    ("f&#105;n", "fin"), ("&l<q></q>t;", "<"),
]


def test_clean_text(spark):
    check(spark, CLEAN, cleaned)


def test_decode_once(spark):
    check(spark, [("fish &amp; chips &#8212; &#39;", "fish & chips — '"), ("&am&#112;lt;", "&amplt;"), ("plain & simple", "plain & simple")],
          lambda df: df.withColumn("got", text.decode_entities("given")))


def test_fold_source(spark):
    check(spark, [
        ("Baltic Herald", "balticherald"), (" BALTIC  Herald\t", "balticherald"), ("balticherald.ee", "balticherald"),
        ("WWW.balticherald.ee/uudised?x", "balticherald"), ("gopher://www.balticherald.ee", "balticherald"),
        ("m.baltic.ee", "m"), ("N.A.T.O", "n"), ("A.B.", "ab"), ("one..two", "onetwo"), ("-dash.org", "dash"),
        ("site.org/a path", "site"), ("Ελλάδα", ""), ("two words.org", "twowordsorg"), (".dot.org", "dotorg"), ("No. 7!", "no7"),
    ], lambda df: df.withColumn("got", names.fold_source(F.col("given"))))


def test_source_field(spark):
    check(spark, [("<i>Bal</i>tic", "baltic|Baltic"), ("—", None), (None, None), ("R&amp;D  Post", "rdpost|R&D Post")],
          lambda df: names.with_source(df, "given").withColumn(
              "got", F.when(F.col("source").isNotNull(), F.concat_ws("|", "source", "source_raw"))))


LINKS = [
    # Scheme, host and port.
    ("HTTP://Www.Dock.IO", "http://dock.io/"), ("https:dock.io/q", "https://dock.io/q"), ("http:\\\\dock.io\\w\\x", "http://dock.io/w/x"),
    ("https://///dock.io/q", "https://dock.io/q"), ("  http://dock.io/z  ", "http://dock.io/z"),
    ("gopher://dock.io", None), ("dock.io/q", None), ("//dock.io", None), ("http:", None), ("https://?q", None), (None, None), ("\t", None),
    ("http://dock.io:080/", "http://dock.io/"), ("http://dock.io:8080", "http://dock.io:8080/"), ("https://dock.io:80/", "https://dock.io:80/"),
    ("http://dock.io:/w", "http://dock.io/w"), ("http://dock.io:0", "http://dock.io:0/"), ("http://dock.io:65536/", None), ("http://dock.io:7x/", None),
    ("http://www.www.dock.io/", "http://www.dock.io/"), ("http://d%6Fck.io/", "http://dock.io/"), ("http://do ck.io/", None), ("http://do|ck.io/", None),
    # Numbers as hosts, with any number of leading zeros.
    ("http://10.1/", "http://10.0.0.1/"), ("http://0xa.0.0.1/", "http://10.0.0.1/"), ("http://167772161/", "http://10.0.0.1/"),
    ("http://012.0.0.01/", "http://10.0.0.1/"), ("http://0x000000000000000000a.0.0.1/", "http://10.0.0.1/"),
    ("http://0000000000000000012.0.0.1/", "http://10.0.0.1/"), ("http://0xffffffffffffffffff/", None),
    ("http://10.0.0.0.1/", None), ("http://10.0.300.1/", None), ("http://dock.7/", None), ("http://4294967296/", None),
    # Addresses of the newer kind, shortest form.
    ("http://[0:0:0:0:0:0:0:1]/a", "http://[::1]/a"), ("http://[::1]:81/", "http://[::1]:81/"), ("http://[2001:DB8:0:0:1:0:0:1]/", "http://[2001:db8::1:0:0:1]/"),
    ("http://[1:0:0:2:0:0:0:3]/", "http://[1:0:0:2::3]/"), ("http://[0000:00ff::]/", "http://[0:ff::]/"), ("http://[::]/", "http://[::]/"),
    ("http://[::ffff:10.0.0.1]/", "http://[::ffff:a00:1]/"), ("http://[1:2:3:4:5:6:7:8]/", "http://[1:2:3:4:5:6:7:8]/"),
    ("http://[1:2:3:4:5:6:7]/", None), ("http://[1::2::3]/", None), ("http://[12345::]/", None), ("http://[1:2:3:4:5:6:7:8:9]/", None), ("http://[::10.0.0.256]/", None),
    # Letters of other scripts; those an old encoder would merge stay apart.
    ("http://Åland.example/x", "http://xn--land-poa.example/x"), ("http://GROẞ.de/", "http://groß.de/"), ("http://straße.de/a", "http://straße.de/a"),
    ("http://strasse.de/a", "http://strasse.de/a"), ("http://a‍b.example/", "http://a‍b.example/"), ("http://ab.example/", "http://ab.example/"),
    # User, path, query.
    ("http://me:pw@dock.io/", "http://me:pw@dock.io/"), ("http://me:@dock.io/", "http://me@dock.io/"), ("http://:@dock.io/", "http://dock.io/"),
    ("http://m@e@dock.io/", "http://m%40e@dock.io/"),
    ("http://dock.io/Pier/", "http://dock.io/Pier"), ("http://dock.io/pier//", "http://dock.io/pier/"), ("http://dock.io///", "http://dock.io//"),
    ("http://dock.io/x y/ü", "http://dock.io/x%20y/%C3%BC"), ("http://dock.io/%q", "http://dock.io/%q"),
    ("http://dock.io/a/b/../../c/.", "http://dock.io/c"), ("http://dock.io/%2E%2e/%2e/q", "http://dock.io/q"), ("http://dock.io/../..", "http://dock.io/"),
    ("http://dock.io?spm=1", "http://dock.io/"), ("http://dock.io/?y=2&x=1&y=1", "http://dock.io/?x=1&y=2&y=1"), ("http://dock.io/?b&a=&=c", "http://dock.io/?=c&a=&b="),
    ("http://dock.io/?MSCLKID=1&Utm_Term=2&k=v", "http://dock.io/?k=v"), ("http://dock.io/?k=v=w&&", "http://dock.io/?k=v%3Dw"),
    ("http://dock.io/?k=a+b%20c%7e%q", "http://dock.io/?k=a+b+c%7E%25q"), ("http://dock.io/p#?k=v", "http://dock.io/p"),
]


def test_canonical_url(spark):
    check(spark, LINKS, lambda df: urls.with_canonical_url(df, "given", out="got"))


def test_uts46_hosts(spark):
    hosts = [("straße.de", "xn--strae-oqa.de"), ("GROẞ.de", "gross.de"), ("ｗｗｗ．Ｄock。io", "www.dock.io"), ("例え.テスト", "xn--r8jz45g.xn--zckzah"),
             ("ΣΑΣ.gr", "xn--mxa9ab.gr"), ("Åland.example", "xn--land-poa.example"), ("strasse.de", "strasse.de")]
    got = spark.createDataFrame(hosts, "host string, want string").select("want", F.expr(urls.uts46_host("host")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_punycode_equals_the_plain_encoder(spark):
    """Random labels of code points from all planes against Python's Bootstring codec."""
    rng = random.Random(7)
    ranges = [(0x61, 0x7A), (0x30, 0x39), (0xA0, 0x2FF), (0x370, 0x3FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F64F), (0x10000, 0x10FFFF)]
    labels = []
    for _ in range(400):
        size = rng.choice([1, 2, 3, 8, 20, 63])
        labels.append("".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(size)))
    labels = [label for label in labels if not any(0xD800 <= ord(c) <= 0xDFFF for c in label)]
    got = spark.createDataFrame([(label,) for label in labels], "label string").select("label", F.expr(urls.punycode("label")).alias("got"))
    for row in got.collect():
        assert row.got == row.label.encode("punycode").decode("ascii"), row.label


def iso(df, number=None):
    return dates.with_published_at(df, "given", number, out="ts").withColumn("got", dates.iso_utc(F.col("ts")))


def at(day, time="00:00:00.000"):
    return f"{day}T{time}Z"


TIMES = [
    # With and without a zone.
    ("2019-11-02T17:04:09Z", at("2019-11-02", "17:04:09.000")), ("2019-11-02T17:04:09-05:45", at("2019-11-02", "22:49:09.000")),
    ("2019-11-02 17:04", at("2019-11-02", "17:04:00.000")), ("2019-11-02T17:04:09.1239+0100", at("2019-11-02", "16:04:09.123")),
    ("\t2019-11-02    17:04 Z", at("2019-11-02", "17:04:00.000")), ("2019-11-02T17:04.25", at("2019-11-02", "17:04:00.250")),
    ("2019-11-02T17:04:60", at("2019-11-02", "17:05:00.000")), ("2019-11-02T24:00", None), ("2019-11-02T17:60", None), ("2019-11-02T23:59:60Z", None),
    ("2019-11-02T17:04:09.12345678Z", None), ("2019-11-02z", None), ("2019-1-2", None), ("2019-13-02", None), ("2019-11-31", None),
    # Days in numbers; the day is first unless it cannot be.
    ("2019-11-02", at("2019-11-02")), ("2019/11/02", at("2019-11-02")), ("2019.11.02", at("2019-11-02")), ("02/11/2019", at("2019-11-02")),
    ("11/22/2019", at("2019-11-22")), ("22-11.2019", at("2019-11-22")), ("31/31/2019", None), ("22/11/2019 17:04", None),
    # Months by name.
    ("2 November 2019", at("2019-11-02")), ("NOVEMBER 2, 2019", at("2019-11-02")), ("2 Nov 2019", at("2019-11-02")), ("17 Agt 2019", at("2019-08-17")),
    ("9 Mei 2019", at("2019-05-09")), ("30 Pebruari 2019", None), ("1 Oktober 2019, 6.07", at("2019-10-01", "06:07:00.000")),
    ("October 1, 2019 06:07:08", at("2019-10-01", "06:07:08.000")), ("2 Smarch 2019", None), ("Smarch 2 2019", None), ("2 Nov 2019 17:04 GMT", None),
    # Local zones of the archipelago, by label.
    ("9 Mei 2019 21:00 WIB", at("2019-05-09", "14:00:00.000")), ("2019-05-09 21:00 wita", at("2019-05-09", "13:00:00.000")),
    ("9 Mei 2019 Wit", at("2019-05-08", "15:00:00.000")), ("2019-05-09T21:00:00-01:00 WIB", at("2019-05-09", "22:00:00.000")), ("WITA", None),
    # Mail headers.
    ("Sat, 02 Nov 2019 17:04:09 GMT", at("2019-11-02", "17:04:09.000")), ("Sat, 2 Nov 2019 17:04 -0330", at("2019-11-02", "20:34:00.000")),
    ("Sat, 02 Nov 2019 17:04:09 PDT", at("2019-11-03", "00:04:09.000")), ("Sat, 30 Feb 2019 01:00:00 GMT", at("2019-03-02", "01:00:00.000")),
    # Seconds and milliseconds since 1970, as text.
    ("1572714249", at("2019-11-02", "17:04:09.000")), ("1572714249500", at("2019-11-02", "17:04:09.500")), ("157271424", None), ("-1572714249", None),
    # Only times from 1990 to 2100 are believed.
    ("1989-12-31", None), ("1990-01-01", at("1990-01-01")), ("1990-01-01T01:00:00+02:00", None), ("2100-12-31T22:30:00-02:00", None),
    (None, None), ("", None), ("last Tuesday", None), ("3 hari lalu", None), ("-", None),
]


def test_dates(spark):
    check(spark, TIMES, iso)


def test_date_numbers(spark):
    def apply(df):
        df = df.withColumn("n", F.col("given")).withColumn("given", F.lit(None).cast("string"))
        return iso(df, "n")
    check(spark, [(1572714249.0, at("2019-11-02", "17:04:09.000")), (1572714249500.0, at("2019-11-02", "17:04:09.500")),
                  (1572714249.25, at("2019-11-02", "17:04:09.250")), (90210.0, None), (-1572714249.0, None), (1e200, None), (None, None)],
          apply, T.DoubleType())


def test_counts(spark):
    zeros = "0" * 305
    check(spark, [
        ("806", "806"), ("31,415", "31415"), ("31.415", "31415"), ("31 415", "31415"), ("3.141.592", "3141592"), ("007", "7"), ("0", "0"), ("  9\n", "9"),
        ("7,5k", "7500"), ("0.25 K", "250"), ("40 ribu", "40000"), ("1.0049k", "1005"), ("2,125jt", "2125000"), ("9 Juta", "9000000"), ("3.000rb", "3000"),
        (f"1.{zeros}k", "1000"), (f"1.{zeros}9k", "1000"), (f"{'9' * 400}k", None), (f"1.5{zeros}jt", "1500000"),
        ("some", None), ("", None), (None, None), ("8.25", None), ("31,41", None), ("31  415", None), ("-806", None), ("3,141.592", None), ("31.415,0", None),
        ("2147483647", "2147483647"), ("2147483648", None), ("31415926535897932384626", None), ("2148 juta", None), ("k", None),
    ], lambda df: counts.with_count(df, "given", None, out="got"))


def test_count_numbers(spark):
    check(spark, [(31.0, "31"), (31.25, None), (-31.0, None), (2147483647.0, "2147483647"), (2147483648.0, None), (1e200, None), (None, None)],
          lambda df: df.withColumn("got", counts.count_from_number(F.col("given"))), T.DoubleType())


def test_number_text(spark):
    check(spark, [(31.0, "31"), (0.0625, "0.0625"), (-0.0, "0"), (3e22, "3e+22"), (2.5e-8, "2.5e-8"), (9e-7, "9e-7"), (98765432109876543210.0, "98765432109876540000"),
                  (7.5e-6, "0.0000075"), (-6.5, "-6.5"), (4000.0, "4000"), (31415926.5, "31415926.5"), (None, None)],
          lambda df: df.withColumn("got", number_text("given")), T.DoubleType())


def test_comparison_form(spark):
    check(spark, [("Low -- TIDE?", "low tide"), (None, ""), ("…", ""), ("Ñu_2/b", "ñu 2 b")],
          lambda df: df.withColumn("got", fingerprints.comparison_form(F.col("given"))))


@pytest.mark.parametrize("body", ["q" * 499 + "🚢z", "q" * 498 + "🚢z", "🚢" * 260, "ž" * 700, "x yz " * 130, ""])
def test_content_prefix_counts_utf16_units(spark, body):
    want = body.encode("utf-16-be")[:1000].decode("utf-16-be", "replace")
    got = spark.createDataFrame([(body,)], "x string").select(fingerprints.content_prefix(F.col("x"))).first()[0]
    assert got == want


def test_schemeless(spark):
    check(spark, [("http://dock.io/q", "dock.io/q"), ("https://dock.io", "dock.io")],
          lambda df: df.withColumn("got", fingerprints.schemeless(F.col("given"))))


# The patterns as plain regular expressions: the cleaning must give exactly their results.
def _plain_code(c):
    return F.regexp_replace(c, text._NON_CONTENT, " ")


def _plain_tags(c):
    spaced = F.regexp_replace(_plain_code(c), text._BLOCK_TAG, " ")
    return F.regexp_replace(F.regexp_replace(spaced, text.COMMENT, " "), text.TAG, "")


_PIECES = [
    "<script>", "</script>", "<SCRIPT a='x'>", "</Script >", "<style>", "</style>", "<noscript>", "</noscript>", "<template>",
    "</template>", "<!--", "-->", "<!-->", "<p>", "</p>", "<div class=a>", "<br/>", "<a href='x'>", "</a>", "<b", ">", "<", "x",
    " y ", "&amp;", "\n", "<scripts>", "<script a='</script>", "<!---->", "é", "<script <style>", "</style\t>", "", text.MARK,
]


def test_html_cleaning_equals_plain_patterns(spark):
    import random

    r = random.Random(17)
    rows = [("".join(r.choice(_PIECES) for _ in range(r.randrange(0, 40))),) for _ in range(3000)] + [(None,), ("",)]
    got = spark.createDataFrame(rows, "h string").select(
        text.drop_non_content(F.col("h")).alias("a"), _plain_code(F.col("h")).alias("b"),
        text.drop_tags(F.col("h")).alias("c"), _plain_tags(F.col("h")).alias("d"),
        text.looks_like_html(F.col("h")).alias("e"),
        ((F.col("h").contains("<") & F.col("h").rlike(text.TAG)) | (F.col("h").contains("&") & F.col("h").rlike(text.ENTITY))).alias("f"),
    ).collect()
    assert all(row.a == row.b and row.c == row.d and row.e == row.f for row in got)


def test_html_cleaning_grows_linearly(spark):
    import time

    units = ["<script>", "<!-- ", "<a", "<p ", "<style>", "<template "]
    seconds = {}
    for n in (20_000, 80_000):
        # Openers that never close, then the closing tag of another element.
        rows = [(unit * n + "<script>x</script>",) for unit in units]
        df = spark.createDataFrame(rows, "h string").select("h")
        started = time.time()
        df.select(F.sum(F.length(text.drop_tags(F.col("h")))), F.sum(F.length(text.drop_non_content(F.col("h"))))).collect()
        text_clean = text.with_clean_text(df, {"body": "h"}).select(F.sum(F.length("body"))).collect()
        seconds[n] = time.time() - started
        assert text_clean
    # Four times the text: far less than sixteen times the time (plain patterns take minutes at 80,000).
    assert seconds[80_000] < 4 * seconds[20_000] + 10


def test_white_space_and_dead_openers_keep_their_results(spark):
    """The quick ways of white space, code elements and comments against the plain patterns."""
    draw = random.Random(5)
    spaces = [" ", " ", "  ", "\t", " \n", "　", "﻿ ", " ", "x", "~", "!", "é", "\u0085"]
    tags = ["<!--", "-->", "<!-->", "<!--->", "--", ">", "<", "<script>", "</script >", "<STYLE a>", "</style>", "<p", "</p>", "a ", "<b>"]
    rows = [("".join(draw.choices(spaces, k=12)), "".join(draw.choices(tags, k=draw.randint(1, 14)))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "s string, h string")
    got = df.select(
        text.collapse_ws(F.col("s")).eqNullSafe(F.trim(F.regexp_replace("s", text.WS + "+", " "))).alias("a"),
        text.drop_tags(F.col("h")).eqNullSafe(_plain_tags(F.col("h"))).alias("b"),
        text.drop_non_content(F.col("h")).eqNullSafe(_plain_code(F.col("h"))).alias("c"),
    ).where("NOT (a AND b AND c)").count()
    assert got == 0


def test_fingerprint_of_long_content_is_that_of_its_whole_form(spark):
    """The form of the content's head stands for the whole only where 500 units are certain."""
    long = [
        "word " * 900, "Ab, " * 2000, "-" * 5000 + "late", "x" * 499 + " " * 3000 + "yz", "x" * 500 + "." * 3000 + "y", "x" * 501 + "." * 3000 + "y",
        "😀é" * 700, "z" * 499 + "😀" * 900, "a" * 20 + "Σ" + "ʰ" * 2100 + "a", "Σ " * 1500, "k" * 2000, "k" * 2001, "", " ", "İ" * 1200,
    ]
    df = spark.createDataFrame([(i, "s", None, None if i % 2 else "T", c) for i, c in enumerate([None, *long])],
                               "i int, source string, url string, title string, content string")
    form = lambda c: fingerprints.comparison_form(F.col(c))
    whole = fingerprints.identity_text(F.col("source"), F.col("url"), form("title"), form("content"))
    rows = fingerprints.with_fingerprint(df.withColumn("want", F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256))))
    assert rows.where("fingerprint <=> want").count() == len(long) + 1
