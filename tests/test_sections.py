"""Large XML files by ranges of bytes: the chunks of a whole reading, whatever the ranges."""

import random

import pytest

from lexloom.sources import outline as O
from lexloom.sources import sections as X


def regulation_file(n):
    rng, out = random.Random(1), ["<?xml version='1.0'?><ECFR><DIV6 N='1'><HEAD>Part 1</HEAD>"]
    for i in range(n):
        words = " ".join(rng.choice(["income", "é", "tax & co".replace("&", "&amp;"), "§"]) for _ in range(rng.randint(0, 300)))
        kind = rng.choice(["SECTION", "SECTION", "SECTION", "APPENDIX"])
        out.append(f"<DIV7><HEAD>Subject</HEAD>\n<DIV8 N='1.{i}' NODE='26:1.{i}' TYPE='{kind}'>\n<HEAD>Scope {i}.</HEAD><P>(a) {words}</P><!-- <DIV8 N='x' TYPE='NONE'> --><P>(b)(1) {words}</P></DIV8>\n</DIV7>")
    return "".join(out) + "</DIV6></ECFR>"


def statute_file(n):
    rng, out = random.Random(2), ["<usc xmlns='u' xmlns:dc='d'><meta><dc:title>26</dc:title><created>2026-01-02T00</created><docPublicationName>Online@119-110</docPublicationName></meta><main><title>"]
    for i in range(n):
        words = " ".join(rng.choice(["income", "gain", "loss"]) for _ in range(rng.randint(1, 200)))
        quoted = "".join(f"<quotedContent><section identifier='/us/bill/{i}/{k}'><num>{k}</num><content>{words}</content></section></quotedContent>" for k in range(rng.randint(0, 3)))
        out.append(f"<section style='x' identifier='/us/usc/t26/s{i}'><num>{i}</num><heading>H{i}</heading><subsection identifier='/us/usc/t26/s{i}/a'><num>(a)</num><content>{words} <dc:b>bold</dc:b>{quoted} after</content></subsection><notes>{quoted}</notes><sourceCredit>(c {i})</sourceCredit></section>\n")
    return "".join(out) + "</title></main></usc>"


def rows(df):
    return sorted(map(str, df.drop("authority").collect()))


@pytest.mark.parametrize("n, size", [(12, 900), (60, 5000), (60, 10**9)])
def test_regulations_by_ranges(spark, tmp_path, n, size):
    (tmp_path / "a.xml").write_text(regulation_file(n))
    (tmp_path / "b.xml").write_text(regulation_file(7))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        if size < 10**9:
            assert X.records(spark, str(tmp_path), "DIV8")._jdf.rdd().getNumPartitions() > 8
        got = rows(X.regulations(spark, str(tmp_path), "2026-09-17"))
        some = rows(X.regulations(spark, str(tmp_path / "a.xml"), "2026-09-17", ["1.3", "1.5", "1.7"]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = O.read_regulations(spark, str(tmp_path), "2026-09-17")
    assert got == rows(want) and len(got) >= n // 2
    assert some == rows(O.read_regulations(spark, str(tmp_path / "a.xml"), "2026-09-17").where("section in ('1.3', '1.5', '1.7')"))


@pytest.mark.parametrize("n, size", [(10, 900), (50, 5000), (50, 10**9)])
def test_statutes_by_ranges(spark, tmp_path, n, size):
    (tmp_path / "a.xml").write_text(statute_file(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = rows(X.statutes(spark, str(tmp_path)))
        some = rows(X.statutes(spark, str(tmp_path), ["3", "44"]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = O.read_statutes(spark, str(tmp_path))
    assert got == rows(whole) and len(got) >= n
    assert some == rows(whole.where("section in ('3', '44')")) and some


def test_an_end_is_found_past_what_is_nested_and_what_is_no_tag():
    assert X.closed("a='1'>x<section>y</section>z</section>rest", "section") == "<section a='1'>x<section>y</section>z</section>"
    assert X.closed("a='1'/>rest", "section") == "<section a='1'/>"
    assert X.closed("a='1'><!-- </section> --><sectional></sectional><![CDATA[</section>]]></section>", "section").endswith("]]></section>")
    assert X.closed("a='1'>x<section/>y", "section") is None
