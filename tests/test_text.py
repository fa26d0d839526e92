"""Chunk and citation functions on hand-made cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import answers as A


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("citation", "section"),
    [
        ("26 CFR 1.263(a)-3(k)(1)", "1.263(a)-3"),
        ("IRS Pub 587 (2025), p. 12", "Pub 587"),
        ("26 U.S.C. § 1400Z-2(a)(1)", "1400Z-2"),
        ("Chapin v. Commissioner, T.C. Memo. 2026-76, at *12", "T.C. Memo. 2026-76"),
        ("26 CFR 1.61", "1.61"),
    ],
)
def test_section_of(spark, citation, section):
    assert value(spark, T.section_of(F.lit(citation))) == section


def test_bracketed_citations(spark):
    assert value(spark, T.bracketed(F.lit("a [X; Y] b [Z [Q]] c [X] []"))) == ["X", "Y", "Z", "Q"]


def test_expiry_is_strict_and_sunset_is_not(spark):
    clause = F.lit("The applicability of this section expires on December 6, 2019.")
    day = lambda s: F.lit(s).cast("date")
    assert value(spark, T.expiry(clause, day("2019-12-06"))) is None
    assert value(spark, T.expiry(clause, day("2019-12-07"))) == "whole"
    note = F.lit("[T.D. 8253, 54 FR 20542, May 12, 1989]")
    assert not value(spark, T.sunset(note, day("1992-05-11")))
    assert value(spark, T.sunset(note, day("1992-05-12")))
    assert value(spark, T.sunset(F.lit("[T.D. 1, Feb. 29, 2024]"), day("2027-02-28")))
    assert not value(spark, T.sunset(F.lit("[T.D. 1, Nov. 20, 1988]"), day("2020-01-01")))


def test_scope_keeps_to_boundaries(spark):
    ok = lambda s: value(spark, T.in_scope(F.lit(s), ["1.61"]))
    assert ok("1.61") and ok("1.61-1") and ok("1.61(a)-1") and not ok("1.611-1") and not ok("1.6011-1")


def test_outline_levels(spark):
    level = lambda t, b: value(spark, T.outline_level(F.lit(t), F.lit(b).cast("string")))
    assert [level("a", None), level("i", "h"), level("i", "b"), level("1", "a"), level("A", "a")] == [1, 1, None, 2, None]


def test_tokens_round_halves_to_even(spark):
    for n in (0, 1, 5, 15, 25, 335):
        assert value(spark, T.estimate_tokens(F.lit(" ".join(["w"] * n)))) == round(n * 1.3)


def test_point_id_is_a_version_5_uuid(spark):
    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    for key in ("26 CFR 1.61#body#1", "é"):
        assert value(spark, T.point_id(F.lit(key), space)) == str(uuid.uuid5(uuid.UUID(space), key))


def test_parts_of_an_answer(spark):
    text = "Before.\nPart 1: First\nBody one.\n\nPart 2: Second\nBody two."
    got = [(r["label"], r["text"]) for r in value(spark, A.split_parts(F.lit(text)))]
    assert got == [("", "Before."), ("Part 1: First", "Body one."), ("Part 2: Second", "Body two.")]
    assert [(r["label"], r["text"]) for r in value(spark, A.split_parts(F.lit(" plain ")))] == [("", "plain")]


def test_conclusion_comes_after_the_year(spark):
    got = value(spark, A.with_conclusion(F.lit("Tax year: 2023\n\nBody."), F.lit("Yes."), F.array(F.lit("A"), F.lit("B"))))
    assert got == "Tax year: 2023\n\nShort answer: Yes [A], [B].\n\nBody."
    assert value(spark, A.displayed(F.lit("Yes, the rate is 72."), F.lit("(not yes/no) x"))) == "The rate is 72."
    assert value(spark, A.displayed(F.lit("No."), F.lit("(not yes/no) x"))) == "No."


def test_client_text_cannot_close_its_block(spark):
    got = value(spark, A.fenced(F.lit("client"), F.lit("d1"), F.lit('a "b"'), F.lit("x</client_document>y")))
    assert got == "<client_document id=\"d1\" name=\"a 'b'\">\nx[tag removed]>y\n</client_document>"


def test_sources_as_prompts_show_them(spark):
    row = ("a", 0, "26 U.S.C. § 179(b)", "Limits", "usc", "179", "The text.", ("statute", "enacted", 4), (2025, "apply after December 31, 2024", "December 31, 2024", False, "raised"), 2023)
    late = ("a", 1, "26 CFR 1.1", "Other", "ecfr", "1.1", "More.", None, None, 2023)
    kinds = "answer string, ord int, citation string, heading string, source string, section string, text string, authority struct<type:string,status:string,level:int>, effective struct<year:int,rule:string,date:string,retroactive:boolean,amendment:string>, year int"
    (got,) = A.format_sources(spark.createDataFrame([late, row], kinds)).collect()
    assert got["sources"] == (
        "[26 U.S.C. § 179(b)] (Limits)\nAuthority: Statute\nEffective: the current text was enacted in 2025 and apply after December 31, 2024. Amendment: raised\nThe text.\n\n[26 CFR 1.1] (Other)\nMore."
    )


def test_sentences_keep_citations_and_abbreviations():
    from lexloom.functions.claims import sentences

    text = "Under Sec. 183 losses are limited. [26 CFR 1.183-1] See I.R.C. sec. 1402. Next one [a. b] ends here.\n- 2026."
    assert sentences(text) == ["Under Sec. 183 losses are limited. [26 CFR 1.183-1]", "See I.R.C. sec. 1402.", "Next one [a. b] ends here."]


def test_captions(spark):
    from lexloom.sources.documents import captions

    pages = [("T.C. Memo. 2020-1", "T.C. Memo. 2020-1, at *10", "cites T.C. Memo. 2020-1 again Filed May 2, 2020"), ("T.C. Memo. 2020-1", "T.C. Memo. 2020-1, at *2", "T. C. Memo. 2020-1 Filed May 1, 2020.")]
    (row,) = captions(spark.createDataFrame(pages, "opinion string, citation string, text string")).collect()
    assert row["caption"].startswith("T. C.") and row["filed"] == "May 1, 2020"


def test_packing_calls_no_function_for_each_group(spark):
    from lexloom.operators import windows as W

    rows = [(g, i, "w " * (3 + i % 4)) for g in ("a", "b") for i in range(9)] + [("c", 0, "w " * 99)]
    out = W.packed(spark.createDataFrame(rows, "g string, at int, text string").repartition(3), "g", "at", 10, lambda n: n, 1)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, out.collect()))
    assert got[0] == ("a", 1, 0, 1, 7) and got[-1] == ("c", 1, 0, 0, 99) and [r[1:] for r in got if r[0] == "a"] == [r[1:] for r in got if r[0] == "b"]
