"""Publications, opinions, question sets and statute notes on small cases."""

import json

from pyspark.sql import functions as F

from lexloom.sources import documents as D


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_titles_and_years(spark):
    title = lambda s, n: value(spark, D.title(F.lit(s), F.lit(n)))
    first = "Publication 587 Business Use of Your Home For use in preparing 2025 Returns"
    assert title(first, "587") == "Publication 587 Business Use of Your Home"
    assert value(spark, D.edition_year(F.lit(first))) == "2025"
    assert title("Your Federal Income Tax For Individuals Publication 17 For use in preparing 2025 Returns", "17") == "Publication 17 Your Federal Income Tax For Individuals"
    assert title("Publication 946 How To Depreciate Property • Section 179 Deduction • MACRS", "946") == "Publication 946 How To Depreciate Property"
    assert title("no recognisable title here", "463") == "Publication 463"


def test_artifacts_go(spark):
    for s in ("Userid: CPM Schema: tipx Pt. size: 10 real text", "MUST be removed before printing. real text", "13:01 - 27-Feb-2026 real text"):
        assert value(spark, F.trim(F.regexp_replace(F.lit(s), D.ARTIFACTS, ""))) == "real text"


def test_publication_chunks(spark):
    body = " ".join(f"w{i}" for i in range(300))
    head = "Publication 587 Business Use of Your Home For use in preparing 2025 Returns"
    lines = lambda i: [f"Printed header {i}", head, "abc"[i - 1] * 3, *[body] * (i < 3), "middle", *"pqr"[i - 1], "xyz"[i - 1] * 2, "IRS.gov footer", f"Page {i}"]
    pages = [("587", i, "\n".join(lines(i))) for i in (1, 2, 3)]
    rows = D.publication_chunks(spark.createDataFrame(pages, "doc string, page int, text string")).orderBy("page", "part").collect()
    assert [(r["page"], r["part"], r["excluded"]) for r in rows] == [(1, 1, None), (1, 2, None), (2, 1, None), (2, 2, None), (3, 1, "extraction_failed")]
    assert rows[0]["citation"].startswith("IRS Pub 587") and not any("header" in r["text"] or "footer" in r["text"] for r in rows)
    assert rows[4]["text"] == "[page 3: extraction produced 4 words]"


def test_opinions_from_boxes(spark):
    words = " ".join(["word"] * 150)
    boxes = [("o", 1, 700.0, 720.0, 18.0, "MASTHEAD"), ("o", 1, 500.0, 600.0, 12.0, "first " + words), ("o", 1, 400.0, 480.0, 12.0, "(1)"), ("o", 1, 300.0, 390.0, 12.0, "second " + words), ("o", 1, 20.0, 60.0, 9.0, "a note"), ("o", 2, 500.0, 600.0, 12.0, "third " + words), ("o", 2, 10.0, 15.0, 12.0, "- 2 -")]
    paras = D.paragraphs(spark.createDataFrame(boxes, "doc string, page int, y0 double, y1 double, size double, text string"))
    assert [r["text"].split()[0] for r in paras.orderBy("seq").collect()] == ["first", "(1)", "second", "a", "third"]
    ops = spark.createDataFrame([("o", "T.C. Memo. 2020-1", "A B, Petitioner"), ("p", "T.C. Memo. 2020-2", "C, Petitioner")], "doc string, citation string, caption string")
    rows = D.opinion_chunks(paras, ops).orderBy("section", "citation").collect()
    assert [(r["citation"], r["excluded"]) for r in rows] == [("T.C. Memo. 2020-1, at *1", None), ("T.C. Memo. 2020-1, at *1-2", None), ("T.C. Memo. 2020-2", "no_text")]
    assert rows[0]["heading"] == "A B v. Commissioner" and "\n(1) second" in rows[0]["text"] and rows[1]["text"].startswith("a note") or rows[1]["text"].startswith("(1) second")


def test_question_sets(spark, tmp_path):
    rows = [{"id": "a", "question": "q", "scorable": True, "gold": ["x", ["y", "z"]]}, {"id": "b", "question": "r", "scorable": False, "gold": []}, {"id": "c", "question": "s", "scored_from": "B", "gold": []}, {"id": "d", "question": "t", "scored_from": "C", "gold": []}]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = D.questions(spark, str(tmp_path / "q.jsonl"), ["A", "B"])
    assert [(r["id"], r["gold"]) for r in got.orderBy("id").collect()] == [("a", [["x"], ["y", "z"]]), ("c", [])]
    plans = spark.createDataFrame([("q", 0)], "question string, plan_set int")
    assert D.missing_plans(got, plans, 2).count() == 3
    (tmp_path / "titles.json").write_text(json.dumps({"titles": [{"number": 25, "up_to_date_as_of": "2026-01-01"}, {"number": 26, "up_to_date_as_of": "2026-02-02"}]}))
    assert D.latest_snapshot(spark, str(tmp_path / "titles.json")).first()[0] == "2026-02-02"
