"""Answers by scripted models: what replies may hold, what is retried, what a verifier's reply does to an answer."""

import json

import pytest

from lexloom.operators import providers as P
from lexloom.operators import synthesis as Y


def test_schemas_are_strict_and_list_what_may_be_cited(spark):
    allowed = ['26 CFR 1.1(a)', 'a "quoted" one']
    text = spark.range(1).select(Y.schema_of(Y.ANSWER, Y.F.array(*[Y.F.lit(c) for c in allowed]))).first()[0]
    whole = json.loads(text)
    item = whole["properties"]["sentences"]["items"]
    assert whole["required"] == ["tax_year", "sentences", "not_answerable", "conclusion"] and whole["additionalProperties"] is False
    assert item["properties"]["citations"]["items"] == {"type": "string", "enum": allowed}
    assert whole["properties"]["tax_year"]["type"] == ["string", "null"] and item["properties"]["part"]["type"] == "integer"


def test_calls_are_repeated_and_then_given_up():
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return "reply"

    assert P.persistently(call, 3, 0.0) == "reply" and len(tries) == 3
    with pytest.raises(ZeroDivisionError):
        P.persistently(lambda: 1 / 0, 2, 0.0)


def test_items_keep_what_the_sources_have(spark):
    reply = json.dumps({"sentences": [{"part": 2, "text": " One. ", "citations": ["b", "x", "b", "a"]}, {"part": 1, "text": "Two.", "citations": ["x"]}, {"text": "Three.", "citations": ["a"]}, {"part": 1, "text": " ", "citations": ["a"]}], "not_answerable": [{"part": 1, "why": "w"}]})
    rows = spark.createDataFrame([(1, ["a", "b"], reply), (2, ["a"], "[1]"), (3, ["a"], None), (4, ["a"], '{"sentences": 5}')], "answer int, allowed array<string>, reply string")
    assert sorted(map(tuple, Y.items(rows).collect())) == [(1, 0, 2, "One.", ["b", "a"]), (1, 2, 1, "Three.", ["a"])]
    assert [tuple(r) for r in Y.notes(rows).collect()] == [(1, 0, 1, "w")]


def court():
    """A provider that is sent whole, since executors lack this file: it confirms all, except for question 3, whose reply is broken."""

    def make():
        def one(system, prompt):
            if system == Y.VERIFY:
                return None if "q3" in prompt else json.dumps({"verdicts": [{"index": k, "supported": True, "why": ""} for k in range(5)]})
            return json.dumps({"follows": True, "basis": [0], "yes_no_question": True, "why": ""})

        return lambda rows: [one(system, prompt) for system, prompt, _ in rows]

    return make


def test_clients_can_not_state_the_law(spark, monkeypatch):
    monkeypatch.setitem(P.CHATS, "of a court", court())
    kinds = "authority struct<type:string,status:string,level:int>, effective struct<year:int,rule:string,date:string,retroactive:boolean,amendment:string>, year int"
    hits = [(n, 1, o, c, "h", s, "s", t, None, None, None) for n in (1, 2, 3) for o, (c, s, t) in enumerate([("memo, p. 1", "client", "See Notice 2026-41."), ("26 CFR 1.1", "ecfr", "The rule is plain.")])]
    hits = spark.createDataFrame(hits, f"answer int, part int, ord int, citation string, heading string, source string, section string, text string, {kinds}")
    said = lambda first, cite, end: json.dumps({"sentences": [{"part": 1, "text": first, "citations": [cite]}, {"part": 1, "text": "The rule is plain.", "citations": ["26 CFR 1.1"]}], "not_answerable": [{"part": 1, "why": "Notice 2026-41 is not there"}], "conclusion": end})
    replies = [(1, said("By Notice 2026-41 it is so.", "memo, p. 1", "Yes, as notice 2026-41 says.")), (2, said("A memo was sent.", "memo, p. 1", "Yes, plain.")), (3, said("A memo was sent.", "memo, p. 1", "Yes."))]
    replies = spark.createDataFrame(replies, "answer int, reply string").withColumn("allowed", Y.F.array(Y.F.lit("memo, p. 1"), Y.F.lit("26 CFR 1.1")))
    questions = spark.createDataFrame([(n, f"q{n}", None) for n in (1, 2, 3)], "answer int, question string, tax_year string")
    parts = questions.select("answer", Y.F.lit(1).alias("part"), Y.F.lit("all").alias("label"))
    got = {r["answer"]: r for r in Y.checked(questions, parts, hits, replies, "of a court", again=False, wait=0.0).collect()}
    note = "Not in the sources: the client document's legal statements are not supported by the sources."
    # the claim that names a client's law is hidden, so the conclusion rests on the other one
    assert got[1]["text"] == f"Short answer: Yes, as notice 2026-41 says [26 CFR 1.1].\n\nThe rule is plain [26 CFR 1.1]. {note}"
    assert (got[1]["shown"], got[1]["hidden"], got[1]["concluded"]) == (1, 1, True)
    # a conclusion that rests on a client's document alone is not shown
    assert got[2]["text"] == f"A memo was sent [memo, p. 1]. The rule is plain [26 CFR 1.1]. {note}" and not got[2]["concluded"]
    assert (got[3]["text"], got[3]["shown"], got[3]["hidden"]) == (Y.UNVERIFIED, 0, 2)
