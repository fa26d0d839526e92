"""What reviews found missing: each query and stage does its method's whole job."""

import hashlib
import random
import string

import corpus_pipeline
from lexloom.llm import pii, queries, secret_scan, sentence_pieces

PROSE = (
    "She went to see whether any of the boats had come back, for it was late, and a wind had risen from the north. Nobody answered; "
    "the quay was dark. He would have asked the keeper, but the keeper slept, and so the matter rested until Monday, when four men "
    "arrived by train with a chest of tools and began to dig."
)
PIECES = ["a▁b ▁", "two  spaces é", " led\nby one", "plain words\n\nand a line", "日本 x", "", None, "plain words again"]


def test_pieces_of_query_and_stage_have_source_spans(spark, tmp_path):
    path = queries.tokenizer("piece_bpe_32k.model")
    docs = spark.createDataFrame(list(enumerate(PIECES)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in sentence_pieces.encode_decode(docs, path).collect()}
    coder = sentence_pieces.PieceCoder(path)
    rows = corpus_pipeline.stage_pieces(spark, docs, "").collect()
    assert len(rows) == len(PIECES)
    for r in rows:
        held = (r["text"] or "").encode()
        assert got[r["doc_id"]]["n_span_bytes"] == r["n_span_bytes"] == len(held)
        ids = [p["id"] for p in r["pieces"]]
        assert ids == coder.library.encode(r["text"] or "") and len(ids) == r["n_tokens"]
        assert r["ids_sha256"] == got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        at = 0
        for p in r["pieces"]:
            said = coder.said[p["id"]].replace("▁".encode(), b" ")
            source = held[p["begin"] : p["end"]].replace("▁".encode(), b" ")
            assert p["begin"] == at and (source == said or at == 0 and b" " + source == said)
            at = p["end"]
        assert at == len(held)


def test_long_keys_of_any_alphabet_are_novel():
    novelty, rng = secret_scan.Novelty(), random.Random(9)
    upper, digits = string.ascii_uppercase, string.digits
    alphabets = {"base64": (string.ascii_letters + digits + "+/", (32, 256, 1600, 4000)), "hex": (digits + "ABCDEF", (64, 128, 256, 1600)), "base32": (upper + "234567", (64, 256, 1600)), "lower": (string.ascii_lowercase + digits, (128, 256, 1600)), "letters": (string.ascii_letters, (64, 256)), "digits": (digits, (32, 256))}
    for around in ("", PROSE):
        for name, (letters, sizes) in alphabets.items():
            for n in sizes:
                key = "".join(rng.choice(letters) for _ in range(n))
                text = f"{around} token {key} {around}"
                at = text.index(key)
                assert ("novel", at, at + n) in secret_scan.find_secrets(text, novelty), (name, n)
    key = "q9Zx3vT7bLk2Wm8Rj5Np"
    assert ("novel", 8, 28) in secret_scan.find_secrets(f"key-pad={key} end", novelty)
    for plain in ("the secret of internationalization is", "token counterrevolutionaries", "secret configurationManagerFactory", "token /usr/local/lib/python/site-packages/thing"):
        assert not secret_scan.find_secrets(plain, novelty)


def test_very_long_keys_are_reported_to_their_end():
    novelty, rng = secret_scan.Novelty(), random.Random(10)
    key = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(20_000)) + "=="
    text = f"private {key} end, token nothing here"
    found = secret_scan.find_secrets(text, novelty)
    assert ("novel", 8, 8 + len(key)) in found and all(e == 8 + len(key) for k, _, e in found if k == "novel")
    assert not secret_scan.find_secrets("token" * 20_000, novelty)


def test_context_after_a_span_and_ibans_before_a_word():
    assert [(k, s, e) for k, s, e, _ in pii.find_pii("123-45-6789 (SSN)")] == [("nid", 0, 11)]
    for text, spans in (("BE68 5390 0754 7034 BANK", [(0, 19)]), ("BE68 5390 0754 7034 DE89 3704 0044 0532 0130 00", [(0, 19), (20, 47)])):
        assert [(s, e) for k, s, e, _ in pii.find_pii(text) if k == "iban"] == spans
