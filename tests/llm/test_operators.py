"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom import session
from lexloom.llm import common, exact_dedup, mixing, near_dedup, pii, quality, queries, secret_scan, sentence_pieces, token_counts, token_store, topk
from lexloom.session import materialise
from oracle import spark_rows, sql_rows

ODD = [
    (1, "", "a", "x"),
    (2, None, "a", "x"),
    (3, "the same text here", None, "x"),
    (4, "the same text here", "b", "y"),
    (4, "the same text here", "b", "y"),
    (5, "  \n\t ", "b", None),
    (None, "no id at all", "b", "y"),
    (6, "x" * 300_000, "b", "y"),
    (7, "word " * 60_000, "a", "y"),
    (8, "mail a.b@c.de or +49 (30) 1234-5678, 10.0.0.1 and 4111 1111 1111 1111", "a", "y"),
    (9, "日本語 テキスト é ́ \x00 <|endoftext|>", "c", "y"),
]
SCHEMA = "doc_id long, text string, source string, kept string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return dict(sorted((r["doc_id"], r["text"] or "") for r in docs.collect()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == sql_rows(queries.oracle_sql()[name], sf_dir)


# exact dedup


def brute_groups(rows):
    by = defaultdict(list)
    for doc_id, text in rows:
        text = text or ""
        by[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), doc_id is None, doc_id))
    return {k: (min(v)[2], len(v)) for k, v in by.items()}


def test_exact_dedup_on_odd_rows(odd, empty):
    want = brute_groups((r[0], r[1]) for r in ODD)
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(ODD)
    digests = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert all((r["keep_id"], r["group_size"]) == digests[r["text_sha256"]] for r in got)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_tables_that_spill_give_the_same_groups():
    rng = random.Random(3)
    rows = [(rng.choice("abcdefgh") * rng.randint(0, 400), rng.randint(0, 500), rng.choice([None, *range(50)]), 1) for _ in range(3000)]
    key = lambda g: (g[0], g[1], -1 if g[2] is None else g[2], g[3])
    records = [(t.encode(), n, d, k) for t, n, d, k in rows]
    whole = sorted(map(key, exact_dedup.grace_groups(iter(records))))
    assert whole == sorted(map(key, exact_dedup.grace_groups(iter(records), most_bytes=2000)))
    assert len(whole) == len({t for t, *_ in records})


# near dedup


def brute_components(rows, words, percent):
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = {}
    for i, t in rows:
        w = t.encode().translate(lower).split()
        k = min(words, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup_equals_brute_force(docs, texts, words):
    assert near_rows(near_dedup.near_dedup(docs, words, 80)) == brute_components(texts.items(), words, 80)


def test_near_dedup_of_a_family_around_the_threshold(spark):
    """Copies of one text with more and more changes: links, chains of links and near misses."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for j in rng.sample(range(120), i % 20):
            words[j] = f"v{i}x{j}"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    got = near_rows(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80))
    assert got == brute_components(rows, 2, 80)
    assert len({c for _, c in got.values()}) > 5


def test_near_dedup_on_odd_rows(odd, empty):
    got = near_dedup.near_dedup(odd, 2, 80).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert (by[4]["component_id"], by[3]["component_id"], by[4]["kept"]) == (3, 3, False)
    assert [by[i]["n_shingles"] for i in (1, 2, 5, 6, 7)] == [0, 0, 0, 1, 1]
    assert by[None]["component_id"] is None and by[1]["component_id"] == 1
    assert near_dedup.near_dedup(empty, 2, 80).count() == 0


def test_rows_that_repeat_an_id_link_their_texts(spark):
    """The texts of one doc_id are one node, so what is like either is in its component."""
    a, b, c = "alpha beta gamma delta", "one two three four", "red green blue black"
    rows = [(3, a), (5, a), (5, b), (7, b), (7, c), (9, c), (11, "something else again here"), (3, a)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (9, 3, False), (11, 11, True)}


def test_components_of_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, write = [], near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df, label: rounds.append(label) or write(df, label))
    chain = [(i, i + 1) for i in range(1000)] + [(2000 + i, 2000) for i in range(1, 300)] + [(5000, 5001), (5001, 5001)]
    got = {r["id"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1001)}, **{2000 + i: 2000 for i in range(300)}, 5000: 5000, 5001: 5000}
    assert rounds.count("step") <= 20


def test_signature_coordinates_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000, np.uint64))
    b = np.unique(np.concatenate([a[:2400], rng.integers(0, 2**63, 600, np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - true) < 0.12


# tokenizers


@pytest.fixture(scope="session")
def counter():
    return token_counts.PrefixCounter(queries.tokenizer("byte_bpe_50k.json"))


ALPHABET = "ab e'\n\t  sréllvé1!?ß日本\x00\x1c▁İſ"


def test_prefix_counts_equal_the_library(counter):
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice([*ALPHABET, "<|endoftext|>", "'re", "  ", "the", "\n\n"]) for _ in range(rng.randint(0, 14)))
        want = [len(counter.library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.prefix_counts(text) == want
        assert counter.count(text) == want[-1]
        limit = rng.randint(1, 6)
        assert counter.truncated(text, limit) == max(k for k, n in enumerate(want) if n <= limit)


def test_prefixes_of_special_strings_take_linear_time(counter):
    text = "<|endoftext|>" * 23_000
    since = time.process_time()
    counts = counter.prefix_counts(text)
    assert time.process_time() - since < 5 and len(counts) == len(text) + 1 and counts[-1] == 23_000
    small = "<|endoftext|>é<|endoftext|> a<|endoftext"
    assert counter.prefix_counts(small) == [len(counter.library.encode(small[:k], add_special_tokens=False).ids) for k in range(len(small) + 1)]


def test_token_counts_of_documents(docs, texts, odd, empty, counter):
    path = queries.tokenizer("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, path).collect()}
    for (i, t), e in zip(texts.items(), counter.library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True):
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (len(e.ids), len(t.encode()), len(e.ids) > 1024)
    rows = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(odd, path).collect())
    assert rows == Counter((i, len((t or "").encode()), n, n > 1024) for i, t, *_ in ODD for n in [len(counter.library.encode(t or "", add_special_tokens=False).ids)])
    assert token_counts.count_tokens(empty, path).count() == 0


def test_coded_blocks_come_back():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 400_000), 49_999).astype(np.uint32)
    ans = token_store.Ans(token_store.scaled(np.bincount(ids, minlength=50_000)))
    for n in (0, 1, 7, 5000, 300_001):
        payload = ans.encode(ids[:n])
        assert (ans.decode(payload) == ids[:n]).all()
        checks = int.from_bytes(payload[12:16], "little")
        assert (np.concatenate([ans.decode(payload, k) for k in range(checks + 1)]) == ids[:n]).all()
    assert checks > 0


def test_store_holds_what_the_library_gives(spark, docs, texts, odd, tmp_path):
    path = queries.tokenizer("word_bpe_49k.json")
    library = token_store.UnitIds(path).library
    token_store.write_store(docs, path, str(tmp_path / "a"), end=2)
    got = {r["doc_id"]: r for r in token_store.read_store(spark, str(tmp_path / "a")).collect()}
    start = 0
    for (i, _), e in zip(texts.items(), library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_store.write_store(odd, path, str(tmp_path / "b"), end=2)
    held, start = token_store.read_store(spark, str(tmp_path / "b")).collect(), 0
    for r in sorted(held, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    want = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t, *_ in ODD]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in held) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    assert [r["doc_id"] for r in sorted(held, key=lambda r: r["start"])] == sorted((r[0] for r in ODD), key=lambda i: (i is not None, i))


def test_some_documents_are_read_from_their_checkpoints(spark, docs, texts, tmp_path, monkeypatch):
    path = queries.tokenizer("word_bpe_49k.json")
    library = token_store.UnitIds(path).library
    token_store.write_store(docs, path, str(tmp_path / "a"), end=2)
    wanted = docs.where("doc_id % 7 = 3").select("doc_id").union(docs.limit(1).select((F.col("doc_id") * 0 - 5).alias("doc_id")))
    got = {r["doc_id"]: r["ids"] for r in token_store.ids_of(spark, str(tmp_path / "a"), wanted).collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items() if i % 7 == 3}
    assert token_store.ids_of(spark, str(tmp_path / "a"), wanted.limit(0)).count() == 0


def test_ranges_of_a_block_decode_alone():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, 1_000_000), 999).astype(np.uint32)
    ans = token_store.Ans(token_store.scaled(np.bincount(ids, minlength=1000)))
    payload, decoded = ans.encode(ids), []
    plain = ans.decode
    ans.decode = lambda p, part=None: decoded.append(part) or plain(p, part)
    n = len(ans.firsts(payload))
    assert n > 3
    for since, until in [(0, 1), (0, len(ids)), (270_000, 270_100), (262_143, 262_145), (999_990, 1_000_000), (5, 5), *[tuple(sorted(rng.integers(0, len(ids), 2).tolist())) for _ in range(20)]]:
        decoded.clear()
        assert (ans.between(payload, since, until) == ids[since:until]).all()
        assert len(decoded) <= (until - since) // int(ans.firsts(payload)[1]) + 2


def test_damage_is_noticed(spark, docs, tmp_path):
    path = str(tmp_path / "c")
    token_store.write_store(docs, queries.tokenizer("word_bpe_49k.json"), path)
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.withColumn("payload", F.concat(F.col("payload"), F.lit(b"\x00"))).write.parquet(f"{path}/broken/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{path}/broken/table")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_store(spark, f"{path}/broken").collect()


def test_unit_ids_equal_the_library():
    coder, rng = token_store.UnitIds(queries.tokenizer("word_bpe_49k.json")), random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice([*ALPHABET, "<|startoftext|>", "ÀÉΣ", " ́", "Word.", "Ende, "]) for _ in range(rng.randint(0, 14)))
        ids, ends = coder.encode(pa.array([text, "", text]))
        want = coder.library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want + want and ends.tolist() == [len(want), len(want), 2 * len(want)]


def test_pieces_equal_the_library_and_cover_the_source(docs, texts, odd, empty):
    path = queries.tokenizer("piece_bpe_32k.model")
    coder, rng = sentence_pieces.PieceCoder(path), random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        assert coder.encode([text])[0] == coder.library.encode(text)
        assert b"".join(text.encode()[s:e] for _, s, e in coder.spans(text)) == text.encode()
    got = {r["doc_id"]: r for r in sentence_pieces.encode_decode(docs, path).collect()}
    for i, t in texts.items():
        ids = coder.library.encode(t)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(coder.library.decode(ids).encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["n_span_bytes"]) == (len(ids), len(t.encode()))
    said = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    want = [(i, t or "", coder.library.encode(t or "")) for i, t, *_ in ODD]
    found = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["n_span_bytes"]) for r in sentence_pieces.encode_decode(odd, path).collect())
    assert found == Counter((i, len(ids), said(ids), hashlib.sha256(coder.library.decode(ids).encode()).hexdigest(), len(t.encode())) for i, t, ids in want)
    assert sentence_pieces.encode_decode(empty, path).count() == 0
    (row,) = sentence_pieces.with_pieces(odd.where("doc_id = 8"), path).collect()
    assert row["pieces"][-1]["end"] == len(ODD[9][1].encode())


def test_character_map_takes_the_longest_entry():
    """A two-entry double array: a -> X, ab -> YZ."""
    import struct

    def leaf(value):
        return 1 << 31 | value

    units = [0] * 512
    units[0] = 256 << 10  # root: children at 256 ^ byte
    a = 256 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | ((a ^ 400) << 10)
    units[400] = leaf(0)
    b = 400 ^ ord("b")
    units[b] = ord("b") | 1 << 8 | ((b ^ 300) << 10)
    units[300] = leaf(2)
    blob = struct.pack("<512I", *units)
    table = sentence_pieces.CharacterMap(struct.pack("<I", len(blob)) + blob + b"X\0YZ\0")
    assert table.longest(b"abc", 0) == (b"YZ", 2)
    assert table.longest(b"ac", 0) == (b"X", 1)
    assert table.longest(b"ca", 0) is None


# scans


def brute_pii(x):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(d):
        s = 0
        for k, c in enumerate(d[::-1]):
            v = int(c) * (2 if k % 2 else 1)
            s += v - 9 if v > 9 else v
        return s % 10 == 0

    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii_base_spans(docs, texts, odd, empty):
    got = {r["doc_id"]: r for r in pii.scan_pii(docs).collect()}
    assert all(got[i]["base_sha256"] == hashlib.sha256(brute_pii(t).encode()).hexdigest() for i, t in texts.items())
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "@", ".", "-", "1", "255", "+4", " ", "(", "4111111111111111", "b@c.d", "é"]) for _ in range(rng.randint(0, 16)))
        found = [f"{k}:{s}:{e}" for k, s, e, _ in pii.find_pii(text) if k in pii.KINDS[: pii.BASE]]
        assert ",".join(found) == brute_pii(text)
    found = Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_card"]) for r in pii.scan_pii(odd).collect())
    want = [(i, brute_pii(t or "")) for i, t, *_ in ODD]
    assert found == Counter((i, hashlib.sha256(b.encode()).hexdigest(), b.count("email"), b.count("card")) for i, b in want)
    assert pii.scan_pii(empty).count() == 0


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1." * 300_000, "+1 " * 300_000, "A1B2 " * 150_000, "a-" * 300_000 + "@" + "b-" * 200_000, "1 " * 400_000])
def test_pii_in_long_runs_takes_linear_time(text):
    since = time.process_time()
    pii.find_pii(text)
    assert time.process_time() - since < 4


def test_pii_beyond_the_base():
    text = "IBAN DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01; ssn 123-45-6789"
    kinds = Counter(k for k, *_ in pii.find_pii(text))
    assert kinds["iban"] == 1 and kinds["nid"] == 1
    assert not [k for k, *_ in pii.find_pii("call 123-45-6789") if k == "nid"]
    assert pii.redact_pii("x a@b.cd y") == "x <email> y"


def brute_secrets(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secret_base_spans(docs, texts, odd, empty):
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(docs).collect()}
    assert all(got[i]["base_sha256"] == hashlib.sha256(brute_secrets(t).encode()).hexdigest() for i, t in texts.items())
    novelty, rng = secret_scan.Novelty(), random.Random(7)
    for _ in range(2000):
        text = "".join(rng.choice(["Token", "=", ": ", '"', "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ſecret", " ", "é"]) for _ in range(rng.randint(0, 12)))
        found = [f"{k}:{s}:{e}" for k, s, e in secret_scan.find_secrets(text, novelty) if k != "novel"]
        assert ",".join(found) == brute_secrets(text)
    found = Counter((r["doc_id"], r["base_sha256"]) for r in secret_scan.scan_secrets(odd).collect())
    assert found == Counter((i, hashlib.sha256(brute_secrets(t or "").encode()).hexdigest()) for i, t, *_ in ODD)
    assert secret_scan.scan_secrets(empty).count() == 0


def test_novel_strings_cost_their_bytes():
    novelty = secret_scan.Novelty()
    random_key, plain = "q9Zx3vT7bLk2Wm8Rj5Np", "configuration1connection2"
    found = secret_scan.find_secrets(f"private signing key {random_key} end", novelty)
    assert [k for k, *_ in found] == ["novel"]
    assert not secret_scan.find_secrets(f"private signing key {plain} end", novelty)


# quality


def test_quality_on_held_out_labels(spark, sf_dir, odd, empty):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], want[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in want]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95
    none = labels.where("false")
    assert {r["score"] for r in quality.quality_scores(odd, none).collect()} == {0.5}
    got = quality.quality_scores(odd, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(round(r["score"], 12))
        assert r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
        assert r["doc_id"] is None or r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert all(len(v) == 1 for v in by.values())  # rows that repeat an id and a text repeat their score
    assert by[1] == by[2] and by[3] == by[4]  # null is empty; equal texts have equal scores whatever their ids
    clashing = odd.withColumnsRenamed({"source": "score", "kept": "predicted"})
    assert {(r["doc_id"], round(r["score"], 12)) for r in quality.quality_scores(clashing, labels).collect()} == {(i, x) for i, v in by.items() for x in v}
    assert quality.quality_scores(empty, none).count() == 0


def by_definition(y, w):
    """The nearest increasing sequence: at each place the greatest mean that starts before of the least mean that ends after."""
    mean = lambda a, b: y[a:b] @ w[a:b] / w[a:b].sum()
    return np.array([max(min(mean(a, b) for b in range(k + 1, len(y) + 1)) for a in range(k + 1)) for k in range(len(y))])


def test_isotonic_is_the_nearest_increasing_sequence():
    rng = np.random.default_rng(3)
    for n in (1, 2, 40):
        x, w = np.arange(float(n)), rng.integers(1, 9, n).astype(float)
        y = x / n + rng.normal(0, 0.3, n)
        at, level = quality.isotonic(x, y, w)
        assert (np.diff(level) > 0).all()
        want = by_definition(y, w)
        assert np.allclose(np.unique(want.round(12)), np.unique(level.round(12)))
        assert np.allclose([np.average(x[want.round(12) == v], weights=w[want.round(12) == v]) for v in np.unique(want.round(12))], at)


def test_scores_equal_a_dense_ridge(spark, sf_dir):
    """The summed equations against one solved matrix of the same features, calibrated by definition."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    x = materialise(quality.measured(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")), "test")
    model = quality.fit(x, labels)
    y = {r["doc_id"]: float(r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    rows = [(r["doc_id"], np.array(r["x"])) for r in x.collect()]
    known = [(i, v) for i, v in rows if i in y]
    every = np.stack([v for _, v in known])
    assert np.allclose(model.mean, every.mean(axis=0)) and np.allclose(model.scale, np.maximum(every.std(axis=0), 1e-3), atol=1e-6)
    held = np.array([(zlib.crc32(str(i).encode()) // 3) % 4 == 0 for i, _ in known])
    target = np.array([y[i] for i, _ in known])
    z = model.features(every)
    d = z.shape[1]
    penalty = np.full(d, quality.RIDGE * (~held).sum() / quality.FEATURES * 10)
    penalty[-1] = 1e-9
    tall = np.vstack([z[~held], np.diag(np.sqrt(penalty))])
    beta = np.linalg.lstsq(tall, np.concatenate([target[~held], np.zeros(d)]), rcond=None)[0]
    assert np.allclose(z @ beta, model.raw(every), atol=1e-5)
    k = np.clip((z[held] @ beta + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    used = np.unique(k)
    want = by_definition(np.array([target[held][k == b].mean() for b in used]), np.array([(k == b).sum() for b in used], float))
    assert np.allclose(np.unique(want.round(9)), np.unique(model.knots[1].round(9)), atol=1e-6)


# mixing


def test_mixing_meets_its_targets(spark, docs, odd, empty):
    rows = mixing.mix(docs, repeats=2.0, budget=1.0).collect()
    total, spent, largest = sum(r["n_tokens"] for r in rows), Counter(), Counter()
    weight = {r["source"]: r["weight"] for r in rows}
    for r in rows:
        spent[r["source"]] += r["n_tokens"] * r["n_copies"]
        largest[r["source"]] = max(largest[r["source"]], r["n_tokens"])
    assert all(w * total - largest[s] < spent[s] <= w * total + 0.01 for s, w in weight.items())
    target = math.log(len({r["source"] for r in rows})) - 0.001
    sized = docs.select(F.concat(F.lit("="), "source").alias("name"), F.regexp_count("text", F.lit(mixing.WORD)).cast("long").alias("n_tokens"))
    w = [r["weight"] for r in mixing.source_weights(sized, entropy=target, repeats=None, budget=1.0).collect()]
    assert abs(-sum(p * math.log(p) for p in w) - target) < 1e-6 and abs(sum(w) - 1) < 1e-9
    got = mixing.mix(odd).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["n_tokens"]) for r in got) == Counter((i, src, words(t)) for i, t, src, _ in ODD)
    weights = {r["source"]: r["weight"] for r in got}
    assert min(weights.values()) > 0 and None in weights and abs(sum(weights.values()) - 1) < 1e-9
    clashing = odd.withColumnRenamed("kept", "n_tokens")
    assert Counter((r["doc_id"], r["n_copies"]) for r in mixing.mix(clashing).collect()) == Counter((r["doc_id"], r["n_copies"]) for r in got)
    assert mixing.mix(empty).count() == 0


def test_mixing_can_lose_nothing(spark):
    rows = [(i, "w " * 10, "big" if i < 800 else f"s{i % 4}") for i in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), repeats=1.5, budget=None).collect()
    copies = defaultdict(set)
    for r in got:
        copies[r["source"]].add(r["n_copies"])
    assert copies["big"] == {1} and all(min(c) >= 1 and max(c) <= 2 for c in copies.values())
    small = [r["n_copies"] for r in got if r["source"] != "big"]
    assert abs(sum(small) / len(small) - 1.5) < 0.1


# search


def test_search_on_odd_rows(spark, odd, empty):
    asked = odd.where("doc_id is not null").withColumnRenamed("doc_id", "query_id")
    got = topk.search(topk.build_index(odd), asked, k=3).collect()
    assert {r["query_id"] for r in got} == {3, 4, 6, 7, 8, 9}
    assert_same_best(best_of(topk.search(topk.build_index(odd), asked.distinct(), k=3)), brute_best([r[:2] for r in ODD], {(r[0], r[1]) for r in ODD if r[0] is not None}, 3))
    assert topk.search(topk.build_index(empty), asked, k=3).count() == 0
    assert topk.search(topk.build_index(odd), asked.where("false"), k=3).count() == 0


def brute_best(docs, asked, k):
    """The k best (doc_id, score) of each of asked (id, text)."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(i, Counter(words(t))) for i, t in docs]
    n, mean, df = len(docs), sum(sum(c.values()) for _, c in counts) / len(docs), Counter(t for _, c in counts for t in c)
    out = {}
    for q, text in asked:
        found = []
        for i, c in counts:
            length = sum(c.values())
            score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t in set(words(text)) if t in c)
            if round(score, 6) > 0:
                found.append((-round(score, 6), i is None, i))
        if found:
            out[q] = [(i, -s) for s, _, i in sorted(found)[:k]]
    return out


def best_of(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["doc_id"], r["score"]))
    return dict(out)


def assert_same_best(got, want):
    assert got.keys() == want.keys()
    for q, hits in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in hits]
        assert np.allclose([s for _, s in got[q]], [s for _, s in hits], atol=2e-6)


@pytest.mark.parametrize("together", [1 << 25, 1 << 13])
def test_pruned_shards_give_the_exact_best(spark, monkeypatch, together):
    """Several shards and blocks of queries, ties across shards, repeated texts, null ids."""
    rng, n = random.Random(8), 1500
    docs = [(i, " ".join(rng.choice(["the", "of", f"w{int(rng.paretovariate(0.6)) % 5000}"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    docs += [(n + i, docs[7 * (i % 40)][1]) for i in range(300)] + [(None, docs[0][1]), (None, "the of")] + [(3000 + i, "same words here") for i in range(30)]
    rng.shuffle(docs)
    monkeypatch.setattr(topk, "GROUP_BYTES", 1 << 14)
    monkeypatch.setattr(topk, "QUERY_BYTES", together)
    asked = rng.sample([d for d in docs if d[0] is not None], 60) + [(9001, "same words"), (9002, "nothing_of_this zzz"), (9003, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    index = topk.build_index(df)
    assert index.count() > 10
    got = best_of(topk.search(index, spark.createDataFrame(asked, "query_id long, text string"), k=10))
    assert_same_best(got, brute_best(docs, asked, 10))


def test_counted_terms():
    texts = ["The the THE 3rd", "", "naïve-naïve  \x00é", "the"]
    found = topk.counted([t.encode() for t in texts])
    name = lambda w: __import__("xxhash").xxh3_64_intdigest(w.encode())
    want = {(0, name("the")): 3, (0, name("3rd")): 1, (2, name("naïve")): 2, (2, name("é")): 1, (3, name("the")): 1}
    assert {(d, t): n for d, t, n in zip(found.doc.tolist(), found.term.tolist(), found.tf.tolist(), strict=True)} == want
    assert found.lengths.tolist() == [4, 0, 3, 1]


def test_limits_are_read_from_the_counts_of_pieces(counter):
    """Texts that spaces alone don't part: the limit is found from the counts of their pieces as from all prefixes."""
    rng = random.Random(12)
    parts = ["a", " ", "  ", "\n", "\n\n", "'re", "'ll", "日本", "é", "12", "x" * 30, " \n", "\t", "word", "!", "...", "<|endoftext|>"]
    for _ in range(1500):
        text, limit = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25))), rng.randint(1, 12)
        counts = counter.prefix_counts(text)
        assert counts[-1] == len(counter.library.encode(text, add_special_tokens=False).ids)
        assert counter.truncated(text, limit) == max(k for k, n in enumerate(counts) if n <= limit)


def test_what_a_worker_remembers_stays_small(counter):
    rng = random.Random(13)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(400)) for _ in range(300)]
    for t in texts:
        counter.count(t)
    assert not any(len(u) > 64 for u in counter.memo.known) and not any(len(p) > 64 for p in counter.small)
    memo = common.Memo(lambda new: [len(u) for u in new], 10)
    assert memo.values(["a" * 65, "b"]) == [65, 1] and list(memo.known) == ["b"]
    assert memo.values(["a" * 65, "b"]) == [65, 1]


def test_token_store_of_an_empty_table(spark, empty):
    path = session.new_path(spark, "tokens")
    token_store.write_store(empty.select("doc_id", "text"), queries.tokenizer("word_bpe_49k.json"), path, end=2)
    assert token_store.read_store(spark, path).count() == 0


def test_blocks_of_queries_are_searched_abreast_and_every_task_has_a_part_of_the_first_wave(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_BYTES", 2000)
    monkeypatch.setattr(topk, "QUERY_BYTES", 1200)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(5, 25)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index = topk.build_index(docs)
    numbers = {}
    for r in index.select("task", "number").collect():
        numbers.setdefault(r["task"], []).append(r["number"])
    assert len(numbers) == 4 and all(sorted(held) == list(range(1, len(held) + 1)) and len(held) > 4 for held in numbers.values())
    files = index.select(F.input_file_name().alias("file")).groupBy("file").count().collect()
    assert max(r["count"] for r in files) <= topk.FILE_SHARDS
    labels, write = [], topk.materialise
    monkeypatch.setattr(topk, "materialise", lambda df, label, **options: labels.append(label) or write(df, label, **options))
    asked = docs.where("doc_id % 6 = 0").withColumnRenamed("doc_id", "query_id")
    got = topk.search(index, asked, k=3).cache()
    blocks = -(-asked.rdd.map(lambda r: 8 * len(set(r["text"].split()))).sum() // topk.QUERY_BYTES)
    assert blocks > topk.ABREAST and labels.count("hits") == 2 * -(-blocks // topk.ABREAST)
    assert_same_best(best_of(got), brute_best(rows, {r for r in rows if r[0] % 6 == 0}, 3))
