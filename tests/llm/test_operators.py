"""The ten operators against brute force, round trips and held-out labels; nulls, ties, repeats, empty tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, chat, decontaminate, exact_dedup, narrowing, near_dedup, pretokens, quality, suffix_dedup, textbytes, token_counts, token_files, tokens, warc
from corpusmill.llm.components import connected_components
from corpusmill.llm.pretokens import Pieces
from corpusmill.llm.store import new_path
from corpusmill.llm.textbytes import Fingerprints, text_buffers, words

public = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BYTE_BPE, WORD_BPE = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
CLASH = "kept string, score string, text_sha256 string, key long, th long, did long, node long, same long, weight long, size long"


def lower(text):
    return (text or "").encode().lower().decode()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta's", "é", "zwölf", "7", "of", "the"]) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(300, 1)
    near = base.replace(" ", "  ", 5).replace("alpha", "omega", 2)
    passage = prose(80, 2)
    texts = [
        (0, base), (1, base.upper()), (2, near), (3, None), (4, ""), (5, "one two"), (6, "One  TWO"), (7, prose(40, 3) + " " + passage), (8, passage + " " + prose(60, 4)),
        (9, "x" * 3000), (10, "\n\n \t"), (11, prose(30, 5)), (11, prose(30, 5)), (12, passage), (None, prose(20, 6)), (None, None), (13, "<|endoftext|> it's I'LL x<|startoftext|>'s 12½"), (14, "日本語 Ünïcode ΣΑΣ İ '' ''s"),
    ]
    return texts


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = ["z"] * 3 + [1] * 7
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], f"doc_id long, text string, {CLASH}")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_words_and_fingerprints():
    texts = ["", "Ab1 c-É", "é", " x ", "x"]
    hashes, row, first = words(*text_buffers(pa.array(texts)))
    assert [int((row == i).sum()) for i in range(5)] == [len(WORD.findall(lower(t))) for t in texts]
    assert hashes[-1] == hashes[-2] and len(set(hashes.tolist())) == len(hashes) - 1
    data = np.frombuffer(b"abcabcab", np.uint8)
    at = Fingerprints(data).of(np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert at[0] == at[1] != at[2]


# 1


def shingle_counts(text):
    w = WORD.findall(lower(text))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def test_signatures_estimate_weighted_similarity():
    texts = [prose(200, 10), prose(200, 10).replace("the", "a", 4), prose(200, 11), "same same same same same same same"]
    element, row, _ = near_dedup.shingles(pa.array(texts))
    sign = near_dedup.dart_minhash(*near_dedup.unit_cells(element, row), None, len(texts), 120)
    real = [shingle_counts(t) for t in texts]
    for i in range(3):
        for j in range(i):
            assert abs((sign[i] == sign[j]).mean() - similarity(real[i], real[j])) < 0.18
    half = near_dedup.dart_minhash(np.array([1, 2, 1], np.uint64), np.array([0, 0, 1]), np.array([1.0, 0.5, 1.0]), 2, 400)
    assert abs((half[0] == half[1]).mean() - 1 / 1.5) < 0.1


def test_near_groups_equal_brute_force(spark, docs, empty, rows):
    known = [(i, shingle_counts(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in known}
    for _ in known:
        for i, a in known:
            for j, b in known:
                if similarity(a, b) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    got = near_dedup.near_dedup(docs).collect()
    assert {(r.doc_id, r.group_id) for r in got} == set(label.items()) and all(r.kept == (r.doc_id == r.group_id) for r in got)
    assert near_dedup.near_dedup(empty).count() == 0
    kept = near_dedup.keep_one_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(label.values()) | {None}


def test_no_link_is_lost_in_a_straddling_bucket(spark):
    """Near copies of one text whose pairs lie on both sides of the threshold."""
    rng = random.Random(3)
    base = prose(220, 20).split()
    texts = []
    for i in range(60):
        own = base[:]
        for _ in range(rng.choice((2, 5, 9))):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    count = [shingle_counts(t) for t in texts]
    label = list(range(60))
    links = [(i, j) for i in range(60) for j in range(i) if similarity(count[i], count[j]) >= 0.8]
    for _ in range(60):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    got = near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.group_id for r in got.orderBy("doc_id").collect()] == label


def test_near_groups_of_repeated_identifiers(spark):
    """Different texts under one doc_id have links of their own."""
    x, y, z = (prose(200, s) for s in (31, 32, 33))
    near = lambda t: t + " tail"
    data = [(5, x), (5, y), (5, z), (5, None), (5, ""), (6, near(x)), (7, near(y)), (3, near(z)), (8, z.replace("Gamma", "GAMMA"))]
    table = spark.createDataFrame(data, "doc_id long, text string")
    got = near_dedup.near_dedup(table).collect()
    assert Counter((r.doc_id, r.group_id, r.kept) for r in got) == Counter({(5, 5, True): 4, (5, 3, False): 1, (6, 5, False): 1, (7, 5, False): 1, (3, 3, True): 1, (8, 3, False): 1})
    kept = near_dedup.keep_one_each(table).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(5, x), (5, y), (5, None), (5, ""), (3, near(z))])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 1, 200: 200, 201: 200}


# 2


def test_quality_learns_and_takes_edges(spark, docs, empty):
    rng = random.Random(1)
    clean = lambda: "\n".join(prose(12, rng.random()) for _ in range(4))
    junk = lambda: "\n".join(" ".join(rng.choice(["BUY!!", "WIN$$$", "###", "CLICK!!"]) for _ in range(12)) for _ in range(4))
    data = [(i, clean() if i % 3 else junk()) for i in range(240)]
    table = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    field = quality.train(table, labels)
    got = quality.score_quality(table, field).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    edge = quality.score_quality(docs, field).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in edge)
    assert quality.score_quality(empty, field).count() == 0 and quality.keep_good(docs, field).columns == docs.columns
    blank = quality.train(empty, labels)
    assert {r.score for r in quality.score_quality(table, blank).collect()} == {0.5}


def test_field_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    features, weights, steps = rng.normal(size=(4, quality.N_FEATURES)), rng.normal(size=quality.N_FEATURES) * 0.2, rng.normal(size=(2, 2))
    field = quality.Field(weights, steps)
    good, _, log_z = field.marginals(features, np.array([0, 4]))
    unary = features @ weights
    scores = {y: sum(unary[i] * y[i] for i in range(4)) + sum(steps[y[i], y[i + 1]] for i in range(3)) for y in itertools.product((0, 1), repeat=4)}
    z = sum(np.exp(list(scores.values())))
    assert np.allclose(good, [sum(np.exp(s) for y, s in scores.items() if y[i]) / z for i in range(4)]) and np.isclose(log_z, np.log(z))


# 3, 4


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTE_BPE, WORD_BPE)}


def test_token_files_round_trip(spark, docs, empty, rows, library):
    out = new_path(spark, "tokens")
    token_files.write_token_files(docs, out, BYTE_BPE)
    got = token_files.read_token_files(spark, out, with_ids=True).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, t in order:
        ids = library[BYTE_BPE].encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert [tuple(r) for r in sorted(got, key=lambda r: r.start)] == want
    none = new_path(spark, "tokens")
    token_files.write_token_files(empty, none, BYTE_BPE)
    assert token_files.read_token_files(spark, none).count() == 0


def test_length_histogram(spark, docs, empty, rows, library):
    size = sorted(len(library[BYTE_BPE].encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    got = token_counts.length_histogram(docs, BYTE_BPE)
    for r in got.collect():
        assert r.n_docs == size.count(r.length) and r.docs_at_least == sum(s >= r.length for s in size) and r.tokens_at_least == sum(s for s in size if s >= r.length)
        assert r.tokens_total == sum(size) and r.tokens_cut == sum(min(s, r.length) for s in size)
    assert sorted(r.length for r in got.collect()) == sorted(set(size))
    cut = {r.context_limit: (r.docs_over, r.tokens_cut) for r in token_counts.cut_totals(got, [0, 5, 100, 10**6]).collect()}
    assert cut == {c: (sum(s > c for s in size), sum(min(s, c) for s in size)) for c in (0, 5, 100, 10**6)}
    assert token_counts.length_quantile(got, 0.5).first().length == size[-(-len(size) // 2) - 1]
    assert token_counts.length_histogram(empty, BYTE_BPE).count() == 0


def test_pieces_keep_every_character():
    texts = ["  a  b\n\n c'd 's't 've  ", "", " ", "x \n y", "'ll''s", "a1 2½\t\t"]
    p = Pieces(texts, leading_space=True)
    assert ["".join(p.joined[a:b] for a, b in zip(p.starts[i:j], p.ends[i:j])) for i, j in zip(p.first[:-1], p.first[1:])] == texts


def thue_morse(n, flip=False):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


@pytest.fixture(scope="module")
def hard_texts():
    """Words that polynomials modulo 2**64 can't tell apart, and texts of all assigned and unassigned code points."""
    a, b = thue_morse(2048), thue_morse(2048, True)
    marks = ["".join(f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)}'s " for c in range(low, low + 2048) if not 0xD800 <= c <= 0xDFFF) for low in range(0, 0x18000, 2048)]
    return [a, b, f"x {a} {b} y", f"{b} {a}", *marks, "\U000e0fff x\U0010fffe'll", "a\u1c89\ua7cb Z<|endoftext|> \u1c8a"]


def test_hard_texts_encode_as_the_library_does(hard_texts, library):
    for tok in library.values():
        tok.no_truncation()
        tok.no_padding()
    ids, edge = tokens.Encoder(BYTE_BPE).encode(hard_texts)
    words_ = bpe.BpeEncoder(WORD_BPE).encode(hard_texts)
    for i, t in enumerate(hard_texts):
        assert ids[edge[i] : edge[i + 1]].tolist() == library[BYTE_BPE].encode(t, add_special_tokens=False).ids
        assert b" ".join(v[1] for v in words_[i]).split() == [str(x).encode() for x in library[WORD_BPE].encode(t, add_special_tokens=False).ids]


def test_long_texts_encode_as_the_library_does(library):
    long = "\n  ".join(prose(2000, i) for i in range(40)) + " " + "é" * 3000 + "\t" * 2000
    long = long * 10 + "x"
    assert len(long.encode()) > 5_000_000 and len(pretokens.parts(long)) > 3
    ids, edge = tokens.Encoder(BYTE_BPE).encode(["a b", long, ""])
    assert ids[edge[1] : edge[2]].tolist() == library[BYTE_BPE].encode(long, add_special_tokens=False).ids and edge[3] == edge[2]
    got = bpe.BpeEncoder(WORD_BPE).encode([long])[0]
    assert b" ".join(v[1] for v in got) == " ".join(map(str, library[WORD_BPE].encode(long, add_special_tokens=False).ids)).encode()


def test_pieces_of_one_hash_keep_apart(monkeypatch, library):
    monkeypatch.setattr(pretokens, "run_hashes", lambda points, starts, ends, seed=0: (ends - starts).astype(np.uint64) % np.uint64(3))
    text = prose(300, 50) + " it's " + prose(50, 51)
    encoder = tokens.Encoder(BYTE_BPE)
    for _ in range(2):
        assert encoder.encode([text])[0].tolist() == library[BYTE_BPE].encode(text, add_special_tokens=False).ids


# 5


def test_archives(spark, empty):
    big, other = "é" * 600, "b" * 2000
    data = [(1, "http://a/b c\n", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "", ""), (7, "u", other), (None, "u", other), (None, "u", None), (2, "again", big)]
    pages = spark.createDataFrame([(*d, "x") for d in data], "page_id long, url string, html string, payload_digest string")
    raw, out = new_path(spark, "raw"), new_path(spark, "warc")
    files = warc.normalise_archives(warc.write_archives(warc.page_records(pages), raw), raw, out)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(files, out).collect())
    sha = lambda t: (len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest())
    want = Counter((i, *sha(h), *(("revisit", 2) if i == 1 else ("revisit", 7) if i is None and h else ("response", None))) for i, _, h in data)
    assert got == want
    payloads = {r.page_id: r.payload for r in warc.read_archives(files, out, with_payload=True).collect() if r.record_type == "response"}
    assert payloads[2] == big.encode() and payloads[3] == b"small"
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_monolithic_streams_of_many_members():
    import gzip
    import io

    records = [warc._record(i, "u", b"\r\n\r\n" * i, hashlib.sha1(b"\r\n\r\n" * i).hexdigest(), None, False, "d") for i in range(50)]
    data = gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:]))
    assert list(warc.split_records(warc.inflate(io.BytesIO(data)))) == records
    with pytest.raises(ValueError):
        list(warc.split_records([records[1][:-3]]))


# 6


def removed_by_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(left).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, docs, empty, rows):
    rng = random.Random(5)
    long = "".join(rng.choice("abcde ") for _ in range(1500))
    texts = [t for _, t in rows] + [long, long[:700] + "#" + long[701:], "!" + long[300:701], long[299:699] + long[299:699], "a" * 399, "a" * 400, "ab" * 450, long[:400], long[1:400]]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rank int")
    got = suffix_dedup.remove_repeats(table, with_text=True).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == removed_by_force(texts, 400)
    assert all(hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    edge = suffix_dedup.remove_repeats(docs)  # null and repeated ids
    assert sorted((r.n_removed for r in edge.collect())) == sorted(r[1] for r in removed_by_force([t for _, t in rows], 400))


def passages_by_force(texts, words):
    lists = [WORD.findall(lower(t)) for t in texts]
    seen = Counter(tuple(w[p : p + words]) for w in lists for p in range(len(w) - words + 1))
    return [len({q for p in range(len(w) - words + 1) if seen[tuple(w[p : p + words])] > 1 for q in range(p, p + words)}) for w in lists]


def test_passages_equal_brute_force(spark, rows):
    passage = [prose(20, 70).upper(), prose(24, 71), prose(25, 72), prose(60, 73)]
    texts = [t for _, t in rows] + [prose(30, 80 + i) + "\n" + p + " -- " + prose(30, 90 + i) for i in range(3) for p in passage] + ["ab " * 300, passage[3], passage[1]]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    got = suffix_dedup.remove_repeats_and_count_passages(table).orderBy("doc_id").collect()
    assert [r.n_passage_words for r in got] == passages_by_force(texts, 51) and max(r.n_passage_words for r in got) > 60
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == removed_by_force(texts, 400)
    short = suffix_dedup.passage_words(table, words=7).collect()
    assert sorted(r.n for r in short) == sorted(n for n in passages_by_force(texts, 7) if n)


def test_covered_units():
    spans = [[(0, 5), (3, 7), (9, 10)], [], [(2, 4), (2, 4), (0, 1)], None, [(5, 50), (6, 7), (49, 60)]]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    array = pa.array([None if x is None else [{"start": a, "end": b} for a, b in x] for x in spans], kind)
    assert suffix_dedup.covered(array).tolist() == [8, 0, 3, 0, 55] and suffix_dedup.covered(array[:0]).tolist() == []


def test_narrowing_drops_nothing_wanted(spark):
    rows, wanted = spark.range(0, 4000), spark.range(0, 4000, 7)
    assert wanted.exceptAll(narrowing.perhaps_among(rows, "id", wanted)).isEmpty()
    some, others = narrowing.split_among(rows, "id", wanted)
    assert some.count() + others.count() == 4000 and others.intersect(wanted).isEmpty() and others.count() > 3000
    assert narrowing.perhaps_among(rows, "id", wanted.limit(0)).isEmpty()


# 7


def contaminated_by_force(text, items, window=13):
    w = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        v = WORD.findall(lower(t))
        n = min(window, len(v))
        for s in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_words_of_one_hash_keep_apart(spark, hard_texts, monkeypatch):
    d = spark.createDataFrame(list(enumerate(hard_texts[:4])), "doc_id long, text string")
    b = spark.createDataFrame([(1, hard_texts[0]), (2, hard_texts[1] + " q")], "item_id long, text string")
    want = [(i, *contaminated_by_force(t, [(r.item_id, r.text) for r in b.collect()])) for i, t in enumerate(hard_texts[:4])]
    assert sorted(tuple(r) for r in decontaminate.contamination(d, b).collect()) == want
    hashes = textbytes.run_hashes
    monkeypatch.setattr(textbytes, "run_hashes", lambda low, starts, ends, seed=0: hashes(low, starts, ends) % np.uint64(2 + seed * 50))
    items = [(1, prose(40, 2)), (2, prose(30, 3)), (3, "alpha1")]
    judge = decontaminate.Judge.__new__(decontaminate.Judge)
    judge.blocks = [decontaminate.TestSuffixes([str(i) for i, _ in items], pa.array([t for _, t in items]))]
    texts = [prose(40, 2) + prose(20, 9), prose(50, 7), prose(30, 3)]
    counts, hit, found = judge(pa.array(texts))
    for i, t in enumerate(texts):
        assert (counts[i], hit[i], len(found[i])) == contaminated_by_force(t, items)[:3]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 100])
def test_contamination_equals_brute_force(spark, docs, empty, rows, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(1, prose(80, 2)), (2, prose(300, 1)[100:600]), (10, "one two"), (3, None), (4, ""), (5, "two"), (5, "two"), (6, prose(13, 99)), (7, " ".join(prose(80, 2).split()[30:50]))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = decontaminate.contamination(docs, bench).collect()
    want = sorted(((i, *contaminated_by_force(t, items)) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in want)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_longest_matches(spark):
    passage = prose(60, 2).split()
    d = spark.createDataFrame([(1, " ".join(passage[:20])), (2, "x y " + " ".join(passage[:31]) + " z"), (3, " ".join(passage[:31]))], "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(passage))], "item_id long, text string")
    n = len(WORD.findall(lower(" ".join(passage[:31]))))
    first = decontaminate.longest_matches(d, b).filter("item_word = 0").first()
    assert (first.item_id, first.n_words, first.doc_id, first.doc_word) == ("9", n, 2, 2)


# 8


def test_bpe_equals_the_library(spark, docs, empty, rows, library):
    tok = library[WORD_BPE]
    tok.no_truncation()
    tok.no_padding()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in bpe.encode_decode(docs, WORD_BPE, with_output=True).collect())
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back] += 1
    assert got == want and bpe.encode_decode(empty, WORD_BPE).count() == 0


def test_prefix_tables_equal_merging():
    """The dynamic programme against plain merging in order of rank."""
    rng = random.Random(7)
    b = bpe.bpe(WORD_BPE)
    with open(WORD_BPE, encoding="utf-8") as f:
        model = json.load(f)["model"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    for word in ["".join(rng.choice("aeiou" * 3 + "thnsrlz") for _ in range(rng.randrange(1, 25))) for _ in range(300)] + ["a" * 60, "ha" * 30]:
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            best = min(((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            pair, out, i = tuple(parts[best[1] : best[1] + 2]), [], 0
            while i < len(parts):
                whole = tuple(parts[i : i + 2]) == pair
                out.append("".join(pair) if whole else parts[i])
                i += 1 + whole
            parts = out
        assert b.encode_words([word])[0] == [model["vocab"][p] for p in parts]


# 9


def test_exact_groups(spark, docs, empty, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    want = Counter((i, best(groups[lower(t)]), len(groups[lower(t)]), i == best(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    kept = exact_dedup.keep_distinct(docs)
    assert kept.columns == docs.columns and sorted(lower(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_distinct(empty).count() == 0


def test_tries_hold_prefixes_and_empty_strings():
    trie = exact_dedup.PatriciaTrie()
    words_ = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abc", b"", b"xyz" * 1000, b"xyz" * 999 + b"xyw"]
    for i, w in enumerate(words_):
        trie.add(w, i, 1)
    assert sorted(trie.terminals()) == sorted((w, max(i for i, v in enumerate(words_) if v == w), words_.count(w)) for w in set(words_))


# 10


def test_chat_round_trip(spark):
    odd = "a\\b \\\\ </s>[INST] <s> <<SYS>> <</SYS>> [/INST] é\U0001f600\n\\"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", None), (2, 0, None, "x"), (2, None, "system", "first"), (None, 0, "assistant", "n"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "ro\nle <s>", "")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    formatted = chat.format_conversations(table)
    for r in formatted.collect():
        inner = r.formatted[3:-5]
        assert not any(c in inner for c in chat.CONTROL)
    got = {r.conv_id: r for r in chat.conversation_digests(chat.written(formatted)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_conversations(table.limit(0))).count() == 0


def test_events_fold(spark):
    log = [(1, 0, 1, 0, "message", "assistant", "He"), (1, 0, 1, 1, "delta", None, "llo"), (1, 0, 1, 3, "delta", None, "new"), (1, 0, 1, 2, "regenerate", None, None), (1, 1, 1, 0, "message", "user", "q"), (1, 1, 1, 5, "edit", None, "Q"), (1, 1, 1, 6, "delta", None, "!"), (2, 0, 1, 0, "delta", "assistant", "only")]
    events = spark.createDataFrame(log, "conv_id long, turn long, part long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold_events(events).collect()}
    assert got == {(1, 0): ("assistant", "new"), (1, 1): ("user", "Q!"), (2, 0): ("assistant", "only")}
