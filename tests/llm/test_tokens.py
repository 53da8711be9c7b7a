import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from nasty_rows import NASTY
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomtext.llm import bpe, packing, tokenfile
from loomtext.llm.common import shared_dir, tie_of
from loomtext.llm.library import library_encoder

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "ab c  \n\t 　é'sdmll7 9。,-‍😀  ÉẞßŉİIſ́.,!?\x1c\x85Σσ"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library(name):
    t = Tokenizer.from_file(P.path(name))
    return lambda s: t.encode(s, add_special_tokens=False).ids


def odd_texts(n=3000):
    r = random.Random(5)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, 16))) for _ in range(n)] + ["it's. DON'T, can't! I'll. we've,", "<|endoftext|> a <|endoftext|>", "hello <|endoftext|> world", "It's<|startoftext|>B<|endoftext|>  c", "<|endof text|>", "<|ENDOFTEXT|>", "a" * 5000, " " * 99, "x\n" * 50]


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys, list(range(5000)))
    assert [h.get(k) for k in keys] == list(range(5000)) and sorted(h.values) == list(range(5000))
    assert [h.get(k) for k in (b"", b"-1", b"5000", b"x")] == [None] * 4
    assert bpe.PerfectHash([], []).get(b"a") is None
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"], [1, 2])


def test_byte_bpe_like_tiktoken(reference, documents):
    own = bpe.loaded(RANKS, P.PATTERN)
    for t in odd_texts() + [r["text"] for r in documents.limit(60).collect()]:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), repr(t)
        assert own.decode(ids) == t.encode()


@given(st.binary(min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_merges_of_any_bytes(raw):
    own = bpe.loaded(RANKS, P.PATTERN)
    assert b"".join(own.tokens[i] for i in own.merge(raw)) == raw


def test_byte_bpe_nasty(nasty, reference):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(nasty, RANKS, P.PATTERN).collect()}
    expected = set()
    for i, t, _ in NASTY:
        ids = reference.encode_ordinary(t or "")
        expected.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == expected
    assert bpe.encode(nasty.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_parts_are_independent(name, spaced, documents):
    own, ids = library_encoder(P.path(name), spaced), library(name)
    for t in odd_texts() + [r["text"] for r in documents.limit(60).collect()]:
        assert np.frombuffer(own(t), "<u4").tolist() == ids(t), repr(t)


# packing


@given(st.dictionaries(st.integers(1, 60), st.integers(0, 30), max_size=25))
@settings(max_examples=500, deadline=None)
def test_plan_places_everything(counts):
    found = packing.plan(counts, 60)
    placed: dict = {}
    for own, many in found:
        assert many > 0 and sum(own) <= 60 and sum(3 * n > 60 for n in own) <= 2
        for n in own:
            placed[n] = placed.get(n, 0) + many
    assert placed == {n: c for n, c in counts.items() if c}
    used = sum(many for _, many in found)
    gaps: list[int] = []  # of best-fit decreasing, one piece at a time
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        if fits := [g for g in gaps if g >= n]:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(60 - n)
    assert packing.lower_bound(counts, 60) <= used <= len(gaps) + 1


def test_plan_of_many_equal_pieces():
    found = packing.plan({7: 10**9, 1000: 10**9, 2048: 5}, 2048)
    assert len(found) < 10 and sum(m for _, m in found) >= 10**9 // 2


def check_packing(rows, texts, ids, capacity, end):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    expected = {}
    for i, t in texts:
        expected.setdefault(i, []).append([*ids(t or ""), end])
    assert set(by_doc) == set(expected)
    for i, copies in expected.items():
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        full = copies[0]
        first = (len(full) - 1) % capacity + 1
        pieces = [(0, 0, first)] + [(k + 1, at, capacity) for k, at in enumerate(range(first, len(full), capacity))]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == sorted([(k, s, n, zlib.crc32(np.array(full[s : s + n], "<u4").tobytes())) for k, s, n in pieces] * len(copies))


def test_packing_nasty(nasty):
    ids = library("byte_bpe_50k.json")
    got = packing.pack(nasty, P.path("byte_bpe_50k.json"), capacity=64).collect()
    check_packing(got, [(i, t) for i, t, _ in NASTY], ids, 64, 0)
    assert packing.pack(nasty.limit(0), P.path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("salts, rows_a_salt", [(64, 250_000), (1, 3), (2, 1)])
def test_packing_by_any_number_of_salts(spark, salts, rows_a_salt):
    rows = [(i, 0, 0, 5 if i % 3 else 7) for i in range(90)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long").repartition(3)
    got = packing.best_fit(pieces, 12, salts=salts, rows_a_salt=rows_a_salt).collect()
    filled: dict = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(got) == 90 and len(filled) == 30 + 15
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 12


def test_packing_documents(documents):
    got = packing.pack(documents, P.path("byte_bpe_50k.json")).collect()
    check_packing(got, [(r["doc_id"], r["text"]) for r in documents.collect()], library("byte_bpe_50k.json"), 2048, 0)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= 1.02 * -(-total // 2048) + 1


# token files


def expected_tokens(rows, ids, end=2):
    rows = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0])
    out, at = [], 0
    for i, t in rows:
        own = np.array([*ids(t or ""), end], "<u4")
        out.append((i, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    return out


def test_token_files_nasty(nasty):
    ids = library("word_bpe_49k.json")
    got = tokenfile.round_trip(nasty, P.path("word_bpe_49k.json"), 2, length=16)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == expected_tokens([(i, t) for i, t, _ in NASTY], ids)
    assert tokenfile.round_trip(nasty.limit(0), P.path("word_bpe_49k.json"), 2).collect() == []


def test_token_files_documents(documents):
    ids = library("word_bpe_49k.json")
    got = tokenfile.round_trip(documents.repartition(3), P.path("word_bpe_49k.json"), 2)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == expected_tokens([(r["doc_id"], r["text"]) for r in documents.collect()], ids)


def test_token_files_of_an_id_of_many_rows(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(40)] + [(7, f"copy {i % 90}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = tokenfile.write(df, P.path("word_bpe_49k.json"), 2, f"file://{tmp_path}")
    assert files.count() >= 12
    got = sorted((tuple(r) for r in tokenfile.read(files, f"file://{tmp_path}").collect()), key=lambda r: r[1])
    ids = library("word_bpe_49k.json")
    own = [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id", tie_of("text")).collect()]
    assert got == expected_tokens(own, ids)


@pytest.mark.parametrize("width", [2, 4])
def test_token_file_access(tmp_path, width):
    where = f"file://{tmp_path}"
    w = tokenfile.Writer(where, "one", length=8, rows=3, width=width)
    parts = [np.arange(k, k + n, dtype=np.uint32) for k, n in ((0, 5), (100, 50), (200, 1), (300, 30))]
    for k, p in enumerate(parts):
        w.add(k, p)
    assert not list(tmp_path.glob("one.*"))  # nothing before it is closed
    w.close()
    flat, r = np.concatenate(parts), tokenfile.Reader(where, "one")
    for k in range(-(-len(flat) // 8)):
        ids, mask = r.sequence(k)
        own = flat[8 * k : 8 * k + 8]
        assert ids[: len(own)].tolist() == own.tolist() and mask.to_pylist() == [i < len(own) for i in range(8)]
    assert not r.sequence(0)[0].flags.owndata  # a view of the mapped file
    assert r.tokens(3, 60).tolist() == flat[3:63].tolist() and r.tokens(0, 0).tolist() == []
    assert [tuple(x) for b in r.documents() for x in zip(*b.to_pydict().values())] == [(0, 0, 5), (1, 5, 50), (2, 55, 1), (3, 56, 30)]


def test_ids_that_do_not_fit_are_an_error(documents, tmp_path):
    with pytest.raises(ValueError, match="do not fit"):
        tokenfile.write(documents, P.path("word_bpe_49k.json"), 70_000, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="do not fit"):
        tokenfile.write(documents, P.path("word_bpe_49k.json"), 2, f"file://{tmp_path}", width=1)


def test_shared_folder(spark):
    assert spark.sparkContext.getCheckpointDir() is not None or shared_dir(spark)
