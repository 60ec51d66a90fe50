import binascii
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkferry.llm import packing, tree_bpe
from sparkferry.llm.queries import QUERIES
from tests.llm.helpers import clashing, empty, odd

FOLDER = "/root/testdata/sf0.001"
RANKS = tree_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
OWN = tree_bpe.TreeBPE(RANKS, P.PATTERN)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HF = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
ENCODER = packing.Encoder(P.path("byte_bpe_50k.json"))


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(" \n\t\x1c\x85\xa0aé'1.="), st.text("abe the'll")))
def test_tree_equals_library(text):
    assert ids(OWN.encode(text)) == TIK.encode_ordinary(text)
    assert OWN.decode(ids(OWN.encode(text))) == text.encode()
    assert ids(ENCODER(text)) == HF.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 30_000, "=" * 20_000, "ab" * 20_000, "\n" * 5000 + "x"])
def test_long_words(text):
    assert ids(OWN.encode(text)) == TIK.encode_ordinary(text)


def test_long_random_word():
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(30_000))
    assert ids(OWN.encode(text)) == TIK.encode_ordinary(text)


def test_join_is_associative_and_empty_is_neutral():
    r = random.Random(5)
    for _ in range(300):
        parts = ["".join(r.choice("theinaorsd") for _ in range(r.randint(0, 9))).encode() for _ in range(3)]
        a, b, c = map(OWN.encode_bytes, parts)
        assert OWN.join(OWN.join(a, b), c) == OWN.join(a, OWN.join(b, c)) == OWN.merge(b"".join(parts))
        assert OWN.join(a, ()) == a == OWN.join((), a)


def test_special_tokens_are_text_for_the_tree_and_tokens_for_packing():
    text = "a<|endoftext|>b"
    assert ids(OWN.encode(text)) == TIK.encode_ordinary(text)
    assert ids(ENCODER(text)) == HF.encode(text, add_special_tokens=False).ids


def test_unknown_ids_raise():
    with pytest.raises(KeyError):
        OWN.decode([10**6])


def test_forgetting_changes_nothing():
    small = tree_bpe.TreeBPE(RANKS, P.PATTERN)
    small.words.most = 2
    for text in ("one two three four", "five six", "one two"):
        assert ids(small.encode(text)) == TIK.encode_ordinary(text)


def test_encode_frames(spark):
    out = tree_bpe.decode(tree_bpe.encode(clashing(odd(spark)), keep=("doc_id", "text")), keep=("text", "ids")).collect()
    assert len(out) == 10
    assert all(bytes(r.decoded) == (r.text or "").encode() and ids(bytes(r.ids)) == TIK.encode_ordinary(r.text or "") for r in out)
    assert tree_bpe.encode(empty(spark)).count() == 0


def test_op3_equals_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op3_tree_bpe"](spark, FOLDER).collect():
        want = np.array(TIK.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


@settings(deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 64, 1024]))
def test_piece_lengths(n, most):
    got = packing.piece_lengths(n, most)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= most for x in got) and got == sorted(got, reverse=True)
    assert len([x for x in got if x < most]) == len({x for x in got if x < most})


def test_op2_covers_each_id_once(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op2_packing"](spark, FOLDER).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for doc, pieces in by.items():
        want = np.array(HF.encode(texts[doc], add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want) and p.offset == 0
            assert p.ids_crc32 == binascii.crc32(want[at : at + p.length].tobytes())
            at += p.length
        assert at == len(want)
    assert len({r.sequence_id for r in got}) == len(got) and all(r.length & (r.length - 1) == 0 and r.length <= 1024 for r in got)


def test_pack_frames(spark):
    out = packing.pack(clashing(odd(spark)), keep=("doc_id", "source")).collect()
    assert sum(r.piece_length for r in out if r.doc_tokens == 1) == 3  # null, empty and all-null rows: the end only
    assert len({r.sequence_id for r in out}) == len(out) and {r.bucket for r in out} <= {2**k for k in range(11)}
    assert packing.pack(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty(spark), most=1000)


@pytest.mark.parametrize("kept", [("doc_id", "ids"), ("doc_id", "BUCKET"), ("doc_id", "doc_id")])
def test_kept_columns_that_clash_raise(spark, kept):
    rows = clashing(odd(spark)).withColumn("BUCKET", F.lit(1))
    with pytest.raises(ValueError, match="clash"):
        packing.pack(rows, keep=kept)


def test_buckets_hold_one_length(spark, tmp_path):
    pieces = packing.pack(odd(spark))
    packing.write_buckets(pieces, f"{tmp_path}/b", files=2)
    back = spark.read.parquet(f"{tmp_path}/b")
    assert sorted(map(tuple, back.select(*pieces.columns).collect()), key=repr) == sorted(map(tuple, pieces.collect()), key=repr)
    assert {int(x.name.split("=")[1]) for x in (tmp_path / "b").iterdir() if x.is_dir()} == {r.piece_length for r in pieces.collect()}
    assert all(len(list(x.glob("*.parquet"))) <= 2 for x in (tmp_path / "b").iterdir() if x.is_dir())


def test_heap_merges_like_the_scan():
    r = random.Random(8)
    for _ in range(200):
        data = "".join(r.choice("theinaorsd ") for _ in range(r.randint(2, 200))).encode()
        assert OWN._merge_by_heap(data) == OWN.merge(data)
