"""Backtracked SentencePiece ids against the library."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from sentencepiece import SentencePieceProcessor

from strandmill.llm import pieces, queries
from strandmill.llm.tokens import vocabulary

PATH = vocabulary(pieces.MODEL)
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(PATH)


def check(own, library, texts):
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        got, want = np.frombuffer(ids, "<u4"), library.encode(text, add_bos=True, add_eos=True)
        assert got.tolist() == want, text[:100]
        assert own.decode(got) == library.decode(want), text[:100]


@pytest.mark.parametrize("alphabet", [
    "ab  ▁", "the of in er 's.,!? \n", "aeinrst", "日本語 の é①𝔘 ab\0", "(){}[];:=<>/ abc\t\r\n\"'", "".join(map(chr, range(1, 700)))])
def test_random_texts(own, library, alphabet):
    rng = random.Random(5)
    check(own, library, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for size in (4, 12, 70, 300) for _ in range(300)])


def test_runs_of_pieces(own, library):
    rng = random.Random(6)
    check(own, library, ["".join(rng.choice(own.text) for _ in range(rng.randint(1, 9))) for _ in range(4000)])


def test_long_parts(own, library):
    rng = random.Random(7)
    check(own, library, ["a" * 70_000, " " * 70_001 + "x", "ab" * 50_000, "①" * 30_000, "".join(rng.choice("thein") for _ in range(60_000)), "aaaa " * 30_000])


def test_taking_back_is_needed(own):
    """Somewhere the longest piece that fits its left neighbour is wrong."""
    def greedy(text):
        longest, at, out = own._longest(text), 0, []
        while at < len(text):
            piece = longest[at]
            while piece >= 0 and out and not own._fit(np.array([out[-1]]), np.array([piece]))[0]:
                piece = own.shorter[piece]
            if piece < 0:
                return None
            out.append(piece)
            at += own.size[piece]
        return out

    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(400)]
    assert any(greedy(t) is None for t in texts)


def test_any_ids_decode(own, library):
    rng = random.Random(9)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 259, 28705, rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids)) == library.decode(ids)


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):  # noqa: B017
        pieces.Pieces(vocabulary())


def test_columns(spark, library):
    rows = [(1, None, 7), (2, "", 8), (3, "two  words", 9), (3, "two  words", 9), (None, "é ▁x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids long").withColumnRenamed("doc_id", "id")
    out = pieces.decode(pieces.encode(df)).collect()
    assert [r.id for r in out] == [1, 2, 3, 3, None]
    for r, (_, text, _) in zip(out, rows, strict=True):
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.piece_ids, "<u4").tolist() == want and r.decoded == library.decode(want)
    assert pieces.encode(df.limit(0)).collect() == []


def test_query(spark, library):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_pieces(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        r = got[doc]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
