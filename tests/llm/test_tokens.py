"""Word-wise encoding and wavelet shards against the whole tokenizer."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandmill.llm import tokens, wavelet

PATH = tokens.vocabulary()
TEXTS = [
    "a b  c", None, "", "  lead trail  ", "it's the dog's THE end. don't", "éà b\x1cz q" * 3, "12345 ½²³ a1b2... ,,, .,;: !?",
    "ÀÉ×ß÷ÿ ŸœŒ İstanbul ΣΑΣ <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "ñ é ́x", "日本語 текст 😀👍🏽",
    " x y\u0085z﻿", "wow!'s 's 'S 'll'VE", "ª º µm", "a.'s b,'t", "x‍y", "long " * 9000,
]


def whole(texts):
    return [x.ids + [2] for x in tokens.whole_tokenizer(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("alphabet", ["abcAB .,!?;:'s1é×÷", [chr(c) for c in [*range(1, 600), 0x1E9E, 0x3A3, 0x3C2, 0x2028, 0x3000, 0x301, 0x327, 0xAC00, 0x1100]]])
def test_ids(alphabet):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(500)]
    ids, bounds = tokens.encode(pa.array(texts, pa.string()), PATH)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == whole(texts)


def test_ids_of_marks():
    test_ids("abst \"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~!")


@pytest.mark.parametrize("slots", [4, 1 << 20])
def test_kept_parts(monkeypatch, slots):
    """Ids of parts outlast a task in a table of fixed size; parts that share a place or are long stay right."""
    monkeypatch.setattr(tokens, "SLOTS", slots)
    coder = tokens.Encoder(PATH)
    monkeypatch.setattr(tokens, "encoder", lambda path: coder)
    asked = []
    code = coder._coded
    monkeypatch.setattr(coder, "_coded", lambda parts: asked.append(parts) or code(parts))
    rng = random.Random(7)
    letters, marks = "abcdefgéßÿABÀ", [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 24))) + "".join(rng.choice(marks) for _ in range(rng.randrange(4))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(20))) for _ in range(400)] + ["", None, "''", "a'", "dog's'", "12 34"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    sizes = []
    for _ in range(2):
        asked.clear()
        ((_, ids, bounds),) = tokens.encoded([batch], "text", PATH)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == whole(texts)
        sizes.append(sum(map(len, asked)))
    assert coder.known.lanes.shape == (2, slots)
    if slots > 4:
        assert sizes[1] < sizes[0] / 2  # parts of over 16 bytes or 8 ids, and those that shared a place
    assert tokens.encode(pa.array(["", None]), PATH)[0].tolist() == [2, 2]
    assert tokens.encode(pa.array(["12"]), PATH)[0].tolist() == whole(["12"])[0]


def test_model_without_word_ends():
    """Where ids don't tell where a word ends, parts are encoded one at a time."""
    coder = tokens.Encoder(PATH)
    parts = ["the", "hallo", "naïve", "!!?"]
    ids, sizes = coder._coded(parts)
    coder.last[:] = False
    again, same = coder._coded(parts)
    assert ids.tolist() == again.tolist() and sizes.tolist() == same.tolist()


@pytest.mark.parametrize("top", [0, 1, 5, 300, 49407, 70000])
def test_shard(top):
    rng = np.random.default_rng(top)
    ids = np.minimum(rng.integers(0, top + 1, 3000), rng.integers(0, top + 1, 3000))
    shard = wavelet.Shard(wavelet.pack(ids, np.array([1000, 0, 2000])))
    assert shard.lengths.tolist() == [1000, 0, 2000] and shard.ids().tolist() == ids.tolist()
    for at in (0, 1, 511, 512, 513, 2999):
        value = int(ids[at])
        assert shard.access(at) == value
        assert shard.count(value) == (ids == value).sum() and shard.count(value, 100, at + 1) == (ids[100 : at + 1] == value).sum()
        places = np.flatnonzero(ids == value)
        for nth in (0, len(places) // 2, len(places) - 1):
            assert shard.find(value, nth) == places[nth]
        assert shard.find(value, len(places)) == -1
    assert shard.count(top + 1) == 0 and shard.find(1 << 20) == -1


def test_empty_shard():
    shard = wavelet.Shard(wavelet.pack(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert shard.ids().tolist() == [] and shard.count(3) == 0 and shard.find(0) == -1


def test_files(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again"), (3, "other one"), (3, "again")]
    rows = [(r[0], r[1], "p") for r in rows] + [(None, "no id", "p"), (None, None, "p")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").selectExpr("*", "1 as ids")
    folder = wavelet.write_shards(df, shard_ids=3000)
    found = sorted(wavelet.read_shards(spark, folder).collect(), key=lambda r: r.start)
    assert sorted(map(str, ((r.id, r.tokens) for r in found))) == sorted(map(str, zip([r[0] for r in rows], whole([r[1] for r in rows]), strict=True)))
    keys = [-1 if r.id is None else r.id for r in found]
    assert keys == sorted(keys)
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    digest = {r.start: r.ids_crc32 for r in wavelet.shard_digests(spark, folder).collect()}
    assert all(digest[r.start] == zlib.crc32(np.array(r.tokens, "<u4").tobytes()) for r in found)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = wavelet.write_shards(df)
    assert wavelet.read_shards(spark, folder).collect() == [] and wavelet.shard_digests(spark, folder).collect() == []
