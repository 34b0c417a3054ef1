"""Array kernels against plain models."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandmill.functions import cigar, kernels


def chunk_model(data, low, high):
    """Ends by definition: the shortest allowed prefix of the rest whose value ends in zero bits."""
    bits = ((low + high) // 2).bit_length() - 1

    def value(piece):  # a byte counts twice as much for each byte after it
        return sum(int(kernels.GEAR[b]) << (len(piece) - 1 - i) for i, b in enumerate(piece)) % 2**64

    ends = [0]
    while ends[-1] < len(data):
        at = ends[-1]
        sizes = [n for n in range(low, max(low, high) + 1) if at + n <= len(data)]
        good = [n for n in sizes if n >= high or value(data[max(at, at + n - 70):at + n]) % 2**bits == 0]
        ends.append(at + good[0] if good else len(data))
    return ends[1:]


@pytest.mark.parametrize("low,high", [(16, 64), (64, 1024), (2, 64), (1, 4), (40, 20), (8, 8)])
def test_cut_ends(low, high):
    rng = random.Random(low * 1000 + high)
    for n in (0, 1, 10, 512, 3000):
        data = bytes(rng.choice(b"ACGT") for _ in range(n))
        assert kernels.cut_ends(data, low, high) == chunk_model(data, low, high)


def test_cut_ends_survive_an_insertion():
    rng = random.Random(77)
    data = bytes(rng.choice(b"ACGT") for _ in range(5000))
    ends = kernels.cut_ends(data, 24, 90)
    moved = kernels.cut_ends(data[:3100] + b"TTAGC" + data[3100:], 24, 90)
    assert [e for e in ends if e <= 3010] == [e for e in moved if e <= 3010]
    assert [e + 5 for e in ends[-5:]] == moved[-5:]
    assert all(24 <= b - a <= 90 for a, b in zip([0] + ends[:-2], ends[:-1]))


def kmer_model(seq, k):
    code, pair = {c: i for i, c in enumerate("ACGT")}, {"A": "T", "C": "G", "G": "C", "T": "A"}

    def mix(x):
        x = (x + kernels.MIX_ADD) % 2**64
        x = (x ^ x >> 30) * kernels.MIX_A % 2**64
        x = (x ^ x >> 27) * kernels.MIX_B % 2**64
        return x ^ x >> 31

    out = []
    for i in range(len(seq) - k + 1):
        w = seq[i:i + k].upper()
        if set(w) <= set("ACGT"):
            value = lambda s: int("".join(str(code[c]) for c in s), 4)
            out.append(mix(min(value(w), value("".join(pair[c] for c in reversed(w))))))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5, 11, 16, 21, 31, 32])
def test_canonical_kmers(k):
    rng = random.Random(k)
    seq = "".join(rng.choice("ACGTacgtN" if i % 40 == 0 else "ACGTacgt") for i in range(400))
    assert kernels.canonical_kmers(seq.encode(), k).tolist() == kmer_model(seq, k)


def test_mixer_values():
    got = kernels.mix64(np.array([0, 27], np.uint64)).tolist()
    assert got == [16294208416658607535, 10902710238276814474]


def test_shared_stretch_shares_a_minimizer():
    rng = random.Random(5)
    for _ in range(50):
        word = bytes(rng.choice(b"AB") for _ in range(24))
        seqs = [bytes(rng.choice(b"ABC") for _ in range(rng.randrange(60))) + word
                + bytes(rng.choice(b"ABC") for _ in range(rng.randrange(60))) for _ in range(2)]
        at = [s.index(word) for s in seqs]
        found = []
        for s, a in zip(seqs, at):
            pos, h = kernels.minimizers(s, 12, 13)
            found.append({(p - a, x) for p, x in zip(pos.tolist(), h.tolist()) if a <= p <= a + 12})
        assert found[0] & found[1]


def test_cigar_operations():
    rng = random.Random(12)
    many = [[(rng.randrange(1, 400), rng.choice("=XIDM")) for _ in range(rng.randrange(6))] for _ in range(30)]
    texts = ["".join(f"{n}{c}" for n, c in ops) for ops in many] + ["12", "=4X9"]
    row, n, op = cigar.operations(pa.array(texts))
    want = [(i, n, c) for i, ops in enumerate(many) for n, c in ops] + [(31, 0, "="), (31, 4, "X")]
    assert list(zip(row.tolist(), n.tolist(), bytes(op.tolist()).decode())) == want
