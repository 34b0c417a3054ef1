"""Byte layout of binary delta files.

Layout: magic, version byte, length-prefixed JSON header, table of reference names, then
per chromosome its name, length, hash and operations.  Lengths are LEB128 numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

# Fixed values of the format.
MAGIC = b"GHD1"
VERSION = 1
COPY_TAG, LITERAL_TAG = 0, 1
RAW, PACKED = 0, 1
BASES = b"ACGT"


def number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def signed(n: int) -> bytes:
    return number(2 * n if n >= 0 else -2 * n - 1)


def blob(b: bytes) -> bytes:
    return number(len(b)) + b


def pack(b: bytes) -> bytes | None:
    """Four bases per byte, first base in the low bits; None for other letters."""
    codes = [BASES.find(c) for c in b]
    if min(codes, default=0) < 0:
        return None
    codes += [0] * (-len(codes) % 4)
    return bytes(
        a | b << 2 | c << 4 | d << 6
        for a, b, c, d in zip(codes[0::4], codes[1::4], codes[2::4], codes[3::4])
    )


def unpack(packed: bytes, n: int) -> bytes:
    return bytes(BASES[x >> s & 3] for x in packed for s in (0, 2, 4, 6))[:n]


def encode_chromosome(name: str, length: int, hash_: str, ops: list[dict]) -> bytes:
    """One chromosome; a copy is (ref_index, ref_start, ref_end), a literal has bytes."""
    out, reached = [blob(name.encode()), number(length), blob(hash_.encode()), number(len(ops))], 0
    for op in ops:
        if op["type"] == "copy":
            out += [bytes([COPY_TAG]), number(op["ref_index"]), signed(op["ref_start"] - reached),
                    number(op["ref_end"] - op["ref_start"])]
            reached = op["ref_end"]
        else:
            packed = pack(op["bytes"])
            kind, body = (RAW, op["bytes"]) if packed is None else (PACKED, packed)
            out += [bytes([LITERAL_TAG]), number(len(op["bytes"])), bytes([kind]), body]
    return b"".join(out)


def preamble(header: dict, names: list[str], chromosomes: int) -> bytes:
    meta = json.dumps(header, separators=(",", ":")).encode()
    table = b"".join(blob(n.encode()) for n in names)
    return MAGIC + bytes([VERSION]) + blob(meta) + number(len(names)) + table + number(chromosomes)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        piece = self.data[self.at:self.at + n]
        if len(piece) < n:
            raise ValueError("truncated delta file")
        self.at += n
        return piece

    def number(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    def signed(self) -> int:
        n = self.number()
        return n // 2 if n % 2 == 0 else -(n + 1) // 2

    def blob(self) -> bytes:
        return self.take(self.number())


def declared_assembly(data: bytes) -> str | None:
    """The assembly that a binary delta's header names; None for other content."""
    r = _Reader(data)
    try:
        known = r.take(4) == MAGIC and r.take(1)[0] == VERSION
        return json.loads(r.blob()).get("assembly") if known else None
    except ValueError:
        return None


def operations(data: bytes) -> Iterator[tuple]:
    """Rows of the delta_ops schema, one per operation, in file order."""
    r = _Reader(data)
    if r.take(4) != MAGIC or r.take(1)[0] != VERSION:
        raise ValueError("not a binary delta of a known version")
    meta = json.loads(r.blob())
    names = [r.blob().decode() for _ in range(r.number())]
    lead = (meta["assembly"], meta["reference"], meta["reference_hash"])
    for chrom_idx in range(r.number()):
        chrom = (chrom_idx, r.blob().decode(), r.number(), r.blob().decode())
        reached = 0
        for op_idx in range(r.number()):
            if r.take(1)[0] == COPY_TAG:
                ref = names[r.number()]
                start = reached + r.signed()
                reached = start + r.number()
                yield (*lead, *chrom, op_idx, "copy", ref, start, reached, None)
            else:
                n, kind = r.number(), r.take(1)[0]
                body = r.take(n) if kind == RAW else unpack(r.take((n + 3) // 4), n)
                yield (*lead, *chrom, op_idx, "literal", None, None, None, body)
