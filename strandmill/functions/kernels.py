"""Small vectorised kernels run inside Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np

_M64 = (1 << 64) - 1

# --- k-mer hashing ----------------------------------------------------------------------

# The SplitMix64 finaliser.
MIX_ADD = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB


def mix64(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(MIX_ADD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def _joined(unit: np.ndarray, k: int, join) -> np.ndarray:
    """Combine ``k`` neighbouring units at every position by repeated doubling.

    ``join(a, b, n)`` puts a piece of n units, b, after the piece a.
    """
    out, width, piece, n = None, 0, unit, 1
    while True:
        if k & n:
            size = len(unit) - width - n + 1
            out = piece[:size] if out is None else join(out[:size], piece[width:width + size], n)
            width += n
        if width == k:
            return out
        piece = join(piece[: len(piece) - n], piece[n:], n)
        n *= 2


_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODE[list(_pair)] = _i


def _kmer_windows(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(value of the canonical k-mer, whether it has four letters only) of every window."""
    code = _CODE[np.frombuffer(seq, np.uint8)]
    base = (code & 3).astype(np.uint64)
    forward = _joined(base, k, lambda a, b, n: (a << np.uint64(2 * n)) | b)
    # The reverse strand grows at the other end, so the shift follows what is there already.
    reverse = np.zeros(len(forward), np.uint64)
    piece = np.uint64(3) - base
    done, n = 0, 1
    while done < k:
        if k & n:
            reverse |= piece[done:done + len(reverse)] << np.uint64(2 * done)
            done += n
        if done < k:
            piece = piece[: len(piece) - n] | (piece[n:] << np.uint64(2 * n))
            n *= 2
    bad = np.concatenate(([0], np.cumsum(code == 4)))
    return np.minimum(forward, reverse), bad[k:] == bad[:-k]


def canonical_kmers(seq: bytes, k: int) -> np.ndarray:
    """Hashes of the canonical k-mers of a sequence; windows with other bytes are left out."""
    if k < 1 or k > 32 or len(seq) < k:
        return np.empty(0, np.uint64)
    values, clean = _kmer_windows(seq, k)
    return mix64(values[clean])


KMER_PIECE = 1 << 17


def row_kmers(rows: list[bytes], k: int, piece: int = KMER_PIECE):
    """(row, hashes of its canonical k-mers), a row longer than ``piece`` in several parts.

    Rows are walked together up to ``piece`` bytes; an N between them keeps k-mers in one row.
    """
    def walked(of: list[int], parts: list[bytes]):
        seq = b"N".join(parts)
        if k < 1 or k > 32 or len(seq) < k:
            return
        values, clean = _kmer_windows(seq, k)
        hashes = mix64(values[clean])
        before = np.concatenate(([0], np.cumsum(clean)))
        starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
        at = before[np.minimum(starts, len(clean))].tolist()
        for n, row in enumerate(of):
            if at[n] < at[n + 1]:
                yield row, hashes[at[n]:at[n + 1]]

    of, parts, room = [], [], 0
    for row, data in enumerate(rows):
        for low in range(0, max(len(data) - k + 1, 0) if k > 0 else 0, piece):
            part = data[low:low + piece + k - 1]
            of.append(row)
            parts.append(part)
            room += len(part) + 1
            if room >= piece:
                yield from walked(of, parts)
                of, parts, room = [], [], 0
    if parts:
        yield from walked(of, parts)


def smallest(hashes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` smallest different values in order; few of many are picked before sorting."""
    if size == 1:
        return hashes.min(keepdims=True) if len(hashes) else hashes
    if len(hashes) > 8 * size:
        some = np.unique(hashes[hashes <= np.partition(hashes, 2 * size)[2 * size]])
        if len(some) >= size:
            return some[:size]
    return np.unique(hashes)[:size]


# --- content-defined chunking -------------------------------------------------------------

# Fixed values of the gear table: a linear congruential sequence starting from 1.
GEAR_MULTIPLIER = 6364136223846793005
GEAR_INCREMENT = 1442695040888963407


def _gear() -> np.ndarray:
    values, v = [], 1
    for _ in range(256):
        v = (v * GEAR_MULTIPLIER + GEAR_INCREMENT) & _M64
        values.append(v)
    return np.array(values, np.uint64)


GEAR = _gear()


def mask_bits(min_size: int, max_size: int) -> int:
    return ((min_size + max_size) // 2).bit_length() - 1


def candidate_ends(data: bytes, bits: int) -> np.ndarray:
    """Where a chunk of at least ``bits`` bytes may end; right from the first ``bits`` bytes on."""
    mask = np.uint64((1 << bits) - 1)
    unit = GEAR[np.frombuffer(data, np.uint8)] & mask
    rolling = unit.copy()
    for back in range(1, min(bits, len(data))):
        rolling[back:] += unit[:-back] << np.uint64(back)
    return np.flatnonzero((rolling & mask) == 0) + 1


def next_ends(starts: np.ndarray, ends: np.ndarray, min_size: int, max_size: int) -> np.ndarray:
    """Ends of the chunks that begin at ``starts``, as far as candidates and the longest chunk tell."""
    longest = max(min_size, max_size)
    if not len(ends):
        return starts + longest
    at = np.searchsorted(ends, starts + min_size)
    return np.where(at < len(ends), np.minimum(ends[np.minimum(at, len(ends) - 1)], starts + longest), starts + longest)


def exit_table(ends: np.ndarray, size: int, min_size: int, max_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How chunks cross a piece of ``size`` bytes: (entries, exits, slopes).

    A chunk beginning at entry e leads to a first chunk at or after the piece's end, ``exit`` bytes
    past it.  The exits are given in stretches of entries, constant (slope 0) or moving along (1).
    Walks that meet stay together, so they are followed band by band and kept once.
    """
    longest = max(min_size, max_size)
    place = np.arange(longest)
    walk = np.arange(longest)
    for bound in [*range(longest, size, longest), size]:
        while (place < bound).any():
            behind = place < bound
            place[behind] = next_ends(place[behind], ends, min_size, max_size)
        place, back = np.unique(place, return_inverse=True)
        walk = back[walk]
    exits = place[walk] - size
    slope = np.diff(exits, append=exits[-1])
    slope[slope > 1] = 0
    new = np.ones(longest, bool)
    new[1:] = (np.diff(exits) != slope[:-1]) | (slope[1:] != slope[:-1])
    at = np.flatnonzero(new)
    return at, exits[at], slope[at]


def cut_ends(data: bytes, min_size: int, max_size: int) -> list[int]:
    """Exclusive ends of the content-defined chunks of one sequence.

    The low ``bits`` of the rolling hash depend on the last ``bits`` bytes only.  With
    chunks at least that long, whether a byte may end a chunk does not depend on where
    the chunk began, so all candidate ends are found at once and then walked.
    """
    n, bits = len(data), mask_bits(min_size, max_size)
    if min_size < bits:
        return _cut_ends_short(data, min_size, max_size, bits)
    ends = candidate_ends(data, bits)
    out, start, longest = [], 0, max(min_size, max_size)
    while start < n:
        i = np.searchsorted(ends, start + min_size)
        soonest = int(ends[i]) if i < len(ends) else n
        start = min(soonest, start + longest, n)
        out.append(start)
    return out


def _cut_ends_short(data: bytes, min_size: int, max_size: int, bits: int) -> list[int]:
    """Minimum below the mask width: a chunk's first bytes see fewer than ``bits`` of them.

    From ``bits`` bytes on, the rolling value no longer depends on the chunk's start, so those ends
    are found for all starts at once; only the few shorter lengths are looked up per chunk, in the
    values of runs of 1 .. bits - 1 bytes.
    """
    n = len(data)
    if not n:
        return []
    mask = np.uint64((1 << bits) - 1)
    unit = GEAR[np.frombuffer(data, np.uint8)] & mask
    runs = [unit]  # runs[k - 1][i]: value of the k bytes from i
    for k in range(2, bits + 1):
        runs.append((runs[-1][:-1] << np.uint64(1)) + unit[k - 1:] if k <= n else unit[:0])
    hits = [(r & mask) == 0 for r in runs]
    late = np.flatnonzero(hits[-1]) + bits if bits <= n else np.zeros(0, np.int64)
    longest = max(min_size, max_size)
    out, start = [], 0
    while start < n:
        end = min(start + longest, n)
        early = next((start + k for k in range(min_size, bits) if start + k <= n and hits[k - 1][start]), end)
        i = np.searchsorted(late, start + max(bits, min_size))
        start = min(end, early, int(late[i]) if i < len(late) else n)
        out.append(start)
    return out


# --- exact matches ------------------------------------------------------------------------


def minimizers(data: bytes, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the leftmost smallest k-byte hash of every ``window`` of them.

    Two sequences that share k + window - 1 bytes share a minimizer inside them.
    """
    if len(data) < k + window - 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    unit = mix64(np.frombuffer(data, np.uint8).astype(np.uint64))
    factor = np.uint64(GEAR_MULTIPLIER)
    hashes = mix64(_joined(unit, k, lambda a, b, n: a * (factor + np.uint64(2 * n)) + b))
    picks = np.lib.stride_tricks.sliding_window_view(hashes, window).argmin(axis=1)
    at = np.unique(picks + np.arange(len(picks)))
    return at, hashes[at].view(np.int64)


def _equal_ahead(a: np.ndarray, b: np.ndarray, step: int = 4096) -> int:
    """Length of the common prefix of two arrays."""
    n, done = min(len(a), len(b)), 0
    while done < n:
        differ = np.flatnonzero(a[done:min(done + step, n)] != b[done:min(done + step, n)])
        if len(differ):
            return done + int(differ[0])
        done = min(done + step, n)
    return n


def _least_rotation(unit: np.ndarray) -> int:
    """Start of the smallest rotation: ranks of pieces of 1, 2, 4, ... units."""
    n, width = len(unit), 1
    rank = np.unique(unit, return_inverse=True)[1]
    while width < n and np.count_nonzero(rank == 0) > 1:
        rank = np.unique(rank * n + np.roll(rank, -width), return_inverse=True)[1]
        width *= 2
    return int(rank.argmin())


def tandem_runs(data: bytes, at: np.ndarray, hashes: np.ndarray, k: int) -> list[tuple[int, int, int, int, bytes]]:
    """Maximal stretches that repeat with a period: (start, end, period, shift, root).

    They are looked for where a minimizer occurs three times at equal distances, and are at least
    two periods and ``k`` bytes long.  The root is the digest of the smallest rotation of the period,
    which begins at all places that leave ``shift`` when divided by it, so two stretches with one
    root are equal wherever their places agree after subtracting the shifts.
    """
    order = np.lexsort((at, hashes))
    pos, h = at[order], hashes[order]
    step = np.diff(pos)
    thrice = np.flatnonzero((h[2:] == h[:-2]) & (h[1:-1] == h[:-2]) & (step[1:] == step[:-1])) if len(pos) > 2 else pos[:0]
    text = np.frombuffer(data, np.uint8)
    found, last, far = {}, 0, 0
    for p, i in sorted(zip(step[thrice].tolist(), pos[thrice].tolist(), strict=True)):
        if p == last and i + 2 * p + k <= far:
            continue
        left = _equal_ahead(text[:i][::-1], text[: i + p][::-1])
        start, end = i - left, i + p + _equal_ahead(text[i:], text[i + p:])
        last, far = p, end
        if end - start >= 2 * p + k:
            found[start, end, p] = None
    out = []
    for start, end, p in found:
        unit = text[start : start + p]
        turn = _least_rotation(unit)
        root = hashlib.blake2b(np.roll(unit, -turn).tobytes(), digest_size=16).digest()
        out.append((start, end, p, (start + turn) % p, root))
    return out


def seed_rows(data: bytes, k: int, window: int) -> tuple[np.ndarray, list[bytes | None]]:
    """Seeds and tandem runs of one sequence: columns (hash, pos, step, count, residue, kind), roots.

    Kind 0 is a minimizer, once or, within a run, at ``count`` places ``step`` apart; its residue
    is its place within the period.  Kind 1 is a run from ``pos`` to ``count`` with period ``step``, its
    residue the shift and its hash taken from the root.
    """
    at, hashes = minimizers(data, k, window)
    runs = tandem_runs(data, at, hashes, k)
    owner = np.full(len(at), -1)
    for r, (start, end, *_) in enumerate(runs):
        part = owner[np.searchsorted(at, start) : np.searchsorted(at, end - k, "right")]
        part[part < 0] = r
    single = np.flatnonzero(owner < 0)
    blocks = [np.stack([hashes[single], at[single], *np.broadcast_to([[1], [1], [0], [0]], (4, len(single)))], axis=1)]
    roots: list[bytes | None] = [None] * len(single)
    for r, (start, end, p, shift, root) in enumerate(runs):
        mine = np.flatnonzero(owner == r)
        residue = (at[mine] - shift) % p
        order = np.lexsort((at[mine], residue, hashes[mine]))
        pos, h, residue = at[mine][order], hashes[mine][order], residue[order]
        # A gap in the places of one residue starts a new row.
        new = np.ones(len(pos), bool)
        new[1:] = (h[1:] != h[:-1]) | (residue[1:] != residue[:-1]) | (np.diff(pos) != p)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(pos)))
        blocks.append(np.stack([h[first], pos[first], np.full(len(first), p), count, residue[first], np.zeros(len(first), np.int64)], axis=1))
        blocks.append(np.array([[int.from_bytes(root[:8], "little", signed=True), start, p, end, shift, 1]], np.int64))
        roots += [root] * (len(first) + 1)
    return np.concatenate(blocks).astype(np.int64), roots


def common_ends(a: list[np.ndarray], b: list[np.ndarray], width: int, ahead: bool) -> np.ndarray:
    """Length of the common prefix (``ahead``) or suffix of each two byte strings of up to ``width``
    bytes; a string is (flat bytes, lengths)."""
    def laid(flat: np.ndarray, sizes: np.ndarray, pad: int) -> np.ndarray:
        out = np.full((len(sizes), width), pad, np.int16)
        place = np.arange(width)
        out[place < sizes[:, None] if ahead else place >= width - sizes[:, None]] = flat
        return out

    same = laid(*a, 256) == laid(*b, 257)
    if not ahead:
        same = same[:, ::-1]
    return np.where(same.all(axis=1), width, (~same).argmax(axis=1)) if width else np.zeros(len(a[1]), np.int64)
