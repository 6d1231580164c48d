"""Repeated byte strings: sorted suffix runs, exchanged front-coded and merged by common prefixes.

The suffix array is sparse. Of the grams inside a window the one of least hash is its anchor, so equal windows have
equal anchors at equal places, and the suffix from the anchor on, with the bytes before it that its windows reach,
stands for all windows it anchors. A task sorts the suffixes of a slice, settles what repeats inside it, and sends every
range of the order its part of the run, front-coded. A range merges its runs by a loser tree whose nodes keep common
prefix lengths: bytes known to be equal are never compared again. The merged prefix lengths tell which windows are equal
to the right of their anchors; bytes to the left are compared by a 64-bit hash.
Suffixes of anchors that hold too many of a sample travel window by window, dealt by all their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SEED, forget_other_stages, partitions
from tidemark.llm.substrings import BASE, NO_ID, ROLL, _mix, _part, _roll

WIDTH = 50
#: Bytes of an anchor, for windows of four times as many or more
GRAM = 12
#: Bytes of text that a task sorts at a time; longer texts are cut into pieces that overlap by a window
SLICE_BYTES = 8 << 20
#: Bytes of text behind one part of the merged order, and of the documents
PART_BYTES = 8 << 20
#: Ranges of the order; beyond them a range is dealt by hashes of anchors
MAX_RANGES = 1 << 14
#: Suffixes sampled for each range, and suffixes of one anchor that may meet in one part
RANGE_SAMPLE, HOT_SUFFIXES = 256, 1 << 16
#: Least number of suffixes sampled, and of those under an anchor that is held to be hot
LEAST_SAMPLE, LEAST_HOT = 1 << 16, 16
CHUNK = 1 << 16
BODY = "part int, hits boolean, body binary"
BODY_SCHEMA = pa.schema([("part", pa.int32()), ("hits", pa.bool_()), ("body", pa.binary())])
HIT = np.dtype([("id", "<i8"), ("salt", "<u2"), ("start", "<u4"), ("count", "u1"), ("sum", "<u8")])
SPANS = T.ArrayType(T.StructType().add("start", "long").add("length", "long"))
RESULTS = ("n_bytes", "n_removed", "n_spans", "removed_spans")


def gram_of(width: int) -> int:
    return min(GRAM, max(width // 4, 1))


def anchors(data: np.ndarray, width: int) -> np.ndarray:
    """Place of the anchor of every window: the leftmost gram of least hash in it."""
    gram, out = gram_of(width), np.empty(max(len(data) - width + 1, 0), dtype=np.int32)
    span = width - gram + 1
    for at in range(0, len(out), CHUNK):
        part = data[at : at + CHUNK + width - 1]
        h = np.zeros(len(part) - gram + 1, dtype=np.uint32)
        for j in range(gram):
            h *= np.uint32(0x9E3779B1)
            h += part[j : j + len(h)]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        # the place in the low bits: a minimum prefers the left one of equal hashes
        least, step = h.astype(np.uint64) << np.uint64(16), 1
        while step * 2 <= span:
            least = np.minimum(least[:-step], least[step:] + np.uint64(step))
            step *= 2
        if step < span:
            least = np.minimum(least[: step - span], least[span - step :] + np.uint64(span - step))
        out[at : at + len(least)] = (least & np.uint64(0xFFFF)).astype(np.int32) + np.arange(at, at + len(least), dtype=np.int32)
    return out


class Suffixes:
    """Suffixes from anchors on, each for a run of windows.

    ``right``: bytes from the anchor to the end of its last window, ``n_right`` of them; ``left``: bytes before the
    anchor, backwards, ``n_left`` of them. Window m starts m bytes before the anchor, for
    m from ``width - n_right`` to ``n_left``. ``at`` is the anchor's place in its document.
    """

    FIELDS = ("right", "n_right", "left", "n_left", "id", "salt", "at")

    def __init__(self, *values: np.ndarray):
        for name, v in zip(self.FIELDS, values):
            setattr(self, name, v)

    def __len__(self) -> int:
        return len(self.id)

    def take(self, i: np.ndarray) -> Suffixes:
        return Suffixes(*(getattr(self, f)[i] for f in self.FIELDS))

    @staticmethod
    def join(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, f) for p in parts]) for f in Suffixes.FIELDS))


def _columns(width: int) -> tuple[int, int]:
    """Columns of right (whole words of eight bytes) and left."""
    return -(-width // 8) * 8, width - gram_of(width)


def _rows(data: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """right, n_right, left and n_left of anchors ``at`` whose windows start from ``first`` to ``last``."""
    rights, lefts = _columns(width)
    n_right, n_left = last + width - at, at - first
    n_right, n_left = n_right.astype(np.uint8), n_left.astype(np.uint8)
    space = np.concatenate([np.zeros(lefts, dtype=np.uint8), data, np.zeros(rights, dtype=np.uint8)])
    right = sliding_window_view(space, rights)[at + lefts]
    right[np.arange(rights, dtype=np.uint8) >= n_right[:, None]] = 0
    left = sliding_window_view(space, lefts)[at][:, ::-1].copy()
    left[np.arange(lefts, dtype=np.uint8) >= n_left[:, None]] = 0
    return right, n_right, left, n_left


def sorted_order(right: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Order of byte strings: by eight bytes at a time, each step only among those equal so far."""
    words = np.ascontiguousarray(right).view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = words[order[1:], 0] != words[order[:-1], 0]
    for key in [*words.T[1:], n_right.astype(np.uint64)]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group, some = np.cumsum(new)[where], order[where]
        order[where] = some = some[np.lexsort((key[some], group))]
        split = np.zeros(len(where), dtype=bool)
        split[1:] = key[some[1:]] != key[some[:-1]]
        new[where] |= split
    return order


def common_prefixes(right: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Bytes that each string shares with the one before it."""
    out = np.zeros(len(right), dtype=np.uint8)
    if len(right) > 1:
        differs = np.concatenate([right[1:] != right[:-1], np.ones((len(right) - 1, 1), dtype=bool)], axis=1)
        out[1:] = np.minimum(differs.argmax(axis=1), np.minimum(n_right[1:], n_right[:-1]))
    return out


def merge(runs: list[list[bytes]], prefixes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Merges sorted runs by a loser tree; ``prefixes`` are common prefix lengths inside each run.

    Returns the run of each string in the merged order and what it shares with the string before it. A node
    keeps the loser of its match and the prefix it shares with the winner. Of two candidates,
    the one that shares more with the last string put out is smaller; only equal lengths need bytes, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    # an ended run shares less than any other, so it loses
    runs = [[*r, b""] for r in runs] + [[b""]] * (size - len(runs))
    prefixes = [[*p, -1] for p in prefixes] + [[-1]] * (size - len(prefixes))
    heads, places = [r[0] for r in runs], [0] * size
    loser, loser_shares, winner = [0] * size, [-1] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        if prefixes[a][0] < 0 or (prefixes[b][0] >= 0 and heads[b] < heads[a]):
            a, b = b, a
        winner[node], loser[node] = a, b
        loser_shares[node] = len(commonprefix((heads[a], heads[b]))) if prefixes[b][0] >= 0 else -1
    run, h, out = winner[1], prefixes[winner[1]][0], []
    while h >= 0:
        out.append(run << 8 | h)
        p = places[run] = places[run] + 1
        x = heads[run] = runs[run][p]
        h = prefixes[run][p]
        node = (run + size) >> 1
        while node:
            other = loser_shares[node]
            if other > h:
                loser_shares[node] = h
                loser[node], run = run, loser[node]
                h, x = other, heads[run]
            elif other == h and h >= 0:
                y = heads[loser[node]]
                if x == y:
                    loser_shares[node] = len(x)
                else:
                    c, most = h, min(len(x), len(y))
                    while c < most and x[c] == y[c]:
                        c += 1
                    loser_shares[node] = c
                    if y < x:
                        loser[node], run = run, loser[node]
                        x = y
            node >>= 1
    packed = np.array(out, dtype=np.int64)
    return (packed >> 8).astype(np.int32), (packed & 0xFF).astype(np.uint8)


def repeats(s: Suffixes, shared: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, m, group) of all windows that come more than once among suffixes in order, by group.

    Window m is equal in two suffixes that share ``width - m`` bytes to the right and m to the left.
    """
    near = np.maximum(shared, np.append(shared[1:], 0)).astype(np.int64)
    low = np.maximum(width - np.minimum(s.n_right, near), 0)
    h, some, ms, keys = np.zeros(len(s), dtype=np.uint64), [], [], []
    for m in range(s.left.shape[1] + 1):
        if m:
            h = h * BASE + s.left[:, m - 1] + np.uint64(1)
        i = np.flatnonzero((low <= m) & (m <= s.n_left))
        if len(i) > 1:
            segment = np.cumsum(shared < width - m)[i].astype(np.uint64)
            some.append(i.astype(np.int32)), ms.append(np.full(len(i), m, dtype=np.uint8)), keys.append(_mix(h[i] ^ _mix(segment * BASE + np.uint64(m))))
    if not some:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    some, ms, keys = np.concatenate(some), np.concatenate(ms), np.concatenate(keys)
    order = np.argsort(keys)
    new = np.ones(len(order), dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    twice = ~new
    twice[:-1] |= ~new[1:]
    i = order[twice]
    return some[i].astype(np.int64), ms[i].astype(np.int64), np.cumsum(new)[twice]


def _window_hashes(s: Suffixes, i: np.ndarray, m: np.ndarray, width: int) -> np.ndarray:
    """The hash that ``hashes_of`` gives window m of each suffix."""
    some, place = np.unique(i, return_inverse=True)
    rows = np.concatenate([s.left[some][:, ::-1], s.right[some]], axis=1)
    at, flat = place * rows.shape[1] + s.left.shape[1] - m, rows.ravel()
    h = np.zeros(len(i), dtype=np.uint64)
    for c in range(width):
        h = h * ROLL + flat[at + c] + np.uint64(1)
    return _mix(h)


def hashes_of(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of one text."""
    out = np.empty(max(len(data) - width + 1, 0), dtype=np.uint64)
    for at in range(0, len(out), CHUNK):
        part = data[at : at + CHUNK + width - 1].astype(np.uint64) + np.uint64(1)
        out[at : at + CHUNK] = _mix(_roll(part, width))
    return out


def _hit_rows(s: Suffixes, i: np.ndarray, m: np.ndarray, width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Windows to remove, as runs of starts with the sum of their hashes, dealt by document."""
    if not len(i):
        return
    start = s.at[i].astype(np.int64) - m
    o = np.lexsort((start, i))
    i, m, start = i[o], m[o], start[o]
    h = _window_hashes(s, i, m, width)
    new = np.ones(len(i), dtype=bool)
    new[1:] = (i[1:] != i[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    hits = np.empty(len(head), dtype=HIT)
    hits["id"], hits["salt"], hits["start"] = s.id[i[head]], s.salt[i[head]], start[head]
    hits["count"], hits["sum"] = np.diff(np.append(head, len(i))), np.add.reduceat(h, head)
    part = document_part(hits["id"], hits["salt"], parts)
    o = np.argsort(part, kind="stable")
    part, hits = part[o], hits[o]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(edges, np.append(edges[1:], len(part))):
        yield _body(int(part[a]), True, np.ascontiguousarray(hits[a:b]).view(np.uint8).reshape(b - a, -1).T.tobytes())


def _body(part: int, hits: bool, raw: bytes) -> pa.RecordBatch:
    body = zstandard.ZstdCompressor(level=3).compress(raw)
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([hits]), pa.array([body], pa.binary())], schema=BODY_SCHEMA)


def document_part(ids: np.ndarray, salts: np.ndarray, parts: int) -> np.ndarray:
    return _part(np.asarray(ids).astype(np.int64).view(np.uint64) ^ (np.asarray(salts).astype(np.uint64) * ROLL), parts)


def salt_of(text: bytes | np.ndarray) -> int:
    """Spreads rows of one id; hits name it, and are checked against the text itself."""
    return xxhash.xxh64_intdigest(text, SEED) & 0xFFFF


def front_coded(s: Suffixes) -> bytes:
    """A sorted run: what each suffix does not share with the one before it, and the other fields in planes."""
    shared = common_prefixes(s.right, s.n_right)
    col = np.arange(s.right.shape[1])
    rest = s.right[(col >= shared[:, None]) & (col < s.n_right[:, None])]
    left = s.left[np.arange(s.left.shape[1]) < s.n_left[:, None]]
    planes = [v.view(np.uint8).reshape(len(s), -1).T.tobytes() for v in (s.id, s.salt, s.at)]
    return b"".join([np.int64(len(s)).tobytes(), shared.tobytes(), s.n_right.tobytes(), s.n_left.tobytes(), *planes, rest.tobytes(), left.tobytes()])


def front_decoded(raws: list[bytes], width: int) -> tuple[Suffixes, np.ndarray, np.ndarray]:
    """The suffixes of some runs, one run after another, what each shares with the one before it, and the sizes of the runs."""
    rights, lefts = _columns(width)
    kinds = [np.dtype(k) for k in (np.uint8, np.uint8, np.uint8, np.int64, np.uint16, np.uint32)]
    sizes = np.array([int(np.frombuffer(r, np.int64, 1)[0]) for r in raws])
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    rests, sides = [], []
    for raw, n in zip(raws, sizes.tolist()):
        at = 8
        for kind, column in zip(kinds, columns):
            planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
            column.append(planes[0] if kind.itemsize == 1 else np.ascontiguousarray(planes.T).view(kind).ravel())
            at += n * kind.itemsize
        size = int(columns[1][-1].sum(dtype=np.int64) - columns[0][-1].sum(dtype=np.int64))
        rests.append(np.frombuffer(raw, np.uint8, size, at))
        sides.append(np.frombuffer(raw, np.uint8, offset=at + size))
    shared, n_right, n_left, ids, salt, place = (np.concatenate(c) for c in columns)
    bytes_at, left = np.zeros((rights, len(ids)), dtype=np.uint8), np.zeros((len(ids), lefts), dtype=np.uint8)
    col = np.arange(rights, dtype=np.uint8)
    bytes_at.T[(col >= shared[:, None]) & (col < n_right[:, None])] = np.concatenate(rests)
    left[col[:lefts] < n_left[:, None]] = np.concatenate(sides)
    # byte j comes from the last suffix up to here that brought its own; a run's first one brings all
    where = np.arange(len(ids), dtype=np.int32)
    for j in range(int(shared.max(initial=0))):
        bytes_at[j] = bytes_at[j][np.maximum.accumulate(np.where(shared <= j, where, 0))]
    bytes_at[col[:, None] >= n_right] = 0
    return Suffixes(np.ascontiguousarray(bytes_at.T), n_right, left, n_left, ids, salt, place), shared, sizes


def shared_leads(s: Suffixes, width: int) -> np.ndarray:
    """Places of the suffixes whose leading bytes another one has too.

    A window of a suffix needs ``width - n_left`` equal bytes to the right at least. Leads of a few lengths up to that are
    counted by hash; a false match keeps a suffix, never drops one.
    """
    need = width - s.n_left.astype(np.int64)
    size = 1 << max(int(4 * len(s)).bit_length(), 10)
    lengths = sorted({gram_of(width), width // 3, width // 2})
    keep, h = np.ones(len(s), dtype=bool), np.zeros(len(s), dtype=np.uint64)
    for j in range(lengths[-1]):
        h = h * ROLL + s.right[:, j] + np.uint64(1)
        if j + 1 in lengths:
            slot = (_mix(h) & np.uint64(size - 1)).astype(np.int64)
            keep &= (np.bincount(slot, minlength=size)[slot] > 1) | (need < j + 1)
    return np.flatnonzero(keep)


def pieces_of(batch: pa.RecordBatch, width: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(row, first byte, bytes) of texts in slices of about SLICE_BYTES; a longer text is cut where its windows allow."""
    some, total = [], 0
    for row, text in enumerate(batch.column(1)):
        data = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8) if text.is_valid else np.zeros(0, dtype=np.uint8)
        for at in range(0, max(len(data) - width + 1, 0), SLICE_BYTES):
            piece = data[at : at + SLICE_BYTES + width - 1]
            if some and total + len(piece) > SLICE_BYTES:
                yield some
                some, total = [], 0
            some.append((row, at, piece))
            total += len(piece)
    if some:
        yield some


def suffixes_of(pieces: list[tuple[int, int, np.ndarray]], ids: np.ndarray, salts: np.ndarray, width: int) -> tuple[Suffixes, np.ndarray]:
    """The suffixes of all anchors of some pieces, and the row of each."""
    data = np.concatenate([p for _, _, p in pieces])
    sizes = np.array([len(p) for _, _, p in pieces])
    begins = np.cumsum(sizes) - sizes
    inside = np.ones(len(data), dtype=bool)
    for e in np.cumsum(sizes):
        inside[max(e - width + 1, 0) : e] = False
    inside = inside[: max(len(data) - width + 1, 0)]
    at = anchors(data, width)
    # a suffix stands for a run of windows inside one piece that have its anchor
    turn = np.ones(len(at) + 1, dtype=bool)
    turn[1:-1] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    first, last = np.flatnonzero(turn[:-1] & inside), np.flatnonzero(turn[1:] & inside)
    at = at[first].astype(np.int64)
    piece = np.searchsorted(begins, at, side="right") - 1
    rows = np.array([r for r, _, _ in pieces])[piece]
    place = at - begins[piece] + np.array([b for _, b, _ in pieces])[piece]
    return Suffixes(*_rows(data, first, last, at, width), ids[rows], salts[rows], place.astype(np.uint32)), rows


def settled(s: Suffixes, rows: np.ndarray, shared: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inside a slice: (suffix, m) of windows that a smaller id has too, whether each suffix must travel, and its last m.

    Of equal windows only those of the smallest id travel, from each row the first one, and of rows with equal id and salt one.
    """
    i, m, group = repeats(s, shared, width)
    start = s.at[i].astype(np.int64) - m
    # rows by id and salt, so that one number orders the windows of a group
    known, first = np.unique(rows, return_index=True)
    rank = np.empty(int(known.max(initial=0)) + 1, dtype=np.int64)
    rank[known[np.lexsort((known, s.salt[first], s.id[first]))]] = np.arange(len(known))
    key, bits = group * len(known) + rank[rows[i]], int(start.max(initial=0)).bit_length()
    o = np.argsort(key << bits | start) if int(key.max(initial=0)).bit_length() + bits < 63 else np.lexsort((start, key))
    i, m, group, start = i[o], m[o], group[o], start[o]
    ids, salts, row = s.id[i], s.salt[i], rows[i]
    same = np.zeros(len(i), dtype=bool)
    same[1:] = group[1:] == group[:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(i)))) if len(i) else i
    hit = ids != ids[head]
    again = same.copy()
    again[1:] &= (ids[1:] == ids[:-1]) & (salts[1:] == salts[:-1]) & ((row[1:] == row[:-1]) | (start[1:] == start[:-1]))
    gone = hit | again
    left = s.n_left.astype(np.int64) + s.n_right + 1 - width - np.bincount(i[gone], minlength=len(s))
    # the last m that stays, where some go
    last, some = s.n_left.astype(np.int64), np.unique(i[gone])
    place = np.searchsorted(some, i[gone])
    alive = np.arange(s.left.shape[1] + 1) <= last[some][:, None]
    alive[place, m[gone]] = False
    last[some] = alive.shape[1] - 1 - alive[:, ::-1].argmax(axis=1)
    return i[hit], m[hit], left > 0, last


def _alone(s: Suffixes, width: int) -> Suffixes:
    """Each window of some suffixes as a suffix of its own."""
    low = width - s.n_right.astype(np.int64)
    count = s.n_left + 1 - low
    i = np.repeat(np.arange(len(s)), count)
    m = low[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    rows = np.concatenate([s.left[:, ::-1], s.right], axis=1)
    rights, lefts = _columns(width)
    right = np.zeros((len(i), rights), dtype=np.uint8)
    right[:, :width] = rows[i[:, None], (lefts - m)[:, None] + np.arange(width)]
    full, none = np.full(len(i), width, dtype=np.uint8), np.zeros(len(i), dtype=np.uint8)
    return Suffixes(right, full, np.zeros((len(i), lefts), dtype=np.uint8), none, s.id[i], s.salt[i], (s.at[i] - m).astype(np.uint32))


def _first_bytes(right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eight bytes (the order of ranges; fewer for short grams), and a hash of the gram."""
    gram = gram_of(width)
    lead = np.zeros((len(right), 8), dtype=np.uint8)
    lead[:, : min(gram, 8)] = right[:, : min(gram, 8)]
    h = np.zeros(len(right), dtype=np.uint64)
    for j in range(gram):
        h = h * ROLL + right[:, j] + np.uint64(1)
    return lead.view(">u8").ravel().astype(np.uint64), _mix(h)


def ranges_of(texts: DataFrame, size: int, parts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders of ranges of the order, and hashes of hot anchors, from a bounded sample of blocks of all texts.

    The sample has about RANGE_SAMPLE suffixes a range, and at least LEAST_SAMPLE. It decides where work is done, not results.
    """
    wanted = max(min(parts, MAX_RANGES) * RANGE_SAMPLE, LEAST_SAMPLE)
    total = max(size * 2 / (width - gram_of(width) + 2), 1)
    rate = min(wanted / total, 1.0)
    block = 4096

    def keys(blocks: list[np.ndarray]) -> pa.RecordBatch:
        z = np.zeros(1, dtype=np.int64)
        lead, gram = _first_bytes(suffixes_of([(0, 0, b) for b in blocks], z, z.astype(np.uint16), width)[0].right, width)
        return pa.record_batch([pa.array([lead.tobytes()], pa.binary()), pa.array([gram.tobytes()], pa.binary())], names=["lead", "gram"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        blocks, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                data = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8) if text.is_valid else ()
                if len(data) < width:
                    continue
                seed = xxhash.xxh64_intdigest(data, SEED + 1)
                for at in range(0, len(data) - width + 1, block):
                    if (xxhash.xxh64_intdigest(at.to_bytes(8, "little"), seed) >> 32) < rate * (1 << 32):
                        blocks.append(data[at : at + block + width])
                        held += len(blocks[-1])
                if held > SLICE_BYTES:
                    yield keys(blocks)
                    blocks, held = [], 0
        if blocks:
            yield keys(blocks)

    found = texts.select("text").mapInArrow(sample, "lead binary, gram binary").collect()
    lead = np.sort(np.frombuffer(b"".join(r["lead"] for r in found), dtype=np.uint64))
    gram, n = np.unique(np.frombuffer(b"".join(r["gram"] for r in found), dtype=np.uint64), return_counts=True)
    n_ranges = min(parts, MAX_RANGES)
    borders = np.unique(lead[np.arange(1, n_ranges) * len(lead) // n_ranges]) if len(lead) else lead
    return borders, gram[(n >= LEAST_HOT) & (n * (total / max(len(lead), 1)) > HOT_SUFFIXES)]


def _send(width: int, parts: int, borders: np.ndarray, hot: np.ndarray):
    """Sorts slices and sends the ranges of the order their runs."""
    ranges = len(borders) + 1
    each = max(parts // ranges, 1)

    def rows_of(s: Suffixes, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        o = np.argsort(part, kind="stable")
        part = part[o]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        for a, b in zip(edges, np.append(edges[1:], len(part)) if len(part) else []):
            yield _body(int(part[a]), False, front_coded(s.take(o[a:b])))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        for batch in batches:
            ids = pc.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            salts = np.array([salt_of(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(1)], dtype=np.uint16)
            for pieces in pieces_of(batch, width):
                s, rows = suffixes_of(pieces, ids, salts, width)
                o = sorted_order(s.right, s.n_right)
                s, rows = s.take(o), rows[o]
                i, m, travels, last = settled(s, rows, common_prefixes(s.right, s.n_right), width)
                yield from _hit_rows(s, i, m, width, parts)
                s.n_left = last.astype(np.uint8)
                s.left[np.arange(s.left.shape[1]) >= s.n_left[:, None]] = 0
                s = s.take(np.flatnonzero(travels))
                lead, gram = _first_bytes(s.right, width)
                part = np.searchsorted(borders, lead, side="right") * each + _part(gram, each)
                alone = np.isin(gram, hot)
                yield from rows_of(s.take(np.flatnonzero(~alone)), part[~alone])
                if alone.any():
                    w = _alone(s.take(np.flatnonzero(alone)), width)
                    w = w.take(sorted_order(w.right, w.n_right))
                    h = _window_hashes(w, np.arange(len(w)), np.zeros(len(w), dtype=np.int64), width)
                    yield from rows_of(w, _part(h, ranges * each))

    return send


def _merge(width: int, parts: int):
    """Merges the runs of a part and finds the windows that a smaller id has too."""

    def settle(bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        s, shared, sizes = front_decoded([unpack.decompress(b) for b in bodies], width)
        bodies.clear()
        # those leave whose leading bytes nobody shares: they can have no window in common with another
        keep = shared_leads(s, width)
        if not len(keep):
            return
        sizes = np.diff(np.searchsorted(keep, np.append(0, np.cumsum(sizes))))
        shared = np.minimum.reduceat(shared[: keep[-1] + 1], np.append(0, keep[:-1] + 1))
        s = s.take(keep)
        raw, step = s.right.tobytes(), s.right.shape[1]
        strings, shared = [raw[k : k + n] for k, n in zip(range(0, len(raw), step), s.n_right.tolist())], shared.tolist()
        ends = np.cumsum(sizes).tolist()
        spans = list(zip([0, *ends[:-1]], ends))
        run, shared = merge([strings[a:b] for a, b in spans], [shared[a:b] for a, b in spans])
        del raw, strings
        # a run's strings keep their order: the k-th time a run comes, it is its k-th string
        index = np.empty(len(run), dtype=np.int64)
        index[np.argsort(run, kind="stable")] = np.arange(len(run))
        s = s.take(index)
        i, m, group = repeats(s, shared, width)
        if not len(i):
            return
        ids = s.id[i]
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(ids, head)
        hit = ids != np.repeat(least, np.diff(np.append(head, len(ids))))
        yield from _hit_rows(s, i[hit], m[hit], width, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        bodies, part = [], None
        for batch in batches:
            for p, hits, body in zip(*(batch.column(n) for n in ("part", "hits", "body"))):
                if hits.as_py():
                    yield pa.record_batch([pa.array([x.as_py()], f.type) for x, f in zip((p, hits, body), BODY_SCHEMA)], schema=BODY_SCHEMA)
                    continue
                if p.as_py() != part and bodies:
                    yield from settle(bodies)
                    bodies = []
                part = p.as_py()
                bodies.append(body.as_py())
        if bodies:
            yield from settle(bodies)

    return run


def gone_bytes(data: np.ndarray, hits: np.ndarray, width: int) -> np.ndarray:
    """Which bytes of a text its hits cover; a window equal to a hit one goes wherever it starts."""
    h = hashes_of(data, width)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h, dtype=np.uint64)])
    start = hits["start"].astype(np.int64)
    end = start + hits["count"]
    fits = end <= len(h)
    start, end, total = start[fits], end[fits], hits["sum"][fits]
    right = sums[end] - sums[start] == total
    start, end = start[right], end[right]
    found = np.cumsum(np.bincount(start, minlength=len(h) + 1) - np.bincount(end, minlength=len(h) + 1))[:-1] > 0
    wanted = np.unique(h[found])
    if not len(wanted):
        return np.zeros(len(data), dtype=bool)
    at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
    cover = np.zeros(len(data) + 1, dtype=np.int64)
    cover[at] += 1
    cover[at + width] -= 1
    return np.cumsum(cover[:-1]) > 0


def _cut(width: int):
    """Cuts hit windows out of documents."""

    def hits_of(bodies: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
        raw = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(HIT.itemsize, -1).T for b in bodies]
        if not raw:
            return {}
        hits = np.ascontiguousarray(np.concatenate(raw)).view(HIT).ravel()
        hits = hits[np.lexsort((hits["salt"], hits["id"]))]
        edges = np.flatnonzero(np.concatenate([[True], (hits["id"][1:] != hits["id"][:-1]) | (hits["salt"][1:] != hits["salt"][:-1])]))
        return {(int(hits["id"][a]), int(hits["salt"][a])): hits[a:b] for a, b in zip(edges, np.append(edges[1:], len(hits)))}

    def one(batch: pa.RecordBatch, hits: dict) -> pa.RecordBatch:
        n_bytes, removed, spans, kept = [], [], [], []
        unpack = zstandard.ZstdDecompressor()
        for id_, salt, body in zip(*(batch.column(c).to_pylist() for c in ("id", "salt", "body"))):
            text = unpack.decompress(body) if body is not None else None
            found = hits.get((NO_ID if id_ is None else id_, salt)) if text else None
            n_bytes.append(len(text or b""))
            gone = gone_bytes(data := np.frombuffer(text, np.uint8), found, width) if found is not None else None
            if gone is None or not gone.any():
                removed.append(0), spans.append([]), kept.append(text)
                continue
            turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            spans.append([{"start": a, "length": b - a} for a, b in turn.reshape(-1, 2).tolist()])
            removed.append(int(gone.sum()))
            kept.append(data[~gone].tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.record_batch(
            [batch.column("row"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
            names=["row", *RESULTS, "kept"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        bodies, part, hits = [], None, None
        for batch in batches:
            # rows come by part, hits before documents
            parts, kinds = np.array(batch.column("part").to_pylist(), dtype=np.int64), np.array(batch.column("hits").to_pylist(), dtype=bool)
            edges = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])])) if len(parts) else []
            for a, b in zip(edges, np.append(edges[1:], len(parts)) if len(parts) else []):
                if parts[a] != part:
                    part, bodies, hits = parts[a], [], None
                if kinds[a]:
                    bodies += batch.column("body").slice(a, b - a).to_pylist()
                    continue
                hits = hits_of(bodies) if hits is None else hits
                bodies = []
                for k in range(a, b, 64):
                    yield one(batch.slice(k, min(64, b - k)), hits)

    return cut


def _packed_text(parts: int):
    """Documents by part, their texts compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = [(x.as_buffer() or b"") if x.is_valid else None for x in b.column(1)]
            ids = pc.fill_null(b.column(0), NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            salts = np.array([0 if t is None else salt_of(t) for t in texts], dtype=np.int32)
            part = document_part(ids, salts, parts).astype(np.int32)
            bodies = pa.array([None if t is None else squeeze.compress(t) for t in texts], pa.binary())
            yield pa.record_batch([pa.array(part), b.column(0), pa.array(salts), bodies, b.column(2)], names=["part", "id", "salt", "body", "row"])

    return pack


def remove_shared_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Cuts out every byte that a string of ``width`` bytes covers which also starts in a document of smaller id.

    Adds n_bytes, n_removed, n_spans, removed_spans (first byte, length; maximal) and ``kept``, the remaining bytes as
    binary, since a cut may fall inside a character; null texts have no bytes and a null ``kept``. Strings are judged on
    the input and lie in one text. All columns stay but the text, which ``kept`` replaces, and those with the names of results.
    A null id is the smallest; rows of one id cut nothing out of each other, and rows that
    repeat an id and its text get equal results.
    Ids are integers, width is up to 200. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS, "kept")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = partitions(spark, size, PART_BYTES)
    rest = [c for c in docs.columns if c != text_col]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(1).alias("_")).alias("row"))
    borders, hot = ranges_of(texts, size, parts, width)
    ranges = len(borders) + 1
    met_parts = ranges * max(parts // ranges, 1)
    sent = texts.select("id", "text").mapInArrow(_send(width, parts, borders, hot), BODY)
    met = sent.repartition(met_parts, "part").sortWithinPartitions("part").mapInArrow(_merge(width, parts), BODY)
    row = texts.schema["row"].dataType
    packed = T.StructType().add("part", "integer").add("id", "long").add("salt", "integer").add("body", "binary").add("row", row)
    right = texts.mapInArrow(_packed_text(parts), packed).select("part", F.lit(False).alias("hits"), "id", "salt", "body", "row")
    left = met.select("part", F.lit(True).alias("hits"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("salt"), "body", F.lit(None).cast(row).alias("row"))
    dealt = left.union(right).repartition(parts, "part").sortWithinPartitions("part", F.col("hits").desc())
    out = T.StructType().add("row", row).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("removed_spans", SPANS).add("kept", "binary")
    cut = dealt.mapInArrow(_cut(width), out)
    return cut.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], *RESULTS, "kept")
