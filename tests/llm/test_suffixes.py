"""Shared byte strings against brute force; the loser tree, front coding and anchors on their own."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import suffixes as S

DOCS = "doc_id long, text string, lang string, n_bytes string"


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(60))
def test_merge_by_common_prefixes(seed):
    rng = random.Random(seed)
    runs = [sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 7))]
    order, h = S.merge(runs, [[shared(r[i - 1], r[i]) if i else 0 for i in range(len(r))] for r in runs])
    its = [iter(r) for r in runs]
    out = [next(its[x]) for x in order]
    assert out == sorted(sum(runs, []))
    assert h[1:].tolist() == [shared(a, b) for a, b in zip(out, out[1:])]


def test_merge_compares_no_known_prefix(monkeypatch):
    """Strings that share 1,000 bytes are told apart by bytes after them only."""
    seen = []

    class Watched(bytes):
        def __getitem__(self, i):
            if isinstance(i, int):
                seen.append(i)
            return bytes.__getitem__(self, i)

    head = b"x" * 1000
    runs = [[Watched(head + bytes([97 + r, 97 + k])) for k in range(20)] for r in range(4)]
    S.merge(runs, [[0] + [1001] * 19 for _ in runs])
    # the first match of each pair reads the common head, later ones nothing of it
    assert sum(i < 1000 for i in seen) <= 2 * 1000 * 3


def some_suffixes(rng, width, n=300, alphabet=b"ab"):
    data = np.frombuffer(bytes(rng.choice(alphabet) for _ in range(n)), dtype=np.uint8)
    s, _ = S.suffixes_of([(0, 0, data)], np.array([5]), np.array([9], dtype=np.uint16), width)
    return data, s.take(S.sorted_order(s.right, s.n_right))


@pytest.mark.parametrize("width", [8, 20, 50])
def test_front_coding_round_trip(width):
    _, s = some_suffixes(random.Random(width), width)
    back, prefixes, sizes = S.front_decoded([S.front_coded(s), S.front_coded(s)], width)
    assert sizes.tolist() == [len(s)] * 2
    for f in S.Suffixes.FIELDS:
        assert np.array_equal(getattr(back, f), np.concatenate([getattr(s, f)] * 2)), f
    prefixes = prefixes[: len(s)]
    rows = [bytes(r[:n]) for r, n in zip(s.right, s.n_right)]
    assert rows == sorted(rows)
    assert prefixes.tolist() == [shared(rows[i - 1], rows[i]) if i else 0 for i in range(len(rows))]


def test_leads_keep_all_that_share_windows():
    rng = random.Random(4)
    data, s = some_suffixes(rng, 20, 3000, b"abcdefghij")
    keep = set(S.shared_leads(s, 20).tolist())
    rows = [bytes(r[:n]) for r, n in zip(s.right, s.n_right)]
    for i, r in enumerate(rows):
        need = 20 - int(s.n_left[i])
        if any(j != i and shared(r, o) >= need for j, o in enumerate(rows)):
            assert i in keep
    assert len(keep) < len(s)


@pytest.mark.parametrize("width", [8, 50])
def test_every_window_has_one_suffix(width):
    data, s = some_suffixes(random.Random(1), width, 700, b"abc")
    starts = sorted(int(a) - m for a, n, k in zip(s.at, s.n_right, s.n_left) for m in range(width - int(n), int(k) + 1))
    assert starts == list(range(len(data) - width + 1))


def test_long_texts_are_cut_where_windows_allow(monkeypatch):
    monkeypatch.setattr(S, "SLICE_BYTES", 100)
    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(["a" * 350, None, "b" * 30, "c" * 120])], names=["id", "text"])
    pieces = [p for group in S.pieces_of(batch, 20) for p in group]
    assert [(r, at) for r, at, _ in pieces] == [(0, 0), (0, 100), (0, 200), (0, 300), (2, 0), (3, 0), (3, 100)]
    windows = [(r, at + i) for r, at, p in pieces for i in range(len(p) - 19)]
    assert len(windows) == len(set(windows)) == 331 + 11 + 101


def brute(rows, width):
    key = lambda d: -(1 << 63) if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            k = b[i : i + width]
            first[k] = min(first.get(k, 1 << 63), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [0] * (len(b) + 2)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < key(d):
                gone[i + 1 : i + width + 1] = [1] * width
        spans = sum(gone[i] < gone[i + 1] for i in range(len(b) + 1))
        kept = None if t is None else bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((d, len(b), sum(gone), spans, kept))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, None if r.kept is None else bytes(r.kept)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width,alphabet,hot", [(8, "ab", None), (50, "abcdefg ", None), (50, "abcdefg ", 3), (20, "aé ", 2)])
def test_against_brute_force(spark, monkeypatch, width, alphabet, hot):
    """Shared passages, periodic texts, repeated and null ids, cuts inside characters; with hot anchors dealt window by window too."""
    rng = random.Random(width)
    if hot:
        monkeypatch.setattr(S, "HOT_SUFFIXES", hot)
        monkeypatch.setattr(S, "LEAST_HOT", 2)
    monkeypatch.setattr(S, "PART_BYTES", 1500)
    word = lambda a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    passages = [word(width // 2, 3 * width) for _ in range(6)]
    rows = []
    for i in range(100):
        t = "".join(rng.choice(passages) if rng.random() < 0.4 else word(0, width) for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice([i, i, i, 7, None]), rng.choice([t, t, t, t, None, "a" * 90, "ab" * 70, ""])))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = found(S.remove_shared_bytes(df, width=width))
    assert got == brute(rows, width) and sum(r[2] for r in got)


def test_odd_rows_and_names(spark):
    line = "a line of boilerplate that is longer than fifty bytes, so it counts"
    rows = [(1, line, "en", "x"), (2, "before " + line + " after", "en", "y"), (None, line, None, None), (3, None, "en", "z"), (4, "", "en", ""), (5, "short", "en", "")]
    d = S.remove_shared_bytes(spark.createDataFrame(rows, DOCS))
    assert d.columns == ["doc_id", "lang", *S.RESULTS, "kept"]
    got = {r.doc_id: r for r in d.collect()}
    # a null id is the smallest: it keeps its text, all others lose the line
    assert got[None].n_removed == 0 and got[1].n_removed == len(line)
    assert bytes(got[2].kept) == b"before  after" and [tuple(s) for s in got[2].removed_spans] == [(7, len(line))]
    assert got[3].kept is None and got[3].n_bytes == 0 and bytes(got[4].kept) == b""
    assert S.remove_shared_bytes(spark.createDataFrame([], DOCS)).count() == 0
