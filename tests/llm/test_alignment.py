"""Tokenizer alignment against a plain two-pointer version, and the matrices on their own."""

import collections
import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import alignment as A


@pytest.mark.parametrize("seed", range(10))
def test_products(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.random((rng.integers(1, 30), 20)) < 0.2 for _ in range(2))
    rows = lambda m: A.Rows(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1])
    got = np.zeros((len(a), len(b)), dtype=int)
    for row, col, value in rows(a).product(rows(b.T)):
        got[row, col] += value
    assert np.array_equal(got, a.astype(int) @ b.T.astype(int))
    assert np.array_equal(rows(a).row_sums(np.arange(20)), a @ np.arange(20))


def test_products_in_blocks(monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 7)
    lens_a, lens_b = np.array([3, 1, 30, 2, 4]), np.array([1, 5, 5, 20, 9])
    got = [(int(r), int(c), int(v)) for row, col, val in A.token_bytes(lens_a).product(A.byte_tokens(lens_b)) for r, c, v in zip(row, col, val)]
    owner_a, owner_b = np.repeat(np.arange(5), lens_a), np.repeat(np.arange(5), lens_b)
    assert got == sorted((i, j, n) for (i, j), n in collections.Counter(zip(owner_a.tolist(), owner_b.tolist())).items())


def test_group_links_are_products():
    ga, gb, n = A.groups_of(np.array([2, 3, 1, 4]), np.array([5, 1, 1, 3]))
    assert (ga.tolist(), gb.tolist(), n) == ([0, 0, 1, 2], [0, 1, 2, 2], 3)
    links = {(int(r), int(c)) for row, col, _ in A.token_groups(ga).product(A.group_tokens(gb, n)) for r, c in zip(row, col)}
    assert links == {(i, j) for i in range(4) for j in range(4) if ga[i] == gb[j]}


def plain(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A.default_a()), SentencePieceProcessor(model_file=A.default_b())
    one.encode_special_tokens = True
    letters = A._byte_of_letter()
    docs = []
    for d, t in rows:
        docs.append((d, [], [], [], [], ""))
        if not t:
            continue
        a, b = one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)
        in_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        in_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(in_a) != (" " + t).encode() or b"".join(in_b) != (" " + t).encode():
            continue
        ends = [np.cumsum([len(x) for x in v]).tolist() for v in (in_a, in_b)]
        spans = [list(zip([0, *e[:-1]], e)) for e in ends]
        links, near = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][near][1] <= s:
                near += 1
            j = near
            while j < len(b) and spans[1][j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        groups, last, pairs = [], 0, 0
        for cut in sorted({*ends[0]} & {*ends[1]}):
            g = [[str(i) for i, (s, _) in zip(ids, sp) if last <= s < cut] for ids, sp in zip((a, b), spans)]
            pairs += len(g[0]) * len(g[1])
            groups.append(",".join(g[0]) + "|" + ",".join(g[1]))
            last = cut
        docs[-1] = (d, a, b, links, [pairs, len(groups)], ";".join(groups))
    count = collections.Counter(p for d in docs for p in set(d[3]))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(((d, len(a), len(b), g[1] if g else 0, len(p), g[0] if g else 0, sum(count[x] == best[x[0]] for x in p), sum(count[x] for x in p), s) for d, a, b, p, g, s in docs), key=repr)


ROWS = [
    (1, "Hello world"), (1, "Hello world"), (None, "x"), (2, None), (3, ""), (4, "a▁b"), (5, "<s></s> <|endoftext|> <0x41>"), (6, "ünï 日本語 😀 \u0000 \n\n\t x"),
    (7, " " * 50), (8, "ab" * 3000), (9, "Привет мир, c'est l'été"), (9, "same id"), (10, "   lead"), (11, "　 \u0085 sp"), (12, "﻿x​"), (13, "x" * 1500 + " y"),
]


def test_against_plain(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(A, "PART_BYTES", 2000)
    t = pq.read_table(f"{sf_dir}/documents.parquet").select(["doc_id", "text"]).slice(0, 40).to_pylist()
    rows = ROWS + [(r["doc_id"] + 1000, (r["text"] or "")[:3000]) for r in t]
    d = A.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_group_links, r.n_best, r.count_sum, r.groups) for r in d.collect()), key=repr)
    assert got == plain(rows)


def test_digest_odd_rows_and_names(spark):
    kind = "doc_id long, text string, lang string, n_best string, slice string"
    df = spark.createDataFrame([(d, t, "en", "own", "s") for d, t in ROWS], kind)
    texts, digests = A.align(df), A.align(df, digest=True)
    assert texts.columns == ["doc_id", "lang", "slice", *A.RESULTS]
    rows = lambda d: sorted((r.doc_id is None, r.doc_id, r.n_a, r.slice, r.groups) for r in d.collect())
    assert [(*r[:4], hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "") for r in rows(texts)] == rows(digests)
    assert A.align(spark.createDataFrame([], kind)).count() == 0


def test_fast_encoder_equals_the_file(sf_dir):
    enc = A.ByteTokenizer(A.default_a())
    assert enc.fast is not None
    texts = [" " + (r or "")[:4000] for r in pq.read_table(f"{sf_dir}/documents.parquet")["text"].slice(0, 80).to_pylist()]
    plain_ids = [e.ids for e in enc.model.encode_batch(texts, add_special_tokens=False)]
    assert [enc.ids(t).tolist() for t in texts] == plain_ids
