"""Alignment of two tokenizers: which tokens of one cover bytes that tokens of the other cover.

Texts are tokenized twice in slices. A slice's tokens and bytes form incidence matrices in compressed rows, built by
hand. The product of token-by-byte and byte-by-token rows, summed row by row, holds the links of overlapping
tokens; the product of token-by-group and group-by-token rows holds the links of tokens that share a group.
Slices are written once with their links as counts of pairs; pairs are summed over the corpus where they
meet by hash, and each slice gets back the sums of its own pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import forget_other_stages, kept_in_worker, partitions, written
from tidemark.llm.substrings import _part

#: Bytes of text that form a slice; a longer text is a slice of its own
SLICE_BYTES = 4 << 20
#: Bytes of text behind one part of the pairs
PART_BYTES = 24 << 20
#: Entries that a product expands at a time
BLOCK = 1 << 19
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups", "n_best", "count_sum")

#: Characters whose classes are the same in every library's tables; other texts take the slower encoder. Not in runs beyond 1,000 of a kind
PLAIN = re.compile("[\t\n\r -~\xa1-ȗΑ-ΡΣ-ωА-я‐-…ぁ-ゔァ-ヺ一-龥]*")
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def default_a() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_b() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Bytes of each token."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.lens = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begins = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lens = self.lens[ids]
        return self.flat[np.repeat(self.begins[ids] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]


def _byte_of_letter() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """Encoder A: a byte-level BPE file.

    Where the merges come in the order of ids, merging by rank gives the same ids, so plain texts take the faster encoder.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters = _byte_of_letter()
        special = {t["id"] for t in said.get("added_tokens", [])}
        tokens = [b""] * (max([*said["model"]["vocab"].values(), *special]) + 1)
        for word, i in said["model"]["vocab"].items():
            tokens[i] = word.encode() if i in special else bytes(letters[c] for c in word)
        self.vocabulary = Vocabulary(tokens)
        merges = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
        in_order = [said["model"]["vocab"][a + b] for a, b in merges] == list(range(256, 256 + len(merges)))
        ranks = {t: i for i, t in enumerate(tokens) if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast and PLAIN.fullmatch(text) and not LONG_RUN.search(text):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=())).astype(np.int32)
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=np.int32)


class PieceTokenizer:
    """Encoder B: a piece model with byte fallback; it puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        tokens = [b"" if self.model.is_control(i) or self.model.is_unknown(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        for i in range(n):
            if self.model.is_byte(i):
                tokens[i] = bytes([int(self.model.id_to_piece(i)[3:5], 16)])
        self.vocabulary = Vocabulary(tokens)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype=np.int32)


class Rows:
    """A 0/1 matrix in compressed rows: columns of row i are ``cols[begins[i]:begins[i + 1]]``."""

    def __init__(self, begins: np.ndarray, cols: np.ndarray):
        self.begins, self.cols = begins, cols

    def __len__(self) -> int:
        return len(self.begins) - 1

    def row_sums(self, weights: np.ndarray) -> np.ndarray:
        """The product with a column of weights."""
        sums = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(weights[self.cols])])
        return sums[self.begins[1:]] - sums[self.begins[:-1]]

    def product(self, other: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, column, value) of the product, by blocks of rows: every entry of a row adds the other matrix's row of its column."""
        lens = np.diff(other.begins)
        work = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lens[self.cols])])[self.begins]
        at = 0
        while at < len(self):
            end = max(int(np.searchsorted(work, work[at] + BLOCK, side="right")) - 1, at + 1)
            cols = self.cols[self.begins[at] : self.begins[end]]
            n = lens[cols]
            of = np.repeat(np.arange(at, end), np.diff(self.begins[at : end + 1]))
            row = np.repeat(of, n)
            col = other.cols[np.repeat(other.begins[cols] - (np.cumsum(n) - n), n) + np.arange(len(row))]
            at = end
            if not len(row):
                continue
            same = row[1:] == row[:-1]
            if (same & (col[1:] < col[:-1])).any():
                o = np.lexsort((col, row))
                row, col = row[o], col[o]
                same = row[1:] == row[:-1]
            head = np.flatnonzero(np.concatenate([[True], ~same | (col[1:] != col[:-1])]))
            yield row[head], col[head], np.diff(np.append(head, len(row)))


def token_bytes(lens: np.ndarray) -> Rows:
    """Tokens by the bytes they cover, one after another."""
    ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lens)])
    return Rows(ends, np.arange(ends[-1]))


def byte_tokens(lens: np.ndarray) -> Rows:
    """The transpose of ``token_bytes``: every byte lies in one token."""
    owner = np.repeat(np.arange(len(lens)), lens)
    return Rows(np.arange(len(owner) + 1), owner)


def token_groups(group: np.ndarray) -> Rows:
    """Tokens by their group."""
    return Rows(np.arange(len(group) + 1), group)


def group_tokens(group: np.ndarray, n: int) -> Rows:
    """Groups by their tokens; groups rise with tokens."""
    return Rows(np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(np.bincount(group, minlength=n))]), np.arange(len(group)))


def groups_of(lens_a: np.ndarray, lens_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of every token of A and B, and their number: bytes are cut where tokens of both end."""
    ends_a, ends_b = np.cumsum(lens_a), np.cumsum(lens_b)
    total = int(ends_a[-1]) if len(ends_a) else 0
    cut = np.zeros(total + 1, dtype=np.int8)
    cut[ends_a] = 1
    cut[ends_b] += 1
    group = np.cumsum(cut == 2)
    return group[ends_a - lens_a], group[ends_b - lens_b], int(group[-1]) if total else 0


class Names:
    """Decimal ids with what follows them, as bytes."""

    def __init__(self, a: int, b: int):
        self.a = a
        self.names = np.array([b"%d%s" % (i, sep) for n, ends in ((a, (b",", b"|")), (b, (b",", b";"))) for sep in ends for i in range(n)], dtype=object)
        self.start_b, self.b = 2 * a, b

    def of(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: int) -> np.ndarray:
        """Tokens of A and B by group, A first, as places in ``names``."""
        count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        out = np.empty(len(a) + len(b), dtype=np.int64)
        last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        out[np.arange(len(a)) + (np.cumsum(count_b) - count_b)[group_a]] = a + self.a * last_a
        out[np.arange(len(b)) + np.cumsum(count_a)[group_b]] = self.start_b + b + self.b * last_b
        return out


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in planes of bytes, compressed."""
    raw = [v for a in arrays for v in (np.int64(len(a)).tobytes(), np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


def _unsqueeze(body: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    for kind in map(np.dtype, kinds):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 8).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 8 + n * kind.itemsize
    return out


class Aligner:
    """Both tokenizers and the tables made from them."""

    def __init__(self, path_a: str, path_b: str, digest: bool):
        self.a, self.b, self.digest = ByteTokenizer(path_a), PieceTokenizer(path_b), digest
        self.names = Names(self.a.vocabulary.size, self.b.vocabulary.size)

    def tokens(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts whose tokens join to a space and the text, their numbers of tokens, and all tokens."""
        good, all_a, all_b = [], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
        va, vb = self.a.vocabulary, self.b.vocabulary
        for i, text in enumerate(texts):
            if not text:
                continue
            said = " " + text
            a, b = self.a.ids(said), self.b.ids(text)
            raw = np.frombuffer(said.encode(), dtype=np.uint8)
            if np.array_equal(va.joined(a), raw) and np.array_equal(vb.joined(b), raw):
                good.append(i), all_a.append(a), all_b.append(b)
        n_a, n_b = (np.array([len(x) for x in v[1:]], dtype=np.int64) for v in (all_a, all_b))
        return good, n_a, n_b, np.concatenate(all_a), np.concatenate(all_b)

    def slice(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray | list], bytes, bytes]:
        """Results of each text, links of each text by pair, and how many texts have each pair."""
        good, n_a, n_b, a, b = self.tokens(texts)
        lens_a, lens_b = self.a.vocabulary.lens[a], self.b.vocabulary.lens[b]
        doc_a, doc_b = np.repeat(np.arange(len(good)), n_a), np.repeat(np.arange(len(good)), n_b)
        group_a, group_b, n = groups_of(lens_a, lens_b)
        keys, n_links = [np.zeros(0, dtype=np.int64)], np.zeros(len(good), dtype=np.int64)
        docs = [np.zeros(0, dtype=np.int64)]
        for row, col, _ in token_bytes(lens_a).product(byte_tokens(lens_b)):
            docs.append(doc_a[row])
            keys.append(a[row].astype(np.int64) * self.b.vocabulary.size + b[col])
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        n_links += np.bincount(docs, minlength=len(good))
        per_token = token_groups(group_a).row_sums(np.diff(group_tokens(group_b, n).begins)) if len(a) else np.zeros(0, dtype=np.int64)
        found = pa.array(keys).dictionary_encode()
        pairs, place = found.dictionary.to_numpy(), found.indices.to_numpy().astype(np.int64)
        order = np.argsort(pairs)
        rank = np.empty(len(pairs), dtype=np.int64)
        rank[order], pairs = np.arange(len(pairs)), pairs[order]
        held = np.sort(docs * max(len(pairs), 1) + rank[place])
        head = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.append(head, len(held)))
        held = held[head]
        of, rank = held // max(len(pairs), 1), held % max(len(pairs), 1)
        steps = rank.copy()
        steps[1:] -= np.where(of[1:] == of[:-1], rank[:-1], 0)
        at = np.array(good, dtype=np.int64)
        out = {"n_a": np.zeros(len(texts), np.int64), "n_b": np.zeros(len(texts), np.int64), "n_groups": np.zeros(len(texts), np.int64), "n_links": np.zeros(len(texts), np.int64), "n_group_links": np.zeros(len(texts), np.int64)}
        out["n_a"][at], out["n_b"][at], out["n_links"][at] = n_a, n_b, n_links
        last = np.cumsum(n_a) - 1
        upto = group_a[last] + 1 if len(good) else at
        out["n_groups"][at] = np.diff(upto, prepend=0)
        out["n_group_links"][at] = np.bincount(doc_a, weights=per_token, minlength=len(good)).astype(np.int64)
        said = [""] * len(texts)
        code, ends = self.names.of(a, b, group_a, group_b, n) if len(a) else None, np.cumsum(n_a + n_b)
        for k, i in enumerate(good):
            line = b"".join(self.names.names[code[ends[k] - n_a[k] - n_b[k] : ends[k]]].tolist())[:-1]
            said[i] = hashlib.sha256(line).hexdigest() if self.digest else line.decode()
        out["groups"] = said
        entries = np.zeros(len(texts), dtype=np.int64)
        entries[at] = np.bincount(of, minlength=len(good))
        return out, _squeeze(entries.astype(np.uint32), steps.astype(np.uint32), times.astype(np.uint32)), _squeeze(pairs, np.bincount(rank, minlength=len(pairs)).astype(np.uint32))


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")


def _slices(row: T.DataType, path_a: str, path_b: str, digest: bool):
    """A row for each slice of documents."""

    def of(aligner: Aligner, texts: list[str | None], rows: list[pa.Array]) -> pa.RecordBatch:
        got, links, pairs = aligner.slice(texts)
        rows = pa.concat_arrays(rows)
        docs = pa.StructArray.from_arrays([rows, *[pa.array(got[c], pa.int64()) for c in COUNTS], pa.array(got["groups"], pa.string())], names=["row", *COUNTS, "groups"])
        docs = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
        return pa.record_batch([pa.array([uuid.uuid4().hex]), docs, pa.array([links], pa.binary()), pa.array([pairs], pa.binary())], names=["slice", "docs", "links", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept_in_worker("aligner", lambda: Aligner(path_a, path_b, digest))
        texts, rows, held = [], [], 0
        for batch in batches:
            at = 0
            for k, text in enumerate(batch.column(0).to_pylist()):
                size = len(text or "")
                if texts and held + size > SLICE_BYTES:
                    yield of(aligner, texts, [*rows, batch.column(1).slice(at, k - at)])
                    texts, rows, held, at = [], [], 0, k
                texts.append(text)
                held += size
            rows.append(batch.column(1).slice(at))
        if texts:
            yield of(aligner, texts, rows)

    docs = T.StructType().add("row", row)
    for c in COUNTS:
        docs = docs.add(c, "long")
    return run, T.StructType().add("slice", "string").add("docs", T.ArrayType(docs.add("groups", "string"))).add("links", "binary").add("pairs", "binary")


def _ask(parts: int):
    """Pairs of each slice by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs, n = _unsqueeze(body, np.int64, np.uint32)
                part = _part(pairs.view(np.uint64), parts)
                o = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[o], np.arange(parts + 1))
                some = [p for p in range(parts) if edges[p] < edges[p + 1]]
                bodies = [_squeeze(pairs[i := o[edges[p] : edges[p + 1]]], n[i]) for p in some]
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array([name] * len(some), pa.string()), pa.array(bodies, pa.binary())], names=["part", "slice", "body"])

    return run


def _sum(size_b: int):
    """Sums pairs over slices: a row of sums for each slice in the order it asked, and the highest sum of each id of A."""

    def settle(part: int, names: list[str], bodies: list[bytes]) -> pa.RecordBatch:
        pairs, n = zip(*(_unsqueeze(b, np.int64, np.uint32) for b in bodies))
        sizes = [len(p) for p in pairs]
        all_, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
        sums = np.zeros(len(all_), dtype=np.int64)
        np.add.at(sums, inverse, np.concatenate(n).astype(np.int64))
        out = [_squeeze(x) for x in np.split(sums[inverse], np.cumsum(sizes)[:-1])]
        ids = all_ // size_b
        head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        best = _squeeze(ids[head], np.maximum.reduceat(sums, head))
        return pa.record_batch([pa.array([part] * (len(out) + 1), pa.int32()), pa.array([*names, None], pa.string()), pa.array([*out, best], pa.binary())], names=["part", "slice", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        part, names, bodies = None, [], []
        for batch in batches:
            for p, name, body in zip(*(batch.column(c).to_pylist() for c in ("part", "slice", "body"))):
                if p != part and bodies:
                    yield settle(part, names, bodies)
                    names, bodies = [], []
                part = p
                names.append(name), bodies.append(body)
        if bodies:
            yield settle(part, names, bodies)

    return run


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column(0).to_pylist():
            a, n = _unsqueeze(body, np.int64, np.int64)
            yield pa.record_batch([pa.array(a), pa.array(n)], names=["a", "n"])


def _finish(size_b: int, parts: int, best: np.ndarray):
    """Sums and best links of the documents of a slice."""

    def run(asked: pa.Table, told: pa.Table) -> pa.Table:
        pairs, _ = _unsqueeze(asked.column("pairs")[0].as_py(), np.int64, np.uint32)
        entries, steps, times = _unsqueeze(asked.column("links")[0].as_py(), np.uint32, np.uint32, np.uint32)
        o = np.argsort(_part(pairs.view(np.uint64), parts), kind="stable")
        bodies = dict(zip(told.column("part").to_pylist(), told.column("body").to_pylist()))
        sums = np.zeros(len(pairs), dtype=np.int64)
        if bodies:
            sums[o] = np.concatenate([_unsqueeze(bodies[p], np.int64)[0] for p in sorted(bodies)])
        is_best = sums == best[pairs // size_b]
        ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(entries, dtype=np.int64)])
        walk = np.cumsum(steps, dtype=np.int64)
        # steps start anew with each document
        base = np.where(ends[:-1] > 0, walk[np.maximum(ends[:-1] - 1, 0)], 0) if len(walk) else np.zeros(len(entries), dtype=np.int64)
        place = walk - np.repeat(base, entries)
        add = lambda v: np.diff(np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(v * times.astype(np.int64))])[ends])
        docs = asked.column("docs").combine_chunks().flatten()
        fields = [docs.field(c) for c in ("row", *COUNTS, "groups")]
        return pa.table([*fields, pa.array(add(is_best[place].astype(np.int64))), pa.array(add(sums[place]))], names=["row", *RESULTS])

    return run


def align(docs: DataFrame, text_col: str = "text", path_a: str | None = None, path_b: str | None = None, digest: bool = False) -> DataFrame:
    """Adds what two tokenizers' tokens of each text share; the text itself is dropped.

    n_a, n_b: tokens. n_groups: stretches between ends common to both; ``groups`` lists them as ``a1,a2|b1;a3|b2`` by ids, or its
    SHA-256 where ``digest`` is set. n_links: pairs of tokens that overlap; n_group_links: pairs that share a group. A pair of ids
    counts the documents that hold it linked, repeated rows included; n_best: links whose count is the highest of
    their A id, count_sum: counts of all links. A text that is null, empty or whose tokens do not join to a space and itself has
    zeros and ''. All other columns stay, those with the names of results are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS)
    path_a, path_b = path_a or default_a(), path_b or default_b()
    size_b = PieceTokenizer(path_b).vocabulary.size
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = partitions(spark, size, PART_BYTES)
    rest = [c for c in docs.columns if c != text_col]
    texts = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(1).alias("_")).alias("row"))
    run, schema = _slices(texts.schema["row"].dataType, path_a, path_b, digest)
    slices = written(texts.mapInArrow(run, schema), "slices")
    asked = slices.select("slice", "pairs").mapInArrow(_ask(parts), "part int, slice string, body binary")
    told = written(asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_sum(size_b), "part int, slice string, body binary"), "pairs")
    # one row for each id of the vocabulary at most
    highest = told.where("slice IS NULL").select("body").mapInArrow(_best, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).collect()
    best = np.zeros(max([r["a"] for r in highest], default=0) + 1, dtype=np.int64)
    for r in highest:
        best[r["a"]] = r["n"]
    out = T.StructType().add("row", slices.schema["docs"].dataType.elementType["row"].dataType)
    for c in RESULTS:
        out = out.add(c, "string" if c == "groups" else "long")
    done = slices.groupBy("slice").cogroup(told.where("slice IS NOT NULL").groupBy("slice")).applyInArrow(_finish(size_b, parts, best), out)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], *RESULTS)
