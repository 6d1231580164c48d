"""Hierarchical multi-length packing.

Documents are tokenized and routed to context-size tiers. Whole windows of the
longest tier are cut off first; what remains opens a window of the smallest
tier that holds it. Gaps of longer windows are filled with pieces of shorter
tiers, so windows end up full at a power of two. Sequences are then dealt to
step groups of even token counts. Packing follows the partitions of the input:
nothing is shuffled, and a task holds no more than a slice of its documents.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept_in_worker

END_ID = 2
#: Context sizes; powers of two, ascending
TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 1 << 16
SLICE_DOCS = 64
#: Words, and pieces of words, that a worker remembers the ids of during a stage; more make it forget and start anew
MEMORY = 1_300_000

#: What the tokenizer's file splits words by (fixed values)
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN = re.compile("[!-~\xa1-\xff]+")

#: In Latin-1: lower case; white space, marks and lower-case letters; and the letter that stands for each byte in the tokenizer's file
LOWER = bytes(ord(chr(i).lower()) for i in range(256))
SIMPLE = b" \t\n\r\x0b\x0c,." + bytes(i for i in range(256) if chr(i).isalpha() and LOWER[i] == i)
DIGIT = re.compile(rb"[0-9]")
BYTE_LEVEL = dict(zip([i for i in range(256) if not (33 <= i <= 126 or 161 <= i <= 172 or 174 <= i)], map(chr, range(256, 512))))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Pieces(dict):
    """Ids of lower-case pieces of words in Latin-1, straight from the file's model; new ones are added as they are asked for."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode("latin-1")
        if not piece.isascii():
            text = text.encode().decode("latin-1").translate(BYTE_LEVEL)
        ids = [t.id for t in self.model.tokenize(text)]
        self[piece] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found


class WordTokenizer:
    """Ids of texts from a file whose model drops white space, remembered word by word.

    White space always ends a token of such a model, so a text's ids are its words' ids in turn.
    Words of plain Latin letters are split further and share the ids of their lower-case pieces.
    A text of nothing but letters, digits, commas and full stops is cut into pieces as a whole.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.memory = memory
        self.words: dict[bytes, bytes] = {}
        self.pieces = Pieces(self.model)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: set[bytes]) -> None:
        whole = []
        for w in missing:
            s = w.decode("utf-8", "replace")
            if PLAIN.fullmatch(s) and "<|" not in s:
                self.words[w] = b"".join([self.pieces[p.encode("latin-1")] for p in PIECES.findall(s.lower())])
            else:
                whole.append((w, s))
        self.words.update(zip([w for w, _ in whole], self._encode([s for _, s in whole])))

    def _cut(self, text: str) -> list[bytes] | None:
        """Pieces of a text that has only letters, single marks and digits; None for any other."""
        try:
            low = text.encode("latin-1").translate(LOWER)
        except UnicodeEncodeError:
            return None
        other = low.translate(None, SIMPLE)
        if other:
            if not other.isdigit():
                return None
            low = DIGIT.sub(rb" \g<0> ", low)
        # marks in a row are one piece
        if b",." in low or b".," in low or b",," in low or b".." in low:
            return None
        return low.replace(b",", b" , ").replace(b".", b" . ").split()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.pieces) > self.memory:
            self.pieces = Pieces(self.model)
        piece = self.pieces.__getitem__
        out: list[bytes | None] = []
        split = []
        for t in texts:
            cut = self._cut(t or "")
            out.append(None if cut is None else b"".join(map(piece, cut)))
            if cut is None:
                split.append(t.encode("utf-8", "replace").split())
        # text by text: a small set stays in the processor's cache, one of all texts does not
        missing: set[bytes] = set()
        for words in split:
            missing.update(set(words).difference(self.words))
        if missing:
            if len(self.words) + len(missing) > self.memory:
                self.words, missing = {}, set().union(*split)
            self._learn(missing)
        get = self.words.__getitem__
        rest = iter(split)
        return [b"".join(map(get, next(rest))) if x is None else x for x in out]


class Packer:
    """Fills windows from a stream of documents; ``take`` returns the sequences that are complete."""

    def __init__(self, tiers=TIERS):
        self.tiers = sorted(tiers)
        self.waiting: list[deque] = [deque() for _ in self.tiers]

    def _route(self, piece: tuple) -> None:
        _, _, length = piece
        self.waiting[next(i for i, t in enumerate(self.tiers) if length <= t)].append(piece)

    def _fill(self, window: list, gap: int, below: int) -> int:
        """Pieces of the tiers under ``below``, shortest first, then of the tier itself; cut where the gap ends."""
        for i in [*range(below), below]:
            queue = self.waiting[i]
            while gap and queue:
                doc, start, length = queue.popleft()
                use = min(length, gap)
                window.append((doc, start, use))
                gap -= use
                if use < length:
                    self._route((doc, start + use, length - use))
        return gap

    def take(self, docs: list[tuple]) -> Iterator[list]:
        """``docs``: (document, tokens). Yields windows, lists of (document, start, length)."""
        top = self.tiers[-1]
        for doc, n in docs:
            whole = n // top * top
            for at in range(0, whole, top):
                yield [(doc, at, top)]
            if n > whole:
                self._route((doc, whole, n - whole))
        yield from self._windows()

    def _windows(self) -> Iterator[list]:
        for i in range(len(self.tiers) - 1, -1, -1):
            while self.waiting[i]:
                doc, start, length = self.waiting[i].popleft()
                window = [(doc, start, length)]
                if self._fill(window, self.tiers[i] - length, i):
                    # nothing is left to fill it with: it waits for more documents
                    for piece in window:
                        self._route(piece)
                    return
                yield window

    def rest(self) -> Iterator[list]:
        """At the end of the stream: what waits, in windows of the longest tier; the last is cut at powers of two down to the shortest."""
        left = [p for q in self.waiting for p in q]
        self.waiting = [deque() for _ in self.tiers]
        total = sum(p[2] for p in left)
        sizes = []
        for t in reversed(self.tiers):
            sizes += [t] * (total // t)
            total %= t
        queue = deque(left)
        for size in [*sizes, total]:
            window = []
            while size:
                doc, start, length = queue.popleft()
                use = min(length, size)
                window.append((doc, start, use))
                size -= use
                if use < length:
                    queue.appendleft((doc, start + use, length - use))
            if window:
                yield window


def step_groups(lengths: list[int], step_tokens: int) -> list[int]:
    """Group of each sequence: longest first, always to the group with the fewest tokens."""
    total = sum(lengths)
    heap = [(0, g) for g in range(max(1, -(-total // step_tokens)))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        tokens, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (tokens + lengths[i], g))
    return out


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, tiers=TIERS, step_tokens: int = STEP_TOKENS, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, step_group.

    Null and empty texts are documents of one token, the end id. Repeated rows and null ids are documents
    of their own. Each task numbers its own sequences and groups, so numbers are unique but have
    gaps between tasks; a task run again gives the same ones. Only the last sequence of a task can be
    at other than a power of two. An empty table gives no pieces.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_in_worker(path, lambda: WordTokenizer(path))
        packer = Packer(tiers)
        base = TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype="<u4").tobytes()
        state = {"seq": 0, "group": 0}

        def out(windows: list[list], id_type: pa.DataType) -> pa.RecordBatch | None:
            lengths = [sum(p[2] for p in w) for w in windows]
            groups = step_groups(lengths, step_tokens)
            cols: list[list] = [[] for _ in range(9)]
            for window, total, group in zip(windows, lengths, groups):
                offset = 0
                for (key, ids), start, length in window:
                    row = (key, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, base + state["seq"], offset, total, base + state["group"] + group)
                    for c, v in zip(cols, row):
                        c.append(v)
                    offset += length
                state["seq"] += 1
            state["group"] += max(groups, default=-1) + 1
            return pa.record_batch([pa.array(cols[0], type=id_type), *[pa.array(c, type=pa.int64()) for c in cols[1:]]], names=["id", *(x.split()[0] for x in SCHEMA.split(", "))])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(0, batch.num_rows, SLICE_DOCS):
                part = batch.slice(i, SLICE_DOCS)
                ids = [x + end for x in words.ids(part.column(1).to_pylist())]
                fed = [((k, x), len(x) // 4) for k, x in zip(part.column(0).to_pylist(), ids)]
                if windows := list(packer.take(fed)):
                    yield out(windows, id_type)
        if windows := list(packer.rest()):
            yield out(windows, id_type)

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"id {kind.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)
