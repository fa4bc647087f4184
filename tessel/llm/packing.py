"""Packing: documents become sequences of a fixed length by order-preserving dynamic programming.

The tokens of consecutive documents form one stream for each input partition. Windows are cut at document ends and, for a
penalty, at sentence ends. Only in a stretch without either that is longer than a window may a cut fall elsewhere, for a
penalty that outweighs the padding of most windows. The cost of a plan is its padding plus its penalties; a
monotone queue gives the best cut for each candidate in constant time. The stream is planned in runs of bounded length, and
the last, unfinished window of a run goes on into the next, so memory does not grow with the partition or with a text. What
remains at the end of a partition is cut into powers of two, which need no padding. Nothing is shuffled.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_ID = 1
#: In a stretch without a boundary that is longer than a window, a cut may fall at each STRIDE-th token of the stretch.
STRIDE = 16
#: In padding tokens, what a cut costs inside a document at a sentence's end, and inside a sentence.
SENTENCE_PENALTY, INSIDE_PENALTY = 8, 64
#: Ends of tokens that end a sentence or a line: full stops, of CJK texts too, as this vocabulary shows their bytes; Ċ is a line feed.
SENTENCE_ENDS = (".", "!", "?", "Ċ", "ãĢĤ", "ï¼ģ", "ï¼Ł")
#: Tokens that are planned together.
RUN = 1 << 17


class _Encoder:
    """Ids of whole texts as little-endian 32-bit words, with frequent space-separated pieces remembered.

    The pre-tokenizer never joins what stands before a single space (or line feed) and what follows it when neither
    neighbour is white space, so a text without two white-space characters in a row is encoded piece by piece. Any other
    text, and one that holds a special token's string, is encoded as a whole.
    """

    MOST = 100_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}  # by piece, without the space before it
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._same_by_rank(path)
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith(SENTENCE_ENDS)
        self.ends = ends

    @staticmethod
    def _same_by_rank(path: str):
        """The same byte-level BPE in a form that is faster on short pieces, or None if ids aren't in the order of the merges."""
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        if sys.byteorder != "little" or array("I").itemsize != 4:
            return None
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"].get(t) for t in joined] != list(range(256, 256 + len(joined))):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(joined)}
        return tiktoken.Encoding("by_rank", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _short(self, text: str) -> bytes:
        return array("I", self.ranked.encode_ordinary(text)).tobytes() if self.ranked else self._plain(text)

    def _new(self, piece: str) -> bytes:
        out = self._short(piece if piece[:1] == "\n" else " " + piece)
        if len(piece) <= 32 and len(self.known) < self.MOST:  # so what is remembered is bounded in bytes
            self.known[piece] = out
        return out

    def ids(self, text: str) -> bytes:
        pieces = text.replace("\n", " \n").split(" ")
        if "" in pieces or "\n" in pieces or len(text.split()) != len(pieces) or any(t in text for t in self.added):
            return self._plain(text)
        known, new = self.known, self._new
        return self._short(pieces[0]) + b"".join([known[p] if p in known else new(p) for p in pieces[1:]])


_ENCODERS: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """One for each worker process, so that what it remembers serves all of the worker's tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def plan_cuts(positions: list[int], penalties: list[int], size: int) -> list[int]:
    """The cheapest increasing cuts of a stream from 0, with windows of at most size, the last in its last size tokens.

    positions are the candidates in order, at most size apart; a window (i, j] costs its padding, size - (j - i), and j's
    penalty. With g(i) = cost(i) + i, cost(j) is the least g(i) of the window + size - j + penalty(j): a sliding minimum,
    kept in a monotone queue. Of equal ends the furthest wins. What stands behind the last cut is left.
    """
    best, back = [0] * len(positions), [0] * len(positions)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # (g, position, index), g and position increasing
    for j, at in enumerate(positions):
        while queue[0][1] < at - size:
            queue.popleft()
        g, _, back[j] = queue[0]
        best[j] = cost = g + size - at + penalties[j]
        g = cost + at
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, at, j))
    j = len(positions) - 1
    for i in range(len(positions) - 1, -1, -1):
        if positions[i] <= positions[-1] - size:
            break
        if best[i] < best[j]:
            j = i
    cuts = []
    while j >= 0:
        cuts.append(positions[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Takes documents in order and gives pieces; window bounds are planned a run at a time."""

    def __init__(self, ends: np.ndarray, size: int, sequence_from: int) -> None:
        self.ends, self.size, self.sequence = ends, size, sequence_from
        self.waiting: list[tuple[int | None, int, int, bytes]] = []  # doc_id, start of what waits, doc_tokens, ids
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        for start in range(0, total, RUN):
            part = ids[4 * start : 4 * (start + RUN)]
            self.waiting.append((doc_id, start, total, part))
            self.tokens += len(part) // 4
            if self.tokens >= RUN:
                yield from self._emit(self._plan())

    def _plan(self) -> list[int]:
        ids = np.frombuffer(b"".join(w[3] for w in self.waiting), "<u4")
        cost = np.full(len(ids) + 1, -1, np.int64)
        cost[np.flatnonzero(self.ends[ids]) + 1] = SENTENCE_PENALTY
        at = 0
        for _, start, total, part in self.waiting:
            at += len(part) // 4
            if start + len(part) // 4 == total:
                cost[at] = 0
        cost[0] = -1
        if cost[len(ids)] < 0:
            cost[len(ids)] = INSIDE_PENALTY
        bounds = np.concatenate([[0], np.flatnonzero(cost >= 0)])
        for k in np.flatnonzero(np.diff(bounds) > self.size).tolist():
            cost[bounds[k] + min(STRIDE, self.size) : bounds[k + 1] : min(STRIDE, self.size)] = INSIDE_PENALTY
        positions = np.flatnonzero(cost >= 0)
        return plan_cuts(positions.tolist(), cost[positions].tolist(), self.size)

    def _emit(self, cuts: list[int]) -> Iterator[tuple]:
        """The pieces of the windows up to the last cut; what follows goes on waiting."""
        queue, k, offset, at = deque(self.waiting), 0, 0, 0
        while k < len(cuts):
            doc_id, start, total, ids = queue.popleft()
            n = min(len(ids) // 4, cuts[k] - at)
            yield doc_id, start, n, zlib.crc32(ids[: 4 * n]), total, self.sequence, offset
            if n < len(ids) // 4:
                queue.appendleft((doc_id, start + n, total, ids[4 * n :]))
            at, offset = at + n, offset + n
            if at == cuts[k]:
                k, offset, self.sequence = k + 1, 0, self.sequence + 1
        self.waiting = list(queue)
        self.tokens -= at

    def finish(self) -> Iterator[tuple]:
        if not self.tokens:
            return
        if self.tokens > self.size:
            yield from self._emit(self._plan())
        at, cuts, rest = 0, [], self.tokens
        while rest:  # powers of two, the largest first
            step = min(self.size, 1 << (rest.bit_length() - 1))
            at, rest = at + step, rest - step
            cuts.append(at)
        yield from self._emit(cuts)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048) -> DataFrame:
    """SCHEMA, one row for each piece of a document in a sequence.

    Each document is its ids and the end id; a null or empty text has the end id only. Sequences keep the order in which
    documents stand in their partition and hold at most size tokens (a power of two); sequence_id is unique over all
    partitions. Rows that share a doc_id are packed each for itself. Only doc_id and text are read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        packer = Packer(enc.ends, size, TaskContext.get().partitionId() << 33)
        kinds = [pa.int64()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        end = np.asarray([END_ID], "<u4").tobytes()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        rows: list[tuple] = []
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                rows += packer.add(ids[i], (enc.ids(text) if text else b"") + end)
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield batch(rows)

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(pack, SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
