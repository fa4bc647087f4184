"""Unigram tokenization with the pieces and scores of a SentencePiece model file: counting, streaming encoding, decoding.

The best segmentation is the one of the highest total score. Ties go, at each position, to the piece that starts first (the
longest), as the usual unigram tokenizers do. A character that no piece covers costs the least score of any piece less 10 and
becomes its UTF-8 bytes. Scores are added in double precision, and where they are whole numbers every sum is exact.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
_UNKNOWN_PENALTY = 10.0
#: Segments that a worker remembers, and the characters of one at most, so that their bytes are bounded.
MOST, LONGEST = 300_000, 64
#: Characters of a text that its stream gets at a time.
PART = 4096
#: A text's line feeds, and its words with the space marks in front of them.
_STRETCH = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
_LEAST = float("-inf")


class Vocabulary:
    """Pieces by an Aho-Corasick automaton. Control, unknown and byte pieces never match text."""

    def __init__(self, pieces: list[tuple[str, float, int]], bytes_at: int, size: int) -> None:
        """pieces: (piece, score, id); bytes_at: the id of byte 0; size: the number of ids."""
        self.automaton = ahocorasick.Automaton()
        for piece, score, i in pieces:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.longest = max(len(p) for p, _, _ in pieces)
        #: All that a piece begins with, from two characters on.
        self.begun = {p[:k] for p, _, _ in pieces for k in range(2, len(p) + 1)}
        self.single = {p for p, _, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s, _ in pieces) - _UNKNOWN_PENALTY
        self.bytes_at = bytes_at
        self.text_of = [b""] * size
        for piece, _, i in pieces:
            self.text_of[i] = piece.replace(SPACE, " ").encode()
        for b in range(256):
            self.text_of[bytes_at + b] = bytes([b])
        #: No piece has a space mark behind another character, or a line feed: both part a text for certain.
        self.parts_at_space = not any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces)
        self.parts_at_line = not any("\n" in p for p, _, _ in pieces)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls([(m.id_to_piece(i), m.get_score(i), i) for i in plain], m.piece_to_id("<0x00>"), m.vocab_size())

    def segments(self, text: str) -> Iterator[str]:
        """The text with a space mark in front and for each space, parted where every segmentation has a boundary."""
        if not text:
            return
        lines = text.split("\n") if self.parts_at_line else [text]
        for n, line in enumerate(lines):
            if n:
                yield "\n"
            if not self.parts_at_space:
                if n == 0 or line:
                    yield (SPACE if n == 0 else "") + line.replace(" ", SPACE)
                continue
            first, *rest = line.split(" ")
            marks = SPACE if n == 0 else ""
            if first:
                yield marks + first
                marks = ""
            for w in rest:
                marks += SPACE
                if w:  # a run of spaces stays with the word behind it
                    yield marks + w
                    marks = ""
            if marks:
                yield marks


def count_pieces(v: Vocabulary, text: str) -> tuple[int, float]:
    """Number of ids and score of the best segmentation of a segment, without backpointers."""
    n = len(text)
    best, count = [0.0] + [_LEAST] * n, [0] * (n + 1)
    if not v.single.issuperset(text):
        return _count_with_unknown(v, text)
    for end, (length, score, _) in v.automaton.iter(text):  # by end; of one end, the longest first
        end += 1
        s = best[end - length] + score
        if s > best[end]:
            best[end], count[end] = s, count[end - length] + 1
    return count[n], best[n]


def _by_end(v: Vocabulary, text: str) -> Iterator[list[tuple[int, float, int]]]:
    """For each end in turn, the pieces (length, score, id) there, the longest first; id -1 for an uncovered character."""
    here: list[tuple[int, float, int]] = []
    at = 0
    for end, piece in v.automaton.iter(text):
        while at < end:
            yield here if here and here[-1][0] == 1 else [*here, (1, v.unknown, -1)]
            here, at = [], at + 1
        here.append(piece)
    while at < len(text):
        yield here if here and here[-1][0] == 1 else [*here, (1, v.unknown, -1)]
        here, at = [], at + 1


def _count_with_unknown(v: Vocabulary, text: str) -> tuple[int, float]:
    best, count = [0.0], [0]
    for end, pieces in enumerate(_by_end(v, text), 1):
        top, n = _LEAST, 0
        for length, score, i in pieces:
            s = best[end - length] + score
            if s > top:
                top, n = s, count[end - length] + (1 if i >= 0 else len(text[end - 1].encode("utf-8", "surrogatepass")))
        best.append(top)
        count.append(n)
    return count[-1], best[-1]


class StreamingViterbi:
    """Ids of a text that comes in parts of any size, from one stream.

    A window of the last `longest` positions is all that later pieces can start from. Whenever the backpointer paths of all of
    them meet in one boundary, the ids up to it are final: they are given out and forgotten. Ahead of a space mark, and about a
    line feed, the next character tells more: positions survive only if what stands between them and it begins a piece. Where none does, all
    paths have met at the character itself.

    known, if given, remembers stretches between two such points by their text and the character behind them. One that comes
    again while no path is open is skipped; ids are the same without it.
    """

    def __init__(self, v: Vocabulary, known: dict[str, tuple[int, ...]] | None = None) -> None:
        self.v = v
        self.known = known
        self.tail = ""  # the last longest - 1 characters, which pieces may still reach back into
        self.last = ""  # the last character of all
        self.at = self.done = 0
        # of the positions from done to at: the best score, the length of the last piece there, and its id or its character's bytes
        self.best: list[float] = [0.0]
        self.length: list[int] = [0]
        self.ids: list[int | tuple[int, ...]] = [0]
        self.widest = 0  # the most positions that were ever waiting

    def feed(self, part: str) -> list[int]:
        """The ids that are final once part has come, behind those given out before."""
        out: list[int] = []
        if not part:
            return out
        stretches = _STRETCH.findall(part)
        if self.last == "\n" or part[0] == "\n" or (part[0] == SPACE and self.last != SPACE):
            self._converge(part[0], out)
        self.last = part[-1]
        known = self.known
        for here, then in zip(stretches, stretches[1:]):
            if self.at == self.done and known is not None:
                key = here + then[0]
                ids = known.get(key)
                if ids is not None:
                    out += ids
                    self.at = self.done = self.at + len(here)
                    continue
                n = len(out)
                self._advance(here, out)
                if self._converge(then[0], out) and len(here) <= LONGEST and len(known) < MOST:
                    known[key] = tuple(out[n:])
            else:
                self._advance(here, out)
                self._converge(then[0], out)
        self._advance(stretches[-1], out)  # what follows it isn't known yet
        return out

    def _advance(self, stretch: str, out: list[int]) -> None:
        v = self.v
        for start in range(0, len(stretch), 4 * v.longest):
            piece = stretch[start : start + 4 * v.longest]
            old, text, n = len(self.tail), self.tail + piece, len(piece)
            base = self.at - self.done - old + 1  # where in the lists the end of text[0] stands
            best, length, ids = self.best, self.length, self.ids
            best += [_LEAST] * n
            length += [0] * n
            ids += [0] * n
            if v.single.issuperset(piece):
                for end, (size, score, i) in v.automaton.iter(text):
                    if end >= old and (to := base + end) >= size:
                        s = best[to - size] + score
                        if s > best[to]:
                            best[to], length[to], ids[to] = s, size, i
            else:
                for end, pieces in enumerate(_by_end(v, text)):
                    to = base + end
                    for size, score, i in pieces if end >= old else ():
                        if to >= size and (s := best[to - size] + score) > best[to]:
                            best[to], length[to] = s, size
                            ids[to] = i if i >= 0 else tuple(v.bytes_at + b for b in text[end].encode("utf-8", "surrogatepass"))
            self.at += n
            self.tail = text[-(v.longest - 1) :] if v.longest > 1 else ""
            if self.at - self.done >= v.longest:
                out += self._commit(self.at - self.done - v.longest + 1)

    def _converge(self, then: str, out: list[int]) -> bool:
        """Whether the character that comes next leaves no open path; the ids up to it are given out in that case."""
        tail, begun = self.tail, self.v.begun
        if any(tail[-k:] + then in begun for k in range(1, min(len(tail), self.at - self.done) + 1)):
            return False
        out += self.finish()
        return True

    def _commit(self, first: int) -> list[int]:
        """Gives out what the paths of all positions from first on, an index of the lists, have in common."""
        length, last = self.length, len(self.best) - 1
        paths = list(range(first, last + 1))
        self.widest = max(self.widest, last)
        while len(paths) > 1:  # the furthest steps back until all stand at one boundary
            p = paths.pop()
            p -= length[p]
            if p not in paths:
                paths.append(p)
                paths.sort()
        boundary = p = paths[0]
        out: list[int] = []
        while p > 0:
            i = self.ids[p]
            if isinstance(i, int):
                out.append(i)
            else:
                out.extend(reversed(i))
            p -= length[p]
        if boundary:
            self.done += boundary
            del self.best[:boundary], length[:boundary], self.ids[:boundary]
        out.reverse()
        return out

    def finish(self) -> list[int]:
        """The ids of all that was fed and not given out; what follows is a text of its own, or starts where no piece reaches back."""
        out = self._commit(len(self.best) - 1)
        self.tail, self.best = "", [0.0]
        return out


class Worker:
    """A vocabulary with the results of frequent segments, one for each worker process."""

    _known: dict[str, Worker] = {}

    def __init__(self, path: str) -> None:
        self.v = Vocabulary.load(path)
        self.counts: dict[str, tuple[int, float]] = {}
        self.ids: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, path: str) -> Worker:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def count(self, text: str) -> tuple[int, float]:
        n, total, known = 0, 0.0, self.counts
        for seg in self.v.segments(text):
            r = known.get(seg)
            if r is None:
                r = count_pieces(self.v, seg)
                if len(seg) <= LONGEST and len(known) < MOST:
                    known[seg] = r
            n += r[0]
            total += r[1]
        return n, total

    def encoded(self, text: str) -> Iterator[list[int]]:
        """Final ids after each part of the text, all from one stream; the last are those that waited for the end."""
        s = StreamingViterbi(self.v, self.ids)
        for at in range(0, len(text), PART):
            part = text[at : at + PART].replace(" ", SPACE)
            yield s.feed(part if at else SPACE + part)
        yield s.finish()

    def encode(self, text: str) -> array:
        ids = array("I")
        for final in self.encoded(text):
            ids.extend(final)
        return ids

    def decode(self, ids) -> str:
        """The text of ids: the first space, which encoding put there, goes; bytes that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.v.text_of.__getitem__, ids))
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, score) for each row; a null or empty text has 0 of both. Only doc_id and text are read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Worker.of(model_path)
        for b in batches:
            found = [w.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_tokens long, score double")


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row; a null or empty text has no ids and decodes to an empty text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Worker.of(model_path)
        for b in batches:
            for at in range(0, b.num_rows, 64):  # ids are larger than texts
                part = b.slice(at, 64)
                ids = [w.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([w.decode(i) for i in ids])], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def code_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, round_trip) for each row, of what encode_texts gives.

    The digests are made where the ids are, so ids need not leave the worker. round_trip is false only where a text holds the space mark itself
    or can't be UTF-8.
    """
    import hashlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Worker.of(model_path)
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                ids = w.encode(text)
                decoded = w.decode(ids)
                rows.append((i, len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digest, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_count_viterbi(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), model_path())


def op7_streaming_viterbi(spark, sf_dir: str) -> DataFrame:
    return code_digests(table(spark, sf_dir, "documents"), model_path())
