"""SentencePiece encoding and decoding by a streaming Viterbi search over the pieces and scores of a model file."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import Memory, whole_text

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# A character that no piece spells costs this much more than the worst piece; its UTF-8 bytes take its place.
_UNKNOWN = 10.0
# Stands for a space mark of the text itself while it is encoded: a lone surrogate, which no text holds and no piece
# spells, so it is written in bytes and comes back as what it was.
_LITERAL = "\ud800"
_STEP = 64


@dataclass(frozen=True)
class Vocabulary:
    """pieces: text to (id, score); spelt: id to bytes (control pieces spell nothing); byte_ids: byte to id; endings: the
    pieces from their last character backwards, a dict from a character to [score of the piece that begins there or None,
    dict of the characters before it or None]."""

    pieces: dict[str, tuple[int, float]]
    spelt: list[bytes]
    byte_ids: list[int]
    unknown: float
    longest: int
    endings: dict[str, list]
    # What some piece goes on after.
    prefixes: frozenset[str]
    # Whether no piece goes on after a space mark or holds a line feed beside other characters.
    splits_at_spaces: bool

    @cached_property
    def prefix_ends(self) -> frozenset[str]:
        """The last two characters of the prefixes that have two."""
        return frozenset(p[-2:] for p in self.prefixes if len(p) > 1)

    @staticmethod
    def load(path: str = VOCABULARY) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, spelt, byte_ids = {}, [], [0] * 256
        for n in range(model.get_piece_size()):
            piece = model.id_to_piece(n)
            if model.is_byte(n):
                byte_ids[int(piece[3:-1], 16)] = n
                spelt.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(n) or model.is_unknown(n) or model.is_unused(n):
                spelt.append(b"")
            else:
                pieces[piece] = (n, model.get_score(n))
                spelt.append(piece.replace(SPACE, " ").encode())
        unknown = min(score for _, score in pieces.values()) - _UNKNOWN
        splits = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in pieces)
        prefixes = frozenset(p[:n] for p in pieces for n in range(1, len(p)))
        return Vocabulary(pieces, spelt, byte_ids, unknown, max(map(len, pieces)), _endings(pieces), prefixes, splits)


def _endings(pieces: dict[str, tuple[int, float]]) -> dict[str, list]:
    endings: dict[str, list] = {}
    for piece, (_, score) in pieces.items():
        before, node = endings, [None, None]
        for char in reversed(piece):
            if before is None:
                before = node[1] = {}
            node = before.setdefault(char, [None, None])
            before = node[1]
        node[0] = score
    return endings


def _extend(words: Vocabulary, text: str, scores: list[float], back: list[int]) -> None:
    """Scores of the boundaries of `text` that have none yet, and the start of the best last piece of each; of equal paths
    the one whose last piece is longest wins."""
    endings, unknown = words.endings, words.unknown
    for end in range(len(scores), len(text) + 1):
        at = start = end - 1
        best = scores[at] + unknown
        # Backwards, as long as what has been passed ends some piece.
        node = endings.get(text[start])
        while node is not None:
            known, before = node
            if known is not None:
                score = scores[start] + known
                if score >= best:
                    best, at = score, start
            if before is None or not start:
                break
            start -= 1
            node = before.get(text[start])
        scores.append(best)
        back.append(at)


def _ids(words: Vocabulary, text: str, back: list[int], upto: int) -> list[int]:
    """Ids of the best path to a boundary."""
    out: list[int] = []
    while upto > 0:
        start = back[upto]
        known = words.pieces.get(text[start:upto])
        if known is not None:
            out.append(known[0])
        else:
            out += (words.byte_ids[b] for b in reversed(text[start:upto].replace(_LITERAL, SPACE).encode()))
        upto = start
    out.reverse()
    return out


class StreamingViterbi:
    """Takes a text in parts of any length and gives ids as soon as they are certain.

    Paths survive at the end of what was read and at boundaries from which a piece can go on beyond it: `longest` boundaries at
    most, since no piece reaches farther. Ids are committed up to the boundary at which all surviving paths meet; scores restart
    from 0 there. The text marks spaces by SPACE.
    """

    def __init__(self, words: Vocabulary) -> None:
        self.words = words
        self.text = ""  # what is not committed
        self.scores = [0.0]  # of the boundaries in `text`
        self.back = [0]

    def feed(self, part: str) -> list[int]:
        out: list[int] = []
        # Parts are taken in steps, so that what is held does not grow with the part.
        for at in range(0, len(part), _STEP):
            self.text += part[at : at + _STEP]
            _extend(self.words, self.text, self.scores, self.back)
            # What is shorter than a piece can wait for the next part.
            if len(self.text) > self.words.longest:
                out += self._commit(self._meeting(self.text))
        return out

    def settle(self, ahead: str) -> list[int]:
        """Ids of what all paths share in front of the next character, which is looked at but not taken."""
        text = self.text + ahead
        _extend(self.words, text, self.scores, self.back)
        upto = self._meeting(text)
        while upto > len(self.text):
            upto = self.back[upto]
        del self.scores[-1], self.back[-1]
        return self._commit(upto)

    def finish(self) -> list[int]:
        return self._commit(len(self.text))

    def _meeting(self, text: str) -> int:
        """The last boundary of what was read that all surviving paths share."""
        last, back, prefixes = len(text), self.back, self.words.prefixes
        # Where no piece goes on after the last two characters, one can only go on after the last.
        low = max(0, last - self.words.longest + 1) if text[-2:] in self.words.prefix_ends else last - 1
        live = {s for s in range(low, last) if text[s:] in prefixes}
        live.add(last)
        while len(live) > 1:
            high = max(live)
            live.remove(high)
            live.add(back[high])
        return live.pop()

    def _commit(self, upto: int) -> list[int]:
        if not upto:
            return []
        out = _ids(self.words, self.text, self.back, upto)
        if upto == len(self.text):
            self.text, self.scores, self.back = "", [0.0], [0]
            return out
        offset = self.scores[upto]
        self.text = self.text[upto:]
        self.scores = [s - offset for s in self.scores[upto:]]
        self.back = [b - upto for b in self.back[upto:]]
        self.back[0] = 0
        return out


_SEGMENT = re.compile(" *[^ \n]+| +|\n")


class Encoder(Memory):
    """Remembers what the stream committed: segments of text to ids (little-endian 32-bit numbers).

    A stream that has committed all it was given is as if new, so what it commits next depends on nothing before. Where no piece
    goes on after a space mark, its paths meet in front of each run of spaces and around line feeds, as soon as the next character is
    read; segments end there. A segment goes through the stream when it is first met, and has the ids it had when it is met
    again."""

    room = 200_000
    # Longer segments are not remembered, so that the room is bounded in bytes.
    longest = 64

    def __init__(self, words: Vocabulary) -> None:
        super().__init__()
        self.words = words
        self.stream = StreamingViterbi(words)

    def compute(self, segment: str) -> bytes:
        """What the stream commits of a segment when the first character after it is seen."""
        stream = self.stream
        ids = stream.feed(_marked(segment))
        ids += stream.settle("\n" if segment[-1] == " " else SPACE)
        if stream.text:
            raise ValueError(f"the stream does not commit at the end of {segment!r}")
        return struct.pack(f"<{len(ids)}i", *ids)

    def __missing__(self, segment: str) -> bytes:
        return super().__missing__(segment) if len(segment) <= self.longest else self.compute(segment)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, which a space is put in front of; an empty text has none."""
        if not text:
            return np.zeros(0, "<i4")
        if not self.words.splits_at_spaces:
            stream = StreamingViterbi(self.words)
            return np.array(stream.feed(_marked(" " + text)) + stream.finish(), "<i4")
        return np.frombuffer(b"".join(map(self.__getitem__, _SEGMENT.findall(" " + text))), "<i4")


def _marked(text: str) -> str:
    return text.replace(SPACE, _LITERAL).replace(" ", SPACE)


def decode(words: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids, without the space put in front. What is no UTF-8 becomes U+FFFD."""
    spelt = words.spelt
    return b"".join([spelt[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


def encoded(docs: DataFrame, path: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, n_ids, round_trip (decoding gives the text back), ids.

    Null and empty texts have no ids. Repeated rows are encoded each; an empty table gives no rows; other columns are not
    read. Texts are neither normalised nor cut, whatever their length.
    """
    words = Vocabulary.load(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(words)
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                texts = part.column("text").to_pylist()
                ids = [encoder.encode(t) for t in texts]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                same = [decode(words, x) == t for x, t in zip(ids, texts, strict=True)]
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
                columns = [part.column("doc_id"), pa.array(sizes), pa.array(same), listed]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "round_trip", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(encode, f"doc_id {kind}, n_ids bigint, round_trip boolean, ids array<int>")
