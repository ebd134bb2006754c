"""SentencePiece BPE, encoded exactly by backtracking over longest matches, and decoded."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Bounds of a worker's memory: entries of a cache's young half, characters of a remembered word, text encoded at once.
ENTRIES, WORD_CHARS, SLICE_CHARS = 250_000, 48, 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """What a model file says: pieces in the order of ids, their scores, the ids of the 256 bytes, unknown and end."""

    pieces: list[str]
    scores: list[float]
    plain: list[bool]  # pieces that stand for their own characters
    byte_ids: list[int]
    unknown: int
    end: int


def read_vocabulary(path: str) -> Vocabulary:
    """Of a BPE model that changes no characters but spaces; others are an error, as their results would differ."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train, kinds = model.normalizer_spec, model.trainer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with a space in front and no other change of text")
    kind = [p.type for p in model.pieces]
    if kinds.USER_DEFINED in kind or kinds.UNUSED in kind or kind.count(kinds.BYTE) != 256:
        raise ValueError("only models with byte fallback and no pieces of users")
    pieces = [p.piece for p in model.pieces]
    of = {p: i for i, p in enumerate(pieces)}
    return Vocabulary(
        pieces, [p.score for p in model.pieces], [k == kinds.NORMAL for k in kind], [of[f"<0x{b:02X}>"] for b in range(256)], kind.index(kinds.UNKNOWN), of[train.eos_piece or "</s>"]
    )


class Encoder:
    """Encodes text in words; a word is a run of spaces with what follows up to the next space.

    BPE merges characters, the best-scored pair first and of equals the leftmost. Its result restricted to a run of
    tokens is the result for that run's text, and tokens are the result if each two neighbours are the result for
    their own text: the first merge across a boundary would come first there as well. So the search goes from left to
    right, takes the longest piece that fits the one before, then shorter ones, and steps back where none fits. A
    prefix has one result only, so a position that failed once has failed for good.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.score = {p: s for p, s, plain in zip(v.pieces, v.scores, v.plain, strict=True) if plain}
        self.id_of = {p: i for i, (p, plain) in enumerate(zip(v.pieces, v.plain, strict=True)) if plain}
        self.matcher = ahocorasick.Automaton()
        for p in self.score:
            self.matcher.add_word(p, p)
        self.matcher.make_automaton()
        self.near = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        # merges cross from a character to a space only if a piece does
        self.crosses = any(b == SPACE != a for a, b in self.near)
        # of each piece the longest other piece it begins with, at last a single character
        self.shorter = {p: next(p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in self.score) for p in self.score if len(p) > 1}
        self.pairs = _Cache(lambda key: self.merged(key[0] + key[1]) == ([*key] if key[0] else [key[1]]))
        self.parts = _Cache(self.packed)
        self.words = _Cache(self.word)
        byte_of = {i: bytes([b]) for b, i in enumerate(v.byte_ids)}
        self.raw = [byte_of.get(i) or (p.replace(SPACE, " ").encode() if plain else b" \xe2\x81\x87 " if i == v.unknown else b"") for i, (p, plain) in enumerate(zip(v.pieces, v.plain, strict=True))]
        self.silent = {i for i, r in enumerate(self.raw) if not r} | {v.unknown}

    def merged(self, text: str) -> list[str]:
        """Plain merging, for texts as long as two pieces."""
        symbols, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def tokens(self, text: str) -> list[str]:
        pairs, shorter = self.pairs, self.shorter
        n = len(text)
        longest = list(text)
        for end, p in self.matcher.iter(text):  # ends ascend, so the longest of a start comes last
            longest[end - len(p) + 1] = p
        open_ = bytearray(b"\1") * (n + 1)  # positions that have not failed
        out: list[str] = []
        pos, last, token = 0, "", longest[0] if n else ""
        while pos < n:
            end = pos + len(token)
            if open_[end] and pairs[last, token]:
                out.append(token)
                pos, last = end, token
                token = longest[pos] if pos < n else ""
            elif (short := shorter.get(token)) is not None:
                token = short
            else:
                open_[pos] = 0
                token = out.pop()
                pos -= len(token)
                last = out[-1] if out else ""
        return out

    def packed(self, text: str) -> bytes:
        """Ids of a stretch, as 32-bit numbers."""
        ids = []
        for t in self.tokens(text):
            i = self.id_of.get(t)
            ids += [i] if i is not None else [self.v.byte_ids[b] for b in t.encode("utf-8", "surrogatepass")]
        return array("i", ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word, the spaces in front included; one space may be left out. No merge crosses a place whose two characters stand together in no piece."""
        text = word.replace(" ", SPACE)
        text = text if text.startswith(SPACE) else SPACE + text
        if word.isalpha():
            return self.parts[text]
        start, out = 0, []
        for m in _OTHER.finditer(text):
            for i in (m.start(), m.end()):
                if start < i < len(text) and text[i - 1 : i + 1] not in self.near:
                    out.append(self.parts[text[start:i]])
                    start = i
        out.append(self.parts[text[start:]])
        return b"".join(out)

    def encode(self, text: str | None, end: bool = True) -> np.ndarray:
        """Ids of the whole text; null is empty, and an empty text has no token but the end."""
        out = [self.packed(SPACE + text.replace(" ", SPACE))] if text and self.crosses else [b"".join(map(self.words.__getitem__, x)) for x in _words(text)] if text else []
        if end:
            out.append(np.int32(self.v.end).tobytes())
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: control pieces are silent, bytes that are no character become U+FFFD each."""
        if not self.silent.isdisjoint(ids[:-1]):  # they also end a run of bytes
            text = "".join(_text(b"".join(map(self.raw.__getitem__, run))) for _, run in groupby(ids, self.silent.__contains__))
        else:
            text = _text(b"".join(map(self.raw.__getitem__, ids)))
        lead = next((i for i in ids if self.raw[i]), None)
        # the space in front of every text
        return text[1:] if lead is not None and self.v.plain[lead] and text.startswith(" ") else text


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return _each_bad_byte(data)


def _each_bad_byte(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


class _Cache(dict):
    """What a function gave for keys already seen. Full, it keeps its entries as the old half and starts anew."""

    def __init__(self, function: Callable):
        self.function, self.old = function, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.function(key)
        if len(key) <= WORD_CHARS:
            if len(self) >= ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


_OTHER = re.compile(r"[^\w▁]+")
_RUN = re.compile(f"[ {SPACE}]+[^ {SPACE}]*")
_EDGE = re.compile(f"[^ {SPACE}](?= )")


def _words(text: str) -> Iterator[list[str]]:
    """The words of the text behind one more space, by slices that end before a space; a word with one space in front stands without it."""
    start = 0
    while start < len(text):
        edge = _EDGE.search(text, start + SLICE_CHARS) if len(text) - start > SLICE_CHARS else None
        stop = edge.end() if edge else len(text)
        part = text[start + (start > 0) : stop]  # a slice's first space stands for the one in front
        if part.startswith(" ") or part.endswith(" ") or "  " in part or SPACE in part or not part:
            yield _RUN.findall(" " + part)
        else:
            yield part.split(" ")
        start = stop


_built: dict[int, Encoder] = {}


def encoder_of(v: Vocabulary) -> Encoder:
    """One encoder of a vocabulary in each worker process."""
    key = hash((tuple(v.pieces), tuple(v.scores)))
    if key not in _built:
        _built.clear()
        _built[key] = Encoder(v)
    return _built[key]


@dataclass(frozen=True)
class Coding:
    """end: whether the end id follows; decode: whether the text is read back from the ids."""

    end: bool = True
    decode: bool = True
    names: list[str] = field(default_factory=lambda: ["ids", "decoded"])


def _coded(vocabulary, c: Coding, keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(vocabulary.value)
        for batch in batches:
            ids, ends, texts = [], [0], []
            column = batch.column(keep)
            for i in range(len(column)):
                one = coder.encode(column[i].as_py(), c.end)
                ids.append(one)
                ends.append(ends[-1] + len(one))
                if c.decode:
                    texts.append(coder.decode(one.tolist()))
            packed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            new = [packed, *([pa.array(texts, pa.string())] if c.decode else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *new], names=[*batch.schema.names[:keep], *c.names[: len(new)]])

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], coding: Coding | None = None) -> DataFrame:
    """The columns ``keep``, ids (array of int) and decoded of every row's whole ``text``.

    Null and empty texts have the end id alone and decode to an empty text. Repeated rows stay; an empty table gives
    no row; a very long text is encoded in slices that end before a space, a very long word in one piece. ``keep``
    must not hold the names of the new columns. No shuffle; the vocabulary is the one thing sent to the tasks.
    """
    c = coding or Coding()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    data = docs.select(*keep, F.col("text").alias("__text"))
    new = [T.StructField(n, t) for n, t in zip(c.names, (T.ArrayType(T.IntegerType()), T.StringType()), strict=True)][: 1 + c.decode]
    return data.mapInArrow(_coded(shared, c, len(keep)), T.StructType([*data.schema.fields[:-1], *new]))
