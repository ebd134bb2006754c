"""Language ID of words in code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import SPACE

UNKNOWN = "und"
NEW = ["lang_pred", "score", "n_switches"]
BUCKETS = 1 << 15
#: Positions of a chain that advance together with those of all other blocks.
BLOCK = 128
#: What bounds a task's memory: numbers held for the scores of remembered words, numbers held for the chains that are
#: labelled at once, and characters of text that those chains come from at most.
MEMORY, CHAINS, PART = 600_000, 400_000, 400_000
#: A word of more bytes is cut into pieces of so many characters; each has a place in the chain.
LONG, PIECE = 48, 8
_GAP = re.compile(r"\s")


@dataclass(frozen=True)
class CrfParams:
    """docs_per_lang, max_docs and words_per_doc bound what is collected for the fit; lexicon the words per language.

    Of more languages than max_langs those with the most rows are learned, and a warning says how many are not.
    """

    docs_per_lang: int = 150
    max_docs: int = 30_000
    words_per_doc: int = 200
    max_langs: int = 200
    lexicon: int = 300
    sequence: int = 48
    epochs: int = 5
    seed: int = 5


def cut(words: list[str]) -> list[str]:
    """The words, those of over LONG bytes as consecutive pieces, so that writing without spaces counts in full.

    A piece has a space on a side that is no edge of the word, and the 3 characters that follow it, so that no gram
    is lost between two pieces.
    """
    if not any(len(w) > LONG // 4 and len(w.encode("utf-8", "surrogatepass")) > LONG for w in words):
        return words
    out = []
    for w in words:
        if len(w.encode("utf-8", "surrogatepass")) <= LONG:
            out.append(w)
        else:
            out.extend((" " if i else "") + w[i : i + PIECE + 3] + (" " if i + PIECE < len(w) else "") for i in range(0, len(w), PIECE))
    return out


def _edged(word: str) -> bytes:
    if not any(map(str.isalpha, word)):
        return b""
    data = word.strip(" ").lower().encode("utf-8", "surrogatepass")
    return (b"" if word.startswith(" ") else b"^") + data + (b"" if word.endswith(" ") else b"$")


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all words in one run, with the word each belongs to, and how many each word has.

    A word, or piece from cut(), stands between edge marks; its 2- to 4-byte grams are its affixes, where they hold an
    edge, and its character n-grams. A word of the lexicon has a feature of its own. A word without letters has none.
    """
    edged = [_edged(w) for w in words]
    sizes = np.array([len(e) for e in edged], np.int64)
    data = np.frombuffer(b"".join(edged), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    index, of = [], []
    with np.errstate(over="ignore"):
        gram = data.copy()
        for k in (2, 3, 4):
            if len(data) < k:
                break
            gram = gram[: len(data) - k + 1] * np.uint64(0x100000001B3) ^ data[k - 1 :]
            inside = owner[: len(gram)] == owner[k - 1 :]
            h = gram[inside] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            index.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64))
            of.append(owner[: len(gram)][inside])
    known = [(lexicon[w], i) for i, w in enumerate(map(str.lower, words)) if w in lexicon]
    if known:
        n, i = zip(*known, strict=True)
        index.append(BUCKETS + np.array(n, np.int64))
        of.append(np.array(i, np.int64))
    index, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (index, of))
    return index, of, np.bincount(of, minlength=len(words))


@dataclass
class Crf:
    langs: list[str]
    emit: np.ndarray  # features x languages
    move: np.ndarray  # languages x languages, log scale
    lexicon: dict[str, int]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Emission scores; a word without letters has none and says nothing."""
        index, of, n = features(words, self.lexicon)
        scale = 1 / np.sqrt(np.maximum(n, 1))
        return np.stack([np.bincount(of, self.emit[index, k], len(words)) * scale for k in range(len(self.langs))], axis=1) if len(words) else np.zeros((0, len(self.langs)))

    def _blocks(self, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each block its chain, its number there, its first place and its size; and each chain's number of blocks."""
        n_blocks = -(-lengths // BLOCK)
        chain = np.repeat(np.arange(len(lengths)), n_blocks)
        number = np.arange(len(chain)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = np.repeat(np.cumsum(lengths) - lengths, n_blocks) + number * BLOCK
        return chain, number, start, np.minimum(lengths[chain] - number * BLOCK, BLOCK), n_blocks

    def _products(self, potential: np.ndarray, start: np.ndarray, size: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The product of the steps of each block, longest block first; ``fresh`` ones begin a text, without a move."""
        n_langs, move = potential.shape[1], np.exp(self.move)
        whole = np.broadcast_to(np.eye(n_langs), (len(start), n_langs, n_langs)).copy()
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t, side="left"))
            m = whole[:n]
            step = (m.reshape(-1, n_langs) @ move).reshape(m.shape)
            if t == 0:
                step[fresh[:n]] = m[fresh[:n]]
            step *= potential[start[:n] + t][:, None, :]
            whole[:n] = step / step.sum(axis=(1, 2), keepdims=True)
        return whole

    def across(self, scores: np.ndarray, begins: bool) -> np.ndarray:
        """The product of all steps of one stretch of a chain, up to a factor: takes messages across it both ways."""
        potential = np.exp(scores - scores.max(axis=1, keepdims=True))
        _, number, start, size, _ = self._blocks(np.array([len(scores)]))
        out = np.eye(scores.shape[1])
        for m in self._products(potential, start, size, (number == 0) & begins):
            out = out @ m
            out /= out.sum()
        return out

    def marginals(self, scores: np.ndarray, lengths: np.ndarray, moves: bool = False, ahead: np.ndarray | None = None, behind: np.ndarray | None = None, begins: bool = True):
        """Forward-backward over many chains at once; with ``moves``, also the expected moves between languages.

        Chains are cut into blocks. The product of a block's steps takes messages across it in both directions, so
        all blocks of all chains advance together and a very long text needs no more steps than its blocks have.
        A chain that is a stretch of a longer one has messages from what stands ``ahead`` of it and ``behind`` it.
        """
        n_langs = scores.shape[1]
        potential = np.exp(scores - scores.max(axis=1, keepdims=True))
        move = np.exp(self.move)
        chain, number, start, size, n_blocks = self._blocks(lengths)
        into, back = np.ones((len(chain), n_langs)), np.ones((len(chain), n_langs))
        if ahead is not None:
            into[number == 0], back[number == n_blocks[chain] - 1] = ahead, behind
        fresh = (number == 0) & begins
        long = np.flatnonzero(n_blocks[chain] > 1)
        if len(long):
            long = long[np.argsort(-size[long], kind="stable")]
            whole = self._products(potential, start[long], size[long], fresh[long])
            place = np.empty(len(chain), np.int64)
            place[long] = np.arange(len(long))
            last = n_blocks[chain] - 1
            for k in range(int(n_blocks.max()) - 1):
                here = np.flatnonzero((number == k) & (last > k))
                v = np.einsum("bi,bij->bj", into[here], whole[place[here]])
                into[here + 1] = v / v.sum(axis=1, keepdims=True)
                there = np.flatnonzero((last - number == k) & (number > 0))
                v = np.einsum("bij,bj->bi", whole[place[there]], back[there])
                back[there - 1] = v / v.sum(axis=1, keepdims=True)
        order = np.argsort(-size, kind="stable")
        start, size, first = start[order], size[order], fresh[order]
        out = np.empty_like(potential)
        steps = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
        a = into[order]
        for t in range(steps):
            a = a[: live[t]]
            moved = a @ move
            if t == 0:
                moved[first] = a[first]
            at = start[: live[t]] + t
            a = moved * potential[at]
            a /= a.sum(axis=1, keepdims=True)
            out[at] = a
        expected = np.zeros_like(move)
        beta = np.empty((0, n_langs))
        for t in range(steps - 1, -1, -1):
            at = start[: live[t]] + t
            b = back[order[: live[t]]].copy()
            if len(beta):
                b[: len(beta)] = beta
                if moves:
                    joint = out[at[: len(beta)]][:, :, None] * move[None] * seen[:, None, :]
                    expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            p = out[at] * b
            seen = b * potential[at]
            beta = seen @ move.T
            beta /= beta.sum(axis=1, keepdims=True)
            out[at] = p / p.sum(axis=1, keepdims=True)
        return (out, expected) if moves else out


def fit(samples: list[tuple[str, list[str]]], p: CrfParams | None = None) -> Crf:
    """Maximum likelihood by stochastic gradients, on code-switched chains put together from pieces of the samples."""
    p = p or CrfParams()
    rng = np.random.default_rng(p.seed)
    samples = [(lang, cut(words)) for lang, words in samples]
    langs = sorted({lang for lang, _ in samples})
    of = {lang: i for i, lang in enumerate(langs)}
    counts = {lang: Counter() for lang in langs}
    for lang, words in samples:
        counts[lang].update(w.lower() for w in words)
    frequent = dict.fromkeys(w for lang in langs for w, _ in counts[lang].most_common(p.lexicon))
    lexicon = {w: i for i, w in enumerate(frequent)}
    n_langs = len(langs)
    model = Crf(langs, np.zeros((BUCKETS + len(lexicon), n_langs)), np.zeros((n_langs, n_langs)), lexicon)
    pieces = []
    for lang, words in samples:
        i = 0
        while i < len(words):
            n = int(rng.integers(4, p.sequence))
            pieces.append((of[lang], words[i : i + n]))
            i += n
    if n_langs < 2 or not pieces:
        return model
    ids: dict[str, int] = {}
    chain_words, chain_langs = [], []
    for i in rng.permutation(len(pieces)):
        lang, words = pieces[i]
        chain_words.extend(ids.setdefault(w, len(ids)) for w in words)
        chain_langs.extend([lang] * len(words))
    n = len(chain_words) // p.sequence * p.sequence or len(chain_words)
    shape = (-1, min(n, p.sequence))
    words, gold = np.array(chain_words[:n]).reshape(shape), np.array(chain_langs[:n]).reshape(shape)
    feats, owner, n_feats = features(list(ids), lexicon)
    order = np.argsort(owner, kind="stable")
    width = int(n_feats.max())
    index, value = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width))
    column = np.arange(len(order)) - np.repeat(np.cumsum(n_feats) - n_feats, n_feats)
    index[owner[order], column] = feats[order]
    value[owner[order], column] = 1 / np.sqrt(n_feats[owner[order]])
    square, square_move = np.full(model.emit.shape, 1e-6), np.full(model.move.shape, 1e-6)
    size = 64
    for _ in range(p.epochs):
        for rows in np.array_split(rng.permutation(len(words)), max(1, len(words) // size)):
            w, g = words[rows], gold[rows]
            s, t = w.shape
            used, inverse = np.unique(w.ravel(), return_inverse=True)
            scores = np.einsum("ufl,uf->ul", model.emit[index[used]], value[used])[inverse]
            m, expected = model.marginals(scores, np.full(s, t), moves=True)
            grad = -m
            grad[np.arange(s * t), g.ravel()] += 1
            move = -expected
            np.add.at(move, (g[:, :-1].ravel(), g[:, 1:].ravel()), 1)
            move /= s
            square_move += move**2
            model.move += 0.1 * move / np.sqrt(square_move) - 1e-3 * model.move
            by_word = np.stack([np.bincount(inverse, grad[:, k], len(used)) for k in range(n_langs)], axis=1)
            at = index[used].ravel()
            push = (by_word[:, None, :] * value[used][..., None]).reshape(len(at), -1)
            total = np.stack([np.bincount(at, push[:, k], len(model.emit)) for k in range(n_langs)], axis=1)
            hit = np.flatnonzero(np.any(total, axis=1))
            square[hit] += total[hit] ** 2
            model.emit[hit] += 0.5 * total[hit] / np.sqrt(square[hit])
    return model


def collect_samples(labelled: DataFrame, p: CrfParams | None = None) -> list[tuple[str, list[str]]]:
    """About docs_per_lang distinct texts of each language, those of the smallest hashes, and words_per_doc words of each.

    Only text and lang of ``labelled`` are used. Copies of a text count once, so a language that says little else has
    its few texts all taken; its texts are counted over all rows first. Many languages share max_docs documents.
    """
    p = p or CrfParams()
    known = labelled.where("lang is not null and text is not null")
    # told apart by hash; an estimate is good enough to say which share is about docs_per_lang
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n"))
    counts = counts.orderBy(F.desc("rows"), "lang").limit(p.max_langs + 1).collect()
    if len(counts) > p.max_langs:
        warnings.warn(f"only the {p.max_langs} languages of the most rows are learned: raise max_langs, or mend the labels", stacklevel=2)
    sizes = {r["lang"]: r["n"] for r in counts[: p.max_langs]}
    if not sizes:
        return []
    docs_per_lang = max(1, min(p.docs_per_lang, p.max_docs // len(sizes)))
    parts = 1_000_000
    # a few more than asked for, so that a language with few texts never has none by chance
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(parts, 1 + int(parts * (docs_per_lang + 20) / max(1, n))))])
    rank = F.pmod(F.xxhash64("text", F.lit(p.seed)), F.lit(parts))
    words = F.filter(F.split("text", rf"[{SPACE}]+"), lambda x: x != "")
    # a slice from a place that the hash decides; short texts are taken whole
    first = 1 + F.pmod(F.col("h"), F.greatest(F.lit(1), F.size("w") - p.words_per_doc)).cast("int")
    chosen = known.where(rank < F.try_element_at(share, F.col("lang"))).select("lang", F.xxhash64("text").alias("h"), words.alias("w"))
    # of a word too long for that many pieces, a passage from such a place
    most = p.words_per_doc * PIECE
    passage = lambda x: F.substring(x, 1 + F.pmod(F.col("h"), F.greatest(F.lit(1), F.char_length(x) - most)).cast("int"), F.lit(most))
    chosen = chosen.select("lang", "h", F.transform(F.slice("w", first, F.lit(p.words_per_doc)), passage).alias("w"))
    rows = chosen.dropDuplicates(["lang", "h"]).limit(3 * (docs_per_lang + 20) * len(sizes)).collect()
    return sorted(((r["lang"], cut(list(r["w"]))[: p.words_per_doc]) for r in rows if r["w"]), key=lambda x: (x[0], x[1]))


class _Scores:
    """Scores of the words already seen, as many as MEMORY allows."""

    def __init__(self, model: Crf):
        self.model, self.most = model, max(1000, MEMORY // max(1, len(model.langs)))
        self.known: dict[str, int] = {}
        self.scores, self.spoken = np.zeros((0, len(model.langs))), np.zeros(0, bool)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The scores of each word with a letter, and which words those are."""
        if len(self.known) > self.most:
            self.known, self.scores, self.spoken = {}, self.scores[:0], self.spoken[:0]
        before, known = len(self.known), self.known
        at = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        if len(known) > before:
            new = list(islice(known, before, None))
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])
            self.spoken = np.concatenate([self.spoken, np.array([w.isalpha() or any(map(str.isalpha, w)) for w in new], bool)])
        letters = self.spoken[at]
        return self.scores[at[letters]], letters


def _stretches(text: str, size: int) -> Iterator[str]:
    """The text in stretches of about so many characters, cut at white space where there is any."""
    start = 0
    while start < len(text):
        stop = start + size
        gap = _GAP.search(text, stop, stop + size) if stop < len(text) else None
        stop = gap.start() if gap else stop
        yield text[start:stop]
        start = stop


def _label_long(model: Crf, scores: _Scores, text: str, size: int) -> tuple[np.ndarray, int, int]:
    """Sum of marginals, words and switches of one long text, exactly, with one stretch of it in memory at a time.

    The first pass keeps what takes messages across each stretch, the second labels each with what stands around it.
    """
    n_langs = len(model.langs)
    steps = []
    for part in _stretches(text, size):
        s, _ = scores.of(cut(part.split()))
        steps.append(model.across(s, not any(x is not None for x in steps)) if len(s) else None)
    behind = [np.ones(n_langs)]
    for m in reversed(steps):
        v = behind[-1] if m is None else m @ behind[-1]
        behind.append(v / v.sum())
    behind.reverse()
    ahead, mass, n, moved, last, begun = np.ones(n_langs), np.zeros(n_langs), 0, 0, None, False
    for k, part in enumerate(_stretches(text, size)):
        if steps[k] is None:
            continue
        s, _ = scores.of(cut(part.split()))
        m = model.marginals(s, np.array([len(s)]), ahead=ahead, behind=behind[k + 1], begins=not begun)
        label = m.argmax(axis=1)
        moved += int((label[1:] != label[:-1]).sum()) + (last is not None and last != label[0])
        mass, n, last, begun = mass + m.sum(axis=0), n + len(s), label[-1], True
        ahead = ahead @ steps[k]
        ahead /= ahead.sum()
    return mass, n, moved


def _predict(model: Crf, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model)
        # about 4 characters make a word at least; no more text at once than its chains' numbers allow
        most = max(1000, min(PART, 4 * CHAINS // len(model.langs)))
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            ends = np.cumsum(np.asarray(pc.binary_length(text).fill_null(0)).astype(np.int64) + 1)
            start = 0
            while start < len(text):  # a slice of the batch: only its texts become Python strings
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
                rows = batch.slice(start, stop - start)
                yield _labelled(model, scores, rows, most, rows.columns if with_text else rows.columns[:-1])
                start = stop

    return run


def _labelled(model: Crf, scores: _Scores, rows: pa.RecordBatch, most: int, keys: list[pa.Array]) -> pa.RecordBatch:
    texts = rows.column(rows.num_columns - 1).to_pylist()
    short = [t if t and len(t) <= most else "" for t in texts]
    words, lengths = [], []
    for t in short:
        w = cut(t.split())
        words += w
        lengths.append(len(w))
    s, letters = scores.of(words)
    # words without letters are no part of the chain: what stands between does not change the language
    doc = np.repeat(np.arange(len(texts)), lengths)[letters]
    sizes = np.bincount(doc, minlength=len(texts))
    m = model.marginals(s, sizes) if len(s) else np.zeros((0, len(model.langs)))
    mass = np.stack([np.bincount(doc, m[:, k], len(texts)) for k in range(len(model.langs))], axis=1)
    label = m.argmax(axis=1)
    moved = np.bincount(doc[1:], (label[1:] != label[:-1]) & (doc[1:] == doc[:-1]), len(texts)) if len(doc) else np.zeros(len(texts))
    for i, t in enumerate(texts):
        if t and not short[i]:
            mass[i], sizes[i], moved[i] = _label_long(model, scores, t, most)
    best = mass.argmax(axis=1)
    langs = [model.langs[k] if n else UNKNOWN for k, n in zip(best, sizes, strict=True)]
    conf = [min(1.0, float(mass[i, k] / n)) if n else 0.0 for i, (k, n) in enumerate(zip(best, sizes, strict=True))]
    return pa.RecordBatch.from_arrays([*keys, pa.array(langs, pa.string()), pa.array(conf, pa.float64()), pa.array(moved.astype(np.int64))], names=[*rows.schema.names[: len(keys)], *NEW])


def label_words(model: Crf, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of one text that has a letter, or of its pieces if it is long."""
    words = [w for w in cut(text.split()) if any(map(str.isalpha, w))]
    if not words:
        return []
    m = model.marginals(model.word_scores(words), np.array([len(words)]))
    return [(w.strip(" ")[:PIECE] if " " in w else w, model.langs[k], float(p[k])) for w, p, k in zip(words, m, m.argmax(axis=1), strict=True)]


def predict(docs: DataFrame, model: Crf, keep: list[str], with_text: bool = False) -> DataFrame:
    """The columns ``keep``, lang_pred, score and n_switches of every row, from its whole text alone.

    Each word gets the probability of each language by forward-backward; the document's language has the greatest
    sum, and the score is its mean. Null texts and texts without a letter are 'und' with score 0; with no language
    learned, every text is. Repeated rows stay; an empty table gives no row; a very long text is labelled as one chain,
    stretch by stretch.
    with_text: the text comes along too, as __text. ``keep`` must not hold the names of the new columns.
    """
    data = docs.select(*keep, F.col("text").alias("__text"))
    if not model.langs:
        data = data.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "n_switches": F.lit(0).cast("long")})
        return data if with_text else data.drop("__text")
    new = [T.StructField(n, t) for n, t in zip(NEW, (T.StringType(), T.DoubleType(), T.LongType()), strict=True)]
    return data.mapInArrow(_predict(model, with_text), T.StructType([*data.schema.fields[: None if with_text else -1], *new]))
