"""Toxicity by compression distance: windows of a text under dictionaries of toxic and of ordinary text."""

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import sampled_texts

_WORD = re.compile(r"[^\W\d_]+")
N_FEATURES = 9


@dataclass(frozen=True)
class ToxicParams:
    """max_per_class bounds the labelled documents of the fit, max_chars the text taken of each for the dictionaries,
    max_pieces the pieces of 256 bytes that the ordinary one is trained on. The toxic one is trained at each of
    toxic_bytes with each of toxic_segments, and the best is taken.
    """

    max_per_class: int = 1500
    max_chars: int = 20_000
    window: int = 64
    stride: int = 32
    max_pieces: int = 20_000
    ordinary_bytes: int = 12_000
    toxic_bytes: tuple[int, ...] = (320, 400, 512, 640, 768, 1024)
    toxic_segments: tuple[int, ...] = (16, 20, 24, 32, 48)
    level: int = 5
    seed: int = 11


@dataclass
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    thresholds: list[float]
    weights: np.ndarray  # of features(), the last is the intercept
    p: ToxicParams

    def compressors(self):
        made = []
        for content in (self.ordinary, self.toxic):
            how = zstandard.ZstdCompressionParameters.from_level(self.p.level, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            d = zstandard.ZstdCompressionDict(content or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
        return made


def margins(text: str | None, ordinary, toxic, p: ToxicParams) -> np.ndarray:
    """For each window of the whole text in lower case, how many bytes shorter it is under the toxic dictionary."""
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    a, b = ordinary.compress, toxic.compress
    ends = max(1, len(data) - p.window + p.stride)
    return np.array([len(a(w)) - len(b(w)) for w in (data[i : i + p.window] for i in range(0, ends, p.stride)) if w], np.int32)


def features(m: np.ndarray, thresholds: list[float]) -> np.ndarray:
    """What the margins say: how many windows pass each threshold, and what share of the text that is."""
    n = len(m)
    if not n:
        return np.zeros(N_FEATURES)
    over = [(m >= t).sum() for t in thresholds]
    return np.array([*(np.log1p(x) for x in over), *(np.sqrt(x / n) for x in over), np.clip(m.max(), 0, 20) / 5, np.log1p(n) / 5, np.clip(m, -2, 10).mean()])


def _marks(toxic: list[str], ordinary: list[str]) -> list[str]:
    """What sets toxic documents apart, best first: words, their beginnings and pairs, in many toxic documents and few others."""

    def holders(texts, among=None):
        out = Counter()
        for t in texts:
            words, seen = _WORD.findall(t), set()
            for w in set(words):
                seen.update(w[:k] for k in range(3, min(len(w), 9) + 1))
                seen.add(w)
            seen.update(f"{v} {w}" for v, w in itertools.pairwise(words))
            out.update(x for x in seen if len(x) >= 3 and (among is None or x in among))
        return out

    n, m = max(1, len(toxic)), max(1, len(ordinary))
    a = {x: k for x, k in holders(toxic).items() if k >= max(4, 0.02 * n)}
    b = holders(ordinary, a)
    rated = []
    for x, k in a.items():
        rate, other = k / n, (b[x] + 0.5) / m
        if rate > 6 * other:
            rated.append((k * np.log(rate / other), " " not in x, len(x), x))
    rated.sort(reverse=True)  # of ties, the longest word
    chosen: list[str] = []
    for score, *_, x in rated:
        if score < 0.1 * rated[0][0]:  # what a few copies of one document share
            break
        if not any(x.startswith(c) or c.startswith(x) or (" " in x and f" {c}" in x) for c in chosen):  # one piece a stem
            chosen.append(x)
    return chosen


def _excess(texts: list[str], marks: list[str]) -> list[bytes]:
    """Of each toxic text, what ordinary text does not have: its marks, one for each word or pair that begins with one, in its order."""
    known = set(marks)
    longest = max(map(len, marks), default=0)

    def mark(w: str) -> str | None:
        return next((w[:k] for k in range(min(len(w), longest), 2, -1) if w[:k] in known), None)

    out = []
    for t in texts:
        words = _WORD.findall(t)
        pairs = [f"{v} {w}" for v, w in itertools.pairwise(words)] + [""]
        found = [x for w, two in zip(words, pairs, strict=False) for x in (mark(w), two if two in known else None) if x]
        if found:
            out.append((" " + " ".join(found)).encode())
    return out


def _trained(pieces: list[bytes], size: int, **how: int) -> bytes:
    """A dictionary trained by zstandard; of too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, pieces, **how).as_bytes() if pieces else b""
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(pieces))[:size]


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * len(x) / 100
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) / 100 * w)
    return w


def histogram(m: np.ndarray, p: ToxicParams) -> np.ndarray:
    """How many windows have each margin, from -span to span: a window's margin cannot be larger than itself and its frame."""
    span = p.window + 32
    return np.bincount(np.clip(m, -span, span) + span, minlength=2 * span + 1)


def _quantile(counts: np.ndarray, q: float) -> float:
    """Of the margins that a histogram counts; 0 if there are none."""
    ends = np.cumsum(counts)
    return float(np.searchsorted(ends, q * (ends[-1] - 1), side="right") - len(counts) // 2) if ends[-1] else 0.0


def _marked_windows(texts: list[str], marks: list[str], p: ToxicParams, most: int = 40) -> list[bytes]:
    """Windows around the marks in these texts, at most so many of each mark."""
    known, out, have = set(marks), [], Counter()
    for t in texts:
        for m in _WORD.finditer(t):
            found = next((m[0][:k] for k in range(len(m[0]), 2, -1) if m[0][:k] in known), None)
            if found and have[found] < most:
                have[found] += 1
                middle = (m.start() + m.end()) // 2
                out.append(t[max(0, middle - p.window // 2) : middle + p.window // 2].encode("utf-8", "surrogatepass")[: p.window])
    return out


def _dictionaries(first: list[tuple[str, int]], p: ToxicParams) -> ToxicModel:
    """Two trained dictionaries: the ordinary one on ordinary text, the toxic one on what toxic text has in excess of it.

    The compressor of toxic text holds both, the toxic one last, where distances are short: a window then differs
    by what it has of the toxic one alone. Trained on whole toxic texts, that one would hold the ordinary text around
    the toxic words, and catches next to nothing (README). Of the sizes and segments that zstandard trains with, those
    are taken under which most windows around a mark gain more than 99 of 100 ordinary windows do.
    """
    rng = np.random.default_rng(p.seed)
    toxic = [t.lower() for t, y in first if y == 1]
    plain = [t.lower() for t, y in first if y == 0]
    pieces = [data[i : i + 256] for data in (t.encode("utf-8", "surrogatepass") for t in plain) for i in range(0, len(data), 256)]
    pieces = [pieces[i] for i in rng.permutation(len(pieces))[: p.max_pieces]]
    base = _trained(pieces, p.ordinary_bytes)
    marks = _marks(toxic, plain)
    excess, hits, calm = _excess(toxic, marks), _marked_windows(toxic, marks, p), [x[: p.window] for x in pieces[:3000]]
    best, model = (-1.0, 0.0), ToxicModel(base, base, [2.0, 3.0, 5.0], np.zeros(N_FEATURES + 1), p)
    tried = dict.fromkeys(_trained(excess, size, k=k, d=6) for size in p.toxic_bytes for k in p.toxic_segments)
    for content in tried:
        one = ToxicModel(base, base + content, model.thresholds, model.weights, p)
        ordinary, other = (c.compress for c in one.compressors())
        gain, usual = (np.array([len(ordinary(w)) - len(other(w)) for w in ws]) for ws in (hits, calm))
        if not len(gain) or not len(usual):
            return one
        rated = (float((gain > max(1.0, np.quantile(usual, 0.99))).mean()), float(gain.mean() - usual.mean()))
        if rated > best:
            best, model = rated, one
    return model


def _calibrate(model: ToxicModel, rest: list[tuple[np.ndarray, int]], seen: dict[int, int], stood: dict[int, float]) -> ToxicModel:
    """Thresholds and weights from the margins' histograms of whole texts; ``seen`` rows of a class stood for ``stood``.

    Where one class has no row to calibrate on, every text scores the share of label 1 among the labelled rows (half a
    row added to each class), which is under 0.5 unless most are toxic.
    """
    y = np.array([label for _, label in rest], float)
    if len(set(y.tolist())) < 2:
        model.weights[-1] = np.log((stood.get(1, 0) + 0.5) / (stood.get(0, 0) + 0.5)) if stood.get(1) or stood.get(0) else -3.0
        return model
    # calibrated: margins that a window of ordinary text passes once in 20, 100 and 1000 times
    calm = sum(h for h, label in rest if not label)
    model.thresholds = [max(float(i), _quantile(calm, q)) for i, q in ((1, 0.95), (2, 0.99), (3, 0.999))]
    bins = np.arange(len(calm)) - len(calm) // 2
    x = np.stack([features(np.repeat(bins, h), model.thresholds) for h, _ in rest])
    model.weights = _fit_logistic(x, y)
    # the classes were sampled at different rates
    model.weights[-1] += np.log(stood[1] / stood[0]) - np.log(seen[1] / seen[0])
    return model


def fit(samples: list[tuple[str, int, float]], p: ToxicParams | None = None) -> ToxicModel:
    """samples: (text, label, how many rows it stands for). Dictionaries from one half, thresholds and weights from the other."""
    p = p or ToxicParams()
    half = np.random.default_rng(p.seed).permutation(len(samples)) % 2 == 0
    model = _dictionaries([(t[: p.max_chars], y) for (t, y, _), h in zip(samples, half, strict=True) if h], p)
    two = model.compressors()
    rest = [(histogram(margins(t, *two, p), p), y) for (t, y, _), h in zip(samples, half, strict=True) if not h]
    seen = {k: sum(1 for _, label, _ in samples if label == k) for k in (0, 1)}
    return _calibrate(model, rest, seen, {k: sum(w for _, label, w in samples if label == k) for k in (0, 1)})


def fit_tables(docs: DataFrame, labels: DataFrame, p: ToxicParams | None = None) -> ToxicModel:
    """As fit(), of each class on about max_per_class of the documents (doc_id, text) that ``labels`` (doc_id, label) marks.

    Dictionaries come from passages of one half, collected; the other half is measured whole, in tasks, and only
    histograms of its margins are collected.
    """
    p = p or ToxicParams()
    known = labels.where("label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = sampled_texts(docs, known, {k: p.max_per_class / n for k, n in sizes.items()}, 4 * p.max_per_class, p.seed).where("text is not null")
    half = F.pmod(F.xxhash64("text", F.lit(p.seed)), F.lit(2))
    # a passage from a place that the hash decides; texts under max_chars are whole
    first = 1 + F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.char_length("text") - p.max_chars)).cast("int")
    rows = chosen.where(half == 0).select(F.substring("text", first, F.lit(p.max_chars)).alias("text"), "label").collect()
    model = _dictionaries(sorted((r["text"], int(r["label"])) for r in rows), p)

    @F.pandas_udf("array<long>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        two = model.compressors()
        for texts in batches:
            yield pd.Series([histogram(margins(t, *two, p), p) for t in texts], dtype=object)

    rest = chosen.where(half == 1).select(measured("text").alias("h"), "label").collect()
    rest = sorted(((list(r["h"]), int(r["label"])) for r in rest))
    got = Counter(int(r["label"]) for r in rows) + Counter(y for _, y in rest)
    return _calibrate(model, [(np.array(h, np.int64), y) for h, y in rest], got, sizes)


def score(docs: DataFrame, model: ToxicModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the probability of label 1 of every row's whole text.

    Null and empty texts have no window and get the score of a text that passes no threshold. Repeated rows stay;
    other columns are ignored; an empty table gives no row. A window's length is bounded, so a long text costs time
    but not memory.
    """

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        two = model.compressors()
        for texts in batches:
            x = np.stack([features(margins(t, *two, model.p), model.thresholds) for t in texts]) if len(texts) else np.zeros((0, N_FEATURES))
            z = np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)
            yield pd.Series(1 / (1 + np.exp(-z)))

    return docs.select(*keep, probability("text").alias("score"))
