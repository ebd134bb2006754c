"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import chunks, written

SHINGLE, CONTAINMENT, HASHES = 5, 0.8, 64
#: Up to so many words of all items, their keys go to every task; beyond, keys are joined.
MAX_LOCAL_WORDS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_PAIRS = "doc_id long, item_id long, n_item long, n_shared long"
_DOC_ROWS = "doc_id long, row long, value long"
_ITEM_ROWS = "item_id long, item_row long, level long, value long"


class _Known(dict):
    """Hashes of words, computed when a word is first met."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _word_hashes(text: str | None, known: _Known) -> list[int]:
    return list(map(known.__getitem__, _WORD.findall((text or "").lower())))


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words; of all words, if there are fewer."""
    n = max(1, len(words) - SHINGLE + 1) if len(words) else 0
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(words))):
            out = (out ^ words[k : k + n]) * _PRIME
            out ^= out >> np.uint64(29)
    return out


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def _level(n: int) -> int:
    """The size class of an item of n shingles: 2**level <= n < 2**(level + 1)."""
    return max(0, int(n).bit_length() - 1)


def _key(minima: np.ndarray, j: int, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (minima.astype(np.uint64) << np.uint64(16)) ^ np.uint64(j * 64 + level)
        x = (x ^ (x >> np.uint64(31))) * _PRIME
    return x ^ (x >> np.uint64(32))


def _item_keys(shingles: np.ndarray, n_hashes: int) -> np.ndarray:
    a, b = _functions(n_hashes)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        return np.array([_key((low * a[j] + b[j]).min()[None], j, _level(len(np.unique(shingles))))[0] for j in range(n_hashes)], np.uint64)


def _window_keys(per_doc: list[np.ndarray], levels: list[int], n_hashes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document's place, key) of every window, hash function and size class.

    A document's windows for items of class l have 4 * 2**l shingles and begin every 2 * 2**l: a stretch as long as
    any item of the class lies whole in one. So a window is at most eight times an item, whatever the document's
    length, and one hash function a band suffices: an item that shares four fifths of its shingles with a window
    goes unseen with a chance under (1 - 0.09) ** 64 at the very worst and (1 - 0.2) ** 64 for a copied passage.
    """
    sizes = np.array([len(x) for x in per_doc])
    alive = np.flatnonzero(sizes)
    if not len(alive):
        return
    flat = np.concatenate([per_doc[i] for i in alive])
    low = (flat >> np.uint64(32)).astype(np.uint32)
    sizes = sizes[alive]
    a, b = _functions(n_hashes)
    base = min(levels)
    unit = 2 << base

    def cut(lengths: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Where blocks of so many begin, and how many each document has."""
        n = -(-lengths // step)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(first, n) + place * step, n

    begins, n_base = cut(sizes, unit)
    upper = [(level, *cut(n_base, 1 << (level - base))) for level in levels]
    for j in range(n_hashes):
        with np.errstate(over="ignore"):
            mins = np.minimum.reduceat(low * a[j] + b[j], begins)
        for level, starts, n in upper:
            m = np.minimum.reduceat(mins, starts) if level > base else mins
            doc = np.repeat(np.arange(len(n)), n)
            pair = m.copy()
            same = doc[1:] == doc[:-1]
            pair[:-1][same] = np.minimum(m[:-1][same], m[1:][same])
            yield alive[doc], _key(pair, j, level)


def _search(items: list[tuple[int, np.ndarray]], containment: float, n_hashes: int):
    levels = sorted({_level(len(s)) for _, s in items})
    keys = np.concatenate([_item_keys(s, n_hashes) for _, s in items])
    owner = np.repeat(np.arange(len(items)), n_hashes)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        # most window keys are no item's: a look at their low bits tells, without a search
        low_bits = np.uint64((1 << 22) - 1)
        known_bits = np.zeros(1 << 22, bool)
        known_bits[keys & low_bits] = True
        for batch in batches:
            out = []
            for ids, texts in chunks([batch.column(0).to_pylist(), batch.column(1).to_pylist()]):
                if len(known) > 500_000:
                    known.clear()
                per_doc = [_shingles(np.array(_word_hashes(t, known), np.uint64)) for t in texts]
                seen: set[tuple[int, int]] = set()
                for doc, k in _window_keys(per_doc, levels, n_hashes):
                    maybe = np.flatnonzero(known_bits[k & low_bits])
                    if not len(maybe):
                        continue
                    left, right = np.searchsorted(keys, k[maybe], "left"), np.searchsorted(keys, k[maybe], "right")
                    for d, lo, hi in zip(doc[maybe].tolist(), left.tolist(), right.tolist(), strict=True):
                        seen.update((d, o) for o in owner[lo:hi].tolist())
                sets: dict[int, np.ndarray] = {}
                for d, o in sorted(seen):
                    item_id, own = items[o]
                    whole = sets.setdefault(d, np.unique(per_doc[d]))
                    shared = int(np.isin(own, whole, assume_unique=True).sum())
                    if shared >= containment * len(own) - 1e-9:
                        out.append((ids[d], item_id, len(own), shared))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_item", "n_shared"])

    return run


def _rows(batches: Iterator[pa.RecordBatch], size: int = 200_000) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    """(ids, texts, shingles of each text), so many characters at once."""
    known = _Known()
    for batch in batches:
        for ids, texts in chunks([batch.column(0).to_pylist(), batch.column(1).to_pylist()], size):
            if len(known) > 500_000:
                known.clear()
            yield ids, texts, [_shingles(np.array(_word_hashes(t, known), np.uint64)) for t in texts]


def _row_key(text: str | None) -> int:
    """Tells rows of one id apart: rows that share id and text are one."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - 2**63


def _emit_docs(levels: list[int] | None, n_hashes: int):
    """(doc_id, row, value): the window keys for these size classes, or the distinct shingles, each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, per_doc in _rows(batches):
            owner, value = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            if levels is None:
                sets = [np.unique(s) for s in per_doc]
                owner.append(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                value.extend(sets)
            else:
                for d, k in _window_keys(per_doc, levels, n_hashes):
                    both = np.unique(np.stack([d.astype(np.uint64), k]), axis=1)
                    owner.append(both[0].astype(np.int64))
                    value.append(both[1])
            at, keys = np.concatenate(owner), np.concatenate(value)
            rows = np.array([_row_key(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[at]), pa.array(rows[at]), pa.array(keys.view(np.int64))], names=["doc_id", "row", "value"])

    return run


def _emit_items(keys: bool, n_hashes: int):
    """(item_id, row, level, value): an item's keys, or its distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, per_doc in _rows(batches):
            found = [(i, _row_key(t), np.unique(s)) for i, t, s in zip(ids, texts, per_doc, strict=True) if len(s)]
            values = [_item_keys(s, n_hashes) if keys else s for _, _, s in found]
            sizes = [len(v) for v in values]
            flat = np.concatenate([np.zeros(0, np.uint64), *values])
            column = lambda xs, t: pa.array(np.repeat(np.array(xs, np.int64), sizes), t)
            yield pa.RecordBatch.from_arrays([column([i for i, _, _ in found], pa.int64()), column([r for _, r, _ in found], pa.int64()), column([_level(len(s)) for *_, s in found], pa.int64()), pa.array(flat.view(np.int64))], names=["item_id", "item_row", "level", "value"])

    return run


def _joined(docs: DataFrame, items: DataFrame, containment: float, n_hashes: int) -> DataFrame:
    """The same search with every table distributed, for a benchmark of any size."""
    items = written(items)
    keyed = written(items.mapInArrow(_emit_items(True, n_hashes), _ITEM_ROWS).distinct())
    levels = sorted(r["level"] for r in keyed.select("level").distinct().collect())  # size classes: at most 64
    if not levels:
        return docs.select("doc_id", *[F.lit(None).cast("long").alias(c) for c in ("item_id", "n_item", "n_shared")]).where("false")
    d = docs.mapInArrow(_emit_docs(levels, n_hashes), _DOC_ROWS)
    pairs = written(d.join(keyed, "value").select("doc_id", "row", "item_id", "item_row").distinct())
    own = written(items.mapInArrow(_emit_items(False, n_hashes), _ITEM_ROWS).select("item_id", "item_row", "value").distinct())
    whole = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_emit_docs(None, n_hashes), _DOC_ROWS).distinct()
    n_item = own.groupBy("item_id", "item_row").agg(F.count("*").alias("n_item"))
    shared = pairs.join(own, ["item_id", "item_row"]).join(whole, ["doc_id", "row", "value"]).groupBy("doc_id", "row", "item_id", "item_row").agg(F.count("*").alias("n_shared"))
    return shared.join(n_item, ["item_id", "item_row"]).where(F.col("n_shared") >= containment * F.col("n_item") - 1e-9).select("doc_id", "item_id", "n_item", "n_shared")


def find_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, n_hashes: int = HASHES, max_local_words: int = MAX_LOCAL_WORDS) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) of each item with so many of its five-word shingles in a document, each once.

    Words are runs of letters and digits in lower case; a text of fewer words is one shingle of all of them. Null
    and wordless texts, and rows without an id, match nothing. Rows that share an id are searched each for itself, on
    both sides: shingles of two rows never add up. Other columns are ignored; empty tables give no pair. While the
    items have at most ``max_local_words`` words, their keys go to every task and no row of the documents is
    shuffled; larger benchmarks are joined by key. Both ways find the same pairs: they share keys and windows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    # words as the search takes them; a word of many characters counts as several
    size = items.agg(F.sum(F.greatest(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")), F.char_length("text") / 16) + 1)).first()[0] or 0
    if size > max_local_words:
        return _joined(docs, items, containment, n_hashes).distinct()
    local = []
    for r in items.distinct().collect():
        s = np.unique(_shingles(np.array(_word_hashes(r["text"], _Known()), np.uint64)))
        if len(s):
            local.append((r["item_id"], s))
    if not local:
        return docs.select("doc_id", *[F.lit(None).cast("long").alias(c) for c in ("item_id", "n_item", "n_shared")]).where("false")
    return docs.mapInArrow(_search(local, containment, n_hashes), _PAIRS).distinct()


def per_document(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """Every document with the items found in it."""
    by_doc = leaks.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("n_shared") / F.col("n_item")).alias("max_containment"))
    out = docs.select("doc_id").join(by_doc, "doc_id", "left")
    none = F.expr("cast(array() as array<bigint>)")
    return out.select("doc_id", F.coalesce("item_ids", none).alias("item_ids"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("max_containment", F.lit(0.0)).alias("max_containment"), F.col("item_ids").isNotNull().alias("contaminated"))
