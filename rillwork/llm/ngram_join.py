"""N-gram Jaccard self-join of documents by token-combination prefixes, exact, to connected components.

A document's set has the hashes of its distinct shingles (tokens), ordered by hash. Documents of one set are one class
from the start. A pair of classes with the wanted similarity shares a token in the prefixes of both sets; if both
prefixes are extended by g tokens, it shares g + 1 tokens there. A token is frequent when it stands in more than so
many extended prefixes. A set whose prefix holds no frequent token is indexed under the single tokens of its prefix.
Any other is indexed under the rare tokens of its extended prefix, and under pairs of frequent ones that fall into the
same of g classes: of g + 1 shared tokens, one is rare or two share a class. With g frequent ones or fewer one is rare in
any case, and no pairs are needed. Every candidate is tried first by a parity sketch, whose distance never exceeds that
of the sets, and then by the sets themselves.

In an index entry, each document is compared with one chosen document. What is linked then is one component, and
only pairs of different components that share an entry are left to compare: groups of copies never give all pairs.
Documents that only entries of many leave apart are indexed anew, by the rarest of all their tokens: what they share by
common lines falls out. In what entries of many are left then, documents are compared within tasks, which tell links that
join components and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import ascii_words, chunks, written
from rillwork.llm.components import components

_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Entries of more sets than this are compared in blocks of their clusters, others by a join.
HOT = 32
BLOCK = 1024
#: Tokens that the sets of a block have together, about.
BLOCK_TOKENS = 4_000_000
_META = "doc_id long, sid long, n long, sketch array<long>, tokens array<long>"


@dataclass(frozen=True)
class JoinParams:
    """Link when 100 * intersection >= percent * union of sets of ``shingle``-word runs. A token is frequent in more than ``frequent`` sets.

    percent is 60 or more: below, linked sets may share too few tokens for the classes, and sketches of too different sizes.
    """

    shingle: int = 4
    percent: int = 85
    frequent: int = 12

    def __post_init__(self) -> None:
        if not 60 <= self.percent <= 100 or self.shingle < 1 or self.frequent < 1:
            raise ValueError("percent must lie between 60 and 100, shingle and frequent must be positive")

    def least(self, n: int) -> int:
        """Tokens that a set of n shares with any set it links to."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def window(self, n: int) -> int:
        """Tokens of lowest hash that are looked at: the prefix, extended by the most classes under which n is indexed."""
        return min(n, self.prefix(n) + self.groups(n)[-1])

    def groups(self, n: int) -> list[int]:
        """Numbers of classes of frequent tokens under which sets of n are indexed: those of all partners' sizes."""
        sizes = range(self.least(n), 100 * n // self.percent + 1)
        of = lambda m: 1 << (max(1, self.prefix(m) // 2).bit_length() - 1)
        low, high = of(sizes[0]), of(sizes[-1])
        out = [low]
        while out[-1] < high:
            out.append(out[-1] * 2)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _PRIME
        return x ^ (x >> np.uint64(29))


def _sets(texts: list[str | None], known: dict[bytes, int], k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; a text of fewer words has the hash of all of them."""
    if len(known) > 400_000:
        known.clear()
    flat, sizes = [], []
    for t in texts:
        words = ascii_words(t)
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            flat.append(h)
        sizes.append(len(words))
    words = np.array(flat, np.uint64)
    del flat
    n = max(0, len(words) - k + 1)
    runs = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            runs = (runs ^ words[i : i + n]) * _PRIME
            runs ^= runs >> np.uint64(32)
    out, at = [], 0
    for size in sizes:
        if size >= k:
            out.append(np.unique(runs[at : at + size - k + 1]))
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[at : at + size].tobytes(), seed=size)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def _sid(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63


def _sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each of as many cells as there are tokens, or up to twice as many."""
    cells = max(64, 1 << (len(own) - 1).bit_length())
    bits = (np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def _batches(batches, k: int):
    known: dict[bytes, int] = {}
    for batch in batches:
        columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
        for ids, texts in chunks(columns):
            yield ids, _sets(texts, known, k)


def _lists(arrays: list[np.ndarray | None]) -> pa.ListArray:
    """The arrays as one column, null for None; no Python object for each number."""
    sizes = np.array([0 if x is None else len(x) for x in arrays], np.int64)
    flat = np.concatenate([x for x in arrays if x is not None]) if sizes.any() else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)), mask=pa.array([x is None for x in arrays]))


def _meta(p: JoinParams):
    """Each text read and hashed once: id and size of its set, its sketch, and the tokens of its extended prefix.

    A set that the task has given tokens of lately has none again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        windows: dict[int, int] = {}
        for ids, sets in _batches(batches, p.shingle):
            if len(seen) > 1_000_000:
                seen.clear()
            sids, tokens = [_sid(s) for s in sets], []
            for s, sid in zip(sets, sids, strict=True):
                if not len(s) or sid in seen:
                    tokens.append(None)
                    continue
                seen.add(sid)
                n = len(s)
                if n not in windows:
                    windows[n] = p.window(n)
                tokens.append(s[: windows[n]])
            sketches = [_sketch(s) if len(s) else None for s in sets]
            columns = [pa.array(ids, pa.int64()), pa.array(sids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sketches), _lists(tokens)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sid", "n", "sketch", "tokens"])

    return run


def _whole(p: JoinParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _batches(batches, p.shingle):
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_sid(s) for s in sets], pa.int64()), _lists(sets)], names=["sid", "tokens"])

    return run


def _pairs(tokens: np.ndarray, g: int) -> Iterator[np.ndarray]:
    """Keys of the pairs of tokens that fall into the same of g classes."""
    of = (_mix(tokens) % np.uint64(g)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    tokens, of = tokens[order], of[order]
    for step in range(1, len(tokens)):
        same = of[step:] == of[:-step]
        if not same.any():
            return
        with np.errstate(over="ignore"):
            yield _mix((tokens[:-step][same] * np.uint64(g * 2 + 1)) ^ _mix(tokens[step:][same]))


def _signatures(p: JoinParams):
    """(key, sid, n) from (sid, n, shared): the tokens of a set's extended prefix that other sets share, as (token, pos, often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            shared = batch.column(2)
            offsets = shared.offsets.to_numpy()
            token, pos, often = (shared.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            token = token.view(np.uint64)
            found, owner = [], []
            for i, n in enumerate(sizes.tolist()):
                own = slice(offsets[i], offsets[i + 1])
                t, at, f = token[own], pos[own], often[own]
                order = np.argsort(t, kind="stable")
                t, at, f = t[order], at[order], f[order]
                need = p.prefix(n)
                if not (f & (at < need)).any():
                    keys = t[at < need]
                else:
                    # sets that link share more tokens than the prefix is extended by: if fewer of them are frequent, a rare one is shared
                    frequent = [(g, f & (at < need + g)) for g in p.groups(n)]
                    keys = np.concatenate([t[~f], *(k for g, x in frequent if x.sum() > min(n, need + g) - need for k in _pairs(t[x], g))])
                keys = np.unique(keys)
                found.append(keys)
                owner.append(np.full(len(keys), i))
            if not found:
                continue
            at = np.concatenate(owner).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(sids[at], pa.int64()), pa.array(sizes[at].astype(np.int32))], names=["key", "sid", "n"])

    return run


def _rarest(p: JoinParams):
    """(key, sid, n) from (sid, n, shared): a set's prefix when its rarest tokens come first. shared: its (df, token) that other sets have; the others are the rarest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            shared = batch.column(2)
            offsets = shared.offsets.to_numpy()
            df, token = (shared.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            found = []
            for i, n in enumerate(sizes.tolist()):
                own = slice(offsets[i], offsets[i + 1])
                left = max(0, p.prefix(n) - (n - (own.stop - own.start)))
                found.append(token[own][np.lexsort((token[own], df[own]))[:left]])
            if not found:
                continue
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(sids[at], pa.int64()), pa.array(sizes[at].astype(np.int32))], names=["key", "sid", "n"])

    return run


def _common(index: DataFrame) -> DataFrame:
    """(token, df) of tokens in two sets or more; counts are summed before the shuffle."""
    return index.groupBy("token").agg(F.count("*").alias("df"), F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo != hi").select("token", "df")


def _texts_of(docs: DataFrame, classes: DataFrame, sids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents that stand for these sets.

    Their ids are written first: Spark then knows the table's size as it plans, sends it to the tasks if that is
    below its broadcast threshold, and otherwise shuffles the texts.
    """
    own = written(classes.join(sids, "sid", "left_semi").select(F.col("rep").alias("doc_id")))
    return docs.join(own, "doc_id", "left_semi").select("doc_id", "text")


def _sets_of(docs: DataFrame, classes: DataFrame, sids: DataFrame, p: JoinParams) -> DataFrame:
    """(sid, tokens) of these sets, whole."""
    sets = _texts_of(docs, classes, sids).mapInArrow(_whole(p), "sid long, tokens array<long>")
    return written(sets.dropDuplicates(["sid"]))


def _buckets(meta: DataFrame, p: JoinParams) -> DataFrame:
    """(key, sid, n, k): sets that may be similar share a key, k sets in all; of keys of the same sets, one."""
    index = meta.where("tokens is not null").select("sid", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    flagged = index.join(_common(index), "token").select("sid", "n", F.struct("token", "pos", (F.col("df") > p.frequent).alias("often")).alias("t"))
    # copies of a set in different tasks gave the same tokens, which meet in one partition and are merged there
    sets = flagged.groupBy("sid").agg(F.first("n").alias("n"), F.collect_set("t").alias("shared"))
    return _entries(written(sets.mapInArrow(_signatures(p), "key long, sid long, n int")))


def _entries(buckets: DataFrame) -> DataFrame:
    """The rows (key, sid, n) of keys of two sets or more, with k, the sets of the key; of keys of the same sets, one."""
    member = [F.bit_xor(F.xxhash64("sid", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    entries = buckets.groupBy("key").agg(F.count("*").alias("k"), F.min("sid").alias("lo"), F.max("sid").alias("hi"), *member).where("lo != hi")
    kept = entries.groupBy("k", "lo", "hi", "x1", "x2").agg(F.min("key").alias("key")).select("key", "k")
    return written(buckets.join(kept, "key"))


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of entries (key, sid, n, k, root) with sets of different components."""
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    return written(placed.join(mixed, "key"))


def _refined(hot: DataFrame, docs: DataFrame, classes: DataFrame, p: JoinParams) -> DataFrame:
    """The sets of entries (key, sid, root) in entries by the rarest of all their tokens, those with different components.

    Any order of tokens that all sets share gives prefixes. Here it goes by the number of these sets that hold a token:
    the lines that many of them have in common come last, and stand in no prefix as long as the rest of the set fills it.
    """
    roots = written(hot.select("sid", "root").distinct())
    index = _sets_of(docs, classes, roots.select("sid"), p).select("sid", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    shared = index.join(_common(index), "token").groupBy("sid").agg(F.first("n").alias("n"), F.collect_list(F.struct("df", "token")).alias("shared"))
    entries = _entries(written(shared.mapInArrow(_rarest(p), "key long, sid long, n int")))
    return _mixed(entries.join(roots, "sid").select("key", "sid", "n", "k", "root"))


def _apart(entries: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs (a, b) of different components and like sizes in entries of few sets."""
    cold = entries.where(F.col("k") <= HOT)
    one = cold.select("key", F.col("sid").alias("a"), F.col("n").alias("m_a"), F.col("root").alias("r_a"))
    two = cold.select("key", F.col("sid").alias("b"), F.col("n").alias("m_b"), F.col("root").alias("r_b"))
    near = (F.least("m_a", "m_b") * 100 >= F.greatest("m_a", "m_b") * p.percent) & (F.col("r_a") != F.col("r_b")) & (F.col("a") > F.col("b"))
    return one.join(two, "key").where(near).select("a", "b")


def _needed(a: Column, b: Column, p: JoinParams) -> Column:
    """The least intersection of linked sets of these sizes."""
    return F.ceil((a + b) * p.percent / (100.0 + p.percent) - 1e-9)


def _fold(x: Column) -> Column:
    half = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs (a, b) that link: by sizes and sketches, then by whole sets."""
    side = lambda x: classes.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * p.percent
    x, y = F.col("s_a"), F.col("s_b")
    x, y = F.when(F.size(x) > F.size(y), _fold(x)).otherwise(x), F.when(F.size(y) > F.size(x), _fold(y)).otherwise(y)
    apart = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, v: t + v)
    most = F.col("n_a") + F.col("n_b") - 2 * _needed(F.col("n_a"), F.col("n_b"), p)
    left = written(both.where(sizes).where(apart <= most).select("a", "b", "n_a", "n_b"))
    sids = left.select(F.col("a").alias("sid")).union(left.select(F.col("b").alias("sid"))).distinct()
    sets = _sets_of(docs, classes, sids, p)
    both = left.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("t_a")), "a").join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("t_b")), "b")
    shared = F.size(F.array_intersect("t_a", "t_b"))
    return both.withColumn("shared", shared).where(100 * F.col("shared") >= p.percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _candidates(sid: np.ndarray, n: np.ndarray, root: np.ndarray, first: np.ndarray, sketches: tuple[np.ndarray, np.ndarray], p: JoinParams) -> Iterator[tuple[int, np.ndarray]]:
    """Each set of two blocks with those it may link to by sizes and sketches: of other components, each pair once."""
    flat, length = sketches
    start = np.cumsum(length) - length
    for size in np.unique(length).tolist():
        own = np.flatnonzero(length == size)
        rows = flat[start[own][:, None] + np.arange(size)]
        twice = np.flatnonzero(length == 2 * size)
        longer = flat[start[twice][:, None] + np.arange(2 * size)]
        others, cells = np.concatenate([own, twice]), np.concatenate([rows, longer[:, :size] ^ longer[:, size:]])
        for k, x in enumerate(own.tolist()):
            apart = np.bitwise_count(cells ^ rows[k]).sum(axis=1, dtype=np.int64)
            both = n[others] + n[x]
            needed = -(-p.percent * both // (100 + p.percent))
            ok = (apart <= both - 2 * needed) & (root[others] != root[x])
            ok &= np.minimum(n[others], n[x]) * 100 >= np.maximum(n[others], n[x]) * p.percent
            ok &= (length[others] > size) | (others > x)
            if not first.all():
                ok &= first[others] != first[x]
            if ok.any():
                yield x, others[ok]


def _close(p: JoinParams):
    """Of two blocks of a cluster the sets that have a candidate there: a row for a set, not for a pair."""

    def run(table: pa.Table) -> pa.Table:
        sid, n, root, first = (table.column(c).to_numpy() for c in ("sid", "n", "root", "first"))
        length = np.array([len(x) for x in table.column("sketch")], np.int64)
        flat = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64)
        near = np.zeros(len(sid), bool)
        for x, hits in _candidates(sid, n, root, first, (flat, length), p):
            near[x] = near[hits] = True
        return table.select(["cluster", "i", "j", "first", "sid", "root"]).filter(pa.array(near))

    return run


def _joined(p: JoinParams):
    """Links (a, b) between the sets of two blocks, tried whole; what is joined already is not tried, so there are fewer links than sets."""

    def run(table: pa.Table) -> pa.Table:
        sid, root, first = (table.column(c).to_numpy() for c in ("sid", "root", "first"))
        tokens = table.column("tokens").combine_chunks()
        offsets, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
        n = np.diff(offsets).astype(np.int64)
        sets = [flat[u:v] for u, v in zip(offsets[:-1], offsets[1:], strict=True)]
        sketches = [_sketch(x).view(np.uint64) for x in sets]
        joined = np.unique(root, return_inverse=True)[1]
        out_a, out_b = [], []
        for x, hits in _candidates(sid, n, root, first, (np.concatenate(sketches), np.array([len(k) for k in sketches])), p):
            for y in hits.tolist():
                if joined[x] == joined[y]:
                    continue
                less, more = (sets[x], sets[y]) if n[x] < n[y] else (sets[y], sets[x])
                at = np.minimum(np.searchsorted(more, less), len(more) - 1)
                shared = int((more[at] == less).sum())
                if 100 * shared >= p.percent * (n[x] + n[y] - shared):
                    joined[joined == joined[y]] = joined[x]
                    out_a.append(max(sid[x], sid[y]))
                    out_b.append(min(sid[x], sid[y]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _within_clusters(hot: DataFrame, docs: DataFrame, classes: DataFrame, p: JoinParams) -> DataFrame:
    """Links (a, b) that join what the entries (key, sid, root) of many sets have apart.

    Such entries overlap almost wholly, so a join by key would give each pair again and again. Sets that entries
    connect are a cluster; its pairs of different components are tested once, block against block: a task holds two
    blocks. Near copies that do not link to their original give candidates with the square of their number, so no
    pair leaves a task: the sets that have a candidate do, and come back whole, for a task that tries their pairs and
    tells no more links than join them. A component of BLOCK members or more has blocks of its own, which are
    not compared with each other: the work grows with what is not linked yet, not with the square of the cluster.
    """
    chosen = written(hot.groupBy("key").agg(F.min("sid").alias("b")))
    clusters = components(hot.join(chosen, "key").select(F.col("sid").alias("a"), "b"))
    members = hot.select("sid", "root").distinct().join(clusters.select(F.col("node").alias("sid"), F.col("root").alias("cluster")), "sid")
    members = written(members.join(classes.select("sid", "n", "sketch"), "sid"))
    part = F.when(F.col("size") >= BLOCK, F.col("root").cast("string")).otherwise("")
    parts = written(members.groupBy("cluster", "root").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).withColumn("part", part))
    blocks = F.ceil(F.greatest(F.sum("size") / BLOCK, F.sum("tokens") / BLOCK_TOKENS)).cast("int")
    blocks = written(parts.groupBy("cluster", "part").agg(blocks.alias("blocks")))
    name = F.concat("part", F.lit(":"), "k")
    placed = members.join(parts.select("cluster", "root", "part"), ["cluster", "root"]).join(blocks, ["cluster", "part"])
    placed = written(placed.withColumn("k", F.pmod(F.xxhash64("sid"), F.col("blocks"))).select("cluster", name.alias("block"), "sid", "n", "root", "sketch"))
    named = blocks.select("cluster", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select("cluster", "part", name.alias("block"))
    one, two = named.select("cluster", F.col("part").alias("p"), F.col("block").alias("i")), named.select("cluster", F.col("part").alias("q"), F.col("block").alias("j"))
    pairs = written(one.join(two, "cluster").where("i <= j and (p != q or p = '')").select("cluster", "i", "j"))
    left = placed.join(pairs, (placed.cluster == pairs.cluster) & (placed.block == pairs.i)).select(pairs.cluster, "i", "j", F.lit(True).alias("first"), "sid", "n", "root", "sketch")
    right = placed.join(pairs, (placed.cluster == pairs.cluster) & (placed.block == pairs.j)).where("i != j").select(pairs.cluster, "i", "j", F.lit(False).alias("first"), "sid", "n", "root", "sketch")
    near = left.unionAll(right).groupBy("cluster", "i", "j").applyInArrow(_close(p), "cluster long, i string, j string, first boolean, sid long, root long")
    near = written(near)
    whole = near.join(_sets_of(docs, classes, near.select("sid").distinct(), p), "sid")
    return whole.groupBy("cluster", "i", "j").applyInArrow(_joined(p), "a long, b long")


def link_components(docs: DataFrame, p: JoinParams | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the least doc_id that links lead to, itself included.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. A text with fewer words than a shingle is one shingle of
    all its words; null and wordless texts have an empty set and are linked with nothing. Rows without a doc_id are
    linked with nothing and have no component_id. Rows that repeat a doc_id stay, each with the component of its own
    text. Other columns are ignored; an empty table gives no row. Sets are told apart by 64-bit hashes.
    """
    p = p or JoinParams()
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    meta = written(docs.mapInArrow(_meta(p), _META))
    docs = docs.where("doc_id is not null")
    known = meta.where("n > 0 and doc_id is not null")
    # the sketch is the same in all rows of a set: the tasks keep one each before rows move
    classes = written(known.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max_by("sketch", "n").alias("sketch")))
    buckets = _buckets(known, p)
    # one chosen set an entry: the one that holds most of what others hold, so that copies meet their original
    weights = buckets.groupBy("sid").agg(F.sum("k").alias("held"))
    weighed = written(buckets.join(weights, "sid"))
    chosen = written(weighed.groupBy("key").agg(F.max_by("sid", F.struct("held", "sid")).alias("b")))
    stars = weighed.join(chosen, "key").where(F.col("sid") != F.col("b")).select(F.greatest("sid", "b").alias("a"), F.least("sid", "b").alias("b")).distinct()
    links = written(_linked(stars, docs, classes, p))
    roots = written(components(links))
    # what is left: sets of different components in one entry
    placed = weighed.where("k > 2").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select("key", "sid", "n", "k", F.coalesce("root", "sid").alias("root"))
    live = _mixed(written(placed))
    left = _refined(live.where(F.col("k") > HOT), docs, classes, p)
    rest = _apart(live, p).union(_apart(left, p)).distinct()
    more = _linked(rest, docs, classes, p).union(_within_clusters(left.where(F.col("k") > HOT), docs, classes, p))
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    full = classes.select("sid", "rep").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", "rep", F.coalesce("root", "sid").alias("root"))
    full = written(full)
    least = full.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_set = full.join(least, "root").select("sid", "component_id")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return meta.select("doc_id", "sid", "n").join(by_set, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
