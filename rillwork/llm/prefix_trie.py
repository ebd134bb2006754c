"""A trie of conversations by preorder intervals.

Distinct conversations get ranks in the order of their sequences of turns, so those that begin alike stand side by
side and a node of the trie is an interval of ranks. By (first rank, depth) nodes stand in preorder, and a subtree
ends with the last node whose first rank is in the interval: leaves and savings of a subtree are differences of
running sums at its two ends.

A turn is told by the MD5 of its role and text, a sequence of turns by the exclusive or of two 64-bit hashes of each
turn and its place, which runs along a conversation like a sum: no text is shuffled, and no conversation has to lie
in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import written
from rillwork.llm.sweep import dense_ranks, running

#: Turns, or blocks of them, that are compared as one; ids in one piece of text that is hashed.
BLOCK, PIECE_IDS = 64, 256


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, position from 1, hi, lo, words) of every turn with a conv_id: its place, what tells it, its words.

    ``turns`` has conv_id, turn, role, text; other columns are ignored, a null role or text is empty. Ordered by turn,
    a null first, then by role and hash, so ties and repeated rows have one order. Texts are read once and not moved.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    told = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), words.alias("words"))
    told = told.select("conv_id", "turn", "role", _half(F.col("digest"), 1).alias("hi"), _half(F.col("digest"), 17).alias("lo"), "words", F.lit(1).cast("long").alias("position"))
    placed = running(told, ["conv_id"], ["conv_id", "turn", "role", "hi", "lo"], sums=["position"])
    return placed.select("conv_id", "position", "hi", "lo", "words")


def with_shared_openings(numbered: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of conversation c - c % every: all ids, and (conv_id, depth, hi, lo, words).

    Conversation c takes the first crc32(c) % most turns from there, all if there are fewer, and goes on with its own
    turns after as many.
    """
    sizes = written(numbered.groupBy("conv_id").agg(F.max("position").alias("n")))
    asked = sizes.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    taken = asked.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    taken = written(taken.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).select("conv_id", "h", "base", "taken"))
    own = numbered.join(taken.drop("base"), "conv_id").where("position > h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("depth"), "hi", "lo", "words")
    heads = numbered.where((F.col("conv_id") % every == 0) & (F.col("position") < most)).withColumnRenamed("conv_id", "base")
    lent = heads.join(taken.where("taken > 0").select("conv_id", "base", "taken"), "base").where("position <= taken")
    return sizes.select("conv_id"), own.union(lent.select("conv_id", F.col("position").alias("depth"), "hi", "lo", "words"))


def _terms() -> list[Column]:
    return [F.xxhash64(F.lit(k), "depth", "hi", "lo") for k in (1, 2)]


def sequence_ranks(rows: DataFrame) -> DataFrame:
    """(conv_id, rank from 1) of conversations given as (conv_id, depth, hi, lo), in the order of their sequences.

    Runs of BLOCK turns are ranked first, then runs of BLOCK such ranks, until each conversation has one left.
    """
    blocks = rows.groupBy("conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "hi", "lo"))).alias("run"))
    while True:
        blocks = blocks.select("conv_id", "block", "run", F.xxhash64(F.lit(1), "run").alias("a"), F.xxhash64(F.lit(2), "run").alias("b"))
        # conv_id and block only split a run that many have
        ranked = written(dense_ranks(blocks, ["a", "b"], ["run", "conv_id", "block"], "rank").select("conv_id", "block", "rank"))
        if ranked.where("block > 0").isEmpty():
            return ranked.select("conv_id", "rank")
        blocks = ranked.groupBy("conv_id", F.floor(F.col("block") / BLOCK).alias("up")).agg(F.sort_array(F.collect_list(F.struct("block", "rank"))).alias("run")).withColumnRenamed("up", "block")


def id_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256): SHA-256 of the decimal conv_ids of each (p1, p2), ascending and joined by commas.

    Ids are sorted over all partitions and turned into pieces of text there; short runs are hashed at once. The
    pieces of a long run meet in one task, as SHA-256 must read them in order: it takes them one after the other and
    keeps its state only.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2, ids = (batch.column(c).to_numpy() for c in ("p1", "p2", "conv_id"))
            n = len(ids)
            cuts = np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1
            out = []
            for a, b in zip([0, *cuts], [*cuts, n], strict=True):
                if 0 < a and b < n:  # the whole run is here
                    out.append((p1[a], p2[a], ids[a], None, hashlib.sha256(",".join(map(str, ids[a:b].tolist())).encode()).hexdigest()))
                else:
                    out.extend((p1[a], p2[a], ids[i], ",".join(map(str, ids[i : min(b, i + PIECE_IDS)].tolist())), None) for i in range(a, b, PIECE_IDS))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()] * 2)], names=["p1", "p2", "first", "piece", "ends_sha256"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for p1, p2, piece in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "piece")), strict=True):
                if (p1, p2) == key:
                    state.update(b"," + piece.encode())
                else:
                    done += [(*key, state.hexdigest())] if key else []
                    key, state = (p1, p2), hashlib.sha256(piece.encode())
            yield _digest_rows(done)
        yield _digest_rows([(*key, state.hexdigest())] if key else [])

    order = ["p1", "p2", "conv_id"]
    cut = written(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "p1 long, p2 long, first long, piece string, ends_sha256 string"))
    long = cut.where("piece is not null").select("p1", "p2", "first", "piece").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first")
    return cut.where("piece is null").select("p1", "p2", "ends_sha256").union(long.mapInArrow(hashed, "p1 long, p2 long, ends_sha256 string"))


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.string()])], names=["p1", "p2", "ends_sha256"])


def build_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of all conversations.

    ``convs`` has each conv_id once; ``turns`` (conv_id, depth from 1 without a gap, hi, lo, words). A node is a
    distinct sequence of first turns; the root is the empty one. Columns: conv_id (smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the preorder
    encoding itself: place (from 1) and subtree_end, the place of the subtree's last node. Conversations without a
    turn are members of the root; without any conversation there is no row.
    """
    t1, t2 = _terms()
    rows = turns.select("conv_id", "depth", "hi", "lo", "words", t1.alias("p1"), t2.alias("p2"))
    rows = written(running(rows, ["conv_id"], ["conv_id", "depth"], xors=["p1", "p2"]))
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2")).alias("end"))
    zero = F.lit(0).cast("long")
    ends = written(convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"end.{c}", zero).alias(c) for c in ("depth", "p1", "p2")]))
    # copies are one sequence from here on
    reps = written(ends.groupBy("p1", "p2", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("m")))
    kept = written(rows.join(reps.select("conv_id", "m"), "conv_id"))
    ranks = reps.where("depth = 0").select("conv_id", zero.alias("rank")).union(sequence_ranks(kept.select("conv_id", "depth", "hi", "lo")))
    ranks = written(ranks)
    over = [F.min("conv_id").alias("conv_id"), F.sum("m").alias("n_convs"), F.min("rank").alias("lo_rank"), F.max("rank").alias("hi_rank")]
    named = kept.join(ranks, "conv_id").withColumns({"q1": F.col("p1").bitwiseXOR(t1), "q2": F.col("p2").bitwiseXOR(t2)})
    nodes = named.groupBy("p1", "p2", "depth").agg(*over, F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    root = reps.join(ranks, "conv_id").agg(*over).where("n_convs > 0").select(zero.alias("p1"), zero.alias("p2"), zero.alias("depth"), "conv_id", "n_convs", "lo_rank", "hi_rank", zero.alias("words"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    nodes = written(nodes.union(root))
    children = nodes.where("q1 is not null").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    one, leaf, saved = F.lit(1).cast("long"), (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    nodes = running(nodes.withColumns({"place": one, "leaves": leaf, "saved": saved}), [], ["lo_rank", "depth"], sums=["place", "leaves", "saved"])
    nodes = written(nodes)
    upto = nodes.groupBy(F.col("lo_rank").alias("hi_rank")).agg(F.max("place").alias("subtree_end"), F.max("leaves").alias("leaves_end"), F.max("saved").alias("saved_end"))
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(upto, "hi_rank").join(id_digests(ends), ["p1", "p2"], "left").join(parents, ["q1", "q2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_end") - F.col("leaves") + leaf).alias("n_leaves"), (F.col("saved_end") - F.col("saved") + saved).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "place", "subtree_end",
    )
