"""The trie of conversations held against a plain one, and against SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from oracle import same
from pyspark.sql import functions as F

from rillwork.llm import prefix_trie, queries, sweep

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, n string"


def plain(rows):
    """Nodes of the trie of rows (conv_id, turn, role, text), by the contract."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        words = (len(m) - 1) * len((p[-1][1] if p else "").replace("\xa0", "x").replace("\x85", "x").replace("\x1c", "x").split())
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += words
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()
    )


def nodes(spark, rows, encoded=False):
    turns = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = prefix_trie.build_trie(*prefix_trie.with_shared_openings(prefix_trie.numbered_turns(turns))).collect()
    return out if encoded else sorted(tuple(r)[:8] for r in out)


def test_query(spark):
    same(spark, queries.op11_prefix_trie, queries.oracle_sql()["op11_prefix_trie"])
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in queries.op11_prefix_trie(spark, SF).collect()) == plain(rows)


@pytest.fixture(scope="module")
def branching():
    r = random.Random(5)
    rows = []
    for c in range(0, 130):
        if c % 20 == 0 and r.random() < 0.3:
            continue  # no conversation to take turns from
        for t in range(r.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a b", "a", " ", "c\td e"])))
    rows += [(c, t, "user", "same words here") for c in range(200, 260) for t in range(4)]  # one group of copies
    return rows


def test_branching_and_copies(spark, branching):
    assert nodes(spark, branching) == plain(branching)


def test_intervals_hold_subtrees(spark, branching):
    out = nodes(spark, branching, encoded=True)
    assert sorted(r["place"] for r in out) == list(range(1, len(out) + 1))
    by = {r["place"]: r for r in out}
    above = []  # in preorder, what lies within an interval lies below its node
    for k in range(1, len(out) + 1):
        while above and by[above[-1]]["subtree_end"] < k:
            above.pop()
        assert by[k]["depth"] == len(above)
        assert by[k]["parent_conv_id"] == (by[above[-1]]["conv_id"] if above else None)
        assert by[k]["n_leaves"] == sum(by[j]["n_children"] == 0 for j in range(k, by[k]["subtree_end"] + 1))
        above.append(k)


def test_long_conversations_and_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 5)
    rows = [(c, t, "user", f"w{(c // 3 if t > 20 else 0)} x") for c in range(1, 20) for t in range(30 + c % 5)]
    rows += [(c, 0, "user", "all alike") for c in range(300, 800)]
    assert nodes(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "gone"), (1, None, None, None), (1, 3, "user", "b"), (1, 3, "assistant", "a"), (1, 3, "assistant", "a"), (2, 0, "user", ""), (2, 1, "user", "x" * 100_000),
        (3, 0, "us", "er"), (4, 0, "u", "ser"), (21, 0, "user", "b"),
    ]
    assert nodes(spark, rows) == plain(rows)
    assert nodes(spark, []) == [] and nodes(spark, rows[:1]) == []


def test_sweeps_cross_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), F.col("id").alias("s"), F.col("id").alias("x"))
    rows = rows.withColumn("g", F.when(F.col("k") < 4000, 1).otherwise(F.col("g")))
    want, at = {}, {}
    for r in sorted((r["g"], r["k"]) for r in rows.collect()):
        s, x = at.get(r[0], (0, 0))
        at[r[0]] = want[r[1]] = (s + r[1], x ^ r[1])
    got = {r["k"]: (r["s"], r["x"]) for r in sweep.running(rows, ["g"], ["g", "k"], ["s"], ["x"]).collect()}
    assert got == want
    total = {r["k"]: r["s"] for r in sweep.running(rows, [], ["k"], ["s"]).collect()}
    assert all(total[k] == k * (k + 1) // 2 for k in range(5000))
    ranks = sweep.dense_ranks(rows.select("g", (F.col("k") % 40).alias("h"), "k"), ["g", "h"], ["g", "h", "k"], "rank").collect()
    order = {p: i + 1 for i, p in enumerate(sorted({(r["g"], r["h"]) for r in ranks}))}
    assert all(r["rank"] == order[r["g"], r["h"]] for r in ranks)
