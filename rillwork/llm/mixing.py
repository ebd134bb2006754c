"""Temperature mixing of sources, realised as budgeted permutations of blocks. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.llm.common import written

#: Stands for a null source.
NO_SOURCE = "\x00none"


@dataclass(frozen=True)
class MixParams:
    """entropy_share: the target entropy, from that of the natural shares (0) to that of equal shares (1).

    max_repeats: how often a source may be passed over at most. budget_tokens: tokens to draw; None means the least
    at which every document is drawn. block_tokens: size of the blocks that are permuted; shelf_blocks: how many of
    them are put in order at once. rounds: each halves the exponent's interval four times.
    """

    entropy_share: float = 0.5
    max_repeats: float = 4.0
    budget_tokens: int | None = None
    block_tokens: int = 65_536
    shelf_blocks: int = 4096
    rounds: int = 5
    seed: int = 17


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")


def source_totals(sized: DataFrame) -> DataFrame:
    """(source, tokens, share): summed before the shuffle, so a hot source costs a row per task."""
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    return totals


def _at(shares: DataFrame, exponents: list[float]) -> dict[float, dict]:
    """For each exponent: entropy of the weights, most repeats, and the budget at which all is drawn once."""
    each = shares.select("share", F.explode(F.array(*[F.lit(float(e)) for e in exponents])).alias("e")).withColumn("u", F.pow("share", F.col("e")))
    # with z = sum u: entropy = log z - sum(u log u) / z; passes over a source at budget b of all tokens = b u / (z share)
    got = each.groupBy("e").agg(F.sum("u").alias("z"), F.sum(F.col("u") * F.log("u")).alias("ulogu"), F.max(F.col("u") / F.col("share")).alias("most"), F.min(F.col("u") / F.col("share")).alias("least")).collect()
    import math

    return {r["e"]: {"z": r["z"], "entropy": math.log(r["z"]) - r["ulogu"] / r["z"], "most": r["most"] / r["z"], "least": r["least"] / r["z"]} for r in got}


def solve_exponent(shares: DataFrame, total: int, p: MixParams) -> tuple[float, float]:
    """The exponent in [0, 1] and the budget as a multiple of all tokens.

    Entropy falls and repetition falls as the exponent grows, so each limit has one crossing: the exponent is the
    larger of where entropy meets its target and where repetition meets its limit. Each round evaluates 15 inner
    points in one aggregation, which is four bisections. At exponent 1 every source is passed over equally often, the
    least that is possible: a budget that breaks the limit even there is an error.
    """

    def budget(x):
        return p.budget_tokens / total if p.budget_tokens is not None else 1 / x["least"]

    ends = _at(shares, [0.0, 1.0])
    least = ends[1.0]["most"] * budget(ends[1.0])
    if least > p.max_repeats + 1e-9:
        raise ValueError(f"a budget of {p.budget_tokens} tokens passes over the sources {least:.2f} times at least; max_repeats is {p.max_repeats}")
    target = ends[1.0]["entropy"] + p.entropy_share * (ends[0.0]["entropy"] - ends[1.0]["entropy"])
    ok = lambda x: x["entropy"] <= target + 1e-12 and x["most"] * budget(x) <= p.max_repeats + 1e-9
    if ok(ends[0.0]):
        return 0.0, budget(ends[0.0])
    low, high, best = 0.0, 1.0, ends[1.0]
    for _ in range(p.rounds):
        points = [low + (high - low) * i / 16 for i in range(1, 16)]
        found = _at(shares, points)
        fit = [e for e in points if ok(found[e])]
        high, best = (fit[0], found[fit[0]]) if fit else (high, best)
        low = max([low, *(e for e in points if e < high)])
    return high, budget(best)


def mix(docs: DataFrame, p: MixParams | None = None) -> DataFrame:
    """One row for each time a document is drawn: doc_id, source, n_tokens, epoch, weight, position.

    Tokens are words. Source i gets the weight share_i ** exponent, normalised, and so many tokens of the budget. It
    is passed over in epochs; each permutes the source's blocks and the documents in each block, by hashes of ids and
    epoch; the last epoch ends where the source's budget does. position, in [0, 1), is the part of the source's
    budget that lies before the document: ordered by it, every stretch of the mixture has the target weights.

    Unless a budget is given, it is the least at which every document is drawn at least once. A null source is a
    source of its own; documents without a word are drawn with no tokens, if their source has any; a source without
    tokens is drawn once, at weight 0. Rows that repeat are drawn each for itself. An empty table gives no row.
    """
    p = p or MixParams()
    sized = written(docs.select("doc_id", F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), n_tokens(F.col("text")).alias("n_tokens")))
    totals = written(source_totals(sized))
    total = totals.agg(F.sum("tokens")).first()[0]
    if not total:
        exponent, budget, z = 1.0, 1.0, 1.0
    else:
        shares = totals.select("source", "tokens", (F.col("tokens") / F.lit(total)).alias("share"))
        exponent, budget = solve_exponent(shares, total, p)
        z = _at(shares, [exponent])[exponent]["z"]
    total = total or 1
    weight = F.pow(F.col("tokens") / F.lit(total), F.lit(exponent)) / F.lit(z)
    plan = totals.withColumn("weight", weight).withColumn("budget", F.col("weight") * F.lit(budget * total))
    plan = plan.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / p.block_tokens)).cast("long"))
    plan = plan.withColumn("n_shelves", F.ceil(F.col("n_blocks") / p.shelf_blocks).cast("long"))
    # a crumb of a token that rounding leaves is no epoch
    plan = plan.withColumn("epochs", F.greatest(F.lit(1), F.ceil(F.col("budget") / F.col("tokens") - 1e-9)).cast("int"))
    # a source may be hot: joined by its few rows of totals, whose size Spark knows
    rows = sized.join(plan, "source", "left").fillna({"weight": 0.0, "budget": 0.0, "n_blocks": 1, "n_shelves": 1, "epochs": 1, "tokens": 0})
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.col("n_blocks")))
    blocks = rows.groupBy("source", "block", "epochs", "n_shelves").agg(F.sum("n_tokens").alias("block_tokens"))
    drawn = blocks.select("source", "block", "block_tokens", "n_shelves", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
    # blocks lie on shelves by hash; shelves are summed first, so a window holds one shelf or one source's shelves
    drawn = written(drawn.withColumn("shelf", F.pmod(F.xxhash64("block", "epoch", F.lit(p.seed + 1)), F.col("n_shelves"))).drop("n_shelves"))
    along = Window.partitionBy("source", "epoch").orderBy("shelf")
    shelves = drawn.groupBy("source", "epoch", "shelf").agg(F.sum("block_tokens").alias("shelf_tokens"))
    shelves = shelves.select("source", "epoch", "shelf", (F.sum("shelf_tokens").over(along) - F.col("shelf_tokens")).alias("before_shelf"))
    order = Window.partitionBy("source", "epoch", "shelf").orderBy(F.xxhash64("block", "epoch", F.lit(p.seed)), "block").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("before_block", F.sum("block_tokens").over(order) - F.col("block_tokens")).join(shelves, ["source", "epoch", "shelf"])
    drawn = drawn.select("source", "block", "epoch", (F.col("before_shelf") + F.col("before_block")).alias("before_block"))
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    inside = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64("doc_id", "epoch", F.lit(p.seed)), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("before_doc", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    out = each.join(drawn, ["source", "block", "epoch"])
    at = F.col("epoch") * F.col("tokens") + F.col("before_block") + F.col("before_doc")
    out = out.withColumn("at", at).where((F.col("at") < F.col("budget") - 1e-6) | (F.col("epoch") == 0) & (F.col("tokens") == 0) | (F.col("n_tokens") == 0) & (F.col("at") <= F.col("budget")))
    source = F.when(F.col("source") != NO_SOURCE, F.col("source"))
    return out.select("doc_id", source.alias("source"), "n_tokens", "epoch", "weight", F.coalesce(F.try_divide(F.col("at").cast("double"), F.col("budget")), F.lit(0.0)).alias("position"))
