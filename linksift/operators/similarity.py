"""Set-similarity joins on tokens: prefix, positional, length and bit filters, then exact verification by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_fingerprint, words
from ..session import by_shuffle, cut_lineage

#: Entries of one token and block that a task meets on either side; longer lists are cut, of the hottest MOST_SPLIT ones.
SPLIT_ROWS, MOST_SPLIT = 20_000, 100_000


def needed(n: Column, ratio: float, min_shared: int = 1) -> Column:
    """How many tokens a set of ``n`` must share. The small slack only lowers it."""
    return F.greatest(F.ceil(n * F.lit(ratio) - F.lit(1e-9)).cast("int"), F.lit(max(min_shared, 1)))


def prefix_length(n: Column, ratio: float, min_shared: int = 1) -> Column:
    """How many of a set's rarest tokens must be probed so that no match is missed: it shares one of any n - needed + 1."""
    return F.greatest(n - needed(n, ratio, min_shared) + 1, F.lit(0))


def smaller_share(jaccard: float) -> float:
    """The share of the smaller set that two sets of this Jaccard similarity have in common at least."""
    return 2 * jaccard / (1 + jaccard)


def ordered_sets(nodes: DataFrame, *keys: str) -> DataFrame:
    """``nodes`` plus ``ordered``: the 64-bit hashes of ``tokens``, those that the fewest nodes have first.

    ``keys`` (``node`` by default) name a row. One such table may serve several joins, as any order common to both
    sides of a join is right.
    """
    by = list(keys) or ["node"]
    long = nodes.select(*by, F.explode(F.transform("tokens", lambda t: F.xxhash64(t))).alias("_tok"))
    freq = long.groupBy("_tok").agg(F.count(F.lit(1)).alias("_df"))
    rarest = F.sort_array(F.collect_list(F.struct("_df", "_tok")))
    order = long.join(by_shuffle(freq), "_tok").groupBy(*by).agg(rarest.alias("_o")).select(*by, F.transform("_o", lambda e: e["_tok"]).alias("ordered"))
    return nodes.join(by_shuffle(order), by)


def _length_class(n: Column) -> Column:
    """floor(log2(n)) of a whole number from 1."""
    return F.length(F.bin(n)) - 1


def _signature(tokens: str, skip: int) -> Column:
    """64 bits, one set for each token by six bits of its hash."""
    def bit(h: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, skip).bitwiseAND(F.lit(63)).cast("int"))

    return F.aggregate(tokens, F.lit(0).cast("long"), lambda seen, h: seen.bitwiseOR(bit(h)))


def pair_entries(sets: DataFrame, two_sided: bool, ratio: float, min_shared: int = 1, split_rows: int = SPLIT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Probing (x) and indexed (y) entries of ``sets`` (node, side, ordered, blocks), which meet on ``_k``, ``_p``, ``_q``.

    A match shares ``needed`` tokens of its smaller set, so the first one that it shares stands among the n - needed + 1
    rarest of that set, and in the other set no later than ``needed`` tokens before the end. Each set probes with the first;
    an indexed token with ``left`` tokens from it to the end only meets sets that need no more than that. ``_k`` is a hash of token,
    block, side and length class (the power of two of ``needed``), so lists hold one length class each. A list of more than
    ``split_rows`` entries is cut into parts by node, and parts meet pairwise.
    """
    n = F.size("ordered")
    base = sets.select("node", "side", "ordered", n.alias("n"), needed(n, ratio, min_shared).alias("need"), _signature("ordered", 0).alias("s0"), _signature("ordered", 6).alias("s1"),
                       F.array_sort(F.transform(F.array_distinct("blocks"), lambda b: F.xxhash64(b))).alias("bs"))
    least = max(min_shared, 1)
    lowest = least.bit_length() - 1
    own = [F.col(c) for c in ("side", "n", "s0", "s1", "bs")]

    def named(p: str) -> list[Column]:
        return [F.col("node").alias(p)] + [F.col(c).alias(p + c) for c in ("side", "n", "s0", "s1", "bs")]

    prefix = F.slice("ordered", F.lit(1), prefix_length(F.col("n"), ratio, min_shared))
    meets = F.lit(1) - F.col("side") if two_sided else F.col("side")
    probe = (base.select("node", *own, "need", prefix.alias("_ts"), F.explode("bs").alias("_b"))
             .select("node", *own, "need", "_b", F.explode("_ts").alias("_tok"))
             .select(*named("x"), F.col("need").alias("xneed"), F.col("_b").alias("xb"), F.xxhash64("_tok", "_b", meets, _length_class(F.col("need"))).alias("_k")))
    left = F.col("n") - F.col("_j")
    index = (base.select("node", *own, "ordered", F.explode("bs").alias("_b"))
             .select("node", *own, "_b", F.posexplode("ordered").alias("_j", "_tok")).filter(left >= least)
             .select("node", *own, "_b", "_tok", left.alias("left"), F.explode(F.sequence(F.lit(lowest), F.greatest(_length_class(left), F.lit(lowest)))).alias("_c"))
             .select(*named("y"), F.col("left").alias("yleft"), F.xxhash64("_tok", "_b", "side", "_c").alias("_k")))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    lists = (probe.select("_k", one.alias("_x"), none.alias("_y")).unionByName(index.select("_k", none.alias("_x"), one.alias("_y")))
             .groupBy("_k").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y")).filter(F.greatest("_x", "_y") > split_rows))
    # Lists left whole beyond the hottest ones hold at most 1 / MOST_SPLIT of all entries each.
    hot = lists.orderBy(F.desc(F.greatest("_x", "_y")), "_k").limit(MOST_SPLIT)
    cuts = F.broadcast(hot.select("_k", *[F.ceil(F.col(c) / F.lit(split_rows)).cast("int").alias(c) for c in ("_x", "_y")]))

    def part(node: str, of: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), node), F.coalesce(F.col(of), F.lit(1))).cast("int")

    def every(of: str) -> Column:
        parts = F.coalesce(F.col(of), F.lit(1))
        return F.explode(F.slice(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1), F.lit(1), parts))  # none where the other side has none

    return (probe.join(cuts, "_k", "left").select("*", part("x", "_x").alias("_p"), every("_y").alias("_q")).drop("_x", "_y"),
            index.join(cuts, "_k", "left").select("*", every("_x").alias("_p"), part("y", "_y").alias("_q")).drop("_x", "_y"))


def similar_pairs(left: DataFrame, right: DataFrame | None, ratio: float, min_shared: int = 1, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Candidate (x, y) whose smaller token set may share ``ratio`` of its tokens with the other, and ``min_shared`` tokens.

    Inputs have ``node``, ``tokens`` (distinct, non-empty) and ``blocks`` (a pair must share
    one); with ``ordered_sets`` of all of them they may have ``ordered`` in place of tokens. Exact copies must be one node already.
    With ``right`` = None this is a self join and each unordered pair appears once. Entries meet as ``pair_entries`` says;
    a pair leaves the join if the tokens from the shared one on can suffice, if the bits of the smaller set that the
    other lacks allow it, and only in the smallest block that both name. No match is lost.
    """
    given = "ordered" in left.columns and (right is None or "ordered" in right.columns)
    cols = ["node", "blocks", "ordered" if given else "tokens"]
    everyone = left.select(*cols, F.lit(0).alias("side"))
    if right is not None:
        everyone = everyone.unionByName(right.select(*cols, F.lit(1).alias("side")))
    sets = everyone if given else ordered_sets(everyone, "node", "side").drop("tokens")
    probe, index = pair_entries(cut_lineage(sets), right is not None, ratio, min_shared, split_rows)
    smaller, equal = F.col("xn") < F.col("yn"), F.col("xn") == F.col("yn")
    kept = smaller | (equal & (F.col("x") < F.col("y") if right is None else F.col("xside") == 0))

    def enough(signature: str) -> Column:
        lacking = F.bit_count(F.col(f"x{signature}").bitwiseAND(F.bitwise_not(f"y{signature}")))
        return F.col("xn") - lacking >= F.col("xneed")

    shared_block = F.array_intersect("xbs", "ybs")
    keys = ["_k", "_p", "_q"]
    first_block = (F.size("xbs") == 1) & (F.size("ybs") == 1) | (F.col("xb") == F.element_at(shared_block, 1))
    met = probe.join(by_shuffle(index), keys).filter((F.col("xneed") <= F.col("yleft")) & kept & enough("s0") & enough("s1") & first_block)
    if right is None:
        return met.select("x", "y").distinct()
    own = F.col("xside") == 0
    return met.select(F.when(own, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(own, F.col("y")).otherwise(F.col("x")).alias("y")).distinct()


def novel_queries(proposed: DataFrame, avoid: DataFrame, query: str = "query", value: str = "value",
                  similarity: float = 0.82, shared: int = 5) -> DataFrame:
    """Proposed queries that are not too close to anything in ``avoid``.

    Too close = same fingerprint, or at least ``shared`` common words making up
    ``similarity`` of the smaller side. Equal fingerprints collapse before pairing.
    """
    fp = proposed.withColumn("fingerprint", query_fingerprint(F.col(query)))
    avoided = avoid.select(query_fingerprint(F.col(value)).alias("fingerprint")).filter("fingerprint <> ''").distinct()

    def nodes(df: DataFrame) -> DataFrame:
        return (df.select("fingerprint").distinct()
                .select(F.col("fingerprint").alias("node"), words(F.col("fingerprint")).alias("tokens"),
                        F.array(F.lit("all")).alias("blocks"))
                .filter(F.size("tokens") >= shared))

    pairs = similar_pairs(nodes(fp), nodes(avoided), similarity, shared)
    common = F.size(F.array_intersect(words(F.col("x")), words(F.col("y"))))
    smaller = F.least(F.size(words(F.col("x"))), F.size(words(F.col("y"))))
    close = pairs.filter((common >= shared) & (common / smaller >= similarity)).select(F.col("x").alias("fingerprint"))
    barred = close.unionByName(avoided.select("fingerprint")).distinct()
    return fp.join(barred, "fingerprint", "left_anti")
