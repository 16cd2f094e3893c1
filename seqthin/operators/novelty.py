"""Novelty: keep a record unless an earlier kept record of its partition resembles it.

The sequential rule "go through the records in order, keep what no kept record
resembles" selects the lexicographically first maximal independent set of the
resemblance graph, which is computed here in rounds over relations.

Resembling records form groups, some holding a large share of all rows, and
listing all pairs of such a group is not an option.  Rounds therefore compare
records only with *heads*: the earliest few undecided holders of every key.
Heads are decided exactly among themselves, all others are compared with the
heads that are kept, and whatever resembles one is gone before the next round.
Once no key is crowded, the few remaining pairs are listed and decided at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqthin.operators.signatures import (
    KEY_LIMIT,
    Scheme,
    compare,
    crowded_keys,
    meeting_keys,
    pairs_between,
    pairs_within,
)
from seqthin.workspace import Workspace

FIRST_HEADS = 1
HEAD_GROWTH = 4


def first_of_equal(records: DataFrame, partition: list[str]) -> DataFrame:
    """Earliest record of every distinct sketch; its copies can only be redundant."""
    keys = [*partition, "sketch"]
    return records.groupBy(*keys).agg(F.min("ord").alias("ord"))


def keep_novel(
    records: DataFrame,
    scheme: Scheme,
    partition: list[str],
    ws: Workspace,
    key_limit: int = KEY_LIMIT,
    kept_before: DataFrame | None = None,
) -> DataFrame:
    """(ord) of the kept records of (ord, sketch, *partition).

    ``kept_before`` holds records kept in earlier batches, with the same columns.
    """
    if scheme.need > scheme.m:
        return records.select("ord")
    nodes = first_of_equal(records.where("sketch IS NOT NULL"), partition)
    if kept_before is not None:
        marked = nodes.withColumn("old", F.lit(False)).unionByName(
            kept_before.select(*nodes.columns).withColumn("old", F.lit(True))
        )
        nodes = ws.table(marked, "sketches")
        return _keep_beside_old(nodes, scheme, partition, ws, key_limit)
    nodes = ws.table(nodes, "sketches")
    return _keep_first(nodes, scheme, partition, ws, key_limit)


def _keep_beside_old(nodes, scheme, partition, ws, key_limit) -> DataFrame:
    new, old = nodes.where("NOT old"), nodes.where("old")
    toks, _, _ = meeting_keys(nodes, scheme, partition, ws, key_limit)
    met = pairs_between(toks.join(new.select("ord"), "ord", "left_semi"),
                        toks.join(old.select("ord"), "ord", "left_semi"))
    hit = compare(met, nodes, scheme).select(F.col("j").alias("ord")).distinct()
    fresh = ws.table(new.join(hit, "ord", "left_anti").drop("old"), "unlike-old")
    return _keep_first(fresh, scheme, partition, ws, key_limit)


def _keep_first(nodes, scheme, partition, ws, key_limit) -> DataFrame:
    toks, filtered, crowded = meeting_keys(nodes, scheme, partition, ws, key_limit)
    kept, heads = [], FIRST_HEADS
    while crowded:
        shared = 1 if filtered else scheme.shared
        chosen, toks = _head_round(nodes, toks, scheme, shared, ws, key_limit, min(heads, key_limit))
        kept.append(chosen)
        heads *= HEAD_GROWTH
        crowded = not crowded_keys(toks, key_limit).isEmpty()
    met = pairs_within(toks, 1 if filtered else scheme.shared)
    edges = ws.table(compare(met, nodes, scheme).select("i", "j"), "edges")
    _, dropped = settle(edges, ws)
    # Without head rounds every node is still a candidate here.
    left = toks.select("ord").distinct() if kept else nodes.select("ord")
    out = left.join(dropped, "ord", "left_anti")
    for chosen in kept:
        out = out.unionByName(chosen)
    return out


def _head_round(nodes, toks, scheme, shared, ws, key_limit, heads):
    """Decide the heads; returns those kept and the tokens of records still undecided."""
    crowded = ws.table(crowded_keys(toks, key_limit), "crowded").select("key")
    earliest = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    # The rank filter is applied before the shuffle too, so a crowded key sends few rows.
    last_head = (
        toks.join(crowded, "key", "left_semi")
        .withColumn("rank", earliest)
        .where(F.col("rank") <= heads)
        .groupBy("key")
        .agg(F.max("ord").alias("last"))
    )
    waiting = ws.table(
        toks.join(last_head, "key").where("ord > last").select("ord").distinct(), "waiting"
    )
    head_toks = toks.join(waiting, "ord", "left_anti")
    # A head behind a waiting record under any key cannot be kept yet.
    cut = toks.join(waiting, "ord", "left_semi").groupBy("key").agg(F.min("ord").alias("cut"))
    blocked = ws.table(
        head_toks.join(cut, "key").where("ord > cut").select("ord").distinct(), "blocked"
    )
    edges = ws.table(
        compare(pairs_within(head_toks, shared), nodes, scheme).select("i", "j"), "edges"
    )
    unsettled, dropped = settle(edges, ws, blocked)
    chosen = ws.table(
        head_toks.select("ord").distinct()
        .join(blocked, "ord", "left_anti")
        .join(dropped, "ord", "left_anti")
        .join(unsettled, "ord", "left_anti"),
        "kept",
    )
    open_toks = toks.join(chosen, "ord", "left_anti").join(dropped, "ord", "left_anti")
    met = pairs_between(open_toks, toks.join(chosen, "ord", "left_semi"))
    like_kept = ws.table(
        compare(met.where("i < j"), nodes, scheme).select(F.col("j").alias("ord")).distinct(),
        "like-kept",
    )
    return chosen, ws.table(open_toks.join(like_kept, "ord", "left_anti"), "tokens")


def settle(
    edges: DataFrame, ws: Workspace, blocked: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Greedy decisions along edges (i, j) of a written table.

    A record with no undecided earlier neighbour is kept and drops its later
    neighbours; edges of dropped records vanish; repeat.  Blocked records are
    never kept.  Returns (unsettled later endpoints, dropped), both (ord).
    """
    live, dropped, rounds = edges, [], 0
    while True:
        later = live.select(F.col("j").alias("ord"))
        if blocked is not None:
            later = later.unionByName(blocked)
        later = later.distinct().select(F.col("ord").alias("i"), F.lit(True).alias("held"))
        marked = ws.table(
            live.join(later, "i", "left").select("i", "j", F.col("held").isNull().alias("decisive")),
            "marked",
        )
        n = marked.groupBy().agg(F.count("*").alias("all"), F.count_if("decisive").alias("hits")).first()
        if n["hits"] == 0:
            break
        gone = marked.where("decisive").select(F.col("j").alias("ord")).distinct()
        dropped.append(gone)
        if n["hits"] == n["all"]:
            marked = marked.where("false")
            break
        live = (
            marked.where("NOT decisive").select("i", "j")
            .join(gone.withColumnRenamed("ord", "i"), "i", "left_anti")
            .join(gone.withColumnRenamed("ord", "j"), "j", "left_anti")
        )
    unsettled = marked.select(F.col("j").alias("ord")).distinct()
    if not dropped:
        return unsettled, unsettled.where("false")
    out = dropped[0]
    for part in dropped[1:]:
        out = out.unionByName(part)
    return unsettled, out.distinct()
