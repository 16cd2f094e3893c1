"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words of both tables become 64-bit hashes.  Of every ``window - k + 1`` consecutive
k-grams the one with the smallest hash is a fingerprint, so any two runs of
``window`` equal words share a fingerprint.  Fingerprints of documents meet those
of benchmark items; a hit is extended to every ``window``-word run around it, and
the run's words themselves are compared, so hash collisions change nothing.
Items shorter than ``window`` words are one run of their own length; their hash is
looked up among all runs of that length in documents.

Defined cases: a null text has no words and no hits; rows with equal doc_id are
judged each by its own text; a null or wordless item never occurs; an empty table
on either side gives no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqthin.workspace import Workspace

WINDOW = 13
K = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_ID = -(1 << 63)
KEY = ["rid", "tid"]


def words(text: Column) -> Column:
    """Lower-case A-Z, then runs of digits, letters and all characters beyond ASCII."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(plain, SEPARATORS), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body's lambdas repeat it."""
    return F.get(F.transform(F.array(value), body), 0)


def _grams(hashes: Column, k: int) -> Column:
    """Hash of every run of ``k`` word hashes; empty below ``k`` words."""

    def runs(h: Column) -> Column:
        last = F.size(h) - (k - 1)
        at = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
        grams = F.transform(at, lambda i: F.xxhash64(F.slice(h, i, k)))
        return F.when(last > 0, grams).otherwise(F.array().cast("array<bigint>"))

    return _let(hashes, runs)


def _least(grams: Column, span: int) -> Column:
    """Distinct minima over ``span`` neighbours; all of one window where there are fewer."""

    def least(g: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(g) - (span - 1), F.lit(1)))
        found = F.transform(at, lambda i: F.array_min(F.slice(g, i, span)))
        return F.when(F.size(g) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))

    return _let(grams, least)


def _with_hashes(df: DataFrame) -> DataFrame:
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return df.withColumn("n", F.size("words"))


def _tagged(values: Column, length: int) -> Column:
    return F.transform(values, lambda h: F.struct(F.lit(length).alias("len"), h.alias("h")))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct runs of every item: (item_id, len, run, h); and the fingerprints they hold."""
    items = _with_hashes(items.select("item_id", words(F.col("text")).alias("words"))).where("n > 0")
    length = F.least(F.col("n"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.col("n") - length + 1))
    return items.select("item_id", "words", "hashes", length.alias("len"), starts.alias("s")).select(
        "item_id", "len",
        F.concat_ws(" ", F.slice("words", F.col("s"), F.col("len"))).alias("run"),
        F.slice("hashes", F.col("s"), F.col("len")).alias("hashes"),
    ).distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, share: int = 20,
    keep_text_id: bool = False,
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated.

    ``keep_text_id`` adds ``tid``, a hash of the text, for joins back to documents.
    ``share``: contaminated when ``share * n_hit >= n_words`` and something is hit.
    """
    ws = Workspace(docs.sparkSession)
    span = window - k + 1
    runs = ws.table(_windows(benchmark, window), "runs")
    # At most `window` lengths.
    lengths = [r["len"] for r in runs.select("len").distinct().collect()]
    short = sorted(x for x in lengths if x < window)

    def prints_of(hashes: Column) -> Column:
        parts = [_tagged(_least(_grams(hashes, k), span), window)] if window in lengths else []
        parts += [_tagged(F.array_distinct(_grams(hashes, x)), x) for x in short]
        return F.concat(*parts) if parts else F.array().cast("array<struct<len:int,h:bigint>>")

    item_prints = ws.table(
        runs.select("len", prints_of(F.col("hashes")).alias("prints"))
        .select("len", F.explode("prints").alias("p"))
        .where("p.len = len").select("p.len", "p.h").distinct(),
        "item-prints",
    )
    keyed = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), F.xxhash64("text").alias("tid"), "text"
    )
    prints = _with_hashes(keyed.withColumn("words", words(F.col("text"))))
    prints = ws.table(
        prints.select("doc_id", *KEY, "n", prints_of(F.col("hashes")).alias("prints")), "prints"
    )
    shared = (
        prints.select(*KEY, F.explode("prints").alias("p")).select(*KEY, "p.len", "p.h")
        .join(item_prints, ["len", "h"], "left_semi")
        .groupBy(*KEY).agg(F.collect_set(F.struct("len", "h")).alias("shared"))
    )
    shared = ws.table(shared, "shared")
    # Only documents with a shared fingerprint are cut into words again.
    near = keyed.drop("doc_id").join(shared, KEY).dropDuplicates(KEY)
    near = _with_hashes(near.withColumn("words", words(F.col("text"))).drop("text"))

    def starts(length: int) -> Column:
        wanted = F.transform(F.filter("shared", lambda p: p["len"] == length), lambda p: p["h"])
        grams = _grams(F.col("hashes"), k if length == window else length)
        at = _let(wanted, lambda w: F.transform(grams, lambda h, i: F.when(F.array_contains(w, h), i + 1)))
        at = F.filter(at, lambda i: i.isNotNull())
        back = span - 1 if length == window else 0
        around = F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - back, F.lit(1)), i)))
        good = F.filter(F.array_distinct(around), lambda s: s <= F.col("n") - (length - 1))
        return F.transform(good, lambda s: F.struct(F.lit(length).alias("len"), s.alias("s")))

    spots = [starts(x) for x in lengths]
    spots = F.concat(*spots) if spots else F.array().cast("array<struct<len:int,s:int>>")
    spots = _let(spots, lambda x: x)
    tried = near.select(*KEY, "words", F.explode(spots).alias("at")).select(
        *KEY, "at.len", "at.s", F.concat_ws(" ", F.slice("words", F.col("at.s"), F.col("at.len"))).alias("run")
    )
    known = ws.table(
        runs.groupBy("len", "run").agg(F.collect_set("item_id").alias("items")), "known-runs"
    )
    found = tried.join(known, ["len", "run"]).select(*KEY, "len", "s", "items")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("len")).alias("e")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(r["e"] - F.greatest(r["s"], a["e"]), F.lit(0))).alias("n"),
            F.greatest(a["e"], r["e"]).alias("e"),
        ),
        lambda a: a["n"],
    )
    hit = found.groupBy(*KEY).agg(
        covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    named = F.transform(F.coalesce("ids", F.array().cast("array<bigint>")), lambda x: x.cast("string"))
    items = F.array_sort(named)
    n_words = F.col("n").cast("bigint")
    return prints.select("doc_id", *KEY, "n").join(hit, KEY, "left").select(
        "doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= n_words)).alias("contaminated"),
        items.alias("items"), *(["tid"] if keep_text_id else []),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = contamination(docs.select("doc_id", "text"), benchmark, window, k, share, keep_text_id=True)
    # A written table: the optimizer sees its size and broadcasts it only where it is small.
    bad = found.where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("tid").alias("_bad_text")).distinct()
    bad = Workspace(docs.sparkSession).table(bad, "contaminated")
    same = docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_bad_text"])
    return docs.join(bad, same, "left_anti")
