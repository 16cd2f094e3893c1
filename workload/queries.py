"""Queries over the driver's tables, one or more per operator.

The tables hold prose, so sequences are derived from ``documents``.  Reductions
that several queries share, and the sequences they read again and again, are
written once per session and input; ``forget`` drops them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqthin.config import ReduceConfig
from seqthin.functions import table_functions, text
from seqthin.functions.calibrate import binomial_cutoff
from seqthin.functions.similarity import sketch_hex
from seqthin.operators import kmers as K
from seqthin.operators import distinct, sketch, superkmers
from seqthin.operators.admission import outlier_test, singleton_counts
from seqthin.operators.clusters import cluster_sizes, nearest_kept
from seqthin.operators.emit import emitted, fasta_text, write_fasta
from seqthin.operators.gate import with_quality
from seqthin.plans.calibration import best_related, pair_counts, suggest
from seqthin.plans.reduce import Reducer, decision_lines, exact_scheme, novelty_lines
from seqthin.plans.validate import study_orders
from seqthin.sources import fasta_source
from seqthin.sources.fasta import read_fasta, stream_fasta
from seqthin.sources.order import chunked, shard_map, with_ordinal
from seqthin.sources.tables import document_sequences, spread
from seqthin.streaming.incremental import IncrementalReducer
from seqthin.workspace import Workspace

BASE = ReduceConfig(
    k=15, min_len=200, max_n_frac=0.2, warmup=100, outlier_sd=3.0, frequency="exact",
    err_rate=0.01,
)
COUNTMIN = BASE.but(frequency="countmin", cms_log2_width=16)
FLAT = BASE.but(by_month=False)
SHARDED = FLAT.but(shards=4)
STRICT = BASE.but(max_n_frac=0.1, salts="pcg64", by_month=False)
CAP = 200
SHARD_LIMIT = 100
SKETCH_LIMIT = 300
ORDERS = 3
SAMPLE_EVERY = 50

_shared: dict = {}


def forget() -> None:
    _shared.clear()


def _version(spark: SparkSession, sf: str) -> tuple:
    """What tells a changed input from the one seen before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    return sf, status.getModificationTime(), status.getLen()


def _once(spark: SparkSession, sf: str, what, make):
    key = (spark.sparkContext.applicationId, _version(spark, sf), what)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The derived sequences, as expressions over the documents."""
    return document_sequences(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"))


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The derived sequences as a table spread over all cores, for work that takes several passes."""

    def make():
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
        return Workspace(spark).table(document_sequences(spread(docs, "doc_id")), "records")

    return _once(spark, sf, "records", make)


def quality(spark, sf, cfg=BASE):
    return with_quality(records(spark, sf), cfg)


def gated(spark, sf, cfg=BASE):
    """Gate and admission."""
    return _once(spark, sf, ("gated", cfg), lambda: Reducer(spark, cfg).gated_admission(stored(spark, sf)))


def reduction(spark, sf, cfg=BASE):
    return _once(spark, sf, cfg, lambda: Reducer(spark, cfg).with_novelty(gated(spark, sf, cfg)))


def profile(spark, sf, cfg=BASE):
    def make():
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
        spaced = with_quality(document_sequences(spread(docs, "doc_id")), cfg)
        return Workspace(spark).table(K.profiles(spaced, cfg), "profile")

    return _once(spark, sf, ("profile", cfg), make)


def kmers(spark, sf, cfg=BASE):
    return K.explode_kmers(with_quality(stored(spark, sf), cfg), cfg, ["shard", "ord"])


def admitted(spark, sf, cfg=BASE):
    """Sequences of the records that admission lets pass."""
    rejects = gated(spark, sf, cfg).admission.rejects
    return with_quality(stored(spark, sf), cfg).join(rejects, ["shard", "ord"], "left_anti")


def targets(spark, sf, cfg=BASE):
    """Targets of runs, from the number of k-mers."""
    return superkmers.target_count(profile(spark, sf, cfg).agg(F.sum("n_kmers")).first()[0] or 0)


def admitted_frequencies(spark, sf, cfg=BASE):
    """From the runs that admission has written."""
    done = gated(spark, sf, cfg).admission
    return superkmers.frequencies_of(done.runs, cfg, done.rejects)


def sketches(spark, sf, cfg=BASE):
    return profile(spark, sf, cfg).where("sketch IS NOT NULL").select("ord", "mbucket", "sketch")


# --- records and gate ---------------------------------------------------------------------


def derive_sequences(spark, sf):
    return records(spark, sf).select("ord", "header", "seq")


def fasta_round_trip(spark, sf):
    """Write the records as FASTA, read the files back, number the records again."""

    def make():
        path = f"{Workspace(spark).path}/fasta"
        write_fasta(records(spark, sf), path)
        return path

    back = read_fasta(spark, _once(spark, sf, "fasta", make))
    return back.select("ord", "header", "seq")


def fasta_source_round_trip(spark, sf):
    """The same through the data source, in small byte ranges."""

    def make():
        fasta_source.register(spark)
        ws = Workspace(spark)
        rows = records(spark, sf).repartitionByRange("ord").sortWithinPartitions("ord").select("header", "seq")
        rows.write.format("fasta").mode("append").save(f"{ws.path}/source")
        return fasta_source.load_fasta(spark, f"{ws.path}/source", ws, splitBytes=1 << 20)

    return _once(spark, sf, "fasta source", make)


def fasta_stripped(spark, sf):
    """Files with blanks and tabs at line ends, read without them."""

    def make():
        path = f"{Workspace(spark).path}/fasta"
        padded = records(spark, sf).select(
            "ord", F.concat("header", F.lit(" \t")).alias("header"), F.concat("seq", F.lit("\t  ")).alias("seq")
        )
        write_fasta(padded, path)
        return path

    back = read_fasta(spark, _once(spark, sf, "padded fasta", make), strip_blanks=True)
    return back.select("ord", "header", "seq")


def seq_stats(spark, sf):
    return quality(spark, sf).select(
        "ord", "len", text.acgt_count(F.col("seq")).alias("acgt"), "n_frac"
    )


def completeness_gate(spark, sf):
    return quality(spark, sf).select(
        "ord", F.when(F.col("complete"), "OK").otherwise("LOWQUAL").alias("status")
    )


def gate_report(spark, sf):
    flags = quality(spark, sf).agg(
        F.count("*").alias("seen"),
        F.count_if(~F.col("complete")).alias("lowqual"),
        F.sum("len").alias("bases"),
    )
    return flags.withColumn("lowqual_pct", 100.0 * F.col("lowqual") / F.col("seen"))


def month_histogram(spark, sf):
    return quality(spark, sf).groupBy("mbucket").agg(F.count("*").alias("n"))


def header_truncate(spark, sf):
    """Byte-wise truncation of long headers with wide characters."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    header = F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "text")
    return docs.select("doc_id", F.hex(text.header_key(header)).alias("key_hex"))


def acgt_runs(spark, sf):
    runs = text.acgt_runs(F.col("seq"), BASE.k)
    rows = records(spark, sf).select("ord", F.explode(runs).alias("run"))
    return rows.groupBy("ord").agg(
        F.count("*").alias("runs"), F.max(F.length("run")).cast("bigint").alias("longest")
    )


# --- k-mers -------------------------------------------------------------------------------


def kmers_canonical(spark, sf):
    return kmers(spark, sf).select("ord", "kmer")


def _sql_records(spark, sf):
    """SQL text of the passing records as (id, seq), for table functions."""
    table_functions.register(spark, BASE, "seq_")
    with_quality(stored(spark, sf), BASE).where("complete").createOrReplaceTempView("passing_records")
    return "TABLE(SELECT ord AS id, seq FROM passing_records)"


def kmers_in_sql(spark, sf):
    """k-mers by a table function."""
    return spark.sql(f"SELECT id AS ord, kmer FROM seq_kmers({_sql_records(spark, sf)})")


def minhash_in_sql(spark, sf):
    """Sketches merged from those of stretches."""
    merged = table_functions.merged_sketch("sketch", BASE.sketch)
    rows = spark.sql(f"SELECT id AS ord, {merged} AS sketch FROM seq_minhash_parts({_sql_records(spark, sf)}) GROUP BY id")
    return rows.select("ord", sketch_hex(F.col("sketch")).alias("sketch"))


def kmer_counts(spark, sf):
    return profile(spark, sf).where("complete").select("ord", "n_kmers")


def kmer_cap(spark, sf):
    """Distinct k-mers among the first occurrences of each record only."""
    return profile(spark, sf, BASE.but(kmer_cap=CAP)).where("complete").select("ord", "n_kmers")


def kmer_df(spark, sf):
    """How many k-mers occur in how many admitted records."""
    df = admitted_frequencies(spark, sf)
    return df.groupBy("df").agg(F.count("*").alias("kmers"))


def kmer_letters(spark, sf):
    """All k-mers of admitted records as letters, with their document frequency."""
    df = admitted_frequencies(spark, sf)
    return df.select(text.kmer_text(F.col("kmer"), BASE.k).alias("kmer"), "df")


def corpus_distinct_kmers(spark, sf):
    done = gated(spark, sf).admission
    counts = superkmers.distinct_counts_of(done.runs, BASE, done.rejects)
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("distinct_kmers"))


def distinct_kmers_sketched(spark, sf):
    """Distinct k-mers by month: exact, and whether the merged sketches of all shards are within 2 % of that."""
    rows = with_quality(stored(spark, sf), BASE).withColumn("shard", F.pmod(F.xxhash64("ord"), F.lit(4)).cast("int"))
    months = distinct.united(distinct.kmer_sketches(rows, BASE, ["shard", "mbucket"]), ["mbucket"])
    exact = superkmers.distinct_counts(rows.withColumn("shard", F.col("mbucket")), BASE, targets(spark, sf))
    both = distinct.estimated(months).join(exact.select(F.col("shard").alias("mbucket"), "n"), "mbucket")
    return both.select("mbucket", "n", (F.abs(F.col("estimate") - F.col("n")) <= 0.02 * F.col("n")).alias("within"))


def kmer_first_seen(spark, sf):
    """k-mers each record is the first to hold."""
    first = superkmers.first_holder_counts(with_quality(stored(spark, sf), BASE), BASE, targets(spark, sf))
    return first.select("ord", F.col("n").alias("first_seen"))


def mix64_hash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    seed = K.kernels.CMS_SEEDS[0]
    return docs.select("doc_id", F.lpad(F.hex(K.mixed(F.col("doc_id"), seed)), 16, "0").alias("mixed"))


def cms_counters(spark, sf):
    counters = sketch.counters(admitted(spark, sf), COUNTMIN)
    width = 1 << COUNTMIN.cms_log2_width
    return counters.select(
        F.floor(F.col("cell") / width).alias("cms_row"), (F.col("cell") % width).alias("col"), "n"
    )


def cms_point_query(spark, sf):
    """Count-Min estimates against true document frequencies."""
    slices = sketch.count_slices(admitted(spark, sf), COUNTMIN)
    both = sketch.estimates(admitted_frequencies(spark, sf), slices, COUNTMIN)
    return both.groupBy((F.col("estimate") - F.col("df")).alias("excess")).agg(F.count("*").alias("kmers"))


# --- admission ----------------------------------------------------------------------------


def admission_round1(spark, sf):
    """Singletons and running statistics with every record counted as a holder."""
    q = with_quality(stored(spark, sf), BASE)
    base = profile(spark, sf).where("complete AND n_kmers > 0").select("shard", "ord")
    counts = singleton_counts(q, BASE, targets(spark, sf))
    base = base.join(counts, ["shard", "ord"], "left").fillna(0, ["n_singleton"])
    scored = outlier_test(chunked(base, Workspace(spark), ["shard", "ord"]), BASE)
    return scored.select(
        "ord", "n_singleton", "n_prior", F.round("mean", 6).alias("mean"),
        F.round("deviation", 6).alias("deviation"), "reject",
    )


def admission_final(spark, sf):
    return _verdicts(gated(spark, sf).decisions())


def admission_countmin(spark, sf):
    return _verdicts(Reducer(spark, COUNTMIN).admission_only(stored(spark, sf)))


def admission_ungated(spark, sf):
    return _verdicts(_ungated(spark, sf))


def _verdicts(rows):
    """Verdict per record; -1 singletons where none were counted."""
    return rows.select("ord", "decision", F.coalesce("n_singleton", F.lit(-1)).alias("n_singleton"))


def _ungated(spark, sf):
    return _once(spark, sf, "ungated", lambda: Reducer(spark, BASE).admission_only(stored(spark, sf)))


def decision_tsv(spark, sf):
    return decision_lines(_ungated(spark, sf))


def decision_tsv_plain(spark, sf):
    """Without the share of singletons."""
    return decision_lines(_ungated(spark, sf), with_ratio=False)


def binomial_cutoffs(spark, sf):
    return records(spark, sf).select(
        "ord", binomial_cutoff(F.greatest(F.lit(1), F.col("ord") - 1), BASE.err_rate, BASE.cutoff_mass).alias("cutoff")
    )


def rare_kmer_counts(spark, sf):
    """From the runs that admission has written; row by row where record numbers repeat."""
    done = gated(spark, sf)
    verdicts = _once(spark, sf, "verdicts", lambda: Workspace(spark).table(done.decisions(), "verdicts"))
    found = superkmers.rare_kmers_of(done.admission.runs, verdicts, BASE)
    if found is None:
        found = K.rare_kmers(kmers(spark, sf), verdicts)
    return found.select("ord", "n_rare")


# --- sketches and novelty -----------------------------------------------------------------


def minhash_sketch(spark, sf):
    return sketches(spark, sf).select("ord", sketch_hex(F.col("sketch")).alias("sketch"))


def minhash_pcg64(spark, sf):
    return sketches(spark, sf, STRICT).select("ord", sketch_hex(F.col("sketch")).alias("sketch"))


def lsh_bands(spark, sf):
    keys = K.band_key_list(F.col("mbucket"), F.col("sketch"), BASE.bands)
    rows = sketches(spark, sf).select("ord", F.posexplode(keys).alias("band", "key"))
    return rows.select("ord", "band", F.lpad(F.hex("key"), 16, "0").alias("key"))


def _related(spark, sf):
    out = reduction(spark, sf, FLAT)
    return best_related(out.admitted.select("ord", "sketch"), out.kept, FLAT)


def jaccard_pairs(spark, sf):
    """Every record with the kept one most like it, of those that share a band with it."""
    pairs = _related(spark, sf)
    return pairs.select("i", "j", "equal", (F.col("equal") / BASE.sketch).alias("jaccard"))


def candidate_pairs(spark, sf):
    """What drops records: the most similar earlier kept one, within the threshold."""
    nearest = reduction(spark, sf, FLAT).nearest()
    return nearest.select(F.col("rep").alias("i"), F.col("ord").alias("j"), "equal")


def novelty_promoted(spark, sf):
    return reduction(spark, sf).promoted.select("ord", "header", "mbucket", "n_kmers")


def novelty_by_month(spark, sf):
    return reduction(spark, sf).promoted.groupBy("mbucket").agg(F.count("*").alias("promoted"))


def novelty_undivided(spark, sf):
    return reduction(spark, sf, FLAT).kept.select("ord")


def novelty_only(spark, sf):
    """No gate, no admission, no months; two phases over four shards."""
    prof, local, overall = Reducer(spark, SHARDED).novelty_only(stored(spark, sf))
    shards = prof.select("ord", "shard").join(local, "ord", "left_semi")
    return shards.join(overall.withColumn("kept", F.lit(True)), "ord", "left").select(
        "ord", "shard", F.coalesce("kept", F.lit(False)).alias("kept")
    )


def _exact(spark, sf):
    return _once(spark, sf, "exact", lambda: Reducer(spark, STRICT).exact_neighbours(stored(spark, sf)))


def _exact_nearest(spark, sf):
    prof, kept = _exact(spark, sf)
    wanted = prof.where("sketch IS NOT NULL").select("ord", "sketch")
    return nearest_kept(wanted, kept, exact_scheme(STRICT), [], Workspace(spark))


def novelty_exact_nn(spark, sf):
    """Decisions against every kept record: a dropped one's nearest and its score.

    Kept records have no score: it decides nothing, and finding it would mean to
    compare all kept records with each other.
    """
    prof, kept = _exact(spark, sf)
    base = prof.where("sketch IS NOT NULL").select("ord")
    rows = base.join(_exact_nearest(spark, sf), "ord", "left")
    return rows.select(
        "ord",
        F.when(F.col("rep").isNull(), "PROMOTE").otherwise("DROP").alias("decision"),
        F.coalesce("rep", "ord").alias("rep"),
        (1.0 - F.col("equal") / STRICT.sketch).alias("novelty"),
    )


def cluster_counts(spark, sf):
    _, kept = _exact(spark, sf)
    return cluster_sizes(kept, _exact_nearest(spark, sf))


def sampled_drops(spark, sf):
    """All promoted records and every 50th of the dropped and the incomplete."""
    prof, _ = _exact(spark, sf)
    rows = prof.join(novelty_exact_nn(spark, sf), "ord", "left").withColumn(
        "decision", F.when(~F.col("complete"), "LOWQUAL").otherwise(F.col("decision"))
    )
    rows = with_ordinal(rows, Workspace(spark), "ord", "n")
    kept = (F.col("decision") == "PROMOTE") | (F.col("n") % SAMPLE_EVERY == 0)
    return novelty_lines(rows.where(F.col("decision").isNotNull() & kept))


# --- shards, emission, reports ------------------------------------------------------------


def shards_by_bytes(spark, sf):
    return shard_map(stored(spark, sf), Workspace(spark), SHARDED.shards)


def sharded_promoted(spark, sf):
    """Records kept within each of four shards."""
    out = reduction(spark, sf, SHARDED)
    return out.profile.join(out.shard_kept, "ord", "left_semi").select("shard", "ord")


def phase2_merge(spark, sf):
    return reduction(spark, sf, SHARDED).kept.select("ord")


def shard_limit(spark, sf):
    """At most so many records of each shard, counted before the gate."""
    limited = Reducer(spark, SHARDED.but(limit=SHARD_LIMIT))
    placed = limited._limited(limited._placed(stored(spark, sf)))
    return placed.select("shard", "ord")


def sketch_limit(spark, sf):
    """The first eligible sketches only."""
    return with_ordinal(sketches(spark, sf), Workspace(spark), "ord", "n").where(
        F.col("n") <= SKETCH_LIMIT
    ).select("ord", F.col("n").cast("bigint").alias("n"))


def emit_promoted(spark, sf):
    out = reduction(spark, sf).emitted()
    return out.select("ord", fasta_text(F.col("header"), F.col("seq")).alias("record"))


def emit_by_header(spark, sf):
    """Headers made of language and length, so that records can share one."""
    docs = records(spark, sf).withColumn(
        "header", F.concat_ws("|", F.element_at(F.split("header", "[|]"), -1), F.length("seq").cast("string"))
    )
    chosen = docs.join(reduction(spark, sf).kept, "ord", "left_semi")
    return emitted(docs, chosen, by="header").select("ord", "header")


def reduction_report(spark, sf):
    return reduction(spark, sf).report()


def run_counters(spark, sf):
    """Counters of a run from what its writes observed, without another pass."""
    done = gated(spark, sf).counters()
    names = ["seen", "lowqual", "skip", "reject", "admit", "bases", "kmers"]
    return spark.createDataFrame([tuple(done[c] for c in names)], ", ".join(f"{c} bigint" for c in names))


def novelty_report(spark, sf):
    rows = novelty_only(spark, sf)
    total = records(spark, sf).agg(F.count("*").alias("admitted"), F.lit(1).alias("one"))
    tally = rows.agg(
        F.count("*").alias("candidates"), F.count_if("kept").alias("promoted"), F.lit(1).alias("one")
    )
    return total.join(tally, "one").select(
        "admitted", "candidates", "promoted",
        (F.col("admitted") / F.greatest(F.lit(1), "promoted")).alias("factor"),
    )


def admission_report(spark, sf):
    rows = _ungated(spark, sf)
    return rows.agg(
        F.count("*").alias("seen"),
        *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in ("SKIP", "ADMIT", "REJECT")],
    )


def cluster_sizes_by_month(spark, sf):
    """Members per kept record in the month-wise reduction."""
    out = reduction(spark, sf)
    return cluster_sizes(out.kept, out.nearest())


# --- order study, calibration, streaming --------------------------------------------------


def _study(spark, sf):
    def make():
        return study_orders(sketches(spark, sf).select("ord", "sketch"), BASE, Workspace(spark), ORDERS)

    return _once(spark, sf, "study", make)


def order_drift(spark, sf):
    return _study(spark, sf).counts


def mutual_coverage(spark, sf):
    return _study(spark, sf).coverage


def order_verdict(spark, sf):
    return _study(spark, sf).verdict


def calibration(spark, sf):
    """Over all pairs of records that pass the gate."""
    out = suggest(pair_counts(sketches(spark, sf), BASE), BASE)
    return out.select(
        "pairs", *[F.round(c, 9).alias(c) for c in ("median_divergence", "mean_divergence", "rank_bound", "suggested_threshold", "boundary", "slot_resolution", "floor")],
        "bytes_per_record", "resolves",
    )


def stream_reduce(spark, sf):
    """The month-wise reduction, record files arriving in two instalments."""

    def make():
        root = Workspace(spark).path
        whole = stored(spark, sf)
        half = whole.agg(F.expr("(min(ord) + max(ord)) div 2")).first()[0]
        runner = IncrementalReducer(spark, BASE, f"{root}/state")
        for part, rows in enumerate((F.col("ord") <= half, F.col("ord") > half)):
            write_fasta(whole.where(rows), f"{root}/in/{part}")
            stream = stream_fasta(spark, f"{root}/in/*")
            runner.start(stream, f"{root}/log", available_now=True).awaitTermination()
        return runner

    runner = _once(spark, sf, "stream", make)
    return runner.table("kept").select("ord", "header")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        derive_sequences, fasta_round_trip, fasta_source_round_trip, fasta_stripped, seq_stats, completeness_gate, gate_report,
        month_histogram, header_truncate, acgt_runs,
        kmers_canonical, kmers_in_sql, kmer_counts, kmer_cap, kmer_df, kmer_letters, corpus_distinct_kmers, distinct_kmers_sketched,
        kmer_first_seen, mix64_hash, cms_counters, cms_point_query,
        admission_round1, admission_final, admission_countmin, admission_ungated, decision_tsv, decision_tsv_plain,
        binomial_cutoffs, rare_kmer_counts,
        minhash_sketch, minhash_in_sql, minhash_pcg64, lsh_bands, jaccard_pairs, candidate_pairs,
        novelty_promoted, novelty_by_month, novelty_undivided, novelty_only, novelty_exact_nn,
        cluster_counts, cluster_sizes_by_month, sampled_drops,
        shards_by_bytes, sharded_promoted, phase2_merge, shard_limit, sketch_limit,
        emit_promoted, emit_by_header, reduction_report, run_counters, novelty_report, admission_report,
        order_drift, mutual_coverage, order_verdict, calibration, stream_reduce,
    )
}
