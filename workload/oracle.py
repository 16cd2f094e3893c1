"""The same answers as :mod:`workload.queries`, as DuckDB SQL over the same tables."""

from __future__ import annotations

from seqthin.functions import kernels
from workload import queries as Q

M32, M64 = 0xFFFFFFFF, 1 << 64
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "".join("ACGT"[i % 4] for i in range(26))
ROUNDS = 7


def with_(*ctes: tuple[str, str], recursive: bool = False) -> str:
    seen, parts = set(), []
    for name, body in ctes:
        if name not in seen:
            seen.add(name)
            plain = body.startswith("/*loop*/")
            parts.append(f"{name} AS {'' if plain else 'MATERIALIZED'} ({body})")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


SEQS = ("seqs", f"""
SELECT doc_id + 1 AS ord,
  'doc' || doc_id || '|' || CASE WHEN doc_id % 17 = 0 THEN 'undated'
    ELSE '2021-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-15' END || '|' || lang AS header,
  regexp_replace(translate(regexp_replace(text, '[ \\t\\r\\n]+', '', 'g'),
    '{LETTERS + LETTERS.upper()}', '{BASES * 2}'), '[^ACGT]', 'N', 'g') AS seq
FROM documents""")

STATS = ("stats", r"""
SELECT *, CASE WHEN length(seq) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - acgt::DOUBLE / length(seq)::DOUBLE END AS n_frac,
  CASE WHEN mm BETWEEN 1 AND 12 THEN yy * 12 + mm - 1 ELSE -1 END AS mbucket
FROM (SELECT ord, header, seq, length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS acgt,
  TRY_CAST(regexp_extract(header, '^[^|]*[|]([0-9]{4})-([0-9]{2})', 1) AS INTEGER) AS yy,
  TRY_CAST(regexp_extract(header, '^[^|]*[|]([0-9]{4})-([0-9]{2})', 2) AS INTEGER) AS mm FROM seqs)""")


def gated(cfg) -> tuple[str, str]:
    return ("gated", f"SELECT * FROM stats WHERE length(seq) >= {cfg.min_len} AND n_frac <= {cfg.max_n_frac}::DOUBLE")


UNGATED = ("gated", "SELECT * FROM stats")

WINDOWS = ("windows", """
SELECT ord, pos, substring(seq, pos, 15) AS w
FROM (SELECT ord, seq, unnest(range(1, length(seq) - 13)) AS pos FROM gated WHERE length(seq) >= 15)""")

CODE = """
SELECT {cols}, (((x | (x >> 16)) & 4294967295)) AS kmer FROM (
SELECT {cols}, ((x | (x >> 8)) & 281470681808895) AS x FROM (
SELECT {cols}, ((x | (x >> 4)) & 71777214294589695) AS x FROM (
SELECT {cols}, ((x | (x >> 2)) & 1085102592571150095) AS x FROM (
SELECT {cols}, ('0x' || translate(least(w, translate(reverse(w), 'ACGT', 'TGCA')), 'ACGT', '0123'))::BIGINT AS x
FROM windows WHERE position('N' IN w) = 0))))"""

OCCURRENCES = ("occurrences", CODE.format(cols="ord, pos"))
KMERS = ("kmers", "SELECT DISTINCT ord, kmer FROM occurrences")
NKMERS = ("nk", "SELECT ord, count(*) AS n_kmers FROM kmers GROUP BY ord")


def base(cfg=Q.BASE, gate=None) -> list[tuple[str, str]]:
    return [SEQS, STATS, gate or gated(cfg), WINDOWS, OCCURRENCES, KMERS, NKMERS]


# --- admission ----------------------------------------------------------------------------


def scoring(cfg, t: int, shards: bool = False) -> list[tuple[str, str]]:
    """Singleton counts and the outlier test, given the rejects of round t."""
    return [
        (f"ns{t}", _singletons(cfg, t, shards)),
        (f"run{t}", f"""
SELECT ord, shard, n_singleton, count(*) OVER w AS n_prior, sum(n_singleton) OVER w AS s, sum(n_singleton * n_singleton) OVER w AS q
FROM ns{t} WINDOW w AS (PARTITION BY shard ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
        (f"test{t}", f"""
SELECT *, coalesce(n_prior >= {cfg.warmup} AND n_singleton > mean + {float(cfg.outlier_sd)}::DOUBLE * deviation + 0.5::DOUBLE, false) AS reject
FROM (SELECT *, sqrt(greatest(0.0::DOUBLE, q::DOUBLE / n_prior::DOUBLE - mean * mean)) AS deviation
FROM (SELECT *, CASE WHEN n_prior > 0 THEN s::DOUBLE / n_prior::DOUBLE END AS mean FROM run{t}))"""),
        (f"rej{t + 1}", f"SELECT ord FROM test{t} WHERE reject"),
    ]


def _singletons(cfg, t: int, shards: bool) -> str:
    kept = f"WHERE ord NOT IN (SELECT ord FROM rej{t})" if t else ""
    if cfg.frequency == "exact":
        return f"""
SELECT k.ord, shard, count_if(f.first IS NULL OR f.first >= k.ord)::BIGINT AS n_singleton
FROM held k LEFT JOIN (SELECT shard, kmer, min(ord) AS first FROM held {kept} GROUP BY shard, kmer) f USING (shard, kmer)
GROUP BY k.ord, shard"""
    return f"""
SELECT ord, shard, count_if(unseen)::BIGINT AS n_singleton FROM (
SELECT k.ord, k.shard, k.kmer, bool_or(f.first IS NULL OR f.first >= k.ord) AS unseen
FROM cells k LEFT JOIN (SELECT shard, cms_row, col, min(ord) AS first FROM cells {kept} GROUP BY shard, cms_row, col) f USING (shard, cms_row, col)
GROUP BY k.ord, k.shard, k.kmer) GROUP BY ord, shard"""


HELD = ("held", "SELECT ord, 0 AS shard, kmer FROM kmers")
HELD_SHARDS = ("held", "SELECT ord, shard, kmer FROM kmers JOIN shards USING (ord)")


def admission(cfg, rounds=ROUNDS, shards=False) -> list[tuple[str, str]]:
    out = [HELD_SHARDS if shards else HELD]
    for t in range(rounds):
        out += scoring(cfg, t, shards)
    last = rounds - 1
    # The result is only valid at the fixpoint; otherwise the oracle fails loudly.
    out.append(("settled", f"""
SELECT CASE WHEN EXISTS ((SELECT ord FROM rej{last} EXCEPT SELECT ord FROM rej{rounds})
  UNION ALL (SELECT ord FROM rej{rounds} EXCEPT SELECT ord FROM rej{last}))
  THEN error('more rounds needed') ELSE true END AS ok"""))
    out.append(("scored", f"SELECT t.* FROM test{last} t, settled WHERE ok"))
    out.append(("admitted", "SELECT g.* FROM gated g JOIN scored s USING (ord) WHERE NOT s.reject"))
    return out


DECISIONS = ("decisions", """
SELECT s.ord, CASE WHEN g.ord IS NULL THEN 'LOWQUAL' WHEN t.ord IS NULL THEN 'SKIP' WHEN t.reject THEN 'REJECT' ELSE 'ADMIT' END AS decision,
  length(s.seq) AS len, s.n_frac, t.n_singleton, s.header, coalesce(n_kmers, 0) AS n_kmers
FROM stats s LEFT JOIN gated g USING (ord) LEFT JOIN scored t USING (ord) LEFT JOIN nk USING (ord)""")


def cutoffs(cfg) -> list[tuple[str, str]]:
    p, mass = cfg.err_rate, cfg.cutoff_mass
    return [
        ("draws", "SELECT DISTINCT greatest(1, ord - 1) AS n FROM stats"),
        ("cut_loop", f"""/*loop*/
SELECT n, 0 AS i, 0.0::DOUBLE AS total, pow(1.0::DOUBLE - {p}::DOUBLE, n::DOUBLE) AS term FROM draws
UNION ALL
SELECT n, i + 1, total + term, term * {p}::DOUBLE / (1.0::DOUBLE - {p}::DOUBLE) * (n - i)::DOUBLE / (i + 1)::DOUBLE
FROM cut_loop WHERE total < {mass}::DOUBLE AND i < n"""),
        ("cuts", "SELECT n, max(i) AS cutoff FROM cut_loop GROUP BY n"),
    ]


# --- hashes -------------------------------------------------------------------------------


def _mul(x: str, c: int) -> str:
    return f"((({x})::UHUGEINT * {c}::UHUGEINT) % {M64}::UHUGEINT)::UBIGINT"


def mix64(source: str, keep: str, x: str, seed: int) -> str:
    """SELECT keep, mixed FROM source, one step per level."""
    a, b = kernels.MIX_MULTIPLIERS
    return f"""
SELECT {keep}, xor(h, h >> 31) AS mixed FROM (
SELECT {keep}, {_mul("xor(h, h >> 27)", b)} AS h FROM (
SELECT {keep}, {_mul("xor(h, h >> 30)", a)} AS h FROM (
SELECT {keep}, xor(({x})::UBIGINT, {seed}::UBIGINT) AS h FROM {source})))"""


def cells(width: int) -> list[tuple[str, str]]:
    parts = [
        f"SELECT kmer, {row} AS cms_row, (mixed & {(1 << width) - 1}::UBIGINT)::BIGINT AS col FROM ({mix64('words', 'kmer', 'kmer', seed)})"
        for row, seed in enumerate(kernels.CMS_SEEDS)
    ]
    return [
        ("words", "SELECT DISTINCT kmer FROM kmers"),
        ("word_cells", " UNION ALL ".join(parts)),
    ]


def slot(x: str, salt: int) -> str:
    """Multiply-shift hash for k-mers below 2^30, in 64-bit arithmetic."""
    low = f"({x} * {salt & M32}::UBIGINT)"
    top = f"((({low} >> 32) + (({x} * {salt >> 32}::UBIGINT) & {M32}::UBIGINT)) & {M32}::UBIGINT)"
    h = f"({top} * 4294967296::UBIGINT + ({low} & {M32}::UBIGINT))"
    return f"xor({h}, {h} >> 29)"


def sketches(cfg, source="gated") -> list[tuple[str, str]]:
    salts = [int(s) for s in kernels.sketch_salts(cfg.sketch, cfg.salts)]
    mins = ", ".join(f"min({slot('u', s)})" for s in salts)
    return [
        ("sk", f"""
SELECT ord, mbucket, s FROM (SELECT ord, [{mins}] AS s FROM (SELECT ord, kmer::UBIGINT AS u FROM kmers) GROUP BY ord)
JOIN {source} USING (ord)"""),
    ]


def sketch_text(cfg) -> str:
    return "list_aggregate(list_transform(s, lambda v: lpad(hex(v), 16, '0')), 'string_agg', '')"


EQUAL = "len(list_filter(range(1, len(a.s) + 1), lambda p: a.s[p] = b.s[p]))"


def bands(cfg, nodes="sk") -> tuple[str, str]:
    r = cfg.sketch // cfg.bands
    return ("bands", f"""
SELECT {'{part}'} AS part, ord, band, list_slice(s, band * {r} + 1, band * {r} + {r}) AS rows
FROM (SELECT *, unnest(range({cfg.bands})) AS band FROM {nodes})""")


def edges(cfg, need: int, nodes="sk", part="mbucket", name="edges") -> list[tuple[str, str]]:
    """Pairs sharing a band within a part, agreeing in at least ``need`` slots."""
    _, body = bands(cfg, nodes)
    return [
        (f"{name}_bands", body.replace("{part}", part)),
        (f"{name}_met", f"SELECT DISTINCT a.ord AS i, b.ord AS j FROM {name}_bands a JOIN {name}_bands b USING (part, band, rows) WHERE a.ord < b.ord"),
        (name, f"""
SELECT * FROM (SELECT i, j, {EQUAL} AS equal FROM {name}_met JOIN {nodes} a ON a.ord = i JOIN {nodes} b ON b.ord = j) WHERE equal >= {need}"""),
    ]


def all_pairs(cfg, need: int, nodes="sk", name="edges") -> list[tuple[str, str]]:
    """Pairs agreeing in at least ``need`` slots, found by counting shared slot values."""
    return [
        (f"{name}_slots", f"SELECT ord, p, s[p] AS v FROM (SELECT ord, s, unnest(range(1, len(s) + 1)) AS p FROM {nodes})"),
        (name, f"""
SELECT a.ord AS i, b.ord AS j, count(*) AS equal FROM {name}_slots a JOIN {name}_slots b USING (p, v)
WHERE a.ord < b.ord GROUP BY ALL HAVING count(*) >= {need}"""),
    ]


def greedy(name="edges", nodes="sk", out="kept") -> list[tuple[str, str]]:
    """Walk records with earlier neighbours in order; drop those with a kept one."""
    return [
        (f"{out}_nb", f"SELECT j, list(i) AS near, row_number() OVER (ORDER BY j) AS rn FROM {name} GROUP BY j"),
        (f"{out}_walk", f"""/*loop*/
SELECT 0::BIGINT AS rn, []::BIGINT[] AS dropped
UNION ALL
SELECT n.rn, CASE WHEN len(list_filter(n.near, lambda x: NOT list_contains(w.dropped, x))) > 0
  THEN list_append(w.dropped, n.j) ELSE w.dropped END
FROM {out}_walk w JOIN {out}_nb n ON n.rn = w.rn + 1"""),
        (f"{out}_gone", f"SELECT unnest(dropped) AS ord FROM (SELECT dropped FROM {out}_walk ORDER BY rn DESC LIMIT 1)"),
        (out, f"SELECT * FROM {nodes} WHERE ord NOT IN (SELECT ord FROM {out}_gone)"),
    ]


def need(cfg) -> int:
    """Equal slots that make a pair redundant: more than one minus the threshold of them."""
    return next(n for n in range(cfg.sketch + 2) if n / cfg.sketch > 1.0 - cfg.threshold)


def reduced(cfg, part="mbucket") -> list[tuple[str, str]]:
    return [
        *base(cfg), *admission(cfg), *sketches(cfg, "admitted"), *edges(cfg, need(cfg), part=part), *greedy(),
    ]


def sharded(cfg, gate=None, ungated=False) -> list[tuple[str, str]]:
    n = cfg.shards
    split = [
        ("sized", "SELECT ord, length(header) + length(seq) + 3 AS bytes FROM stats"),
        ("shards", f"""
SELECT ord, least(coalesce(sum(bytes) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  // ((SELECT sum(bytes) FROM sized) // {n}), {n - 1})::INTEGER AS shard FROM sized"""),
    ]
    source = [*base(cfg, gate), *split]
    if not ungated:
        source += admission(cfg, shards=True)
    source += sketches(cfg, "gated" if ungated else "admitted")
    source += [("shard_sk", "SELECT sk.*, shard FROM sk JOIN shards USING (ord)")]
    source += edges(cfg, need(cfg), "shard_sk", "shard", "local") + greedy("local", "shard_sk", "local_kept")
    source += edges(cfg, need(cfg), "local_kept", "0", "merge") + greedy("merge", "local_kept", "kept")
    return source


def exact_neighbours() -> list[tuple[str, str]]:
    cfg = Q.STRICT
    return [
        *base(cfg), *sketches(cfg), *all_pairs(cfg, need(cfg)), *greedy(),
        ("nearest", """
SELECT j AS ord, arg_max(i, equal * 100000000 - i) AS rep, max(equal) AS equal
FROM edges WHERE i IN (SELECT ord FROM kept) AND j NOT IN (SELECT ord FROM kept) GROUP BY j"""),
    ]


def shuffled(x: str, order: int) -> str:
    """Nested SELECTs that turn ``ord`` of ``sk`` into an order key ``o`` (UBIGINT)."""
    from seqthin.plans.validate import ORDER_STEP

    body = f"SELECT ord, s, xor(ord::UBIGINT, {order * ORDER_STEP}::UBIGINT) AS o FROM {x}"
    for left, right in ((13, 7), (17, 11)):
        low = (1 << (64 - left)) - 1
        body = f"SELECT ord, s, xor(o, (o & {low}::UBIGINT) * {1 << left}::UBIGINT) AS o FROM ({body})"
        body = f"SELECT ord, s, xor(o, o >> {right}) AS o FROM ({body})"
    # Order as signed 64-bit numbers.
    return f"SELECT ord, s, xor(o, {1 << 63}::UBIGINT) AS o FROM ({body})"


def study() -> list[tuple[str, str]]:
    cfg = Q.BASE
    out = [*base(cfg), *sketches(cfg), *all_pairs(cfg, need(cfg), name="alike")]
    for o in range(Q.ORDERS):
        place = "SELECT ord, s, ord::UBIGINT AS o FROM sk" if o == 0 else shuffled("sk", o)
        out += [
            (f"place{o}", f"SELECT ord AS origin, row_number() OVER (ORDER BY o) AS ord FROM ({place})"),
            (f"edges{o}", f"""
SELECT least(a.ord, b.ord) AS i, greatest(a.ord, b.ord) AS j FROM alike e JOIN place{o} a ON a.origin = e.i JOIN place{o} b ON b.origin = e.j"""),
            *greedy(f"edges{o}", f"place{o}", f"kept{o}"),
        ]
    sizes = " UNION ALL ".join(f"SELECT {o} AS o, count(*) AS kept FROM kept{o}" for o in range(Q.ORDERS))
    out.append(("sizes", sizes))
    out.append(("counts", """
SELECT count(*) AS orders, min(kept) AS low, max(kept) AS high, avg(kept) AS mean_kept, (max(kept) - min(kept)) / avg(kept) AS drift FROM sizes"""))
    pairs = " UNION ALL ".join(
        f"""SELECT {a} AS a, {b} AS b, count(*) AS kept, count_if(origin IN (SELECT origin FROM kept{b})
  OR origin IN (SELECT i FROM alike WHERE j IN (SELECT origin FROM kept{b}))
  OR origin IN (SELECT j FROM alike WHERE i IN (SELECT origin FROM kept{b})))::BIGINT AS covered FROM kept{a}"""
        for a in range(Q.ORDERS) for b in range(Q.ORDERS) if a != b
    )
    out.append(("cover", f"SELECT *, covered / greatest(1, kept) AS share FROM ({pairs})"))
    return out


def report(cfg_ctes) -> str:
    share = lambda a, b: f"100.0::DOUBLE * {a}::DOUBLE / greatest({b}, 1)::DOUBLE"
    return with_(*cfg_ctes, DECISIONS, ("tally", """
SELECT count(*) AS seen, count_if(decision = 'LOWQUAL')::BIGINT AS lowqual, count_if(decision = 'SKIP')::BIGINT AS skip,
  count_if(decision = 'REJECT')::BIGINT AS reject, count_if(decision = 'ADMIT')::BIGINT AS admit, (SELECT count(*) FROM kept) AS promoted FROM decisions"""), recursive=True) + f"""
SELECT *, {share('lowqual', 'seen')} AS lowqual_pct, {share('reject', 'seen')} AS reject_pct, {share('admit', 'seen')} AS admit_pct,
  {share('promoted', 'seen')} AS promoted_pct, {share('promoted', 'admit')} AS promoted_of_admit_pct,
  seen::DOUBLE / greatest(promoted, 1)::DOUBLE AS reduction FROM tally"""


def band_fold() -> str:
    """Bit-exact band keys, one fold per level."""
    cfg = Q.BASE
    rows = cfg.sketch // cfg.bands
    start, step, month = kernels.BAND_START, kernels.BAND_STEP, kernels.BAND_MONTH
    mul = lambda x: _mul(x, kernels.FOLD_PRIME)
    body = f"""SELECT ord, band, s, {mul(f"xor(xor({start}::UBIGINT, {_mul('band', step)}), {_mul('mbucket + 1', month)})")} AS h
FROM (SELECT *, unnest(range({cfg.bands})) AS band FROM sk)"""
    body = f"SELECT ord, band, s, xor(h, h >> 33) AS h FROM ({body})"
    for r in range(1, rows + 1):
        body = f"SELECT ord, band, s, {mul(f'xor(h, s[band * {rows} + {r}])')} AS h FROM ({body})"
        body = f"SELECT ord, band, s, xor(h, h >> 33) AS h FROM ({body})"
    return with_(*base(), *sketches(cfg)) + f"SELECT ord, band, lpad(hex(h), 16, '0') AS key FROM ({body})"


def oracle() -> dict[str, str]:
    B = Q.BASE
    seq, all_ = with_(SEQS), with_(SEQS, STATS)
    gate = with_(SEQS, STATS, gated(B))
    km = lambda tail: with_(*base()) + tail
    flow = lambda tail: with_(*reduced(B), recursive=True) + tail
    ungated_cfg = B.but(min_len=0, max_n_frac=1.0)
    ungated = [*base(B, UNGATED), *admission(ungated_cfg)]
    wide = Q.COUNTMIN.cms_log2_width
    countmin_cfg = Q.COUNTMIN.but(min_len=0, max_n_frac=1.0)
    countmin = [
        *base(B, UNGATED), *cells(wide),
        ("cells", "SELECT ord, 0 AS shard, kmer, cms_row, col FROM kmers JOIN word_cells USING (kmer)"),
        *admission(countmin_cfg),
    ]
    passed = ("passed", "SELECT k.ord, k.kmer FROM kmers k JOIN scored s USING (ord) WHERE NOT s.reject")
    held = [*base(), *admission(B), passed]
    counters = [*held, *cells(wide), ("counters", "SELECT cms_row, col, count(*) AS n FROM passed JOIN word_cells USING (kmer) GROUP BY ALL")]
    exact, shard = exact_neighbours(), sharded(Q.SHARDED)
    alone = sharded(Q.SHARDED, UNGATED, ungated=True)
    decided = "SELECT ord, decision, coalesce(n_singleton, -1) AS n_singleton FROM decisions"
    related = [*reduced(Q.FLAT, "0"), ("near", f"""
SELECT j, arg_max(i, equal * 100000000 - i) AS i, max(equal) AS equal
FROM (SELECT i, j, {EQUAL} AS equal FROM (SELECT DISTINCT a.ord AS i, b.ord AS j FROM edges_bands a JOIN edges_bands b USING (part, band, rows)
  WHERE a.ord <> b.ord AND a.ord IN (SELECT ord FROM kept)) JOIN sk a ON a.ord = i JOIN sk b ON b.ord = j) GROUP BY j""")]
    return {
        "derive_sequences": seq + "SELECT ord, header, seq FROM seqs",
        "fasta_round_trip": seq + "SELECT ord, header, seq FROM seqs",
        "fasta_source_round_trip": seq + "SELECT ord, header, seq FROM seqs",
        "fasta_stripped": seq + "SELECT ord, header, seq FROM seqs",
        "seq_stats": all_ + "SELECT ord, length(seq) AS len, acgt, n_frac FROM stats",
        "completeness_gate": gate + "SELECT s.ord, CASE WHEN g.ord IS NULL THEN 'LOWQUAL' ELSE 'OK' END AS status FROM stats s LEFT JOIN gated g USING (ord)",
        "gate_report": gate + """SELECT count(*) AS seen, count(*) - (SELECT count(*) FROM gated) AS lowqual, sum(length(seq))::BIGINT AS bases,
  100.0::DOUBLE * (count(*) - (SELECT count(*) FROM gated))::DOUBLE / count(*)::DOUBLE AS lowqual_pct FROM stats""",
        "month_histogram": all_ + "SELECT mbucket, count(*) AS n FROM stats GROUP BY mbucket",
        "header_truncate": "SELECT doc_id, left(hex(encode(doc_id || '|' || lang || '|' || text)), 510) AS key_hex FROM documents",
        "acgt_runs": seq + """SELECT ord, count(*) AS runs, max(length(run)) AS longest
FROM (SELECT ord, unnest(regexp_split_to_array(seq, '[^ACGT]+')) AS run FROM seqs) WHERE length(run) >= 15 GROUP BY ord""",
        "kmers_canonical": km("SELECT ord, kmer FROM kmers"),
        "kmers_in_sql": km("SELECT ord, kmer FROM kmers"),
        "kmer_counts": km("SELECT ord, coalesce(n_kmers, 0) AS n_kmers FROM gated LEFT JOIN nk USING (ord)"),
        "kmer_cap": km(f"""SELECT ord, coalesce(n, 0) AS n_kmers FROM gated LEFT JOIN (SELECT ord, count(DISTINCT kmer) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY pos) AS rn FROM occurrences) WHERE rn <= {Q.CAP} GROUP BY ord) USING (ord)"""),
        "kmer_df": with_(*held) + "SELECT df, count(*) AS kmers FROM (SELECT kmer, count(*) AS df FROM passed GROUP BY kmer) GROUP BY df",
        "kmer_letters": with_(*base(), *admission(B)) + """
SELECT kmer, count(*) AS df FROM (SELECT DISTINCT ord, least(w, translate(reverse(w), 'ACGT', 'TGCA')) AS kmer
  FROM windows JOIN scored USING (ord) WHERE position('N' IN w) = 0 AND NOT reject) GROUP BY kmer""",
        "distinct_kmers_sketched": km("SELECT mbucket, count(DISTINCT kmer) AS n, TRUE AS within FROM kmers JOIN stats USING (ord) GROUP BY mbucket"),
        "corpus_distinct_kmers": with_(*held) + "SELECT count(DISTINCT kmer) AS distinct_kmers FROM passed",
        "kmer_first_seen": km("SELECT ord, count(*) AS first_seen FROM (SELECT kmer, min(ord) AS ord FROM kmers GROUP BY kmer) GROUP BY ord"),
        "mix64_hash": f"SELECT doc_id, lpad(hex(mixed), 16, '0') AS mixed FROM ({mix64('documents', 'doc_id', 'doc_id', kernels.CMS_SEEDS[0])})",
        "cms_counters": with_(*counters) + "SELECT cms_row, col, n FROM counters",
        "cms_point_query": with_(*counters) + """SELECT estimate - df AS excess, count(*) AS kmers FROM
(SELECT kmer, min(n) AS estimate FROM word_cells JOIN counters USING (cms_row, col) GROUP BY kmer)
JOIN (SELECT kmer, count(*) AS df FROM passed GROUP BY kmer) USING (kmer) GROUP BY ALL""",
        "admission_round1": with_(*base(), HELD, *scoring(B, 0)) + "SELECT ord, n_singleton, n_prior, round(mean, 6) AS mean, round(deviation, 6) AS deviation, reject FROM test0",
        "admission_final": with_(*base(), *admission(B), DECISIONS) + decided,
        "admission_countmin": with_(*countmin, DECISIONS) + decided,
        "admission_ungated": with_(*ungated, DECISIONS) + decided,
        "decision_tsv": with_(*ungated, DECISIONS, *cutoffs(B), recursive=True) + """
SELECT decision, len, printf('%.4f', n_frac) AS n_frac, n_kmers, n_singleton,
  printf('%.4f', n_singleton::DOUBLE / greatest(1, n_kmers)::DOUBLE) AS singleton_frac, cutoff, header
FROM decisions JOIN cuts ON n = greatest(1, ord - 1) WHERE decision IN ('ADMIT', 'REJECT')""",
        "decision_tsv_plain": with_(*ungated, DECISIONS, *cutoffs(B), recursive=True) + """
SELECT decision, len, printf('%.4f', n_frac) AS n_frac, n_kmers, n_singleton, cutoff, header
FROM decisions JOIN cuts ON n = greatest(1, ord - 1) WHERE decision IN ('ADMIT', 'REJECT')""",
        "binomial_cutoffs": with_(SEQS, STATS, *cutoffs(B), recursive=True) + "SELECT ord, cutoff FROM stats JOIN cuts ON n = greatest(1, ord - 1)",
        "rare_kmer_counts": with_(*base(), *admission(B), *cutoffs(B), ("held_df", """
SELECT ord, kmer, reject, coalesce(sum(CASE WHEN reject THEN 0 ELSE 1 END) OVER
  (PARTITION BY kmer ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS df FROM kmers JOIN scored USING (ord)"""), recursive=True) + """
SELECT ord, count_if(df <= cutoff)::BIGINT AS n_rare FROM held_df JOIN cuts ON n = greatest(1, ord - 1) GROUP BY ord""",
        "minhash_sketch": with_(*base(), *sketches(B)) + f"SELECT ord, {sketch_text(B)} AS sketch FROM sk",
        "minhash_in_sql": with_(*base(), *sketches(B)) + f"SELECT ord, {sketch_text(B)} AS sketch FROM sk",
        "minhash_pcg64": with_(*base(Q.STRICT), *sketches(Q.STRICT)) + f"SELECT ord, {sketch_text(B)} AS sketch FROM sk",
        "lsh_bands": band_fold(),
        "jaccard_pairs": with_(*related, recursive=True) + f"SELECT i, j, equal, equal::DOUBLE / {B.sketch} AS jaccard FROM near",
        "candidate_pairs": with_(*reduced(Q.FLAT, "0"), recursive=True) + """SELECT arg_max(i, equal * 100000000 - i) AS i, j, max(equal) AS equal FROM edges
WHERE i IN (SELECT ord FROM kept) AND j NOT IN (SELECT ord FROM kept) GROUP BY j""",
        "novelty_promoted": flow("SELECT ord, header, a.mbucket, n_kmers FROM admitted a JOIN nk USING (ord) WHERE ord IN (SELECT ord FROM kept)"),
        "novelty_by_month": flow("SELECT mbucket, count(*) AS promoted FROM kept GROUP BY mbucket"),
        "novelty_undivided": with_(*reduced(Q.FLAT, "0"), recursive=True) + "SELECT ord FROM kept",
        "novelty_only": with_(*alone, recursive=True) + "SELECT ord, shard, ord IN (SELECT ord FROM kept) AS kept FROM local_kept",
        "novelty_exact_nn": with_(*exact, recursive=True) + """SELECT ord, CASE WHEN rep IS NULL THEN 'PROMOTE' ELSE 'DROP' END AS decision, coalesce(rep, ord) AS rep,
  1.0::DOUBLE - equal::DOUBLE / {m} AS novelty FROM sk LEFT JOIN nearest USING (ord)""".format(m=Q.STRICT.sketch),
        "cluster_counts": with_(*exact, recursive=True) + "SELECT rep, count(*) AS members FROM (SELECT ord AS rep FROM kept UNION ALL SELECT rep FROM nearest) GROUP BY rep",
        "cluster_sizes_by_month": with_(*reduced(B), ("nearest", """
SELECT j AS ord, arg_max(i, equal * 100000000 - i) AS rep FROM edges WHERE i IN (SELECT ord FROM kept) AND j NOT IN (SELECT ord FROM kept) GROUP BY j"""), recursive=True)
        + "SELECT rep, count(*) AS members FROM (SELECT ord AS rep FROM kept UNION ALL SELECT rep FROM nearest) GROUP BY rep",
        "sampled_drops": with_(*exact, recursive=True) + f"""
SELECT decision, length(seq) AS len, printf('%.4f', n_frac) AS n_frac,
  CASE WHEN equal IS NOT NULL THEN printf('%.4f', 1.0::DOUBLE - equal::DOUBLE / {Q.STRICT.sketch}) END AS novelty, header FROM (
SELECT s.*, n.equal, CASE WHEN g.ord IS NULL THEN 'LOWQUAL' WHEN k.ord IS NULL THEN NULL WHEN n.rep IS NULL THEN 'PROMOTE' ELSE 'DROP' END AS decision
FROM stats s LEFT JOIN gated g USING (ord) LEFT JOIN sk k USING (ord) LEFT JOIN nearest n USING (ord))
WHERE decision = 'PROMOTE' OR (decision IS NOT NULL AND ord % {Q.SAMPLE_EVERY} = 0)""",
        "shards_by_bytes": with_(*sharded(Q.SHARDED)[:9]) + "SELECT ord, shard FROM shards",
        "sharded_promoted": with_(*shard, recursive=True) + "SELECT shard, ord FROM local_kept",
        "phase2_merge": with_(*shard, recursive=True) + "SELECT ord FROM kept",
        "shard_limit": with_(*sharded(Q.SHARDED)[:9]) + f"SELECT shard, ord FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ord) AS rn FROM shards) WHERE rn <= {Q.SHARD_LIMIT}",
        "sketch_limit": km(f"SELECT ord, n FROM (SELECT ord, row_number() OVER (ORDER BY ord) AS n FROM nk) WHERE n <= {Q.SKETCH_LIMIT}"),
        "emit_promoted": flow("SELECT ord, '>' || header || chr(10) || seq AS record FROM admitted WHERE ord IN (SELECT ord FROM kept)"),
        "emit_by_header": flow("""SELECT ord, key AS header FROM (SELECT ord, split_part(header, '|', 3) || '|' || length(seq) AS key FROM stats)
WHERE key IN (SELECT split_part(header, '|', 3) || '|' || length(seq) FROM admitted WHERE ord IN (SELECT ord FROM kept))"""),
        "reduction_report": report(reduced(B)),
        "run_counters": with_(*held) + """SELECT s.*, l.lowqual, g.n - k.n AS skip, r.reject, k.n - r.reject AS admit, k.kmers
FROM (SELECT count(*) AS seen, sum(length(seq))::BIGINT AS bases FROM stats) s, (SELECT count(*) AS n FROM gated) g,
  (SELECT (SELECT count(*) FROM stats) - count(*) AS lowqual FROM gated) l,
  (SELECT count(*) AS n, sum(n_kmers)::BIGINT AS kmers FROM nk) k, (SELECT count_if(reject)::BIGINT AS reject FROM scored) r""",
        "novelty_report": with_(*alone, recursive=True) + """SELECT (SELECT count(*) FROM stats) AS admitted, (SELECT count(*) FROM local_kept) AS candidates,
  count(*) AS promoted, (SELECT count(*) FROM stats)::DOUBLE / greatest(1, count(*))::DOUBLE AS factor FROM kept""",
        "admission_report": with_(*ungated, DECISIONS) + """SELECT count(*) AS seen, count_if(decision = 'SKIP')::BIGINT AS skip,
  count_if(decision = 'ADMIT')::BIGINT AS admit, count_if(decision = 'REJECT')::BIGINT AS reject FROM decisions""",
        "order_drift": with_(*study(), recursive=True) + "SELECT * FROM counts",
        "mutual_coverage": with_(*study(), recursive=True) + "SELECT * FROM cover",
        "order_verdict": with_(*study(), recursive=True) + """SELECT avg(share) AS mean_coverage, min(share) AS min_coverage, any_value(drift) AS drift,
  avg(share) > 0.98 AND any_value(drift) < 0.10 AS equivalent FROM cover, counts""",
        "calibration": with_(*base(), *sketches(B), ("near", f"SELECT {EQUAL} AS equal FROM sk a JOIN sk b ON a.ord < b.ord"),
            ("dist", f"SELECT CASE WHEN equal = 0 THEN 1 ELSE least(1, -ln(2 * x / (1 + x)) / {B.k}) END AS d FROM (SELECT equal, equal::DOUBLE / {B.sketch} AS x FROM near)"),
            ("med", "SELECT count(*) AS pairs, median(d) AS m, avg(d) AS mean FROM dist")) + f"""
SELECT pairs, round(m, 9) AS median_divergence, round(mean, 9) AS mean_divergence, round(sqrt(ln(200) / (2 * pairs)), 9) AS rank_bound,
  round(30 * m, 9) AS suggested_threshold, round({B.threshold}::DOUBLE / 30, 9) AS boundary,
  round(1.0::DOUBLE / 64, 9) AS slot_resolution, round(1.0::DOUBLE / (30 * 64), 9) AS floor, 512::BIGINT AS bytes_per_record, 1.0::DOUBLE / 64 < m AS resolves FROM med""",
        "stream_reduce": flow("SELECT ord, header FROM admitted WHERE ord IN (SELECT ord FROM kept)"),
    }
