"""One query per training-data operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqthin.llm import (
    boosted_rules, bwt_merge, byte_cnn, codes, hash_tree, main_text, phrases, ppm, repair, simhash, two_fit, winnow, word_cnn,
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_repair(spark, sf):
    return repair.repair_round_trip(_table(spark, sf, "documents"), tokenizer_path())


def op2_two_fit(spark, sf):
    return two_fit.pack(_table(spark, sf, "documents"), tokenizer_path())


def op3_boosted_rules(spark, sf):
    docs = _table(spark, sf, "documents")
    trees = boosted_rules.fit_quality(docs, _table(spark, sf, "labels"))
    return boosted_rules.quality_rules(docs, trees)


def op4_byte_cnn(spark, sf):
    docs = _table(spark, sf, "documents")
    return byte_cnn.score(docs, byte_cnn.fit_quality(docs, _table(spark, sf, "labels")))


def op5_bwt_merge(spark, sf):
    return bwt_merge.repeats(_table(spark, sf, "documents"))


def op6_ppm(spark, sf):
    return ppm.language_scores(_table(spark, sf, "documents"))


def op7_simhash(spark, sf):
    return simhash.components(_table(spark, sf, "documents"))


def op8_word_cnn(spark, sf):
    docs = _table(spark, sf, "documents")
    return word_cnn.score(docs, word_cnn.fit_toxicity(docs, _table(spark, sf, "labels")))


def op9_hash_tree(spark, sf):
    """Two regions of two racks of two shards, and one more shard in a region of its own."""
    tree = hash_tree.regular_tree(2, 2, 2)
    return hash_tree.hash_tree_shards(_table(spark, sf, "documents"), tree, hash_tree.grown(tree, 8))


def op10_winnowing(spark, sf):
    found = winnow.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.drop("items")


def op11_tag_ratio(spark, sf):
    return main_text.extract(_table(spark, sf, "pages"))


def op12_parsed_phrases(spark, sf):
    return phrases.collocations(_table(spark, sf, "documents"))


def op13_adaptive_codes(spark, sf):
    return codes.compress(_table(spark, sf, "embeddings"))


QUERIES = {
    "op1_repair": op1_repair,
    "op2_two_fit": op2_two_fit,
    "op3_boosted_rules": op3_boosted_rules,
    "op4_byte_cnn": op4_byte_cnn,
    "op5_bwt_merge": op5_bwt_merge,
    "op6_ppm": op6_ppm,
    "op7_simhash": op7_simhash,
    "op8_word_cnn": op8_word_cnn,
    "op9_hash_tree": op9_hash_tree,
    "op10_winnowing": op10_winnowing,
    "op11_tag_ratio": op11_tag_ratio,
    "op12_parsed_phrases": op12_parsed_phrases,
    "op13_adaptive_codes": op13_adaptive_codes,
}

ORACLE = {
    "op10_winnowing": r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
    FROM documents
), b AS (
    SELECT item_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
    FROM benchmark
), item AS (
    SELECT item_id, words, len(words) AS n, least(len(words), 13) AS m FROM b WHERE len(words) > 0
), runs AS (
    SELECT DISTINCT item_id, m, array_to_string(words[s : s + m - 1], ' ') AS run
    FROM (SELECT *, unnest(range(1, n - m + 2)) AS s FROM item)
), lengths AS (SELECT DISTINCT m FROM runs),
tried AS (
    SELECT doc_id, m, s, array_to_string(words[s : s + m - 1], ' ') AS run
    FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS s FROM d, lengths)
), found AS (SELECT doc_id, item_id, s, m FROM tried JOIN runs USING (m, run)),
hit AS (
    SELECT doc_id, count(DISTINCT w) AS n_hit
    FROM (SELECT doc_id, unnest(range(s, s + m)) AS w FROM (SELECT DISTINCT doc_id, s, m FROM found))
    GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.words) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op12_parsed_phrases": r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), p AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM piece
), word AS (SELECT lang, unnest(w) AS phrase FROM p),
two AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda s: w[s] || ' ' || w[s + 1])) AS phrase FROM p),
three AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda s: w[s] || ' ' || w[s + 1] || ' ' || w[s + 2])) AS phrase FROM p),
f AS (
    SELECT lang, 1 AS k, phrase, count(*) AS f FROM word GROUP BY ALL
    UNION ALL SELECT lang, 2, phrase, count(*) FROM two GROUP BY ALL HAVING count(*) >= 10
    UNION ALL SELECT lang, 3, phrase, count(*) FROM three GROUP BY ALL HAVING count(*) >= 10
), n AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT *, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (
    SELECT cut.lang, cut.phrase, cut.k, a, j, fx.f AS l, fy.f AS r,
        (1000000::HUGEINT * a * a) // (fx.f::HUGEINT * fy.f) AS score
    FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.phrase = cut.x JOIN f fy ON fy.lang = cut.lang AND fy.phrase = cut.y
), low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_two AS (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3
), longer AS (SELECT lang, phrase, max(a) AS m FROM inner_two GROUP BY ALL),
kept AS (
    SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE m IS NULL OR 100 * m < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
    a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
""",
}
