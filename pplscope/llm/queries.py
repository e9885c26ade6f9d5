"""One query per corpus operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pplscope import scratch
from pplscope.llm import bpe, collocations, dac, decontam, filter_audit, hashtree, kneser_ney, pii, probminhash, rlz, suffixes, syncmers, toxicity
from pplscope.llm.frames import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


@query()
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by backtracking BPE, and the text decoded from them; as digests."""
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def _span_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


@query()
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: counts of the base kinds, digest of their spans, all spans."""
    found = pii.find_spans(table(spark, sf_dir, "documents"), across=True)
    names = [k.name for k in pii.KINDS if k.base]
    base = F.filter("spans", lambda s: s.kind.isin(names))

    def count(name):
        return F.size(F.filter("spans", lambda s: s.kind == name)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id",
        *[count(name) for name in names],
        F.sha2(_span_text(base), 256).alias("base_sha256"),
        _span_text(F.col("spans")).alias("spans"),
        F.transform("spans", lambda s: s.score).alias("scores"),
    )


@query()
def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards of a hash tree, and where they go with a 41st."""
    placed = hashtree.assign(table(spark, sf_dir, "documents"), hashtree.layout(40), hashtree.layout(41, founded=40))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query()
def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they and the next text's are."""
    compared = syncmers.compare_edits(table(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


@query()
def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text written in directly addressable codes, and each document read back."""
    path = scratch.new_path(spark, "tokens")
    dac.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return dac.read_documents(spark, path)


@query()
def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a conditional random field, with the offending offsets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), F.col("_toxicity.score").alias("score"),
        (F.col("_toxicity.score") >= 0.5).cast("int").alias("predicted"), F.col("_toxicity.spans").alias("spans"),
    )


@query("""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), places AS (
    SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM words WHERE len(w) >= 35
), hashed AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM places
), again AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM hashed) WHERE n > 1
), covered AS (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS i FROM again
), each_word AS (
    SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM words
), rest AS (
    SELECT e.doc_id, count(*) AS n_left, string_agg(word, ' ' ORDER BY e.i) AS left_text
    FROM each_word e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.i = c.i WHERE c.i IS NULL GROUP BY e.doc_id
)
SELECT a.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_left, 0))::BIGINT AS n_removed,
    sha256(coalesce(left_text, '')) AS kept_sha256
FROM words a LEFT JOIN rest b ON a.doc_id = b.doc_id
""")
def op5_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside every passage of 35 words that the collection has again."""
    cut = rlz.dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), places AS (
    SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words WHERE len(w) >= 50
), hashed AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM places
), again AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM hashed) WHERE n > 1
), covered AS (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM again
), runs AS (
    SELECT doc_id, min(i) - 1 AS a, count(*) AS n
    FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM covered) GROUP BY doc_id, g
)
SELECT doc_id, sum(n)::BIGINT AS n_repeated, string_agg(a || ':' || n, ',' ORDER BY a) AS passages FROM runs GROUP BY doc_id
""")
def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words that the collection has again: these, as start:words in words."""
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    shown = F.transform("passages", lambda p: F.concat_ws(":", p.start.cast("string"), p.words.cast("string")))
    return found.select("doc_id", "n_repeated", F.array_join(shown, ",").alias("passages"))


@query()
def op4_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies."""
    return probminhash.classify(table(spark, sf_dir, "documents"))


@query()
def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, one row per document and item."""
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_words", "overlap", "answer")


@query("""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
    SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, row_number() OVER () AS r,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS copied FROM docs
), label AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), failed AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([
        len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
        regexp_matches(t, '[#$%&*|]'), copied
    ]) AS bad, r
    FROM words LEFT JOIN label ON words.doc_id = label.doc_id
), sets AS (
    SELECT r, any_value(part) AS part, any_value(good) AS good, any_value(toxic) AS toxic, coalesce(string_agg(f, '') FILTER (bad), '') AS bad
    FROM failed GROUP BY r
), counted AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM sets GROUP BY part, bad
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
    SELECT a.c || b.c || d.c || e.c || g.c AS o FROM letters a, letters b, letters d, letters e, letters g
    WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5
), places AS (
    SELECT o, s::INTEGER AS step, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS earlier FROM orders, generate_series(1, 5) AS x(s)
), judged AS (
    SELECT part, o, step, f, n, good, toxic, contains(bad, f) AS fails, bad = f AS only_this,
        len(list_intersect(string_split(bad, ''), string_split(earlier, ''))) > 0 AND bad <> '' AND earlier <> '' AS gone
    FROM counted, places
), rows AS (
    SELECT part, o, step, any_value(f) AS f, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
    FROM judged GROUP BY part, o, step
)
SELECT part, o AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM rows
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all 120 orders, and each one's Shapley value, by language."""
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""
WITH docs AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), pieces AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM docs
), places AS (
    SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m
), counted AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f FROM places GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang
), candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE m >= 2 AND f >= 30
), cuts AS (
    SELECT c.lang, c.phrase, c.m, c.f AS a, k, x.f AS l, y.f AS r, (2000000 * c.f::HUGEINT) // (x.f::HUGEINT + y.f) AS score
    FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM candidates) c
    JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, f, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (
        SELECT *, unnest(generate_series(1, m - s + 1)) AS i FROM candidates, (SELECT unnest([2, 3]) AS s) WHERE s < m)
), swallowed AS (
    SELECT DISTINCT a.lang, a.phrase FROM candidates a JOIN inside b ON a.lang = b.lang AND a.phrase = b.phrase
    WHERE 100 * b.f::HUGEINT >= 80 * a.f::HUGEINT
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM lowest ANTI JOIN swallowed USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""")
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two to four words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query()
def op12_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text under a Kneser-Ney model of four fifths of them, and of counted words alone."""
    return kneser_ney.held_out_scores(table(spark, sf_dir, "documents"))
