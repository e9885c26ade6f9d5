"""The test tables seen as documents, responses, results and manifests: in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pplscope.bounded import small_side
from pplscope.functions import text as T
from pplscope.operators import perplexity as P
from pplscope.operators.chunking import base_chunks
from pplscope.sources.parquet import scan_parquet

MODELS = [f"m{j}" for j in range(6)]

# --- Spark side -------------------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str, **options) -> DataFrame:
    return scan_parquet(spark, f"{d}/{name}.parquet", **options)


ROWS_PER_TASK = 1 << 12


def tasks(spark: SparkSession, d: str) -> int:
    """How many ways the checks deal documents out: one task per core, more for large tables (the rows are
    counted from footers)."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, d, "documents").count() // ROWS_PER_TASK))


def documents(spark: SparkSession, d: str, **options) -> DataFrame:
    """id, text: dealt over all cores, as the test tables have one row group each."""
    return table(spark, d, "documents", partitions=tasks(spark, d), **options).select(F.col("doc_id").alias("id"), "text")


def repeated_documents(spark: SparkSession, d: str) -> DataFrame:
    """id, text, ord: labelled documents appear a second time, later and with another text."""
    docs = documents(spark, d)
    again = docs.join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return docs.withColumn("ord", F.col("id") * 2).unionByName(
        again.select("id", F.concat(F.lit("Again. "), "text").alias("text"), (F.col("id") * 2 + 1).alias("ord"))
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return base_chunks(documents(spark, d))


# Rows of labels, three numbers each, up to which texts stay where they are when labels are joined.
LABELS = 1_000_000


def responses(spark: SparkSession, d: str) -> DataFrame:
    """model, model_response, is_correct: labelled documents dealt out to six models."""
    docs = table(spark, d, "documents")
    response = F.when(F.col("toxic") == 1, F.lit(None)).when(F.col("lang") == "es", F.lit("  ")).otherwise(F.col("text"))
    labels = small_side(table(spark, d, "labels").select("doc_id", "toxic", "quality"), LABELS)
    return docs.join(labels, "doc_id").select(
        model_of("doc_id").alias("model"), response.alias("model_response"),
        (F.col("quality") == 1).alias("is_correct"),
    )


def model_of(id_col: str):
    return F.concat(F.lit("m"), (F.col(id_col) % 6).cast("string"))


def training(spark: SparkSession, d: str) -> DataFrame:
    """model, text: every document trains one of the six models. Counting costs little a row, so rows are dealt
    out only where the files have fewer tasks than there are cores."""
    docs = table(spark, d, "documents")
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        docs = table(spark, d, "documents", partitions=tasks(spark, d))
    return docs.select(model_of("doc_id").alias("model"), "text")


def results(spark: SparkSession, d: str) -> DataFrame:
    """text_id, chunk_id, model, logprobs: ten numbers of every embedding per model, the last model has the
    rest; one model has no log-probs where an embedding starts high."""
    emb = table(spark, d, "embeddings")

    def logprobs(j: int):
        n = 10 if j < 5 else 14
        part = F.transform(F.slice("embedding", 10 * j + 1, n), lambda x: -F.abs(x))
        return F.when(F.get("embedding", F.lit(0)) > 0.25, F.array().cast("array<float>")).otherwise(part) if j == 3 else part

    per_model = F.array(*[F.struct(F.lit(m).alias("model"), logprobs(j).alias("logprobs")) for j, m in enumerate(MODELS)])
    return emb.select(
        F.col("label").cast("long").alias("text_id"), F.col("vec_id").alias("chunk_id"), F.explode(per_model).alias("r")
    ).select("text_id", "chunk_id", "r.*")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("label").cast("long").alias("text_id"), F.col("vec_id").alias("chunk_id"), "embedding"
    )


def perplexities(spark: SparkSession, d: str) -> DataFrame:
    return P.results_to_ppl(results(spark, d))


def accuracies(spark: SparkSession, d: str) -> DataFrame:
    return P.model_accuracy(responses(spark, d))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return P.gamma(perplexities(spark, d), accuracies(spark, d), MODELS)


def raw_scores(spark: SparkSession, d: str) -> DataFrame:
    """id, raw as JSON: words as tokens, the first and the longer ones unscored, and a second
    candidate beside every scored word."""

    def score(w, value):
        return F.struct(value.cast("float").alias("logprob"), w.alias("decoded_token"))

    def entry(w, i):
        both = F.map_from_arrays(
            F.array(F.concat(w, F.lit("/1")), F.concat(w, F.lit("/2"))),
            F.array(score(w, -F.length(w) / 4.0), score(F.upper(F.lit("alt")), F.lit(-9.0))),
        )
        return F.when((i > 0) & (F.length(w) <= 8), both)

    docs = documents(spark, d).select("id", T.words(F.col("text")).alias("w"))
    return docs.select("id", F.to_json(F.transform("w", entry)).alias("raw"))


# --- SQL side ---------------------------------------------------------------------------------

# Written out by hand, not taken from the code under test.
STRIP_SET = " || ".join(f"chr({c})" for c in (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
HELD, CUT = "\ufdd0", "\ufdd1"
ABBREVIATED = r"(^|[ (\ufdd0])(\p{Lu}|Mr|Mrs|Dr|St|Jr|Sr|Gen|vs|No)\. ".replace("\\ufdd0", HELD)
SENTENCE_END = "([.!?][\"')\\]]*) +([\"'(\\[]?\\p{Lu})"
WORD_CHARACTER = r"[\p{L}\p{N}_]"


def strip(x: str) -> str:
    return f"trim({x}, {STRIP_SET})"


def clean(x: str) -> str:
    return strip(f"replace(replace({x}, chr(10), ' '), chr(13), ' ')")


def words(x: str) -> str:
    flat = f"replace(replace(replace({x}, chr(10), ' '), chr(13), ' '), chr(9), ' ')"
    return f"list_filter(string_split({flat}, ' '), lambda w: w <> '')"


def sentences(x: str) -> str:
    quote = lambda s: s.replace("'", "''")
    guard = quote(ABBREVIATED)
    once = f"regexp_replace({x}, '{guard}', '\\1\\2.{HELD}', 'g')"
    twice = f"regexp_replace({once}, '{guard}', '\\1\\2.{HELD}', 'g')"
    marked = f"regexp_replace({twice}, '{quote(SENTENCE_END)}', '\\1{CUT}\\2', 'g')"
    parts = f"string_split(replace({marked}, '{HELD}', ' '), '{CUT}')"
    return f"list_filter({parts}, lambda s: s <> '')"


def packed(x: str, size: int = 500) -> str:
    return f"""list_reduce({x}, lambda acc, s:
        CASE WHEN acc.cur <> '' AND length(acc.cur) + 1 + length(s) <= {size}
             THEN {{'done': acc.done, 'cur': acc.cur || ' ' || s}}
             WHEN acc.cur = '' THEN {{'done': acc.done, 'cur': s}}
             ELSE {{'done': list_append(acc.done, acc.cur), 'cur': s}} END,
        {{'done': []::VARCHAR[], 'cur': ''}})"""


def tail(x: str, n: int = 100) -> str:
    return f"""CASE WHEN length({x}) <= {n} THEN {x}
        WHEN regexp_matches(right({x}, {n}), '^{WORD_CHARACTER}')
        THEN regexp_extract(left({x}, length({x}) - {n}), '{WORD_CHARACTER}*$') || right({x}, {n})
        ELSE right({x}, {n}) END"""


# base: text_id, chunk_id, chunk_text
BASE = f"""base_state AS (
    SELECT doc_id AS text_id, {packed(sentences(clean("text")))} AS st FROM documents),
base_lists AS (
    SELECT text_id, CASE WHEN st.cur <> '' THEN list_append(st.done, st.cur) ELSE st.done END AS chs FROM base_state),
base AS (
    SELECT text_id, CAST(unnest(generate_series(1, len(chs))) - 1 AS INTEGER) AS chunk_id, unnest(chs) AS chunk_text
    FROM base_lists)"""

RESPONSES = """responses AS (
    SELECT 'm' || (doc_id % 6) AS model,
           CASE WHEN toxic = 1 THEN NULL WHEN lang = 'es' THEN '  ' ELSE text END AS model_response,
           quality = 1 AS is_correct
    FROM documents JOIN labels USING (doc_id))"""

ACCURACY = f"""{RESPONSES}, accuracy AS (
    SELECT model, avg(CASE WHEN {strip("model_response")} <> '' THEN CAST(is_correct AS INTEGER) END) AS accuracy
    FROM responses GROUP BY model)"""

RESULTS = """results AS (
    SELECT CAST(label AS BIGINT) AS text_id, vec_id AS chunk_id, 'm' || j AS model,
           CASE WHEN j = 3 AND embedding[1] > 0.25 THEN []::FLOAT[]
                ELSE list_transform(embedding[10 * j + 1 : CASE WHEN j < 5 THEN 10 * j + 10 ELSE 64 END], lambda x: -abs(x)) END AS logprobs
    FROM embeddings, generate_series(0, 5) AS g(j))"""

PPL = f"""{RESULTS}, ppl AS (
    SELECT text_id, chunk_id, model,
           CASE WHEN len(logprobs) > 0 THEN exp(-list_sum(CAST(logprobs AS DOUBLE[])) / len(logprobs)) END AS ppl
    FROM results)"""


def ranks(source: str = "ppl") -> str:
    return f"""ranks AS (
    SELECT *, CASE WHEN ppl IS NOT NULL THEN
        rank() OVER (PARTITION BY text_id, chunk_id ORDER BY ppl NULLS LAST)
        + (count(*) OVER (PARTITION BY text_id, chunk_id, ppl) - 1) / 2.0 END AS ppl_rank
    FROM {source})"""


# gamma by its definition: the sum over ordered pairs of models
GAMMA_OF_RANKS = """gamma AS (
    SELECT k.text_id, k.chunk_id,
           CASE WHEN count(k.ppl_rank - l.ppl_rank) = count(*)
                THEN CAST(sum(sign(yk.accuracy - yl.accuracy) * (k.ppl_rank - l.ppl_rank)) AS DOUBLE) END AS gamma
    FROM ranks k JOIN ranks l ON k.text_id = l.text_id AND k.chunk_id = l.chunk_id AND k.model <> l.model
    JOIN accuracy yk ON yk.model = k.model JOIN accuracy yl ON yl.model = l.model
    GROUP BY k.text_id, k.chunk_id)"""

GAMMA = f"{PPL}, {ACCURACY}, {ranks()}, {GAMMA_OF_RANKS}"

# bigram: text_id, chunk_id, model, pos, lp over base
BIGRAM = f"""{BASE},
train_words AS (SELECT 'm' || (doc_id % 6) AS model, {words("text")} AS w FROM documents),
vocab AS (SELECT count(DISTINCT u) AS v FROM (SELECT unnest(w) AS u FROM train_words)),
train_pairs AS (
    SELECT model, w[i] AS a, w[i + 1] AS b
    FROM (SELECT model, w, unnest(generate_series(1, len(w) - 1)) AS i FROM train_words)),
pair_counts AS (SELECT model, a, b, count(*) AS c FROM train_pairs GROUP BY ALL),
start_counts AS (SELECT model, a, count(*) AS n FROM train_pairs GROUP BY ALL),
chunk_words AS (SELECT text_id, chunk_id, {words("chunk_text")} AS w FROM base),
chunk_pairs AS (
    SELECT text_id, chunk_id, i AS pos, w[i] AS a, w[i + 1] AS b
    FROM (SELECT text_id, chunk_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM chunk_words)),
names AS (SELECT 'm' || j AS model FROM generate_series(0, 5) AS g(j)),
bigram AS (
    SELECT p.text_id, p.chunk_id, n.model, p.pos,
           ln((coalesce(c.c, 0) + CAST(0.1 AS DOUBLE)) / (coalesce(s.n, 0) + CAST(0.1 AS DOUBLE) * (SELECT v FROM vocab))) AS lp
    FROM chunk_pairs p CROSS JOIN names n
    LEFT JOIN pair_counts c ON c.model = n.model AND c.a = p.a AND c.b = p.b
    LEFT JOIN start_counts s ON s.model = n.model AND s.a = p.a)"""

# One row per chunk × model, also for chunks with no scored word.
BIGRAM_LISTS = f"""{BIGRAM}, bigram_lists AS (
    SELECT b.text_id, b.chunk_id, n.model, coalesce(x.n_scored, 0) AS n_scored, x.lps
    FROM base b CROSS JOIN names n
    LEFT JOIN (SELECT text_id, chunk_id, model, count(*) AS n_scored, list(lp ORDER BY pos) AS lps
               FROM bigram GROUP BY ALL) x
    ON x.text_id = b.text_id AND x.chunk_id = b.chunk_id AND x.model = n.model)"""
