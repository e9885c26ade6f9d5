"""Queries over log-probs, perplexities, scores, selections, similarities and the regression."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from pplscope import scratch
from pplscope.bounded import pinned, small_side
from pplscope.checks import views as V
from pplscope.checks.registry import check
from pplscope.functions import arrays as A
from pplscope.operators import perplexity as P, regression as R, selection as S, similarity as sim, stats
from pplscope.operators.columns import nonblank_response
from pplscope.operators.scoring import WordLengthScorer, ngram_ppl, ngram_scorer, score_chunks
from pplscope.plans import jobs
from pplscope.sources.responses import scan_responses_csv

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BY_KEY = ["text_id", "chunk_id"]


def _total(values: str):
    return F.round(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double")), 6)


@check(f"""WITH s AS (SELECT doc_id AS id, list_filter(({V.words('text')})[2:], lambda t: length(t) <= 8) AS w FROM documents)
    SELECT id, CAST(len(w) AS INTEGER) AS n_scored,
           round(coalesce(list_sum(list_transform(w, lambda t: -length(t) / CAST(4 AS DOUBLE))), 0.0), 6) AS total FROM s""")
def first_logprobs(spark: SparkSession, d: str) -> DataFrame:
    raw = A.raw_from_json(F.col("raw"))
    scored = V.raw_scores(spark, d).select("id", A.extract_first_logprob(raw).alias("lp"))
    return scored.select("id", F.size("lp").alias("n_scored"), _total("lp").alias("total"))


@check(f"""WITH s AS (SELECT doc_id AS id, list_filter(({V.words('text')})[2:], lambda t: length(t) <= 8) AS w FROM documents)
    SELECT id, CAST(2 * len(w) AS INTEGER) AS n_scored,
           round(coalesce(list_sum(list_transform(w, lambda t: -9 - length(t) / CAST(4 AS DOUBLE))), 0.0), 6) AS total,
           md5(array_to_string(list_transform(w, lambda t: t || ' ALT'), ' ')) AS digest FROM s""")
def all_logprobs(spark: SparkSession, d: str) -> DataFrame:
    scored = V.raw_scores(spark, d).select("id", A.extract_all_logprobs(A.raw_from_json(F.col("raw"))).alias("x"))
    return scored.select(
        "id", F.size("x.prompt_logprobs").alias("n_scored"), _total("x.prompt_logprobs").alias("total"),
        F.md5(F.array_join("x.decoded_tokens", " ")).alias("digest"),
    )


@check(f"""WITH {V.BIGRAM_LISTS} SELECT text_id, chunk_id, model, CAST(n_scored AS INTEGER) AS n_scored,
    round(coalesce(list_sum(lps), 0.0), 6) AS total, round(lps[1], 6) AS first_lp, round(lps[-1], 6) AS last_lp FROM bigram_lists""")
def bigram_logprobs(spark: SparkSession, d: str) -> DataFrame:
    scored = ngram_scorer(V.training(spark, d), scratch.materialize(V.chunks(spark, d), "chunks", "zstd"), V.MODELS)
    return scored.select(
        *BY_KEY, "model", F.size("logprobs").alias("n_scored"), _total("logprobs").alias("total"),
        F.round(F.try_element_at("logprobs", F.lit(1)), 6).alias("first_lp"),
        F.round(F.try_element_at("logprobs", F.lit(-1)), 6).alias("last_lp"),
    )


@check(f"""WITH {V.BIGRAM_LISTS} SELECT text_id, chunk_id, model,
    CASE WHEN n_scored > 0 THEN round(-list_sum(lps) / n_scored, 4) END AS log_ppl FROM bigram_lists""")
def bigram_ppl(spark: SparkSession, d: str) -> DataFrame:
    ppl = ngram_ppl(V.training(spark, d), scratch.materialize(V.chunks(spark, d), "chunks", "zstd"), V.MODELS)
    return ppl.select(*BY_KEY, "model", F.round(F.ln("ppl"), 4).alias("log_ppl"))


@check(f"WITH {V.PPL} SELECT text_id, chunk_id, model, round(ppl, 6) AS ppl FROM ppl")
def chunk_ppl(spark: SparkSession, d: str) -> DataFrame:
    return V.perplexities(spark, d).withColumn("ppl", F.round("ppl", 6))


@check("""WITH p AS (SELECT CAST(label AS BIGINT) AS text_id, vec_id AS chunk_id,
        exp(-list_sum(list_transform(CAST(embedding[1:32] AS DOUBLE[]), lambda x: -abs(x))) / 32) AS a,
        CASE WHEN embedding[1] <= 0.25 THEN exp(-list_sum(list_transform(CAST(embedding[33:64] AS DOUBLE[]), lambda x: -abs(x))) / 32) END AS b
        FROM embeddings)
    SELECT text_id, chunk_id, round(CASE WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 6) AS ppl FROM p""")
def mean_ppl(spark: SparkSession, d: str) -> DataFrame:
    absent = F.array().cast("array<float>")
    two = V.embeddings(spark, d).select(
        *BY_KEY, F.transform(F.slice("embedding", 1, 32), lambda x: -F.abs(x)).alias("logprobs_a"),
        F.when(F.get("embedding", F.lit(0)) > 0.25, absent)
        .otherwise(F.transform(F.slice("embedding", 33, 32), lambda x: -F.abs(x))).alias("logprobs_b"),
    )
    mean = P.mean_ppl_over_columns(P.chunk_perplexity(two), ["logprobs_a", "logprobs_b"])
    return mean.withColumn("ppl", F.round("ppl", 6))


@check(f"WITH {V.PPL} SELECT text_id, chunk_id, " + ", ".join(
    f"round(max(ppl) FILTER (WHERE model = '{m}'), 6) AS {m}" for m in V.MODELS) + " FROM ppl GROUP BY text_id, chunk_id")
def ppl_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = P.ppl_wide(V.perplexities(spark, d), V.MODELS)
    return wide.select(*BY_KEY, *[F.round(m, 6).alias(m) for m in V.MODELS])


@check(f"WITH {V.RESPONSES} SELECT * FROM responses WHERE {V.strip('model_response')} <> ''")
def nonblank_responses(spark: SparkSession, d: str) -> DataFrame:
    return nonblank_response(V.responses(spark, d))


@check(f"WITH {V.ACCURACY} SELECT model, round(accuracy, 9) AS accuracy FROM accuracy")
def model_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return V.accuracies(spark, d).withColumn("accuracy", F.round("accuracy", 9))


@check(f"""WITH {V.RESPONSES} SELECT model, count(*) AS n, count(*) FILTER (WHERE {V.strip('model_response')} <> '') AS n_usable,
    CAST(sum(length(model_response)) AS BIGINT) AS n_chars, CAST(sum(CAST(is_correct AS INTEGER)) AS BIGINT) AS n_correct FROM responses GROUP BY model""")
def responses_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "responses")
    rows = V.responses(spark, d)
    for m in V.MODELS:
        (rows.where(F.col("model") == m).drop("model").write
         .options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
         .csv(f"{path}/{m}.csv"))
    read = scan_responses_csv(spark, [f"{path}/{m}.csv" for m in V.MODELS])
    return read.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.trim("model_response") != "").alias("n_usable"),
        F.sum(F.length("model_response")).alias("n_chars"),
        F.sum(F.col("is_correct").cast("int")).alias("n_correct"),
    )


@check(f"""WITH {V.RESPONSES} SELECT model, count(*) AS n, count(*) FILTER (WHERE {V.strip('model_response')} <> '') AS n_usable,
    CAST(sum(length(model_response)) AS BIGINT) AS n_chars,
    CAST(sum(CASE WHEN model NOT IN ('m2', 'm5') THEN CAST(is_correct AS INTEGER) END) AS BIGINT) AS n_correct FROM responses GROUP BY model""")
def responses_of_three_headers(spark: SparkSession, d: str) -> DataFrame:
    """Files with the columns in either order, and with one column only; the ones without answers have null there."""
    path = scratch.new_path(spark, "responses")
    headers = (["model_response", "is_correct"], ["is_correct", "model_response"], ["model_response"])
    rows = V.responses(spark, d)
    for j, m in enumerate(V.MODELS):
        (rows.where(F.col("model") == m).select(*headers[j % 3]).write
         .options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
         .csv(f"{path}/{m}.csv"))
    return scan_responses_csv(spark, [f"{path}/{m}.csv" for m in V.MODELS]).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.trim("model_response") != "").alias("n_usable"),
        F.sum(F.length("model_response")).alias("n_chars"),
        F.sum(F.col("is_correct").cast("int")).alias("n_correct"),
    )


@check(f"""WITH {V.PPL}, {V.ACCURACY} SELECT model, round(accuracy, 9) AS accuracy FROM accuracy
    WHERE model IN (SELECT model FROM ppl) AND accuracy IS NOT NULL""")
def common_models(spark: SparkSession, d: str) -> DataFrame:
    return P.common_models(V.perplexities(spark, d), V.accuracies(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


@check(f"""WITH {V.ACCURACY} SELECT k.model, CAST(sum(sign(k.accuracy - l.accuracy)) AS INTEGER) AS sign_sum
    FROM accuracy k, accuracy l GROUP BY k.model""")
def accuracy_signs(spark: SparkSession, d: str) -> DataFrame:
    return P.accuracy_sign_sums(V.accuracies(spark, d))


@check(f"WITH {V.PPL}, {V.ranks()} SELECT text_id, chunk_id, model, CAST(ppl_rank AS DOUBLE) AS ppl_rank FROM ranks")
def avg_ranks(spark: SparkSession, d: str) -> DataFrame:
    return P.average_rank(V.perplexities(spark, d)).drop("ppl")


@check(f"WITH {V.GAMMA} SELECT * FROM gamma")
def gamma(spark: SparkSession, d: str) -> DataFrame:
    return V.scores(spark, d)


@check(f"WITH {V.GAMMA} SELECT * FROM gamma")
def gamma_by_rank(spark: SparkSession, d: str) -> DataFrame:
    return P.gamma_by_rank(V.perplexities(spark, d), P.accuracy_sign_sums(V.accuracies(spark, d)))


BEST = "gamma DESC NULLS LAST, text_id, chunk_id"


@check(f"WITH {V.GAMMA} SELECT text_id, chunk_id, gamma, row_number() OVER (ORDER BY {BEST}) AS rank FROM gamma")
def gamma_curve(spark: SparkSession, d: str) -> DataFrame:
    return S.gamma_curve(V.scores(spark, d))


EMBEDDED_TEXTS = "texts AS (SELECT CAST(label AS BIGINT) AS text_id, vec_id AS chunk_id, ' vector ' || vec_id || ' ' AS chunk_text FROM embeddings)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit(" vector "), F.col("chunk_id").cast("string"), F.lit(" "))
    return V.embeddings(spark, d).select(*BY_KEY, name.alias("chunk_text"))


@check(f"""WITH {V.GAMMA}, {EMBEDDED_TEXTS}, top AS (SELECT *, row_number() OVER (ORDER BY {BEST}) AS rank FROM gamma)
    SELECT text_id, chunk_id, gamma, CAST(rank AS INTEGER) AS rank, chunk_text FROM top JOIN texts USING (text_id, chunk_id) WHERE rank <= 20""")
def top_gamma(spark: SparkSession, d: str) -> DataFrame:
    return S.lookup_texts(S.with_rank(S.top_gamma(V.scores(spark, d), 20)), _texts(spark, d))


@check(f"WITH {V.GAMMA} SELECT * FROM gamma ORDER BY gamma ASC NULLS LAST, text_id, chunk_id LIMIT 100")
def bottom_gamma(spark: SparkSession, d: str) -> DataFrame:
    return S.bottom_gamma(V.scores(spark, d), 100)


CONTROL = f"""{V.GAMMA}, top AS (SELECT * FROM gamma ORDER BY {BEST} LIMIT 100),
    control AS (SELECT * FROM gamma ANTI JOIN top USING (text_id, chunk_id)
                ORDER BY md5('7:' || text_id || ':' || chunk_id), text_id, chunk_id LIMIT 100)"""


@check(f"WITH {CONTROL} SELECT * FROM control")
def random_control(spark: SparkSession, d: str) -> DataFrame:
    scores = V.scores(spark, d)
    return S.random_control(scores, S.top_gamma(scores, 100), 100, seed=7)


@check(f"""WITH {V.GAMMA}, top AS (SELECT * FROM gamma ORDER BY {BEST} LIMIT 100)
    SELECT * FROM gamma ANTI JOIN top USING (text_id, chunk_id)""")
def complement(spark: SparkSession, d: str) -> DataFrame:
    scores = V.scores(spark, d)
    return S.complement(scores, S.top_gamma(scores, 100))


@check(f"""WITH {V.GAMMA}, {EMBEDDED_TEXTS}, top AS (SELECT *, row_number() OVER (ORDER BY {BEST}) AS rank FROM gamma)
    SELECT CAST(rank AS INTEGER) AS rank, '=== Chunk ' || chunk_id || ' ===' || chr(10) || trim(chunk_text) || chr(10) AS value
    FROM top JOIN texts USING (text_id, chunk_id) WHERE rank <= 20""")
def top_report(spark: SparkSession, d: str) -> DataFrame:
    found = S.lookup_texts(S.with_rank(S.top_gamma(V.scores(spark, d), 20)), _texts(spark, d))
    return S.top_chunk_report(found, label="chunk_id")


UNIT = """unit AS (
    SELECT CAST(label AS BIGINT) AS text_id, vec_id AS chunk_id,
           list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u
    FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""


def _sql_pairs(members: str) -> str:
    return f"""{UNIT}, members AS ({members}), vectors AS (SELECT m."set", u.* FROM members m JOIN unit u USING (text_id, chunk_id)),
    pairs AS (SELECT a."set", a.chunk_id AS id_i, b.chunk_id AS id_j,
        list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2])) AS cosine
        FROM vectors a JOIN vectors b ON a."set" = b."set" AND a.chunk_id < b.chunk_id)"""


def _sql_histogram(bins: int = 50) -> str:
    return f"""ranges AS (SELECT "set", min(cosine) AS lo, max(cosine) AS hi, count(*) AS total FROM pairs GROUP BY "set"),
    grid AS (SELECT "set", lo, hi, total, unnest(generate_series(1, {bins})) AS bin FROM ranges),
    counts AS (SELECT p."set", least(floor((cosine - lo) / (hi - lo) * {bins}.0::DOUBLE) + 1, {bins}) AS bin, count(*) AS n
               FROM pairs p JOIN ranges r ON r."set" = p."set" GROUP BY ALL),
    histogram AS (SELECT g."set", CAST(g.bin AS INTEGER) AS bin, round(lo + (hi - lo) * (g.bin - 1) / {bins}.0::DOUBLE, 6) AS lower,
        round(lo + (hi - lo) * g.bin / {bins}.0::DOUBLE, 6) AS upper, coalesce(c.n, 0) AS n,
        round(coalesce(c.n, 0) / (total * ((hi - lo) / {bins}.0::DOUBLE)), 6) AS density
        FROM grid g LEFT JOIN counts c ON c."set" = g."set" AND c.bin = g.bin)"""


TOP_ONLY = f"SELECT 'top' AS \"set\", text_id, chunk_id FROM gamma ORDER BY {BEST} LIMIT 100"


def _top_vectors(spark: SparkSession, d: str) -> DataFrame:
    top = small_side(S.top_gamma(V.scores(spark, d), 100).select(*BY_KEY))
    return pinned(V.embeddings(spark, d).join(top, BY_KEY))


@check(f"WITH {V.GAMMA}, {_sql_pairs(TOP_ONLY)} SELECT id_i, id_j, round(cosine, 6) AS cosine FROM pairs")
def pairwise_cosine(spark: SparkSession, d: str) -> DataFrame:
    return sim.pairwise_cosine(_top_vectors(spark, d), "chunk_id").withColumn("cosine", F.round("cosine", 6))


def _rounded(histogram: DataFrame) -> DataFrame:
    return histogram.withColumns({c: F.round(c, 6) for c in ("lower", "upper", "density")})


@check(f"""WITH {V.GAMMA}, {_sql_pairs(TOP_ONLY)}, {_sql_histogram()}
    SELECT bin, lower, upper, n, density FROM histogram""")
def similarity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.density_histogram(sim.pairwise_cosine(_top_vectors(spark, d), "chunk_id"), "cosine"))


ALL_PAIRS = """vectors AS (SELECT CASE WHEN chunk_id % 3 = 0 THEN 'third' ELSE 'rest' END AS "set", u.* FROM unit u),
    pairs AS (SELECT a."set", list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2])) AS cosine
        FROM vectors a JOIN vectors b ON a."set" = b."set" AND a.chunk_id < b.chunk_id)"""


@check(f"""WITH {UNIT}, {ALL_PAIRS}, {_sql_histogram()} SELECT "set", bin, lower, upper, n FROM histogram""")
def all_pairs_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The cosines of all pairs within two parts of all embeddings; only bins leave the tasks."""
    parts = V.embeddings(spark, d).withColumn("set", F.when(F.col("chunk_id") % 3 == 0, "third").otherwise("rest"))
    return _rounded(sim.cosine_histogram(parts, "chunk_id", by="set", block=100)).drop("density")


@check(f"""WITH {V.PPL}, pairs AS (SELECT model AS "set", ppl AS cosine FROM ppl WHERE ppl IS NOT NULL), {_sql_histogram(20)}
    SELECT "set" AS model, bin, lower, upper, n, density FROM histogram""")
def ppl_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.density_histogram(V.perplexities(spark, d), "ppl", 20, by="model"))


def _sql_compare(side: str, order: str) -> str:
    return f"""WITH {V.GAMMA}, chosen AS (SELECT * FROM gamma ORDER BY {order} LIMIT 100),
    control AS (SELECT * FROM gamma ANTI JOIN chosen USING (text_id, chunk_id)
                ORDER BY md5('7:' || text_id || ':' || chunk_id), text_id, chunk_id LIMIT 100),
    {_sql_pairs(f"SELECT '{side}' AS set, text_id, chunk_id FROM chosen UNION ALL SELECT 'random', text_id, chunk_id FROM control")},
    {_sql_histogram()} SELECT "set", bin, n, lower, upper, density FROM histogram""".replace(" AS set,", ' AS "set",')


def _compared(spark: SparkSession, d: str, side: str) -> DataFrame:
    return _rounded(sim.compare_sets(V.scores(spark, d), V.embeddings(spark, d), 100, 7, side))


@check(_sql_compare("top", BEST))
def compare_sets(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d, "top")


@check(_sql_compare("bottom", "gamma ASC NULLS LAST, text_id, chunk_id"))
def compare_sets_bottom(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d, "bottom")


class LetterEncoder:
    """Offline stand-in for an embedding model: how often each of a few letters occurs."""

    LETTERS = "etaoinsr"

    def encode(self, texts: Sequence[str]) -> list[list[float]]:
        return [[float(t.count(c)) for c in self.LETTERS] for t in texts]


@check(f"WITH {V.BASE} SELECT text_id, chunk_id, " + ", ".join(
    f"CAST(length(chunk_text) - length(replace(chunk_text, '{c}', '')) AS DOUBLE) AS n_{c}" for c in "etaoinsr") + " FROM base")
def embed_plugin(spark: SparkSession, d: str) -> DataFrame:
    vectors = sim.embed_texts(V.chunks(spark, d), LetterEncoder, BY_KEY)
    return vectors.select(
        *BY_KEY, *[F.get("embedding", F.lit(i)).cast("double").alias(f"n_{c}") for i, c in enumerate("etaoinsr")]
    )


LETTER_UNIT = "unit AS (SELECT text_id, chunk_id, list_transform(e, lambda x: coalesce(x / nullif(sqrt(list_sum(list_transform(e, lambda y: y * y))), 0), 0)) AS u " \
    "FROM (SELECT text_id, chunk_id, [" + ", ".join(
        f"CAST(length(chunk_text) - length(replace(chunk_text, '{c}', '')) AS DOUBLE)" for c in "etaoinsr") + "] AS e FROM texts))"


DOCUMENT_TEXTS = "texts AS (SELECT CAST(label AS BIGINT) AS text_id, vec_id AS chunk_id, text AS chunk_text FROM embeddings JOIN documents ON vec_id = doc_id)"


@check(_sql_compare("top", BEST).replace(UNIT, f"{DOCUMENT_TEXTS}, {LETTER_UNIT}"))
def compare_texts(spark: SparkSession, d: str) -> DataFrame:
    """The selected texts and their control, embedded by an encoder instead of ready vectors."""
    docs = V.documents(spark, d).select(F.col("id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    texts = V.embeddings(spark, d).select(*BY_KEY).join(docs, "chunk_id")
    return _rounded(sim.compare_texts(V.scores(spark, d), texts, LetterEncoder, 100, 7, "top"))


@check(f"""WITH {V.RESULTS} SELECT model, count(*) AS n_rows, CAST(sum(len(logprobs)) AS BIGINT) AS n_tokens
    FROM results GROUP BY model UNION ALL SELECT 'all', count(*), CAST(sum(len(logprobs)) AS BIGINT) FROM results""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    results = V.results(spark, d)
    per_model = results.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("logprobs").cast("long")).alias("n_tokens")
    )
    return per_model.unionByName(stats.run_summary(results).withColumn("model", F.lit("all")))


@check(f"""WITH {V.BASE}, s AS (SELECT text_id, chunk_id, {V.words('chunk_text')} AS w FROM base)
    SELECT text_id, chunk_id, m AS model,
           round(CASE WHEN len(w) > 1 THEN exp(list_sum(list_transform(w[2:], lambda t: length(t) / CAST(4 AS DOUBLE))) / (len(w) - 1)) END, 6) AS ppl
    FROM s, (VALUES ('first'), ('second')) v(m)""")
def union_slices(spark: SparkSession, d: str) -> DataFrame:
    """The same chunks scored twice, as if by two models, and put into one table."""
    chunks = scratch.materialize(V.chunks(spark, d), "chunks")
    parts = [
        P.results_to_ppl(score_chunks(chunks, WordLengthScorer).withColumn("model", F.lit(m)))
        for m in ("first", "second")
    ]
    return P.align_models(*parts).withColumn("ppl", F.round("ppl", 6))


@check(f"""WITH {V.PPL}, {V.ACCURACY} SELECT model, text_id, chunk_id, round(ppl, 6) AS value, round(accuracy, 9) AS label
    FROM ppl JOIN accuracy USING (model)""")
def design_matrix(spark: SparkSession, d: str) -> DataFrame:
    matrix = R.design_matrix(V.perplexities(spark, d), V.accuracies(spark, d))
    return matrix.withColumns({"value": F.round("value", 6), "label": F.round("label", 9)})


@check(f"WITH {V.GAMMA} SELECT * FROM gamma ORDER BY abs(gamma) DESC NULLS LAST, text_id, chunk_id LIMIT 50")
def screen_features(spark: SparkSession, d: str) -> DataFrame:
    return R.screen_features(V.scores(spark, d), 50)


COMPLETE = """complete AS (SELECT * FROM ppl SEMI JOIN (
    SELECT text_id, chunk_id FROM ppl GROUP BY ALL HAVING count(ppl) = 6) USING (text_id, chunk_id))"""


@check(f"""WITH {V.PPL}, {COMPLETE}, scales AS (
    SELECT f.model AS held_out, f.text_id, f.chunk_id, stddev_pop(o.ppl) AS s
    FROM complete f JOIN complete o ON o.text_id = f.text_id AND o.chunk_id = f.chunk_id AND o.model <> f.model GROUP BY ALL)
    SELECT CAST(substring(held_out, 2) AS INTEGER) AS fold, text_id, chunk_id, model,
           round(ppl / CASE WHEN s = 0 THEN 1 ELSE s END, 4) AS scaled, model = held_out AS is_test
    FROM complete JOIN scales USING (text_id, chunk_id)""")
def scaled_features(spark: SparkSession, d: str) -> DataFrame:
    scaled = R.scale_features(R.feature_rows(V.perplexities(spark, d), V.MODELS), V.MODELS)
    return scaled.withColumn("scaled", F.round("scaled", 4))


@check(f"""WITH {V.ACCURACY}, m AS (SELECT model, row_number() OVER (ORDER BY model) - 1 AS fold FROM accuracy)
    SELECT CAST(f.fold AS INTEGER) AS fold, m.model, m.model = f.model AS is_test FROM m, m AS f""")
def loo_folds(spark: SparkSession, d: str) -> DataFrame:
    return R.loo_folds(V.accuracies(spark, d))


def _fit(spark: SparkSession, d: str) -> R.LassoFit:
    scores = V.scores(spark, d)
    return R.loo_predictions(V.perplexities(spark, d), V.accuracies(spark, d), start=R.screen_features(scores, 100))


@check()
def loo_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d).predictions


@check()
def loo_metrics(spark: SparkSession, d: str) -> DataFrame:
    return R.loo_metrics(_fit(spark, d).predictions)


@check()
def nonzero_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return R.nonzero_coefficients(_fit(spark, d))


BIGRAM_GAMMA = f"""{V.BIGRAM_LISTS},
    bigram_ppl AS (SELECT text_id, chunk_id, model,
        CASE WHEN n_scored > 0 THEN round(exp(-list_sum(lps) / n_scored), 9) END AS ppl FROM bigram_lists),
    {V.ACCURACY}, {V.ranks("bigram_ppl")}, {V.GAMMA_OF_RANKS}"""


@check(f"""WITH {BIGRAM_GAMMA}, top AS (SELECT *, row_number() OVER (ORDER BY {BEST}) AS rank FROM gamma)
    SELECT CAST(rank AS INTEGER) AS rank, text_id, chunk_id, gamma, chunk_text
    FROM top JOIN base USING (text_id, chunk_id) WHERE rank <= 20""")
def top_quality_chunks(spark: SparkSession, d: str) -> DataFrame:
    return jobs.top_quality_chunks(V.documents(spark, d), V.responses(spark, d), V.training(spark, d), V.MODELS)
