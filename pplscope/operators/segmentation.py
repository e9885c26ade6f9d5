"""Sentence borders by what the corpus itself shows: abbreviations, sentence starters and collocations.

Nothing is labelled. A word type is an abbreviation when a full stop follows it far more often than
chance and it is short; a capitalised word starts sentences when it follows sure sentence ends more
often than chance and is written small elsewhere; a number or an initial belongs with the next word
when the two meet more often than chance. All three are log-likelihood ratios of counts (Kiss and
Strunk, 2006), found by three combining aggregates over the tokens. A learned table that is small becomes
part of a native expression, so cutting is row-local like the plain rule; of a larger one each text gets
what it asks for by a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pplscope.bounded import lookup_with_hot_keys
from pplscope.functions import text as T
from pplscope.scratch import materialize

# Significance levels of the published method.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
MAX_ENTRIES = 20_000

KINDS = ("abbreviation", "starter", "collocation")
CLOSERS = r"""["')\]}]"""
END = rf"[.!?]{CLOSERS}*$"
NUMBER = r"^[0-9]+([.,:-][0-9]+)*$"


@dataclass(frozen=True)
class Segmenter:
    """What was learned: types of abbreviations (no final stop), of sentence starters, and pairs `first second`.
    A kind with more entries than an expression takes is None, and `table` (`what, entry`) has them."""

    abbreviations: tuple[str, ...] | None = ()
    starters: tuple[str, ...] | None = ()
    collocations: tuple[str, ...] | None = ()
    table: DataFrame | None = None


def bare(token: Column) -> Column:
    """A token without quotes and brackets around it, or a comma behind."""
    return F.regexp_replace(token, rf"""^["'(\[{{]+|{CLOSERS[:-1]},;:]+$""", "")


def stopped(base: Column) -> Column:
    """Does a bare token end in one full stop?"""
    return base.rlike(r"[^.]\.$")


def word_type(base: Column) -> Column:
    """The bare token in small letters, without the marks at its end."""
    return F.lower(F.regexp_replace(base, r"(\.|[.!?]{2,}|[!?])$", ""))


def tokens(clean: Column) -> Column:
    """Tokens of a cleaned text, each with the blanks behind it."""
    return F.regexp_extract_all(clean, F.lit("[^ ]+ *"), F.lit(0))


def _is_in(value: Column, entries: tuple[str, ...] | None, what: str = "", found: Column | None = None) -> Column:
    """Is a value among the entries, or where these are in a table, among those `found` for its text?"""
    if entries is None:
        return F.array_contains(found, F.concat(F.lit(f"{what} "), value))
    return value.isin(*entries) if entries else F.lit(False)


def _class(kind: Column) -> Column:
    """What collocations are learned for: numbers alike, each initial of its own; null for other words."""
    return F.when(kind.rlike(NUMBER), F.lit("##")).when(kind.rlike(r"^\p{L}$"), kind)


def pairs(df: DataFrame, text_col: str) -> DataFrame:
    """Each kind of token beside the one before it, once, with its number `n`: base, kind (its type), prev
    (bare token before it; null at a text's start). Types are looked for in these rows, not in every token."""
    cleaned = df.select(T.clean_text(F.col(text_col)).alias("c")).select(
        F.transform(tokens(F.col("c")), lambda t: bare(F.rtrim(t))).alias("t")
    )
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), F.col("t")), F.lit(1), F.size("t"))
    rows = cleaned.select(F.explode(F.arrays_zip(F.col("t").alias("base"), before.alias("prev"))).alias("p"))
    met = materialize(rows.groupBy("p.base", "p.prev").agg(F.count("*").alias("n")), "token-pairs")
    return met.select("base", "prev", "n", word_type(F.col("base")).alias("kind"))


def _number(condition: Column) -> Column:
    """How many tokens of rows with their number `n` a condition holds for."""
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def _xlog(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio of two events of counts `a` and `b`, together `ab`, among `n`; null unless they
    meet more often than by chance."""
    a, b, ab, n = (c.cast("double") for c in (a, b, ab, n))
    p, p1, p2 = b / n, ab / a, F.when(n > a, (b - ab) / (n - a))
    null = _xlog(b, p) + _xlog(n - b, 1 - p)
    fits = _xlog(ab, p1) + _xlog(a - ab, 1 - p1) + _xlog(b - ab, p2) + _xlog(n - a - b + ab, 1 - p2)
    return F.when((ab / a > b / n) & p2.isNotNull(), 2 * (fits - null))


def abbreviation_scores(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, stops, plain, score) of every word type that a full stop follows somewhere."""
    return _abbreviation_scores(pairs(df, text_col))


def _abbreviation_scores(met: DataFrame) -> DataFrame:
    rows = met.select("kind", "n", stopped(F.col("base")).alias("stop"))
    counts = materialize(
        rows.groupBy("kind").agg(_number(F.col("stop")).alias("stops"), _number(~F.col("stop")).alias("plain")), "word-types"
    )
    n, with_stop = counts.agg(F.sum(F.col("stops") + F.col("plain")), F.sum("stops")).first()
    if not with_stop or with_stop == n:
        return counts.where("false").select("kind", "stops", "plain", F.lit(0.0).alias("score"))
    chance, sure = F.lit(with_stop / n), F.lit(0.99)
    stops, plain = F.col("stops"), F.col("plain")
    gain = 2 * (stops * (F.ln(sure) - F.ln(chance)) + plain * (F.ln(1 - sure) - F.ln(1 - chance)))
    inner = F.length("kind") - F.length(F.replace("kind", F.lit("."), F.lit("")))
    size = (F.length("kind") - inner).cast("double")
    score = gain * F.exp(-size) * (inner + 1) * F.pow(size, -plain.cast("double"))
    letters = F.col("kind").rlike(r"\p{L}") & ~F.col("kind").rlike("[0-9]")
    return counts.where((F.col("stops") > 0) & letters).select("kind", "stops", "plain", score.alias("score"))


def learn_table(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(what, entry, n, score) of all that is significant: abbreviation, starter or collocation."""
    seen = pairs(df, text_col)
    found = _abbreviation_scores(seen).where(F.col("score") >= ABBREVIATION)
    short = materialize(found.select(
        F.lit("abbreviation").alias("what"), F.col("kind").alias("entry"), F.col("stops").alias("n"), "score"), "abbreviations")
    known = _few(short)
    rows = seen.where(F.col("prev").isNotNull())
    prev_kind = word_type(F.col("prev"))
    stop, group = stopped(F.col("prev")), _class(prev_kind)
    if known is None:
        # Looked up by the token before; the weight counts the rows of each.
        before = rows.groupBy("prev").agg(F.count("*").alias("uses")).withColumn("prev_kind", prev_kind)
        entries = short.select(F.col("entry").alias("prev_kind"), F.lit(True).alias("short"))
        before = materialize(before.join(entries, "prev_kind", "left").select("prev", "uses", "short"), "abbreviated")
        rows = lookup_with_hot_keys(rows, before, ["prev"], "uses", spread=F.struct("base", "prev"))
        is_short = F.coalesce(F.col("short"), F.lit(False))
    else:
        is_short = _is_in(prev_kind, known)
    sure = F.col("prev").rlike("[!?]$") | (stop & ~is_short & group.isNull())
    upper, lower = F.col("base").rlike(r"^\p{Lu}"), F.col("base").rlike(r"^\p{Ll}")
    counted = materialize(
        rows.select("kind", "n", sure.alias("sure"), F.when(stop, group).alias("group"), lower.alias("small"),
                    (upper & ~F.col("prev").rlike("[.!?]$")).alias("large"))
        .groupBy("kind", "group")
        .agg(F.sum("n").alias("n"), *[_number(F.col(c)).alias(a) for c, a in (("sure", "after"), ("small", "small"), ("large", "large"))]),
        "starts",
    )
    n, ends = counted.agg(F.sum("n"), F.sum("after")).first()
    n, ends = n or 0, ends or 0
    types = counted.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("n", "after", "small", "large")]).where(F.col("kind").rlike(r"^\p{L}"))
    starts = types.where((F.col("after") > 0) & (F.col("small") > F.col("large"))).select(
        F.lit("starter").alias("what"), F.col("kind").alias("entry"), F.col("after").alias("n"),
        ratio(F.lit(ends), F.col("n"), F.col("after"), F.lit(n)).alias("score"),
    ).where(F.col("score") >= STARTER)
    starts = materialize(starts, "starters")
    groups = counted.where(F.col("group").isNotNull()).groupBy("group").agg(F.sum("n").alias("a"))
    met = counted.where(F.col("group").isNotNull() & (F.col("n") > 1)).select("group", "kind", F.col("n").alias("ab"))
    together = (
        met.join(F.broadcast(groups), "group").join(types.select("kind", F.col("n").alias("b")), "kind")
        .join(starts.select(F.col("entry").alias("kind")), "kind", "left_anti")
        .select(F.lit("collocation").alias("what"), F.concat_ws(" ", "group", "kind").alias("entry"), F.col("ab").alias("n"),
                ratio(F.col("a"), F.col("b"), F.col("ab"), F.lit(n)).alias("score"))
        .where(F.col("score") >= COLLOCATION)
    )
    return short.unionByName(starts).unionByName(together)


def _entries(table: DataFrame) -> tuple[str, ...]:
    """The entries, sorted; a table too large for an expression is an error, not cut."""
    found = table.select("entry").limit(MAX_ENTRIES + 1).collect()
    if len(found) > MAX_ENTRIES:
        raise ValueError(f"over {MAX_ENTRIES} entries: the texts don't look like sentences of a few languages; learn on fewer kinds of text")
    return tuple(sorted(r.entry for r in found))


def _few(table: DataFrame) -> tuple[str, ...] | None:
    """The entries, or None where they are too many for an expression."""
    try:
        return _entries(table)
    except ValueError:
        return None


def segmenter(learned: DataFrame) -> Segmenter:
    """The learned table (a written one) as constants of an expression, but for the kinds that are too large for that."""
    kinds = {k: _few(learned.where(F.col("what") == k)) for k in KINDS}
    large = [k for k in KINDS if kinds[k] is None]
    return Segmenter(*kinds.values(), learned.where(F.col("what").isin(*large)).select("what", "entry") if large else None)


def learn(df: DataFrame, text_col: str = "text") -> Segmenter:
    """Learn from all texts of a column."""
    return segmenter(materialize(learn_table(df, text_col), "segmenter"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _next_to(token: Column, following: Column) -> Column:
    """What the rules look at: the bare token and the one behind it, and the types of both."""
    both = F.struct(bare(F.rtrim(token)).alias("base"), bare(F.rtrim(following)).alias("after"))
    return _let(both, lambda p: F.struct(
        p["base"].alias("base"), p["after"].alias("after"), word_type(p["base"]).alias("kind"), word_type(p["after"]).alias("next")))


def breaks_after(token: Column, following: Column, model: Segmenter, found: Column | None = None) -> Column:
    """Does a sentence end with this token? `following` is the next one; `found` has what the model's table has
    of what the text asks for."""

    def at_end(p: Column) -> Column:
        known = F.struct(p["base"].alias("base"), p["after"].alias("after"), word_type(p["base"]).alias("kind"), word_type(p["after"]).alias("next"))
        return F.when(p["base"].rlike("[!?]$"), F.lit(True)).otherwise(_let(known, at_stop))

    def at_stop(q: Column) -> Column:
        upper, lower = q["after"].rlike(r"^\p{Lu}"), q["after"].rlike(r"^\p{Ll}")
        apart = ~_is_in(F.concat_ws(" ", _class(q["kind"]), q["next"]), model.collocations, "collocation", found)
        short = _is_in(q["kind"], model.abbreviations, "abbreviation", found) | q["kind"].rlike(r"^\p{L}$")
        return (
            F.when(q["base"].rlike(r"\.\.$"), upper)
            .when(q["kind"].rlike(NUMBER), ~lower & apart)
            .when(short, upper & _is_in(q["next"], model.starters, "starter", found) & apart)
            .otherwise(F.lit(True))
        )

    both = F.struct(bare(F.rtrim(token)).alias("base"), bare(F.rtrim(following)).alias("after"))
    return F.when(following.isNull() | ~F.rtrim(token).rlike(END), F.lit(False)).otherwise(_let(both, at_end))


def _beside(token_array: Column) -> Column:
    """Each token next to the one behind it."""
    following = F.slice(token_array, F.lit(2), F.greatest(F.size(token_array) - 1, F.lit(0)))
    return F.arrays_zip(token_array.alias("token"), following.alias("following"))


def mark(token_array: Column, model: Segmenter, found: Column | None = None) -> Column:
    """The text of the tokens, BREAK in place of the blanks between its sentences. Each token is looked at
    next to the one behind it, never by its place, so time is linear however the expression is planned."""
    marked = F.transform(_beside(token_array), lambda p: F.when(
        breaks_after(p["token"], p["following"], model, found), F.concat(F.rtrim(p["token"]), F.lit(T.BREAK))
    ).otherwise(p["token"]))
    return F.array_join(marked, "")


def _asked(token_array: Column, model: Segmenter) -> Column:
    """What the rules may ask the model's table about a text: `what entry`, each once."""
    stops = F.filter(_beside(token_array), lambda p: p["following"].isNotNull() & F.rtrim(p["token"]).rlike(END))

    def entries(q: Column) -> Column:
        short = q["kind"].rlike(r"^\p{L}$")
        short = F.lit(True) if model.abbreviations is None else short | _is_in(q["kind"], model.abbreviations)
        may = {
            "abbreviation": (F.lit(True), q["kind"]), "starter": (short, q["next"]),
            "collocation": (short | q["kind"].rlike(NUMBER), F.concat_ws(" ", _class(q["kind"]), q["next"])),
        }
        large = [k for k, kept in zip(KINDS, (model.abbreviations, model.starters, model.collocations)) if kept is None]
        return F.array_compact(F.array(*[F.when(may[k][0], F.concat(F.lit(f"{k} "), may[k][1])) for k in large]))

    return F.array_distinct(F.flatten(F.transform(stops, lambda p: _let(_next_to(p["token"], p["following"]), entries))))


def _answers(cut: DataFrame, model: Segmenter) -> DataFrame:
    """`_place, _found`: what the model's table has of what each text asks for. The most frequent questions are
    answered by broadcast."""
    asked = materialize(cut.select("_place", F.explode(_asked(F.col("_tokens"), model)).alias("_entry")), "asked", "zstd")
    table = model.table.select(F.concat_ws(" ", "what", "entry").alias("_entry"), F.lit(True).alias("_has")).distinct()
    uses = materialize(asked.groupBy("_entry").agg(F.count("*").alias("_uses")).join(table, "_entry", "left"), "questions")
    answered = lookup_with_hot_keys(asked, uses, ["_entry"], "_uses", spread=F.col("_place"))
    return answered.where("_has").groupBy("_place").agg(F.collect_list("_entry").alias("_found"))


def split_learned(df: DataFrame, model: Segmenter, text_col: str = "text", name: str = "sentences") -> DataFrame:
    """`df` with the sentences of each text, cleaned, as an array."""
    return _with_pieces(df, text_col, name, model, lambda marked: F.array_remove(F.split(marked, T.BREAK), ""))


def pack_learned(df: DataFrame, model: Segmenter, chunk_size: int = 500, text_col: str = "text", name: str = "chunks") -> DataFrame:
    """`df` with the chunks of each text: its sentences, packed as `functions.text` does."""
    return _with_pieces(df, text_col, name, model, lambda marked: T.pack_marked(marked, chunk_size))


def _with_pieces(df: DataFrame, text_col: str, name: str, model: Segmenter, pieces: Callable[[Column], Column]) -> DataFrame:
    """The text's own mark characters are hidden before it is cut and come back in the pieces."""
    marks = F.lit(T.KEEP + T.BREAK)

    def with_tokens(rows: DataFrame) -> DataFrame:
        hidden = rows.withColumn("_clean", T.clean_text(F.col(text_col))).withColumn("_stand", T.stand_ins(F.col("_clean")))
        return hidden.withColumn("_tokens", tokens(T.swap(F.col("_clean"), marks, F.col("_stand"))))

    rows, found = df, None
    if model.table is not None:
        # Rows are numbered to meet their answers, and written so that the numbers stay; tokens don't move.
        rows = materialize(df.withColumn("_place", F.monotonically_increasing_id()), "numbered", "zstd")
        rows = rows.join(_answers(with_tokens(rows).select("_place", "_tokens"), model), "_place", "left")
        found = F.coalesce("_found", F.array().cast("array<string>"))
    cut = with_tokens(rows).withColumn("_pieces", pieces(mark(F.col("_tokens"), model, found)))
    back = F.transform("_pieces", lambda p: T.swap(p, F.col("_stand"), marks))
    shown = F.when(F.col("_clean").rlike(f"[{T.KEEP}{T.BREAK}]"), back).otherwise(F.col("_pieces"))
    return cut.select(*[c for c in df.columns if c != name], shown.alias(name))
