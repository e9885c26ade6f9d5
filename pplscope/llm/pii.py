"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything is a native column expression over one row: no shuffle, no Python. A pattern's matches
come from `regexp_extract_all`, the text between them from `split` on the same pattern; their
lengths give each match's place in code points. All patterns are linear: quantifiers that cannot
give anything back are possessive, and look-behinds keep a match from being tried inside a run
that already failed.

`find_spans` returns each document's spans with their scores, `redact` its text with the spans
replaced by their kind. Null and empty texts have no spans. Rows are independent, so repeated rows
and ties repeat their result, and columns with other names are carried along by `redact` only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pplscope.llm.frames import by_place, whole_text

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"
CONTEXT, BEHIND = 48, 24
KEEP = 0.5
BLOCK = 256
#: No pattern has matches of under four characters, so as many neighbours cover CONTEXT.
NEIGHBOURS = CONTEXT // 4


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _letters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def luhn(value: Column) -> Column:
    """Every second digit from the right doubled, its digits summed; the total ends in 0."""
    def term(digit: Column, i: Column) -> Column:
        d = digit.cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    terms = F.transform(_letters(F.reverse(digits(value))), term)
    return F.aggregate(terms, F.lit(0), lambda total, t: total + t) % 10 == 0


def mod97(value: Column) -> Column:
    """The first four characters moved to the end, letters read as 10 to 35; the remainder is 1."""
    plain = F.regexp_replace(value, "[ ]", "")
    turned = _letters(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)))

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + letter) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def octets(value: Column) -> Column:
    return ~F.exists(F.split(value, r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. `guard`: a literal every match contains, or a pattern; `near`: words
    that raise the score by `lift` when they stand near a match."""

    name: str
    pattern: str
    guard: str
    valid: object
    score: float
    near: str
    lift: float
    base: bool = True


# The base patterns and their order; written so that each is linear with equal matches.
EMAIL_RUN = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{EMAIL_RUN})){EMAIL_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda v: F.lit(True),
         0.9, "e-?mail|contact|write|mailto", 0.1),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", octets, 0.6, r"\bip\b|address|host|server", 0.3),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", "[0-9][ -]?[0-9]", luhn,
         0.8, "card|visa|master|credit|pay", 0.2),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", lambda v: F.length(digits(v)).between(10, 15),
         0.7, "call|phone|tel|mobile|fax", 0.2),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", mod97,
         0.8, "iban|account|bank|transfer|konto", 0.2, base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]",
         lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, r"ssn|social|security|tax|\bid\b", 0.4, base=False),
)


def _starts(gaps: Column, hits: Column) -> Column:
    """Start of each hit: the lengths of all gaps up to it and all hits before it, summed in blocks so
    that a text with very many hits stays far from quadratic."""
    steps = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(h), F.lit(0)).alias("hit")))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda t, s: t + s.gap + s.hit)

    count = F.size(hits)
    before = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.floor((count - 1) / BLOCK).cast("int") - 1, F.lit(-1)), F.lit(1)),
        F.array(F.lit(0)),
        lambda sums, b: F.concat(sums, F.array(F.element_at(sums, -1) + total(F.slice(steps, b * BLOCK + 1, BLOCK)))),
    )
    one_block = F.transform(
        hits, lambda h, i: total(F.slice(steps, F.lit(1), i)) + F.element_at(steps, i + 1).gap
    )
    many = F.transform(
        hits,
        lambda h, i: F.element_at(before, F.floor(i / BLOCK).cast("int") + 1)
        + total(F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
        + F.element_at(steps, i + 1).gap,
    )
    return F.when(count <= BLOCK, one_block).otherwise(many)


def _present(text: Column, guard: str) -> Column:
    return F.contains(text, F.lit(guard)) if len(guard) == 1 else text.rlike(guard)


def _with_matches(rows: DataFrame, kinds) -> DataFrame:
    """Per kind: its matches and, where there are any, the text between them."""
    rows = rows.withColumns({
        f"_hits_{k.name}": F.when(_present(F.col("_text"), k.guard), F.regexp_extract_all("_text", F.lit(k.pattern), F.lit(0)))
        for k in kinds
    })
    return rows.withColumns({
        f"_gaps_{k.name}": F.when(F.size(f"_hits_{k.name}") > 0, F.split("_text", k.pattern, -1)) for k in kinds
    })


def _around(gaps: Column, hits: Column, i: Column) -> Column:
    """The text around a match, across other matches: CONTEXT characters before its start, a line end in its
    place, and BEHIND characters after its end. Put together from its neighbours, however long the text."""

    def piece(k: Column) -> Column:
        return F.get(gaps, k)

    before = F.transform(
        F.sequence(F.greatest(i - NEIGHBOURS, F.lit(0)), i),
        lambda k: F.concat(F.right(piece(k), F.lit(CONTEXT)), F.when(k < i, F.get(hits, k)).otherwise("")),
    )
    after = F.transform(
        F.sequence(i + 1, F.least(i + 1 + NEIGHBOURS, F.size(hits))),
        lambda k: F.concat(F.left(piece(k), F.lit(BEHIND)), F.coalesce(F.get(hits, k), F.lit(""))),
    )
    return F.concat(
        F.right(F.array_join(before, ""), F.lit(CONTEXT)), F.lit("\n"), F.left(F.array_join(after, ""), F.lit(BEHIND))
    )


def _context(gaps: Column, hits: Column, i: Column, across: bool) -> Column:
    return _around(gaps, hits, i) if across else F.right(F.get(gaps, i), F.lit(CONTEXT))


def _score(kind: Kind, context: Column) -> Column:
    near = F.lower(context).rlike(kind.near)
    return F.round(F.lit(kind.score) + F.when(near, kind.lift).otherwise(0.0), 3)


def _kept(kind: Kind, value: Column, context: Column) -> Column:
    """Base kinds stay when valid; the others need a score as well."""
    valid = kind.valid(value)
    return valid if kind.base else valid & (_score(kind, context) >= KEEP)


def _spans(rank: int, kind: Kind, across: bool) -> Column:
    """The confirmed spans of one kind, from its matches and their places."""
    hits, gaps, at = (F.col(f"_{part}_{kind.name}") for part in ("hits", "gaps", "at"))

    def span(hit: Column, i: Column) -> Column:
        start, context = F.element_at(at, i + 1), _context(gaps, hits, i, across)
        fields = {
            "start": start, "rank": F.lit(rank), "end": start + F.length(hit), "kind": F.lit(kind.name), "score": _score(kind, context)
        }
        return F.when(_kept(kind, hit, context), F.struct(*[c.alias(n) for n, c in fields.items()]))

    spans = F.filter(F.transform(hits, span), lambda s: s.isNotNull())
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(SPAN))


def _replaced(kind: Kind, across: bool) -> Column:
    """The text put together again, confirmed matches as `<KIND>`."""
    hits, gaps = F.col(f"_hits_{kind.name}"), F.col(f"_gaps_{kind.name}")

    def part(gap: Column, i: Column) -> Column:
        hit = F.get(hits, i)
        shown = F.when(_kept(kind, hit, _context(gaps, hits, i, across)), f"<{kind.name.upper()}>").otherwise(hit)
        return F.concat(gap, F.when(i < F.size(hits), shown).otherwise(""))

    return F.array_join(F.transform(gaps, part), "")


def find_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", kinds=KINDS,
               across: bool = False) -> DataFrame:
    """(doc_id, spans): spans in code points, end exclusive, by start and then kind as listed.

    The context is what stands between a match and the one of its kind before it, or with `across`
    (as in op6 and in `redact`) the text on both sides, other matches or not."""
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("_text"))
    rows = _with_matches(rows, kinds).drop("_text")
    rows = rows.withColumns({
        f"_at_{k.name}": F.when(F.size(f"_hits_{k.name}") > 0, _starts(F.col(f"_gaps_{k.name}"), F.col(f"_hits_{k.name}")))
        for k in kinds
    })
    found = [_spans(rank, k, across) for rank, k in enumerate(kinds)]
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def redact(docs: DataFrame, text_column: str = "text", kinds=KINDS, across: bool = True) -> DataFrame:
    """The same columns, the text's spans replaced by `<KIND>`; null texts stay null.

    Kind by kind, each on the text the one before left, so that what two kinds share goes with the
    first. A kind's matches that are not confirmed stay as they are.
    """
    rows, (text,) = by_place(docs, text_column)
    rows = rows.withColumn("_text", F.col(text).cast("string"))
    order = sorted(kinds, key=lambda k: ("email", "iban", "card", "phone", "ssn", "ip").index(k.name))
    for k in order:
        rows = _with_matches(rows, [k])
        rows = rows.withColumn("_text", F.when(F.size(f"_hits_{k.name}") > 0, _replaced(k, across)).otherwise(F.col("_text")))
        rows = rows.drop(f"_hits_{k.name}", f"_gaps_{k.name}")
    return rows.withColumn(text, F.col("_text")).drop("_text").toDF(*docs.columns)
