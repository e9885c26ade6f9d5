"""Spans against the plain patterns in Python's re, edge cases, and redaction."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from pplscope.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


FIXED = [
    None, "", "a@b.c@d.e", "a@b.cd+e@f.g h@@i.j", "1.2.3.4.5.6.7.8 999.1.2.3.4 001.002.3.255", "4111 1111 1111 1111",
    "4111-1111-1111-1111 x 41111111111111111111111", "+49 (30) 123456-78) +1", "é😀 mail ü@x.yz z@x.yz", "+1 4111111111111111",
    "x" * 50_000 + "@a.b", "1" * 50_000, "1 " * 20_000, "+1" + " " * 30_000 + "2", ".a@b" * 3_000, "card 4111111111111111 " * 700,
    "IBAN GB82 WEST 1234 5698 7654 32. and DE89370400440532013000, DE89370400440532013001", "ssn 123-45-6789, 123-45-6789 xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 123-45-6789",
]


def random_texts(n: int) -> list[str]:
    r = random.Random(6)
    parts = ["a", "@", ".", "b-", "+", "1", "22", "255", "256", " ", "-", "(", ")", "4111111111111111", "é", "\n", "%", "_", "10.0.0.1"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_base_spans_equal_the_plain_patterns(spark):
    texts = FIXED + random_texts(1500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in pii.find_spans(df).collect():
        text = texts[row.doc_id] or ""
        got = [(s.start, s.end, s.kind) for s in row.spans if s.kind in PATTERNS]
        assert got == base_spans(text), text[:200]


def test_added_kinds_and_context(spark):
    df = spark.createDataFrame([(1, FIXED[-2]), (2, FIXED[-1])], "doc_id long, text string")
    rows = {r.doc_id: [(s.kind, s.start, s.end, s.score) for s in r.spans] for r in pii.find_spans(df).collect()}
    ibans = [x for x in rows[1] if x[0] == "iban"]
    assert [FIXED[-2][s:e] for _, s, e, _ in ibans] == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
    assert ibans[0][3] == 1.0 and all(x[3] >= pii.KEEP for x in ibans)
    assert [x[1] for x in rows[2] if x[0] == "ssn"] == [4]  # nothing between the later ones and the match before them speaks for them


def test_context_reaches_across_matches_and_behind(spark):
    numbers = [f"{100 + k}-45-{6789 + k}" for k in range(6)]
    texts = ["SSN: 123-45-6789, 234-56-7890", "SSN " + ", ".join(numbers), "123-45-6789 (SSN)", "123-45-6789 and 234-56-7890 are numbers",
             "ssn " + "x" * 60 + " 123-45-6789", "123-45-6789 " + "x" * 30 + " ssn", "ssn 000-45-6789, 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "ssn"] for r in pii.find_spans(df, across=True).collect()}
    want = {}
    for i, text in enumerate(texts):
        hits = [m for m in re.finditer(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", text) if not m[0].startswith("000")]
        want[i] = [m[0] for m in hits if "ssn" in f"{text[max(0, m.start() - 48) : m.start()]}|{text[m.end() : m.end() + 24]}".lower()]
    assert found == want and len(want[0]) == 2 and len(want[1]) >= 4 and len(want[2]) == 1 and not want[3]
    redacted = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert redacted[0] == "SSN: <SSN>, <SSN>" and all(redacted[i].count("<SSN>") == len(want[i]) for i in want)


def test_redact_keeps_columns_and_hides_values(spark):
    df = spark.createDataFrame(
        [(1, "mail a@b.cd now, card 4111 1111 1111 1111", "x"), (2, None, "y"), (3, "plain 1.2.3", "z")],
        "doc_id long, text string, spans string",
    )
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[1].text == "mail <EMAIL> now, card <CARD>" and out[1].spans == "x"
    assert out[2].text is None and out[3].text == "plain 1.2.3"
    assert pii.redact(df).columns == df.columns


def test_plan_is_native_and_unshuffled(spark, small):
    plan = queries.QUERIES["op6_pii"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_pii"](spark, small).collect():
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for *_, k in spans) for n in PATTERNS]


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, "a@b.c"), (None, "a@b.c")]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.find_spans(df).count() == len(rows)
