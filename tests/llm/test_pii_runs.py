"""Valid cards and phone numbers beside other numbers are found."""

import random

import pytest

from wavemill.llm import pii

CARD, PLAIN, PHONE = "4111 1111 1111 1111", "4111111111111111", "+49 170 12345678"


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.pseudonymise(docs, key="k").collect()}


@pytest.fixture(scope="module")
def alone(spark):
    return {x: r["text"] for x, r in zip((CARD, PLAIN, PHONE), run(spark, [CARD, PLAIN, PHONE]).values())}


CASES = [
    (f"{CARD} 12/25", CARD, ["card"]), (f"{PLAIN} 123", PLAIN, ["card"]), (f"12 {PLAIN}", PLAIN, ["card"]), (f"{PHONE} 2023", PHONE, ["phone"]),
    (f"12 25 {CARD} 123 7", CARD, ["card"]), (f"{CARD} 12 25 123", CARD, ["card"]), (f"12-{PLAIN}", PLAIN, ["card"]), (f"{PLAIN}-123.", PLAIN, ["card"]),
    (f"ID12 {CARD} x", CARD, ["card"]), (f"({PLAIN} 12)", PLAIN, ["card"]), (f"call {PHONE} 2023 99", PHONE, ["phone"]), (f"{' 7' * 60} {CARD} {'8 ' * 60}", CARD, None),
]


def test_beside_short_numbers(spark, alone):
    got = run(spark, [t for t, _, _ in CASES])
    for k, (text, value, kinds) in enumerate(CASES):
        assert kinds is None or (got[k]["kinds"] == kinds and got[k]["text"] == text.replace(value, alone[value])), text
        assert value not in got[k]["text"] and alone[value] != value


def test_several_kinds_in_one_run(spark, alone):
    text = f"{PHONE} {CARD} 2020-02-29 123-45-6789 {PLAIN} 10.0.0.1 GB82 WEST 1234 5698 7654 32 {CARD}"
    got = run(spark, [text, f"1-{CARD}.5 v.{PLAIN} a{PLAIN} {PLAIN}b 1234.5@x.com 555 12.me@x.com 2020-13-01"])
    assert got[0]["kinds"] == ["phone", "card", "date", "ssn", "card", "ip", "iban", "card"]
    assert got[0]["text"].startswith(f"{alone[PHONE]} {alone[CARD]} ") and alone[PLAIN] in got[0]["text"] and got[0]["text"].endswith(alone[CARD])
    assert got[1]["kinds"] == ["email", "email"] and got[1]["text"].startswith(f"1-{CARD}.5 v.{PLAIN} a{PLAIN} {PLAIN}b ") and got[1]["text"].endswith(" 2020-13-01")


def test_nothing_but_values_changes(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["12", "4", "1234", " ", "-", ".", "(", ")", "/", "+", " x ", "\n"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    for r in run(spark, texts).values():
        old = texts[r["doc_id"]]
        assert len(r["text"]) == len(old) and (r["kinds"] or r["text"] == old)
        assert all(a == b or (a.isdigit() and b.isdigit()) for a, b in zip(old, r["text"]))
