"""Error rates compare whole normalised texts, wakeword_sim all that is heard; against brute force."""

import difflib
import random

import pytest

from pyspark.sql import functions as F

from wavemill import queries as Q
from wavemill.functions import text as X
from wavemill.operators import sampling
from wavemill.sources import manifests

SAME = "ab cd, " * 30  # over 60 letters
TALK = [(1, 0, "user", SAME + "Ende é"), (1, 1, "assistant", SAME + "anders"), (1, 2, "user", SAME + "ＡＮＤＥＲＳ!"), (1, 3, None, None), (1, 4, "user", ""), (1, 5, "system", "éé"), (5, 0, "user", "Café ÉÑ"), (5, 1, "assistant", "Cafe en"), (5, 2, "user", "café éñ")]
TALK += [(3, 0, "user", SAME), (3, 1, "assistant", SAME[:100]), (3, 2, "user", "x"), (7, 0, "user", "Computer" + " xyz" * 20 + "mputer"), (7, 1, "user", "Hey Mill" + "o" * 50 + "hey mil")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def edits(a, b):
    return X._distance(a, b)


def pairs():
    n = {(c, i): (r, X.normalise(x)) for c, i, r, x in TALK}
    return [((c, i), r, a, n[c, i + 1][1]) for (c, i), (r, a) in n.items() if (c, i + 1) in n]


def one(spark, sf, name):
    return Q.QUERIES[name](spark, sf).collect()[0]


def test_rows(spark, sf):
    got = {(r["conv_id"], r["turn"]): (r["cer"], r["sim"]) for r in Q.QUERIES["cer_rows"](spark, sf).collect()}
    want = {}
    for i, _, a, b in pairs():
        cer = edits(a, b) / len(a) if a else float(bool(b))
        want[i] = (round(cer, 6), round(max(0, 1 - edits(a, b) / len(b)), 6) if a and b else 0)
    assert got == want and got[1, 0][0] > 0 and got[1, 1] == (0, 1)
    assert got[5, 0] == (0.5, 0.5)  # an accent counts


def test_totals(spark, sf):
    p = [x[2:] for x in pairs()]
    rate = sum(edits(a, b) for a, b in p if a) / sum(len(a) for a, _ in p)
    assert one(spark, sf, "micro_cer")["cer"] == round(rate, 6)
    assert one(spark, sf, "micro_cer_official")["cer"] == round(sum(edits(a, b) for a, b in p) / sum(len(a) for a, _ in p), 6)
    assert one(spark, sf, "cer_mismatches")["differ"] == sum(bool(a) and abs(edits(a, b) / len(a) - 0.75) > 1e-6 for a, b in p)


def test_labelled(spark, sf):
    rows = [(i, a, b, a if r == "user" else "" if r == "assistant" else None, "" if i[0] % 3 == 0 else "null" if i[0] % 7 == 0 else b) for i, r, a, b in pairs()]
    got = {(r["conv_id"], r["turn"]): r["cer"] for r in Q.QUERIES["outcome_cer"](spark, sf).collect()}
    assert got == {i: None if y is None else 0 if y == c == "" else 1 if not y or not c else round(edits(c, y) / len(y), 6) for i, _, _, y, c in rows}
    pos, neg = [r for r in rows if r[3]], [r for r in rows if not r[3]]
    cer = sum(edits(a, b) for _, a, b, _, _ in pos) / sum(len(a) for _, a, *_ in pos)
    rr = sum(c in ("", "null") for *_, c in neg) / len(neg)
    e = one(spark, sf, "evaluate")
    assert (e["cer"], e["rr"], e["pos_count"], e["neg_count"]) == (round(cer, 6), round(rr, 6), len(pos), len(neg)) and e["score80"] == round((1 - cer) * 40 + rr * 40, 6)
    r = one(spark, sf, "rejection_rate")
    assert (r["rr"], r["rr_strict"]) == (round(rr, 6), round(1 - sum(c != "" for *_, c in neg) / len(neg), 6))


def brute(k, h):
    k, h = X.phonetic(k or "", None), X.phonetic(h or "", None)
    if not k or not h:
        return 0.0
    parts = [h[i:j] for i in range(len(h)) for j in range(i + 1, len(h) + 1)]
    return max([1 - edits(k, h) / max(len(k), len(h))] + [difflib.SequenceMatcher(None, k, x).ratio() for x in parts])


def test_wake_word_in_all_that_is_heard(spark, sf):
    talk = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = {(r["conv_id"], r["turn"]): r["sim"] for r in Q.QUERIES["wakeword_sim"](spark, sf).collect()}
    assert got == {k: brute((x or "")[:8], (x or "")[2:]) for k, x in talk.items()} and got[7, 1] > brute("Hey Mill", talk[7, 1][2:18])


def test_wake_word_bounds_lose_nothing():
    rng = random.Random(9)
    for _ in range(150):
        k, h = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, n))) for n in (9, 25))
        assert X.wakeword(k, h) == brute(k, h)


def test_wake_words_in_a_batch():
    rng = random.Random(4)
    pairs = [tuple("".join(rng.choice(rng.choice(["abc ", "ab", "efgh你好"])) for _ in range(rng.randrange(0, n))) for n in (12, 28)) for _ in range(300)] + [(None, "a"), ("a", None), ("", ""), ("a", "a")]
    assert X.wakewords(pairs) == [brute(*p) for p in pairs]
    assert X.wakewords([]) == [] and X.wakewords([("ab", "x" * 300_000 + "ab"), ("abcd", "xabxcd" * 3)])[0] == 1.0
    for n in (64, 65, 130):  # keywords of more than one machine word
        k, h = ("".join(rng.choice("abcdef") for _ in range(m)) for m in (n, 50))
        assert X.wakeword(k, h) == brute(k, h)


def test_plain_texts_are_normalised_alike(spark):
    texts = [None, "", " A, b!\t", "\x1c.x \x1d y\x1f", "$+<=>^`|~_-", "É ＡＢ。x", "a\u00a0b"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string").select("i", X.normalize_text("s").alias("n")).collect()
    assert [r["n"] for r in sorted(rows)] == [X.normalise(x) for x in texts]


def test_last_n_with_nulls_and_equal_rows(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (3, "b"), (3, "b")], "i int, s string")
    got = sorted((r["i"], r["is_val"]) for r in sampling.last_n_split(d, 2, [F.desc("i")]).collect())
    assert got == [(1, False), (2, False), (3, False), (3, True), (3, True)]
    assert {r["i"] for r in sampling.last_n_split(d, 4, [F.desc("i")]).where("is_val").collect()} == {2, 3}


def test_ids_go_on_after_one_line(spark, tmp_path):
    for name, n in (("pos", 1), ("neg", 2)):
        (tmp_path / f"{name}.jsonl").write_text("".join("{}\n\n" for _ in range(n)))
    got = [(r["split"], r["idx"], r["id"]) for r in manifests.read_manifest(spark, str(tmp_path)).orderBy("split", "idx").collect()]
    assert got == [("neg", 0, "1"), ("neg", 2, "3"), ("pos", 0, "0")]
