"""Small fixtures against brute force, round trips and held-out accuracy; nulls, empty and repeated rows, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavemill.llm import bpe, chat, common, jaccard, langid, packing, pii, quality, suffix, topk, toxicity
from wavemill.llm.common import components

SCHEMA = "doc_id long, text string, n long, key string, score double, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 0.5, "x") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    base = words(rng, 120)
    rows = [(1, base), (2, base), (3, base.replace("w1 ", "x ")), (4, None), (5, ""), (6, "one two"), (7, "One  TWO"), (8, "é" * 300), (None, base), (9, "ab " * 200)]
    passage = words(rng, 60)
    rows += [(10 + i, words(rng, 30) + " " + passage + " " + words(rng, 30)) for i in range(8)]
    rows += [(30 + i, " ".join(w if rng.random() > 0.01 else "edit" for w in base.split())) for i in range(10)]
    return [*rows, (1, base)]


def test_suffix(spark, corpus):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix.remove_repeats(frame(spark, corpus)).collect())
    texts = [(t or "").encode() for _, t in corpus]
    seen = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    want = []
    for (i, _), b in zip(corpus, texts):
        mask = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                mask[k : k + 200] = b"\1" * 200
        want.append((i is None, i or 0, len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), bytes(x for x, m in zip(b, mask) if not m)))
    assert got == sorted(want)
    assert suffix.remove_repeats(frame(spark, corpus[:0])).count() == 0


def test_suffix_with_all_anchors_common(spark, corpus, monkeypatch):
    usual = {tuple(r) for r in suffix.remove_repeats(frame(spark, corpus)).collect()}
    real = suffix._frequent

    def everything(texts, share, length):
        places = suffix._places(texts, np.zeros(0, np.uint64), length)
        return places.groupBy(F.col("anchor").alias("value")).agg(F.count(F.lit(1)).alias("n"))

    monkeypatch.setattr(suffix, "_frequent", everything)
    assert {tuple(r) for r in suffix.remove_repeats(frame(spark, corpus)).collect()} == usual
    monkeypatch.setattr(suffix, "MOST_SENT", 3)
    assert {tuple(r) for r in suffix.remove_repeats(frame(spark, corpus)).collect()} == usual
    assert real is not suffix._frequent


def test_interval_tree():
    data = [b"banana", b"ana", b"anana", b"na", b"nana"]
    rows = sorted(data)
    width = max(map(len, rows))
    lens = np.array([len(r) for r in rows])
    lcp = suffix.lcp_of_neighbours(np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width), lens)
    assert lcp.tolist() == [0, 3, 0, 0, 2]
    assert sorted(suffix.intervals(lcp)) == [(0, 0, 4), (2, 3, 4), (3, 0, 1)]


@pytest.mark.parametrize("k, t", [(3, 90), (5, 80)])
def test_jaccard(spark, corpus, k, t):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.similar_classes(frame(spark, corpus), words=k, threshold=(t, 100)).collect())
    sets = []
    for i, text in corpus:
        w = (text or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    to = {i: i for i, _ in sets if i is not None}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= t * len(a | b):
                x, y = sorted((root(i), root(j)))
                to[y] = x
    assert got == sorted((i is None, i or 0, len(s), 0 if i is None else root(i)) for i, s in sets)
    assert jaccard.similar_classes(frame(spark, corpus[:0])).count() == 0


def test_keep_one(spark, corpus):
    docs = frame(spark, corpus)
    left = jaccard.keep_one(docs, jaccard.similar_classes(docs))
    ids = [r["doc_id"] for r in left.collect()]
    assert ids.count(1) == 1 and 2 not in ids and None in ids and {4, 5, 6} <= set(ids) and left.columns == docs.columns


def test_components_of_a_path(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r["node"], r["component"]) for r in components(edges).collect()} == {(i, 0) for i in range(41)}


def test_bpe_round_trip(spark):
    texts = ["", None, "Hello, wörld! " * 3, "a" * 5000, "x  y\n\n z", " " * 12_000 + "end", ("word " * 20_000) + "<|endoftext|>", "漢字 😀\r\n"]
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(frame(spark, list(enumerate(texts))))).collect()}
    enc = bpe.encoding()
    for i, t in enumerate(texts):
        assert bytes(got[i]["bytes"]) == (t or "").encode()
        if not t or "  " * 6000 not in t:
            assert list(got[i]["ids"]) == enc.encode_ordinary(t or "")
    assert [x for p in bpe.pieces("ab cd " * 50, 20) for x in enc.encode_ordinary(p)] == enc.encode_ordinary("ab cd " * 50)


class Rewriting:
    def render(self, turns):
        return f"[{len(turns)} turns]" + "".join(t for _, t in turns)


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be: brief"), (1, 1, "user", said), (1, 2, "assistant", said), (1, 2, "assistant", said), (2, 0, None, None), (None, None, "assistant", "x\n")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(d)).collect()}
    assert set(got) == {1, 2, None} and got[1]["n_turns"] == 4 and got[1]["n_rewrites"] == 0
    h = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:4]).encode()).hexdigest()
    assert got[1]["turns_sha256"] == h and got[1]["loss_sha256"] == hashlib.sha256((said * 2).encode()).hexdigest() and got[1]["loss_chars"] == 2 * len(said)
    t = chat.BlockTemplate()
    turns = [("user", said), ("assistant", "\\\\</turn>")] * 3
    out, spans = chat.trace(t, turns)
    tracer = chat.Tracer(t)
    assert [tracer.add(x)[1:] for x in turns] == spans and [x[:2] for x in t.read(out)] == turns
    assert [x[2] for x in chat.trace(Rewriting(), [("u", "a"), ("u", "b")])[1]] == [True, True]
    assert chat.read_back(chat.format_turns(d.limit(0))).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    good = [(i, ". ".join(words(rng, 12, 5000).capitalize() for _ in range(10)).replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")) + ".") for i in range(60)]
    bad = [(100 + i, " ".join((w + "!!").upper() for w in words(rng, 90, 5000).split())) for i in range(10)] + [(200 + i, ("spam " * 30 + "#$%& ") * 4) for i in range(5)]
    rows = [*good, *bad, (300, None), (301, ""), (302, "one two three"), (303, "a\na\n\n a")]
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, rows)).collect()}
    assert all(got[i]["kept"] for i, _ in good) and not any(got[i]["kept"] for i, _ in bad)
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (300, 301, 302)) and got[303]["n_dup_lines"] == 1
    for _, text in rows:
        w = (text or "").encode().split()
        c = Counter(zip(w, w[1:], w[2:]))
        again = {j + d for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for d in range(3)}
        assert quality.measure(text)[4] == len(again)
    assert quality.judge(frame(spark, [])).count() == 0


def test_toxicity_finds_unseen_spellings():
    rng = random.Random(3)
    stems = ["loser", "scumbag", "idiot"]
    texts, y = [], []
    for i in range(300):
        w = words(rng, rng.randrange(10, 200), 900).split()
        if i % 4 == 0:
            for s in rng.sample(stems, 2):
                w.insert(rng.randrange(len(w)), s + rng.choice(["", "s", "ic", "y", "ish"]))
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    model = toxicity.train(texts, np.array(y))
    p = toxicity.score_texts(pa.array(["w1 w2 w3 losers w5 w6", "you loserly idiotic one", "w4 w8 w9", "", None]), *model.collapsed())
    assert p[0] > 0.5 and p[1] > 0.5 and p[2] < 0.5 and 0 <= p[3] == p[4] <= 1


def test_toxicity_frame(spark):
    docs = frame(spark, [(i, f"text {i} " + ("idiot " if i % 2 else "")) for i in range(40)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score"] and out.count() == 40
    assert toxicity.fit(docs, labels.limit(0)).collapsed()[1] == 0


def test_topk(spark):
    rng = np.random.default_rng(4)
    v = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)] + [(400 + i, v0) for i in range(20) for v0 in [[0.5] * 8]]
    rows = [*v, (500, None), (501, [float("nan")] * 8), (502, [None] * 8), (50_000, [0.5] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    topk_blocks = topk.QUERY_BYTES, topk.CANDIDATE_BYTES
    topk.QUERY_BYTES, topk.CANDIDATE_BYTES = 100, 1600
    try:
        got = sorted(tuple(r) for r in topk.top_k(d, F.col("vec_id") % 50 == 0).collect())
    finally:
        topk.QUERY_BYTES, topk.CANDIDATE_BYTES = topk_blocks
    q = {i: np.floor(256 * np.array(x)).astype(np.int64) for i, x in [*v, rows[-1]]}
    want = []
    for i in (i for i in q if i % 50 == 0):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_pii(spark):
    rows = [
        (1, "mail joe.doe@example.com on 2020-02-29, card 4111 1111 1111 1111."), (2, "card 4111 1111 1111 1111 bad 4111 1111 1111 1112"), (3, None), (4, ""), (5, "plain 3.14 text 99"),
        (6, "ip 10.0.0.1 not 300.1.1.1; ssn 123-45-6789 not 000-12-3456; 31.12.1999 30.02.2000 12/25/2001"), (7, "GB82WEST12345698765432 and +49 170 1234567!"),
    ]
    got = {r["doc_id"]: r for r in pii.pseudonymise(frame(spark, rows), key="k").collect()}
    assert got[1]["kinds"] == ["email", "date", "card"] and "joe.doe" not in got[1]["text"] and got[1]["text"].startswith("mail ")
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", got[1]["text"])[1]
    assert card in got[2]["text"] and "4111 1111 1111 1112" in got[2]["text"] and got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == rows[4][1]
    digits = [int(c) for c in card if c.isdigit()]
    assert sum(d if k % 2 else (2 * d - 9 if 2 * d > 9 else 2 * d) for k, d in enumerate(digits)) % 10 == 0
    assert got[6]["kinds"] == ["ip", "ssn", "date", "date"] and "300.1.1.1" in got[6]["text"] and "30.02.2000" in got[6]["text"]
    assert got[7]["kinds"] == ["iban", "phone"] and "+49" in got[7]["text"]
    assert pii.pseudonymise(frame(spark, []), key="k").count() == 0


def test_pii_is_a_permutation(spark):
    days = spark.range(0, 160_000, 13).select(F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("s"))
    out = days.select(pii.pseudonym(F.col("s"), F.lit("date"), "k").alias("p"))
    assert out.distinct().count() == days.count() and out.where("try_cast(p AS date) IS NULL").count() == 0
    ends = spark.range(10_000).select(F.concat(F.lit("ab"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("@x.com")).alias("s"))
    assert ends.select(pii.pseudonym(F.col("s"), F.lit("email"), "k")).distinct().count() == 10_000


def test_language(spark):
    rng = random.Random(5)
    vocab = {"en": "the of and water house", "de": "der die und wasser haus", "fr": "le la et eau maison"}
    say = lambda x, n=30: " ".join(rng.choice(vocab[x].split()) for _ in range(n))
    docs = spark.createDataFrame([(i, say(x), x) for i in range(90) for x in [list(vocab)[i % 3]]], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    pages = [(i, f"http://h{i % 3}.example.de/", f"<html><p>{say('de')}</p></html>") for i in range(30)]
    pages += [(100, "http://a.example.fr/", f'<html lang="fr"><script>the the</script><p>{say("fr")}</p>'), (101, "http://h1.example.de/", ""), (102, None, None)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in langid.fuse(langid.evidence(d, model), model.languages).collect()}
    assert all(got[i]["lang"] == "de" for i in range(30)) and got[100]["lang"] == "fr" and got[101]["lang"] == "de" and got[101]["text_lang"] is None and len(got) == 33
    assert langid.fuse(langid.evidence(d.limit(0), model), model.languages).count() == 0


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(6)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(1, 60), 8)))
        counts = np.array([rng.randrange(1, 9) for _ in lengths])
        cost = lambda cuts: sum(c * (min(x for x in cuts if x >= n) - n) for n, c in zip(lengths, counts))  # noqa: B023, E731
        best = min(cost((*some, lengths[-1])) for k in range(3) for some in combinations(lengths[:-1], k))
        assert cost(packing.boundaries(lengths, counts, 3)) == best


def test_packing(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.choice([3, 10, 200]))) for i in range(100)] + [(None, None), (500, ""), (501, "w " * 5000), (1, "w w")]
    got = packing.pack(frame(spark, rows), buckets=4, budget=400, shards=3).collect()
    assert len(got) == 104 and all(r["padding"] >= 0 for r in got)
    size = Counter(r["batch_id"] for r in got)
    assert all(size[r["batch_id"]] * r["padded_to"] <= 400 or size[r["batch_id"]] == 1 for r in got)
    per = Counter((r["bucket"]) for r in got)
    assert len(size) == sum(-(-n // max(1, 400 // next(r["padded_to"] for r in got if r["bucket"] == b))) for b, n in per.items())
    assert packing.pack(frame(spark, [])).count() == 0


def test_jaccard_of_a_large_group_alike(spark):
    """Copies of one text with more and more edits: many pairs alike, some linked; a repeated id joins two classes."""
    rng = random.Random(8)
    base = words(rng, 150, 5000).split()
    rows = [(i, " ".join(w if rng.random() > (i % 40) / 300 else f"e{rng.randrange(10**6)}" for w in base)) for i in range(240)]
    rows += [(1000 + i, words(rng, 30, 5000) + " " + " ".join(base[20:70])) for i in range(30)] + [(5, words(rng, 80)), (2000, rows[7][1] + " x")]
    rows += [(2001, words(random.Random(9), 80)), (2002, words(random.Random(9), 80) + " y z")] + [(5, words(random.Random(9), 80))]
    for k, t in ((3, 90), (5, 80)):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), words=k, threshold=(t, 100)).collect())
        sets = [(i, {tuple(w[j : j + k]) for w in [x.split()] for j in range(len(w) - k + 1)}) for i, x in rows]
        to = {i: i for i, _ in sets}

        def root(x):
            while to[x] != x:
                x = to[x]
            return x

        for n, (i, a) in enumerate(sets):
            for j, b in sets[:n]:
                if 100 * len(a & b) >= t * len(a | b):
                    x, y = sorted((root(i), root(j)))
                    to[y] = x
        assert got == sorted((i, len(s), root(i)) for i, s in sets)


def test_jaccard_lists_over_batch_borders(spark):
    rng = random.Random(10)
    rows = [(rng.randrange(40), rng.randrange(6)) for _ in range(200)] + [(99, i % 7) for i in range(50)]
    want = {(k, n) for k, n in rows if len({y for x, y in rows if x == k}) > 1}
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(setting)
    for size in (1, 2, 3, 7):
        spark.conf.set(setting, str(size))
        got = [tuple(r) for r in jaccard._lists(spark.createDataFrame(rows, "key long, node long")).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    spark.conf.set(setting, usual)


def test_components_of_a_long_chain_and_stars(spark):
    edges = [((i * 7919) % 1009, ((i + 1) * 7919) % 1009) for i in range(600)] + [(5000, 5001 + i) for i in range(100)] + [(5000 - 1, 5050)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    chain = {x for e in edges[:600] for x in e}
    assert all(out[x] == min(chain) for x in chain) and all(out[x] == 4999 for x in range(4999, 5101))


def removed(texts, length):
    """Brute force: the bytes of each text under a string that starts anywhere else."""
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        mask = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        out.append(bytes(x for x, m in zip(b, mask) if not m))
    return out


def passages(rng):
    one, two = words(rng, 200), words(rng, 90)
    rows = [words(rng, rng.randrange(5, 60)) + " " + one[rng.randrange(300) : rng.randrange(400, 900)] + " " + words(rng, 20) for _ in range(24)]
    return rows + [two + words(rng, 5) + two[40:], "ab" * 900, two, None, "", "x" * 63]


@pytest.mark.parametrize("length, piece, most", [(64, 1 << 20, 20_000), (200, 300, 20_000), (320, 1 << 20, 4), (600, 700, 20_000)])
def test_suffix_at_other_lengths(spark, monkeypatch, length, piece, most):
    monkeypatch.setattr(suffix, "PIECE", piece)
    monkeypatch.setattr(suffix, "MOST_MEMBERS", most)
    texts = passages(random.Random(length))
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix.remove_repeats(frame(spark, list(enumerate(texts))), length=length).collect()}
    assert [got[i] for i in range(len(texts))] == removed([(t or "").encode() for t in texts], length)


def test_suffix_of_one_very_long_text(spark):
    """2 MB in one row, a passage of which stands in another."""
    rng = random.Random(12)
    long = "".join(rng.choices("abcdefghij \n", k=2_000_000))
    rows = [(1, long), (2, "start " + long[1_048_000:1_049_000] + " end"), (3, "other")]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept"]) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2][:2] == (1000, 1) and bytes(got[2][2]) == b"start  end" and got[1][:2] == (1000, 1) and got[3][0] == 0


def test_maximal_repeats(spark):
    rng = random.Random(11)
    a, b = words(rng, 12), words(rng, 12)
    texts = [f"one {a} two", f"three {a} {b} four", f"{b} five", f"six {a} two", "none"]
    got = {}
    for r in suffix.repeat_groups(frame(spark, list(enumerate(texts))), length=30).collect():
        got.setdefault((r["group_id"], r["n_bytes"]), set()).add((r["doc_id"], r["start"]))
    data = [t.encode() for t in texts]
    said = {}
    for (_, n), where in got.items():
        strings = {data[i][s : s + n] for i, s in where}
        assert len(strings) == 1 and len(where) > 1
        said[strings.pop()] = where
    for string, where in said.items():  # all occurrences
        assert where == {(i, m.start()) for i, d in enumerate(data) for m in re.finditer(b"(?=" + re.escape(string) + b")", d)}
    covered = [set() for _ in data]
    for string, where in said.items():
        for i, s in where:
            covered[i] |= set(range(s, s + len(string)))
    assert [bytes(x for k, x in enumerate(d) if k not in c) for d, c in zip(data, covered)] == removed(data, 30)


def test_maximal_repeats_of_a_passage_that_is_everywhere(spark, monkeypatch):
    monkeypatch.setattr(suffix, "MOST_MEMBERS", 5)
    rng = random.Random(12)
    passage, longer = "p" + words(rng, 9), words(rng, 14)
    texts = [f"{words(rng, 3)} {passage} {words(rng, 3)}" for _ in range(60)] + [f"same {passage} same"] * 40 + [f"{i} {longer} {passage}" for i in range(5)] + ["", "none"]
    got = {}
    for r in suffix.repeat_groups(frame(spark, list(enumerate(texts))), length=30).collect():
        got.setdefault((r["group_id"], r["n_bytes"]), []).append((r["doc_id"], r["start"]))
    data = [t.encode() for t in texts]
    said = {}
    for (_, n), where in got.items():
        strings = {data[i][s : s + n] for i, s in where}
        assert len(strings) == 1 and len(set(where)) == len(where) > 1
        said[strings.pop()] = set(where)
    for string, where in said.items():
        assert where == {(i, m.start()) for i, d in enumerate(data) for m in re.finditer(b"(?=" + re.escape(string) + b")", d)}
    assert max(map(len, said.values())) == 105 and any(len(w) == 40 for w in said.values())
    covered = [set() for _ in data]
    for string, where in said.items():
        for i, s in where:
            covered[i] |= set(range(s, s + len(string)))
    assert [bytes(x for k, x in enumerate(d) if k not in c) for d, c in zip(data, covered)] == removed(data, 30)


class Lying(chat.BlockTemplate):
    """Looks as if turns did not depend on each other, but changes its head between two turns and back."""

    context = 0

    def __init__(self, since, until):
        super().__init__()
        self.since, self.until = since, until

    def render(self, turns):
        return ("!" if self.since <= len(turns) < self.until else "") + super().render(turns)


@pytest.mark.parametrize("n, since, until", [(40, 10, 99), (1300, 1100, 9999), (3000, 1500, 1501), (3000, 2999, 9999)])
def test_every_rewrite_is_found(n, since, until):
    turns = [("user", f"turn {i} of a long conversation") for i in range(n)]
    template = Lying(since, until)
    tracer = chat.Tracer(template)
    found = [tracer.add(t) for t in turns]
    assert [i + 1 for i, f in enumerate(found) if f[3]] == [k for k in (since, until) if k <= n]
    assert tracer.before == template.render(turns) and found[since - 1][1] == 0 and found[-1][2] == len(tracer.before)
    if n < 100:
        assert [f[1:] for f in found] == chat.trace(template, turns)[1]


def test_turns_are_kept_within_a_bound(monkeypatch):
    monkeypatch.setattr(chat.BlockTemplate, "KEPT", 200)
    t, turns = chat.BlockTemplate(), [("user", "x" * n) for n in (10, 300, 50, 60, 70, 10, 300)]
    for _ in range(2):
        assert t.render(turns) == "".join(f"### user: {x}</turn>\n" for _, x in turns)
        assert len(t._shown) == 1 or sum(map(len, t._shown.values())) <= 200


def test_very_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i} " * 20) for i in range(1500)] + [(2, 0, "assistant", "x: y" * 300_000)]
    d = spark.createDataFrame([(*r, 1, "t") for r in rows], "conv_id long, turn long, role string, text string, start int, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(d)).collect()}
    for c in (1, 2):
        mine = [r for r in rows if r[0] == c]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in mine).encode()).hexdigest()
        assert got[c]["loss_chars"] == sum(len(r[3]) for r in mine if r[2] == "assistant") and got[c]["n_rewrites"] == 0


def test_pii_links_notations(spark):
    one = spark.createDataFrame([
        (1, "GB82WEST12345698765432|GB82 WEST 1234 5698 7654 32"), (2, "Joe.Doe@x.com|joe.doe@x.com"), (3, "4111 1111 1111 1111|4111-1111-1111-1111"),
        (4, "2020-02-29|29.02.2020"), (5, "+49 170 1234567|+49 (170) 123-4567"),
    ], "id long, t string").select("id", F.explode(F.split("t", "\\|")).alias("text"))
    got = {}
    for r in pii.pseudonymise(one.withColumn("_found", F.lit("mine")).withColumn("_new", F.lit("too")), key="k").collect():
        assert r["n_pseudonyms"] == 1 and r["_found"] == "mine" and r["_new"] == "too"
        bare = re.sub(r"[^a-z0-9]", "", r["text"].lower())
        if r["id"] == 4:
            bare = "".join(sorted(bare))
        got.setdefault(r["id"], set()).add(bare)
    assert all(len(v) == 1 for v in got.values()), got
    bad = spark.createDataFrame([("GB99WEST00000000000029",)], "text string")
    assert "iban" not in pii.pseudonymise(bad, key="k").first()["kinds"]
    with pytest.raises(ValueError):
        pii.pseudonymise(bad)


def plain_top(rows, k=5):
    """Rows (id, components); queries are those with an id divisible by 50; whole numbers of any size."""
    whole = [(i, [Fraction(x) * 256 // 1 for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in whole:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def test_topk_of_long_vectors(spark):
    rng = random.Random(9)
    rows = [(0, [1e7, 0.0]), (50, [1.0, 1.0]), (1, [0.5, 2.0])]
    wide = [(i, [rng.uniform(-2, 2), rng.uniform(-99, 99), rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 7])]) for i in range(150)]
    far = [(0, [1.0, 1.0]), (50, [1.0, -1.0]), (7, [1e14, 0.0]), *[(100 + i, [1.0, i / 4]) for i in range(1, 40)]]
    for case in (rows, wide, far, [(0, [1e30, 0.0]), (1, [0.0, 3.0]), (2, [0.0, -1.0])]):
        want = plain_top(case)
        assert max(abs(r[3]) for r in want) < 1 << 63
        d = spark.createDataFrame([(*r, "t") for r in case], "vec_id long, embedding array<double>, score string").repartition(3)
        assert sorted(tuple(r) for r in topk.top_k(d, F.col("vec_id") % 50 == 0).collect()) == want


def test_topk_tells_scores_beyond_64_bits(spark):
    for v in ([1e200, 2.0], [-1e200, 0.0]):  # the one candidate there is has to be returned
        d = spark.createDataFrame([(0, v), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(d, F.col("vec_id") == 0).collect()
    # One that is not among the best is no error.
    d = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [-1e200, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(d, F.col("vec_id") == 0, k=1).collect()] == [(0, 1, 1, 3 * 65536)]
    assert topk.top_k(d.limit(0), F.col("vec_id") == 0).count() == 0


def test_topk_of_repeated_rows(spark):
    rows = [(0, [1.0, 2.0])] * 2 + [(3, [1.0, 1.0])] * 2 + [(4, [9.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[1:] for r in topk.top_k(d, F.col("vec_id") == 0, k=3).collect()]
    assert got == [(1, 4, 9 * 65536), (2, 4, 9 * 65536), (3, 3, 3 * 65536)]


def test_bpe_cuts_in_other_scripts():
    rng = random.Random(3)
    enc = bpe.encoding()
    cyrillic = " ".join("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(rng.randint(1, 9))) for _ in range(40_000))
    chinese = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(rng.randint(1, 5))) for _ in range(30_000))
    unspaced = "".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(rng.randint(1, 9))) + rng.choice("、。！，：；？") for _ in range(20_000))
    mixed = "".join(rng.choice(["字", "。", " ", "\n", "a", "'s", "１", "é", "\u3000", "\x1c", "…", "か", "\u0301", "7", "，", "\t", "\u00a0"]) for _ in range(60_000))
    for text in (cyrillic, chinese, unspaced, mixed):
        parts = list(bpe.pieces(text, 4000))
        assert "".join(parts) == text and max(map(len, parts)) < 4200
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def families(m, seed=3):
    """2m near copies of one text, m of another that is far from it, and texts between the two that link each side to the next."""
    rng = random.Random(seed)
    one = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    places = rng.sample(range(600), 25)
    other = [f"y{rng.randrange(10**6)}" if i in places else w for i, w in enumerate(one)]

    def near(text, n=2):
        return " ".join(f"z{rng.randrange(10**6)}" if i in spots else w for spots in [set(rng.sample(range(600), n))] for i, w in enumerate(text))

    return [(i, near(one)) for i in range(2 * m)] + [(10_000 + i, near(other)) for i in range(m)], one, other, places


def made(monkeypatch, run):
    """Rows of the frames of candidate pairs that a run makes."""
    counts, real = [], jaccard.checkpointed

    def spy(df):
        out = real(df)
        if df.columns == ["a", "b"] or "node_b" in df.columns:
            counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "checkpointed", spy)
    got = run()
    monkeypatch.setattr(jaccard, "checkpointed", real)
    return got, sum(counts)


def test_jaccard_of_two_families_makes_no_pairs(spark, monkeypatch):
    rows, *_ = families(400)
    d = frame(spark, rows).repartition(4)
    got, pairs = made(monkeypatch, lambda: jaccard.similar_classes(d, words=3, threshold=(90, 100)).collect())
    assert {(r["doc_id"] >= 10_000, r["component_id"]) for r in got} == {(False, 0), (True, 10_000)} and pairs <= 400


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_of_families_with_bridges(spark, seed):
    """Texts between the families, some of which link them, and families that only look alike."""
    rng = random.Random(seed)
    rows, one, other, places = families(12, seed)
    for i in range(30):
        mine = set(rng.sample(places, rng.randrange(0, 26)))
        rows.append((20_000 + i, " ".join(other[k] if k in mine else w for k, w in enumerate(one))))
    for f in range(3):  # far from each other and in themselves
        base = [other[k] if k % 9 == f else w for k, w in enumerate(one)]
        rows += [(30_000 + 100 * f + i, " ".join(f"q{rng.randrange(10**6)}" if rng.random() < 0.03 else w for w in base)) for i in range(10)]
    sets = {i: {tuple(w[j : j + 3]) for w in [t.split()] for j in range(len(w) - 2)} for i, t in rows}
    to = {i: i for i in sets}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 100 * len(a & b) >= 90 * len(a | b):
                x, y = sorted((root(i), root(j)))
                to[y] = x
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_classes(frame(spark, rows).repartition(5), words=3, threshold=(90, 100)).collect()}
    assert got == {i: root(i) for i in sets}


def test_texts_of_a_large_group_stay_apart(spark):
    """No task gets the texts of all members of a root."""
    rows, *_ = families(150)
    texts = frame(spark, [(i, t) for i, t in rows if i < 10_000]).select(F.col("doc_id").alias("node"), "text")
    pairs = texts.where("node > 0").select(F.lit(0).cast("long").alias("a"), F.col("node").alias("b"), F.lit(None).cast("long").alias("most"))
    seen = []
    real = jaccard.checkpointed

    def spy(df):
        if "delta" in df.columns:
            seen.append(df)
        return real(df)

    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    jaccard.checkpointed = spy
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = jaccard._differences(pairs, texts, 3)
        assert out.count() == 299 and out.select(F.max("d")).first()[0] < 40
        sizes = [r["n"] for r in seen[0].groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) <= 2 * jaccard.PART
    finally:
        jaccard.checkpointed = real
        for k, v in old.items():
            spark.conf.set(k, v)


def test_settings_are_read_as_spark_writes_them(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(setting)
    try:
        for given, want in (("64m", str(8 << 20)), ("1g", str(8 << 20)), ("67108864b", str(8 << 20)), ("1m", "1m"), ("4096", "4096")):
            spark.conf.set(setting, given)
            common.small_batches(spark)
            assert spark.conf.get(setting) in (want, f"{want}b")
            kept = spark.conf.get(setting)
            assert bpe.counts(frame(spark, [(1, "a b")])).first()["n_tokens"] == 2 and spark.conf.get(setting) == kept
    finally:
        spark.conf.set(setting, old)


def test_rows_meet_what_their_key_has(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 5 + [None, "a", "b", *[f"k{j}" for j in range(300)]])) for i in range(3000)]
    d = spark.createDataFrame(rows, "id long, key string")
    by = d.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("twice", F.col("n") * 2)
    counts = Counter(k for _, k in rows)
    got = {(r["id"], r["key"], r["twice"]) for r in common.joined_by_key(d, by, "key", "n").collect()}
    assert got == {(i, k, 2 * counts[k]) for i, k in rows}


def test_least_count(spark):
    counts = [rng for k in range(1, 60) for rng in [k**4] * (60 - k)]
    d = spark.createDataFrame([(c,) for c in counts], "n long")
    for most in (0, 1, 5, 100, 1000, 10**6):
        least = common.least_count(d, most)
        n = sum(c >= least for c in counts)
        assert n <= most and (n == len(counts) or n + max(Counter(counts).values()) * 2 > most)


def test_keys_are_drawn_where_none_is_set(spark):
    key = pii.application_key(spark)
    assert key == pii.application_key(spark) and len(key) == 64
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.application_key(spark) == "mine"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_packing_counts_tokens(spark):
    rows = [(1, "Hello, wörld! 漢字"), (2, None), (3, "a b c")]
    got = {r["doc_id"]: r["n_tokens"] for r in packing.pack(frame(spark, rows)).collect()}
    assert got == {i: len(bpe.encoding().encode_ordinary(t or "")) for i, t in rows}
