"""Quality posteriors, toxicity scores, pseudonyms and languages against second versions in plain Python."""

import datetime
import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from wavemill.llm import langid, pii, quality, toxicity

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# ---------------------------------------------------------------- quality


def plain_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = Counter(zip(words, words[1:], words[2:]))
    again = {j + d for j in range(len(words) - 2) if triples[tuple(words[j : j + 3])] > 1 for d in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again),
        "n_upper": sum(c.isupper() for c in text), "n_alpha": sum(c.isalpha() for c in text), "n_marks": sum(c in "!?" for c in text), "n_distinct": len(set(words)), "n_lines": len(lines),
    }


def plain_votes(f):
    w, c = f["n_words"], max(f["word_chars"], 1)
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    return (
        vote(f["n_symbols"] / c > 1 / 50, f["n_symbols"] / c < 1 / 500), vote(f["n_symbols"] > w / 4, False), vote(f["n_upper"] > 0.4 * f["n_alpha"], 10 * f["n_upper"] < 2 * f["n_alpha"]),
        vote(f["n_marks"] > w / 4, f["n_marks"] < w / 20), vote(f["n_repeat_words"] * 10 > 3 * w, f["n_repeat_words"] * 20 < w), vote(f["n_dup_lines"] * 10 > 3 * f["n_lines"], False),
        vote(f["n_alpha"] * 10 < 7 * c, f["n_alpha"] * 10 > 9 * c), vote(c > 15 * w or c * 10 < 22 * w, 3 * w < c < 11 * w), vote(w < 20, w >= 80),
    )


def plain_posteriors(votes):
    """EM over rows, not over patterns."""
    n, rules = len(votes), len(votes[0])
    post = [0.1 if min(v) < 0 else 0.9 for v in votes]
    for _ in range(200):
        theta = []
        for r in range(rules):
            classes = []
            for y in (0, 1):
                weight = {v: 1.0 for v in (-1, 0, 1)}
                for v, p in zip(votes, post):
                    weight[v[r]] += p if y else 1 - p
                total = sum(weight.values())
                classes.append({v: x / total for v, x in weight.items()})
            bad, good = classes
            if good[-1] > bad[-1]:
                good[-1] = bad[-1] = (good[-1] + bad[-1]) / 2
            if good[1] < bad[1]:
                good[1] = bad[1] = (good[1] + bad[1]) / 2
            theta.append(classes)
        share = min(0.99, max(0.01, (sum(post) + 1) / (n + 2)))
        new = []
        for v in votes:
            odds = math.log(share / (1 - share)) + sum(math.log(theta[r][1][v[r]] / theta[r][0][v[r]]) for r in range(rules))
            new.append(1 / (1 + math.exp(-max(-700, min(700, odds)))))
        moved = max(abs(a - b) for a, b in zip(new, post))
        if moved < 1e-9:
            break
        post = new
    return new


def test_quality_by_a_second_em(spark, documents):
    got = {r["doc_id"]: r for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    ids = sorted(documents)
    figures = {i: plain_figures(documents[i]) for i in ids}
    votes = [plain_votes(figures[i]) for i in ids]
    for i, v, p in zip(ids, votes, plain_posteriors(votes)):
        assert {k: got[i][k] for k in figures[i]} == figures[i] and tuple(got[i]["votes"]) == v
        assert abs(got[i]["posterior"] - p) < 1e-6
        failed = figures[i]["n_words"] < 50 or 100 * figures[i]["n_repeat_words"] > 50 * figures[i]["n_words"]
        assert got[i]["base_failed"] == failed and got[i]["kept"] == (not failed and p >= 0.5)
    assert {r["kept"] for r in got.values()} == {True, False}


def test_quality_of_very_long_texts_and_clashing_names(spark):
    long = "Some words of a very long text that goes on. " * 60_000
    rows = [(1, long, 5, 0.1, True), (2, "short", 1, 0.2, False), (3, None, 1, 0.2, False)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words int, posterior double, kept boolean")
    got = {r["doc_id"]: r for r in quality.judge(d).collect()}
    assert {k: got[1][k] for k in plain_figures(long)} == plain_figures(long) and got[2]["n_words"] == 1 and got[3]["n_words"] == 0


# ---------------------------------------------------------------- toxicity


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_grams(word):
    codes = [ord(c) for c in f"<{word}>"]
    out = []
    for n in toxicity.SIZES:
        for k in range(len(codes) - n + 1):
            h = n
            for c in codes[k : k + n]:
                h = (h * 0x100000001B3 + c) & M64
            out.append(mix(h) % toxicity.BUCKETS)
    whole, power = 0, 1
    for c in codes:
        power = power * (0x9E3779B97F4A7C15 | 1) & M64
        whole = (whole + mix(c) * power) & M64
    return [*out, mix(whole) % toxicity.BUCKETS]


def test_toxicity_scores_from_the_vectors(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    weight = (model.vectors.astype(float) @ (model.softmax[:, 1] - model.softmax[:, 0]).astype(float)).tolist()
    bias = float(model.bias[1] - model.bias[0])
    known = {}
    for i, text in documents.items():
        scores = []
        for w in (text or "").lower().split():
            if w not in known:
                grams = plain_grams(w)
                known[w] = sum(weight[g] for g in grams) / len(grams)
            scores.append(known[w])
        n = min(len(scores), toxicity.WINDOW)
        logit = bias + max((sum(scores[k : k + n]) / n for k in range(len(scores) - n + 1)), default=0) if scores else bias
        assert abs(got[i] - 1 / (1 + math.exp(-logit))) < 1e-4
    assert any(s > 0.5 for s in got.values())


def test_an_id_labelled_both_ways_teaches_nothing_new(spark):
    """It stands in both classes, so both learn from its text; whatever it adds to the one it adds to the other."""
    docs = spark.createDataFrame([(i, ("idiot " if i % 2 else "kind ") * 3 + f"w{i}") for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (4, 1), (5, 0)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(60))


# ---------------------------------------------------------------- pseudonyms


def spark_hash(text, number):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<i", number), seed=h)))[0]


def plain_feistel(values, radices, key, tweak):
    half = len(values) // 2
    a, b, ra, rb = values[:half], values[half:], radices[:half], radices[half:]
    for r in range(1, pii.ROUNDS + 1):
        inner = hashlib.sha256("|".join([key, tweak, str(r), ",".join(map(str, b))]).encode()).hexdigest()
        pad = hashlib.sha256(f"{key}|{inner}".encode()).hexdigest()
        a, b, ra, rb = b, [(x + spark_hash(pad, i) % m) % m for i, (x, m) in enumerate(zip(a, ra))], rb, ra
    return a + b


def plain_text(s, key, tweak):
    if not s:
        return s
    low = [48 if c.isdigit() else 97 if c.islower() else 65 if c.isupper() else 0 for c in s]
    radix = [{48: 10, 97: 26, 65: 26, 0: 1}[x] for x in low]
    shape = "".join({48: "0", 97: "a", 65: "A"}.get(x, c) for x, c in zip(low, s))
    moved = plain_feistel([ord(c) - x if x else 0 for c, x in zip(s, low)], radix, key, tweak + shape)
    return "".join(chr(v + x) if x else c for v, x, c in zip(moved, low, s))


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10


def refilled(old, new, is_slot):
    put = iter(new)
    return "".join(next(put) if is_slot(c) else c for c in old)


def plain_pseudonym(s, kind, key):
    digits = "".join(filter(str.isdigit, s))
    if kind == "email":
        name, at, domain = s.partition("@")
        new = plain_text(name.lower(), key, "email")
        return "".join(n.upper() if c.isupper() else n for c, n in zip(name, new)) + at + domain
    if kind == "card":
        body = digits[0] + plain_text(digits[1:-1], key, "card")
        return refilled(s, body + str(-luhn(body + "0") % 10), str.isdigit)
    if kind == "phone":
        return refilled(s, digits[:2] + plain_text(digits[2:], key, "phone"), str.isdigit)
    if kind == "ip":
        return ".".join(map(str, plain_feistel(list(map(int, s.split("."))), [256] * 4, key, "ip")))
    if kind == "ssn":
        area, group, serial = map(int, s.split("-"))
        a, g, n = plain_feistel([area - (2 if area > 666 else 1), group - 1, serial - 1], [898, 99, 9999], key, "ssn")
        return f"{a + (2 if a >= 665 else 1):03}-{g + 1:02}-{n + 1:04}"
    if kind == "date":
        form = next(f for f in ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y") if re.fullmatch(f.replace(".", r"\.").replace("%Y", r"\d{4}").replace("%m", r"\d\d").replace("%d", r"\d\d"), s))
        first = datetime.date(1700, 1, 1)
        n = (datetime.datetime.strptime(s, form).date() - first).days
        x, y = plain_feistel([n // 400, n % 400], [400, 400], key, "date")
        return (first + datetime.timedelta(x * 400 + y)).strftime(form)
    bare = s.replace(" ", "")
    body = plain_text(bare[4:], key, "iban")
    number = int("".join(str(int(c, 36)) for c in body + bare[:2] + "00"))
    return refilled(s, f"{bare[:2]}{98 - number % 97:02}{body}", lambda c: c != " ")


VALUES = [
    ("email", "joe.doe@example.com"), ("email", "Ann-Marie_7@x.org"), ("email", "a@b.de"), ("email", "9+z@b.de"), ("card", "4111 1111 1111 1111"), ("card", "378282246310005"), ("card", "6011-1111-1111-1117"),
    ("phone", "+49 170 1234567"), ("phone", "(555) 123-4567"), ("phone", "555.123.4567"), ("ip", "10.0.255.1"), ("ip", "192.168.1.77"), ("ssn", "001-01-0001"), ("ssn", "665-99-9999"), ("ssn", "667-12-3456"),
    ("ssn", "899-50-1234"), ("date", "2020-02-29"), ("date", "1999/12/31"), ("date", "01.03.1700"), ("date", "12/25/2100"), ("iban", "GB82WEST12345698765432"), ("iban", "DE89 3704 0044 0532 0130 00"),
]


def test_pseudonyms_of_each_kind(spark):
    d = spark.createDataFrame(VALUES, "kind string, s string")
    for key in ("k", "another key"):
        for r in d.select("kind", "s", pii.pseudonym(F.col("s"), F.col("kind"), key).alias("p"), pii.kind_of(F.col("s")).alias("found")).collect():
            assert (r["found"], r["p"]) == (r["kind"], plain_pseudonym(r["s"], r["kind"], key)), r


def test_pseudonyms_in_very_long_texts(spark):
    rng = random.Random(1)
    parts, want = [], []
    for kind, s in VALUES * 20:
        filler = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(300))
        parts += [filler, s]
        want += [filler, plain_pseudonym(s, kind, "k")]
    d = spark.createDataFrame([(1, " ; ".join(parts))], "doc_id long, text string")
    r = pii.pseudonymise(d, "k").first()
    assert r["text"] == " ; ".join(want) and r["n_pseudonyms"] == len(VALUES) * 20


# ---------------------------------------------------------------- languages


def plain_languages(seen, languages, strength=20.0):
    """``seen``: page_id -> (declared, host, domain, suffix, ll)."""
    n = len(languages)
    vote = {p: ll.index(max(ll)) if any(ll) else None for p, (*_, ll) in seen.items()}
    counts = defaultdict(Counter)
    for p, (declared, host, domain, suffix, _) in seen.items():
        for key in (("all",), ("declared", declared), ("host", host), ("domain", domain), ("suffix", suffix)):
            if vote[p] is not None:
                counts[key][vote[p]] += 1
    total = counts["all",].total()
    top = [(counts["all",][k] + 1) / (total + n) for k in range(n)]
    out = {}
    for p, (declared, host, domain, suffix, ll) in seen.items():
        def smoothed(key, above):
            own = [counts[key][k] - (vote[p] == k) for k in range(n)]  # noqa: B023
            return [(x + strength * a) / (sum(own) + strength) for x, a in zip(own, above)]

        prior = smoothed(("host", host), smoothed(("domain", domain), smoothed(("suffix", suffix), top)))
        told = [math.log(a / b) for a, b in zip(smoothed(("declared", declared), top), top)] if declared else [0.0] * n
        score = [x + math.log(a) + t for x, a, t in zip(ll, prior, told)]
        parts = [math.exp(s - max(score)) for s in score]
        best = parts.index(max(parts))
        out[p] = (languages[best], parts[best] / sum(parts))
    return out


def test_languages_by_a_second_fusion(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "pages"))
    model = langid.fit(docs)
    odd = spark.createDataFrame([(9001, "http://x.example.net/", ""), (9002, None, None), (9003, "http://x.example.net/", "<html lang=de>"), (9004, "HTTP://U@X.Example.NET:80/en/", "<p>" + "und der die das " * 20_000), (9005, "http://10.0.0.1/", "<p>the of")], "page_id long, url string, html string")
    every = pages.select("page_id", "url", "html").unionByName(odd).withColumn("vote", F.lit("x")).withColumn("ll", F.lit(1.0))
    seen = langid.evidence(every, model)
    rows = {r["page_id"]: (r["declared"], r["host"], r["domain"], r["suffix"], list(r["ll"])) for r in seen.collect()}
    got = {r["page_id"]: (r["lang"], r["probability"]) for r in langid.fuse(seen, model.languages).collect()}
    want = plain_languages(rows, model.languages)
    assert set(got) == set(want) and len(got) == pages.count() + 5
    for p, (lang, probability) in want.items():
        assert got[p][0] == lang and abs(got[p][1] - probability) < 1e-9


def test_language_likelihoods(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    texts = ["the water of the house", "Über die Häuser", "a", "x" * 300, "l'eau de la maison " * 30]
    d = spark.createDataFrame([(i, "http://h.example.de/", f"<p>{t}</p>") for i, t in enumerate(texts)], "page_id long, url string, html string")
    for r in langid.evidence(d, model).collect():
        grams = []
        for w in texts[r["page_id"]].lower().split():
            codes = [ord(c) for c in f"<{w}>"]
            for n in langid.SIZES:
                for k in range(len(codes) - n + 1):
                    h = n
                    for c in codes[k : k + n]:
                        h = (h * 0x100000001B3 + c) & M64
                    grams.append(mix(h) % langid.BUCKETS)
        for k, x in enumerate(r["ll"]):
            assert abs(x - sum(float(model.logs[k][g]) for g in grams) * min(1, 40 / len(grams))) < 1e-3


def test_known_documents_get_their_language(spark):
    """Documents as pages without any other evidence; the model was trained on 40 of each language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    model = langid.fit(docs, per_language=40)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("<p>"), F.regexp_replace("text", "[<>&]", " ")).alias("html"))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = {r["page_id"]: r["lang"] for r in langid.fuse(langid.evidence(pages, model), model.languages).collect()}
    assert sum(got[i] == x for i, x in truth.items()) / len(truth) > 0.97
