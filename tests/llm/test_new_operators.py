"""Vector codes, address filter and source audit against plain Python, odd rows included."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from wavemill.llm import divergence, urls, vafile

NAN, INF = float("nan"), float("inf")


# ---------------------------------------------------------------- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Rows (id, label, vector) in whole numbers of any size."""
    kept = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = -(-max((len(v) for _, _, v in kept), default=0) // parts)
    cut = []
    for i, label, v in kept:
        q = [Fraction(x) * scale // 1 for x in v] + [0] * (parts * w - len(v))
        cut.append((i, label, v, [q[j * w : (j + 1) * w] for j in range(parts)]))
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[3][j] for r in first] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, book: min((far(p, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            members = defaultdict(list)
            for r in cut:
                members[near(r[3][j], books[j])[1]].append(r[3][j])
            books[j] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if members[k] else e for k, e in enumerate(books[j])]
    out = [(i, label, [near(q[j], books[j]) for j in range(parts)]) for i, label, _, q in cut]
    total = Counter()
    for _, label, found in out:
        total[label] += sum(d for d, _ in found)
    text = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), total[label], text) for i, label, found in out), key=repr)


def coded(spark, rows, **more):
    d = spark.createDataFrame([(i, label, v, "x") for i, label, v in rows], "vec_id long, label int, embedding array<double>, code string").repartition(3)
    return sorted((tuple(r) for r in vafile.compress(d, **more).collect()), key=repr)


def vectors(n, width, seed=3, step=0.25):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 1, 2, None]), [rng.randint(-9, 9) * step for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        vectors(120, 16),
        vectors(9, 16),  # fewer rows than entries
        vectors(40, 13) + [(7, 2, [0.1] * 5), (None, None, [1.0] * 13), (900, 1, []), (7, 2, [0.1] * 5)],
        vectors(30, 8) + [(100, 1, None), (101, 1, [NAN] * 8), (102, 1, [1.0, -INF] * 4), (103, 2, [1.0, None] * 4)],
        vectors(30, 8) + [(5, 1, [3e4, -2e5] * 4), (6, 1, [2.0**28] * 8)],  # beyond what doubles hold exactly
        [(i, 1, [0.5] * 8) for i in range(20)],
        [],
    ],
)
def test_vector_codes(spark, rows):
    assert coded(spark, rows) == plain_codes(rows)


def test_vector_codes_of_other_shapes(spark):
    rows = vectors(60, 12, 5)
    assert coded(spark, rows, parts=3, entries=5, rounds=2, scale=100) == plain_codes(rows, 3, 5, 2, 100)


def test_an_error_beyond_64_bits_is_told(spark):
    far = [(i, 1, [i * 1e29] * 8) for i in range(60)]
    assert max(r[2] for r in plain_codes(far)) >= 1 << 63
    with pytest.raises(Exception, match="64 bits"):
        coded(spark, far)


def test_cells_bound_and_refine():
    rng = np.random.default_rng(1)
    for k, w in ((16, 8), (5, 3), (1, 4), (40, 6)):
        entries, queries = rng.integers(-50, 50, (k, w)).astype(float), rng.integers(-60, 60, (200, w)).astype(float)
        file = vafile.VAFile(entries)
        exact = ((queries[:, None] - entries) ** 2).sum(2)
        lower, upper = file.bounds(queries)
        assert (lower <= exact).all() and (exact <= upper).all()
        best, far, refined = file.nearest(queries)
        assert (best == exact.argmin(1)).all() and (far == exact.min(1)).all() and (k < 16 or refined < exact.size)


def test_codes_decode(spark):
    rows = [(i, 1, [float(i % 4)] * 10) for i in range(40)]
    d = vafile.usable(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    books = vafile.fit(d)
    got = {r["vec_id"]: r["embedding"] for r in vafile.decode(vafile.encode(d, books), books).collect()}
    assert got == {i: v for i, _, v in rows}


# ---------------------------------------------------------------- addresses


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else None


URLS = [
    "http://a.net/x", "HTTP://A.NET", "http://net/", "http://anet/", "http://x.example.net/en/1", "http://example.net/en", "http://example.net/EN/1", "http://example.com/de/?q=1#f", "http://example.com/de",
    "http://b.example.com/de/7", "https://w.org/fr/", "https://w.org/FR/", "https://org/fr/?x://y", "x", "", None, "://", "://net/", "http://x.net?/a", "http://x.net#/en/", "http://casino-win.example.com/en/1",
    "http://freebets.example.com/en/2", "http://Ünet.net/ä", "ftp://u:p@a.net:80/en/", "http://" + "ab" * 3000 + ".com/" + "cd" * 3000, "http://a.net/\nb", "http://example.net//en/",
]


def test_hosts_paths_and_rules(spark):
    d = spark.createDataFrame([(i, u, "t") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.filter_urls(d).collect()}
    for i, u in enumerate(URLS):
        host, path = plain_parts(u)
        rule = plain_rule(host, path, urls.RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[0])
        assert got[i]["verdict"] == (rule[1] if rule else "block" if got[i]["score"] > 0 else "allow")


def test_rules_in_all_orders():
    rules = [("c", "/ab", "allow"), ("b.c", "/", "block"), ("c", "/", "allow"), ("c", "/", "block"), ("a.b.c", "", "allow")]
    for order in itertools.permutations(rules):
        r = urls.Rules(list(order))
        for host in ("c", "b.c", "a.b.c", "x.a.b.c", "xc", "", "bb.c"):
            for path in ("", "/", "/a", "/ab", "/abc"):
                assert r.of(host, path) == plain_rule(host, path, rules)


def plain_split(run, cost, nothing):
    """The best of all splits."""
    best = None
    for k in range(1 << (len(run) - 1)):
        cuts = [0, *(i + 1 for i in range(len(run) - 1) if k >> i & 1), len(run)]
        words = [run[a:b] for a, b in zip(cuts, cuts[1:])]
        at = sum(min(cost.get(w, math.inf), nothing + urls.LETTER * len(w)) for w in words)
        if best is None or at < best[0] - 1e-9:
            best = (at, words)
    return best


def test_segmentation():
    words = urls.Words.of({"free": 40, "bet": 9, "bets": 30, "casino": 20, "win": 25, "winter": 3, "a": 60, "in": 50})
    assert words.tokens("freebets casinowin4u win-ter") == ["free", "bets", "casino", "win", "0", "u", "win", "ter"]
    rng = random.Random(2)
    for _ in range(60):
        run = "".join(rng.choice(["free", "bets", "win", "a", "x", "in", "q"]) for _ in range(rng.randint(1, 5)))[:12]
        want = plain_split(run, words.cost, words.nothing)
        got = words.split(run)
        assert "".join(got) == run and abs(sum(min(words.cost.get(w, math.inf), words.nothing + urls.LETTER * len(w)) for w in got) - want[0]) < 1e-9


def test_words_in_bad_company_are_learned(spark):
    pages = [f"http://casino-win{i}.example.com/en/{i}" for i in range(30)] + [f"http://blog.gardenhouse.example.com/en/{i}" for i in range(300)]
    pages += ["http://bigwin.example.com/en/1", "http://garden.example.com/en/1", "http://house.example.com/de"]
    d = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    texts = spark.createDataFrame([("the big garden of a house " * 20,), (None,), ("",)], "text string")
    got = {r["page_id"]: r for r in urls.filter_urls(d, texts, rules=[]).collect()}
    assert got[330]["verdict"] == "block" and "win" in got[330]["words"] and "big" in got[330]["words"]
    assert {got[i]["verdict"] for i in range(30)} == {"block"} and {got[i]["verdict"] for i in [*range(30, 330), 331, 332]} == {"allow"}
    assert "garden" in got[30]["words"] and "house" in got[30]["words"]
    # The scores are those of a multinomial model counted by hand.
    yes, no = Counter(), Counter()
    for r in got.values():
        (yes if set(r["words"]) & set(urls.UNWANTED) else no).update(r["words"])
    n = len(set(yes) | set(no))
    blocked = sum(bool(set(r["words"]) & set(urls.UNWANTED)) for r in got.values())
    for r in got.values():
        want = math.log((blocked + 1) / (len(got) - blocked + 1)) + sum(math.log((yes[t] + 1) / (yes.total() + n)) - math.log((no[t] + 1) / (no.total() + n)) for t in r["words"])
        assert abs(want - r["score"]) < 1e-9


def test_examples_instead_of_words(spark):
    d = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}-name.example.com/x{i}") for i in range(40)] + [(99, "http://very-bad.example.com/"), (98, "http://so-good.example.com/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(40)], "page_id long, blocked boolean")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(d, rules=[], examples=labels).collect()}
    assert got[99] == "block" and got[98] == "allow"


def test_no_addresses(spark):
    d = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(d, spark.createDataFrame([], "text string")).collect() == []


# ---------------------------------------------------------------- audit


def plain_audit(rows, least=30, top=50):
    words = [(lang or "", source or "", ["".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    df = Counter((lang, w) for lang, _, ws in words for w in set(ws))
    kept = defaultdict(set)
    for (lang, w), n in df.items():
        if n >= least:
            kept[lang].add(w)
    counts = defaultdict(Counter)
    for lang, source, ws in words:
        counts[lang, source].update(w for w in ws if w in kept[lang])
        counts[lang, None].update(w for w in ws if w in kept[lang])
    shares = {}
    for (lang, source), c in counts.items():
        n, v = c.total(), len(kept[lang])
        shares[lang, source] = {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * v) for w in kept[lang]}
    out = []
    for lang, source in [k for k in counts if k[1] is not None]:
        mine = shares[lang, source]
        pairs = [(other, sum(abs(mine[w] - shares[lang, other][w]) for w in kept[lang])) for l2, other in counts if l2 == lang and other is not None and other != source]
        terms = [(w, mine[w] - shares[lang, None][w]) for w in kept[lang] if counts[lang, source][w] and mine[w] > shares[lang, None][w]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows(seed, n=240):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "ÉTA", "x", "über", "a1b", "it's", "中文", "Ω", "rare", "mid"]
    rows = []
    for i in range(n):
        ws = rng.choices(words, weights=[9, 8, 7, 6, 5, 4, 3, 3, 3, 2, 2, 1, 2], k=rng.randint(0, 25))
        rows.append((rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", "é", None]), rng.choice([" ", "\n", "-", "\x00", " - "]).join(ws)))
    return rows + [("fr", "only", "bonjour"), ("fr", "two", None), ("es", "alone", ""), ("en", "empty", ""), ("en", "long", "alpha beta " * 40_000), ("de", "s1", None)]


@pytest.mark.parametrize("automaton, block", [(200_000, 128), (3, 128), (200_000, 2), (0, 1)])
def test_audit(spark, monkeypatch, automaton, block):
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", block)
    monkeypatch.setattr(divergence, "TERM_BLOCK", 4)
    rows = audit_rows(automaton + block)
    d = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n int, term string").repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(d, least=20, top=3, automaton=automaton).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, 20, 3)


def test_audit_of_nothing(spark):
    d = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(d).collect() == []
