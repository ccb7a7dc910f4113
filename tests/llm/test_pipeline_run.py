"""run() over a small corpus against brute force, stage by stage; odd rows; extra columns."""

import random

import pyarrow as pa

import corpus_pipeline
from wavemill.llm import bpe, packing, pii, toxicity


def words(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(21)
    rows = [(i, words(rng, rng.randrange(30, 200)) + (" you idiot scumbag loser" * 3 if i % 6 == 0 else "")) for i in range(60)]
    shared = words(rng, 70)
    rows += [(100 + i, words(rng, 60) + " " + shared + " " + words(rng, 60)) for i in range(5)]
    near = words(rng, 200).split()
    rows += [(200 + i, " ".join(w if k != 50 * (i % 4) else f"x{i}" for k, w in enumerate(near))) for i in range(6)]
    rows += [(300, rows[1][1]), (301, None), (302, ""), (303, "one two"), (304, "mail joe.doe@example.com or 4111 1111 1111 1111 today " + words(rng, 20))]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(60)]
    return rows, labels


def test_run_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = toxicity.score_texts(pa.array([t for _, t in rows], pa.string()), *[x if k else x.astype("float32") for k, x in enumerate(model.collapsed())])
    left = [(i, t) for (i, t), p in zip(rows, scores) if p < 0.5]
    assert {i for i, _ in rows} - {i for i, _ in left} >= {i for i in range(60) if i % 6 == 0}

    sets = {i: {tuple(w[j : j + 5]) for w in [(t or "").lower().split()] for j in range(len(w) - 4)} or ({tuple((t or "").lower().split())} if (t or "").split() else set()) for i, t in left}
    to = {i: i for i in sets}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                to[y] = x
    left = [(i, t or "") for i, t in left if root(i) == i]

    seen = {}
    for _, t in left:
        for k in range(len(t) - 199):
            seen[t[k : k + 200]] = seen.get(t[k : k + 200], 0) + 1
    cut = []
    for i, t in left:
        mask = [False] * len(t)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                mask[k : k + 200] = [True] * 200
        cut.append((i, "".join(c for c, m in zip(t, mask) if not m)))
    assert sum(len(t) for _, t in cut) < sum(len(t) for _, t in left)

    hidden = pii.pseudonymise(spark.createDataFrame(cut, "doc_id long, text string"), pii.application_key(spark)).collect()
    assert sum(r["n_pseudonyms"] for r in hidden) == 2
    length = {r["doc_id"]: len(bpe.encoding().encode_ordinary(r["text"])) for r in hidden}
    assert {i: r["n_tokens"] for i, r in got.items()} == length
    sizes = sorted(set(length.values()))
    import numpy as np

    cuts = packing.boundaries(np.array(sizes), np.array([sum(v == n for v in length.values()) for n in sizes]), packing.BUCKETS)
    assert all(r["padded_to"] == min(c for c in cuts if c >= r["n_tokens"]) for r in got.values())
    batches = {}
    for r in got.values():
        batches.setdefault(r["batch_id"], []).append(r["padded_to"])
    assert all(len(set(b)) == 1 and (sum(b) <= packing.BUDGET or len(b) == 1) for b in batches.values())


def test_stages_on_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    shape = "doc_id long, text string, lang string, source string, n_chars long, score double, kinds string, n_spans int"
    odd = [(1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, 1.0, "k", 1), (2, "", "en", "s", 0, 1.0, "k", 1), (None, "text " * 60, None, None, None, None, None, None), (3, "text " * 60, "en", "s", 1, 0.0, "", 2)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, shape)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= len(rows), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
