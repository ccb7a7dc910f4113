"""pack() pads no more than the best boundaries do, lengths over 4096 words included."""

from itertools import combinations

from pyspark.sql import functions as F

from wavemill.llm import packing


def padding(spark, lengths, buckets):
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    return packing.pack(docs, buckets=buckets, length=F.col("n")).collect()


def test_one_long_length_is_not_padded(spark):
    got = padding(spark, [5461] * 7, 16)
    assert {r["padded_to"] for r in got} == {5461} and sum(r["padding"] for r in got) == 0
    assert len({r["batch_id"] for r in got}) == 3


def test_padding_over_long_lengths_is_the_least(spark):
    lengths = [7, 7, 90, 4095, 4097, 4097, 4130, 5461, 5470, 9001, 9001, 9100, 20020, 20021]
    distinct = sorted(set(lengths))
    for buckets in (1, 3, 4):
        cuts = ((*some, distinct[-1]) for some in combinations(distinct[:-1], buckets - 1))
        best = min(sum(min(c for c in x if c >= n) - n for n in lengths) for x in cuts)
        assert sum(r["padding"] for r in padding(spark, lengths, buckets)) == best
