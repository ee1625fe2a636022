"""Pairwise counts by blocks: the same as by a join on sites, with nothing shuffled for a pair of taxa."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import SF

from sparkclade.operators import counts as C
from sparkclade.plans.queries import QUERIES, ids, rounded
from sparkclade.sources import observe


@pytest.fixture(scope="module")
def sites(spark):
    """Ids far apart, gaps, several chunks, cells that occur twice, nulls."""
    rng = np.random.default_rng(5)
    rows = [(int(t) ** 3 - 40, int(s) - 7, int(rng.integers(4))) for t in range(23) for s in range(50) if rng.random() < 0.6]
    rows += rows[::9] + [(t, s, 3 - a) for t, s, a in rows[::11]] + [(1000000, 5000, 1), (None, 1, 1), (3, None, 1), (3, 1, None)]
    return spark.createDataFrame(rows, "taxon int, site int, state int").repartition(3).cache()


def told(df):
    return sorted(tuple(r) for r in df.collect())


def shuffled_after_meeting(df):
    """Whether rows of pairs are shuffled: an exchange or aggregate above the Python step that makes them."""
    above = df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    return len(above) == 1 or "Exchange" in above[0] or "Aggregate" in above[0]


@pytest.mark.parametrize("name", ["hamming_missing", "jc_similarity", "conf_counts", "valid_pairs", "hamming"])
def test_no_shuffle_of_pairs(spark, name):
    assert not shuffled_after_meeting(QUERIES[name](spark, SF))


def test_hamming_blocked(spark, sites):
    want = told(C.hamming(C.conf(sites.dropna())).select("i", "j", "h"))
    assert len(want) == 253
    assert told(C.hamming_blocked(sites, block=4, chunk=16)) == want
    assert told(C.hamming_blocked(sites)) == want


def test_conf_blocked(spark, sites):
    want = told(C.conf(sites.dropna()))
    assert told(C.conf_blocked(sites, 4, block=4, chunk=16)) == want
    assert told(C.conf_blocked(sites, 4)) == want


def test_conf_blocked_sends_words(spark, sites, monkeypatch):
    """A pair's 16 counts below 256 leave Python as two numbers, at most 64 pairs in a row."""
    held, meet = [], C._meet
    monkeypatch.setattr(C, "_meet", lambda *a, **b: held.append(meet(*a, **b)) or held[-1])
    many = spark.range(2000 * 2).selectExpr("cast(id % 2000 as int) AS taxon", "cast(id div 2000 as int) AS site", "cast(id % 4 as int) AS state")
    C.conf_blocked(many, 4)
    sent = held[0].selectExpr("sum(size(js))", f"sum(size({held[0].columns[-1]}))", "max(size(js))").first()
    assert sent[0] == 1999000 and sent[1] == 2 * sent[0] and sent[2] <= 64


@pytest.mark.parametrize("states, times", [(4, 1), (3, 1), (5, 1), (2, 20), (4, 20), (5, 300)])
def test_conf_blocked_of_many_states_and_counts(spark, states, times):
    """Counts of one, two and four bytes, in words filled and not; as many taxa in a block as there are states."""
    rows = spark.range(states * 8 * 6).selectExpr(f"cast(id % {states * 8} as int) AS taxon", f"cast(id div {states * 8} as int) AS site", f"cast(crc32(cast(id as string)) % {states} as int) AS state")
    # Two taxa have cells that occur often.
    often = rows.withColumn("n", F.expr(f"if(taxon < 2, {times}, 1)")).selectExpr("taxon", "site", "state", "explode(sequence(1, n)) AS n").drop("n")
    assert told(C.conf_blocked(often, states, block=states, chunk=4)) == told(C.conf(often))


def test_shared_sites(spark, sites):
    want = told(C.valid_pairs(C.conf(sites.dropna())))
    assert told(C.shared_sites(sites, block=4, chunk=16)) == want
    assert told(C.shared_sites(sites)) == want


def test_null_components_count_as_lowest(spark):
    """As in SQL, where they fall to ELSE 0."""
    vectors = spark.createDataFrame([(1, [0.2, None, -0.05]), (2, [0.2, 0.05, None]), (3, None)], "vec_id bigint, embedding array<float>")
    assert told(C.conf_blocked(observe.of_vectors(vectors), 4)) == [(1, 2, 0, 2, 1), (1, 2, 1, 0, 1), (1, 2, 3, 3, 1)]


def test_mismatches_of_many_sites(spark):
    """Scores are looked up in another way where n passes 1023."""
    long = spark.range(3 * 2500).selectExpr("cast(id % 3 as int) AS taxon", "cast(id div 3 as int) AS site", "cast(crc32(cast(id as string)) % 4 as int) AS state")
    assert told(C.hamming_blocked(long)) == told(C.hamming(C.conf(long)).select("i", "j", "h"))


def test_rounded_as_in_spark(spark):
    """Halves of a seventh place too: 1 of 128."""
    rows = spark.range(2 * 128).selectExpr("cast(id % 2 as int) AS taxon", "cast(id div 2 as int) AS site", "cast(id = 1 as int) AS state")
    scored = C.pair_scores(rows, rounded(C.share)).withColumnRenamed("s", "h")
    assert told(scored) == told(ids(C.hamming(C.conf(rows)))) == [(0, 1, 0.007813)]


def test_no_rows(spark, sites):
    assert C.hamming_blocked(sites.where("false")).count() == 0
