import numpy as np
import pytest

from sparkclade.functions import kernels as K
from sparkclade.functions import latent as L
from sparkclade.functions import metrics, models, scorers
from sparkclade.operators import metadata
from sparkclade.operators import reconstruct as R
from sparkclade.operators import simulate as M
from sparkclade.operators import trees as T


def similarity(kind, m, length, n, seed):
    rng = np.random.default_rng(seed)
    edges = M.tree_edges(kind, m, length, rng)
    x = models.evolve(edges, m, models.JukesCantor(4), n, rng)
    return np.maximum(metrics.jc(x, 4), 1e-6), K.splits(edges, m)


def test_neighbor_joining_recovers_simulated_caterpillar():
    s, truth = similarity("caterpillar", 16, 0.1, 2000, 345)
    assert K.splits(K.neighbor_joining(-np.log(s)), 16) == truth


def test_spectral_joining_recovers_simulated_caterpillar():
    s, truth = similarity("caterpillar", 12, 0.1, 5000, 345)
    assert K.splits(K.spectral_joining(s), 12) == truth


@pytest.mark.parametrize("score", ["least_square", "angle"])
def test_divide_and_merge_recovers_caterpillar(score):
    s, truth = similarity("caterpillar", 32, 0.05, 6000, 789)
    solved = {name: (ids, K.INNER["nj"](s[np.ix_(ids, ids)]) if len(ids) > 1 else []) for name, ids in K.parts_of(s, 16, 5)}
    assert len(solved) > 1
    assert K.splits(K.merge_parts(solved, s, score), 32) == truth


def test_quartet_identity():
    m = np.random.default_rng(1).random((4, 6))
    minors = sum((m[i, j] * m[k, l] - m[i, l] * m[k, j]) ** 2 for i in range(4) for k in range(i + 1, 4) for j in range(6) for l in range(j + 1, 6))
    assert np.isclose(K.squared_quartets(m) * (m**2).sum() / 2, minors)


def test_bad_inputs_raise():
    with pytest.raises(ValueError):
        M.tree_edges("balanced", 6, 1.0, np.random.default_rng(0))
    with pytest.raises(ValueError):
        K.edge_score(np.ones(2), np.ones(2), "tensor")
    with pytest.raises(ValueError):
        K.partition(np.ones((3, 3)), least=2)


def test_kingman_and_birth_death_have_all_leaves():
    for make in (K.kingman, K.birth_death):
        edges = make(9, np.random.default_rng(4))
        assert {c for c, _, _ in edges if c < 9} == set(range(9)) and len(edges) == 16 and all(w >= 0 for *_, w in edges)


def test_transition_rows_sum_to_one_and_rates_are_scaled():
    model = models.gtr([0.1, 0.2, 0.3, 0.4], [1.0, 2.0, 1.0, 1.0, 2.0, 1.0])
    flow = model.q * model.pi[:, None]
    assert np.allclose(model.matrix(0.7).sum(axis=1), 1) and np.isclose(-np.diag(flow).sum(), 1) and np.allclose(flow, flow.T)
    assert np.allclose(model.matrix(0.3) @ model.matrix(0.4), model.matrix(0.7)) and np.isclose(model.length(model.distance(0.7, 0.2), 0.2), 0.7)
    assert np.isclose(np.linalg.det(model.matrix(0.7)), model.similarity(0.7))


def test_models_refuse_what_is_no_distribution():
    for bad in (lambda: models.Fixed([1, 1], [[0.5, 0.6], [0.5, 0.5]]), lambda: models.Fixed([1, 1], [[1.0]]), lambda: models.ContinuousTime([1, 1], [[1, 0], [0, 1]]), lambda: models.Discrete([-1, 2]), lambda: models.preset("no such")):
        with pytest.raises(ValueError):
            bad()
    jc = models.JukesCantor(4)
    assert np.isclose(jc.stay(jc.time(0.95)), 0.95) and np.isclose(jc.matrix(0.3)[0, 0], jc.stay(0.3))


def test_gamma_blocks_have_rates_of_their_own():
    rng = np.random.default_rng(2)
    x = models.evolve(M.tree_edges("balanced", 2, 1.0, rng), 2, models.JukesCantor(4), 4000, rng, shape=0.3, block=100)
    differ = (x[0] != x[1]).reshape(-1, 100).mean(axis=1)
    assert differ.std() > 0.15


@pytest.mark.parametrize("name", scorers.NAMES)
def test_every_scorer_is_a_number(name):
    rng = np.random.default_rng(1)
    for shape in ((2, 5), (3, 3), (1, 4)):
        assert np.isfinite(scorers.by_values(name)(rng.random(shape))) or name == "gap_root"


def test_scorers_by_definition():
    m = np.random.default_rng(4).random((3, 4))
    sv = np.linalg.svd(m, compute_uv=False)
    minors = [m[i, j] * m[k, l] - m[i, l] * m[k, j] for i in range(3) for k in range(i + 1, 3) for j in range(4) for l in range(j + 1, 4)]
    want = {"second": sv[1], "minors": sum(x * x for x in minors), "max_quartet": max(map(abs, minors)), "rest_squares": (m**2).sum() - sv[0] ** 2, "squared_quartets": K.squared_quartets(m)}
    assert all(np.isclose(scorers.by_values(k)(m), v) for k, v in want.items())
    assert np.allclose(K.second_singulars(np.random.default_rng(0).random((3, 20, 30))), [K.second_singular(b) for b in np.random.default_rng(0).random((3, 20, 30))])


@pytest.mark.parametrize("m, a", [(40, 18), (50, 33), (70, 35)])
def test_scores_of_unions_with_each_taxon_are_those_of_the_blocks(m, a):
    rng = np.random.default_rng(m)
    x = rng.random((m, m))
    s, clade = np.exp(-x - x.T), sorted(rng.choice(m, a, replace=False).tolist())
    others = np.array([k for k in range(m) if k not in clade])
    want = [K.second_singular(s[np.ix_(sorted([*clade, k]), [j for j in others if j != k])]) for k in others]
    assert np.allclose(K.with_each(s, clade, others), want, atol=1e-9)
    # Of a clade of an exact tree the union with the next taxon has rank one.
    s = np.exp(-K.patristic(M.tree_edges("caterpillar", m, 0.1, rng), m))
    found = K.with_each(s, list(range(m - a, m)), np.arange(m - a))
    assert np.argmin(found) == m - a - 1 and found[m - a - 1] < 1e-6


def test_metric_repair_against_shortest_paths():
    rng = np.random.default_rng(3)
    d = rng.random((7, 7)) ** 3
    got, want = K.metric_repair(d), np.minimum(d, d.T)
    np.fill_diagonal(want, 0)
    for _ in range(7):
        want = np.minimum(want, (want[:, :, None] + want[None]).min(axis=1))
    assert np.allclose(got, want)


def test_own_scorers_and_metrics_can_be_registered():
    s, truth = similarity("balanced", 8, 0.1, 6000, 5)
    R.register_scorer("mine", lambda block: K.second_singular(block) * 2)
    R.register_metric("mine", lambda x: metrics.jc(x, 4))
    assert K.splits(R.METHODS["snj_mine"](s), 8) == truth == K.splits(K.spectral_joining(s), 8)
    assert "mine" in metrics.METRICS
    with pytest.raises(ValueError):
        R.similarity_of(np.zeros((2, 2)), "no such")


def test_metrics_agree_with_what_they_estimate():
    rng = np.random.default_rng(3)
    edges = M.tree_edges("balanced", 4, 0.1, rng)
    d = K.patristic(edges, 4)
    jc = models.JukesCantor(4)
    x = models.evolve(edges, 4, jc, 200_000, rng)
    assert np.allclose(metrics.jc(x, 4), jc.similarity(d), atol=0.02) and np.allclose(metrics.paralinear(x), jc.similarity(d), atol=0.02)
    y = models.evolve(edges, 4, models.hky(2.0), 200_000, rng)
    assert np.allclose(metrics.hky(y), models.hky(2.0).similarity(d), atol=0.03)
    assert np.allclose(metrics.hamming(x), [[np.mean(a != b) for b in x] for a in x])


def test_spanning_tree_and_linkage_against_plain_loops():
    rng = np.random.default_rng(7)
    d = rng.random((9, 9))
    d = d + d.T
    inside, total = {0}, 0.0
    while len(inside) < 9:
        w, v = min((d[u, v], v) for u in inside for v in range(9) if v not in inside)
        total += w
        inside.add(v)
    assert np.isclose(sum(w for *_, w in K.spanning_tree(d)), total)
    for how, pick in (("single", np.max), ("complete", np.min), ("average", np.mean)):
        groups, joined = [[i] for i in range(9)], []
        while len(groups) > 1:
            _, a, b = max((float(pick(d[np.ix_(groups[a], groups[b])])), -a, -b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
            one, two = groups[-a], groups[-b]
            joined.append(frozenset(one + two))
            groups = [g for g in groups if g not in (one, two)] + [one + two]
        below: dict[int, frozenset] = {i: frozenset([i]) for i in range(9)}
        for c, p, _ in K.linkage(d, how):
            below[p] = below.get(p, frozenset()) | below[c]
        assert {below[p] for p in below if p >= 9} == set(joined)


@pytest.mark.parametrize("kind", ["angle", "normalized_least_square", "global_diff", "longest_branch"])
def test_merge_scores_find_the_root_edges(kind):
    edges = M.tree_edges("balanced", 16, 0.2, np.random.default_rng(0))
    s = np.exp(-K.patristic(edges, 16))
    assert K.splits(K.divided(s, "nj", 8, kind=kind), 16) == K.splits(edges, 16)


def test_grouping_tolerates_noise_and_contracts_weak_edges():
    # Of a clock-like tree a hidden node is as near to one leaf as to another, and spanning trees are arbitrary.
    rng = np.random.default_rng(3)
    edges = [(c, p, float(rng.uniform(0.4, 0.8))) for c, p, _ in M.tree_edges("balanced", 8, 0.5, rng)]
    d = K.patristic(edges, 8)
    noise = rng.normal(0, 0.005, d.shape)
    d = np.maximum(d + noise + noise.T, 0)
    np.fill_diagonal(d, 0)
    for f in (L.relaxed_grouping, L.observed_neighbor_joining, lambda x: L.spanning_then(x, L.relaxed_grouping), lambda x: L.spanning_then(x, L.observed_neighbor_joining)):
        assert K.splits(f(d), 8) <= K.splits(edges, 8)
    assert K.splits(L.relaxed_grouping(d), 8) == K.splits(edges, 8)
    assert L.consistent(np.array([[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0]], dtype=bool)) == (True, [[0, 1], [2, 3]])


def test_latent_classes_are_counted():
    rng = np.random.default_rng(6)
    z = rng.integers(0, 3, 6000)
    x = np.stack([(rng.random(6000) < np.array([0.05, 0.5, 0.95])[z]).astype(int) for _ in range(8)], axis=1)
    patterns, weight = np.unique(x, axis=0, return_counts=True)
    assert L.latent_class_by_bic(L.evidence(patterns, [2] * 8), weight.astype(float), restarts=4)[0] == 3
    f = L.chow_liu(patterns, weight.astype(float), [2] * 8)
    back = L.sampled(f, 20_000, rng)
    assert np.allclose(back.mean(axis=0), x.mean(axis=0), atol=0.03)


def test_trees_of_any_depth(spark):
    members = T.clades(T.caterpillar(spark, 200, 1.0)).groupBy("node").count().collect()
    assert sorted(r["count"] for r in members) == sorted([1] * 200 + list(range(2, 201)))
    assert T.patristic(T.caterpillar(spark, 130, 1.0)).agg({"hops": "max"}).first()[0] == 130


def test_metadata_refuses_what_it_lacks(spark):
    taxa = metadata.default_taxa(spark, 4)
    known, unknown = (spark.createDataFrame([(x,)], "label string") for x in ("T1", "no such"))
    for f in (lambda: metadata.mask_of(taxa, unknown), lambda: metadata.leaves(taxa, unknown), lambda: metadata.sub_metadata(taxa, unknown), lambda: metadata.invert_mask(metadata.mask_of(taxa, known), metadata.mask_of(taxa, spark.createDataFrame([("T2",)], "label string"))), lambda: T.merge_children(taxa, [], 9), lambda: T.set_lengths(taxa)):
        with pytest.raises(ValueError):
            f()


def test_recursive_partition_by_every_way():
    edges = M.tree_edges("balanced", 16, 0.25, np.random.default_rng(0))
    s = np.exp(-K.patristic(edges, 16))
    for how in K.DIVISIONS:
        first = K.recursive_partition(s, 4, how)[0]
        assert {frozenset(first[1]), frozenset(first[2])} == {frozenset(range(8)), frozenset(range(8, 16))}


def test_permuting_taxa_permutes_splits():
    s, _ = similarity("balanced", 8, 0.1, 3000, 5)
    perm = np.random.default_rng(0).permutation(8)
    a, b = K.splits(K.neighbor_joining(-np.log(s)), 8), K.splits(K.neighbor_joining(-np.log(s[np.ix_(perm, perm)])), 8)
    back = {frozenset(perm[i] for i in side) for side in b}
    assert a == {frozenset(range(8)) - x if 0 in x else x for x in back}


def test_fasta_and_phylip(spark, tmp_path):
    from sparkclade.sources import observe

    (tmp_path / "a.fasta").write_text(">x 1\nACG\nT-\n>y\nGG\nAAA\n")
    rows = {r["label"]: r["seq"] for r in observe.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert rows == {"x 1": "ACGT-", "y": "GGAAA"}
    lines = [r["value"] for r in observe.phylip(observe.read_fasta(spark, str(tmp_path / "a.fasta"))).orderBy("ix", "value").collect()]
    assert lines == ["2 5", "x_1 ACGT-", "y GGAAA"]


def test_streaming_counts(spark, tmp_path):
    from sparkclade.streaming.incremental import conf_stream

    spark.sql("SELECT id AS site, map(0, cast(id % 2 as int), 1, 1) AS states FROM range(6)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("site bigint, states map<int,int>").parquet(str(tmp_path / "in"))
    q = conf_stream(stream).writeStream.outputMode("complete").format("memory").queryName("conf_now").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("conf_now").collect()} == {(0, 1, 0, 1, 3), (0, 1, 1, 1, 3)}
