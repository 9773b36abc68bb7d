import numpy as np
import pyarrow as pa

from marginalia.llm import embeds

from .helpers import components


def vectors():
    r = np.random.default_rng(3)
    rows = []
    for k in range(60):
        base = r.standard_normal(16)
        for c in (0.0, 0.05, 0.15, 0.25, 0.4)[: 1 + k % 5]:
            rows.append(base + c * np.linalg.norm(base) / 4 * r.standard_normal(16))
    x = [v.astype(np.float32).tolist() for v in rows]
    x += [x[0]] * 40 + [(2 * np.array(x[0], np.float32)).tolist()]
    return list(enumerate(x)) + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [-1.0, 2.0])]


def brute(rows):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = {i: [j for j, w in ok if j != i and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.95] for i, v in ok}
    comp = components([i for i, _ in rows], [(i, j) for i, js in links.items() for j in js])
    return {i: (len(links.get(i, [])), comp[i], comp[i] == i) for i, _ in rows}


def test_all_pairs(spark):
    rows = vectors()
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links int, component_id string")
    for block in (16, 512):
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeds.embedding_dedup(d, block=block).collect()} == brute(rows)


def test_empty_and_null_keys(spark):
    d = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in embeds.embedding_dedup(d).collect()) == [("1", 0, True), ("None", 0, True)]
    assert embeds.embedding_dedup(d.limit(0)).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_calibrated_recall_and_count():
    r = np.random.default_rng(6)
    x, zero = unit(r.standard_normal((500, 64))), np.zeros(64)
    few, many = embeds.calibrate(x, zero, 20_000, 0.95, 0.999, 4096), embeds.calibrate(x, zero, 10**9, 0.95, 0.999, 4096)
    assert few.joint == 1 and few.passing == 2 and many.joint > 1 and many.passing == many.joint + 1
    fresh = unit(r.standard_normal((1000, 64)))
    for plan in (few, many):  # measured on other vectors than those of the calibration
        (a, p), (b, q) = embeds.outermost(fresh, zero, 4096, plan.top), embeds.outermost(embeds.partners(fresh, 0.95, 9), zero, 4096, plan.top)
        lines, places, n = np.concatenate([a, b]), np.concatenate([p, q]), np.arange(1000)
        assert (embeds.collisions(lines, places, n, n + 1000, embeds.window(0.95)) >= plan.passing).mean() >= 0.995
    assert embeds.calibrate(x, zero, 1000, 0.95, 0.999, 1) is None


def test_windows_are_ranges_of_sorted_places():
    r = np.random.default_rng(2)
    unit_of = np.sort(r.integers(0, 9, 200))
    place = r.standard_normal(200)
    place = place[np.lexsort((place, unit_of))]
    got = [(i, j) for a, b in embeds.window_pairs(unit_of, place, 0.3, room=37) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(got) == [(i, j) for i in range(200) for j in range(i + 1, 200) if unit_of[i] == unit_of[j] and place[j] - place[i] <= 0.3]


def test_a_common_mean_costs_far_less_than_all_pairs():
    r = np.random.default_rng(7)
    common = r.standard_normal(64)
    x = unit(unit(r.standard_normal((4000, 64))) * 0.5 + common / np.linalg.norm(common))
    assert 0.7 < (x[:300] @ x[:300].T).mean() < 0.9
    plan = embeds.calibrate(x[:500], x.mean(0), len(x), 0.95, 0.999, 4096)
    lines, places = embeds.outermost(x, x.mean(0), 4096, plan.top)
    spot, place = lines.ravel(), places.ravel().astype(float)
    order = np.lexsort((place, spot))
    met = sum(len(i) for i, _ in embeds.window_pairs(spot[order].astype(np.int64), place[order], embeds.window(0.95)))
    assert plan.joint == 1 and met < 0.3 * len(x) * len(x) / 2


def test_all_pairs_with_a_common_mean_and_without_a_plan(spark):
    r = np.random.default_rng(8)
    base = r.standard_normal((150, 12)) * 0.4 + 1.5
    x = np.concatenate([base, base[:90] + 0.2 * r.standard_normal((90, 12))]).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for projections in (4096, 1):  # with one line no plan has the recall
        assert {v.vec_id: (v.n_links, v.component_id, v.kept) for v in embeds.embedding_dedup(d, projections=projections).collect()} == brute(rows)


def test_byte_copies_drop_no_near_pair():
    r = np.random.default_rng(4)
    for dim in (8, 64, 128, 384, 1536):
        signs = r.choice([-1.0, 1.0], (200, dim))
        flipped = signs * np.where(r.random((200, dim)) < 0.012, -1, 1)
        near = r.standard_normal((200, dim))
        x = np.concatenate([signs, flipped, near, near + 0.2 * r.standard_normal((200, dim))])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        i = np.concatenate([np.arange(200), np.arange(400, 600)])
        j = i + 200
        close = (x[i] * x[j]).sum(1) >= 0.95
        assert close.sum() > 200 and embeds.may_link(embeds.packed(x), i, j, 0.95)[close].all()
        assert not embeds.may_link(embeds.packed(x), np.arange(199), np.arange(1, 200), 0.95).all()


def test_no_link_is_lost_where_a_sample_tells_nothing(spark):
    r = np.random.default_rng(11)
    w = r.standard_normal((2500, 32))
    w[:, 0] = 0
    x = np.concatenate([0.7 * unit(w), [[0] * 9 + [0.155] + [0] * 22, [0] * 9 + [-0.155] + [0] * 22]])
    x[:, 0] = 1  # the two last ones lie on two sides of the mean, so that they have no outermost line in common
    rows = list(enumerate(x.tolist()))
    got = {v.vec_id: (v.n_links, v.component_id) for v in embeds.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: g for i, g in got.items() if g != (0, i)} == {2500: (1, 2500), 2501: (1, 2500)} and len(got) == 2502


def test_all_pairs_in_blocks(spark, monkeypatch):
    rows = vectors()
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for blocks in ((16, 250_000), (1, 40)):
        monkeypatch.setattr(embeds, "BLOCKS", blocks)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeds.embedding_dedup(d).collect()} == brute(rows)


def test_tiles_of_a_unit_connect_all_near_pairs():
    r = np.random.default_rng(12)
    base = r.standard_normal((2600, 24))
    x = unit(np.concatenate([base, base + 0.22 * r.standard_normal(base.shape)]))
    order = r.permutation(len(x))
    x = x[order]
    for one in (True, False):
        side = np.zeros(len(x), int) if one else r.integers(0, 2, len(x))
        t = pa.table({"node": np.arange(len(x)), "side": side, "bi": np.zeros(len(x), int), "bj": np.zeros(len(x), int) + (not one), "copy": embeds._binary(embeds.packed(x))})
        out = embeds._near(0.95)(t, np.zeros(len(x), int))
        root = np.arange(len(x))
        root[out.column(0).to_numpy()] = out.column(1).to_numpy()
        i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
        ok = one | (side[i] != side[j])
        assert ok.sum() > 800 and (root[i[ok]] == root[j[ok]]).all() and len(out) < 1.1 * ok.sum()


def test_collision_counting_on_demand(spark):
    rows = vectors()
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for projections in (4096, 1):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeds.embedding_dedup(d, recall=0.999, projections=projections).collect()}
        want = brute(rows)
        assert sum(g[0] for g in got.values()) >= 0.99 * sum(g[0] for g in want.values()) and got.keys() == want.keys()
