import math
import random
from dataclasses import asdict, replace
from statistics import NormalDist

import duckdb
import pytest
from conftest import rows_of

from cohortweave.operators import boosting
from cohortweave.operators import gradient_trees as gt
from cohortweave.operators.cohort import OUTCOME
from cohortweave.plans.build import CohortBuild
from cohortweave.plans.catalog import all_queries
from cohortweave.settings import CohortSettings

FEATURES = ["signal", "noise", "age", "rare"]


def invented(n, seed=0):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(draw.random() < 0.3)
        hit = int(draw.random() < (0.8 if y else 0.2))
        age = None if i % 37 == 5 else float(draw.randint(20, 60) + 8 * y * draw.randint(0, 1))
        rows.append((i, None if i >= n - 40 else y, hit, draw.randint(0, 1), age, int(draw.random() < 0.1)))
    return rows


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame(
        invented(400), f"person_id bigint, {OUTCOME} int, signal int, noise int, age double, rare int"
    ).cache()


def labelled(matrix, held_out=True):
    rows = matrix.filter(f"{OUTCOME} IS NOT NULL")
    return rows.selectExpr("*", f"person_id % 4 = 0 AND {str(held_out).lower()} AS is_holdout")


def plain_boosting(rows, params, edges, rounds, patience=10):
    """Trees, round of the best AUC and that AUC; rows are (values, label, held out)."""
    margins, trees, best = [0.0] * len(rows), [], (0, None)
    bins = [[sum(v is not None and v > e for e in es) for v, es in zip(values, edges)] for values, _, _ in rows]

    def term(g, h):
        return max(abs(g) - params.reg_alpha, 0) ** 2 / (h + params.reg_lambda) if h + params.reg_lambda > 0 else 0.0

    for tree in range(rounds):
        weights = [params.scale_pos_weight if y else 1 for _, y, _ in rows]
        p = [1 / (1 + math.exp(-m)) for m in margins]
        g = [round(w * (q - y) * gt.UNITS) for w, q, (_, y, _) in zip(weights, p, rows)]
        h = [round(w * q * (1 - q) * gt.UNITS) for w, q in zip(weights, p)]
        allowed = gt.drawn_features(params, tree, len(edges))
        nodes, at = {}, [1] * len(rows)
        for depth in range(params.max_depth + 1):
            for node in sorted({n for n, r in zip(at, rows) if n not in nodes and not r[2]}):
                mine = [i for i, n in enumerate(at) if n == node and not rows[i][2]]
                gs, hs = sum(g[i] for i in mine) / gt.UNITS, sum(h[i] for i in mine) / gt.UNITS
                options = []
                for f in allowed:
                    for b in range(1, len(edges[f]) + 1):
                        right = [i for i in mine if bins[i][f] >= b]
                        if not any(bins[i][f] == b for i in mine) or len(right) == len(mine):
                            continue
                        gr, hr = sum(g[i] for i in right) / gt.UNITS, sum(h[i] for i in right) / gt.UNITS
                        gain = term(gs - gr, hs - hr) + term(gr, hr) - term(gs, hs)
                        if min(hr, hs - hr) >= params.min_child_weight and gain > max(params.gamma, gt.LEAST_GAIN):
                            options.append((round(gain, 9), -f, -b, gain))
                weight = hs + params.reg_lambda
                value = -math.copysign(max(abs(gs) - params.reg_alpha, 0), gs) / weight if weight > 0 else 0.0
                if options and depth < params.max_depth:
                    _, f, b, gain = max(options)
                    nodes[node] = (-f, -b, gain, hs, gt.LEARNING_RATE * value, False)
                else:
                    nodes[node] = (None, None, None, hs, gt.LEARNING_RATE * value, True)
            at = [n if nodes.get(n, (0,) * 6)[5] or n not in nodes else 2 * n + (bins[i][nodes[n][0]] >= nodes[n][1]) for i, n in enumerate(at)]
        margins = [m + (nodes[n][4] if n in nodes else 0.0) for m, n in zip(margins, at)]
        trees.append(nodes)
        held = [(m, y) for m, (_, y, out) in zip(margins, rows) if out]
        pos, neg = [m for m, y in held if y], [m for m, y in held if not y]
        if pos and neg:
            auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
            if best[1] is None or auc > best[1]:
                best = (tree + 1, auc)
            if tree + 1 - best[0] >= patience:
                break
    return trees, best, margins


BASE = gt.TreeParams(max_depth=3, gamma=0.5, reg_alpha=1, reg_lambda=0.7, min_child_weight=2, scale_pos_weight=3, n_estimators=3)
VARIANTS = {
    "base": {}, "max_depth": {"max_depth": 1}, "gamma": {"gamma": 30.0}, "reg_alpha": {"reg_alpha": 25},
    "reg_lambda": {"reg_lambda": 40.0}, "colsample_bytree": {"colsample_bytree": 0.5}, "min_child_weight": {"min_child_weight": 30},
    "scale_pos_weight": {"scale_pos_weight": 8},
}


@pytest.fixture(scope="module")
def fitted(matrix):
    """All variants, fitted side by side."""
    rows, edges = boosting.training_rows(labelled(matrix), FEATURES)
    settings = {i: replace(BASE, **v) for i, v in enumerate(VARIANTS.values())}
    return edges, {f.number: f for f in gt.Boosting(rows, edges, settings).run()}


@pytest.mark.parametrize("number, name", list(enumerate(VARIANTS)))
def test_trees_equal_plain_boosting(matrix, fitted, number, name):
    edges, fits = fitted
    fit = fits[number]
    rows = [(list(r)[2:6], r[1], r["is_holdout"]) for r in labelled(matrix).collect()]
    trees, best, _ = plain_boosting(rows, fit.params, edges, 3)
    found = {(n[1], n[2]): n[3:5] + n[6:] for n in fit.nodes}
    expected = {(t, n): v for t, nodes in enumerate(trees) for n, v in nodes.items()}
    assert found.keys() == expected.keys()
    for key, (f, b, *numbers) in expected.items():
        assert found[key][:2] == (f, b) and found[key][2:] == pytest.approx(tuple(numbers))
    assert (fit.best_round, fit.best_auc) == (best[0], pytest.approx(best[1]))
    # every sampled parameter changes the trees
    assert number == 0 or found != {(n[1], n[2]): n[3:5] + n[6:] for n in fits[0].nodes}


def test_fit_ends_ten_rounds_after_the_best_auc(matrix):
    rows, edges = boosting.training_rows(labelled(matrix), FEATURES)
    params = gt.TreeParams(max_depth=2, n_estimators=40, scale_pos_weight=3)
    (fit,) = gt.Boosting(rows, edges, {0: params}).run(patience=4)
    plain_rows = [(list(r)[2:6], r[1], r["is_holdout"]) for r in labelled(matrix).collect()]
    trees, best, _ = plain_boosting(plain_rows, params, edges, 40, patience=4)
    assert (fit.best_round, fit.best_auc, fit.rounds) == (best[0], pytest.approx(best[1]), len(trees))
    assert fit.rounds == fit.best_round + 4 < 40
    assert {n[1] for n in fit.kept_nodes()} == set(range(fit.best_round))


def test_model_without_gain_settles(matrix):
    rows, edges = boosting.training_rows(labelled(matrix, held_out=False), FEATURES)
    (fit,) = gt.Boosting(rows, edges, {0: gt.TreeParams(reg_alpha=100_000)}).run()
    assert fit.rounds == fit.best_round == 1 and len(fit.nodes) == 1 and fit.nodes[0][8] == 0


@pytest.fixture(scope="module")
def model(matrix):
    return boosting.fit_boosted_trees(labelled(matrix, held_out=False), BASE, FEATURES)


def test_scores_equal_plain_boosting(matrix, model):
    rows, edges = boosting.training_rows(labelled(matrix, held_out=False), FEATURES)
    people = matrix.collect()
    both = [(list(r)[2:], r[1] or 0, r[1] is None) for r in people]  # unlabelled rows shape no tree
    _, _, margins = plain_boosting(both, BASE, edges, 3, patience=99)
    scores = {r[0]: r[1:] for r in gt.scores(matrix, model, FEATURES).collect()}
    assert len(scores) == 400
    for r, m in zip(people, margins):
        p = 1 / (1 + math.exp(-m))
        assert scores[r[0]] == (pytest.approx(p), round(p))


def test_walk_and_importance_equal_sql_over_the_stored_nodes(matrix, model):
    con = duckdb.connect()
    con.register("nodes", model.toPandas())
    con.register("people", matrix.toPandas())
    walked = con.execute(
        f"""
        WITH RECURSIVE x AS (SELECT person_id, [{", ".join(FEATURES)}]::DOUBLE[] AS x FROM people),
        place AS (
          SELECT person_id, x, tree, 1::BIGINT AS node FROM x, (SELECT DISTINCT tree FROM nodes)
          UNION ALL
          SELECT person_id, x, p.tree,
            2 * p.node + CASE WHEN NOT isnan(x[feature::BIGINT + 1]) AND x[feature::BIGINT + 1] > threshold THEN 1 ELSE 0 END
          FROM place p JOIN nodes n ON n.tree = p.tree AND n.node = p.node AND NOT n.is_leaf
        )
        SELECT person_id, 1 / (1 + exp(-sum(value))) FROM place JOIN nodes USING (tree, node) WHERE is_leaf GROUP BY 1
        """
    ).fetchall()
    found = {r[0]: r[1] for r in gt.scores(matrix, model, FEATURES).collect()}
    assert found == pytest.approx(dict(walked))
    used = con.execute("SELECT feature, avg(gain), count(*), avg(cover) FROM nodes WHERE NOT is_leaf GROUP BY 1").fetchall()
    expected = {FEATURES[int(f)]: (pytest.approx(g), n, pytest.approx(c)) for f, g, n, c in used}
    importance = gt.importance(model, FEATURES).collect()
    assert {r[0]: tuple(r[1:]) for r in importance} == expected
    assert importance[0]["feature"] == "signal"
    assert [r[0] for r in gt.importance(model, FEATURES, top=1).collect()] == ["signal"]


def test_nodes_beyond_the_broadcast_limit_are_joined(matrix, model, monkeypatch):
    near = rows_of(gt.scores(matrix, model, FEATURES))
    monkeypatch.setattr(gt, "fits_broadcast", lambda df: False)
    assert rows_of(gt.scores(matrix, model, FEATURES)) == near


def test_auc_of_groups(frame):
    draw = random.Random(2)
    rows = [(g, int(draw.random() < 0.4), draw.choice([-3.0, -0.5, 0.0, 0.25, 2.0, draw.gauss(0, 2)])) for g in (1, 2) for _ in range(300)]
    rows += [(3, 1, 0.5), (3, 1, -0.5)]
    got = {r[0]: r for r in gt.grouped_auc(frame("fit int, label int, margin double", rows), "fit", "label", "margin").collect()}
    for g in (1, 2):
        pos, neg = ([m for f, y, m in rows if f == g and y == want] for want in (1, 0))
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
        assert got[g]["auc"] == pytest.approx(auc)
        assert (got[g]["tp"], got[g]["fp"]) == (sum(m > 0 for m in pos), sum(m > 0 for m in neg))
    assert (got[3]["auc"], got[3]["pos"], got[3]["neg"], got[3]["tp"]) == (None, 2, 0, 1)


def test_grid_is_seeded_and_within_the_space():
    grid = boosting.sample_param_grid(200, seed=3)
    assert grid == boosting.sample_param_grid(200, seed=3) != boosting.sample_param_grid(200, 4)
    assert {p.scale_pos_weight for p in grid} == {4, 5, 6, 7, 8}
    assert {p.max_depth for p in grid} == set(range(3, 19))
    assert all(0.5 <= p.colsample_bytree <= 1 and 1 <= p.gamma <= 9 for p in grid)
    assert all(40 <= p.reg_alpha <= 180 and 0 <= p.reg_lambda <= 1 for p in grid)
    assert {p.n_estimators for p in grid} == {180}


def test_draws_equal_sql():
    hexed = "list_reduce(list_transform(range(1, 14), lambda i: (instr('0123456789abcdef', substr(md5('3:' || t || ':gamma'), i, 1)) - 1)::BIGINT), lambda a, b: a * 16 + b)"
    found = duckdb.execute(f"SELECT 1 + 8 * ({hexed} / 4503599627370496.0) FROM range(20) r(t) ORDER BY t").fetchall()
    assert [r[0] for r in found] == pytest.approx([p.gamma for p in boosting.sample_param_grid(20, 3)], rel=1e-15)


def history(n, seed=1):
    draw = random.Random(seed)
    points = boosting.sample_param_grid(n)
    return [{"trial": i, "loss": abs(p.gamma - 3) / 10 + abs(p.max_depth - 6) / 40 + draw.random() / 100, **asdict(p)} for i, p in enumerate(points)]


def test_proposals_equal_plain_parzen_windows():
    past = history(40)
    got = boosting.propose(40, past)
    ranked = sorted(past, key=lambda r: (r["loss"], r["trial"]))

    def bells(values, low, high):
        centres = sorted(values + [(low + high) / 2])
        for i, c in enumerate(centres):
            left = c - (centres[i - 1] if i else low)
            right = (centres[i + 1] if i + 1 < len(centres) else high) - c
            width = high - low if c == (low + high) / 2 else max(left, right, (high - low) / min(100, 1 + len(centres)))
            bell = NormalDist(c, min(width, high - low))
            yield bell, bell.cdf(low), bell.cdf(high)

    for name, (low, high) in boosting.REAL.items():
        good = list(bells([r[name] for r in ranked[:10]], low, high))
        rest = list(bells([r[name] for r in ranked[10:]], low, high))
        points = []
        for i in range(24):
            bell, a, b = good[int(boosting.uniform(0, 40, f"{name}:{i}:which") * len(good))]
            points.append(min(max(bell.inv_cdf(a + boosting.uniform(0, 40, f"{name}:{i}") * (b - a)), low), high))

        def ratio(x):
            return (sum(k.pdf(x) / (b - a) for k, a, b in good) / len(good)) / (sum(k.pdf(x) / (b - a) for k, a, b in rest) / len(rest))

        assert getattr(got, name) == pytest.approx(max(points, key=ratio))
    assert got == boosting.propose(40, list(reversed(past))) != boosting.propose(41, past)
    assert boosting.propose(5, past[:5]) == boosting.random_point(5)


def test_proposals_stay_in_the_space_and_near_good_trials():
    past = history(60)
    found = [boosting.propose(60 + i, past) for i in range(60)]
    for p in found:
        assert 3 <= p.max_depth <= 18 and 40 <= p.reg_alpha <= 180 and 0 <= p.min_child_weight <= 10
        assert 1 <= p.gamma <= 9 and 0 <= p.reg_lambda <= 1 and 0.5 <= p.colsample_bytree <= 1
        assert p.scale_pos_weight in boosting.POS_WEIGHTS
    drawn = boosting.sample_param_grid(60, seed=9)
    assert sum(abs(p.gamma - 3) for p in found) < 0.7 * sum(abs(p.gamma - 3) for p in drawn)


def test_tune_ranks_trials_and_returns_values(matrix):
    grid = [
        gt.TreeParams(max_depth=2, n_estimators=3, scale_pos_weight=4),
        gt.TreeParams(max_depth=2, n_estimators=3, gamma=1e6, scale_pos_weight=7),
    ]
    trials = boosting.tune(matrix, grid, CohortSettings())
    rows = trials.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0]["loss"] < rows[1]["loss"]
    assert rows[1]["auc_hard"] == 0.5 and rows[1]["auc_score"] == 0.5  # no split is worth that much
    assert 1 <= rows[0]["best_round"] <= 3 and rows[0]["auc_score"] > 0.6
    assert boosting.best_params(trials) == grid[0]


def test_search_looks_back_and_goes_on_from_stored_trials(matrix, tmp_path, monkeypatch):
    monkeypatch.setattr(boosting, "STARTUP_TRIALS", 3)
    settings = CohortSettings(trials=6, trees=2)
    run, begun = gt.Boosting.run, []

    def counted(self, *more):
        begun.extend(f.number for f in self.fits)
        if begun.count(4) == 1 and 4 in [f.number for f in self.fits]:
            raise RuntimeError("lost")
        return run(self, *more)

    monkeypatch.setattr(gt.Boosting, "run", counted)
    with pytest.raises(RuntimeError, match="lost"):
        boosting.tune(matrix, None, settings, store=str(tmp_path), at_once=2)
    found = boosting.tune(matrix, None, settings, store=str(tmp_path), at_once=2).orderBy("trial").collect()
    assert begun == [0, 1, 2, 3, 4, 5, 4, 5]
    past = [r.asDict() for r in found]
    for i, r in enumerate(past):
        point = boosting.propose(i, past[: i - i % 2], n_estimators=2)
        assert asdict(point).items() <= r.items()
    assert {p["n_estimators"] for p in past} == {2}


@pytest.mark.parametrize("name", ["tuning_trials", "risk_scores", "feature_importance"])
def test_model_queries_do_the_whole_search(spark, matrix, monkeypatch, name):
    seen = {}

    def searched(matrix, grid, settings, store):
        seen["search"] = (grid, settings.trials, settings.trees)
        return spark.createDataFrame([{"rank": 1, **asdict(replace(BASE, gamma=2.5))}])

    def fitted(self, matrix, params, store):
        seen["params"] = params
        nodes = boosting.fit_boosted_trees(labelled(matrix, held_out=False), replace(BASE, n_estimators=1), FEATURES)
        return nodes, FEATURES, matrix

    monkeypatch.setattr(CohortBuild, "model_matrix", property(lambda self: matrix))
    monkeypatch.setattr(CohortBuild, "fit_final", fitted)
    monkeypatch.setattr(boosting, "tune", searched)
    assert all_queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert seen["search"] == (None, 100, 180)
    assert name == "tuning_trials" or seen["params"] == replace(BASE, gamma=2.5)


def test_rows_are_held_once_and_auc_is_counted_for_rounds_together(matrix, monkeypatch):
    rows, edges = boosting.training_rows(labelled(matrix), FEATURES)
    settings = {i: gt.TreeParams(max_depth=2, n_estimators=40, scale_pos_weight=3 + i) for i in range(3)}
    boosted = gt.Boosting(rows, edges, settings)
    assert boosted._state.count() == rows.count()
    counted, held_out = [], gt.Boosting._held_out
    monkeypatch.setattr(gt.Boosting, "_held_out", lambda self, *more: counted.append(1) or held_out(self, *more))
    fits = boosted.run(patience=4)
    # the first four rounds cannot end a fit
    assert len(counted) <= max(f.rounds for f in fits) - 4
    assert boosted._state.count() == rows.count()


@pytest.mark.parametrize("waiting, batch", [(1, 10_000), (5_000, 7)])
def test_written_scores_and_small_batches_give_the_same_trees(spark, matrix, fitted, monkeypatch, waiting, batch):
    edges, fits = fitted
    rows, _ = boosting.training_rows(labelled(matrix), FEATURES)
    monkeypatch.setattr(gt, "WAITING_ROWS", waiting)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        again = gt.Boosting(rows, edges, {n: f.params for n, f in fits.items()}).run()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {f.number: (f.nodes, f.best_round, f.best_auc, f.confusion) for f in again} == {
        n: (f.nodes, f.best_round, f.best_auc, f.confusion) for n, f in fits.items()
    }


def test_fit_without_features_or_training_rows(spark, matrix):
    rows, edges = boosting.training_rows(labelled(matrix, held_out=False), [])
    (fit,) = gt.Boosting(rows, edges, {0: replace(BASE, n_estimators=2)}).run()
    assert fit.rounds == 2 and [n[9] for n in fit.nodes] == [True, True]
    none = labelled(matrix).filter("is_holdout")
    rows, edges = boosting.training_rows(none, FEATURES)
    (fit,) = gt.Boosting(rows, edges, {0: replace(BASE, n_estimators=2)}).run()
    assert fit.nodes == [] and fit.best_auc == 0.5
