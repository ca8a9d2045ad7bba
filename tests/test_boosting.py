"""Boosting on histograms against a plain version that looks at every split of every row."""

import random

import numpy as np
import pytest

from clonoscope.plans import boosting as B


def table(spark, n=120, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = [round(r.gauss(0, 1), 3), float(r.randint(0, 4)), r.random() < 0.5, 1.0]
        y = float((x[0] > 0.2) ^ (x[1] > 2) if r.random() < 0.9 else r.random() < 0.5)
        rows.append((i, [float(v) for v in x], y, i % 3))
    return rows, spark.createDataFrame(rows, "id long, features array<double>, label double, fold int").repartition(3)


def plain_fit(x, y, edges, s, trees):
    """Margins of all rows by one model that learns from all of them, every split tried by itself."""
    margin = np.zeros(len(x))
    splits = []

    def part(g, h):
        g = np.sign(g) * max(abs(g) - s.l1, 0)
        return g, h + s.l2

    def grow(rows, depth, g, h):
        own = part(g[rows].sum(), h[rows].sum())
        best = None
        if depth < s.depth:
            for f in range(x.shape[1]):
                for b, edge in enumerate(edges[f]):
                    left = rows & (x[:, f] <= edge)
                    right = rows & ~left
                    if min(h[left].sum(), h[right].sum()) < s.least:
                        continue
                    gain = round(0.5 * (sum(a * a / c for a, c in (part(g[left].sum(), h[left].sum()), part(g[right].sum(), h[right].sum()))) - own[0] ** 2 / own[1]) - s.gamma, 9)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, f, b, left, right)
        if best is None:
            margin[rows] += s.rate * -own[0] / own[1]
            return
        splits.append((best[1], best[2], best[0]))
        grow(best[3], depth + 1, g, h)
        grow(best[4], depth + 1, g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, s.positive, 1.0)
        grow(np.ones(len(x), dtype=bool), 0, w * (p - y), w * p * (1 - p))
    return margin, splits


@pytest.mark.parametrize("setting", [B.Setting(), B.Setting(depth=2, rate=0.3, l2=0.5, l1=0.4, gamma=0.05, least=2.0, positive=3.0)])
def test_as_every_split_tried(spark, setting, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", 2)
    rows, df = table(spark)
    model = B.fit(df, [setting], trees=5)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    margin, splits = plain_fit(x, y, model.edges, setting, 5)
    got = {r["id"]: r["probabilities"][0] for r in model.score(df).collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)
    ours = [(int(t.feature[i]), int(t.bin[i]), t.gain[i]) for t in model.trees[0] for i in range(len(t.feature)) if t.feature[i] >= 0]
    assert sorted(f"{f} {b} {g:.6f}" for f, b, g in ours) == sorted(f"{f} {b} {g:.6f}" for f, b, g in splits)
    assert model.importance().sum() == pytest.approx(1) and model.importance()[3] == 0


def test_models_of_one_pass_are_those_fitted_alone(spark):
    rows, df = table(spark, 90, seed=4)
    settings = [B.Setting(without=k, depth=d) for k, d in ((0, 1), (1, 3), (-1, 2))]
    together = {r["id"]: r["probabilities"] for r in B.fit(df, settings, trees=4).score(df).collect()}
    for m, s in enumerate(settings):
        alone = {r["id"]: r["probabilities"][0] for r in B.fit(df, [s], trees=4).score(df).collect()}
        assert {i: p[m] for i, p in together.items()} == pytest.approx(alone, abs=1e-12)
    kept = {r[0] for r in rows if r[3] != 0}
    without = {r["id"]: r["probabilities"][0] for r in B.fit(df.where("fold <> 0"), [B.Setting(depth=1)], trees=1).score(df.where("fold <> 0")).collect()}
    assert set(without) == kept


def test_shares_of_rows_and_columns():
    names = np.arange(20_000, dtype=np.int64)
    one, two = B._seen(names, 1, 0.8), B._seen(names, 2, 0.8)
    assert abs(one.mean() - 0.8) < 0.02 and abs((one & two).mean() - 0.64) < 0.02
    assert B._columns(10, 0, 0, 0.5).sum() == 5 and (B._columns(100, 0, 0, 0.5) != B._columns(100, 0, 1, 0.5)).any()
