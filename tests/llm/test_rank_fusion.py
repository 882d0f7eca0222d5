import numpy as np

from tallyloom.llm import rank_fusion as f

SCORES = {"a": 1, "b": -1, "c": 1}


def fused(spark, rows):
    return {(r.g, r.i): round(r.projection, 6) for r in f.fuse_scores(spark.createDataFrame(rows, "g long, i string, a double, b double, c double, projection double"), "g", "i", SCORES).collect()}


def test_no_range_prevails(spark):
    rows = [(1, "x", 1.0, 1e9, 5.0, 0.0), (1, "y", 2.0, 1.0, 6.0, 0.0), (1, "z", 3.0, 5e8, 7.0, 0.0)]
    got = fused(spark, rows)
    scaled = fused(spark, [(g, i, a * 1e6, b / 1e3, c, 0.0) for g, i, a, b, c, _ in rows])
    assert got == scaled and max(got, key=got.get) in ((1, "z"), (1, "y"))


def test_missing_scores_stand_in_the_middle(spark):
    got = fused(spark, [(1, "x", None, 1.0, -1.0, 0.0), (1, "y", 1.0, None, None, 0.0), (2, "x", None, None, None, 0.0), (2, "y", 5.0, 5.0, 5.0, 0.0), (2, "z", 5.0, 5.0, 5.0, 0.0)])
    assert len(got) == 5 and got[2, "y"] == got[2, "z"] and all(np.isfinite(v) for v in got.values())
    assert fused(spark, []) == {}


def test_component():
    c = np.array([[1.0, 0.8], [0.8, 1.0]])
    w = f.first_component(c.tolist())
    assert abs(w[0] - w[1]) < 1e-9 and (w > 0).all()
    trade = np.array([[1.0, -0.6, 0.1], [-0.6, 1.0, 0.1], [0.1, 0.1, 1.0]])
    w = f.first_component(trade.tolist())
    assert (w >= 0).all() and abs(w[0] - w[1]) < 1e-9
    assert w[2] < 0.3 * w[0]  # signs are turned, sizes kept
    assert f.first_component([[0.0, 0.0], [0.0, 1.0]])[0] == 0.0
    assert f.first_component([[0.0]]).tolist() == [1.0]


def test_loadings_decide_the_first_place(spark):
    """Two scores move together, the third alone; x leads by the mean of the ranks, w by the component."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(2, 60):
        for i in range(8):
            v = float(rng.random()) + 1
            rows.append((g, f"n{i}", v, 1 / v, float(rng.random()) + 1, 0.0))
    # ranks of group 1 (best 3): w = (3, 3, 0), x = (2, 2, 3), y = (1, 1, 2), z = (0, 0, 1)
    rows += [(1, "w", 4.0, 1.0, 1.0, 0.0), (1, "x", 3.0, 2.0, 4.0, 0.0), (1, "y", 2.0, 3.0, 3.0, 0.0), (1, "z", 1.0, 4.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "g long, i string, a double, b double, c double, projection double")
    got = {r.i: r for r in f.fuse_scores(df, "g", "i", SCORES).filter("g = 1").collect()}
    assert max(got, key=lambda i: got[i].mean_rank) == "x" and max(got, key=lambda i: got[i].projection) == "w"
