import random
from itertools import combinations

from tallyloom.operators import rules


def brute(rows):
    predicates = []
    for f in range(len(rules.FEATURES)):
        v = sorted({x[f] for _, _, x in rows})
        predicates += [(f, op, (a + b) / 2) for op in ("lt", "gt") for a, b in zip(v, v[1:])]
    models = [None, [], *([p] for p in predicates), *([p, q] for p, q in combinations(predicates, 2) if p[0] != q[0])]
    fee = rules.PENALTY * sum(a for a, _, _ in rows)

    def cost(m):
        tries = [rules.accepts(m, x) for _, _, x in rows]
        return sum(max(0, a - b) if not t else max(0, b - a) for t, (a, b, _) in zip(tries, rows)) + fee * len(m or [])

    return min(range(len(models)), key=lambda i: (round(cost(models[i]), 6), i)), models, cost


def test_fits_equal_trying_every_rule():
    rnd = random.Random(5)
    for n in (1, 2, 5, 8):
        for _ in range(6):
            rows = [(rnd.randint(900, 1100), rnd.randint(900, 1100), [float(rnd.randint(0, 3)) for _ in rules.FEATURES]) for _ in range(n)]
            best, models, cost = brute(rows)
            got, rule = rules.fit(rows)
            assert rule == models[best] and abs(got - cost(models[best])) < 1e-6


def test_a_pair_of_any_thresholds_is_found(spark):
    # both features are needed; a line of 100, 200, 400, 800 or 1600 of one feature cannot tell the families
    rows = [(f"f{a}{b}", 1000, 500 if a > 3 and b < 4 else 1500, [float(a), 0.0, float(b), 0.0, 0.0, 0.0, 0.0]) for a in range(6) for b in range(6)]
    df = spark.createDataFrame([(f, i, c, *x) for f, i, c, x in rows], "family string, inline_bytes bigint, channel_bytes bigint, " + ", ".join(f"{f} double" for f in rules.FEATURES))
    got = rules.learned_rules(df).collect()
    whole = next(r for r in got if r.holdout is None)
    assert len(got) == 37 and (whole.feature1, whole.op1, whole.threshold1, whole.feature2, whole.op2, whole.threshold2) == ("side_density", "gt", 3.5, "mean_code", "lt", 3.5)
    assert all(r.decision == r.wins for r in got if r.holdout)
