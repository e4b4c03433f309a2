"""Risk-controlled thresholds against a plain version, and their guarantee."""

import collections
import random
from math import comb

from provisio.llm import rules


def make(spark, strata, n, seed):
    """Values of labelled documents: good ones are mostly low, each stratum in its own way; bad ones are higher."""
    rng, rows, labels = random.Random(seed), [], []
    for s in range(strata):
        scale = [rng.choice((2, 8, 20, 60)) for _ in rules.RULES]
        for _ in range(n):
            good = rng.random() < 0.7
            rows.append((len(rows), f"s{s}", *[min(1000, int(rng.expovariate(1 / (c if good else 6 * c)))) for c in scale]))
            labels.append((len(labels), int(good)))
    names = ", ".join(f"{r} int" for r in rules.RULES)
    return rows, labels, spark.createDataFrame(rows, f"doc_id long, stratum string, {names}"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_cutoffs_equal_a_plain_version(spark):
    rows, labels, values, table = make(spark, 3, 1500, 5)
    got = {r.stratum: r for r in rules.thresholds(values, table).collect()}
    halves = {r.doc_id: r.h for r in values.selectExpr("doc_id", "pmod(xxhash64(doc_id, 7), 2) AS h").collect()}
    good = dict(labels)
    for s in ("s0", "s1", "s2"):
        a, b = ([r for r in rows if r[1] == s and halves[r[0]] == h] for h in (0, 1))
        share = lambda part, hit, g: sum(hit(r) for r in part if good[r[0]] == g) / max(1, sum(good[r[0]] == g for r in part))
        proposed = []
        for level in rules.LEVELS:
            cut = {}
            for k, name in enumerate(rules.RULES):
                options = []
                for c in rules.GRID:
                    lost, caught = share(a, lambda r, k=k, c=c: r[2 + k] > c, 1), share(a, lambda r, k=k, c=c: r[2 + k] > c, 0)
                    if caught - rules.COST * lost > 0 and lost <= level:
                        options.append((caught - rules.COST * lost, c))
                if options:
                    cut[name] = max(options)[1]
            proposed.append(cut)
        n = sum(good[r[0]] for r in b)
        best = None
        for cut in proposed:
            hit = lambda r, cut=cut: any(r[2 + k] > cut.get(name, 10**6) for k, name in enumerate(rules.RULES))
            k = sum(hit(r) for r in b if good[r[0]])
            if k >= n * rules.RISK or sum(comb(n, j) * rules.RISK**j * (1 - rules.RISK) ** (n - j) for j in range(k + 1)) > 0.05 / 3:
                break
            gain = share(b, hit, 0) - rules.COST * k / n
            if best is None or gain > best[0] + 1e-12:
                best = (gain, cut, k)
        if best is None:
            assert s not in got
        else:
            assert {k: v for k, v in got[s].cutoffs.asDict().items() if v is not None} == best[1] and got[s].false_rejections == best[2] and got[s].n_good == n
    assert any(got[s].caught for s in got)


def test_risk_of_the_joint_verdict(spark):
    """Fresh good documents of each stratum: all rules together lose fewer than RISK, but for chance of the fresh sample."""
    strata = 16
    rows, labels, values, table = make(spark, strata, 3000, 11)
    cut = {r.stratum: {k: v for k, v in r.cutoffs.asDict().items() if v is not None} for r in rules.thresholds(values, table).collect()}
    lost = collections.Counter()
    rng = random.Random(11)
    for s in range(strata):
        scale = [rng.choice((2, 8, 20, 60)) for _ in rules.RULES]
        for _ in range(3000):  # the same draws, to stay in step with make()
            good = rng.random() < 0.7
            [rng.expovariate(1 / (c if good else 6 * c)) for c in scale]
        own = random.Random(1000 + s)
        for _ in range(5000):
            v = dict(zip(rules.RULES, [int(own.expovariate(1 / c)) for c in scale], strict=True))
            lost[s] += any(v[k] > c for k, c in cut.get(f"s{s}", {}).items())
    assert len(cut) > strata / 2 and sum(lost[s] / 5000 > rules.RISK + 0.006 for s in range(strata)) <= 0.05 * strata
