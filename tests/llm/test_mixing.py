import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tokenframe.llm import mixing as M

from .fixtures import documents, empty, rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 4)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_knapsack(items, budget):
    lengths, counts = [x for x, _ in items], [c for _, c in items]
    got = M.knapsack(lengths, counts, budget)
    assert all(0 <= g <= c for g, c in zip(got, counts))
    total = sum(g * n for g, n in zip(got, lengths))
    everything = sum(c * n for c, n in zip(counts, lengths))
    assert total <= budget and (budget < everything or total == everything)
    sums = {sum(a * n for a, n in zip(t, lengths)) for t in itertools.product(*(range(c + 1) for c in counts))}
    best = max(s for s in sums if s <= budget)
    assert best - total <= 9


def test_knapsack_is_exact_for_real_lengths():
    lengths = list(range(20, 400))
    assert sum(g * n for g, n in zip(M.knapsack(lengths, [30] * 380, 1_234_567), lengths)) == 1_234_567


def brute_targets(sizes, cycle=(5, 2, 1), most=3):
    """Share, close what is over, and share again, source by source."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    closed = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in closed)
        total = sum(weight[s] for s in names if s not in closed)
        over = {s for s in names if s not in closed and rest * weight[s] > most * sizes[s] * total}
        if not over:
            return {s: most * sizes[s] if s in closed else rest * weight[s] / total for s in names}
        closed |= over


def spark_targets(spark, sizes):
    d = spark.createDataFrame([("" if s is None else f"={s}", n) for s, n in sizes.items()], "source string, words long")
    return {r.source[1:] if r.source else None: r.target for r in M.targets(d).collect()}


def test_targets(spark):
    rng = random.Random(2)
    many = {f"é{i}" if i % 3 else f"z{i}": int(10 ** rng.uniform(0, 6)) for i in range(500)} | {None: 77, "\U0001f642": 5, "\ufb01": 9, "": 3}
    for sizes in ({"b": 100, "a": 10, None: 50, "c": 1000}, {"a": 0, "b": 5}, {}, {None: 4}, {"a": 0}, many):
        got, want = spark_targets(spark, sizes), brute_targets(sizes) if sizes else {}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)
    assert sum(not w for w in want.values()) == 0 and len(set(want.values())) > 100


def test_mix(spark):
    r = rows()
    got = M.mix(documents(spark)).collect()
    again = M.mix(documents(spark).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = {i: len((t or "").encode().split()) for i, t, *_ in r}
    assert {x.doc_id: x["size"] for x in got} == size and len(got) == len(r)
    sources = {}
    for i, _, _, s, *_ in r:
        sources.setdefault(s, []).append(i)
    taken = {x.doc_id: x for x in got}
    want = brute_targets({s: sum(size[i] for i in ids) for s, ids in sources.items()})
    for s, ids in sources.items():
        assert abs(sum(taken[i].taken for i in ids) - want[s]) <= 5
        assert all(abs(taken[i].target - want[s]) < 1e-6 and taken[i].taken in (0, size[i], 2 * size[i], 3 * size[i]) for i in ids)


def test_odd_tables(spark):
    assert M.mix(empty(spark)).count() == 0
    d = documents(spark)
    assert M.mix(d.union(d)).count() == 2 * d.count()
    kept = M.with_copies(d.union(d))
    assert kept.count() == 2 * d.count() and kept.columns == [*d.columns, "copies"]
