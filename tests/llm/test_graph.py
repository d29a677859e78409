import random

from panelwright.llm.graph import components


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)] + [(5000 + i, 5000) for i in range(50)] + [(7, 7), (9000, 9000)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_random_graphs(spark):
    """Graphs of all densities side by side, nodes apart by their graph: paths in any order, trees, cycles, dense ones."""
    rng = random.Random(1)
    links = []
    for g in range(150):
        n = rng.randint(2, 14)
        names = rng.sample(range(g * 100, g * 100 + 100), n)
        links += [(rng.choice(names), rng.choice(names)) for _ in range(rng.choice([n // 2, n, 3 * n]))] + (list(zip(names, names[1:], strict=False)) if g % 3 == 0 else [])
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
