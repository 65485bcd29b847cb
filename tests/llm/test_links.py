import random

import pytest
from pyspark.sql import functions as F

from watchspan.llm import links


def labels(pairs):
    label = {x: x for pair in pairs for x in pair}
    for u, v in pairs:
        a, b = sorted((label[u], label[v]))
        label = {x: a if own == b else own for x, own in label.items()}
    return label


def graph(seed):
    """Chains, stars with a large and a small centre, repeated and turned links, loops, and links at random."""
    rng, name = random.Random(seed), list(range(-150, 150))
    rng.shuffle(name)
    pairs = [(name[k], name[k + 1]) for k in range(60)] + [(149, name[k]) for k in range(70, 90)] + [(-150, name[k]) for k in range(100, 120)]
    pairs += [(rng.choice(name[130:]), rng.choice(name[130:])) for _ in range(90)]
    pairs += [(v, u) for u, v in rng.sample(pairs, 40)] + rng.sample(pairs, 40)
    return [(u, v) for u, v in pairs if u != v]


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_plain_unions(spark, seed):
    pairs = graph(seed)
    table = spark.createDataFrame([*pairs, (5, 5)], "u long, v long")
    got = links.components(table).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got if (r.node, r.root) != (5, 5)} == {x: own for x, own in labels(pairs).items() if (x, own) != (5, 5)}


def test_a_round_deals_few_rows_and_adds_no_link(spark):
    table = links.keep(spark.createDataFrame(graph(7), "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    made = links._stars(links._stars(table, True), False)
    assert len(made.collect()) == table.count()
    final = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("- Exchange hashpartitioning") == 2
