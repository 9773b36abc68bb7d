import os
import random

from marginalia.llm import common

from .helpers import components


def test_components_of_random_chains_and_hubs(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(400)] + [(r.randrange(2000, 2600), r.randrange(2000, 2600)) for _ in range(350)] + [(5000, 5000)]
    r.shuffle(edges)
    rows = edges + edges[:50] + [(None, 1), (1, None)]
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == components(nodes, edges[:-1] if edges[-1] == (5000, 5000) else [e for e in edges if e[0] != e[1]])
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_are_written_and_forgotten(spark):
    t = common.written(spark.range(5), "five")
    path = common.path_of(t)
    assert path.startswith(common.shared_dir(spark)) and t.count() == 5
    common.forget(t)
    assert common.path_of(t) is None and not os.path.exists(path.removeprefix("file://"))


def test_units_meet_each_pair_once(spark):
    import numpy as np
    import pyarrow as pa

    rows = spark.createDataFrame([(k, 100 * k + i) for k, n in ((1, 37), (2, 3), (3, 1)) for i in range(n)], "k long, node long")

    def run(t, unit):
        node, side, one = (t.column("node").to_numpy(), t.column("side").to_numpy(), t.column("bi").to_numpy() == t.column("bj").to_numpy())
        got = list(common.unit_pairs(unit, side, one, room=50))
        if not got:
            return None
        i, j = (np.concatenate([g[x] for g in got]) for x in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    pairs = [tuple(r) for r in common.scan_units(common.blocked_units(rows, ["k"], "node", 8), ["k"], run, "a long, b long").collect()]
    assert len(pairs) == len(set(pairs)) == 37 * 36 // 2 + 3
