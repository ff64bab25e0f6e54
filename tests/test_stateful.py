"""Word graphs of any length and the recurrence against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelight.functions import vectors
from pagelight.operators import decode, network, word_graphs
from pagelight.operators.stages import Stages
from pagelight.sources.activations import Activations


def graph_of(spark, run, words, depth=2):
    rows = spark.createDataFrame([(list(w),) for w in words], "letters array<int>")
    bits, packed = word_graphs.packed(run, word_graphs.automaton(run, rows, depth))
    return decode.graph_edges(run.write(packed, "packed"), bits)


def brute_nodes(words):
    """The different sets of continuations of all beginnings."""
    words = {tuple(w) for w in words if w}
    return {frozenset(w[len(p) :] for w in words if len(w) > len(p) and w[: len(p)] == p) for w in words for p in (w[:k] for k in range(len(w)))}


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_word_graphs_of_any_length(spark, depth):
    rng = np.random.default_rng(8)
    words = [tuple(rng.integers(1, 4, rng.integers(1, 7)).tolist()) for _ in range(60)] + [tuple([1, 2] * 60), tuple([3] + [2] * 99), (), (3,), (500,)]
    asked = [w[:k] for w in words for k in (len(w), len(w) - 1)] + [w + (1,) for w in words] + [tuple(rng.integers(1, 4, 5).tolist()) for _ in range(60)]
    with Stages(spark, "t") as run:
        edges = run.write(graph_of(spark, run, words, depth), "edges")
        assert edges.select("node").distinct().count() == len(brute_nodes(words))
        assert edges.where("edge = 0 and node = 0").count() == 1 and edges.where("last").count() == len(brute_nodes(words))
        df = spark.createDataFrame([(i, list(w)) for i, w in enumerate(asked)], "word_id long, letters array<int>")
        whole = {r["word_id"]: r["found"] for r in decode.in_graph(df, edges).collect()}
        begins = {r["word_id"]: r["found"] for r in decode.in_graph(df, edges, prefix=True).collect()}
    held = {w for w in words if w}
    assert whole == {i: w in held for i, w in enumerate(asked)}
    assert begins == {i: any(x[: len(w)] == w for x in held) for i, w in enumerate(asked)}


def test_nodes_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(word_graphs, "BLOCK", 4)
    rng = np.random.default_rng(9)
    last = (rng.random(50) < 0.2).tolist()
    last[-1] = True
    want, at = [], 0
    for i, end in enumerate(last):
        want.append(at)
        at = i + 1 if end else at
    df = spark.createDataFrame(list(enumerate(last)), "edge long, last boolean")
    assert [r["node"] for r in word_graphs.nodes_of(df).orderBy("edge").collect()] == want


def test_recurrence_equals_the_network(spark):
    rng = np.random.default_rng(10)
    gates = [rng.normal(0, 1, (3, 4 + 3 + 1)) for _ in range(4)]
    lines = [rng.normal(0, 1, (n, 4)) for n in (1, 7, 40)]
    df = spark.createDataFrame([(i, t, v.tolist()) for i, x in enumerate(lines) for t, v in enumerate(x)], "id long, t int, vec array<double>").repartition(4)
    got = {(r["id"], r["t"]): r["vec"] for r in network.recurrent(df, [g.tolist() for g in gates]).collect()}
    layer = network.Layer("lstm", 4, 3, matrices=[(g.astype(np.float32), None) for g in gates])
    for i, x in enumerate(lines):
        want = network.forward(layer, x.astype(np.float32)[None])[0]
        assert np.abs(np.array([got[i, t] for t in range(len(x))]) - want).max() < 1e-4
    whole = [(np.round(g * 20).astype(np.int8), np.full(3, 0.05)) for g in gates]
    stacked = network.forward(network.Layer("lstm", 4, 3, matrices=whole), lines[2].astype(np.float32)[None])[0]
    state, last = np.zeros(3, np.float32), np.zeros(3, np.float32)
    for step, out in zip(lines[2].astype(np.float32), stacked):  # a gate at a time
        cell, gate_in, forget, gate_out = (network.product(m, s, np.concatenate((step, last))[None, :])[0] for m, s in whole)
        state = np.clip(state * network._sigmoid(forget) + network._tanh(cell) * network._sigmoid(gate_in), -100, 100).astype(np.float32)
        last = network._tanh(state) * network._sigmoid(gate_out)
        assert np.allclose(out, last, atol=1e-6)


def test_whole_number_activations(spark):
    a = Activations(3, 2, whole=True)
    a.write(0, [0.5, -1.0])
    a.write(1, [2.0, -3.0])
    assert a.whole_numbers(0).tolist() == [64, -127] and a.whole_numbers(1).tolist() == [127, -127]
    assert a.read(0) == pytest.approx([64 / 127, -1.0]) and a.read(2).tolist() == [0, 0]
    b = Activations(2, 2, whole=True)
    b.copy_step(1, a, 0)
    assert b.whole_numbers(1).tolist() == [64, -127] and b.whole_numbers(0).tolist() == [0, 0]
    b.zero(1)
    assert b.whole_numbers(1).tolist() == [0, 0]
    a.resize(2, 3)
    assert (a.steps, a.features, a.rows, a.columns) == (2, 3, 1, 2) and not a.values.any()
    a.resize(6, 1, rows=2)
    assert (a.rows, a.columns, a.steps) == (2, 3, 6)
    f = Activations(1, 2)
    f.write(0, [0.25, 7.0])
    assert f.read(0).tolist() == [0.25, 7.0] and f.values.dtype == np.float32
    for wrong in (lambda: f.write(0, [1.0]), lambda: f.write(1, [1.0, 2.0]), lambda: f.whole_numbers(0), lambda: b.copy_step(0, f, 0)):
        with pytest.raises(ValueError):
            wrong()
    # the same as columns, from step to step without loss
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(0, 1, 5).tolist()) for i in range(50)] + [(50, [0.5, -0.5, 1 / 254, -1 / 254, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    whole = df.select("id", F.transform("vec", vectors.clamped_int).alias("q")).select("id", "q", F.transform("q", vectors.from_whole).alias("back"))
    for r, (_, vec) in zip(whole.orderBy("id").collect(), rows):
        one = Activations(1, 5, whole=True)
        one.write(0, vec)
        assert one.whole_numbers(0).tolist() == r["q"] and one.read(0) == pytest.approx(r["back"])
    again = whole.select("q", F.transform("back", vectors.clamped_int).alias("p"))
    assert again.where("q <> p").count() == 0
    grid = rng.normal(0, 0.5, (2, 3, 4)).astype(np.float32)
    kept = Activations.of(grid, whole=True)
    assert np.abs(kept.grid() - grid.clip(-1, 1)).max() <= 0.5 / 127 + 1e-6 and (Activations.of(kept.grid(), whole=True).values == kept.values).all()
