"""Neighbours among many near but unequal copies."""

import numpy as np
import pytest

from tracewell.llm import ann


@pytest.mark.parametrize("noise", [0.001, 0.05, 0.2])
def test_near_copies_are_all_considered(noise):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 32))
    v[:1000] = v[0] + rng.normal(size=(1000, 32)) * noise
    ids, asked = np.arange(3000), np.arange(0, 3000, 50)
    model = ann.Quantiser((v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32))
    got = ann.search_block(model, ids[asked], v[asked], ids, v, 5)
    assert [(q, c) for q, c, _ in got] == [(q, c) for q, _, c in ann.brute(ids, v, asked)]


def test_recall_of_the_scan_alone():
    """A fiftieth of a block is scored, and nothing else."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 64))[rng.integers(0, 120, 8000)] + 0.5 * rng.normal(size=(8000, 64))
    ids, asked = np.arange(8000), np.arange(0, 8000, 50)
    model = ann.Quantiser((v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32))
    got = {(q, c) for q, c, _ in ann.search_block(model, ids[asked], v[asked], ids, v, 5, 0.02, False)}
    want = {(q, c) for q, _, c in ann.brute(ids, v, asked)}
    assert len(got & want) / len(want) >= 0.9


def test_cells_hold_the_neighbours_of_queries():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 32))
    u = (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)
    cells = ann.Cells(u[rng.permutation(4000)[:2000]], 40)
    home, asked = cells.ranked(u, 1)[:, 0], np.arange(0, 4000, 50)
    seen = cells.ranked(u[asked], cells.probes)
    want = [(q, c) for q, _, c in ann.brute(np.arange(4000), v, asked)]
    assert cells.probes < 20 and np.mean([home[c] in seen[q // 50] for q, c in want]) >= 0.95


def test_bound_holds():
    rng = np.random.default_rng(9)
    u, q = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (rng.normal(size=(500, 16)), rng.normal(size=(40, 16))))
    q[:20] = u[:20] + 0.1 * q[:20]
    q /= np.sqrt((q * q).sum(1, keepdims=True))
    model = ann.Quantiser(u.astype(np.float32))
    codes = model.encode(u.astype(np.float32))
    along, across = model.errors(u.astype(np.float32), codes)
    scan = q @ model.centres[np.arange(model.parts), codes].reshape(500, -1)[:, :16].T
    for s, c in zip(scan, q @ u.T, strict=True):
        for least in (0.0, 0.2, 0.5, 0.9, 0.99):
            assert ann.could_reach(s, least, along, across)[c >= least].all()
