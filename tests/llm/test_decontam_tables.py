"""Block tables of decontamination: every pair within the bits, whatever fits at once."""

import numpy as np
import pytest

from tracewell.llm import decontam


@pytest.mark.parametrize("cells", [1, 37, 1 << 20])
def test_a_table_gives_every_pair_within_its_bits(monkeypatch, cells):
    monkeypatch.setattr(decontam, "CELLS", cells)
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 1 << 10, 60).astype(np.uint16)
    asked = np.concatenate([rng.integers(0, 1 << 10, 90).astype(np.uint16), blocks[:5], blocks[:5]])
    table = decontam.Table(blocks, 3)
    found = [(int(a), int(i)) for w, of in table.near(asked) for a, i in zip(w, of, strict=True)]
    want = [(a, i) for a, x in enumerate(asked) for i, y in enumerate(blocks) if bin(int(x) ^ int(y)).count("1") <= 3]
    assert sorted(found) == want
    assert not list(table.near(asked[:0]))


def test_lookup_finds_every_window_within_the_radius():
    rng = np.random.default_rng(6)
    index = decontam.Index([(k, " ".join(f"w{x}" for x in rng.integers(0, 300, 8))) for k in range(150)])
    prints = index.prints[rng.integers(0, 150, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    want = {(w, i) for w, p in enumerate(prints.tolist()) for i, q in enumerate(index.prints.tolist()) if (p ^ q).bit_count() <= index.radius}
    assert index.lookup(8, prints) == want
