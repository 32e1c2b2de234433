import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from trendlab.operators import tiles


@settings(max_examples=200, deadline=None)
@given(
    st.integers(1, 12), st.integers(1, 60), st.integers(1, 8),
    st.sampled_from([-np.inf, 0.0, 0.5, 0.9]), st.sampled_from([0.0, 0.05, 1.0]),
    st.integers(0, 2**32 - 1),
)
def test_strip_top_k_equals_a_full_sort(rows, columns, k, floor, dense, seed):
    rng = np.random.default_rng(seed)
    # Few distinct values, moved by less than the rounding: ties everywhere.
    scores = rng.integers(-4, 5, size=(rows, columns)) / 4 + rng.uniform(-4e-10, 4e-10, size=(rows, columns))
    old, tiles.DENSE = tiles.DENSE, dense
    try:
        row, col, sim = tiles._strip_top_k(scores, k, floor)
    finally:
        tiles.DENSE = old
    rounded = np.floor(scores * 1e9 + 0.5) / 1e9
    want = []
    for i in range(rows):
        order = sorted(range(columns), key=lambda j: (-rounded[i, j], j))[:k]
        want += [(i, j, rounded[i, j]) for j in order if rounded[i, j] >= floor]
    assert list(zip(row, col, sim)) == want


def _nearest(x, k, floor, cuts):
    """The k best of each row among all, found block by block: (row, column, similarity), best first."""
    query = tiles._Query(tiles._Rows(np.arange(len(x)), x), k, floor)
    edges = [0, *cuts, len(x)]
    for a, b in zip(edges, edges[1:]):
        part = x[a:b]
        kept = tiles._first_copies(part, k)
        query.see(tiles._Rows(np.arange(a, b)[kept], part[kept]))
    out, start = [], 0
    for strip in query.strips:
        strip.settle()
        for i in range(len(strip.x)):
            out += [(start + i, int(p), s) for p, s in zip(strip.place[i], strip.sim[i]) if p != tiles.NOBODY]
        start += len(strip.x)
    return out


@pytest.mark.parametrize("kind", ["spread", "copies", "near copies", "long", "huge", "unsound"])
@pytest.mark.parametrize("floor", [-np.inf, 0.3])
@pytest.mark.parametrize("precision", [np.float32, np.float64])
def test_running_top_k_equals_a_full_sort(kind, floor, precision):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "copies":
        x[100:1200:2] = x[7]
    if kind == "near copies":
        x[100:1200:2] = x[7] + rng.uniform(-3e-8, 3e-8, size=(550, 24))
    if kind == "long":
        x *= 10.0 ** rng.uniform(-2, 1, size=(1300, 1))
    if kind == "huge":
        x[::3] *= 1e16
    if kind == "unsound":
        x[[3, 900]] = 0
        x[5, 2], x[1250, 7] = np.nan, np.nan
    x = x.astype(precision)
    got = _nearest(x, 9, floor, [70, 700, 1290])
    scores = x.astype(np.float64) @ x.astype(np.float64).T
    scale = 10.0**tiles.SIM_DIGITS
    sims = np.floor(scores * scale + 0.5) / scale
    # Products summed in another order may round to the neighbouring digit.
    size = np.maximum(1.0, np.abs(np.where(np.isnan(sims), 0, sims)))
    for i in range(len(x)):
        mine = [(p, s) for r, p, s in got[i * 9:(i + 1) * 9] if r == i] if len(got) == 9 * len(x) else \
            [(p, s) for r, p, s in got if r == i]
        best = np.sort(sims[i][sims[i] >= floor])[::-1][:9]
        assert len(mine) == len(best), (i, mine)
        assert np.all(np.abs(np.array([s for _, s in mine]) - best) <= 2e-9 * np.maximum(1, np.abs(best)))
        assert all(abs(sims[i, p] - s) <= 2e-9 * size[i, p] for p, s in mine)
        assert mine == sorted(mine, key=lambda z: (-z[1], z[0])) and len({p for p, _ in mine}) == len(mine)
        if kind == "copies" and i == 7 and floor < 0:
            assert [p for p, _ in mine] == [7, 100, 102, 104, 106, 108, 110, 112, 114]
