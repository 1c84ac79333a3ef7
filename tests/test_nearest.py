"""Nearest-row fill of a block against a loop over all rows."""

import numpy as np
import pytest

from careflow.operators import impute


def by_loop(x):
    """Row each missing cell is filled from: the first of the nearest rows that have the column."""
    missing = np.isnan(x)
    out = np.full(x.shape, -1)
    for a in range(len(x)):
        both = ~missing[a] & ~missing
        n = both.sum(axis=1)
        d = np.where(n > 0, np.where(both, (x[a] - x) ** 2, 0).sum(axis=1) / np.maximum(n, 1), np.inf)
        for c in np.flatnonzero(missing[a]):
            donors = np.flatnonzero(~missing[:, c])
            if len(donors):
                out[a, c] = donors[d[donors].argmin()]
    return out


KINDS = {
    "plain": lambda r: r.normal(size=(200, 9)),
    "many ties": lambda r: np.round(r.normal(size=(200, 9))),
    "all equal": lambda r: np.ones((200, 9)),
    "far from 0": lambda r: r.normal(size=(200, 9)) * 1e6 + 1e9,
    "repeated rows": lambda r: np.repeat(r.normal(size=(20, 9)), 10, axis=0),
    "uneven scales": lambda r: r.normal(size=(200, 9)) * 10.0 ** r.integers(-8, 8, 9),
    "squares overflow": lambda r: np.round(r.normal(size=(200, 9))) * 1e160,
    "few rows": lambda r: r.normal(size=(3, 9)),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("share", [0.1, 0.6, 0.95])
@pytest.mark.parametrize("near", [1, 64])
def test_donors_are_those_of_the_loop(kind, share, near):
    rng = np.random.default_rng(3)
    x = KINDS[kind](rng)
    x[rng.random(x.shape) < share] = np.nan
    with np.errstate(over="ignore", invalid="ignore"):
        filled, origin, far = impute.nearest_in_block(x, near=near, slab=64)
        np.testing.assert_array_equal(origin, by_loop(x))
    at, c = np.nonzero(origin >= 0)
    np.testing.assert_array_equal(filled[at, c], x[origin[at, c], c])
    assert np.isnan(filled).any() == (np.isnan(x) & (origin < 0)).any() and not np.isnan(far[at, c]).any()


def test_blocks_without_rows_or_gaps():
    for x in (np.empty((0, 3)), np.ones((4, 3)), np.full((4, 3), np.nan)):
        filled, origin, _ = impute.nearest_in_block(x)
        np.testing.assert_array_equal(filled, x)
        assert (origin == -1).all()
