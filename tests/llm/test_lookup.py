import numpy as np
import pytest

from lectern.llm import suffix_tree


@pytest.mark.parametrize("keys", [
    np.random.default_rng(1).integers(0, 2 ** 64, 5000, dtype=np.uint64), np.arange(3000, dtype=np.uint64), np.array([7], np.uint64),
    np.array([0, 5, 5, 2 ** 64 - 1], np.uint64), np.empty(0, np.uint64)])
def test_keys_are_found_where_a_search_by_halves_finds_them(keys):
    """seven searches by halves for each token, in tables that no cache holds."""
    keys = np.sort(keys)
    rng = np.random.default_rng(2)
    wanted = np.concatenate([rng.choice(keys, 2000) if len(keys) else keys, rng.integers(0, 2 ** 64, 2000, dtype=np.uint64), rng.integers(0, 4000, 500, dtype=np.uint64)])
    at, hit = suffix_tree._Lookup(keys).find(wanted)
    where = np.searchsorted(keys, wanted)
    assert hit.tolist() == np.isin(wanted, keys).tolist() and (at[hit] == where[hit]).all()
    assert not len(keys) or at.max() < len(keys)


def test_hashes_are_not_searched_by_halves(monkeypatch):
    keys = np.sort(np.random.default_rng(1).integers(0, 2 ** 64, 1 << 16, dtype=np.uint64))
    table = suffix_tree._Lookup(keys)
    monkeypatch.setattr(np, "searchsorted", lambda *_: pytest.fail("searched by halves"))
    assert not table.crowded and table.find(keys)[1].all()
