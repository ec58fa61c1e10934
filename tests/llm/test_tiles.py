import numpy as np

from casefuse.llm.tiles import local_components
from tests.llm.common import groups


def test_local_components_equal_union_find():
    rng = np.random.default_rng(5)
    for n, m in [(1, 0), (2, 1), (40, 20), (200, 150), (200, 199), (500, 480), (60, 900)] * 20:
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        assert local_components(n, a, b).tolist() == groups(n, zip(a.tolist(), b.tolist()))
    path = rng.permutation(300)
    assert set(local_components(300, path[:-1], path[1:]).tolist()) == {0}
