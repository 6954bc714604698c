import numpy as np
import pytest

from clauseloom.llm.eliasfano import EliasFano


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (5, 5), (100, 100), (1000, 10**6), (1000, 500), (50_000, 2**36)])
def test_access_and_search(n, universe):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n))
    coded = EliasFano.view(np.frombuffer(EliasFano.encode(values, universe), np.uint8))
    assert (coded.all() == values).all() and (coded.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, rng.integers(0, universe, max(n, 3)), [universe, universe + 10**7]])
    at = {v: i for i, v in enumerate(values.tolist())}
    assert coded.find(asked).tolist() == [at.get(v, -1) for v in asked.tolist()]


def test_whole_bytes():
    values = np.unique(np.random.default_rng(4).integers(0, 2**36, 5000))
    coded = EliasFano.view(np.frombuffer(EliasFano.encode(values, 2**36, 8), np.uint8))
    assert (coded.all() == values).all() and coded.find(values).tolist() == list(range(len(values)))


def test_repeats_and_size():
    values = np.sort(np.random.default_rng(0).integers(0, 2**20, 10_000))
    data = EliasFano.encode(values, 2**20)
    assert (EliasFano.view(np.frombuffer(data, np.uint8)).all() == values).all()
    assert len(data) < 10_000 * 10 / 8 + 100
