import numpy as np
import pyarrow as pa
import pytest

from pixelmill.llm import kernel


def test_row_sums_of_floats_depend_on_the_row_only():
    r = np.random.default_rng(3)
    values = r.normal(size=5000) * 10.0 ** r.integers(-8, 8, 5000)
    at = np.sort(np.concatenate(([0, 0, 5000, 5000], r.integers(0, 5000, 300))))
    whole = kernel.row_sums(values, at)
    for k in range(len(at) - 1):
        assert kernel.row_sums(values[at[k] : at[k + 1]], np.array([0, at[k + 1] - at[k]]))[0] == whole[k]
    assert (kernel.row_sums(np.zeros(0), np.array([0, 0, 0])) == 0).all()
    assert kernel.row_sums(np.array([True, True, False]), np.array([0, 2, 3])).tolist() == [2, 0]


def test_partitions_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(kernel, "give_back", lambda: calls.append(1))
    batches = [pa.record_batch({"x": [k]}) for k in range(3)]
    assert list(kernel.tidied(lambda b: (x for x in b))(batches)) == batches and calls == [1]

    def broken(b):
        yield next(iter(b))
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        list(kernel.tidied(broken)(batches))
    assert calls == [1, 1]


def test_giving_back_works_here():
    x = pa.array(np.zeros(1 << 20))
    del x
    kernel.give_back()
