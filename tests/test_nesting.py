import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

ROWS = st.lists(st.lists(st.sampled_from([1, -1, 0]), max_size=15), max_size=6)


@pytest.fixture(scope="module")
def kernels(spark):
    from codeloom.functions import nesting

    return nesting


@settings(max_examples=300, deadline=None)
@given(rows=ROWS, cut=st.integers(0, 6))
def test_partners_and_sums_equal_a_stack(kernels, rows, cut):
    column = pa.array(rows, pa.list_(pa.int32())).slice(min(cut, len(rows)))
    rows = column.to_pylist()
    want = []
    for row in rows:
        stack, out = [], [-1] * len(row)
        for i, step in enumerate(row):
            if step > 0:
                stack.append(i)
            elif step < 0 and stack:
                out[stack.pop()] = i
        for i in stack:
            out[i] = len(row) - 1
        want.append(out)
    assert kernels.closing_partner.func(column).to_pylist() == want
    assert kernels.running_before.func(column).to_pylist() == [
        [sum(row[:i]) for i in range(len(row))] for row in rows
    ]
