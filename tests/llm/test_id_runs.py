"""Rows of ids leave Arrow as plain numbers, whole columns at a time."""

import pyarrow as pa
import pytest

from churnscope.llm import bpe


@pytest.mark.parametrize("kind", [pa.list_(pa.int32()), pa.large_list(pa.int32())])
def test_ids_of_sliced_rows_with_nulls(kind):
    column = pa.array([[9], [1, 2], None, [], [3, 70000, 3], None], kind)
    assert list(bpe.id_runs(column)) == [[9], [1, 2], [], [], [3, 70000, 3], []]
    assert list(bpe.id_runs(column.slice(1, 4))) == [[1, 2], [], [], [3, 70000, 3]]
    assert list(bpe.id_runs(column.slice(2, 1))) == [[]] and list(bpe.id_runs(column.slice(0, 0))) == []
    assert {type(i) for run in bpe.id_runs(column) for i in run} == {int}


def test_null_ids_inside_a_row_are_refused():
    """As any id outside the vocabulary."""
    codec = bpe.ByteBpe.__new__(bpe.ByteBpe)
    codec.bytes_of = {1: b"a", 2: b"b"}
    assert [codec.decode(run) for run in bpe.id_runs(pa.array([[1, 2], None, [2]], pa.list_(pa.int32())))] == [b"ab", b"", b"b"]
    for bad in ([1, None], [1, 3]):
        with pytest.raises(KeyError):
            [codec.decode(run) for run in bpe.id_runs(pa.array([bad], pa.list_(pa.int32())))]
