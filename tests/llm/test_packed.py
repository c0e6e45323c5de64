"""Rows of a key, of batches that are taken in slices."""

import pyarrow as pa

from quillspark.llm import substrings
from quillspark.llm.packed import whole_groups


class Watched:
    """A batch that notes how many rows become Python's objects at once."""

    def __init__(self, batch, seen):
        self.batch, self.seen, self.num_rows = batch, seen, batch.num_rows

    def slice(self, at, n):
        return Watched(self.batch.slice(at, n), self.seen)

    def column(self, name):
        self.seen.append(self.num_rows)
        return self.batch.column(name)


def test_groups_are_whole_across_slices_and_batches():
    keys, seen = [0] * 700 + [1] + [2] * 900, []
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(range(len(keys)))], ["k", "v"])
    cut = [whole.slice(0, 1000), whole.slice(1000, 0), whole.slice(1000)]
    got = [(k, [v for (v,) in rows]) for k, rows in whole_groups([Watched(b, seen) for b in cut], ["k", "v"])]
    assert got == [(0, list(range(700))), (1, [700]), (2, list(range(701, 1601)))]
    assert max(seen) <= 256


def test_a_task_gets_many_buckets():
    class Docs:
        def count(self):
            return 256410  # at 0.5 GB, where 51 tasks share the buckets

    assert 1 << substrings._bucket_bits(Docs()) >= 16 * 51
