"""What a worker keeps is shared by its tasks, though their functions travel with their code."""

import os

from pyspark import cloudpickle

from lumifield.llm import packing, pieces
from lumifield.llm.kept import kept


def test_made_once_and_the_last_two_stay():
    made = []
    make = lambda p: made.append(p) or object()
    a = kept("test", "a", make)
    assert kept("test", "b", make) is not a and kept("test", "a", make) is a and made == ["a", "b"]
    kept("test", "c", make)
    assert kept("test", "a", make) is a and made == ["a", "b", "c"]
    kept("test", "b", make)
    assert made == ["a", "b", "c", "b"]


def test_functions_need_no_package():
    for f in (packing._word_tokens, pieces._encoder, pieces._vocabulary):
        assert cloudpickle.loads(cloudpickle.dumps(f)) is not f  # it would be, if it were looked up by its name


def test_two_copies_of_a_function_share():
    one, two = (cloudpickle.loads(cloudpickle.dumps(kept)) for _ in range(2))
    assert one is not two and one("copies", "a", lambda p: object()) is two("copies", "a", lambda p: object())


def test_workers_read_once(spark):
    def ids(batches):
        for part in batches:
            yield part.from_pydict({"at": [id(kept("rows", "a", lambda p: [p]))] * part.num_rows, "pid": [os.getpid()] * part.num_rows})

    for _ in range(2):
        rows = spark.range(0, 64, 1, 16).mapInArrow(ids, "at long, pid long").distinct().collect()
        assert len({r.pid for r in rows}) == len(rows)
