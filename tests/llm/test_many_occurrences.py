"""A document that has very many segments on one gram that others share."""

import hashlib

import numpy as np
import pytest

from tablemill.llm import shared_windows, suffix_array


def test_long_run_of_one_byte(spark):
    rows = [(1, "b" + " " * 100_000 + "c"), (2, "d" + " " * 200), (3, "e" + " " * 120 + "f")]
    got = suffix_array.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    whole = hashlib.sha256(rows[0][1].encode()).hexdigest()
    # The runs go from 2 and 3; doc 1 has no "f" after its spaces and the others no "c".
    want = [(1, 100_002, 0, 0, whole), (2, 201, 200, 1, hashlib.sha256(b"d").hexdigest()), (3, 122, 120, 1, hashlib.sha256(b"ef").hexdigest())]
    assert sorted(map(tuple, got)) == want


def test_too_many_ends_are_refused():
    with pytest.raises(ValueError, match="16 bits"):
        suffix_array.enhanced(256 + np.arange(70_000), 10)


def test_nothing_to_pack():
    none = [np.zeros(0, np.int64)] * 4
    assert shared_windows._by_k(none, shared_windows.SPAN, 4).num_rows == 0
