"""What a Python worker, which outlives the stage it was started for, still holds when the next operator comes."""

import gc
import re
import sys
import weakref
from pathlib import Path

import numpy as np
import pytest
import public_tokenizers

from trafficlens.llm import byte_bpe, language_id, similar, util
from trafficlens.llm.queries import BYTE_RANKS


def known():
    return language_id._known((["▁a", "b"], np.full((2, 2), 0.5)))


def encoder():
    return byte_bpe._encoder(public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


@pytest.fixture(autouse=True)
def no_tables():
    util.drop_tables()
    yield
    util.drop_tables()


@pytest.mark.parametrize("first, then", [(known, encoder), (encoder, known)])
def test_only_one_operators_tables_stay(first, then):
    held = weakref.ref(first())
    then()
    gc.collect()
    assert held() is None


@pytest.mark.parametrize("first", [known, encoder])
def test_tasks_of_near_copies_drop_the_tables_of_others(first):
    held = weakref.ref(first())
    assert list(similar._first(15, similar.LEAST)(iter(()))) == []
    gc.collect()
    assert held() is None


def test_tables_stay_from_task_to_task():
    model = (["▁a", "b"], np.full((2, 2), 0.5))
    assert language_id._known(model) is language_id._known(model)
    assert encoder() is encoder()
    assert util.tables_of("byte_bpe", "another path", list) == []


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_task_gives_back_what_it_freed():
    def mb() -> int:
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024

    def task():
        rows = [np.ones(8000, np.uint8) for _ in range(20_000)]  # of a size that is not mapped by itself
        rows[:-1] = []  # the last is above the others, so that they can't be cut off as the heap's end
        yield mb()
        kept.append(rows)

    kept = []
    (before,) = util.given_back(task())
    assert mb() < before - 80
