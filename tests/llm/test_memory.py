"""Memory of the steps that gather words before they send them."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from runsift.llm import collocations as C
from runsift.llm import frequent


def test_edges_of_a_flush_take_little_beside_its_words():
    """The texts of half a million grams were picked at once, with three places of 8 bytes per letter: 697 bytes a word."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"word{x:06d}" for x in rng.integers(0, 900, 1000)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 400)], ["text", "group"])
    likely = frequent.Filter(0)
    likely.table[:] = 255  # all may be frequent
    run = C._edges(SimpleNamespace(value=likely), 3)
    tracemalloc.start()
    total = sum(int(np.asarray(b.column(3)).sum()) for b in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 400_000
    assert peak < 400 * 400_000, peak / 400_000


def test_a_flush_takes_little_beside_its_words_from_start_to_end():
    """Two copies of the hashes, places of 8 bytes and texts that nothing read: 135 and 67 bytes a word."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"word{x:06d}" for x in rng.integers(0, 900, 1000)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 1000)], ["text", "group"])
    likely = frequent.Filter(0)
    likely.table[:] = 255  # all may be frequent
    for run, most in ((C._edges(SimpleNamespace(value=likely), 3), 90), (C._hashed(SimpleNamespace(value=likely), 2, 0, 10), 60)):
        tracemalloc.start()
        rows = sum(b.num_rows for b in run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and peak < most * 1_000_000, peak / 1_000_000
