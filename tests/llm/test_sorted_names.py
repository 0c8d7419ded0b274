import random
import time

import numpy as np
import pytest

from folioflow.llm import suffixarray


@pytest.mark.parametrize("seed", range(20))
def test_sort_names(seed):
    rnd = random.Random(seed)
    s = [rnd.randrange(rnd.choice([1, 2, 3, 200])) for _ in range(rnd.choice([0, 1, 2, 3, 40, 400]))]
    s[50:90] = s[:40]
    assert suffixarray._sort_names(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_names_are_not_sorted_on_lists():
    """A shard of passages that stand twice: sorting suffixes costs a few times what their prefixes cost."""
    rng = np.random.default_rng(4)
    letters = rng.integers(98, 123, 75_000)
    s = np.concatenate([np.tile(x, 2) for x in np.split(letters, 125)] * 2)
    spent = []
    for _ in range(3):
        began = time.process_time()
        sa = suffixarray.suffix_array(s)
        middle = time.process_time()
        suffixarray.common_prefixes(s, sa)
        spent.append((middle - began, time.process_time() - middle))
    sort, prefixes = map(min, zip(*spent))
    assert sort < 4 * prefixes
