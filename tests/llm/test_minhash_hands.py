"""A class goes on with its full set only where a pair of its own is first met, and only if sizes allow a link."""

import pandas as pd
import pytest

from cutloom.llm import minhash_dedup as M


@pytest.mark.parametrize(("band", "sizes", "named"), [(0, (100, 90), 2), (3, (100, 90), 0), (0, (100, 50), 0)])
def test_likely_in_the_first_common_band(band, sizes, named):
    one = list(range(M.BANDS))
    two = [k if k in (0, 3) else -1 - k for k in one]
    rows = pd.DataFrame({"key": 7, "band": band, "cls": [1, 2], "comp": [1, 2], "side": [0, 1], "i": 0, "j": 1, "size_": sizes, "bands": [one, two], "sig": [[5] * 8, [5] * 8]})
    assert len(M._likely(rows)) == named
