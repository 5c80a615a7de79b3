"""The comparison of results: nulls do not hide or invent differences."""

import numpy as np
import pandas as pd

from tests.harness import compare


def test_integers_with_nulls():
    nullable = pd.DataFrame({"a": pd.array([1, None], "Int64")})
    assert compare(pd.DataFrame({"a": [1.0, np.nan]}), nullable) is None
    assert compare(pd.DataFrame({"a": [2.0, np.nan]}), nullable) is not None
    assert compare(pd.DataFrame({"a": [np.nan, np.nan]}), pd.DataFrame({"a": pd.array([None, None], "Int64")})) is None
    assert compare(pd.DataFrame({"a": [1.5, np.nan]}), nullable) is not None
    assert compare(pd.DataFrame({"a": [1.0, 2.0]}), pd.DataFrame({"a": [1, 2]})) is not None
