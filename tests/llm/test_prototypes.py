"""The table of confusable characters, where it can't be read."""

import pytest

from citeloom.llm import oneform


def test_a_missing_table_is_an_error():
    class Session:
        pass

    broken = Session()
    broken._jvm = None
    for session in (Session(), broken):
        with pytest.raises(RuntimeError, match="confusable"):
            oneform.prototypes(session)
