import pytest

pytest.importorskip("quern.llm")
