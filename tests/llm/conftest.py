import pytest

pytest.importorskip("turnwise.llm")
