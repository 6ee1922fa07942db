import pytest

pytest.importorskip("chorale.llm")
