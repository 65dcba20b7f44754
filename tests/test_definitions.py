"""A name stands for one thing in its module: a later definition would silently take the place of the first."""

import ast
from collections import Counter
from pathlib import Path

import pytest

import sitewright

FILES = sorted(Path(sitewright.__file__).parent.rglob("*.py"))


@pytest.mark.parametrize("path", FILES, ids=lambda p: p.stem)
def test_defined_once(path):
    names = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
    assert [n for n, k in names.items() if k > 1] == []
