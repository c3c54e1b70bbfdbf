"""Functions that run in Python tasks must load where this package is not installed."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from tidewatt.models import mlp

LOAD = "import pickle, sys; f = pickle.load(sys.stdin.buffer); assert 'tidewatt' not in sys.modules; print(f.__name__)"


@pytest.mark.parametrize("function", [mlp.forward, mlp.gradient, mlp.merged_moments, mlp.Layout, mlp.Adam])
def test_loads_without_the_package(function, tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", LOAD], input=cloudpickle.dumps(function), cwd=tmp_path, env={}, capture_output=True
    )
    assert done.stdout.decode().strip() == function.__name__, done.stderr.decode()
