"""Command-line smoke test: snapshot and single-query commands write their outputs."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_cli_snapshot_and_query():
    d = tempfile.mkdtemp(prefix="pulse-cli-", dir="/tmp")
    env = dict(os.environ, PYTHONPATH=ROOT)
    for args in (["snapshot", "--variant", "v8", "--cutoffs", "3,7,14", "--out", os.path.join(d, "panel")],
                 ["query", "--name", "roc_auc", "--out", os.path.join(d, "auc")]):
        subprocess.run([sys.executable, "-m", "pulse", *args, "--sf", "/root/testdata/sf0.001",
                        "--master", "local[2]"], check=True, env=env, cwd=ROOT, capture_output=True, timeout=600)
    assert sorted(x for x in os.listdir(os.path.join(d, "panel")) if x.startswith("cutoff=")) == \
        ["cutoff=14", "cutoff=3", "cutoff=7"]
    assert any(x.endswith(".parquet") for x in os.listdir(os.path.join(d, "auc")))
