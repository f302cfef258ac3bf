import hashlib

import numpy as np
import pytest

from lumenframe.__main__ import main
from lumenframe.sources import datasets, store


def test_registry_verifies_digests(tmp_path, monkeypatch):
    monkeypatch.setenv(datasets.FOLDER_VARIABLE, str(tmp_path))
    good = hashlib.sha256(b"abc").hexdigest()
    datasets.register(datasets.DataSet("clip", (datasets.DataFile("a.bin", good),)))
    with pytest.raises(FileNotFoundError):
        datasets.fetch("clip")
    (tmp_path / "clip").mkdir()
    (tmp_path / "clip/a.bin").write_bytes(b"abc")
    assert datasets.fetch("clip") == [str(tmp_path / "clip/a.bin")]
    (tmp_path / "clip/a.bin").write_bytes(b"abd")
    with pytest.raises(ValueError, match="digest"):
        datasets.fetch("clip")
    with pytest.raises(KeyError):
        datasets.fetch("nothing")


def test_command_line(capsys):
    assert main(["queries"]) == 0 and "fill_mapping" in capsys.readouterr().out
    assert main(["data", "list"]) == 0 and main(["what"]) == 2


def test_chunk_sizes():
    assert store.factors(12) == [1, 2, 3, 4, 6, 12]
    rows, stored = store.chunk_plan({"frame": 2000, "height": 480, "width": 752}, 4, "frame", 256)
    assert rows == 185 and 2000 % stored == 0 and stored <= rows
    assert store.optimal_rows(4, 1) == 1 << 18 and np.isfinite(rows)
