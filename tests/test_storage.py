import os
import re
from pathlib import Path

import pytest

from kinmatch import storage


def test_native_memory_goes_back(spark):
    """What the driver's JVM frees between memory in use stays in its arenas unless a stored table hands it back."""
    jvm = spark._jvm
    if not Path("/proc/self/smaps_rollup").exists() or not storage.trim(spark):
        pytest.skip("no such figures, or no such command")
    pid = jvm.java.lang.ProcessHandle.current().pid()
    mb = lambda: int(re.search(r"Anonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024
    storage.materialise(spark.range(10), "warm")
    raw, held = bytearray(os.urandom(70_000)), []
    for _ in range(600):
        x = jvm.java.util.zip.Deflater()
        x.setInput(raw)
        x.deflate(bytearray(1000))
        held.append(x)
    for k, x in enumerate(held):
        if k % 50:
            x.end()
    jvm.System.gc()
    before = mb()
    assert storage.materialise(spark.range(10), "rows").count() == 10
    assert before - mb() > 60


def test_trim_of_other_jvms(spark, monkeypatch):
    """A JVM without the command costs nothing but the memory."""
    from py4j.protocol import Py4JError

    class Other:
        def __getattr__(self, name):
            raise Py4JError(name)

    session = type("Session", (), {"_jvm": type("Jvm", (), {"java": spark._jvm.java, "javax": Other()})(), "sparkContext": spark.sparkContext})()
    assert storage.trim(session) is False
