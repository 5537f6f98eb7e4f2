"""What the driver's JVM has freed goes back to the system when an operator writes a table between its steps."""

import re
from pathlib import Path

import pytest

from claimloom.llm.common import discard, stash

BLOCK, BLOCKS = 64 << 10, 2400  # 150 MB, too small each to be mapped alone


def held(pid):
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_stash_gives_back_what_the_driver_has_freed(spark):
    jvm = spark._jvm
    pid, platform = jvm.java.lang.ProcessHandle.current().pid(), jvm.org.apache.spark.unsafe.Platform
    if not Path(f"/proc/{pid}/smaps_rollup").exists():
        pytest.skip("memory can't be read here")
    stash(spark.range(10), "warm")
    blocks = [platform.allocateMemory(BLOCK) for _ in range(BLOCKS)]
    for at in blocks:
        platform.setMemory(None, at, BLOCK, 1)
    for at in blocks[:-1]:  # the last one keeps the library from giving back what lies below it
        platform.freeMemory(at)
    before = held(pid)
    written = stash(spark.range(10), "after")
    after = held(pid)
    platform.freeMemory(blocks[-1])
    assert before - after > 100
    assert sorted(r.id for r in written.collect()) == list(range(10))
    discard(spark)


def test_stash_writes_no_marker_files(spark):
    path = Path(stash(spark.range(10), "plain").inputFiles()[0].removeprefix("file:")).parent
    assert not [p.name for p in path.iterdir() if "_SUCCESS" in p.name]
    discard(spark)
