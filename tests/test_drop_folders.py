"""The newest drop may be a folder of part files, which is read whole."""

from __future__ import annotations

import os

from ledgerspark.sources import files
from tests.test_sources import write


def test_newest_drop_is_a_folder_of_part_files(spark, tmp_path):
    row = "01/01/2025,01/01/2025,{},F,Sale,-1,".format
    write(tmp_path / "old.csv", [row("OLD")], age=1000)
    for name, age in (("newer.csv", 10), ("archive", 1)):
        (tmp_path / name).mkdir()
        for n in range(3):
            write(tmp_path / name / f"part-{n}.csv", [row(f"{name} {n}")], age=age + n)
    found = [r["Description"] for r in files.latest_file_scan(spark, str(tmp_path)).collect()]
    assert sorted(found) == ["newer.csv 0", "newer.csv 1", "newer.csv 2"]
    os.utime(tmp_path / "old.csv")
    assert [r["Description"] for r in files.latest_file_scan(spark, str(tmp_path)).collect()] == ["OLD"]


def test_an_unfinished_folder_is_not_a_drop(spark, tmp_path):
    row = "01/01/2025,01/01/2025,{},F,Sale,-1,".format
    for name, age in (("whole.csv", 50), ("half.csv", 1)):
        (tmp_path / name).mkdir()
        write(tmp_path / name / "part-0.csv", [row(name)], age=age)
    (tmp_path / "half.csv" / "_temporary" / "0").mkdir(parents=True)
    assert [r["Description"] for r in files.latest_file_scan(spark, str(tmp_path)).collect()] == ["whole.csv"]
    (tmp_path / "half.csv" / "_temporary" / "0").rmdir()
    (tmp_path / "half.csv" / "_temporary").rmdir()
    assert [r["Description"] for r in files.latest_file_scan(spark, str(tmp_path)).collect()] == ["half.csv"]
