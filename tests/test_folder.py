"""A folder of files with settings in their first line."""

import pytest
from pyspark.sql import functions as F

from jetforge.sources import folder, jet_csv


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("folder")
    (root / "deep er").mkdir()
    for k in range(6):
        where = root / "deep er" if k % 2 else root
        (where / f"{k}_HF_0.csv").write_text(f"# centrality={k % 2} harmonics=3 events={10 * k} version=1\n" + "".join(f"{k},{i}\n" for i in range(k)))
    (root / "old_HF_0.csv").write_text("no settings\n1,2\n")
    (root / "empty_HF_0.csv").write_text("")
    (root / "other.csv").write_text("# centrality=1 harmonics=3 events=5 version=1\n9,9\n")
    (root / "notes.txt").write_text("nothing")
    return str(root)


def test_only_wanted_files_are_opened(spark, place):
    found = folder.file_headers(spark, place, ["centrality", "harmonics", "events", "version", "absent"], "HF_0.csv")
    rows = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert sorted(rows) == sorted([*(f"{k}_HF_0.csv" for k in range(6)), "old_HF_0.csv"])  # an empty file is no file of the reader's
    assert (rows["3_HF_0.csv"].centrality, rows["3_HF_0.csv"].events, rows["3_HF_0.csv"].absent) == (1, 30, None)
    assert rows["old_HF_0.csv"].centrality is None
    wanted = jet_csv.catalog_scan(found, name="path", centrality=1, version=1)
    data = folder.read_files(spark, wanted, "k int, i int")
    assert len(data.inputFiles()) == 3
    assert sorted((r.k, r.i) for r in data.collect()) == [(k, i) for k in (1, 3, 5) for i in range(k)]
    # The files of the catalog and of the rows have the same names.
    assert data.select("path").distinct().join(wanted, "path").count() == 3


def test_listing_reads_no_content(spark, place):
    plan = folder.list_files(spark, place, ".csv")._jdf.queryExecution().toString()
    assert "content" not in plan.split("== Physical Plan ==")[1]
    assert folder.list_files(spark, place).count() == 9


def test_nothing_wanted(spark, place):
    found = folder.file_headers(spark, place, ["centrality"], ".csv")
    assert folder.read_files(spark, found.where("centrality = 9"), "k int").count() == 0
    assert folder.file_headers(spark, place, ["centrality"], ".nothing").count() == 0


def test_paths_that_can_only_be_read_whole(spark, place, monkeypatch):
    names = ["centrality", "events"]
    want = sorted(map(tuple, folder.file_headers(spark, place, names, ".csv").collect()), key=str)
    monkeypatch.setattr(folder, "RANGED", {})
    assert sorted(map(tuple, folder.file_headers(spark, place, names, ".csv").collect()), key=str) == want
