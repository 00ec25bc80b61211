import random

import pytest
from lodeline.llm import warc


def pages(spark, n=400):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdef \n") for _ in range(rng.randint(0, 4000)))) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_archives_are_read_in_many_tasks(spark, tmp_path):
    manifest = warc.write_archives(pages(spark), str(tmp_path / "w"), shard_bytes=100_000, roll_bytes=8_000)
    files = manifest.count()
    found = warc.read_archives(manifest, str(tmp_path / "w"), with_payload=False)
    assert files > 50 and found.rdd.getNumPartitions() == min(files, warc.READ_TASKS) and "payload" not in found.columns
    used = found.selectExpr("spark_partition_id() AS p").distinct().count()
    assert used > 25 and found.count() == 400
    assert warc.read_archives(manifest.limit(2), str(tmp_path / "w")).rdd.getNumPartitions() == 2
    assert not (tmp_path / "w/_temporary").exists() and len(list((tmp_path / "w").glob("part-*.warc.gz"))) == files


def test_a_file_of_another_attempt_stays(spark, tmp_path):
    """A file that is there already is left alone, so a dying attempt can't take it away; one with other bytes is an error."""
    (tmp_path / "_temporary").mkdir()
    done = []
    for attempt in range(2):
        roll = warc._Roll(f"file://{tmp_path}", 3, 1 << 20)
        for i in range(5):
            roll.add(warc.record(i, None, b"x" * 2000))
        roll.close()
        done.append(roll.done)
        final = tmp_path / roll.done[0][2]
        if attempt == 0:
            made = final.stat().st_ino, final.read_bytes()
    assert done[0] == done[1] and (final.stat().st_ino, final.read_bytes()) == made and not list((tmp_path / "_temporary").iterdir())
    half = warc._Roll(f"file://{tmp_path}", 4, 1 << 20)
    half.add(warc.record(9, None, b"y"))  # an attempt that dies here has named nothing
    assert len(list(tmp_path.glob("part-*"))) == 1 and len(list((tmp_path / "_temporary").iterdir())) == 1
    final.write_bytes(b"other")
    again = warc._Roll(f"file://{tmp_path}", 3, 1 << 20)
    again.add(warc.record(0, None, b"z"))
    with pytest.raises(ValueError, match="5 bytes"):
        again.close()


def test_leftovers_do_not_count(spark, tmp_path):
    """Files of a dead attempt in the temporary folder, and others beside the archives, are not read."""
    target = tmp_path / "w"
    (target / "_temporary").mkdir(parents=True)
    (target / "_temporary/part-00000-00000.warc.gz.dead").write_bytes(b"half a file")
    (target / "part-00099-00000.warc.gz").write_bytes(b"not in the manifest")
    found = warc.round_trip(pages(spark, 50), str(target), shard_bytes=50_000, roll_bytes=8_000)
    assert sorted(r.page_id for r in found.collect()) == list(range(50)) and not (target / "_temporary").exists()
