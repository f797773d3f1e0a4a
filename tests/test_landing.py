"""The landing source: what it lists, what a stream hands out, and restarts."""

import shutil

from ledgerloom.plans.intake import folder_verdicts, pdf_verdicts
from ledgerloom.schemas import Settings
from ledgerloom.sources import landing
from ledgerloom.streaming import intake

LIMIT = Settings(max_size_mb=1)


def fill(folder):
    for name, content in {
        "a.pdf": b"%PDF-1", "empty.pdf": b"", "b.txt": b"%PDF", "one/c.PDF": b"hello", "one/two/d.pdf": b"%PDF",
        "one/two/three/e.pdf": b"%PD", "x/empty": b"", "ñ ü+%20.pdf": b"%PDF", "huge.pdf": b"%PDF" + b"x" * (2 << 20),
    }.items():
        place = folder / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(content)


def test_scan_sees_every_file_once(spark, tmp_path):
    fill(tmp_path)
    for shares in (1, 3, 16):
        rows = landing.scan(spark, str(tmp_path), shares=shares, head=4, max_bytes=1 << 20).collect()
        got = {r.path: (r.filename, r.size_bytes, None if r.head is None else bytes(r.head)) for r in rows}
        want = {}
        for place in tmp_path.rglob("*"):
            if place.is_file():
                content = place.read_bytes()
                head = content[:4] if len(content) <= 1 << 20 else None
                want[str(place)] = (place.name, len(content), head)
        assert len(rows) == len(want) and got == want
    assert all(r.head is None for r in landing.scan(spark, str(tmp_path)).collect())
    assert landing.scan(spark, str(tmp_path / "nothing")).count() == 0


def test_verdicts_equal_those_of_scan_and_listing(spark, tmp_path):
    fill(tmp_path)
    columns = ["filename", "size_bytes", "accepted", "code", "reason"]
    want = sorted(map(tuple, folder_verdicts(spark, str(tmp_path), LIMIT).select(columns).collect()))
    assert sorted(map(tuple, pdf_verdicts(spark, str(tmp_path), LIMIT).collect())) == want


def run(spark, folder, out, checkpoint):
    intake.follow(spark, str(folder), str(out), str(checkpoint), LIMIT).awaitTermination()
    rows = intake.verdicts(spark, str(out)).collect()
    return sorted((r.filename, r.code) for r in rows)


def test_the_stream_hands_out_each_file_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    folder.mkdir()
    fill(folder)
    first = run(spark, folder, out, checkpoint)
    assert len(first) == 9 and ("empty.pdf", 400) in first and ("huge.pdf", 413) in first
    assert run(spark, folder, out, checkpoint) == first
    (folder / "late.pdf").write_bytes(b"")
    (folder / "one" / "later.pdf").write_bytes(b"%PDF")
    second = run(spark, folder, out, checkpoint)
    assert second == sorted([*first, ("late.pdf", 400), ("later.pdf", None)])


def test_a_batch_that_runs_again_hands_out_the_same_files(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"%PDF")
    first = run(spark, folder, out, checkpoint)
    (folder / "b.pdf").write_bytes(b"%PDF")
    run(spark, folder, out, checkpoint)
    # The last batch was planned and listed, but neither written nor committed.
    batch = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    for place in (checkpoint / "commits" / str(batch), out / "read" / "_spark_metadata" / str(batch)):
        place.unlink()
        shadow = place.parent / f".{place.name}.crc"
        if shadow.exists():
            shadow.unlink()
    (folder / "c.pdf").write_bytes(b"%PDF")
    run(spark, folder, out, checkpoint)  # the batch that was left, of the files it had
    assert run(spark, folder, out, checkpoint) == [*first, ("b.pdf", None), ("c.pdf", None)]


def test_old_entries_of_the_log_are_merged(tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "_LOGGED", 3)
    folder, log = tmp_path / "in", tmp_path / "log"
    folder.mkdir()
    source = landing.LandingStream({"path": str(folder), "log": str(log), "shares": "1"})
    at, handed = 0, []
    for turn in range(9):
        (folder / f"{turn}").write_bytes(b"x")
        end = at + 1
        (share,) = source.partitions({"listed": at}, {"listed": end})
        handed += [name for batch in source.read(share) for name in batch.column("filename").to_pylist()]
        at = end
    assert handed == [str(turn) for turn in range(9)]
    assert len(list((log / "share-0000").iterdir())) <= 5
    assert source.partitions({"listed": at}, {"listed": at}) == []
    shutil.rmtree(folder)
    assert landing.LandingStream({"path": str(folder), "log": str(log), "shares": "5"}).files.shares == 5
