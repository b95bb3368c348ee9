import os
import shutil

from tonarm.sources.inventory import Inventory


def touch(root, *paths):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"x")


def settle(root):
    """Gives all folders a time long ago, so that they count as settled."""
    for at, _, _ in os.walk(root):
        os.utime(at, (1_000_000, 1_000_000))


def changes(listing):
    return {tuple(r) for r in listing.changes().collect()}


def test_only_changed_folders_are_listed(spark, tmp_path):
    root = tmp_path / "root"
    touch(root, "top.mp3", "a/1.mp3", "a/x/2.mp3", "b/3.mp3", "b/3.txt", "c d/é 4.mp3", "gone/5.mp3", "gone/deep/6.mp3")
    (root / "empty").mkdir()
    settle(root)
    listing = Inventory(spark, str(root), str(tmp_path / "states"), settled=3_600)
    assert listing.update() == 1
    first = {"top.mp3", "a/1.mp3", "a/x/2.mp3", "b/3.mp3", "c d/é 4.mp3", "gone/5.mp3", "gone/deep/6.mp3"}
    assert changes(listing) == {("added", p) for p in first}
    assert listing.update() == 2 and changes(listing) == set()
    assert listing.folders().where("listed").count() == 0 and {r["path"] for r in listing.files().collect()} == first
    touch(root, "a/x/7.mp3", "new/8.mp3")
    (root / "b/3.mp3").unlink()
    shutil.rmtree(root / "gone")
    assert listing.update() == 3
    assert changes(listing) == {("added", "a/x/7.mp3"), ("added", "new/8.mp3"), ("removed", "b/3.mp3"), ("removed", "gone/5.mp3"), ("removed", "gone/deep/6.mp3")}
    assert {r["folder"] for r in listing.folders().where("listed").collect()} == {"", "a/x", "new", "b"}
    # What changed just now is not settled: listed again, without a change.
    assert listing.update() == 4 and changes(listing) == set()
    assert {r["folder"] for r in listing.folders().where("listed").collect()} == {"", "a/x", "new", "b"}
    assert listing.update(full=True) == 5 and listing.folders().where("NOT listed").count() == 0 and changes(listing) == set()
    assert {r["path"] for r in listing.files().collect()} == (first | {"a/x/7.mp3", "new/8.mp3"}) - {"b/3.mp3", "gone/5.mp3", "gone/deep/6.mp3"}


def test_a_run_that_broke_off_does_not_count(spark, tmp_path):
    root = tmp_path / "root"
    touch(root, "1.mp3")
    listing = Inventory(spark, str(root), str(tmp_path / "states"))
    listing.update()
    listing.files().write.parquet(str(tmp_path / "states/run2/files"))  # files alone
    assert listing.runs() == 1 and listing.update() == 2 and listing.files().count() == 1
    nowhere = Inventory(spark, str(tmp_path / "none"), str(tmp_path / "other"))
    assert nowhere.runs() == 0 and nowhere.update() == 1 and nowhere.files().count() == 0
