"""A folder with one deep branch and links in circles, walked by rounds of bounded work."""

import os

from shelfspark.sources import books


def made(root):
    at = root
    for i in range(30):
        at = at / f"d{i}"
        at.mkdir(parents=True)
        (at / f"{i}.epub").write_bytes(b"x" * (i + 1))
        (at / ".hidden.epub").write_bytes(b"x")
    for i in range(20):
        (root / "wide" / f"w{i}").mkdir(parents=True)
        (root / "wide" / f"w{i}" / "b.pdf").write_bytes(b"y")
    (at / "up").symlink_to(root)  # back to the top
    (root / "wide" / "w3" / "self").symlink_to(root / "wide")
    (root / "wide" / "w4" / "other").symlink_to(root / "d0" / "d1")  # another name of a deep folder
    (root / "d0" / "to_wide").symlink_to(root / "wide")
    (root / "wide" / "w5" / "file.epub").symlink_to(root / "d0" / "0.epub")
    out = root.parent / "out"
    out.mkdir()
    (out / "x.epub").write_bytes(b"x")
    (root / "away").symlink_to(out)


def plainly(root):
    """Real files by the real folders they stand in, each folder once."""
    got = set()
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith(".")]
        got |= {os.path.join(folder, n) for n in names if not n.startswith(".") and os.path.realpath(os.path.join(folder, n)).startswith(str(root))}
    return {os.path.realpath(os.path.dirname(p)) + "/" + os.path.basename(p) for p in got}


def test_rounds_of_bounded_work_find_every_folder_once(spark, tmp_path, monkeypatch):
    root = tmp_path / "books"
    made(root)
    for most in (1000, 3):
        rounds = []
        real = books.materialize
        monkeypatch.setattr(books, "materialize", lambda df, label, keep=rounds, real=real: keep.append(label) or real(df, label))
        rows = books.walked(spark, [str(root)], most).collect()
        monkeypatch.undo()
        assert not [r for r in rows if r.warning]
        found = [os.path.realpath(os.path.dirname(r.path)) + "/" + os.path.basename(r.path) for r in rows]
        assert len(found) == len(set(found)) and set(found) == plainly(root), most
        assert all(r.below == r.path[len(str(root)) + 1 :] and r.length == os.path.getsize(r.path) for r in rows)
        assert rounds.count("walk") == 1 if most == 1000 else rounds.count("walk") > 5


def test_one_task_is_not_given_all(spark, tmp_path):
    root = tmp_path / "books"
    made(root)
    held = list(books.visited(books.fs.LocalFileSystem(), str(root), str(root), [], 5))
    assert sum(x["kind"] == "folder" for x in held) == 5 and sum(x["kind"] == "open" for x in held) >= 1
