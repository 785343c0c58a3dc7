"""Files that grow in place, followed by byte offsets."""

import os

import pytest

from tidewater.streaming import tail


@pytest.fixture
def follow(spark, tmp_path):
    def run(piece=tail.PIECE):
        rows = tail.follow(spark, f"file://{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/out", piece=piece).collect()
        return sorted((os.path.basename(r.file), r.start, r.line) for r in rows)

    (tmp_path / "in").mkdir()
    return run


def expected(folder):
    """The batch form: whole lines of what is there now."""
    out = []
    for f in folder.rglob("*.jsonl"):
        at, data = 0, f.read_bytes()
        for line in data.splitlines(keepends=True):
            if line.endswith(b"\n") and line.strip():
                out.append((f.name, at, line.decode("utf-8", "replace").strip()))
            at += len(line)
    return sorted(out)


def test_growth_restart_and_shrinking(follow, tmp_path):
    folder = tmp_path / "in"
    a, b = folder / "a.jsonl", folder / "deep" / "b.jsonl"
    b.parent.mkdir()
    assert follow() == []
    a.write_bytes(b"one\ntwo\n\nthr")
    b.write_bytes("été\r\n".encode())
    (folder / "c.other").write_text("not followed\n")
    assert follow() == expected(folder) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("b.jsonl", 0, "été")]
    with a.open("ab") as f:
        f.write(b"ee\nfour\n\xff\n")  # the line that had no end, and a byte that is no text
    assert follow() == expected(folder) and len(follow()) == 6
    assert follow() == expected(folder)  # nothing new
    a.write_bytes(b"new\n")  # shorter: rewritten
    assert follow() == expected(folder) == [("a.jsonl", 0, "new"), ("b.jsonl", 0, "été")]
    b.unlink()
    assert follow() == [("a.jsonl", 0, "new")]
    b.write_bytes(b"back\n")
    assert follow() == expected(folder)


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_share_a_file(follow, tmp_path, piece):
    (tmp_path / "in" / "x.jsonl").write_text("".join(f"{'y' * (i % 9)}{i}\n" for i in range(50)) + "tail without end")
    assert follow(piece) == expected(tmp_path / "in") and len(follow(piece)) == 50


def test_last_whole_line_is_found_backwards(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "LOOK", 4)
    store, _ = tail.fs.FileSystem.from_uri(f"file://{tmp_path}")
    for data, upto in ((b"", 0), (b"no end at all, and long", 0), (b"a\nlong tail", 2), (b"abc\n", 4), (b"\n" + b"x" * 40, 1)):
        (tmp_path / "f").write_bytes(data)
        assert tail._whole_lines(store, str(tmp_path / "f"), len(data)) == upto
