"""WARC archives against a plain reading of their bytes and of the rules."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from quillon.llm import warc

SCHEMA = "page_id long, url string, html string, key string, mark int, shard int"


def rows():
    long, other = "<p>é🙂 " + "x" * 1200, "y" * 999
    out = [(i, f"http://h/{i}", long if i % 3 == 0 else f"{i} " * 900) for i in range(60)]
    out += [(i, f"http://s/{i}", other) for i in range(60, 70)]  # equal, too small
    out += [(70, None, None), (71, "http://e\r\nX: y z", ""), (None, "http://n", long), (None, "http://n2", "null key " * 200), (None, "http://n3", "null key " * 200)]
    out += [(57, "http://a", long)] * 2 + [(80, "http://t/2", "tie " * 400), (80, "http://t/1", "tie " * 400), (80, "http://t/1", "tie " * 400), (5, "http://z", "z" * 300_000)]
    return [(*r, "k", 7, 9) for r in out]


def parsed(folder):
    """(fields, block) of every record of every committed file, by the standard library."""
    out = []
    for f in sorted(Path(folder.removeprefix("file:")).glob("part-*.warc.gz")):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            out.append((fields, rest[:n]))
            data = rest[n + 4 :]
    return out


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def want(least=1000):
    """(page_id, bytes, digest, type, refers_to) of every row, sorted."""
    out = []
    for text in {r[2] or "" for r in rows()}:
        data = text.encode()
        same = sorted(((r[0], r[1] or "") for r in rows() if (r[2] or "") == text), key=lambda r: (r[0] is not None, r[0] or 0, [-ord(c) for c in r[1]]))
        for i, (page, _) in enumerate(same):
            first = i == len(same) - 1 or len(data) < least
            out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", None if first else same[-1][0]))
    return sorted(out, key=str)


def test_archive_holds_every_row(spark, pages, tmp_path):
    folder = f"file:{tmp_path}/a"
    files = warc.write_archive(pages.repartition(7), folder, roll=2000)
    found = warc.read_archive(spark, folder).collect()
    assert sorted([(r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=str) == want()
    assert all(r.intact for r in found) and len({r.record_id for r in found}) == len(rows())
    ids = {r.record_id: r for r in found}
    for r in found:
        if r.record_type == "revisit":
            assert ids[r.refers_to_id].record_type == "response" and ids[r.refers_to_id].key == r.refers_to and r.payload is None
        else:
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    assert any(r.uri == "http://e%0D%0AX:%20y%20z" for r in found)
    plain = parsed(folder)
    info = [f["WARC-Filename"] for f, _ in plain if f["WARC-Type"] == "warcinfo"]
    assert info == sorted(r.name for r in files.collect()) and len(info) > 10
    for f, block in plain:
        if f["WARC-Type"] != "warcinfo":
            assert base64.b32encode(hashlib.sha1(block).digest()).decode() == f["WARC-Block-Digest"].removeprefix("sha1:")
    keys = [int(f["Record-Key"]) if "Record-Key" in f else -1 for f, _ in plain if f["WARC-Type"] != "warcinfo"]
    assert keys == sorted(keys)
    for r in files.collect():
        data = Path(f"{tmp_path}/a/{r.name}").read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)


def test_archive_does_not_depend_on_partitions(pages, tmp_path):
    one = warc.write_archive(pages.coalesce(1), f"file:{tmp_path}/a").orderBy("name").collect()
    many = warc.write_archive(pages.repartition(9, "url"), f"file:{tmp_path}/b").orderBy("name").collect()
    assert one == many and one


def test_commit(spark, pages, tmp_path, monkeypatch):
    """A writer that dies before the commit leaves no archive; what it left does not disturb the next; a committed one is kept."""
    folder = f"file:{tmp_path}/a"

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(warc, "_renamer", dies)
        with pytest.raises(OSError, match="lost"):
            warc.write_archive(pages, folder)
    assert not Path(f"{tmp_path}/a/_manifest").exists() and list(Path(f"{tmp_path}/a").glob(".tmp-*"))
    warc.write_archive(pages, folder)
    Path(f"{tmp_path}/a/part-999999-00000.warc.gz").write_bytes(b"stray")
    assert warc.read_archive(spark, folder, payload=False).count() == len(rows())
    with pytest.raises(FileExistsError):
        warc.write_archive(pages, folder)
    data = Path(f"{tmp_path}/a/{warc.archive_files(spark, folder).first()['name']}")
    data.write_bytes(data.read_bytes()[:-9])
    with pytest.raises(Exception, match="not complete"):
        warc.read_archive(spark, folder, payload=False).count()


def test_rename_runs_again(tmp_path):
    """A task that is run again finds its files renamed."""
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.1").write_bytes(b"abc")
    batch = warc._batch([(0, "x", "x.1", 3, 1, 0, 0, "")], warc.FILES)
    for _ in range(2):
        list(warc._renamer(f"file:{tmp_path}/t", f"file:{tmp_path}")([batch]))
    assert (tmp_path / "x").read_bytes() == b"abc"


def test_archive_of_nothing(spark, pages, tmp_path):
    assert warc.write_archive(pages.where("false"), f"file:{tmp_path}/e").count() == 0
    assert warc.read_archive(spark, f"file:{tmp_path}/e").count() == 0
