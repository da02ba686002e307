import hashlib

import pytest
import zstandard
from pyarrow import fs

from opsmill.llm import warc
from opsmill.llm.common import fresh_path


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, refers_to string").repartition(3)


def cases():
    long = "<p>é</p>" * 40
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * 30) for k in range(60)] + [(100 + k, None, long) for k in range(40)]
    rows += [(200, "http://h/a\r\nX: y", "short"), (201, "u", "short"), (202, "u", None), (203, "u", "")]
    rows += [(204, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (None, "u", long), (7, "u", rows[3][2]), (100, None, long)]
    return [*rows, (300, "u", "z" * 3_000_000)]


def brute(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= 100:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        again = i is not None and to is not None and i > to
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bundle_bytes", [1 << 24, 2000])
def test_round_trip(spark, bundle_bytes, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", bundle_bytes)
    rows, folder = cases(), fresh_path(spark, "warc")
    index = warc.write_bundles(pages(spark, rows), folder)
    found = sorted((tuple(r) for r in warc.read_bundles(index, folder).collect()), key=repr)
    assert found == brute(rows)
    whole = {(r.page_id, bytes(r.payload)) for r in warc.fetch(index, folder).collect()}
    wanted = {(i, b"" if kind == "revisit" else (html or "").encode()) for i, _, html in rows for j, *_, kind, _ in [next(b for b in brute([*rows]) if b[0] == i and b[2] == hashlib.sha256((html or "").encode()).hexdigest())]}
    assert whole == wanted


def test_bundles_are_plain_zstandard(spark):
    folder = fresh_path(spark, "warc")
    names = {r.bundle for r in warc.write_bundles(pages(spark, cases()), folder).collect()}
    store, root = fs.FileSystem.from_uri(folder)
    there = [f.base_name for f in store.get_file_info(fs.FileSelector(root))]
    assert sorted(there) == sorted(names)
    for name in names:
        with store.open_input_file(f"{root}/{name}") as stream:
            data = stream.read()
            frames = [warc.read_frame(stream, f) for f in warc.seek_table(stream)]
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert plain == b"".join(frames)
        at = 0
        while at < len(plain):
            fields, head, _, at = warc.parse(plain, at)
            assert head.startswith(b"HTTP/1.1 200") and "X" not in fields


def test_empty(spark):
    folder = fresh_path(spark, "warc")
    index = warc.write_bundles(pages(spark, []), folder)
    assert index.collect() == [] and warc.read_bundles(index, folder).collect() == []
