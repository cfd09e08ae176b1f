import glob
import hashlib
import io
import tarfile
import zlib

from ledgerlark.llm import media
from ledgerlark.llm.shared import fresh_path


def brute(text):
    raw = (text or "").encode()
    payload = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_whole_table(spark, sf, docs_rows):
    got = {r.doc_id: r for r in media.op5_media(spark, sf).collect()}
    for r in docs_rows:
        g = got[r["doc_id"]]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == brute(r["text"])
        m = media.encode(media.padded(r["text"].encode()))
        assert (g.media_bytes, g.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    assert len(got) == len(docs_rows)


def test_edges_ranges_and_damage(spark):
    texts = [None, "", "x", "y" * 64, "z" * 65, "é😀" * 100, "long " * 200_000, "same", "same"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "same", "c")], "doc_id long, text string, media string")
    folder = fresh_path(spark, "test-archives")
    rows = media.features(media.stored(df.coalesce(2), folder, range_bytes=1024, batch_bytes=100)).collect()
    assert len(rows) == 10
    for r in rows:
        assert r[1:5] == brute(texts[r.doc_id] if r.doc_id is not None else "same") and r.error is None
    assert len({tuple(r)[1:] for r in rows if r.n_bytes == 4}) == 1
    archives = sorted(glob.glob(f"{folder}/*.tar"))
    members = [m for a in archives for m in tarfile.open(a).getmembers()]
    assert len(members) == 10
    with open(archives[0], "r+b") as f:  # one damaged byte costs one member
        f.seek(512 + 30)
        f.write(b"\xff\x00\xff")
    again = media.features(spark.read.format("archives").load(folder)).collect()
    assert sorted(r.error or "" for r in again) == [""] * 9 + ["checksum differs"]
    empty = media.stored(df.limit(0))
    assert media.features(empty).count() == 0


def test_png_is_a_png():
    png = media.encode(media.padded(b"abc"))
    assert media.decode(png) == b"abc".ljust(64, b"\0")
    assert io.BytesIO(png).read(8) == media.PNG


def test_a_lost_member_is_told_by_the_query(spark, sf, monkeypatch):
    plain = media.write_archives

    def damaged(docs, folder, *args):
        plain(docs, folder, *args)
        archive = sorted(glob.glob(f"{folder}/*.tar"))[0]
        with open(archive, "r+b") as f:
            f.seek(512 + 20)
            f.write(b"\xff" * 4000)

    monkeypatch.setattr(media, "write_archives", damaged)
    rows = media.op5_media(spark, sf).collect()
    lost = [r for r in rows if r.payload_sha256 is None]
    assert len(rows) == 200 and 0 < len(lost) < 20 and all(r.error == "checksum differs" for r in lost)
    assert all(r.error is None for r in rows if r.payload_sha256)
