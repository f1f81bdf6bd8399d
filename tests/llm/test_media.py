import hashlib
import tarfile
import zlib
from pathlib import Path

import duckdb

from tidemark.llm import media
from tidemark.llm.shared import new_path


def want(text):
    raw = (text or "").encode()
    padded = raw + b"\xff" * (-len(raw) % 576)
    padded = padded or b"\xff" * 576
    return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])


def test_png_round_trip():
    for text in ("", "a", "é" * 288, "x" * 576, "y" * 577, "long " * 9000):
        samples = media.payload(text)
        image = media.to_png(samples)
        assert media.from_png(image) == samples
        assert media.png_header(image[: media.HEADER]) == (576, len(samples) // 576, 8, 0)
        assert media.feature(samples) == media.feature(media.payload(text))


def test_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = {r.doc_id: r for r in media.media_report(spark.read.parquet(path)).collect()}
    texts = dict(duckdb.sql(f"select doc_id, text from '{path}'").fetchall())
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want(text)
        assert r.height * r.width == r.payload_bytes and len(r.media_sha256) == 64


def test_shards_are_tar_files_with_each_image_once(spark):
    rows = [(1, None), (2, ""), (3, "same"), (4, "same"), (4, "same"), (None, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", media.F.lit(1)).repartition(3)
    folder = new_path(spark, "t")
    index, stored = (df.collect() for df in media.store_media(docs, folder))
    assert len(stored) == 3 and {(r.digest, r.shard, r.offset, r.length) for r in index} == {tuple(r) for r in stored}
    members = []
    for shard in {r.shard for r in index}:
        with tarfile.open(shard) as tar:
            members += [(shard, m.name, m.offset_data, m.size) for m in tar.getmembers()]
    assert set(members) >= {(r.shard, f"{r.digest}.png", r.offset, r.length) for r in index}
    raw = {r.digest: Path(r.shard).read_bytes()[r.offset : r.offset + r.length] for r in index}
    assert all(hashlib.sha256(b).hexdigest() == d for d, b in raw.items())
    report = media.media_report(docs).collect()
    assert len(report) == len(rows) and {r.payload_sha256 for r in report if r.doc_id in (1, 2)} == {want("")[2]}


def test_no_documents(spark):
    assert media.media_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_and_clashing_names(spark):
    long = "some words é " * 200_000
    names = ["digest", "shard", "offset", "length", "width", "feature", "home"]
    docs = spark.createDataFrame([(1, long, *names), (2, long, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(2)
    rows = media.media_report(docs).collect()
    assert [(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows] == [want(long)] * 2
    assert len({r.media_sha256 for r in rows}) == 1
