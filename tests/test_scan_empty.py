"""Files without a byte, and documents without a text."""

import hashlib

from quireflow import plans
from quireflow.sources import files


def test_empty_files_are_found(spark, tmp_path):
    for name, data in {"part-0/a.txt": b"x", "part-0/b.txt": b"", "part-1/c.txt": b"", "part-1/d.bin": b"", "part-1/_e.txt": b"", "other/f.txt": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.label: (r.length, bytes(r.content)) for r in files.scan_corpus(spark, f"{tmp_path}/part-*", "*.{txt,md}").collect()}
    assert got == {"a.txt": (1, b"x"), "b.txt": (0, b""), "c.txt": (0, b"")}
    one = files.scan_corpus(spark, f"{tmp_path}/part-1/c.txt").collect()
    assert [(r.path, r.label, r.length) for r in one] == [(f"file:{tmp_path}/part-1/c.txt", "c.txt", 0)]
    assert one[0].mtime == files.scan_corpus(spark, f"{tmp_path}/part-1", "c*").first().mtime


def test_texts_that_are_empty_or_null(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "é")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, plans.queries()["scan_corpus"](spark, str(tmp_path)).collect()))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [("1.txt", 3, digest("a b")), ("2.txt", 0, digest("")), ("3.txt", None, None), ("4.txt", 2, digest("é"))]
