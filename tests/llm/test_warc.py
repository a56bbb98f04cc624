import base64
import hashlib

import pyarrow.fs as pafs
import pytest

from evenkeel.llm import queries, warc
from evenkeel.session import new_path

SF = "/root/testdata/sf0.001"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, at_least):
    groups = {}
    for i, h in rows:
        if i is not None and len((h or "").encode()) >= at_least:
            groups[h or ""] = max(i, groups.get(h or "", i))
    out = []
    for i, h in rows:
        largest = groups.get(h or "", i) if i is not None else None
        again = largest != i
        kind = "revisit" if again else "response"
        out.append((i, len((h or "").encode()), digest(h), kind, largest if again else None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame(
        [(i, f"http://x/{i}\r\nX: y" if i else None, h, "x", "x", "x") for i, h in rows],
        "page_id long, url string, html string, payload string, part string, refers_to string",
    )


def back(spark, folder):
    return sorted((tuple(r)[:5] for r in warc.read_warc(spark, folder).collect()), key=str)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "é" * 9), (7, "a"), (7, "a"), (None, "a"), (8, "x\r\n\r\ny" * 10**5)]


@pytest.mark.parametrize("at_least", [0, 2])
def test_round_trip(spark, at_least):
    folder = new_path(spark, "warc")
    manifest = warc.write_warc(pages(spark, ROWS), folder, at_least).collect()
    assert sum(m.records for m in manifest) == len(ROWS)
    assert back(spark, folder) == expected(ROWS, at_least)


def test_a_payload_of_most_pages_and_no_broadcast(spark):
    rows = [(i, "" if i % 4 else f"page {i // 8}") for i in range(3000)] + [(11, "other"), (12, "")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folder = new_path(spark, "warc")
        warc.write_warc(pages(spark, rows), folder)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert back(spark, folder) == expected(rows, 0)


def test_a_second_attempt_leaves_a_whole_file_and_replaces_a_cut_off_one(spark):
    folder = new_path(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)

    def attempt():
        roll = warc.Roll(folder, 3, 1 << 20)
        roll.add(1, warc.page_record(1, "u", b"payload", None))
        return roll.close()

    entry = attempt()
    fs, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/{entry['file']}"
    first = fs.get_file_info(path).mtime_ns
    assert attempt() == entry and fs.get_file_info(path).mtime_ns == first
    with fs.open_output_stream(path, compression=None) as f:
        f.write(b"cut off")
    assert attempt() == entry and warc.Roll(folder, 3, 1)._sha1_of(path) == entry["sha1"]
    assert fs.get_file_info(pafs.FileSelector(f"{root}/_temporary")) == []


def test_payloads_come_back_whole(spark):
    folder = new_path(spark, "warc")
    warc.write_warc(pages(spark, ROWS), folder, 10**9)
    got = {(r.page_id, r.payload.decode()) for r in warc.read_warc(spark, folder, payloads=True).collect()}
    assert got == {(i, h or "") for i, h in ROWS}


def test_the_same_bytes_each_time_in_order_and_rolled(spark):
    rows = [(i, f"{hashlib.sha1(str(i).encode()).hexdigest()}" * 20) for i in range(200)]
    runs = []
    for _ in range(2):
        folder = new_path(spark, "warc")
        manifest = warc.write_warc(pages(spark, rows), folder, roll_bytes=4000).collect()
        runs.append(sorted((m.file, m.records, m.bytes, m.sha1, m.first_id, m.last_id) for m in manifest))
        fs, root = pafs.FileSystem.from_uri(folder)
        for m in manifest:
            with fs.open_input_stream(f"{root}/{m.file}", compression=None) as f:
                data = f.read()
            assert len(data) == m.bytes and hashlib.sha1(data).hexdigest() == m.sha1
        assert fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.NotFound
    assert runs[0] == runs[1] and len(runs[0]) > 4
    ends = [(a, b) for *_, a, b in runs[0]]
    assert ends == sorted(ends) and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))


def test_files_outside_the_manifest_do_not_count(spark):
    folder = new_path(spark, "warc")
    warc.write_warc(pages(spark, [(1, "a")]), folder)
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{root}/pages-999999-000000.warc.gz", compression=None) as f:
        f.write(warc.page_record(9, None, b"left behind", None))
    assert [r[0] for r in back(spark, folder)] == [1]


def test_damage_is_noticed():
    import gzip
    import io

    good = gzip.decompress(warc.page_record(1, "u", b"payload", None))
    for bad in (good.replace(b"payload", b"paylord"), good[:-12]):
        with pytest.raises(ValueError):
            [warc.page_row(*r, True) for r in warc.records(io.BytesIO(bad))]


def test_no_pages(spark):
    folder = new_path(spark, "warc")
    assert warc.write_warc(pages(spark, ROWS).limit(0), folder).count() == 0
    assert back(spark, folder) == []


def test_query_on_all_pages(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op8_warc"].run(spark, SF).collect()), key=str) == expected(rows, 0)
