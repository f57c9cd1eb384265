import hashlib

from ledgerspark.llm import warc


def expected(rows):
    out, first = [], {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (h or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        keep = first.setdefault(digest, i) if len(raw) >= 100 else i
        out.append((i, len(raw), digest, "response" if keep == i else "revisit", None if keep == i else keep))
    return sorted(out, key=str)


def fake(n):
    inner = f"WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: {n}\r\n\r\nHTTP/1.1 200 OK\r\n\r\nxx"
    return warc.MAGIC + inner


def test_round_trip_with_quoted_magic_and_copies(spark):
    long = "<p>wörd</p>" * 40
    rows = [(1, "http://a", long), (2, "http://b\r\nX: y", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "ü", long + warc.MAGIC + "tail" + warc.MAGIC)]
    rows += [(7, "u", "a" + fake(23) + "\r\n\r\n" + fake(23) + "\r\n\r\n" + "z" * 300), (8, "u", warc.MAGIC), (None, "u", "é" * 70), (9, "u", "\r\n\r\n" * 30 + long), (-4, "u", long)]
    rows += [(100 + k, "u", f"{k} " * (k % 90)) for k in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = sorted(map(tuple, warc.warc_round_trip(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == expected(rows)


def test_no_pages(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
