"""Records are cut out of a text without sorting or grouping its lines."""

import random
import re

from ledgerspark.plans.queries import QUERIES
from ledgerspark.sources import statements

SCHEMA = "portfolio_id string, path string, text string"


def plain_records(text):
    """(line_no, record) of all records that aren't empty."""
    out, quotes = [], 0
    for i, line in enumerate(re.split("\r\n|\r|\n", text.removeprefix("﻿"))):
        if quotes % 2 == 0:
            out.append([i + 1, line])
        else:
            out[-1][1] += "\n" + line
        quotes += line.count('"')
    return [(n, r) for n, r in out if r]


def fields_of(record):
    cells = re.findall(r',((?:[^,"]+|"[^"]*"?)*)', "," + record)
    return [re.sub(r'"([^"]*(?:""[^"]*)*)"?', r"\1", c).replace('""', '"') if '"' in c else c for c in cells]


def test_records_of_odd_texts(spark):
    r = random.Random(5)
    bits = ["a", '"', "\n", "\r", "\r\n", ",", "1:", "Trades,Data,", "12:x", '"a\nb"', " ", "é", "﻿", ":", "\x1e", "\n\n"]
    texts = ["", "﻿", "\n", '"', "7:a\n8:b"] + ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(200)]
    files = statements.identify(spark.createDataFrame([("p", f"f{i}", t) for i, t in enumerate(texts)] + [("p", "none", None)], SCHEMA)).dropDuplicates(["file_id"])
    got = statements.records(files).join(files.select("file_id", "text"), "file_id").select("text", "line_no", "fields").collect()
    want = sorted((t, n, fields_of(rec)) for t in set(texts) for n, rec in plain_records(t))
    assert sorted((g.text, g.line_no, g.fields) for g in got) == want


def test_a_file_is_read_once(spark):
    files = statements.identify(spark.createDataFrame([("p", "a", 'x,"1\n2"\ny,3'), ("p", "b", 'x,"1\n2"\ny,3'), ("q", "c", "y,3")], SCHEMA))
    got = sorted((r.portfolio_id, r.line_no, r.fields) for r in statements.records(files).collect())
    assert got == [("p", 1, ["x", "1\n2"]), ("p", 3, ["y", "3"]), ("q", 1, ["y", "3"])]


def test_lines_are_neither_sorted_nor_grouped(spark):
    files = statements.identify(spark.createDataFrame([("p", "a", "x,1\ny,2")], SCHEMA))
    plan = statements.records(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan and plan.index("Generate") < plan.index("Aggregate")


def test_blocks_of_the_same_text(spark, tmp_path):
    line = "timestamp '2001-02-03 00:00:00' AS l_shipdate, 'N' AS l_returnflag, 2.0D AS l_quantity, 10.5D AS l_extendedprice, 7L AS l_partkey"
    spark.sql(f"SELECT explode(array(1L, 2L, 2L, 501L, 502L, 502L, 1001L)) AS l_orderkey, {line}").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, QUERIES["statement_records"](spark, str(tmp_path)).collect())) == [(0, 3), (1, 3), (2, 1)]
