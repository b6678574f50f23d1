import hashlib
import re

import pytest

from wordloom.llm.exact_dedup import distinct_rows, exact_groups

SCHEMA = "doc_id long, text string, row long, sha string"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        group = sorted(((-len(t or ""), float("inf") if j is None else j) for (j, t), m in zip(rows, norm) if m == n))
        keep = group[0][1]
        out.append((i, None if keep == float("inf") else keep, len(group), hashlib.sha256(n.encode()).hexdigest()))
    return out


ROWS = [(5, "a b"), (3, "ab"), (7, "a  b"), (2, "a  b"), (9, None), (8, ""), (1, " \t\x0b"), (4, "é x"), (6, "éx"), (None, "lone"), (10, "x" * 200_000), (11, "x" * 200_000 + "\n"), (12, "ab\x85")]


def test_groups_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in ROWS], SCHEMA)
    got = exact_groups(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute(ROWS), key=key)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got if r.doc_id is not None)


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a", 0, "z")] * 4 + [(None, "b", 0, "z")] * 3, SCHEMA)
    got = exact_groups(df).collect()
    assert sorted((r.group_size, r.kept) for r in got) == [(3, False)] * 2 + [(3, True)] + [(4, False)] * 3 + [(4, True)]
    assert sorted(distinct_rows(df).collect(), key=lambda r: r.text) == [(1, "a", 0, "z"), (None, "b", 0, "z")]


def test_distinct_rows_keep_all_columns(spark):
    df = spark.createDataFrame([(i, t, n, f"s{n}") for n, (i, t) in enumerate(ROWS)], SCHEMA)
    got = distinct_rows(df)
    assert got.schema == df.schema
    keep = {k for _, k, _, _ in brute(ROWS)}
    assert {r.doc_id for r in got.collect()} == keep and got.count() == len(keep)


@pytest.mark.parametrize("run", [exact_groups, distinct_rows])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_rows(spark):
    rows = [(i, f"text {i % 700} {'x' * (i % 3)}") for i in range(3000)]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).repartition(7)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_groups(df).collect()) == sorted(brute(rows))
