"""Rounded figures of the queries are those of their SQL, ties too."""

import random

import duckdb

from relaynote import config
from relaynote.operators import classify
from relaynote.plans import catalogue

TIES = [k / 20 / n for n in (8, 16, 23, 32, 64, 96) for k in range(0, 20 * n, 7)] + [0.5046875, 0.5203125, 1.0, 0.0, 0.0005, 1.0005, -0.0000005]


def test_rounding_is_that_of_sql(spark):
    con = duckdb.connect()
    rows = spark.createDataFrame([(x,) for x in [*TIES, None]], "x double")
    for digits in (6, 3):
        got = rows.select("x", catalogue._rounded(rows["x"], digits).alias("y")).collect()
        for x, y in got:
            assert y == con.execute(f"select round(?::double, {digits})", [x]).fetchone()[0], x


def test_context_has_the_bits_of_sql(spark):
    con = duckdb.connect()
    rnd = random.Random(3)
    base = [(job, at, [rnd.randrange(1, 30) / rnd.randrange(30, 90) for _ in range(2)]) for job, n in enumerate((1, 2, 5, 40, 400)) for at in range(n)]
    secs = [config.Section(k, f"s{k}", f"t{k}") for k in range(2)]
    rows = spark.createDataFrame([(job, at, "x", own, [0.0, 0.05]) for job, at, own in base], "job_id long, sent_idx int, text string, base array<double>, boost array<double>")
    got = {(r["job_id"], r["sent_idx"]): (r["context"], r["combined"]) for r in classify.with_context(rows, secs).collect()}
    con.execute("create table b (job_id bigint, sent_idx int, ord int, base double, boost double)")
    con.executemany("insert into b values (?, ?, ?, ?, ?)", [(job, at, k, own[k], 0.05 * k) for job, at, own in base for k in range(2)])
    window = "window w as (partition by job_id, ord order by sent_idx rows between 3 preceding and 3 following exclude current row)"
    scored = f"select *, case when n = 0 then 0.0::double else s / n end as context from (select *, coalesce(sum(base) over w, 0) as s, count(*) over w as n from b {window})"
    for job, at, k, context, combined in con.execute(f"select job_id, sent_idx, ord, context, 0.7::double * base + 0.3::double * context + boost from ({scored})").fetchall():
        assert (got[job, at][0][k], got[job, at][1][k]) == (context, combined), (job, at, k)
