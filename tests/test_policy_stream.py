"""Migrations that arrive one batch at a time, out of order and again, end where the batch fold ends."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tarnfall import queries
from tarnfall.operators.detect.row_security import final_state
from tarnfall.streaming import policy_state

ARRIVALS = [
    [("p/migrations/3_c.sql", "alter policy a on t rename to b; create table u (id int);"), ("q/schema.sql", "create table x (id int);")],
    [("p/migrations/1_a.sql", "create table t (id int); create policy a on t using (true);")],
    [("p/migrations/20_d.sql", "drop table u;"), ("p/migrations/2_b.sql", "alter table t enable row level security; alter policy a on t to editor;")],
    [("p/migrations/3_c.sql", "alter policy a on t rename to c;"), ("q/notes.sql", None), ("q/empty.sql", "")],
]


def test_late_and_repeated_files(spark, tmp_path):
    schema = "rel string, content string"
    for rows in ARRIVALS:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    policy_state.follow(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()
    updates = spark.read.parquet(f"{tmp_path}/out")
    assert updates.select("batch").distinct().count() == 4
    last = {rel: text for rows in ARRIVALS for rel, text in rows}  # a file that came again counts as it came last
    want = final_state(spark.createDataFrame([*last.items()], schema))
    got = policy_state.state_after(updates)
    # the first form of 3_c.sql made a table that its second form does not name: its effect on that table stays until the file names it
    rows = {repr(r) for r in got.select(want.columns).collect()}
    assert {repr(r) for r in want.collect()} <= rows
    assert [(r.table_name, r.policy) for r in got.where("what = 'policy'").collect()] == [("t", "c")]
    assert {r.table_name: r.enabled for r in got.where("what = 'table'").collect()} == {"t": True, "x": False}


def test_a_batch_is_dealt_out_whatever_its_keys(spark, tmp_path):
    """One file of one table's migrations: several tasks take them, and no state is kept for each key. The stream goes on from its checkpoint."""
    schema, one = "rel string, content string", "create table t (id int); create policy q on t using (true);"
    rows = [("p/migrations/0.sql", one), *((f"p/migrations/{k}.sql", f"alter policy q on t rename to x; alter policy x on t rename to q; alter policy q on t to role{k};") for k in range(1, 60))]
    for some in (rows[30:], rows[:30]):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        policy_state.follow(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()
    updates = spark.read.parquet(f"{tmp_path}/out")
    parts = updates.select("batch", F.input_file_name().alias("part")).distinct().groupBy("batch").count().collect()
    assert len(parts) == 2 and all(r["count"] > 1 for r in parts)
    assert not os.path.exists(f"{tmp_path}/checkpoint/state")
    want, got = final_state(spark.createDataFrame(rows, schema)), policy_state.state_after(updates)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert [list(r.roles) for r in got.where("what = 'policy'").collect()] == [["role59"]]


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["policy_state_stream"](spark, str(tmp_path)).collect() == []
