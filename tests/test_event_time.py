import datetime as dt
import random

import pytest

from pagelattice.streaming import live, ordered

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    ordered.with_state_store(spark)
    yield spark
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def arriving(spark, path, schema, batches):
    """A stream with one batch for each list of rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{k:03d}")
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    return found


def ended(spark, df, path):
    live.start(df, f"{path}/out", f"{path}/ck").awaitTermination()
    return spark.read.parquet(f"{path}/out").collect()


NOTES = "key string, ts timestamp, id long, what string"


def shown_by_rule(notes, seconds):
    out, last = [], {}
    for key, ts, i, what in sorted(notes, key=lambda n: (n[0], n[1], n[2])):
        if key in last and last[key][0] == what and (ts - last[key][1]).total_seconds() < seconds:
            continue
        last[key] = (what, ts)
        out.append((key, i, what))
    return sorted(out)


def test_notes_out_of_order_over_batches(store, tmp_path):
    rng = random.Random(3)
    notes = [(f"k{rng.randint(0, 2)}", at(rng.randint(0, 4000) / 10), i, rng.choice("AAB")) for i in range(160)]
    late = sorted(notes, key=lambda n: n[1] + dt.timedelta(seconds=rng.random() * 20))  # up to 20 seconds out of order
    batches = [late[k : k + 20] for k in range(0, len(late), 20)]
    end = [[("z", at(9999), 999, "end")], [("z", at(19999), 1000, "end")]]  # moves the watermark past all notes
    stream = arriving(store, str(tmp_path), NOTES, batches + end)
    got = ended(store, ordered.suppressed(stream, 3.0, "60 seconds"), str(tmp_path))
    assert sorted((r.key, r.id, r.result) for r in got if r.key != "z") == shown_by_rule(notes, 3)
    in_arrival_order = [n for n in late if n[0] == "k0"]
    assert in_arrival_order != sorted(in_arrival_order, key=lambda n: n[1])


def test_a_note_is_forgotten(store, tmp_path):
    batches = [[("k", at(0), 1, "A")], [("k", at(1), 2, "A")], [("j", at(500), 3, "x")], [("j", at(1000), 4, "x")], [("k", at(1001), 5, "A")], [("j", at(3000), 6, "x")], [("j", at(4000), 7, "x")]]
    stream = arriving(store, str(tmp_path), NOTES, batches)
    q = live.start(ordered.suppressed(stream, 3.0, "10 seconds"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    got = {r.id for r in store.read.parquet(f"{tmp_path}/out").collect()}
    assert got >= {1, 3, 4, 5} and 2 not in got
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert states[-1] <= 6  # of k nothing is left but the timers of the last rows


def test_open_documents(store, tmp_path):
    events = [("a", at(0), 1, "open"), ("a", at(5), 2, "open"), ("b", at(6), 3, "close"), ("a", at(10), 4, "close"), ("a", at(12), 5, "open"), ("b", at(13), 6, "open"), ("a", at(20), 7, "close"), ("a", at(21), 8, "close")]
    mixed = [[events[1], events[0]], [events[4], events[2]], [events[3], events[5]], [events[7]], [events[6]], [("z", at(500), 99, "open")], [("z", at(900), 100, "open")]]
    got = ended(store, ordered.open_set(arriving(store, str(tmp_path), NOTES, mixed), "30 seconds"), str(tmp_path))
    want = [(1, "opened"), (2, "shown"), (4, "closed"), (5, "opened"), (6, "opened"), (7, "closed")]
    assert sorted((r.id, r.result) for r in got if r.key != "z") == want
    table = store.createDataFrame(events, NOTES)
    assert sorted((r.id, r.result) for r in ordered.open_set_batch(table).collect()) == want
    paths = store.createDataFrame([("a",), ("b",), ("b",), ("c",)], "path string")
    assert sorted(r.path for r in ordered.to_open(paths, store.createDataFrame([("a",), ("d",)], "path string")).collect()) == ["b", "b", "c"]


def test_requests_wait_between_batches(store, tmp_path):
    ask = lambda i, page, kind, cancelled=False: ("d", i, page, kind, cancelled)
    batches = [
        [ask(1, 5, 0), ask(2, 3, 1), ask(3, 3, 0), ask(4, 9, 2)],  # hands out (3, 0) and (3, 1)
        [ask(5, 9, 2, True), ask(6, 1, 3), ask(7, 8, 1)],  # (9, 2) goes; (1, 3) comes before (5, 0)
        [ask(8, 8, 1), ask(9, 2, 0)],  # (8, 1) waits already; (2, 0) comes before it
        [ask(10, 7, 0, True), ("e", 11, 1, 1, None)],  # hands out (8, 1)
        [ask(12, 4, 4)],
        [ask(13, None, None)],  # nothing waits any more
    ]
    stream = arriving(store, str(tmp_path), "key string, id long, page_no int, type int, cancelled boolean", batches)
    got = ended(store, ordered.queue(stream, 2), str(tmp_path))
    assert {(r.key, r.page_no, r.type, r.id) for r in got} == {("d", 3, 0, 3), ("d", 3, 1, 2), ("d", 1, 3, 6), ("d", 5, 0, 1), ("d", 2, 0, 9), ("d", 8, 1, 7), ("e", 1, 1, 11), ("d", 4, 4, 12)}
    assert all(r.turn in (1, 2) for r in got)
