"""Timers of the queue's streams against plain models, whatever the micro-batches."""

import datetime as dt
import random

import pandas as pd
import pytest

from terncove.streaming import expiry

START = dt.datetime(2024, 1, 1, 8)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def minute(m):
    return START + dt.timedelta(minutes=m)


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, folder, batches, columns, schema, build, name):
    folder.mkdir()
    for n, batch in enumerate(batches):
        frame = pd.DataFrame(batch, columns=columns)
        frame["at"] = frame["at"].astype("datetime64[us]")
        frame.to_parquet(folder / f"{n:03}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = build(stream).writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def model(events, ttl, until):
    """Plain simulation in time, with the clock standing at ``until`` in the end."""
    out, state = [], {}
    for at, _, i, wanted in sorted((e[2], e[1], e[0], e[3]) for e in events):
        status, claimed = state.get(i, ("queued", None))
        if status == "claimed" and at > claimed + ttl:
            status = "queued"
            out.append((i, "queued", claimed + ttl + dt.timedelta(milliseconds=1), "expired"))
        ok = {"claimed": status == "queued", "sent": status == "claimed", "failed": status == "claimed", "replied": status == "sent"}[wanted]
        if ok:
            status, claimed = wanted, at if wanted == "claimed" else claimed
        out.append((i, status, at, "event" if ok else "refused"))
        state[i] = status, claimed
    for i, (status, claimed) in state.items():
        if status == "claimed" and until > claimed + ttl:
            out.append((i, "queued", claimed + ttl + dt.timedelta(milliseconds=1), "expired"))
    return sorted(out)


@pytest.mark.parametrize("size", [7, 40])
def test_stale_claims_return(rocks, tmp_path, size):
    r = random.Random(1)
    events = sorted(((r.randint(0, 12), k, minute(r.randint(0, 700)), r.choice(["claimed", "claimed", "sent", "replied"])) for k in range(110)), key=lambda e: (e[2], e[1]))
    events += [(99, 1000, minute(3000), "claimed"), (98, 1001, minute(3001), "claimed")]  # time goes on
    batches = [events[k : k + size] for k in range(0, len(events), size)] + [[(97, 1002, minute(3002), "claimed")]]
    got = streamed(rocks, tmp_path / "e", batches, ["id", "seq", "at", "status"], "id long, seq long, at timestamp, status string", expiry.item_moves, f"moves{size}")
    rows = sorted((x.id, x.status, x.at, x.cause) for x in got.where("id < 97").collect())
    assert rows == model([e for e in events if e[0] < 97], dt.timedelta(minutes=120), minute(2990))
    assert any(x[3] == "expired" for x in rows)


def test_rolling_use_falls_by_timer(rocks, tmp_path):
    claims = [("instagram", i, minute(10 * i)) for i in range(30)]
    quiet = [("telegram", 1, minute(24 * 60 + 100)), ("telegram", 2, minute(24 * 60 + 125))]  # moves the clock only
    batches = [claims[:20], claims[20:], quiet[:1], quiet[1:], [("telegram", 3, minute(24 * 60 + 126))]]
    schema = "channel string, id long, at timestamp"
    got = streamed(rocks, tmp_path / "c", batches, ["channel", "id", "at"], schema, lambda s: expiry.rolling_used(s, shards=3), "used")
    used = {x.channel: x.used for x in expiry.channel_used(got).collect()}
    clock = minute(24 * 60 + 125 - 10)  # the watermark of the last batch
    assert used["instagram"] == sum(at > clock - dt.timedelta(days=1) for _, _, at in claims)
    assert used["telegram"] == 3
