"""Held uploads against a fold that says what it does, in batch and as a stream out of order."""

import datetime
import random

import pytest

from platen.operators import holding
from platen.streaming import holding as streamed

T0 = datetime.datetime(2024, 1, 1)
MINUTES, CAP = 30, 100
SCHEMA = f"store long, {holding.EVENTS}"


def made(seed, n=250):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        at = T0 + datetime.timedelta(seconds=rng.randrange(0, 6 * 3600), milliseconds=rng.randrange(1000))
        token = f"t{rng.randrange(25)}"
        put = rng.random() < 0.4
        rows.append((rng.randrange(3), at, "put" if put else "get", token, rng.choice([5, 20, 40, 130, None]) if put else None, rng.choice(["ann", "bob", None]) if put else None, None if put else rng.choice(["ann", "bob", None])))
    return rows


def brute(rows):
    """(store, at, kind, token, given) of each event, and (store, token) of what is held at the end."""
    out, held = [], {}
    order = lambda r: (r[1], r[2] == "get", r[3], r[4] is not None, r[4] or 0, r[5] is not None, r[5] or "", r[6] is not None, r[6] or "")
    hold = datetime.timedelta(minutes=MINUTES)
    for store, at, kind, token, size, owner, caller in sorted(rows, key=order):
        own = held.setdefault(store, {})
        given = True
        if kind == "put":
            own.pop(token, None)
            for t in [t for t, h in own.items() if h["ends"] < at]:
                del own[t]
            while own and sum(h["size"] for h in own.values()) + (size or 0) > CAP:
                del own[min(own, key=lambda t: (own[t]["ends"], own[t]["turn"]))]
            own[token] = {"ends": at + hold, "size": size or 0, "owner": owner, "turn": len(out)}
        else:
            found = own.get(token)
            if found and found["ends"] < at:
                del own[token]
                found = None
            if found:
                found["ends"] = at + hold
            given = bool(found and (not found["owner"] or found["owner"] == caller))
        out.append((store, at, kind, token, given))
    return sorted(out), {(s, t) for s, own in held.items() for t in own}


def collected(df):
    return sorted((r["store"], T0 + datetime.timedelta(microseconds=r["micros"] - int(T0.replace(tzinfo=datetime.UTC).timestamp() * 1_000_000)), r["kind"], r["token"], r["given"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_batch_by_brute_force(spark, seed):
    rows = made(seed)
    odd = [(1, None, "put", "x", 1, None, None), (1, T0, "look", "x", 1, None, None), (1, T0, "get", None, None, None, None)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    want, held = brute(rows)
    assert collected(holding.answers(df, "store", MINUTES, CAP)) == want and any(w[4] for w in want if w[2] == "get")
    assert {(r["store"], r["token"]) for r in holding.still_held(df, "store", MINUTES, CAP).collect()} == held
    assert holding.answers(df.limit(0), "store").count() == holding.still_held(df.limit(0), "store").count() == 0


def test_stream_out_of_order_is_the_batch_fold(spark, tmp_path):
    before = spark.conf.get(streamed.PROVIDER[0])
    spark.conf.set(*streamed.PROVIDER)
    try:
        rows = sorted(made(9, 120), key=lambda r: r[1])
        rng = random.Random(2)
        late = sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=rng.uniform(0, 20)))  # up to twenty minutes out of order
        files = [late[i : i + 30] for i in range(0, len(late), 30)] + [[(0, rows[-1][1] + datetime.timedelta(hours=2), "get", "end", None, None, None)]]
        for i, part in enumerate(files):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
        answers = streamed.answers(stream, "store", "21 minutes", MINUTES, CAP)
        query = answers.writeStream.format("memory").queryName("held_answers").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).outputMode("append").start()
        assert query.awaitTermination(240)
        got = collected(spark.table("held_answers"))
        assert got == brute(rows)[0]
    finally:
        spark.conf.set(streamed.PROVIDER[0], before)


def test_owner_and_clock(spark):
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    rows = [(1, at(0), "put", "a", 60, "ann", None), (1, at(1), "put", "b", 30, None, None), (1, at(20), "get", "a", None, None, "bob"), (1, at(40), "get", "a", None, None, "ann"), (1, at(40), "get", "b", None, None, "ann"), (1, at(41), "put", "c", 50, None, None), (1, at(42), "get", "a", None, None, "ann")]
    got = [(r["token"], r["given"]) for r in holding.answers(spark.createDataFrame(rows, SCHEMA), "store", MINUTES, CAP).orderBy("micros", "token").collect()]
    # asked for by another it isn't given, but its clock starts anew; the one that ends first makes room
    assert got == [("a", True), ("b", True), ("a", False), ("a", True), ("b", False), ("c", True), ("a", False)]
