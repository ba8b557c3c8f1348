"""Boundary cases of the traffic operators on rows made by hand."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from trafficlens.functions import keys, scalars
from trafficlens.operators import health, locales, metrics, policy, refresh, storage
from trafficlens.operators.prefix_sum import as_of
from trafficlens.sources import config, requests, snapshot
from trafficlens.streaming import twins

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("query,allowed,want", [
    ("b=2&a=1", ["a", "b"], "a1b2"), ("a=1&b=2", ["a", "b"], "a1b2"), ("ab=c", ["a"], "abc"), ("a=bc", ["a"], "abc"),
    ("a=2&a=1", ["a"], "a2a1"), ("choice[name]=x&choices=y&cho=z", ["choice"], "choice[name]xchoicesy"), ("a", ["a"], "a"), ("=v&a=1", ["a"], "a1"),
    ("", ["a"], ""), ("??a=1", ["a"], "a1"), ("a=1&&b=2&", ["a", "b"], "a1b2"), ("a==1", ["a"], "a=1"), ("a%5B0%5D=1", ["a["], ""), (None, ["a"], ""), ("a=1", [], ""),
])
def test_canonical_keys(spark, query, allowed, want):
    pairs = keys.sort_pairs(keys.keep_prefixed(keys.parse_pairs(F.lit(query).cast("string")), allowed))
    assert one(spark, keys.canonical(pairs).alias("k"))["k"] == want


def test_decoded_keys(spark):
    pairs = keys.keep_prefixed(keys.parse_pairs(F.lit("a%5B0%5D=x+y&b=%zz"), decode=True), ["a[", "b"])
    assert one(spark, keys.canonical(keys.sort_pairs(pairs)).alias("k"))["k"] == "a[0]x yb%zz"


def test_xxh3_and_shards(spark):
    import xxhash

    r = one(spark, keys.xxh3(F.lit("abc")).alias("h"))["h"]
    assert r["key64"] % (1 << 64) == xxhash.xxh3_64_intdigest(b"abc")
    assert int.from_bytes(r["fingerprint"], "little") == xxhash.xxh3_128_intdigest(b"abc")
    assert one(spark, keys.shard_of_hash(F.lit(-1)).alias("s"))["s"] == 2047


def log(spark, rows):
    return spark.createDataFrame([(i, at(m), k, p, s, p if p != "/x" else None) for i, (m, k, p, s) in enumerate(rows)], "req_id long, ts timestamp_ntz, key string, path string, status int, rule_path string")


def test_hits_need_an_earlier_stored_answer(spark):
    rows = [(0, "a", "/v", 500), (1, "a", "/v", 200), (2, "a", "/v", 200), (2, "a", "/w", 500), (3, "a", "/x", 200), (0, "b", "/x", 200), (1, "b", "/v", 200), (1, "b", "/v", 200)]
    got = [r["outcome"] for r in storage.outcomes(log(spark, rows)).orderBy("req_id").collect()]
    assert got == ["error", "miss", "hit", "hit", "proxied", "proxied", "miss", "hit"]


def test_clear_starts_anew(spark):
    rows = [(0, "a", "/v", 200), (1, "c", "/clear", 200), (2, "a", "/v", 200), (1500, "a", "/v", 200), (1501, "c", "/clear", 200), (3000, "a", "/v", 200)]
    marked = storage.clear_epochs(log(spark, rows), F.col("path") == "/clear")
    got = [(r["epoch"], r["outcome"]) for r in storage.outcomes(marked, "epoch").where("key = 'a'").orderBy("req_id").collect()]
    assert got == [(0, "miss"), (1, "miss"), (1, "hit"), (2, "miss")]


def test_kinds_of_writes(spark):
    df = spark.createDataFrame([(1, at(0), "a", "p", "f"), (2, at(1), "a", "p", "f"), (3, at(2), "a", "q", "f"), (4, at(3), "a", "q", "g"), (5, at(0), "b", None, "f")], "req_id long, ts timestamp_ntz, key string, payload string, fp string")
    got = [r["kind"] for r in storage.classify_sets(df, "payload", "fp").orderBy("req_id").collect()]
    assert got == ["insert", "touch", "update", "collision", "insert"]


def test_payload_comparison(spark):
    long = b"a" * 8 + b"b" * 16 + b"c" * 8 + b"d" * 8
    cases = [(b"x", b"x", True, True), (b"x", b"y", False, False), (b"x" * 31, b"x" * 30 + b"y", False, False), (long, long[:10] + b"z" + long[11:], False, True), (long, long + b"e", False, False), (None, None, True, False)]
    for a, b, exact, probe in cases:
        x, y = (F.lit(None).cast("binary") if v is None else F.lit(bytearray(v)) for v in (a, b))
        r = one(spark, scalars.exact_equal(x, y).alias("e"), scalars.probe_equal(x, y).alias("p"))
        assert (r["e"], r["p"]) == (exact, probe), (a, b)


def test_formats(spark):
    cases = [(0, "0B", "0 B"), (1023, "1023B", "1.0 kB"), (1024, "1KB 0B", "1.0 kB"), (999, "999B", "999 B"), (1150, "1KB 126B", "1.1 kB"), (1250, "1KB 226B", "1.2 kB"), (1 << 20, "1MB 0KB", "1.0 MB"), ((1 << 40) + (3 << 30), "1TB 3GB", "1.1 TB")]
    for n, mem, size in cases:
        r = one(spark, scalars.fmt_mem(F.lit(n).cast("bigint")).alias("m"), scalars.fmt_bytes(F.lit(n).cast("bigint")).alias("b"))
        assert (r["m"], r["b"]) == (mem, size), n
    r = one(spark, scalars.rfc1123_ns(F.lit(0).cast("bigint")).alias("z"), scalars.rfc1123_ns(F.lit(1704067200 * 10**9 + 5).cast("bigint")).alias("t"), scalars.version_number(F.lit("v12")).alias("v"), scalars.version_number(F.lit("vx")).alias("w"))
    assert r["z"] is None and r["t"] == "Mon, 01 Jan 2024 00:00:00 UTC" and r["v"] == 12 and r["w"] == (1 << 63) - 1
    assert scalars.duration_ns("1h30m") == 5400 * 10**9 and scalars.duration_ns("500ms") == 5 * 10**8
    with pytest.raises(ValueError):
        scalars.duration_ns("soon")


def test_eviction_orders(spark):
    rows = [(f"k{s}{i}", s, at(i), i, 100) for s, n in ((0, 5), (1, 1), (2, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, shard int, ts timestamp_ntz, req_id long, weight long")
    gone = lambda **kw: [(r["shard"], r["recency"]) for r in policy.evict(df, **kw).orderBy("freed_before").collect()]
    assert gone(excess=350, order="documented") == [(0, 4), (0, 3), (0, 2), (0, 1)]
    assert gone(excess=350, order="reference") == [(0, 0), (0, 2), (0, 4), (2, 0)]
    assert gone(excess=0, order="documented") == []
    assert gone(excess=100, order="documented") == [(0, 4)]
    with pytest.raises(ValueError):
        policy.evict(df, 1, "other")


def test_victims_of_neighbours(spark):
    df = spark.createDataFrame([("a", 0, at(0), 1), ("b", 5, at(1), 2), ("c", 5, at(0), 3)], "key string, shard int, ts timestamp_ntz, req_id long")
    got = {r["shard"]: (r["from_shard"], r["victim"]) for r in policy.neighbour_victims(df, 8).collect()}
    assert got == {0: (0, "a"), 4: (5, "c"), 5: (5, "c"), 6: (5, "c")}


def test_stack_distance_equals_an_lru_list(spark):
    r = random.Random(2)
    seq = [r.choice("abcdefgh") for _ in range(200)]
    df = spark.createDataFrame([(i, at(i), k, i % 2) for i, k in enumerate(seq)], "req_id long, ts timestamp_ntz, key string, shard int")
    got = {x["req_id"]: x["distance"] for x in policy.stack_distances(df).collect()}
    for shard in (0, 1):
        stack = []
        for i, k in ((i, k) for i, k in enumerate(seq) if i % 2 == shard):
            assert got[i] == (stack.index(k) if k in stack else None)
            stack = [k] + [x for x in stack if x != k]


def test_frequency_estimates(spark):
    times = [0, 0, 0, 1, 3, 4, 4]
    df = spark.createDataFrame([(i, at(m), "a") for i, m in enumerate(times)], "req_id long, ts timestamp_ntz, key string")
    got = {r["win"]: r["estimate"] for r in policy.frequency_estimate(policy.window_frequency(df)).collect()}
    assert got == {at(0): 1, at(1): 2, at(3): 0, at(4): 1}


def test_refresh_gate_and_parameters(spark):
    hour = 3600 * 10**9
    rules = [("/r", True, True, 0, 0.0, 0.0), ("/off", True, False, hour, 0.9, 0.5), ("/own", True, True, 10 * hour, 0.9, 0.25), ("/plain", False, False, hour, 0.9, 0.9)]
    rules = spark.createDataFrame(rules, "path string, refresh_present boolean, refresh_enabled boolean, ttl_ns bigint, beta double, coefficient double")
    cfg = config.Config(ttl_ns=24 * hour, beta=0.4, coefficient=0.5)
    rows = [("/r", 12 * hour - 1), ("/r", 12 * hour), ("/r", 48 * hour), ("/off", 48 * hour), ("/own", 5 * hour), ("/plain", 12 * hour), ("/none", 24 * hour)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, path string, age bigint")
    got = refresh.with_probability(refresh.with_parameters(df, rules, cfg), F.col("age")).orderBy("id").collect()
    assert [r["stale"] for r in got] == [False, True, True, False, True, True, True]
    assert [round(r["probability"], 4) for r in got] == [0.0, 0.1813, 0.3297, 0.0, 0.3624, 0.1813, 0.3297]


def test_decisions_at_the_boundaries(spark):
    cases = [(50, 0.9, 0, "idle"), (51, 0.7, 0, "quarantine"), (51, 0.6999, 0, "throttle"), (51, 0.1, 0, "quarantine"), (51, 0.1001, 9, "quarantine"), (51, 0.1001, 8, "throttle"), (51, 0.0999, 1, "unthrottle"), (51, 0.0999, 0, "keep")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, total long, err_rate double, t int, want string")
    assert [r["decision"] for r in health.decide(df, F.col("t")).orderBy("id").collect()] == [c[3] for c in cases]


def test_throttled_rates(spark):
    for rate, n, want in ((10, 0, 10), (10, 9, 1), (150, 3, 105), (3, 9, 0), (10, 11, 1)):
        assert one(spark, health.throttled_rate(F.lit(rate), F.lit(n)).alias("r"))["r"] == want
    assert one(spark, health.unthrottled_rate(F.lit(95), F.lit(100)).alias("r"))["r"] == 100


def ticks(seed, n):
    r = random.Random(seed)
    t, out, good = 0, [], 0.7
    for _ in range(n):
        t += r.choice([60, 600, 4000, 30000])
        good = r.choice([0.02, 0.5, 0.98]) if r.random() < 0.05 else good
        if r.random() < 0.2:
            out.append((t, "window", None, r.choice([10, 51, 900]), r.choice([0.0, 0.05, 0.1, 0.3, 0.7, 0.9])))
        else:
            out.append((t, "probe", r.random() < good, 0, 0.0))
    return out


def test_state_machine_twins_agree(spark):
    """The fold of the batch form, the step of the streaming form, and the stream itself."""
    rows = [(f"b{s}", *e) for s in range(6) for e in ticks(s, 400)]
    schema = "backend string, at bigint, kind string, ok boolean, total bigint, err_rate double"
    df = spark.createDataFrame(rows, schema)
    got = {r["backend"]: r for r in health.replay(df).collect()}
    seen = set()
    for s in range(6):
        now, moves = ["healthy", 0, 0, 0, 0, 0], []
        for e in ticks(s, 400):
            move = twins.advance(now, e[0], e[1], bool(e[2]), e[3], e[4])
            if move:
                moves.append((e[0], move))
            assert now[0] != "buried" or not moves or moves[-1][1] == "bury"
        g = got[f"b{s}"]
        assert [g[c] for c in ("state", "throttles")] == now[:2] and [(m["at"], m["move"]) for m in g["moves"]] == moves
        seen |= {m for _, m in moves}
    assert {"quarantine", "cure", "kill", "throttle"} <= seen


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    for k in range(4):
        events.where(F.col("event_id") % 4 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    folder = tmp_path / "flat"
    folder.mkdir()
    for k, f in enumerate(sorted((tmp_path / "in").rglob("*.parquet"))):
        f.rename(folder / f"{k}.parquet")
    stream = twins.traffic(twins.read_events(spark, str(folder)), "60 days")
    batch = requests.from_events(events.withColumn("ts", F.col("ts").cast("timestamp")))
    for name, f in (("counters", lambda x: twins.windowed_counters(x, "1 day")), ("freq", lambda x: twins.frequencies(x, "1 hour")), ("err", lambda x: twins.error_windows(x, "1 day"))):
        got = sorted(map(tuple, twins.to_memory(f(stream), f"t_{name}", "complete").collect()))
        assert got == sorted(map(tuple, f(batch).collect())) and got


def test_health_stream(spark, tmp_path):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [(f"b{s}", *e) for s in range(3) for e in ticks(s, 200)]
        schema = "backend string, at bigint, kind string, ok boolean, total bigint, err_rate double"
        cut = sorted(r[1] for r in rows)[len(rows) // 2]
        for k, part in enumerate(([r for r in rows if r[1] <= cut], [r for r in rows if r[1] > cut])):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"p{k}"))
        folder = tmp_path / "flat"
        folder.mkdir()
        for k in (0, 1):
            f = next((tmp_path / f"p{k}").glob("*.parquet"))
            import os

            os.utime(f, (1000 + k, 1000 + k))
            f.rename(folder / f"{k}.parquet")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        got = sorted((r["backend"], r["at"], r["move"]) for r in twins.to_memory(twins.health_moves(stream), "moves").collect())
        want = sorted((r["backend"], m["at"], m["move"]) for r in health.replay(spark.createDataFrame(rows, schema)).collect() for m in r["moves"])
        assert got == want and got
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_frames(spark):
    data = [b"one", b"", b"three" * 100]
    framed = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "id int, d binary")
    good = b"".join(bytes(r["f"]) for r in framed.select("id", snapshot.frame(F.col("d")).alias("f")).orderBy("id").collect())
    zero = b"".join(bytes(r["f"]) for r in framed.select("id", snapshot.frame(F.col("d"), False).alias("f")).orderBy("id").collect())
    files = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(good[:8] + b"x" + good[9:])), ("cut", bytearray(good[:-1])), ("zero", bytearray(zero)), ("none", bytearray(b"")), ("stub", bytearray(b"abc"))], "path string, content binary")
    by = {}
    for r in snapshot.read_framed(files).orderBy("path", "offset").collect():
        by.setdefault(r["path"], []).append(r["status"])
    assert by == {"good": ["ok"] * 3, "bad": ["bad checksum", "ok", "ok"], "cut": ["ok", "ok", "truncated"], "zero": ["bad checksum", "ok", "bad checksum"], "stub": ["truncated"]}
    assert {r["status"] for r in snapshot.read_framed(files.where("path = 'zero'"), False).collect()} == {"ok"}


def test_versions(spark, tmp_path):
    import os

    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, shard int")
    base = str(tmp_path / "dumps")
    assert snapshot.Versions(spark, base).latest() is None and snapshot.Versions(spark, base).size() == 0
    for k in range(4):
        snapshot.dump(df.where(f"shard <= {k}"), base, keep=3)
    assert sorted(n for _, _, n in snapshot.Versions(spark, base).listed()) == [2, 3, 4]
    os.utime(f"{base}/v2", (4e9, 4e9))  # the version that changed last is the latest, whatever its number
    assert snapshot.Versions(spark, base).latest().endswith("v2") and snapshot.load(spark, base).count() == 1
    assert snapshot.load(spark, base, "v4").count() == 2 and snapshot.Versions(spark, base).next().endswith("v5")


def test_config():
    tree = {"cache": {"upstream": {"backend": {"id": "x", "enabled": True, "rate": 5, "timeout": "5s"}}, "rules": {"/a": None, "/b": {"refresh": {"enabled": True, "ttl": "12h"}}}}}
    c = config.from_mapping(tree)
    assert c.backends[0][:2] == ("x", True) and c.rules[0][4] is False and c.rules[1][4:7] == (True, True, 12 * 3600 * 10**9)
    for bad in ({"cache": {}}, {"cache": {"upstream": {"cluster": {"backends": [{"id": "x", "enabled": True, "rate": 1}, {"id": "x", "enabled": True, "rate": 1}]}}}}, {"cache": {"upstream": {"backend": {"id": "x", "rate": 0}}}}):
        with pytest.raises(ValueError):
            config.from_mapping(bad)


def test_locales(spark):
    rows = locales.rows()
    assert len({c for k, c, *_ in rows if k == "locale"}) == 83 and len({c for k, c, *_ in rows if k == "code"}) == 90
    dim = locales.dimension(spark)
    gaps = {(r["locale"], r["by"]) for r in locales.roundtrip_gaps(dim).collect()}
    assert gaps == {(x, by) for x in ("aa_ET", "sd_IN", "zu_ZA") for by in ("code", "translators")}
    df = spark.createDataFrame([("en",), ("gb",), ("xx",), (None,)], "c string")
    got = {r["c"]: (r["l"], r["ok"]) for r in locales.valid(locales.translate(df, "c", "code", "locale", "l", dim), "c", "code", "ok", dim).collect()}
    assert got == {"en": ("en_GB", True), "gb": ("en_GB", False), "xx": (None, False), None: (None, False)}


def test_generated_requests(spark):
    r = requests.generate(spark, 12).orderBy(F.desc("req_id")).first()
    assert r["query"].endswith("&choice" + "[choice]" * 6 + "=null") and "betting_live_null_11_11_11" in r["query"] and r["query"].count("&") == 9
    assert requests.generate_stream(spark, 5).isStreaming


def test_hit_rate_of_nothing(spark):
    df = spark.createDataFrame([(0, 0, 0, 0)], "hits long, misses long, errors long, proxied long")
    r = metrics.error_rate(metrics.hit_rate(df)).first()
    assert r["hit_rate"] == 0 and r["error_rate"] == 0


def test_clear_tokens(spark):
    from trafficlens.operators import control

    rows = [(1, 1, 0, None), (1, 2, 10, None), (1, 3, 20, "t1"), (1, 4, 30, "t1"), (1, 5, 40, None), (1, 6, 50, "bad"), (1, 7, 60, "t5"), (1, 8, 70, None), (1, 9, 70 + 300, "t8"), (1, 10, 400, None), (1, 11, 699, None), (1, 12, 700, None), (2, 13, 5, "t1")]
    df = spark.createDataFrame(rows, "instance int, req_id long, at long, token string")
    got = {r["req_id"]: (r["answer"], r["token"]) for r in control.clear_requests(df).collect()}
    assert [got[i][0] for i in range(1, 14)] == ["issued", "reused", "cleared", "refused", "issued", "refused", "refused", "issued", "refused", "issued", "reused", "issued", "refused"]
    assert got[2][1] == "t1" and got[11][1] == "t10" and got[12][1] == "t12"


@pytest.mark.parametrize("uses", [0, 0.02, 0.5])
def test_clear_tokens_do_not_depend_on_slices(spark, uses):
    """One fold over each instance's requests, nulls and equal times included, whatever the slices."""
    from trafficlens.operators import control

    r = random.Random(6)
    rows = [(r.choice([1, 2, None]), i, r.randrange(-2000, 60_000) if i % 50 else None, r.choice(["bad", f"t{i - 1}", f"t{i - 2}"]) if r.random() < uses else None) for i in range(900)]
    want = {}
    for instance in (1, 2, None):
        token, expires = "", 0
        for _, i, at, asked in sorted((x for x in rows if x[0] == instance), key=lambda x: (x[2] is not None, x[2] or 0, x[1])):
            live = token != "" and at is not None and at < expires
            if asked is not None:
                want[i] = ("cleared" if live and asked == token else "refused", asked, instance)
                token = ""
            else:
                token, expires = (token, expires) if live else (f"t{i}", at + 300) if at is not None else ("", 0)
                want[i] = ("reused" if live else "issued", token or f"t{i}", instance)
    df = spark.createDataFrame(rows, "instance int, req_id long, at long, token string")
    for width in (100, 3600, 86_400):
        got = {x["req_id"]: (x["answer"], x["token"], x["instance"]) for x in control.clear_requests(df, width).collect()}
        assert got == want, width
    assert control.clear_requests(df.limit(0)).count() == 0


def test_clear_tokens_of_a_busy_instance_take_time_in_proportion(spark):
    """100,000 requests of one instance: with an array of answers that is copied at each step, minutes."""
    from trafficlens.operators import control

    ids = spark.range(100_000)
    df = ids.select(F.lit(1).alias("instance"), F.col("id").alias("req_id"), (F.col("id") * 7).alias("at"), F.when(F.col("id") % 3 == 2, "wrong").alias("token"))
    began = time.monotonic()
    counts = {x["answer"]: x["count"] for x in control.clear_requests(df).groupBy("answer").count().collect()}
    assert counts == {"issued": 33_334, "reused": 33_333, "refused": 33_333} and time.monotonic() - began < 60


def test_replay_without_limit_is_the_plain_storage(spark):
    from trafficlens.operators import control

    r = random.Random(4)
    rows = [(i, at(i), r.choice("abcdefghij"), 0, r.randint(10, 40), r.random() < 0.8) for i in range(400)]
    df = spark.createDataFrame(rows, "req_id long, ts timestamp_ntz, key string, shard int, weight long, stored boolean")
    free = {x["req_id"]: x for x in control.replay_shards(df, 10**9).collect()}
    seen = set()
    for i, _, key, _, _, stored in rows:
        assert free[i]["outcome"] == ("hit" if key in seen else "insert" if stored else "miss")
        seen |= {key} if stored else set()
    tight = {x["req_id"]: x for x in control.replay_shards(df, 120, 86_400).collect()}
    assert all(x["mem"] <= 120 for x in tight.values())
    assert sum(x["outcome"] == "hit" for x in tight.values()) < sum(x["outcome"] == "hit" for x in free.values())
    assert {"rejected", "insert", "hit", "miss"} == {x["outcome"] for x in tight.values()} and any(x["evicted"] for x in tight.values())
    assert {x["outcome"] for x in control.replay_shards(df, 5).collect()} == {"rejected", "miss"}


def test_sources_by_settings(spark):
    from trafficlens.operators import control

    a, b = spark.range(2), spark.range(3)
    assert control.loaded(a, b, True, True, True).count() == 5 and control.loaded(a, b, True, False, True).count() == 3
    assert control.loaded(a, b, False, True, True) is None and control.loaded(None, b, True, True, False) is None


def _probes(*runs):
    """Events of one backend from (start, seconds between, probes, ok, requests in the window)."""
    return [("b", at + k * step, "probe", ok, total, 0.0) for at, step, n, ok, total in runs for k in range(n)]


@pytest.mark.parametrize(
    "events,moves",
    [
        # Quarantine sets the counts to zero: an hour later one failure doesn't kill, the sixth does.
        (_probes((0, 10, 6, False, 0), (3700, 10, 5, False, 0)), ["quarantine"]),
        (_probes((0, 10, 6, False, 0), (3700, 10, 6, False, 0)), ["quarantine", "kill"]),
        # A healthy backend with requests in the window isn't probed; a sick one is.
        (_probes((0, 10, 50, False, 1)), []),
        (_probes((0, 10, 6, False, 0), (100, 10, 6, True, 9)), ["quarantine", "cure"]),
        (_probes((0, 10, 3, False, 0), (40, 10, 3, False, 1), (80, 10, 3, False, 0)), ["quarantine"]),
    ],
)
def test_probes_by_batch_and_stream_alike(spark, events, moves):
    from trafficlens.streaming import twins

    df = spark.createDataFrame(events, "backend string, at bigint, kind string, ok boolean, total bigint, err_rate double")
    got = health.replay(df).collect()[0]
    now, streamed = ["healthy", 0, 0, 0, 0, 0], []
    for _, at, kind, ok, total, rate in events:
        streamed.append(twins.advance(now, at, kind, ok, total, rate))
    assert [m["move"] for m in got["moves"]] == moves == [m for m in streamed if m]
    assert (got["state"], got["suc"], got["err"]) == (now[0], now[2], now[3])


def test_payloads_that_are_cut_short(spark):
    from trafficlens.functions import codec

    pairs = F.array(F.struct(F.lit("a").alias("k"), F.lit("b").alias("v")))
    packed = codec.pack_payload(F.lit("/p"), F.lit(None).cast("string"), pairs, F.lit(404), F.lit(None).cast("array<struct<k: string, v: string>>"), F.lit("body"))
    data = bytes(spark.range(1).select(packed.alias("p")).first()["p"])
    assert codec.read_payload(data) == ("/p", "", [{"k": "a", "v": "b"}], 404, [], b"body", None)
    for k in range(1, len(data) - 4):
        assert codec.read_payload(data[:k])[-1] == codec.CUT
    assert codec.read_payload(b"")[-1] == codec.read_payload(None)[-1] == codec.EMPTY
    rows = spark.createDataFrame([(b"",), (b"\x05\x00\x00\x00ab",), (None,)], "r binary")
    rules = spark.createDataFrame([("/p",)], "path string")
    assert {r["error"] for r in codec.unpack_entries(rows, "r", rules).collect()} == {codec.CUT}


def test_as_of_takes_the_last_write_before(spark):
    rows = [("a", f"2024-01-0{d} 0{h}:00:00", 10 * d + h, w) for d, h, w in ((1, 1, True), (1, 2, False), (3, 1, False), (3, 2, True), (3, 3, True), (4, 1, False))]
    df = spark.createDataFrame([*rows, ("b", "2024-01-03 01:00:00", 99, False)], "key string, ts string, req_id long, w boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["req_id"]: r["last"] for r in as_of(df, "key", F.col("w"), F.col("req_id"), "last").collect()}
    assert got == {11: None, 12: 11, 31: 11, 32: 11, 33: 32, 41: 33, 99: None}
