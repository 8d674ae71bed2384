import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import kernels as K


def events(seed, n, horizon, keys=3):
    rnd = random.Random(seed)
    return [
        (i, f"k{min(rnd.randrange(keys * 2), keys - 1)}", rnd.randrange(horizon), rnd.randrange(4), rnd.random() < 0.5)
        for i in range(n)
    ]


@pytest.mark.parametrize("seed,width,block,horizon,keys", [
    (1, 10, 10, 400, 3), (2, 7, 30, 400, 3), (3, 50, 60, 400, 3), (4, 1, 8, 400, 3),
    (5, 50, 200, 40, 1), (6, 5, 20, 30, 1), (7, 1000, 4000, 300, 2), (8, 3, 3, 6, 1), (9, 100, 400, 1, 1),  # crowded blocks are cut
])
def test_trailing_window_equals_loop(spark, seed, width, block, horizon, keys):
    rows = events(seed, 300, horizon, keys)
    df = spark.createDataFrame(rows, "id int, k string, t bigint, v int, f boolean")
    got = K.trailing_window(
        df, {"k": F.col("k")}, F.col("t"), width, query=F.col("v") > 0, keep={"id": F.col("id")},
        sums={"n": F.lit(1), "nf": F.col("f").cast("int")}, spans={"all": F.lit(True), "f": F.col("f")},
        distinct={"dv": F.when(F.col("f"), F.array(F.col("v").cast("string")))}, block=block,
    ).collect()
    got = {r.id: r for r in got}
    assert len(got) == sum(1 for r in rows if r[3] > 0)
    for i, k, t, v, f in rows:
        if v == 0:
            continue
        inside = [r for r in rows if r[1] == k and t - width <= r[2] <= t]
        flagged = [r for r in inside if r[4]]
        r = got[i]
        assert (r.n, r.nf, r.dv) == (len(inside), len(flagged), len({x[3] for x in flagged}))
        assert (r.all_first, r.all_last) == (min(x[2] for x in inside), max(x[2] for x in inside))
        if flagged:
            assert (r.f_first, r.f_last) == (min(x[2] for x in flagged), max(x[2] for x in flagged))


def test_a_crowded_block_is_dealt_out(spark):
    """Half of all rows stand on one key inside one window: no (key, block, sub-block) has more than twice a partition's share."""
    from pyspark.sql import Window

    n, width, block = 20_000, 1_000_000, 4_000_000
    ids = spark.range(n).withColumn("k", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)))
    df = ids.withColumn("t", F.when(F.col("k") == "hot", F.pmod(F.xxhash64("id"), F.lit(width))).otherwise(F.pmod(F.xxhash64("id"), F.lit(50 * width))))
    own = F.floor(F.col("_t") / block)
    base = df.select("k", F.col("t").alias("_t"))
    moved = base.select("k", own.alias("_blk"), F.col("_t").alias("_at"), F.lit(1).alias("_s_n"))
    placed = K._sub_blocks(base, moved, ["k", "_blk"], own, F.lit(False), width, block, ["n"], [], [])
    sizes = [r["count"] for r in placed.groupBy("k", "_blk", "_sub").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * n / 8 and max(sizes) < n / 2 / 3
    got = K.trailing_window(df, {"k": F.col("k")}, F.col("t"), width, F.lit(True), {"id": F.col("id")}, {"n": F.lit(1)}, {"x": F.lit(True)},
                            {"v": F.array(F.col("id").cast("string"), F.lit("same"))})
    up = Window.partitionBy("k").orderBy("t").rangeBetween(-width, 0)
    want = df.select("k", "id", F.count("*").over(up).alias("n"), F.min("t").over(up).alias("x_first"), (F.count("*").over(up) + 1).alias("v"))
    assert got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == n


def naive_suppress(rows, controls):
    out = {}
    for key in {r[1] for r in rows}:
        deadline, anchor = None, None
        log = [(t, 0, i, d) for i, k, t, d in rows if k == key] + [(t, 1, 0, 0) for k, t in controls if k == key]
        for t, ctl, i, d in sorted(log):
            if ctl:
                deadline = None
            elif deadline is None or t > deadline:
                deadline, anchor = d, i
                out[i] = (i, True)
            else:
                out[i] = (anchor, False)
    return out


@pytest.mark.parametrize("seed,w,block,own_time", [(6, 20, 4, False), (7, 30, 1, True), (8, 25, 5000, False), (9, 10, None, True), (1, 20, 20, False), (2, 15, 60, True), (3, 40, 90, False), (4, 5, 5, True)])
@pytest.mark.parametrize("with_control", [False, True])
def test_suppress_equals_loop(spark, seed, w, block, own_time, with_control):
    rnd = random.Random(seed)
    rows = []
    for i in range(250):
        t = rnd.randrange(600)
        anchor = t if own_time else t - rnd.randrange(w + 1)
        rows.append((i, f"k{rnd.randrange(3)}", t, anchor + w))
    controls = [(f"k{rnd.randrange(3)}", rnd.randrange(600)) for _ in range(12)] if with_control else []
    df = spark.createDataFrame(rows, "id bigint, k string, t bigint, d bigint")
    control = spark.createDataFrame(controls, "key string, t bigint") if with_control else None
    got = K.suppress(df, F.col("k"), F.col("id"), F.col("t"), F.col("d"), reach=w, block=block, control=control)
    assert {r.id: (r.anchor, r.fires) for r in got.collect()} == naive_suppress(rows, controls)


def test_fold_states_equals_loop(spark):
    from vigil.functions.fixed_values import NOTIFICATION_TRANSITIONS as T

    rnd = random.Random(5)
    names = list(T)
    rows = [(f"e{rnd.randrange(4)}", rnd.randrange(500), i, rnd.choice(names)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t bigint, seq bigint, a string")
    moves = {s: {n: n for n in targets} for s, targets in T.items()}
    got = K.fold_states(df, F.col("k"), F.col("t"), F.col("seq"), F.col("a"), "pending", moves, block=70).collect()
    want, state = {}, {}
    for k, t, i, a in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.get(k, "pending")
        ok = a in T[s]
        state[k] = a if ok else s
        want[i] = (s, state[k], ok)
    assert {r.seq: (r.before, r.after, r.accepted) for r in got} == want


def test_numbered_equals_sorted_position(spark):
    rnd = random.Random(6)
    rows = [(i, f"k{rnd.randrange(3)}", rnd.randrange(300)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, t bigint")
    got = {r.id: r.n for r in K.numbered(df, ["k"], "t", ["t", "id"], "n", block=40).collect()}
    for k in {r[1] for r in rows}:
        order = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))
