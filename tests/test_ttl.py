import random

import pytest

from landfold.streaming import ttl


def direct(ops):
    """Each key's operations one after the other; answers of gets and what ran out, at the end of time."""
    out, held = [], {}
    for key, op, value, life, at, seq in sorted((o for o in ops if o[0] is not None and o[4] is not None and o[1] in ttl.OPS), key=lambda o: (o[4], o[5])):
        if key in held and held[key][1] is not None and held[key][1] < at:
            out.append((key, "expired", *held.pop(key), None))
        if op == "get":
            out.append((key, "get", held.get(key, (None, None))[0], at, seq))
        elif op == "drop" or (life is not None and life <= 0):
            held.pop(key, None)
        else:
            held[key] = (value, None if life is None else at + life)
    return out, held


def operations(rng, n):
    out = []
    for i in range(n):
        at = 1_000_000 + i * 100 + rng.randint(-2000, 2000)
        out.append((rng.choice(["a", "b", "bb", "c", None]), rng.choice(["put", "put", "get", "get", "drop", "what"]), rng.choice(["x", "y", None]), rng.choice([500, 3000, 20_000, None, 0]), at, i))
    return [*out, ("a", "put", "z", 5, None, 999)]


def land(spark, path, ops, files):
    size = -(-len(ops) // files)
    for i in range(files):
        spark.createDataFrame(ops[i * size : (i + 1) * size], ttl.OPERATIONS).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("stopped", [False, True])
def test_answers_equal_one_run_over_all(spark, tmp_path, stopped):
    ops = operations(random.Random(6), 160)
    end = [("end", "get", None, None, 10**9, 1000)]  # moves the watermark past all others
    landed, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    first, rest = (ops[:80], ops[80:]) if stopped else (ops, [])
    land(spark, landed, first, 3)
    ttl.run(spark, landed, out, checkpoint, "5 seconds", 1).awaitTermination()
    if stopped:  # another run goes on from the checkpoint
        assert 0 < spark.read.schema(ttl.ANSWERS).parquet(out).count()
        land(spark, landed, rest, 2)
    land(spark, landed, end, 1)
    ttl.run(spark, landed, out, checkpoint, "5 seconds", 1).awaitTermination()
    want, left = direct(ops)
    # the watermark runs to 5 seconds before the end
    want += [(k, "expired", *left.pop(k), None) for k in list(left) if left[k][1] is not None]
    got = [tuple(r) for r in spark.read.schema(ttl.ANSWERS).parquet(out).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(x[1] == "expired" for x in want) and any(x[2] for x in want if x[1] == "get")
    assert sorted((r.key, r.value, r.expire_at) for r in ttl.held(spark, checkpoint).collect()) == sorted((k, v, ttl.FOR_EVER) for k, (v, _) in left.items())
    assert sorted(r.key for r in ttl.keys(spark, checkpoint, "*b*").collect()) == sorted(k for k in left if "b" in k)
    assert sorted(r.key for r in ttl.keys(spark, checkpoint).collect()) == sorted(left)
