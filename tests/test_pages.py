import json
import random

import pytest

from landfold.operators import keyed, paging
from landfold.streaming import pages

READS = pages.Said("data.items", "data.has_more", "data.cursor", "data.total", "replies")


def landed(rng, rule):
    """Pages of streams as responses; some say nothing, some are no JSON."""
    out = []
    for s in range(20):
        asked = ""
        for p in range(rule.first, rng.randint(2, 9)):
            items = rng.choice([None, [], *[[{"id": f"{s}-{p}-{i}" if rng.random() < 0.8 else f"{s}-x", "n": p * 10 + i} for i in range(rng.randint(1, 6))]] * 8])
            cursor = rng.choice(["a", "b", "c", "0", "no_more", None])
            body = {"data": {"items": items, "has_more": rng.choice([True] * 6 + [False, None]), "cursor": cursor, "total": rng.choice([3, 40, 90])}, "replies": rng.choice([0, 1, None])}
            if items is None and rng.random() < 0.5:
                del body["data"]["items"]
            out.append((f"s{s}", p, asked, json.dumps(body) if rng.random() < 0.97 else "{no json"))
            asked = cursor or ""
    return out


def land(spark, path, rows):
    spark.createDataFrame(rows, pages.LANDED).coalesce(1).write.mode("append").json(path)


def batch(spark, rows, rule, most):
    """What the loop keeps of all pages at once."""
    said = READS.read(spark.createDataFrame(rows, pages.LANDED))
    return sorted((r.stream, r.page, r.pos, r.item) for r in paging.replay(said, rule, most).collect())


@pytest.mark.parametrize("name, most", [(("xhs", "comments"), 9), (("xhs", "replies"), 0), (("xhs", "search"), 60), (("bili", "comments with replies"), 3), (("wb", "creator"), 0), (("zhihu", "comments"), 0), (("tieba", "creator"), 0), (("tieba", "creator by url"), 7)])
def test_admission_equals_the_loop(spark, tmp_path, name, most):
    rule, rng = paging.RULES[name], random.Random(str(name))
    rows = landed(rng, rule)
    mixed = rows + rng.sample(rows, 10) + [(None, 1, "", "{}"), ("s1", None, "", "{}"), ("s1", -5, "", "{}")]
    rng.shuffle(mixed)
    path, out, checkpoint = (str(tmp_path / x) for x in ("landed", "out", "checkpoint"))
    for i in range(0, len(mixed), 45):
        land(spark, path, mixed[i : i + 45])
    own = pages.session(spark)
    stream = own.readStream.schema(pages.LANDED).option("maxFilesPerTrigger", 1).json(path)
    pages.admitted(READS.read(stream), rule, most).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(pages.KEPT).parquet(out).collect())
    want = batch(spark, rows, rule, most)
    assert got == want and len(want) > 30


class Killed(Exception):
    pass


def test_a_killed_run_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    rule, most, rng = paging.RULES["xhs", "comments"], 12, random.Random(4)
    rows = landed(rng, rule)
    rng.shuffle(rows)
    path = str(tmp_path / "landed")
    for i in range(0, len(rows), 20):
        land(spark, path, rows[i : i + 20])
    stores = [keyed.Store(spark, str(tmp_path / x), ["id"], ["__page", "__pos"]) for x in ("whole", "parts")]
    go = lambda store, checkpoint: pages.collected(spark, path, READS, rule, most, store, "id string, n int", str(tmp_path / checkpoint), files=1).awaitTermination()
    go(stores[0], "c0")
    write, calls = keyed.Store.write, []

    def dies(self, batch):
        calls.append(1)
        write(self, batch)
        if len(calls) == 3:  # after the store was written, before the checkpoint says so
            raise Killed

    monkeypatch.setattr(keyed.Store, "write", dies)
    with pytest.raises(Exception):  # noqa: B017
        go(stores[1], "c1")
    monkeypatch.setattr(keyed.Store, "write", write)
    assert len(calls) == 3
    go(stores[1], "c1")
    show = lambda s: sorted(tuple(r) for r in s.read().select("id", "n", "stream").collect())
    want = {}
    for stream, _, _, item in sorted(batch(spark, rows, rule, most), key=lambda x: x[1:3]):
        want[json.loads(item)["id"]] = (json.loads(item)["n"], stream)
    assert show(stores[0]) == show(stores[1]) == sorted((k, *v) for k, v in want.items())
