"""Sharding against a plain version; maps, versions, growth, hot keys and odd rows."""

import zlib
from collections import Counter, defaultdict

from irloom.llm import sharding
from irloom.llm.common import documents

DOCS = "doc_id long, text string, shard int, slot string, size string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash", "clash", 1) for i, t in rows], DOCS)


def plain_edit(slots, size, shards):
    """slots: slot -> shard; the next map by the docstring of edited_map."""
    large = [b for b in size.values() if b > sum(size.values()) / shards]
    share, old = (sum(size.values()) - sum(large)) / (shards - len(large)), max(slots.values()) + 1
    held, pool, out = [0] * shards, [], {}
    for s in range(old):
        upto = 0
        for slot in sorted((k for k, v in slots.items() if v == s), key=lambda k: (-size.get(k, 0), k)):
            upto += size.get(slot, 0)
            if upto <= share:
                out[slot] = s
                held[s] += size.get(slot, 0)
            else:
                pool.append(slot)
    open_shards = range(old, shards) if shards > old else range(shards)
    for slot in sorted(pool, key=lambda k: (-size.get(k, 0), k)):
        to = min(open_shards, key=lambda s: (held[s], s))
        out[slot] = to
        held[to] += size.get(slot, 0)
    return out


def check_result(rows, want):
    """want: Counter of (doc_id, size, crc) that must come out, each once per row."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and set(places) <= set(range(16))
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)
    return {s: sum(r.size for r in rows if r.shard == s) for s in places}


def expected(rows):
    return Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)


def test_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = sharding.op11_sharding(spark, folder).collect()
    docs = [(r.doc_id, r.text) for r in documents(spark, folder).collect()]
    loads = check_result(rows, expected(docs))
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) < 0.02 * max(loads.values()) + 200
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.virtual_slot] += r.size
        slots[r.virtual_slot] = r.shard
    want = plain_edit({s: s % 16 for s in range(sharding.SLOTS)}, sizes, 16)
    assert all(want[k] == v for k, v in slots.items()) and {r.map_version for r in rows} == {2}


def test_odd_rows_and_hot_keys(spark, tmp_path):
    rows = [(7, "same")] * 3000 + [(None, f"t{i}") for i in range(3000)] + [(i, "copy of one text") for i in range(3000)] + [(1, None), (1, ""), (2, "é" * 100_000), (None, None)]
    x = sharding.shard(table(spark, rows), str(tmp_path / "map"))
    out = [r for r in x.collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == expected(rows)
    loads = Counter()
    for r in out:
        loads[r.shard] += r.size
    big = next(r.shard for r in out if r.size == 200_001)
    rest = [v for s, v in loads.items() if s != big]
    assert loads[big] == 200_001 and max(rest) - min(rest) < 60  # the long text alone is larger than a share
    assert sharding.shard(table(spark, []), str(tmp_path / "none")).count() == 0


def test_versions_and_growth(spark, tmp_path):
    docs, path = documents(spark, "/root/testdata/sf0.001"), str(tmp_path / "map")
    rows = sharding.records(docs, 256)
    loads = sharding.slot_loads(rows)
    sharding.store_map(sharding.first_map(spark, 256, 4), path)
    sharding.store_map(sharding.edited_map(sharding.load_map(spark, path), loads, 4), path)
    grown = sharding.edited_map(sharding.load_map(spark, path), loads, 6)
    sharding.store_map(grown, path)
    maps = [{r.virtual_slot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2, 3)]
    assert all(len(m) == 256 for m in maps) and {r.version for r in sharding.load_map(spark, path).collect()} == {3}
    size = {r.virtual_slot: r.bytes for r in loads.collect()}
    assert maps[1] == plain_edit(maps[0], size, 4) and maps[2] == plain_edit(maps[1], size, 6)
    assert all(maps[2][s] == maps[1][s] or maps[2][s] >= 4 for s in maps[1])  # the new ones take slots only into themselves
    held = Counter()
    for s, b in size.items():
        held[maps[2][s]] += b
    assert set(held) == set(range(6))
