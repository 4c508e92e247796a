import random
import zlib
from collections import Counter, defaultdict

import pytest

from codecorpus.llm import mixing, packing, sharding
from llm_fixtures import edge_docs, no_docs  # noqa: F401

SF = "/root/testdata/sf0.001"


def targets_by_rounds(sizes):
    """The rule itself: share by weight, stop at three times the size,
    reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: 3 * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, "d": 1, "e": 700, None: 40}, {"a": 7}, {"a": 1, "b": 10 ** 6},
                                   {f"s{i}": (i * 37) % 11 * 100 + 1 for i in range(12)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = targets_by_rounds(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_flight_keeps_totals():
    rng = random.Random(4)
    z = [float(rng.randrange(1, 900)) for _ in range(500)]
    p = [0.37] * 500
    mixing.flight(p, z, rng)
    assert sum(1e-9 < x < 1 - 1e-9 for x in p) <= 2
    assert abs(sum(p) - 185) < 1e-6 and abs(sum(a * b for a, b in zip(p, z)) - 0.37 * sum(z)) < 1e-4


def test_giants_do_not_stay_open():
    """One text of a twelfth of its source: the words promised are taken."""
    rng = random.Random(3)
    for seed in range(20):
        z = sorted([20_000.0, *(float(rng.randrange(1, 900)) for _ in range(500))], reverse=True)
        p = [0.6176] * len(z)
        want = sum(a * b for a, b in zip(p, z))
        mixing.settle_giants(p, z, 1900.0, random.Random(seed))
        assert p[0] in (0.0, 1.0) and all(0 <= x <= 1 for x in p)
        assert abs(sum(a * b for a, b in zip(p, z)) - want) < 1
    p, z = [0.5, 0.5], [50.0, 60.0]  # nothing can make up for them
    mixing.settle_giants(p, z, 10.0, random.Random(1))
    assert sorted(p) == [0.0, 1.0]


def test_mix_lands_within_a_thousandth(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for r in mixing.mix(df).groupBy("source").agg({"target": "max", "taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.001 * r["max(target)"]


def test_mix_reaches_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["copies"], r["taken"])
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == docs.count()
    taken, target = Counter(), {}
    for r in first:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    biggest = max(r["size"] for r in first)
    assert all(abs(taken[s] - target[s]) <= biggest / 2 for s in target)


def test_mix_edges(edge_docs, no_docs):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == 13 and mixing.mix(no_docs).collect() == []
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3, 11))
    assert len({r["copies"] for r in rows if r["doc_id"] == 6}) == 1


def best_fit(lengths, cap):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= x]
        if fit:
            i = min(fit, key=lambda j: bins[j])
            bins[i] -= x
        else:
            bins.append(cap - x)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 101), rng.randrange(1, 12), 100]) for _ in range(rng.randrange(1, 400))]
    slots = packing.plan(Counter(lengths), 100)
    rest, taken = defaultdict(lambda: 100), Counter()
    for length, lo, hi, seq, per, off in slots:
        for rank in range(lo, hi):
            s = seq + (rank - lo) // per
            assert off + (rank - lo) % per * length == 100 - rest[s]  # gapless
            rest[s] -= length
            taken[length] += 1
    assert taken == Counter(lengths) and sorted(rest.values()) == best_fit(lengths, 100)


def test_cuts():
    assert packing.cuts(1, 4) == [(0, 1)] and packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)]


def test_encoder_equals_the_json_tokenizer():
    encode = packing.Encoder(*packing.default_files())
    rng = random.Random(2)
    alphabet = "ab E'  \n\t1٣é漢🙂  .,!<|endoftext|>ñß\x00‍"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    texts += ["<|endoftext|>", "a" * 5000, " " * 3000, "\n" * 700 + "x"]
    for t in texts:
        assert encode(t) == encode.slow(t) if t else encode(t) == []


def test_pack_round_trip(spark, edge_docs, no_docs):
    assert packing.pack(no_docs).collect() == []
    rows = packing.pack(edge_docs, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == r["length"] and r["ids_crc32"] == zlib.crc32(
            b"".join(i.to_bytes(4, "little") for i in r["ids"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.MAX_LEN
    encode = packing.Encoder(*packing.default_files())
    for d in edge_docs.where("doc_id <> 6 or doc_id is null").collect():
        parts = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [i for r in parts for i in r["ids"]] == encode.slow(d["text"] or "") + [0]
        assert [r["start"] for r in parts] == [sum(q["length"] for q in parts[:i]) for i in range(len(parts))]
    assert len(by_doc[6]) == 2 and len(by_doc[4]) > 50


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.kd_shards(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    size, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes"
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[raw].add(r["shard"])
    assert set(size) == set(range(24)) and len(rows) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    biggest = max(len(t.encode()) for t in texts.values())
    assert max(size.values()) - min(size.values()) <= 2 * biggest


def test_one_text_heavier_than_a_shard(spark):
    docs = spark.createDataFrame([(i, "same text " * 5) for i in range(960)] + [(None, None)], "doc_id long, text string")
    docs = docs.selectExpr("*", "cast(null as string) as source", "cast(null as string) as lang")
    size = Counter()
    for r in sharding.kd_shards(docs).collect():
        size[r["shard"]] += r["size"]
    assert len(size) == 24 and max(size.values()) - min(size.values()) <= 2 * 58


def test_shard_edges(edge_docs, no_docs):
    rows = sharding.kd_shards(edge_docs).collect()
    assert len(rows) == 13 and sharding.kd_shards(no_docs).collect() == []
    assert all(r["text_crc32"] == 0 and r["size"] == 8 for r in rows if r["doc_id"] in (1, 2, 11))


def test_added_tokens_are_one_id():
    from tokenizers import Tokenizer
    ranks, rules = packing.default_files()
    encode, contract = packing.Encoder(ranks, rules), Tokenizer.from_file(rules)
    for t in ("<|endoftext|>", "one<|endoftext|> two", "a <|endoftext|><|endoftext|>\n", "<|endoftext |>", "plain words"):
        assert encode(t) == contract.encode(t, add_special_tokens=False).ids
    assert encode("a<|endoftext|>").count(50256) == 1
