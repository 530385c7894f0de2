"""Operators on documents against brute force, with the odd rows of the corpus in conftest."""

import binascii
import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlens.llm import minhash, mixing, mpegts, packing, pii, quality, sharding, suffix
from strandlens.llm.queries import tokenizer_path


def raw(text):
    return (text or "").encode()


# --- near-duplicates --------------------------------------------------------------------------


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw(text).lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return collections.Counter((r[0], len(sets[i]), least.get(root(i)), least.get(root(i)) == r[0]) for i, r in enumerate(rows))


def test_near_duplicates(docs, rows):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == brute_components(rows)
    assert minhash.near_duplicates(docs, tile=2).count() == len(rows)


def test_small_tiles_give_the_same(docs, monkeypatch):
    want = sorted(map(tuple, minhash.near_duplicates(docs).select("component_id", "n_shingles").collect()), key=str)
    monkeypatch.setattr(minhash, "AGREE", 40)
    assert sorted(map(tuple, minhash.near_duplicates(docs, tile=1).select("component_id", "n_shingles").collect()), key=str) == want


def test_near_duplicates_odd_tables(empty, clashing, rows):
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.near_duplicates(clashing).count() == len(rows)
    kept = minhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    texts = [r.text for r in kept.select("text").collect() if r.text and r.text.strip()]
    assert len(texts) == len(set(texts))


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    for n, m in ((4, 3), (400, 300), (3000, 2250)):
        agree = []
        for _ in range(60):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            agree.append((minhash.fast_sketch(a) == minhash.fast_sketch(a[:m])).mean())
        assert abs(np.mean(agree) - m / n) < 0.04
    assert (minhash.fast_sketch(np.array([5], np.uint64)) != 0).all()


def test_sketch_does_not_depend_on_batches_of_rounds():
    rng = np.random.default_rng(5)
    # sizes on both sides of every change of the number of rounds at once, similarities from 0.75 on
    for n in (64, 100, 127, 128, 170, 171, 255, 256):
        for m in (n + 1, n + n // 8, n + n // 3):
            agree = []
            for _ in range(100):
                a = rng.integers(0, 2**63, m).astype(np.uint64)
                agree.append((minhash.fast_sketch(a) == minhash.fast_sketch(a[:n])).mean())
            error = np.sqrt(n / m * (1 - n / m) / (100 * minhash.COORDINATES))
            assert abs(np.mean(agree) - n / m) < 4 * error
    for n in (1, 7, 100, 300, 600):
        items = rng.integers(0, 2**63, n).astype(np.uint64)
        want = {}
        for i in range(2 * minhash.COORDINATES):
            hashes = minhash.mix(items ^ minhash._ROUND[i]).tolist()
            for h in hashes:
                b = h >> 57 if i < minhash.COORDINATES else i - minhash.COORDINATES
                value = b << 57 | i << 48 | h & (1 << 48) - 1
                want[b] = min(want.get(b, value), value)
        assert minhash.fast_sketch(items).tolist() == [want[b] for b in range(minhash.COORDINATES)]


def test_long_text_is_hashed_in_blocks(monkeypatch):
    text = b" ".join(b"w%d" % (i % 977) for i in range(5000))
    want = minhash.shingle_sets([text])[0]
    monkeypatch.setattr(minhash, "BLOCK", 1000)
    assert (minhash.shingle_sets([text, b"", b"a b"])[0] == want).all()


# --- repeated passages ------------------------------------------------------------------------


def brute_repeats(rows, length=200):
    seen = collections.Counter(raw(t)[i : i + length] for _, t, *_ in rows for i in range(len(raw(t)) - length + 1))
    out = collections.Counter()
    for doc_id, t, *_ in rows:
        data = raw(t)
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out[doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("hot", "keys"), [(10_000, 200_000), (1, 200_000), (10_000, 0)])
def test_repeats(docs, rows, monkeypatch, hot, keys):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "KEYS", keys)
    got = collections.Counter(tuple(r) for r in suffix.remove_repeats(docs).collect())
    assert got == brute_repeats(rows)


def test_repeats_divide_large_buckets(spark, docs, rows, monkeypatch):
    # one line in many documents, whose surroundings differ: all its anchors' pieces do too
    rng = np.random.default_rng(9)
    line = "".join(rng.choice(list("abcdefgh "), 260))
    more = [(1000 + i, "".join(rng.choice(list("abcdefgh "), 150)) + line + "".join(rng.choice(list("abcdefgh "), 150))) for i in range(60)]
    monkeypatch.setattr(suffix, "HOT", 20)
    monkeypatch.setattr(suffix, "INDEX", 2000)
    asked = []
    whole = suffix._divided

    def divided(*args):
        pieces, tables = whole(*args)
        asked.append(pieces.where("piece is not null").groupBy("bucket").agg(F.sum(F.octet_length("piece") + 1).alias("bytes"), F.countDistinct("piece").alias("n")).where("n > 1").agg(F.max("bytes")).first()[0])
        return pieces, tables

    monkeypatch.setattr(suffix, "_divided", divided)
    table = [(i, t) for i, t, *_ in rows] + more
    got = collections.Counter(tuple(r) for r in suffix.remove_repeats(spark.createDataFrame(table, "doc_id bigint, text string")).collect())
    assert got == brute_repeats(table)
    assert asked[0] <= 2000


def test_repeats_odd_tables(empty, clashing, rows):
    assert suffix.remove_repeats(empty).count() == 0
    out = suffix.remove_repeats(clashing, texts=True)
    assert out.count() == len(rows)
    assert {len(r.kept_text.encode()) == r.n_bytes - r.n_removed for r in out.where("n_removed = 0").collect()} == {True}


@pytest.mark.parametrize("letters", [1, 2, 4, 256])
def test_index(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 30, 400):
        x = rng.integers(0, letters, n).astype(np.uint8)
        data = x.tobytes()
        order = sorted(range(n), key=lambda i: data[i:])
        assert suffix.suffix_array(x).tolist() == order
        best = [0] * n
        for a, b in zip(order, order[1:], strict=False):
            k = next((k for k in range(n) if max(a, b) + k >= n or data[a + k] != data[b + k]), 0)
            best[a], best[b] = max(best[a], k), max(best[b], k)
        index = suffix.RunIndex(x)
        assert index.matching_statistics().tolist() == best
        assert int(index.lengths.sum()) == n


# --- shards -----------------------------------------------------------------------------------


def test_shards(docs, rows):
    out = sharding.shard_rows(docs, shards=5, seed=3, tasks=4).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter((r[0], len(raw(r[1])) + 1, binascii.crc32(raw(r[1]))) for r in rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    again = sharding.shard_rows(docs.repartition(7), shards=5, seed=3, tasks=1).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(map(tuple, again))
    other = sharding.shard_rows(docs, shards=5, seed=4).collect()
    assert {(r.row_number, r.shard) for r in other} != {(r.row_number, r.shard) for r in out}


def test_many_copies_and_null_ids_are_divided(spark, monkeypatch):
    """A third of the rows is one row, another third has no id: both leave in several tasks."""
    monkeypatch.setattr(sharding, "RUN", 50)
    table = [(3, "same")] * 400 + [(None, f"text {i}") for i in range(400)] + [(i, "t") for i in range(10, 410)]
    out = sharding.shard_rows(spark.createDataFrame(table, "doc_id long, text string"), shards=4, tasks=6).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.shard, r.slot) for r in out) == sorted((s, i) for s in range(4) for i in range(300))
    assert len({r.task for r in out if r.doc_id == 3}) > 2 and len({r.task for r in out if r.doc_id is None}) > 2


def test_shards_can_be_computed(spark, docs, rows):
    out = sharding.shard_rows(docs, shards=5, seed=3)
    there = sharding.place(F.col("row_number"), len(rows), 5, 3)
    assert out.where((there["shard"] != F.col("shard")) | (there["slot"] != F.col("slot"))).count() == 0


def test_shards_odd_tables(empty, clashing, rows):
    assert sharding.shard_rows(empty).count() == 0
    assert sharding.shard_rows(clashing).count() == len(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1024, 5000])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 9)
    assert sorted(p.tolist()) == list(range(n))
    assert n < 90 or abs(np.corrcoef(np.arange(n), p.astype(float))[0, 1]) < 0.3


# --- mixing -----------------------------------------------------------------------------------


def test_mixing_draws_poisson_counts(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 5000, "big").otherwise("small").alias("source"))
    out = mixing.poisson_mix(many, {"big": 0.5, "small": 0.5}, epochs=1.0)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 3000) < 200 and abs(n["small"] - 3000) < 200
    copies = collections.Counter(r["count"] for r in out.where("source = 'small'").groupBy("doc_id").count().collect())
    for k in (1, 2, 3, 4):
        assert abs(copies[k] - 1000 * math.exp(-3) * 3**k / math.factorial(k)) < 60
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_poisson_table(spark):
    for rate in (0.1, 3.0, 900.0, 20_000.0):
        cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first()["c"]
        assert abs(cdf[-1] - 1) < 1e-12 * max(1000, rate) and abs(sum(1 - c for c in cdf) - rate) < 1e-6 * max(1, rate)


def test_mixing_without_texts(docs):
    out = mixing.poisson_mix(docs.drop("text"), epochs=2.0, text_col=None)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "copy", "rate", "shuffle_key"] and out.count() > 0


def test_mixing_odd_tables(docs, empty, clashing, rows, monkeypatch):
    assert mixing.poisson_mix(empty).count() == 0
    assert mixing.poisson_mix(docs, {}).count() == 0
    out = mixing.poisson_mix(clashing, epochs=2.0)
    assert set(out.columns) == set(clashing.columns)
    want = collections.Counter(map(tuple, mixing.poisson_mix(docs, epochs=2.0).select("doc_id", "source", "copy", "shuffle_key").collect()))
    assert want == collections.Counter(map(tuple, out.select("doc_id", "source", "copy", "shuffle_key").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert want == collections.Counter(map(tuple, mixing.poisson_mix(docs, epochs=2.0).select("doc_id", "source", "copy", "shuffle_key").collect()))


# --- packing ----------------------------------------------------------------------------------


def least_bins(lengths, size):
    """A lower bound: pieces over half a bin need one each, and shorter ones the room that is left."""
    best = 0
    for k in range(1, size // 2 + 1):
        large = [x for x in lengths if x > size - k]
        middle = [x for x in lengths if size // 2 < x <= size - k]
        small = [x for x in lengths if k <= x <= size // 2]
        best = max(best, len(large) + len(middle) + max(0, -(-(sum(small) - (len(middle) * size - sum(middle))) // size)))
    return best


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 2]
        for k, (start, n) in enumerate(packing.cut(len(ids), 64)):
            want[doc_id, k, start, n, binascii.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    out = packing.pack_documents(docs, tokenizer_path(), size=64).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert all(a + n == c for (a, n), (c, _) in zip(b, b[1:], strict=False)) and b[0][0] == 0 and sum(n for _, n in b) <= 64
    assert len(bins) <= least_bins([r.length for r in out], 64) + 1


def test_packing_odd_tables(empty, clashing, docs):
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0
    assert packing.pack_documents(clashing, tokenizer_path()).count() == packing.pack_documents(docs, tokenizer_path()).count()


def test_local_search_and_cuts():
    assert packing.cut(0, 4) == [] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    rng, emptied = np.random.default_rng(2), 0
    for _ in range(30):
        counts = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 60), 12, replace=False), rng.integers(1, 40, 12), strict=True)}
        bins = packing.pack(counts, 60)
        used = collections.Counter()
        for pattern, copies in bins.items():
            assert 0 < sum(pattern) <= 60
            for x in pattern:
                used[x] += copies
        assert used == counts
        start = packing.best_fit(counts, 60)
        fill = lambda x: sum(sum(p) ** 2 * n for p, n in x.items())
        assert sum(bins.values()) <= sum(start.values()) and fill(bins) >= fill(start)
        # from a start that leaves much to do, first fit in no order, moves and swaps empty bins
        open_bins: list[list[int]] = []
        for x in rng.permutation([k for k, n in counts.items() for _ in range(n)]).tolist():
            home = next((b for b in open_bins if sum(b) + x <= 60), None)
            if home is None:
                open_bins.append(home := [])
            home.append(x)
        loose = collections.Counter(tuple(sorted(b, reverse=True)) for b in open_bins)
        tight = packing.local_search(loose, 60)
        assert sum((collections.Counter({x: n * p.count(x) for x in set(p)}) for p, n in tight.items()), collections.Counter()) == counts and fill(tight) >= fill(loose)
        emptied += sum(loose.values()) - sum(tight.values())
    assert emptied >= 20
    assert packing.pack({}, 60) == {}
    better = packing.local_search(collections.Counter({(6, 3): 1, (5, 5): 1, (1,): 1}), 10)
    assert sum(better.values()) == 2


@pytest.mark.parametrize("times", [600, 600_000])
def test_local_search_takes_all_underfull_bins(times):
    # best fit pairs 513 with 258 and leaves room in all those bins
    counts = {513: times, 258: times, 257: times, 254: 2 * times}
    bins = packing.pack(counts, 1024)
    assert 1.2 * sum(bins.values()) < sum(packing.best_fit(counts, 1024).values())
    assert sum(bins.values()) == -(-sum(k * n for k, n in counts.items()) // 1024)


def test_special_strings_follow_the_tokenizer():
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(tokenizer_path()), packing.ByteBpe(tokenizer_path())
    for text in ("<|endoftext|> a", "naïve Überfluß", "日本語 text", "a\x85b c", "  lead\n\n\ntail  ", "don't 123 ...!!", "​zero", ""):
        assert fast(text) == exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "!" * 2_000_000, "a b" + " \t" * 700_000 + "end", "x " * 20_000])
def test_long_runs_of_one_character(text):
    from tokenizers import Tokenizer

    assert packing.ByteBpe(tokenizer_path())(text) == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_packing_of_lanes(docs, rows, monkeypatch):
    """Copies of one row in many lanes: all pieces are placed, and no two in one place."""
    monkeypatch.setattr(packing, "RANKED", (3, 5))
    many = docs.unionByName(docs.where("doc_id = 4")).unionByName(docs.where("doc_id = 4"))
    out = packing.pack_documents(many, tokenizer_path(), size=64).collect()
    plain = packing.pack_documents(docs, tokenizer_path(), size=64).collect()
    cells = [(r.sequence_id, r.offset + i) for r in out for i in range(r.length)]
    assert len(cells) == len(set(cells)) and len(out) > len(plain)


# --- media ------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 162, 176, 184, 185, 4000, 32_768, 32_769, 140_001])
def test_stream_round_trip(n):
    payload = bytes(i * 7 % 251 for i in range(n))
    media = mpegts.mux(payload)
    assert len(media) % 188 == 0
    (stream,) = mpegts.demux(media)
    assert (stream.payload, stream.continuity_errors, stream.pid) == (payload, 0, mpegts.DATA_PID)
    assert stream.pts == [90_000 + 3_600 * i for i in range(len(stream.pts))] and stream.random_access == stream.pts[::4]


def test_stream_faults():
    media = mpegts.mux(bytes(range(256)) * 8)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert mpegts.demux(b"".join([*packets[:5], packets[4], *packets[5:]]))[0].continuity_errors == 0
    assert mpegts.demux(b"".join([*packets[:5], *packets[6:]]))[0].continuity_errors == 1
    assert mpegts.demux(media)[0].damaged == [] and mpegts.demux(b"".join([*packets[:5], *packets[6:]]))[0].damaged == [0]
    two = mpegts.mux(bytes(range(256)) * 200)
    parts = [two[i : i + 188] for i in range(0, len(two), 188)]
    heads = [i for i, p in enumerate(parts) if p[1] & 0x40 and (p[1] & 31) << 8 | p[2] == mpegts.DATA_PID]
    assert len(heads) == 2
    assert mpegts.demux(b"".join([*parts[: heads[1] - 1], *parts[heads[1] :]]))[0].damaged == [0]
    assert mpegts.demux(b"".join(parts[:-1]))[0].damaged == [1]
    assert mpegts.demux(b"junk" + media + b"G12")[0].payload == bytes(range(256)) * 8
    assert mpegts.demux(b"") == [] and mpegts.demux(b"no stream here" * 30) == [] and mpegts.demux(b"".join(packets[2:])) == []


def test_media_digest(docs, rows, empty, clashing):
    out = mpegts.media_digest(docs).collect()
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        p = mpegts.padded(raw(text))
        want[doc_id, len(raw(text)), len(p), hashlib.sha256(p).hexdigest(), binascii.crc32(p[-64:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    assert mpegts.media_digest(empty).count() == 0 and mpegts.media_digest(clashing).count() == len(rows)
    assert all(len(r.pts) == max(1, -(-r.payload_bytes // mpegts.UNIT)) and r.pts[::4] == r.random_access and r.continuity_errors == r.damaged_units == 0 for r in out)
    stored = mpegts.read_media(mpegts.to_media(docs.select("doc_id", "text"))).collect()
    assert all(bytes(r.streams[0].payload) == mpegts.padded(raw(r.text)) for r in stored)


# --- personal data ----------------------------------------------------------------------------

ENTITIES = ["anna.34@mail7.example.com", "bo.1@m.org", "97.51.17.173", "4845168114407329", "4111 1111 1111 1111", "+1 (017) 555-7713", "123-45-6789", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "DE89 3704 0044 0532 0130 00"]


def test_surrogates(spark):
    texts = [f"before {e} after" for e in ENTITIES] + [f"again {e.upper()}." for e in ENTITIES] + ["x a.1@m.org b.2@m.org c.3@m.org", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "plain 12, 9807915762804490 and 2024-01-02", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.surrogates(df, "k").collect()}
    for i, e in enumerate(ENTITIES):
        if "04db" in e:
            continue
        new, up = out[i].text.removeprefix("before ").removesuffix(" after"), out[i + len(ENTITIES)].text
        assert new != e and out[i].n_entities == 1 and new.upper() in up
        assert re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "0", new)) == re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "0", e)) or "." in e
    token = out[len(texts) - 4].text
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', token) and "04dbeb" not in token
    assert [out[len(texts) - k].text for k in (3, 2, 1)] == ["plain 12, 9807915762804490 and 2024-01-02", None, ""]
    assert {r.doc_id: r.text for r in pii.surrogates(df, "k").collect()} == {k: r.text for k, r in out.items()}
    assert pii.surrogates(df, "other").where("doc_id = 0").first().text != out[0].text


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_card_numbers_keep_their_check_sum(spark):
    good = [f"{n:015d}" for n in range(400000000000000, 400000000000300)]
    cards = [g + next(str(d) for d in range(10) if luhn(g + str(d))) for g in good]
    out = [r.text for r in pii.surrogates(spark.createDataFrame([(i, c) for i, c in enumerate(cards)], "doc_id long, text string"), "k").collect()]
    assert all(luhn(c) for c in out) and len(set(out)) == len(cards) and not set(out) & set(cards)


def test_collisions_are_repaired(spark):
    """Addresses of one or two signs can't all get different surrogates of their own length."""
    mails = [f"{a}{b}@x.org" for a in "abcdefghij" for b in "klmnopqrst"] + [f"{a}@x.org" for a in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame([(i, f"m {m} n") for i, m in enumerate(mails)], "doc_id long, text string")
    out = [r.text for r in pii.surrogates(df, "k").collect()]
    assert len(set(out)) == len(mails) and not {o[2:-2] for o in out} & set(mails)


def test_names_match_gender_and_script(spark):
    text = "Mr. John Smith, Mrs. Mary Smith, Herr Smith, Г-жа Анна Петрова, Dr. Maria Lopez and Smithy"
    df = spark.createDataFrame([(1, text), (2, "Mr. John Smith again")], "doc_id long, text string")
    one, two = (r.text for r in pii.surrogates(df, "k").orderBy("doc_id").collect())
    family = one.split(",")[0].split()[-1]
    assert re.match(r"Mr\. [A-Z]\w+ [A-Z]\w+, Mrs\. [A-Z]\w+a [A-Z]\w+, Herr", one) and one.count(family) == 3
    assert re.search(r"Г-жа [А-Я][а-я]+ [А-Я][а-я]+,", one) and "Анна" not in one and one.endswith(" and Smithy")
    assert two.startswith(one.split(",")[0])


def test_known_names_without_titles(spark):
    texts = ["Mrs. Mary Smith came. Mary Smith left; Smith's car, Smithson and mary stay.", "Mary Smith is nobody here.", "Herr Dr. Karl Braun und Karl Braun."]
    out = [r.text for r in pii.surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    given, family = re.match(r"Mrs\. (\w+) (\w+) came", out[0]).groups()
    assert out[0] == f"Mrs. {given} {family} came. {given} {family} left; {family}'s car, Smithson and mary stay." and "Mary" not in out[0]
    assert out[1] == texts[1]
    given, family = re.match(r"Herr Dr\. (\w+) (\w+) und", out[2]).groups()
    assert out[2] == f"Herr Dr. {given} {family} und {given} {family}." and family not in ("Braun", "Karl")


def iban_ok(e):
    e = e.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in e[4:] + e[:4])) % 97 == 1


def test_check_digits(spark):
    """Valid account numbers get valid ones; what fails its check digits is no account or card."""
    good = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "NL91ABNA0417164300"]
    bad = ["DE88 3704 0044 0532 0130 00", "1234567890123456", "4111 1111 1111 1112", "9000000000000001", "0000000000000000"]
    assert luhn("9000000000000001") and luhn("0" * 16)
    assert all(map(iban_ok, good))
    out = [r for r in pii.surrogates(spark.createDataFrame([(i, f"x {e} y") for i, e in enumerate(good + bad)], "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    for e, r in zip(good, out, strict=False):
        new = r.text[2:-2]
        assert iban_ok(new) and new != e and new[:2] == e[:2] and [c == " " for c in new] == [c == " " for c in e] and r.n_entities == 1
    assert [(r.text[2:-2], r.n_entities) for r in out[len(good) :]] == [(e, 0) for e in bad]


def test_long_entities_are_replaced_whole(spark):
    local, labels = "a" * 600, ".".join(f"l{i}" for i in range(3000))
    texts = [f"x {local}@m.org y", f"x {local}b@m.org y", f"x Q{local}@m.org y", f"x a@{labels} y", f"x token={'k' * 5000} y", "m a@b.c. d"]
    out = [r.text for r in pii.surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert [len(o) for o in out] == [len(t) for t in texts] and len(set(out)) == len(out)
    assert "l2998" not in out[3] and out[3].endswith(".l2999 y") and re.fullmatch(r"m \w@\w\.c\. d", out[5]) and "kkk" not in out[4]


#: A second, simpler detection, for the forms that the tables hold.
SIMPLE = re.compile(r"(?P<email>[\w.%+\-]+@\w+(?:\.\w+)+)|(?P<secret>(?<=token = \")[0-9a-f]{40}(?=\"))|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]))|(?P<phone>\+1 \(\d{3}\) \d{3}-\d{4})|(?P<card>(?<!\d)\d{16}(?!\d))")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_surrogates_against_a_second_implementation(spark, sf):
    """op1 over whole tables: text outside entities stays, every entity is replaced by one of its form,
    equal ones by equal ones, different ones by different ones, and none by another's value."""
    import os

    from strandlens.llm.queries import op1_surrogates

    data = f"/root/testdata/{sf}"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    shape = lambda e: re.sub(r"[a-zà-ÿ]", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"\d", "0", e)))
    given, total = collections.defaultdict(set), 0
    for r in op1_surrogates(spark, data).collect():
        old, at, now = before[r.doc_id], 0, 0
        if old is None:
            assert r.text is None and r.n_entities == 0
            continue
        hits = [m for m in SIMPLE.finditer(old) if m.lastgroup != "card" or (luhn(m.group()) and m.group()[0] in "23456")]
        for m in hits:
            assert r.text[now : now + m.start() - at] == old[at : m.start()]
            now += m.start() - at
            new = SIMPLE.match(r.text, now).group()
            now, at = now + len(new), m.end()
            given[m.lastgroup, m.group()].add(new)
            assert new != m.group() and (m.lastgroup == "secret" and re.fullmatch("[0-9a-f]{40}", new) or m.lastgroup == "ip" or shape(new) == shape(m.group()))
            assert m.lastgroup != "card" or luhn(new)
        assert r.text[now:] == old[at:] and r.n_entities == len(hits)
        total += len(hits)
    assert total > 0 and all(len(x) == 1 for x in given.values())
    new = [(kind, next(iter(x))) for (kind, _), x in given.items()]
    assert len(new) == len(set(new)) and not set(new) & set(given)


def test_surrogates_odd_tables(docs, empty, clashing, rows):
    assert pii.surrogates(empty, "k").count() == 0
    out = pii.surrogates(clashing, "k")
    assert set(out.columns) == set(clashing.columns)
    assert collections.Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()) == collections.Counter((r[0], r[1]) for r in rows)


def test_surrogates_use_no_python(docs):
    plan = pii.surrogates(docs, "k")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- quality ----------------------------------------------------------------------------------


def test_labellers_are_weighed_by_agreement():
    """Two good labellers and one that votes at random, without true labels."""
    rng = np.random.default_rng(1)
    m = len(quality.LABELLERS)
    counts = collections.Counter()
    for _ in range(20_000):
        high = rng.random() < 0.8
        votes = [quality.ABSTAIN] * m
        for j, accuracy in enumerate((0.97, 0.95, 0.9, 0.5)):
            votes[j] = quality.HIGH if (rng.random() < accuracy) == high else quality.LOW
        counts[sum(v * 3 ** (m - 1 - j) for j, v in enumerate(votes))] += 1
    prior, table = quality.fit_labellers(dict(counts))
    assert abs(prior - 0.8) < 0.02
    assert abs(table[0, 1, quality.HIGH] - 0.97) < 0.02 and abs(table[3, 1, quality.HIGH] - 0.5) < 0.03 and abs(table[2, 0, quality.LOW] - 0.9) < 0.03


def plain_describe(text):
    """Statistics and units by plain counting: a second way to what the labellers see."""
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", text.lower()), [x for x in text.split(b"\n") if x.strip()]
    symbols = set(b"#$%&*\\^`{|}~[]!")
    full = sum(c not in b" \t\n\x0b\x0c\r" for c in text)
    upper, lower = sum(65 <= c <= 90 for c in text), sum(97 <= c <= 122 for c in text)
    share = lambda xs: len(set(xs)) / len(xs) if xs else 1.0
    n = len(words)
    parts = [words] if n < 400 else [words[i : i + 200] for i in range(0, n - 199, 200)] + ([words[n - 200 :]] if n % 200 else [])
    stats = [
        sum(c in symbols for c in text) / max(1, full), upper / max(1, upper + lower), sum(w[-1] in symbols for w in words) / max(1, n), 1 - share([tuple(words[i : i + 3]) for i in range(n - 2)]),
        sum(map(share, parts)) / len(parts), sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n - 1) if n > 1 else 0.0, full / max(1, n), 1 - share(lines) if lines else 0.0,
    ]
    return stats, {"words": n, "letters": upper + lower, "lines": len(lines)}, words


def word_hash(word):
    total, power = 0, 1
    for c in word:
        total, power = (total + int(minhash._BYTE[c]) * power) % 2**64, power * minhash._BASE % 2**64
    return int(minhash.mix(np.array([total], np.uint64))[0])


def plain_quality(texts, sample):
    """(votes, posterior, score) of each text, with everything done document by document in double
    precision: votes by plain counting, EM over documents, a scorer over dictionaries."""
    seen = [plain_describe(raw(t)) for t in texts]
    ballots = [[0 if units[lab.unit] < lab.least else 2 if lab.fair[0] <= x <= lab.fair[1] else 0 if lab.poor[0] <= x <= lab.poor[1] else 1 for lab, x in zip(quality.LABELLERS, stats, strict=True)] for stats, units, _ in seen]
    high, before = [0.1 if 1 in b else 0.9 for b in ballots], None
    for _ in range(200):
        prior = (sum(high) + 1) / (len(high) + 2)
        table = [[[0.1 + sum((h if c else 1 - h) for h, b in zip(high, ballots, strict=True) if b[j] == v) for v in range(3)] for c in (0, 1)] for j in range(len(quality.LABELLERS))]
        table = [[[x / sum(row) for x in row] for row in pair] for pair in table]
        odds = [math.log(prior / (1 - prior)) + sum(math.log(table[j][1][v] / sum(table[j][1][1:])) - math.log(table[j][0][v] / sum(table[j][0][1:])) for j, v in enumerate(b) if v) for b in ballots]
        high = [1 / (1 + math.exp(-min(500, max(-500, o)))) for o in odds]
        if before and max(abs(x - y) for p, q in zip(table, before, strict=True) for r, s in zip(p, q, strict=True) for x, y in zip(r, s, strict=True)) < 1e-9:
            break
        before = table

    def features(stats, units, words):
        found = collections.Counter()
        ends = collections.Counter()
        for w in words:
            found["word", (word_hash(w) >> 20) % quality.WORD_BUCKETS] += 1 / max(1, len(words))
            ends["end", w[-1]] += 1 / max(1, len(words))
        for j, (lab, x) in enumerate(zip(quality.LABELLERS, stats, strict=True)):
            width = lab.poor[1] - lab.poor[0]
            place = (x - (lab.poor[0] - width / 2)) / (2 * width) * (quality.BINS - 1)
            found["bin", j, quality.BINS - 1 if units[lab.unit] < lab.least else min(quality.BINS - 2, max(0, int(place)))] = 1.0
        return found + ends | {"one": 1.0}

    described = [features(*x) for x in seen]
    assert len(set(texts)) <= sample
    w, old = collections.Counter(), collections.Counter()
    for k in range(300):
        ahead = {f: w[f] + (w[f] - old[f]) * k / (k + 3) for f in set(w) | set(old)}
        grad = collections.Counter({f: 1e-4 * v for f, v in ahead.items()})
        for x, y in zip(described, high, strict=True):
            p = 1 / (1 + math.exp(-sum(ahead.get(f, 0) * v for f, v in x.items())))
            for f, v in x.items():
                grad[f] += (p - y) * v / len(texts)
        old, w = w, collections.Counter({f: ahead.get(f, 0) - 4 / (len(quality.LABELLERS) + 3) * grad[f] for f in set(ahead) | set(grad)})
    scores = [1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items()))) if words else 0.0 for x, (_, _, words) in zip(described, seen, strict=True)]
    return [(int("".join(map(str, b)), 3), h, s) for b, h, s in zip(ballots, high, scores, strict=True)]


def test_quality_equals_a_second_implementation(docs, rows):
    """op7 against plain_quality: equal votes, and posteriors and scores but for rounding."""
    texts = [r[1] for r in rows if len(r[1] or "") < 5000]
    table = docs.where("text is null or length(text) < 5000")
    want = {t: x for t, x in zip(texts, plain_quality([t or "" for t in texts], 4096), strict=True)}
    model = quality.fit(table)
    for t, (votes, high, score) in want.items():
        words = next(minhash.hashed_words([raw(t)]))
        stats, units, last = quality._describe(raw(t), words)
        assert quality.votes(stats, units) == votes
        assert model.posterior[votes] == pytest.approx(high, abs=1e-6)
        assert model.score(stats, units, words, last) == pytest.approx(score, abs=2e-3)
    out = quality.quality_scores(table, model).collect()
    by_id = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in out:
        if r.doc_id in by_id and [x[0] for x in rows].count(r.doc_id) == 1:
            votes, high, score = want[by_id[r.doc_id]]
            assert (r.votes, r.kept) == (votes, r.score >= 0.5) and r.posterior == pytest.approx(high, abs=1e-6) and r.score == pytest.approx(score, abs=2e-3)


def test_distinct_words_see_the_end_of_a_text():
    def distinct(words):
        text = " ".join(words).encode()
        return quality._describe(text, next(minhash.hashed_words([text])))[0][4]

    fresh = [f"w{i}" for i in range(400)]
    assert distinct(fresh) == 1
    assert distinct(fresh + ["same"] * 199) == pytest.approx((1 + 1 + 2 / 200) / 3)
    assert distinct(fresh + ["same"] * 200) == pytest.approx((1 + 1 + 1 / 200) / 3)


def test_sample_of_copies_has_all_texts(spark, monkeypatch):
    texts = [f"{word} " * 30 + "a line of other words that stands at the end" for word in "abcdefghij"]
    docs = spark.createDataFrame([(i, texts[i % 10]) for i in range(400)], "doc_id bigint, text string")
    seen = []
    monkeypatch.setattr(quality, "fit_scorer", lambda rows, **more: seen.append((len(rows), sorted(more["copies"]))) or np.zeros(quality.FEATURES, np.float32))
    quality.fit(docs, sample=8)
    quality.fit(docs, sample=50)
    assert seen == [(8, [40] * 8), (10, [40] * 10)]


def test_quality_held_out(spark):
    import os

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    found = quality.quality_scores(spark.read.parquet(f"{data}/documents.parquet"), sample=500)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    both = found.join(labels, "doc_id").collect()
    good, bad = [r for r in both if r.quality == 1], [r for r in both if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)


def test_quality_odd_tables(docs, empty, clashing, rows):
    assert quality.quality_scores(empty).count() == 0
    out = quality.quality_scores(docs, sample=20).collect()
    assert len(out) == len(rows)
    blank = {r[0] for r in rows if not (r[1] or "").strip()}
    assert all(r.score == 0.0 and not r.kept for r in out if r.doc_id in blank)
    model = quality.fit(docs, 20)
    again = collections.Counter(map(tuple, quality.quality_scores(docs.repartition(5), model).collect()))
    assert again == collections.Counter(map(tuple, quality.quality_scores(docs, model).collect()))
    assert quality.keep_good(clashing).columns == clashing.columns
    assert quality.keep_good(docs).count() == quality.quality_scores(docs).where("kept").count()
    one = docs.where("doc_id = 8")
    assert quality.quality_scores(one).count() == 1
