import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from small import ROWS, clashing, documents, got

from tidemark.llm import lmscore, mpegts, pieces, queries, sharding, simhash
from tidemark.llm.common import Stage
from tidemark.llm.components import components

MODEL = queries.tokenizer_path(queries.PIECES_MODEL)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def fingerprint(text):
    w = WORD.findall(lower(text))
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(nodes, distance=3):
    """The smallest fingerprint that links reach, over all pairs."""
    root = {x: x for x in nodes}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= distance:
                x, y = up(a), up(b)
                root[max(x, y)] = min(x, y)
    return {x: up(x) for x in nodes}


def test_simhash_against_all_pairs(spark):
    for df in (documents(spark), clashing(documents(spark))):
        fp = [(r[0], fingerprint(r[1])) for r in ROWS]
        root = smallest({f for _, f in fp})
        first = {k: min((i for i, f in fp if root[f] == k and i is not None), default=None) for k in set(root.values())}
        assert got(simhash.groups(df)) == sorted(((i, f - (f >> 63 << 64), first[root[f]]) for i, f in fp), key=repr)
    kept = simhash.first_of_group(clashing(documents(spark)))
    assert kept.columns == clashing(documents(spark)).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, *sorted(i for i, f in fp if i is not None and i == first[root[f]])]


@pytest.mark.parametrize("most", [8, 4096])
def test_links_connect_what_all_pairs_connect(spark, most):
    rng = np.random.default_rng(5)
    fps = set()
    for base in rng.integers(0, 1 << 63, 25).tolist():
        x = base
        for _ in range(12):
            fps.add(x)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False).tolist():
                x ^= 1 << b
    fps |= {0, 1, 3, (1 << 64) - 1}
    signed = lambda x: x - (x >> 63 << 64)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fingerprint bigint")
    stage = Stage(spark, "test")
    found = {r["node"]: r["root"] for r in components(simhash.links(df, stage, 3, most), stage).collect()}
    want = {}
    for x, r in smallest(fps).items():
        want.setdefault(r, set()).add(signed(x))
    have = {}
    for x in map(signed, fps):
        have.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_loops_and_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(99, 99), (70, 71), (71, 70), (None, 3)], "a bigint, b bigint")
    assert dict(got(components(edges, Stage(spark, "c")))) == {i: 0 for i in range(41)} | {70: 70, 71: 70}
    assert components(edges.limit(0), Stage(spark, "c")).count() == 0


def test_language_model_against_plain_counts(spark, monkeypatch):
    """An automaton of dictionaries over all orders, walked token by token."""
    monkeypatch.setattr(lmscore, "BATCH", 2000)
    monkeypatch.setattr(lmscore, "SHARD_BYTES", 100_000)
    rows = [*ROWS, *((100 + i, f"the quick fox {i % 3} runs the river and the quick fox {i % 7} sleeps", "en", "s") for i in range(60))]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    split = [(i, held(i), [*WORD.findall(lower(t)), "</s>"]) for i, t, *_ in rows]
    c, follows = Counter(), Counter()
    for _, h, tokens in split:
        if not h:
            c.update((w,) for w in tokens)
            line = ["</s>", *tokens]
            follows.update(line[k : k + 2] and tuple(line[k : k + 2]) for k in range(len(tokens)))
            follows.update(tuple(line[k : k + 3]) for k in range(len(tokens) - 1))
    n, v = sum(c.values()), len(c)
    known = lambda h: c[h] if len(h) == 1 else follows[h]

    def p(h, w):
        if not h:
            return (c[w,] + 0.1) / (n + 0.1 * (v + 1))
        return (follows[(*h, w)] + p(h[1:], w)) / (known(h) + 1)

    want = []
    for i, h, tokens in split:
        state, score = ("</s>",) if c["</s>",] else (), 0.0
        for w in tokens:
            while state and not follows[(*state, w)]:  # failure arcs
                score += math.log10(1 / (known(state) + 1))
                state = state[1:]
            score += math.log10(p(state, w))
            state = (*state, w)[-2:]
            while state and not known(state):
                state = state[1:]
        want.append((i, h, len(tokens), sum(c[t,] > 0 for t in tokens), n, sum(math.log10(p((), t)) for t in tokens), score))
    have = got(lmscore.scores(clashing(documents(spark, rows))))
    for x, y in zip(have, sorted(want, key=repr), strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9)
    assert got(lmscore.scores(documents(spark, []))) == []
    named = lmscore.scores(documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string")))
    assert {(r["doc_id"], round(r["score"], 6)) for r in named.collect()} == {(i if i is None else str(i), round(s, 6)) for i, *_, s in want}


def test_numbers_survive_squeezing():
    for x in (np.array([], np.uint64), np.array([5], np.uint32), np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64)):
        assert lmscore.unsqueezed(lmscore.squeezed(x), x.dtype.type).tolist() == x.tolist()


def test_streams_hold_the_payload(spark):
    for r, (i, text, *_) in zip(sorted(mpegts.digests(clashing(documents(spark))).collect(), key=lambda r: (str(r["doc_id"]), r["n_bytes"])), sorted(ROWS, key=lambda x: (str(x[0]), len((x[1] or "").encode()))), strict=True):
        raw = (text or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len(raw), len(full))
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-32:])
        assert r["media_bytes"] % 188 == 0 and r["media_sha256"] == hashlib.sha256(mpegts.mux(full)).hexdigest() and "continuity=0;damaged=0" in r["feature"]
    assert mpegts.digests(documents(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=30_000))
def test_transport_stream_round_trip(data):
    out = mpegts.demux(mpegts.mux(data))
    assert out.payload == data and not out.damaged and not out.continuity_errors
    assert [u[0] for u in out.units] == [3600 * i for i in range(len(out.units))] and [u[3] for u in out.units] == [i % 4 == 0 for i in range(len(out.units))]


def test_damaged_streams_are_noticed():
    data = bytes(range(256)) * 100
    stream = mpegts.mux(data)
    lost = mpegts.demux(stream[: 188 * 20] + stream[188 * 21 :])
    assert lost.continuity_errors == 1 and lost.damaged == 1 and lost.payload != data
    assert mpegts.demux(b"\0" + stream[1:]).damaged == 1 and mpegts.demux(stream[:-5]).damaged >= 1 and mpegts.demux(b"").units == []


def ts_packet(pid, counter, payload, begins=False, adaptation=None):
    """A transport packet written field by field."""
    head = bytes([0x47, (0x40 if begins else 0) | pid >> 8, pid & 255])
    if adaptation is None and len(payload) < 184:
        adaptation = b"\x00" if len(payload) < 183 else b""
    if adaptation is None:
        return head + bytes([0x10 | counter]) + payload
    room = 183 - len(payload)
    return head + bytes([0x30 | counter, room]) + adaptation[:room].ljust(room, b"\xff") + payload


def table(table_id, number, body):
    """A section with its checksum by plain long division."""
    data = bytes([table_id, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    crc = 0xFFFFFFFF
    for byte in data:
        for bit in range(8):
            top = (crc >> 31) ^ (byte >> 7 - bit & 1)
            crc = (crc << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
    return data + crc.to_bytes(4, "big")


def foreign(change=lambda packets: packets):
    """A stream not made by the muxer: a program map over two packets, two units, the second a random-access point at 1,000."""
    pat = table(0, 1, bytes([0, 7, 0xE0 | 0x02, 0x00]))
    info = bytes([5, 200]) + b"i" * 200
    pmt = table(2, 7, bytes([0xE1, 0x11, 0xF0, len(info)]) + info + bytes([6, 0xE1, 0x11, 0xF0, 0]))
    pes = lambda t, data: b"\0\0\1\xbd" + (len(data) + 8).to_bytes(2, "big") + bytes([0x84, 0x80, 5, 0x21 | t >> 29 & 14, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1]) + data
    one, two = pes(7, b"a" * 300), pes(1000, b"b" * 20)
    first = b"\0" + pmt
    packets = [
        ts_packet(0, 3, b"\0" + pat + b"\xff" * (183 - len(pat)), True),
        ts_packet(0x200, 14, first[:184], True),
        ts_packet(0x200, 15, first[184:].ljust(184, b"\xff")),
        ts_packet(0x111, 9, one[:184], True),
        ts_packet(0x111, 10, one[184:]),
        ts_packet(0x111, 11, two, True, b"\x40"),
    ]
    return mpegts.demux(b"".join(change(packets)))


def test_streams_of_another_muxer():
    got_ = foreign()
    assert got_.programs == [(7, 0x200, 0x111, 6)] and got_.payload == b"a" * 300 + b"b" * 20
    assert got_.units == [(7, 0, 300, False), (1000, 300, 20, True)] and (got_.damaged, got_.continuity_errors) == (0, 0)
    twice = foreign(lambda p: [*p[:5], p[4], p[5]])
    assert twice.payload == got_.payload and (twice.damaged, twice.continuity_errors) == (0, 0)
    thrice = foreign(lambda p: [*p[:5], p[4], p[4], p[5]])
    assert thrice.continuity_errors >= 1
    jump = lambda p, flag: [*p[:5], ts_packet(0x111, 2, p[5][-34:], True, flag)]
    assert foreign(lambda p: jump(p, b"\x40")).continuity_errors == 1 and foreign(lambda p: jump(p, b"\xc0")).continuity_errors == 0
    assert foreign(lambda p: [p[0], p[1], p[2], p[4], p[5]]).damaged >= 1
    assert foreign(lambda p: [p[0], p[1], p[3], p[4], p[5]]).programs == [] and foreign(lambda p: [p[0], p[1], p[3], p[4], p[5]]).damaged == 1
    assert foreign(lambda p: [p[0][:-1] + b"\0", *p[1:]]).programs == got_.programs


def test_feature_tells_all_units_apart(spark):
    features = [r["feature"] for r in mpegts.digests(documents(spark, [(1, "x" * 200_000, "en", "s"), (2, "x" * 219_000, "en", "s")])).collect()]
    assert len(set(features)) == 2 and all("access=1" in f for f in features)


def test_shards(spark):
    df = clashing(documents(spark))
    for shards in (1, 5, 8):
        rows = sharding.shard_rows(df, shards).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
        slots = [sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(shards)]
        assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    again = sharding.shard_rows(df.repartition(3), 8)
    assert got(again) == got(sharding.shard_rows(df, 8)) and sharding.shard_rows(documents(spark, []), 8).count() == 0


def xx64(x, seed):
    """XXH64 of one long as Spark's xxhash64 has it, as a signed number."""
    h = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed & (1 << 64) - 1)
    return h - (h >> 63 << 64)


def plain_place(x, n, seed):
    """The cycle-walked network by plain numbers."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in range(sharding.ROUNDS):
            k = 2 * ((seed << 8) + i) + i % 2
            if k % 2:
                right = (right + xx64(k, xx64(left, 42)) % b) % b
            else:
                left = (left + xx64(k, xx64(right, 42)) % a) % a
        x = left * b + right
        if x < n:
            return x


def test_places_against_plain_numbers(spark):
    """Every row's shard and slot from its rank by content hash, computed apart."""
    rows = [(i, f"text {i} " + "x" * (i % 13), "en", "s") for i in range(137)]
    n = len(rows)
    found = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(documents(spark, rows), 8).collect()}
    text_hash = lambda t: (lambda h: h - (h >> 63 << 64))(xxhash.xxh64_intdigest(t.encode(), 42))
    key = {i: hashlib.md5(f"{sharding.SEED}:{i}:{text_hash(t)}".encode()).hexdigest() for i, t, *_ in rows}
    for number, i in enumerate(sorted(key, key=key.get)):
        place = plain_place(number, n, sharding.SEED)
        assert found[i] == (place % 8, place // 8)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(spark, n):
    places = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
    assert sorted(places) == list(range(n)) and (n < 50 or places != sorted(places))


def test_pieces_as_the_library_does(spark, sf):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").union(documents(spark))
    texts = {(r["doc_id"], r["text"] or "") for r in df.collect()}
    want = []
    for i, t in texts:
        ids = lib.encode(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert set(got(pieces.digests(clashing(df), MODEL))) == set(want)
    assert pieces.digests(documents(spark, []), MODEL).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab tion▁  ing the", max_size=80), st.text(alphabet="a ", max_size=60)))
def test_any_text_encodes_as_the_library_does(text):
    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.pieces(MODEL)
    ids = np.frombuffer(own.encode([text])[0], np.int32)
    assert ids.tolist() == lib.encode(text) and own.decode(ids) == lib.decode(ids.tolist())


def test_totals_beyond_32_bits():
    asked = [np.array([5, 9], np.uint64), np.array([9, 1 << 60], np.uint64)]
    counts = [np.array([7, 3_000_000_000]), np.array([3_000_000_000, 1])]
    table = pa.table(
        {
            "batch": [1, 2],
            "hashes": [lmscore.squeezed(np.diff(h, prepend=np.uint64(0))) for h in asked],
            "counts": [lmscore.counted(c) for c in counts],
        }
    )
    out = lmscore._answer(lmscore.Shards(1, 1))((pa.scalar(0),), table).to_pylist()
    assert [lmscore.uncounted(r["totals"]).tolist() for r in out] == [[7, 6_000_000_000], [6_000_000_000, 1]]
    assert out[0]["n"] == 6_000_000_008 and out[0]["v"] == 3
