import random
import statistics

from blockloom.llm import matroska as m


def files():
    plain = m.write([bytes([k % 251]) * 576 for k in range(900)])
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x81\0\5\0abc") + m.number(m.REFERENCE, 1))
    laced = m.element(m.SIMPLE_BLOCK, b"\x81\0\7\x86" + m.lace([b"a" * 300, b"b" * 20, b"c"], m.EBML_LACING))
    small = m._HEAD + m.element(m.SEGMENT, m._AUDIO + m.element(m.CLUSTER, m.number(m.TIMESTAMP, 5) + group + laced) + m.element(m.CUES, m.element(m.CUE_POINT, m.number(m.CUE_TIME, 5) + m.element(m.CUE_POSITIONS, m.number(m.CUE_TRACK, 1) + m.number(m.CUE_CLUSTER, 70)))))
    return plain, small


def test_flipped_bytes_give_packets_or_damage():
    rng = random.Random(1)
    for media in files():
        places = range(min(len(media), 400)) if len(media) > 2000 else range(len(media))
        for at in places:
            for value in (0, 255, 1, 0x80, rng.randrange(256)):
                bad = media[:at] + bytes([value]) + media[at + 1 :]
                try:
                    for what, *x in m.scan(bad):
                        if what == "packet":
                            p = x[0]
                            assert 0 <= p.offset <= p.offset + p.size <= len(bad) and abs(p.timestamp_ns) < 2**63 and p.track < 2**31
                except m.Damaged:
                    pass


def test_every_flip_is_a_row(spark):
    rng, small = random.Random(2), files()[1]
    bad = [small[:k] + bytes([rng.randrange(256)]) + small[k + 1 :] for k in range(len(small))]
    df = spark.createDataFrame(list(enumerate(bad)), "id long, m binary")
    assert m.packets(df, "id", "m").where("packet IS NULL AND error IS NULL").count() == 0
    assert m.cues(df, "id", "m").where("time_ns IS NULL AND error IS NULL").count() == 0


def test_an_unknown_size_ends_with_what_holds_it():
    block = m.element(m.SIMPLE_BLOCK, b"\x81\0\0\x80data")
    open_cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.number(m.TIMESTAMP, 3) + block
    cue = m.element(m.CUES, m.element(m.CUE_POINT, m.number(m.CUE_TIME, 3) + m.element(m.CUE_POSITIONS, m.number(m.CUE_TRACK, 1) + m.number(m.CUE_CLUSTER, 0))))
    known = m.element(m.SEGMENT, open_cluster + open_cluster + cue)
    unknown = m.SEGMENT.to_bytes(4, "big") + b"\xff" + open_cluster
    found = list(m.scan(m._HEAD + known + m._HEAD + known + m._HEAD + unknown + m._HEAD + unknown))
    assert [x[0] for x in found] == ["packet", "packet", "cue"] * 2 + ["packet"] * 2
    assert all(x[1].timestamp_ns == 3_000_000 for x in found if x[0] == "packet")


def test_odd_places_and_numbers():
    alone = m.element(m.CUE_POSITIONS, m.number(m.CUE_TRACK, 1))
    assert list(m.scan(alone)) == [("cue", 0, 1, 0)]
    late = m.element(m.CLUSTER, m.number(m.TIMESTAMP, 2**63) + m.element(m.SIMPLE_BLOCK, b"\x81\0\0\x80x"))
    many = m.element(m.CLUSTER, m.number(m.TIMESTAMP, 1) + m.element(m.SIMPLE_BLOCK, m.vint(2**40) + b"\0\0\x80x"))
    for media in (late, many):
        try:
            list(m.scan(media))
            raise AssertionError("no damage found")
        except m.Damaged:
            pass


def test_damaged_cues_say_so(spark):
    plain = files()[1]
    df = spark.createDataFrame([(1, plain), (2, plain[:-3]), (3, None)], "id long, m binary")
    assert sorted((r.id, r.error is None) for r in m.cues(df, "id", "m").collect()) == [(1, True), (2, False)]


def test_features_by_hand(docs):
    for r in m.text_media(docs.limit(20)).join(docs.limit(20).select("doc_id", "text"), "doc_id").collect():
        x = list(m.payload((r.text or "").encode()))
        packets, points, mean, deviation, crossings, energy = r.feature.split(":")
        centred = [v - statistics.fmean(x) for v in x]
        assert int(packets) == len(x) // 576 and int(points) == -(-int(packets) // (m.FRAMES_PER_BLOCK * m.BLOCKS_PER_CLUSTER))
        assert abs(float(mean) - statistics.fmean(x)) < 1e-3 and abs(float(deviation) - statistics.pstdev(x)) < 1e-3
        assert int(crossings) == sum((a < 0) != (b < 0) for a, b in zip(centred, centred[1:]))
        size, extra = divmod(len(x), 8)
        at = 0
        for k, e in enumerate(energy.split(",")):
            part = centred[at : at + size + (k < extra)]
            at += len(part)
            assert abs(float(e) - statistics.fmean(v * v for v in part)) < 0.02
