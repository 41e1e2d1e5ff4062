from blockloom.llm import matroska


def test_laced_frames_have_times_of_their_own():
    found = [x[1] for x in matroska.scan(matroska.write([bytes([k % 250]) * 576 for k in range(1000)])) if x[0] == "packet"]
    assert [p.timestamp_ns for p in found] == [k * 72_000_000 for k in range(1000)]
    assert max(p.lace for p in found) == 7


def test_without_default_duration_it_is_the_blocks_time():
    media = matroska.write([b"a" * 576] * 16).replace(b"\x23\xe3\x83", b"\x23\xe3\x84")
    assert [p.timestamp_ns for p in (x[1] for x in matroska.scan(media) if x[0] == "packet")] == [0] * 8 + [576_000_000] * 8
