import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obliqua.llm import flac
from obliqua.llm.media import media_features, pcm_blocks, to_media


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 14), st.integers(0, 3), st.integers(0, 2**31)), min_size=1, max_size=5))
def test_round_trip(specs):
    payloads = []
    for units, kind, seed in specs:
        r, n = np.random.default_rng(seed), 192 * units
        wave = 128 + 90 * np.sin(np.arange(n) / (1 + seed % 50))
        payloads.append({0: r.integers(0, 256, n), 1: np.full(n, seed % 256), 2: wave, 3: np.clip(np.cumsum(r.integers(-2, 3, n)) + 128, 0, 255)}[kind].astype(np.uint8).tobytes())
    files = flac.encode_many(payloads)
    assert [(x + 128).astype(np.uint8).tobytes() for x in flac.decode_many(files)] == payloads
    assert flac.encode_many(payloads[:1]) == files[:1]
    n = len(payloads[0])
    assert (flac.read_samples(files[0], n // 3, n // 2) + 128).astype(np.uint8).tobytes() == payloads[0][n // 3 : n // 2]


def test_files_without_a_seek_table_decode_too():
    payload = bytes(np.random.default_rng(2).integers(60, 120, 192 * 15, dtype=np.uint8))
    file = flac.encode_many([payload])[0]
    bare = bytearray(file[:42] + file[flac.read_metadata(file).first :])
    bare[4] |= 0x80  # the stream information becomes the last metadata block
    assert (flac.decode_many([bytes(bare)])[0] + 128).astype(np.uint8).tobytes() == payload


@pytest.mark.parametrize("place", [24, 45, 80, -1])
def test_damage_is_noticed(place):
    file = bytearray(flac.encode_many([bytes(range(192)) * 3])[0])
    file[place] ^= 0x10
    with pytest.raises(flac.FlacError):
        flac.decode_many([bytes(file)])


def test_features_describe_the_payload(frame, odd_texts):
    rows = {r["doc_id"]: r for r in media_features(to_media(frame(odd_texts))).collect()}
    for i, text in enumerate(odd_texts):
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        got = rows[i]
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[3]["media_sha256"] == rows[4]["media_sha256"] and rows[3]["feature"] == rows[4]["feature"]
    assert media_features(to_media(frame([]))).count() == 0


def test_blocks_have_sample_offsets(frame):
    text = "seekable " * 400
    blocks = sorted(pcm_blocks(to_media(frame([text]))).collect(), key=lambda r: r["block"])
    assert b"".join(bytes(b["pcm"]) for b in blocks).rstrip() == text.rstrip().encode()
    assert [b["first_sample"] for b in blocks] == [flac.BLOCK * k for k in range(len(blocks))]
