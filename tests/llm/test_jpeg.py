import hashlib
import struct
import zlib

import numpy as np
import pytest

from sessionmill.llm.jpeg import Bits, _ac_first, _ac_refine, _zigzag, decode, encode, lookup, media_digests, padded, payload_of, rgb_tensors, stored_as_media

TEXTS = ["", None, "a", "hello " * 50, "é" * 1000, "x" * 64, "y" * 65, "漢" * 4000, "z" * 70_000, "hello " * 50]


def files():
    pairs = [padded(t) for t in TEXTS]
    return pairs, encode([p for p, _ in pairs], [struct.pack(">QQ", n, len(p)) for p, n in pairs])


def test_round_trip_together_and_alone():
    pairs, data = files()
    images = decode(data)
    for (payload, n), image, own in zip(pairs, images, data, strict=True):
        assert payload_of(image) == (payload, n)
        alone = decode([own])[0]
        assert (alone.rgb == image.rgb).all() and payload_of(alone) == (payload, n)
    assert data[3] == data[9] and data[0] == data[1]


def test_tensor_equals_the_plain_formula():
    _, data = files()
    image = decode([data[3]])[0]
    cos = [[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.5) if u == 0 else 1) / 2 for u in range(8)] for x in range(8)]
    basis = np.array(cos)
    units = []
    for block in image.blocks.reshape(-1, 6, 64):
        planes = []
        for zz in block:
            square = np.zeros(64)
            square[_zigzag()] = zz
            planes.append(np.clip(np.rint(basis @ square.reshape(8, 8) @ basis.T + 128), 0, 255))
        y = np.block([[planes[0], planes[1]], [planes[2], planes[3]]])
        cb, cr = (np.kron(p, np.ones((2, 2))) - 128 for p in planes[4:])
        units.append(np.clip(np.rint(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), -1)), 0, 255))
    wide = image.rgb.shape[1] // 16
    for i, unit in enumerate(units):
        r, c = divmod(i, wide)
        assert np.abs(image.rgb[16 * r : 16 * r + 16, 16 * c : 16 * c + 16].astype(int) - unit).max() <= 1


def bits_of(text):
    text = text.replace(" ", "")
    text += "1" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8).replace(b"\xff", b"\xff\x00")


def test_runs_and_end_of_band_runs():
    # codes: 0 = (0,1), 10 = end of band run of 2 to 3 blocks, 110 = sixteen zeros, 1110 = (2,2), 11110 = end of block
    table = lookup(bytes([1, 1, 1, 1, 1, *[0] * 11]), bytes([0x01, 0x10, 0xF0, 0x22, 0x00]))
    out = np.zeros((4, 64), np.int32)
    data = bits_of("0 1  110 1110 01  11110   10 1  1110 10 11110")
    _ac_first(out, Bits([data]), np.array([0]), np.array([5]), np.array([0, 1, 2, 3, 3]), table, 1, 63, 1)
    want = np.zeros((4, 64), np.int32)
    want[0, 1], want[0, 20] = 2, -4
    # the run covers blocks 1 and 2 and one more
    assert (out[0] == want[0]).all() and not out[1:3].any()


def test_refinement_inserts_and_corrects():
    # codes: 0 = (0,1), 10 = (1,1), 110 = end of block
    table = lookup(bytes([1, 1, 1, *[0] * 13]), bytes([0x01, 0x11, 0x00]))
    out = np.zeros((1, 64), np.int32)
    out[0, 2], out[0, 5], out[0, 9] = 2, -2, 4
    # new +1 after one zero: passes place 1, corrects 2, lands on 3; then end of block corrects 5 (yes) and 9 (no)
    _ac_refine(out, Bits([bits_of("10 1 1  110 1 0")]), np.array([0]), np.array([1]), np.array([0]), table, 1, 63, 0)
    want = np.zeros(64, np.int32)
    want[2], want[3], want[5], want[9] = 3, 1, -3, 4
    assert (out[0] == want).all()


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        decode([b"GIF89a"])


def test_query_columns(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (3, TEXTS[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    media = stored_as_media(df)
    got = media_digests(media).collect()
    assert len(got) == len(rows)
    for r in got:
        payload, n = padded("no id" if r.doc_id is None else TEXTS[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = [tuple(r)[1:] for r in got if r.doc_id in (3, 9)]
    assert len(same) == 3 and len(set(same)) == 1
    tensor = rgb_tensors(media.where("doc_id = 4")).first()
    assert len(tensor.rgb) == tensor.height * tensor.width * 3
    assert media_digests(stored_as_media(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
