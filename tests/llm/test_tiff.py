import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest

from vellumine.llm import tiff


def rebuilt(data):
    return b"".join(p.data for p in tiff.read_pages(data))


@pytest.mark.parametrize("rows", [1, 5, 64, 65, 200])
@pytest.mark.parametrize("forms", [tiff.FORMS, (("strips", tiff.NONE, 1),), (("strips", tiff.LZW, 1),), (("tiles", tiff.LZW, 2),), (("tiles", tiff.DEFLATE, 2),), (("strips", tiff.PACKBITS, 2),)])
def test_round_trip(rows, forms):
    rng = random.Random(rows)
    for payload in (os.urandom(576 * rows), bytes(576 * rows), bytes(rng.choice(b"ab \xff") for _ in range(576 * rows))):
        assert rebuilt(tiff.write_payload(payload, forms)) == payload
    assert len(list(tiff.read_pages(tiff.write_payload(bytes(576 * rows))))) == max(-(-rows // 64), min(rows, 3))


def test_every_file_of_three_rows_has_all_codecs():
    import pandas as pd

    texts = [t.encode() for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet")["text"]]
    decoded, files = {}, 0
    for t in texts:
        found = list(tiff.read_pages(tiff.write_payload(t + b"\xff" * (-len(t) % 576 or (0 if t else 576)))))
        for p in found:
            decoded[p.compression] = decoded.get(p.compression, 0) + len(p.data)
        if sum(p.height for p in found) >= 3:
            files += 1
            assert {p.compression for p in found} == {tiff.DEFLATE, tiff.PACKBITS, tiff.LZW} and {p.predictor for p in found} == {1, 2}
    assert files > 0.6 * len(texts) and min(decoded.values()) > 0.25 * sum(decoded.values())


def test_codecs():
    for data in (b"", b"a", b"aaa", b"abababab" * 99, bytes(range(256)) * 40, os.urandom(9000), b"x" * 70_000):
        assert tiff.unlzw(tiff.lzw(data), len(data)) == data
        assert tiff.unpackbits(tiff.packbits(data), len(data)) == data
    assert tiff.unpackbits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x80, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA]), 24) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)


def file_of(order, tags, chunks, offsets_tag, counts_tag):
    """A one-page file in either byte order, written independently of the module."""
    body, places = bytearray(b"\0" * 8), []
    for c in chunks:
        places.append(len(body))
        body += c
    tags = tags | {offsets_tag: ("I", places), counts_tag: ("I", [len(c) for c in chunks])}
    entries = b""
    for tag in sorted(tags):
        code, values = tags[tag]
        packed = struct.pack(f"{order}{len(values)}{code}", *values)
        if len(packed) > 4:
            at = len(body)
            body += packed
            packed = struct.pack(f"{order}I", at)
        entries += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4}[code], len(values)) + packed.ljust(4, b"\0")
    at = len(body)
    body += struct.pack(f"{order}H", len(tags)) + entries + b"\0\0\0\0"
    body[:8] = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at)
    return bytes(body)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("bits", [8, 16, 32])
def test_horizontal_predictor_of_wide_samples(order, bits):
    rng = np.random.default_rng(bits)
    image = rng.integers(0, 1 << bits, (7, 5, 2)).astype(f"u{bits // 8}")
    diff = image.copy()
    diff[:, 1:] -= image[:, :-1]
    tags = {256: ("H", [5]), 257: ("H", [7]), 258: ("H", [bits, bits]), 259: ("H", [8]), 277: ("H", [2]), 278: ("H", [3]), 317: ("H", [2])}
    strips = [zlib.compress(diff[y : y + 3].astype(f"{order}u{bits // 8}").tobytes()) for y in (0, 3, 6)]
    page = next(tiff.read_pages(file_of(order, tags, strips, 273, 279)))
    assert (page.width, page.height, page.samples, page.bits) == (5, 7, 2, bits)
    assert page.data == image.astype(f"<u{bits // 8}").tobytes()


def test_float_predictor_and_planes():
    image = np.random.default_rng(3).normal(size=(4, 6)).astype("<f4")
    planes = image.astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
    coded = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1)
    tags = {256: ("H", [6]), 257: ("H", [4]), 258: ("H", [32]), 259: ("H", [1]), 277: ("H", [1]), 278: ("H", [4]), 317: ("H", [3]), 339: ("H", [3])}
    assert next(tiff.read_pages(file_of("<", tags, [coded.tobytes()], 273, 279))).data == image.tobytes()
    rgb = np.random.default_rng(4).integers(0, 256, (20, 20, 3)).astype(np.uint8)
    tags = {256: ("H", [20]), 257: ("H", [20]), 258: ("H", [8, 8, 8]), 259: ("H", [32773]), 277: ("H", [3]), 284: ("H", [2]), 322: ("H", [16]), 323: ("H", [16])}
    padded = np.zeros((32, 32, 3), np.uint8)
    padded[:20, :20] = rgb
    tiles = [b"".join(tiff.packbits(r.tobytes()) for r in padded[y : y + 16, x : x + 16, p]) for p in range(3) for y in (0, 16) for x in (0, 16)]
    assert next(tiff.read_pages(file_of("<", tags, tiles, 324, 325))).data == rgb.tobytes()


def test_pages_of_a_column(rows):
    good = tiff.write_payload(os.urandom(576 * 130))
    broken = bytearray(good)
    broken[4:8] = (1 << 30).to_bytes(4, "little")
    df = rows([(1, bytearray(good), "x"), (2, None, "y"), (3, bytearray(b"junk"), None), (4, bytearray(), "z"), (5, broken, "w")], "doc_id long, media binary, page string")
    got = sorted(((r["doc_id"], -1 if r["page"] is None else r["page"], r["error"] is None) for r in tiff.pages(df).collect()))
    assert got == [(1, 0, True), (1, 1, True), (1, 2, True), (3, -1, False), (5, -1, False)]
    bad = bytearray(tiff.write_payload(os.urandom(576 * 130)))
    at = 4
    for _ in range(2):  # the second directory's width becomes 0
        at = struct.unpack_from("<I", bad, at)[0]
        first, at = at, at + 2 + 12 * struct.unpack_from("<H", bad, at)[0]
    struct.pack_into("<I", bad, first + 10, 0)
    walked = sorted((r["page"], r["error"] is None, r["pixels"] is None) for r in tiff.pages(rows([(1, bad)], "doc_id long, media binary")).collect())
    assert walked == [(0, True, False), (1, False, True), (2, True, False)]
    small = tiff.pages(rows([(1, bytearray(good))], "doc_id long, media binary"), most=10).collect()
    assert tiff.pages(rows([], "doc_id long, media binary")).count() == 0
    assert len(small) == 3 and all(r["error"] and r["pixels"] is None for r in small)


def test_fold_of_broken_files(rows):
    good = tiff.write_payload(os.urandom(576 * 5))
    cut = bytearray(good)
    struct.pack_into("<I", cut, struct.unpack_from("<I", cut, 4)[0] + 10, 0)
    df = rows([(1, bytearray(good), "x"), (2, None, "y"), (3, bytearray(b"junk"), None), (4, cut, "z"), (5, bytearray(), "w")], "doc_id long, media binary, error string")
    got = {r["doc_id"]: (r["payload_bytes"], r["error"] is None) for r in tiff.pages(df, fold=(tiff.payload_digest, tiff.DIGEST_SCHEMA)).collect()}
    assert got == {1: (2880, True), 2: (0, True), 3: (None, False), 4: (None, False), 5: (0, True)}


def test_golden_bytes():
    """Whole files and LZW codes laid out by hand from the specification."""
    # codes of 9 bits, high bits first: clear, 7, 258 (7 7), 8, 8, 258, 6, 6, end
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unlzw(data, 10) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) == tiff.unlzw(tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])), 9)
    # widths grow one code early: after 253 literals the table holds code 510 and the next code has 10 bits
    plain = bytes(range(256))
    bits = f"{256:09b}" + "".join(f"{v:0{9 if k < 254 else 10}b}" for k, v in enumerate(plain)) + f"{257:010b}"
    assert tiff.unlzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big"), 256) == plain
    # a big-endian file of one grey row of four samples in PackBits
    entries = [(256, 3, 1, 4 << 16), (257, 3, 1, 1 << 16), (258, 3, 1, 8 << 16), (259, 3, 1, 32773 << 16), (262, 3, 1, 1 << 16), (273, 4, 1, 8), (277, 3, 1, 1 << 16), (278, 3, 1, 1 << 16), (279, 4, 1, 4)]
    file = b"MM\0*\0\0\0\x0c" + bytes([0xFE, 9, 0, 5]) + struct.pack(">H", 9) + b"".join(struct.pack(">HHII", *e) for e in entries) + b"\0\0\0\0"
    assert [(p.width, p.height, p.data) for p in tiff.read_pages(file)] == [(4, 1, bytes([9, 9, 9, 5]))]


def test_digests_of_texts(rows):
    texts = [None, "", "a", "é" * 288, "x" * 576, "y" * 577, "long " * 30_000, "a"]
    df = rows([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, feature string, media_bytes int")
    got = {r["doc_id"]: r for r in tiff.stored_digests(df.select("doc_id", "text")).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[2]["media_sha256"] == got[7]["media_sha256"] and got[0]["feature"] == got[1]["feature"]
    assert len(tiff.stored_digests(df).collect()) == len(texts)
    assert tiff.stored_digests(rows([], "doc_id long, text string")).count() == 0
