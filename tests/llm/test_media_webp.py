import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelattice.llm import media_columns as mc
from pagelattice.llm import webp_lossless as wl

# A plain scalar writer of VP8L streams, with all features, to test the decoder against.


def split(p):
    return [p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255]


def number(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def prefix(v):
    """code, extra value, extra bits of a length or distance."""
    for code in range(40):
        if code < 4:
            if v == code + 1:
                return code, 0, 0
        else:
            e = (code - 2) >> 1
            low = ((2 + (code & 1)) << e) + 1
            if low <= v < low + (1 << e):
                return code, v - low, e
    raise AssertionError(v)


def put_pixels(w, argb, width, cache_bits=0, refs=False, meta=None, main=True, rng=None):
    """argb: flat list of numbers; meta: (bits, blocks by row) for several groups."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = 1
    if main:
        w.put(int(meta is not None), 1)
        if meta:
            w.put(meta[0] - 2, 3)
            put_pixels(w, [g << 8 for row in meta[1] for g in row], len(meta[1][0]), main=False)
            groups = 1 + max(g for row in meta[1] for g in row)
    cache, ops, i = {}, [], 0
    slot = lambda p: (p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)
    near = {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(wl.NEAR))) if x + y * width >= 1}
    while i < len(argb):
        at = i
        if refs and i and rng.random() < 0.7:
            best = max(((next((k for k in range(min(300, len(argb) - i)) if argb[i + k] != argb[i - d + k]), min(300, len(argb) - i)), -d) for d in range(1, min(i, 60) + 1)), default=(0, 0))
            if best[0] >= 2:
                ops.append((at, "ref", best[0], near.get(-best[1], -best[1] + 120)))
                for p in argb[i : i + best[0]]:
                    cache[slot(p) if cache_bits else 0] = p
                i += best[0]
                continue
        p = argb[i]
        if cache_bits and cache.get(slot(p)) == p:
            ops.append((at, "cache", slot(p)))
        else:
            ops.append((at, "pixel", p))
        cache[slot(p) if cache_bits else 0] = p
        i += 1
    group = lambda at: meta[1][at // width >> meta[0]][at % width >> meta[0]] if meta else 0
    codes = []
    for g in range(groups):
        counts = [[0] * (280 + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
        for at, kind, *x in ops:
            if group(at) != g:
                continue
            if kind == "pixel":
                a, r, gr, b = split(x[0])
                for k, s in enumerate((gr, r, b, a)):
                    counts[k][s] += 1
            elif kind == "cache":
                counts[0][280 + x[0]] += 1
            else:
                counts[0][256 + prefix(x[0])[0]] += 1
                counts[4][prefix(x[1])[0]] += 1
        mine = []
        for c in counts:
            used = [s for s, n in enumerate(c) if n]
            if len(used) <= 2 and all(s < 256 for s in used):
                used = used or [0]
                wl.put_simple(w, tuple(used))
                mine.append({used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)})
            else:
                lengths = wl.code_lengths(c)
                wl.put_code(w, lengths)
                mine.append(wl.canonical(lengths) if len(used) > 1 else {used[0]: (0, 0)})
        codes.append(mine)
    for at, kind, *x in ops:
        c = codes[group(at)]
        if kind == "pixel":
            a, r, gr, b = split(x[0])
            for k, s in enumerate((gr, r, b, a)):
                w.put(*c[k][s])
        elif kind == "cache":
            w.put(*c[0][280 + x[0]])
        else:
            code, extra, bits = prefix(x[0])
            w.put(*c[0][256 + code])
            w.put(extra, bits)
            code, extra, bits = prefix(x[1])
            w.put(*c[4][code])
            w.put(extra, bits)


def guess(mode, left, top, tl, tr):
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [a + b - c for a, b, c in zip(left, top, tl)]
        pl, pt = sum(abs(a - b) for a, b in zip(p, left)), sum(abs(a - b) for a, b in zip(p, top))
        return left if pl < pt else top
    return [
        lambda: [255, 0, 0, 0], lambda: left, lambda: top, lambda: tr, lambda: tl, lambda: avg(avg(left, tr), top), lambda: avg(left, tl), lambda: avg(left, top), lambda: avg(tl, top), lambda: avg(top, tr),
        lambda: avg(avg(left, tl), avg(top, tr)), None, lambda: [clip(a + b - c) for a, b, c in zip(left, top, tl)], lambda: [clip(a + int((a - b) / 2)) for a, b in zip(avg(left, top), tl)],
    ][mode]()


def write(img, width, transforms=(), rng=None, **how):
    """A WebP file of flat ARGB numbers; transforms are applied in order."""
    height = len(img) // width
    w = wl.BitWriter()
    w.put(0x2F, 8)
    w.put(wl.size_bits(width, height), 32)
    px, wide = list(img), width
    for t in transforms:
        w.put(1, 1)
        w.put(t, 2)
        if t in (wl.PREDICTOR, wl.CROSS):
            bits = rng.randint(2, 3)
            w.put(bits - 2, 3)
            bw, bh = -(-wide // (1 << bits)), -(-height // (1 << bits))
            new = []
            if t == wl.PREDICTOR:
                blocks = [rng.randint(0, 13) << 8 for _ in range(bw * bh)]
                for i, p in enumerate(px):
                    y, x = divmod(i, wide)
                    c = [split(px[j]) if j >= 0 else None for j in (i - 1, i - wide, i - wide - 1, i - wide + 1)]
                    g = [255, 0, 0, 0] if i == 0 else c[0] if y == 0 else c[1] if x == 0 else guess(blocks[(y >> bits) * bw + (x >> bits)] >> 8, *c)
                    new.append(number([(a - b) & 255 for a, b in zip(split(p), g)]))
            else:
                blocks = [rng.getrandbits(24) for _ in range(bw * bh)]
                s8 = lambda v: v - 256 if v > 127 else v
                for i, p in enumerate(px):
                    y, x = divmod(i, wide)
                    _, rb, gb, gr = split(blocks[(y >> bits) * bw + (x >> bits)])
                    a, r, g, b = split(p)
                    new.append(number([a, (r - (s8(gr) * s8(g) >> 5)) & 255, g, (b - (s8(gb) * s8(g) >> 5) - (s8(rb) * s8(r) >> 5)) & 255]))
            put_pixels(w, blocks, bw, main=False)
            px = new
        elif t == wl.GREEN:
            px = [number([a, (r - g) & 255, g, (b - g) & 255]) for a, r, g, b in map(split, px)]
        else:
            colours = sorted(set(px))
            w.put(len(colours) - 1, 8)
            diff = [number([(x - y) & 255 for x, y in zip(split(c), split(d))]) for c, d in zip(colours, [0, *colours])]
            put_pixels(w, diff, len(diff), main=False)
            bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            per, new = 1 << bits, []
            for y in range(height):
                row = [colours.index(p) for p in px[y * wide : (y + 1) * wide]]
                for a in range(0, wide, per):
                    new.append(255 << 24 | sum(v << (k * (8 >> bits)) for k, v in enumerate(row[a : a + per])) << 8)
            px, wide = new, -(-wide // per)
    w.put(0, 1)
    put_pixels(w, px, wide, rng=rng, **how)
    return wl.wrap(w.data())


@pytest.mark.parametrize("seed", range(24))
def test_decoder(seed):
    rng = random.Random(seed)
    files, want = [], []
    for k in range(4):
        width, height = rng.randint(1, 19), rng.randint(1, 13)
        few = rng.choice((1, 2, 4, 9, 40, None))
        colours = [rng.getrandbits(32) for _ in range(few or 1)]
        img = [rng.choice(colours) if few else (number([255 - (i & 3), i & 255, i * 3 & 255, rng.randint(0, 9)])) for i in range(width * height)]
        if rng.random() < 0.5:
            img = [img[i // 3] for i in range(len(img))]
        options = [wl.PREDICTOR, wl.CROSS, wl.GREEN, *([wl.PALETTE] if few else [])]
        transforms = rng.sample(options, rng.randint(0, len(options)))
        if wl.PALETTE in transforms:  # the palette counts the colours of the image, so it comes first here
            transforms.sort(key=lambda t: t != wl.PALETTE)
        how = {"cache_bits": rng.choice((0, 1, 4, 11)), "refs": rng.random() < 0.6}
        if not transforms and rng.random() < 0.5:
            how["meta"] = (2, [[rng.randint(0, 2) for _ in range(-(-width // 4))] for _ in range(-(-height // 4))])
        files.append(write(img, width, transforms, rng, **how))
        want.append(np.array(list(map(split, img)), np.uint8).reshape(height, width, 4))
    for got, exact in zip(wl.Decoder().decode(files), want, strict=True):
        assert got.shape == exact.shape and (got == exact).all()


def test_bad_files():
    good = wl.encode([bytes(range(64))])[0]
    for bad in (b"", b"RIFF", good[:30], good[:20] + b"\x00" + good[21:], good[:60]):
        with pytest.raises((wl.BadImage, IndexError, ValueError)):
            wl.Decoder().decode([bad])


def test_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "x" * 64, "é🎉" * 50, "word " * 40000, *("".join(rng.choice("etaoin \nÉ,") for _ in range(rng.randint(0, 3000))) for _ in range(40))]
    data = [(i, t, b"clash", 1) for i, t in enumerate(texts)] + [(5, texts[5], None, None), (None, "a", None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, media binary, n_bytes int")
    media = mc.stored(df)
    out = mc.digests(media).collect()
    assert len(out) == len(data)
    seen = {}
    for r in out:
        raw = (texts[r.doc_id] if r.doc_id is not None else "a" or "") or ""
        full = raw.encode() + bytes(-len(raw.encode()) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw.encode()), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert seen.setdefault(raw, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert len({v[1] for v in seen.values()}) == len(seen)
    assert all(r.height * r.width * 4 == len(r.pixels) for r in mc.arrays(media).collect())
    assert mc.digests(mc.stored(df.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a line that stands again\n", "x", "0123456789abcdef" * 4, "\x00", "é"]), st.integers(0, 400)), max_size=8), st.integers(0, 9))
def test_back_references_of_the_encoder(parts, seed):
    data = mc.padded(random.Random(seed).randbytes(7 * seed) + "".join(t * n for t, n in parts).encode())
    media = wl.encode([mc.padded(b"other"), data, data])
    assert media[1] == media[2]
    assert [p.tobytes() for p in mc.pixels_of(media)] == [mc.padded(b"other"), data, data]
    runs = wl.repeats(np.frombuffer(data, "<u4"), np.zeros(len(data) // 4, np.int64))
    assert all(n >= wl.REPEAT for _, n, _ in runs)


def test_repeated_text_goes_out_by_back_references():
    line = mc.padded(b"A line of text that stands here many times, of more than sixty-four bytes.\n" * 200)
    assert len(wl.encode([line])[0]) < len(line) // 8
