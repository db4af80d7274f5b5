"""GIF media columns: LZW code streams, palettes, interlace, transparency, disposal and frame times, in both directions."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.batches import kept_for, map_texts

#: Stored payloads: samples in a row, rows in a frame at most, hundredths of a second that a frame is shown.
WIDTH, ROWS, DELAY = 64, 4096, 4
#: Colour histogram: two bits of each of red, green and blue.
BINS = 64
#: Pixels of the largest canvas that is drawn (64 MB); a file that claims a larger one is at fault.
MOST_PIXELS = 1 << 24
#: Samples that are encoded or decoded at once, a single larger picture apart.
AT_ONCE = 1 << 21
_MOST = 4096
_GREY = bytes(c for v in range(256) for c in (v, v, v))


class GifError(ValueError):
    pass


def _widths(size: int, n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, for literals of `size` bits."""
    return np.clip(np.frexp(np.arange(n) + (1 << size) + 1)[1], size + 1, 12)


_W8 = _widths(8, 2 * _MOST)


#: Samples between clear codes when encoding: even, and so few that the table can't fill up.
_SEGMENT = 3_836


def lzw_encode_all(parts: list[bytes]) -> list[bytes]:
    """An LZW stream for each run of 8-bit samples (of even length), packed from the low bit up.

    The parse is by pairs: the first time that a pair of samples occurs in a segment it is written as two literals,
    which enters it in the table; later it is the one code of that entry. So all codes are found without a loop.
    """
    if not parts:
        return []
    sizes = np.array([len(p) for p in parts], np.int64)
    x = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    pair = x[::2] << 8 | x[1::2]
    n_seg = -(-sizes // _SEGMENT)
    seg_sizes = np.full(int(n_seg.sum()), _SEGMENT)
    last = np.cumsum(n_seg) - 1
    seg_sizes[last] = sizes - (n_seg - 1) * _SEGMENT
    seg = np.repeat(np.arange(len(seg_sizes)), seg_sizes // 2)
    _, first, back = np.unique(seg << 16 | pair, return_index=True, return_inverse=True)
    origin = first[back]
    new = origin == np.arange(len(pair))
    seg_first = np.concatenate(([0], np.cumsum(seg_sizes // 2)[:-1]))
    seg_part = np.repeat(np.arange(len(parts)), n_seg)
    # codes: a clear code before each segment, one or two for each pair, an end code after each part
    own = 1 + new
    own[seg_first] += 1
    ends_here = np.cumsum(own) + seg_part[seg]
    at = ends_here - 1 - new  # place of each pair's first code
    total = int(ends_here[-1]) + 1
    codes, since = np.full(total, 257, np.int64), np.zeros(total, np.int64)
    clear_at = at[seg_first] - 1
    codes[at] = np.where(new, pair >> 8, 258 + at[origin] - clear_at[seg] - 1)
    codes[at[new] + 1] = pair[new] & 255
    codes[clear_at] = 256
    bounds = np.append(clear_at, total)
    since = np.arange(total) - np.repeat(clear_at, np.diff(bounds)) - 1
    widths = _W8[np.maximum(since, 0)]
    inner = np.setdiff1d(np.arange(len(clear_at)), np.concatenate(([0], last[:-1] + 1)))
    widths[clear_at] = 9
    widths[clear_at[inner]] = _W8[since[clear_at[inner] - 1] + 1]
    part_first = clear_at[np.concatenate(([0], last[:-1] + 1))]
    bits = np.add.reduceat(widths, part_first)
    lengths = (bits + 7) >> 3
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    before = np.cumsum(widths) - widths
    n_codes = np.diff(np.append(part_first, total))
    offset = before + np.repeat(begin * 8 - before[part_first], n_codes)
    value, byte = codes << (offset & 7), offset >> 3
    out = sum(np.bincount(byte + k, value >> 8 * k & 255, int(lengths.sum()) + 3) for k in range(3)).astype(np.uint8).tobytes()
    return [out[lo : lo + n] for lo, n in zip(begin.tolist(), lengths.tolist(), strict=True)]


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """At most `most` samples; a stream that ends early gives fewer. Raises GifError on a code that can't be.

    Code widths follow from the number of codes since the last clear code, so codes are cut out in vectors.
    """
    if not 1 <= size <= 11:
        raise GifError(f"literals of {size} bits")
    clear, end = 1 << size, (1 << size) + 1
    widths = _W8 if size == 8 else _widths(size, 2 * _MOST)
    raw = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
    bits, pos, out, got = len(stream) * 8, 0, [], 0
    table: list[bytes] = []
    prev, since = b"", 0
    while pos < bits and got < most:
        if not table:
            table = [bytes([i]) if i < 256 else b"" for i in range(clear)] + [b"", b""]
            prev, since = b"", 0
        own = widths[since : since + _MOST] if since < _MOST else np.full(_MOST, 12)
        ends = pos + np.cumsum(own)
        n = int(np.searchsorted(ends, bits, side="right"))
        if not n:
            break
        begin, own = (ends - own)[:n], own[:n]
        b = begin >> 3
        codes = ((raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (begin & 7).astype(np.uint32)) & ((1 << own) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        add, grow = out.append, table.append
        known = len(table)
        for code in codes[:stop].tolist():
            if code < known:
                entry = table[code]
            elif code == known and prev:
                entry = prev + prev[:1]
            else:
                raise GifError(f"code {code} of {known}")
            add(entry)
            if prev and known < _MOST:
                grow(prev + entry[:1])
                known += 1
            prev = entry
        got = sum(map(len, out)) if len(out) < 64 else got + sum(map(len, out[-stop:] if stop else []))
        since += stop
        if stop == n:
            pos = int(ends[n - 1])
        elif codes[stop] == end:
            break
        else:
            pos, table = int(ends[stop]), []
    return b"".join(out)[:most]


def lzw_decode_all(streams: list[bytes], size: int, most: list[int]) -> list[bytes | GifError]:
    """lzw_decode of many streams at once; a faulty stream gives its error.

    Between two clear codes, code i either is a literal or names the entry that code j < i began, which is the string of
    code j and the first sample of code j + 1. So strings are chains of codes, followed for all codes side by side.
    Streams that go on with a full table are left to lzw_decode.
    """
    out: list[list[bytes]] = [[] for _ in streams]
    fault: dict[int, GifError] = {}
    slow: set[int] = set()
    if not 2 <= size <= 8:
        return [_guarded(x, size, m) for x, m in zip(streams, most, strict=True)]
    clear, end = 1 << size, (1 << size) + 1
    longest = _MOST - clear - 2
    widths = _widths(size, longest + 2).astype(np.int64)
    before = np.cumsum(widths) - widths
    raw = np.frombuffer(b"".join(streams) + bytes(4), np.uint8).astype(np.int64)
    lengths = np.array([len(x) for x in streams], np.int64)
    base = np.concatenate(([0], np.cumsum(lengths)[:-1])) * 8 if len(streams) else lengths
    left, pos, got = lengths * 8, np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
    active = np.arange(len(streams))
    want = np.array(most, np.int64)
    while len(active):
        n = np.minimum((left[active] - pos[active]) // (size + 1), longest + 1)
        active, n = active[n > 0], n[n > 0]
        if not len(active):
            break
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        k = np.arange(int(n.sum())) - np.repeat(first, n)
        offset = np.repeat(base[active] + pos[active], n) + before[k]
        byte = np.minimum(offset >> 3, len(raw) - 3)
        code = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (offset & 7) & ((1 << widths[k]) - 1)
        ended = offset + widths[k] > np.repeat(base[active] + left[active], n)
        stops = (code == clear) | (code == end) | ended
        m = np.minimum.reduceat(np.where(stops, k, _MOST), first)
        full = (m == _MOST) & (n > longest)
        slow.update(active[full].tolist())
        m = np.minimum(m, n)
        ok = ~full
        last_code, was_end = code[first + np.minimum(m, n - 1)], ended[first + np.minimum(m, n - 1)]
        use = (k < np.repeat(m, n)) & np.repeat(ok, n)
        c = code[use]
        sizes = np.where(ok, m, 0)
        seg = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        plain = c < clear
        index = np.arange(len(c))
        parent = np.where(plain, index, np.repeat(seg, sizes) + c - clear - 2)
        wrong = np.flatnonzero(~plain & (parent >= index))
        if len(wrong):
            owner = np.repeat(np.arange(len(active)), sizes)
            for w in wrong.tolist():
                fault.setdefault(int(active[owner[w]]), GifError(f"code {c[w]} is unknown"))
            plain = plain.copy()
            plain[wrong], parent[wrong], c[wrong] = True, wrong, 0
        root, depth, todo = index.copy(), np.zeros(len(c), np.int64), np.flatnonzero(~plain)
        while len(todo):
            root[todo] = parent[root[todo]]
            depth[todo] += 1
            todo = todo[~plain[root[todo]]]
        head, stop = c[root], np.cumsum(depth + 1)
        made = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
        at, here, todo = stop - 1, index.copy(), np.flatnonzero(~plain)
        made[at[plain]] = c[plain]
        while len(todo):
            up = parent[here[todo]]
            made[at[todo]] = head[up + 1]
            at[todo] -= 1
            here[todo] = up
            done = plain[up]
            made[at[todo[done]]] = c[up[done]]
            todo = todo[~done]
        bytes_made, marks = made.tobytes(), np.concatenate(([0], stop))
        for a, lo, size_ in zip(active.tolist(), seg.tolist(), sizes.tolist(), strict=True):
            piece = bytes_made[marks[lo] : marks[lo + size_]]
            out[a].append(piece)
            got[a] += len(piece)
        pos[active] += before[m] + widths[m]
        go = ok & (m < n) & ~was_end & (last_code == clear) & (got[active] < want[active])
        go &= ~np.isin(active, list(fault)) if fault else True
        active = active[go]
    return [fault.get(i) or (_guarded(streams[i], size, most[i]) if i in slow else b"".join(x)[: most[i]]) for i, x in enumerate(out)]


def _guarded(stream: bytes, size: int, most: int) -> bytes | GifError:
    try:
        return lzw_decode(stream, size, most)
    except GifError as e:
        return e


def _blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(part := stream[i : i + 255])]) + part for i in range(0, len(stream), 255)) + b"\0"


def _together(things: list, size) -> Iterator[list]:
    """Consecutive things in groups of about AT_ONCE by `size`."""
    group, filled = [], 0
    for x in things:
        group.append(x)
        filled += size(x)
        if filled >= AT_ONCE:
            yield group
            group, filled = [], 0
    if group:
        yield group


def encode_payloads(payloads: list[bytes], width: int = WIDTH, rows: int = ROWS) -> list[bytes]:
    """For each payload a GIF whose grey levels are its bytes, row by row, in frames of at most `rows` rows."""
    if any(not p or len(p) % width for p in payloads) or width % 2:
        raise GifError("payloads must fill whole rows of even width")
    cut = [[p[i : i + width * rows] for i in range(0, len(p), width * rows)] for p in payloads]
    streams = (x for group in _together([f for own in cut for f in own], len) for x in lzw_encode_all(group))
    out = []
    for own in cut:
        parts = [b"GIF89a", struct.pack("<HHBBB", width, len(own[0]) // width, 0xF7, 0, 0), _GREY]
        for part in own:
            parts += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY, 0), b"\0"]
            parts += [b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(next(streams))]
        out.append(b"".join([*parts, b"\x3b"]))
    return out


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int
    rgba: np.ndarray  # the whole canvas while the frame is shown

    def histogram(self) -> np.ndarray:
        """Pixels of each colour bin; transparent pixels are left out."""
        c = self.rgba.reshape(-1, 4)
        bins = (c[:, 0] >> 6) << 4 | (c[:, 1] >> 6) << 2 | c[:, 2] >> 6
        return np.bincount(bins[c[:, 3] > 0], minlength=BINS)

    def grey(self) -> bytes:
        """Red samples of the frame's own rectangle; of a grey picture, its levels."""
        return self.rgba[self.top : self.top + self.height, self.left : self.left + self.width, 0].tobytes()


@dataclass
class Picture:
    """One image of a file before decoding."""

    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    palette: np.ndarray
    literal: int
    stream: bytes
    delay: int
    disposal: int
    transparent: int


def parse(data: bytes) -> tuple[tuple[int, int], list[Picture], str | None]:
    """Canvas size, the pictures of a file, and the fault that ended it, if any."""
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        return (0, 0), [], "not a GIF"
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, shared, out = 13, None, []
    delay, disposal, transparent = 0, 0, -1
    if width * height > MOST_PIXELS:
        return (width, height), [], f"a canvas of {width} x {height}"

    def table(flags: int, at: int) -> tuple[np.ndarray, int]:
        size = 3 * (2 << (flags & 7))
        if at + size > len(data):
            raise GifError("cut short")
        return np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3), at + size

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data):
            n = data[at]
            if not n:
                return b"".join(parts), at + 1
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        raise GifError("cut short")

    try:
        if flags & 0x80:
            shared, at = table(flags, at)
        while at < len(data) and data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1] if at + 1 < len(data) else 0
                body, at = blocks(at + 2)
                if label == 0xF9 and len(body) >= 4:
                    packed, delay, index = struct.unpack("<BHB", body[:4])
                    disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
                continue
            if data[at] != 0x2C or at + 11 > len(data):
                raise GifError(f"unknown block {data[at]}")
            left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            if left + w > width or top + h > height:
                raise GifError("a picture beyond the canvas")
            palette = shared
            if flags & 0x80:
                palette, at = table(flags, at)
            if palette is None:
                raise GifError("no palette")
            if at >= len(data):
                raise GifError("cut short")
            stream, after = blocks(at + 1)
            out.append(Picture(left, top, w, h, bool(flags & 0x40), palette, data[at], stream, delay, disposal, transparent))
            at, delay, disposal, transparent = after, 0, 0, -1
    except GifError as e:
        return (width, height), out, str(e)
    return (width, height), out, None


def compose(size: tuple[int, int], pictures: list[Picture], samples: list[bytes]):
    """Frames in order, each drawn on the canvas by its palette and transparency after the disposal of those before it."""
    canvas, clock = np.zeros((size[1], size[0], 4), np.uint8), 0
    for p, own in zip(pictures, samples, strict=True):
        pixels = np.frombuffer(own, np.uint8).reshape(p.height, p.width)
        if p.interlaced:
            order = np.concatenate([np.arange(s, p.height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(pixels)
            plain[order] = pixels
            pixels = plain
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(p.palette), :3] = p.palette
        colours[:, 3] = 255
        before = canvas.copy() if p.disposal == 3 else None
        shown = canvas[p.top : p.top + p.height, p.left : p.left + p.width]
        new = colours.view(np.uint32).ravel()[pixels].view(np.uint8).reshape(*pixels.shape, 4)
        if p.transparent >= 0:
            kept = pixels == p.transparent
            new[kept] = shown[kept]
        shown[...] = new
        yield Frame(clock, p.delay * 10, p.left, p.top, p.width, p.height, p.disposal, p.transparent, canvas)
        if p.disposal == 2:
            shown[...] = 0
        elif before is not None:
            canvas = before
        clock += p.delay * 10


def decoded(files: list[bytes]):
    """For each file its canvas size, its frames (an iterator) and its first fault; all code streams are decoded together."""
    parsed = [parse(x) for x in files]
    samples: dict[tuple[int, int], bytes | GifError] = {}
    by_size: dict[int, list[tuple[int, int]]] = {}
    for i, (_, pictures, _) in enumerate(parsed):
        for k, p in enumerate(pictures):
            by_size.setdefault(p.literal, []).append((i, k))
    for literal, places in by_size.items():
        for group in _together(places, lambda x: parsed[x[0]][1][x[1]].width * parsed[x[0]][1][x[1]].height):
            own = [parsed[i][1][k] for i, k in group]
            most = [p.width * p.height for p in own]
            made = lzw_decode_all([p.stream for p in own], literal, most)
            samples.update((at, x if isinstance(x, GifError) or len(x) == n else GifError("a picture cut short")) for at, x, n in zip(group, made, most, strict=True))
    for i, (size, pictures, fault) in enumerate(parsed):
        got = [samples[i, k] for k in range(len(pictures))]
        bad = next((k for k, x in enumerate(got) if isinstance(x, GifError)), len(got))
        yield size, compose(size, pictures[:bad], got[:bad]), str(got[bad]) if bad < len(got) else fault


def store_payloads(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Column `media`: each whole text in UTF-8, filled with zero bytes to a positive multiple of 64, as a GIF. Null: empty."""

    def make():
        def step(texts, _):
            return {"media": encode_payloads([(t or b"").ljust(max(WIDTH, -(-len(t or b"") // WIDTH) * WIDTH), b"\0") for t in texts])}

        return step

    return map_texts(docs, text, "media binary", make, keep or ["doc_id"])


_SUMMARY = (
    "samples binary, width int, height int, duration_ms bigint, error string, "
    "frames array<struct<index:int,start_ms:int,delay_ms:int,left:int,top:int,width:int,height:int,disposal:int,transparent:int,histogram:array<int>>>"
)


_FIELDS = ("start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "transparent")


def read_gifs(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Decodes a binary GIF column: timed frames with colour histograms, and `samples`, the frames' red samples one after another.

    Media that are null or broken give null samples, the frames before the fault, and the fault in `error`: pictures with
    too few samples or beyond the canvas, and canvases of over MOST_PIXELS, are faults.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from courtline.llm.batches import schema_of, slices

    out = schema_of(_SUMMARY)
    taken = {f.name.lower() for f in out.fields}
    kept = [c for c in (keep or [c for c in df.columns if c != media]) if c.lower() not in taken]
    schema = StructType([df.schema[c] for c in kept] + out.fields)
    arrow = to_arrow_schema(schema)

    def rows_of(files: list[bytes | None]) -> list[dict]:
        rows = []
        for data, (size, shown, fault) in zip(files, decoded([x or b"" for x in files]), strict=True):
            row = {"samples": None, "width": None, "height": None, "duration_ms": 0, "error": "null" if data is None else fault, "frames": []}
            parts = []
            for k, f in enumerate(shown):
                parts.append(f.grey())
                row["frames"].append({"index": k, **{x: getattr(f, x) for x in _FIELDS}, "histogram": f.histogram()})
                row["duration_ms"] = f.start_ms + f.delay_ms
            if row["error"] is None:
                row |= {"samples": b"".join(parts), "width": size[0], "height": size[1]}
            rows.append(row)
        return rows

    def run(batches):
        kept_for(__name__)
        for batch in batches:
            for part in slices(batch, "__media"):
                rows = rows_of(part.column("__media").to_pylist())
                made = [pa.array([r[f.name] for r in rows], type=arrow.field(f.name).type) for f in out.fields]
                yield pa.RecordBatch.from_arrays([part.column(c).cast(arrow.field(c).type) for c in kept] + made, schema=arrow)

    columns = [F.col(f"`{c}`") for c in kept]
    return df.select(*columns, F.col(f"`{media}`").alias("__media")).mapInArrow(run, schema)
