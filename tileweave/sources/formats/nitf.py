"""NITF 2.1 and NSIF 1.0: header, segments, uncompressed images (plain or masked), text, data.

Headers and subheaders are structures of fixed-width text fields; their definitions are
YAML files read by the structure engine, so the offset of each field follows from the
values before it.
"""

from __future__ import annotations

from importlib import resources

import numpy as np

from ...operators.blocks import ABSENT
from ...operators.segments import TAGGED_LIMIT
from ...operators.validate import COMPLEXITY
from ...structure.codec import parsed_records, read, record, records, split_by_size, write
from ...structure.layout import Layout, Registry, load
from ...structure.tagged import TAGGED
from . import Asset, FormatError, padded, plugin, plugin_encode, registered

MAGIC = (b"NITF02.10", b"NSIF01.00")

_DEFINITIONS = resources.files(__package__) / "definitions"  # also where the package is shipped as an archive
FILE, IMAGE, GRAPHIC, TEXT, DATA = (load((_DEFINITIONS / f"nitf_{name}.yaml").read_text()) for name in ("file", "image", "graphic", "text", "data"))
BUILTIN = {**TAGGED, "nitf_file": FILE, "nitf_image": IMAGE, "nitf_graphic": GRAPHIC, "nitf_text": TEXT, "nitf_data": DATA}
_KINDS = (("NUMI", "LISH", "LI", "image"), ("NUMS", "LSSH", "LS", "graphic"), ("NUMT", "LTSH", "LT", "text"), ("NUMDES", "LDSH", "LD", "des"), ("NUMRES", "LRESH", "LRE", "res"))
#: Sample types by kind: the first whose bits hold a sample's.
_DTYPES = {"INT": ((8, "uint8"), (16, "uint16"), (32, "uint32"), (64, "uint64")), "SI": ((8, "int8"), (16, "int16"), (32, "int32"), (64, "int64")), "R": ((32, "float32"), (64, "float64")), "C": ((64, "complex64"),), "B": ((1, "uint8"),)}


def segments(data: bytes, file_size: int | None = None) -> tuple[dict, list[dict]]:
    """The file header, and kind, index, and places of subheader and data of each segment."""
    if bytes(data[:9]) not in MAGIC:
        raise FormatError("no NITF 2.1 or NSIF 1.0 header")
    header, _ = read(FILE, data)
    out, unknown = [], []
    for count, sub, body, kind in _KINDS:
        for i, item in enumerate(header[f"{count}_LENGTHS"]):
            if item[sub].strip("9") == "" and item[sub]:
                raise FormatError("a subheader of unknown length")
            out.append({"kind": kind, "index": i, "sub_len": int(item[sub]), "len": int(item[body])})
            if item[body].strip("9") == "":
                unknown.append(out[-1])
    if len(unknown) > 1:
        raise FormatError("several segments of unknown length")
    start = int(header["HL"])
    if unknown:
        unknown[0]["len"] = (file_size or len(data)) - start - sum(s["sub_len"] + s["len"] for s in out if s is not unknown[0]) - unknown[0]["sub_len"]
    for s in out:
        s["sub_off"], s["off"] = start, start + s["sub_len"]
        start = s["off"] + s["len"]
    return header, out


def assets(data: bytes, registry: Registry | None = None) -> list[Asset]:
    registry = registry or Registry(BUILTIN)
    _, found = segments(data)
    extensions = [s for s in found if s["kind"] == "des"]
    out = []
    for s in found:
        sub = bytes(data[s["sub_off"] : s["sub_off"] + s["sub_len"]])
        if s["kind"] != "image":
            layout = {"graphic": GRAPHIC, "text": TEXT, "des": DATA}.get(s["kind"])
            meta = read(layout, sub)[0] if layout else {}
            out.append(Asset(f"{s['kind']}:{s['index']}", {"text": "text", "graphic": "graphics"}.get(s["kind"], "data"), offset=s["off"], length=s["len"], metadata={k: v.strip() for k, v in meta.items() if isinstance(v, str)}))
            continue
        values, _ = read(IMAGE, sub)
        number = lambda k, v=values: int(v[k].strip() or 0)
        bands = number("NBANDS") or number("XBANDS")
        rows, cols = number("NROWS"), number("NCOLS")
        bh, bw = number("NPPBV") or rows, number("NPPBH") or cols
        bits, kind = number("NBPP"), values["PVTYPE"].strip()
        dtype = next((name for most, name in _DTYPES.get(kind, ()) if bits <= most), "")
        meta = {k: v.strip() for k, v in values.items() if isinstance(v, str)}
        for field in ("UDID", "IXSHD"):
            if values.get(field):
                meta.update(parsed_records(values[field], registry))
        for field, index in ((f, int(values[f] or 0)) for f in ("UDOFL", "IXSOFL") if values.get(f)):
            if index:
                if index > len(extensions):
                    raise FormatError(f"{field} names data segment {index} of {len(extensions)}")
                more = extensions[index - 1]
                meta.update(parsed_records(bytes(data[more["off"] : more["off"] + more["len"]]), registry))
        out.append(Asset(
            f"image:{s['index']}", rows=rows, cols=cols, bands=bands, bh=bh, bw=bw, dtype=dtype, bits=bits, offset=s["off"], length=s["len"], metadata=meta,
            private={"tables": [t["LUTD"] for b in values.get("BAND") or () for t in b.get("LUTS") or ()], "mode": values["IMODE"], "ic": values["IC"].strip(), "actual": number("ABPP") or bits, "left": values["PJUST"] == "L", "grid": (number("NBPC"), number("NBPR")), "mask": mask_table(data, s["off"], values["IC"].strip(), values["IMODE"], number("NBPR") * number("NBPC"), bands)},
        ))
    return out


def mask_table(data: bytes, at: int, ic: str, mode: str, blocks: int, bands: int) -> dict | None:
    """start of the pixel data, offsets by record (block, or band plane and block in mode S) and the pad value; none for plain images."""
    if not (ic == "NM" or ic.startswith("M")):
        return None
    start, size, pad_size, pad_bits = (int.from_bytes(data[at + a : at + b], "big") for a, b in ((0, 4), (4, 6), (6, 8), (8, 10)))
    here = at + 10
    pad = int.from_bytes(data[here : here + -(-pad_bits // 8)], "big") if pad_bits else 0
    here += -(-pad_bits // 8)
    records = blocks * (bands if mode == "S" else 1)
    offsets = np.frombuffer(data[here : here + 4 * records], ">u4").tolist() if size else None
    del pad_size
    return {"start": start, "offsets": offsets, "pad": pad}


def place(asset: Asset, br: int, bc: int, band: int = 0) -> int | None:
    """Byte offset of a block (in mode S of one band's), none if it isn't recorded."""
    gr, gc = asset.grid
    mode, mask = asset.private["mode"], asset.private["mask"]
    n = br * gc + bc
    size = -(-asset.bh * asset.bw * asset.bits * (1 if mode == "S" else asset.bands) // 8)
    if mask and mask["offsets"] is not None:
        offset = mask["offsets"][band * gr * gc + n if mode == "S" else n]
        return None if offset == ABSENT else asset.offset + mask["start"] + offset
    return asset.offset + (mask["start"] if mask else 0) + ((band * gr * gc if mode == "S" else 0) + n) * size


def coded_range(asset: Asset, br: int, bc: int) -> tuple[int, int]:
    """First byte and length of a coded block that a mask table places: up to the next one's first byte."""
    at = place(asset, br, bc)
    if at is None:
        raise FormatError(f"block {br}, {bc} isn't recorded")
    base = asset.offset + asset.private["mask"]["start"]
    later = [base + o for o in asset.private["mask"]["offsets"] if o != ABSENT and base + o > at]
    return at, min(later, default=asset.offset + asset.length) - at


def jpeg_block(data: bytes, asset: Asset, br: int, bc: int) -> np.ndarray:
    """A block of baseline JPEG: its place from the mask table, or by its number among the images that follow each other."""
    from .jpeg import decode, streams

    masked = asset.private["mask"]
    if masked and masked["offsets"] is not None:
        at, size = coded_range(asset, br, bc)
    else:
        start = asset.offset + (masked["start"] if masked else 0)
        found = asset.private.setdefault("streams", streams(data, start, asset.offset + asset.length))
        at, size = found[br * asset.grid[1] + bc]
    return decode(bytes(data[at : at + size]))


def unpack(raw: bytes, bits: int, count: int, dtype: str) -> np.ndarray:
    """Samples of ``bits`` bits, most significant first; the first bit of a signed one is its sign."""
    ones = np.unpackbits(np.frombuffer(raw, np.uint8))[: bits * count].reshape(count, bits)
    value = ones.astype(np.uint64) @ (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))
    if np.dtype(dtype).kind == "i" and bits < 64:
        return np.where(ones[:, 0] == 1, value.astype(np.int64) - (1 << bits), value.astype(np.int64)).astype(dtype)
    return value.astype(dtype)


def pack(samples: np.ndarray, bits: int) -> bytes:
    ones = (samples.astype(np.uint64).ravel()[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(ones.astype(np.uint8).ravel()).tobytes()


def decode_samples(raw: bytes, asset: Asset, bands: int) -> np.ndarray:
    """One recorded block as (bands, rows, cols) of nominal size."""
    n = asset.bh * asset.bw * bands
    if not asset.dtype:
        raise FormatError(f"no type for {asset.bits} bits of {asset.metadata.get('PVTYPE')}")
    if asset.bits != np.dtype(asset.dtype).itemsize * 8:
        flat = unpack(raw, asset.bits, n, asset.dtype)
    else:
        flat = np.frombuffer(raw, np.dtype(asset.dtype).newbyteorder(">"), n).astype(asset.dtype)
    mode = asset.private["mode"]
    if mode == "P":
        return flat.reshape(asset.bh, asset.bw, bands).transpose(2, 0, 1)
    if mode == "R":
        return flat.reshape(asset.bh, bands, asset.bw).transpose(1, 0, 2)
    return flat.reshape(bands, asset.bh, asset.bw)


def block(data: bytes, asset: Asset, br: int, bc: int) -> np.ndarray:
    """A block clipped to the image; blocks that aren't recorded hold the pad value."""
    h, w = asset.extent(br, bc)
    if asset.private["ic"] not in ("NC", "NM"):
        # Masked forms (M3 ...) have the decoder of the plain ones (C3 ...); see ``coded_range`` for a block's bytes.
        name = f"nitf:C{asset.private['ic'][-1]}"
        if asset.private["ic"] in ("C3", "M3", "I1") and not registered(name):
            return jpeg_block(data, asset, br, bc)[:, :h, :w]
        return plugin(name)(data, asset, br, bc)[:, :h, :w]
    sequential = asset.private["mode"] == "S"
    parts = []
    for band in range(asset.bands if sequential else 1):
        at, bands = place(asset, br, bc, band), 1 if sequential else asset.bands
        if at is None:
            parts.append(np.full((bands, asset.bh, asset.bw), asset.private["mask"]["pad"], asset.dtype))
        else:
            parts.append(decode_samples(data[at : at + -(-asset.bh * asset.bw * asset.bits * bands // 8)], asset, bands))
    return np.ascontiguousarray(np.concatenate(parts)[:, :h, :w])


def aligned(samples: np.ndarray, asset: Asset) -> np.ndarray:
    """Unsigned samples of which fewer bits count than are stored: the low ones, or the high ones if they are justified to the left."""
    if asset.private["actual"] >= asset.bits or samples.dtype.kind != "u":
        return samples
    shift, mask = asset.bits - asset.private["actual"], (1 << asset.private["actual"]) - 1
    return samples >> samples.dtype.type(shift) if asset.private["left"] else samples & samples.dtype.type(mask)


def has_block(asset: Asset, br: int, bc: int) -> bool:
    return 0 <= br < asset.grid[0] and 0 <= bc < asset.grid[1] and place(asset, br, bc) is not None


def ranges(asset: Asset) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Byte ranges of the recorded blocks; in mode S one for each band."""
    sequential = asset.private["mode"] == "S"
    size = -(-asset.bh * asset.bw * asset.bits * (1 if sequential else asset.bands) // 8)
    if asset.private["ic"] not in ("NC", "NM"):
        if not asset.private["mask"] or asset.private["mask"]["offsets"] is None:
            return {(0, 0): [(asset.offset, asset.length)]}
        return {(r, c): [coded_range(asset, r, c)] for r in range(asset.grid[0]) for c in range(asset.grid[1]) if has_block(asset, r, c)}
    out = {}
    for br in range(asset.grid[0]):
        for bc in range(asset.grid[1]):
            at = [place(asset, br, bc, band) for band in range(asset.bands if sequential else 1)]
            if None not in at:
                out[br, bc] = [(a, size) for a in at]
    return out


def _blank(layout: Layout, given: dict) -> dict:
    """Blank or zero values for the fields that aren't given."""
    out = {f.id: ("0" if f.pad == "0" else "") if f.type == "str" else b"\0" * int(f.size) for f in layout.fields if f.size and str(f.size).isdigit() and not f.condition and not f.repeat}
    return {**out, **{k: v for k, v in given.items() if any(f.id == k for f in layout.fields)}}


def expected_length(data) -> tuple[int, int]:
    """The length that a file's header states, and where its last segment ends."""
    header, found = segments(data)
    return int(header["FL"]), max([int(header["HL"]), *(s["off"] + s["len"] for s in found)])


def complexity(shapes: list[tuple[int, int, int]]) -> int:
    """The least complexity level whose dimensions hold images (bands, rows, cols)."""
    most = max((max(rows, cols) for _, rows, cols in shapes), default=1)
    return next(level for level, limit in sorted(COMPLEXITY.items()) if most <= limit)


def checked_data(meta: dict) -> dict:
    """Subheader values of a data segment; its id takes 1 to 25 characters and its version exactly two."""
    name, version = str(meta.get("DESID", "DATA")), meta.get("DESVER", "01")
    version = f"{version:02d}" if isinstance(version, int) else str(version)
    if not 1 <= len(name) <= 25:
        raise FormatError("a data segment's id takes 1 to 25 characters")
    if len(version) != 2:
        raise FormatError("a data segment's version takes two characters")
    return {**meta, "DESID": name, "DESVER": version}


def encode(images: list[tuple[np.ndarray, dict]], texts: list[tuple[str, dict]] = (), data: list[tuple[bytes, dict]] = (), block_size: tuple[int, int] = (256, 256), mode: str = "B", present=None, compression: str | None = None, magic: bytes = MAGIC[0], header: dict | None = None, graphics: list[tuple[bytes, dict]] = ()) -> bytes:
    """A file of images (array, metadata), graphics, texts and data segments.

    An image's metadata may state NBPP, ABPP and PJUST, one-band look-up tables (``LUTS``, bytes each), tagged ``records`` and
    fields of its subheader.

    ``present`` (image index, block row, block column) says which blocks are recorded;
    with it images are masked (NM).  ``compression`` (C3, C8 ...) has every block coded by the hook
    of that name, and a mask table tells where each begins.
    """
    heads, bodies = [], []
    for k, (image, meta) in enumerate(images):
        bands, rows, cols = image.shape
        bh, bw = min(block_size[0], rows, 8192), min(block_size[1], cols, 8192)
        gr, gc = -(-rows // bh), -(-cols // bw)
        bits = int(meta.get("NBPP", image.dtype.itemsize * 8))
        recorded: list[bytes] = []
        mask = np.full(gr * gc * (bands if mode == "S" else 1), ABSENT, ">u4")
        size = 0
        for band in range(bands if mode == "S" else 1):
            for n in range(gr * gc):
                r, c = divmod(n, gc)
                if present is not None and not present(k, r, c):
                    continue
                part = image[band : band + 1] if mode == "S" else image
                px = padded(part[:, r * bh : (r + 1) * bh, c * bw : (c + 1) * bw], bh, bw)
                px = px.transpose(1, 2, 0) if mode == "P" else px.transpose(1, 0, 2) if mode == "R" else px
                if compression == "C3" and not registered("nitf:C3"):
                    from .jpeg import encode as encode_jpeg

                    raw = encode_jpeg(px, meta)
                elif compression:
                    raw = plugin_encode(f"nitf:{compression}")(px, meta)
                elif bits == image.dtype.itemsize * 8:
                    raw = np.ascontiguousarray(px).astype(image.dtype.newbyteorder(">")).tobytes()
                else:
                    raw = pack(px, bits)
                mask[band * gr * gc + n if mode == "S" else n] = size
                recorded.append(raw)
                size += len(raw)
        body = b"".join(recorded)
        coded = f"M{compression[-1]}" if compression else "NC" if present is None else "NM"
        if coded != "NC":
            table = (10 + mask.nbytes).to_bytes(4, "big") + (4).to_bytes(2, "big") + bytes(4) + mask.tobytes()
            body = table + body
        tables = meta.get("LUTS", ())
        if tables and (bands != 1 or len(tables) > 4 or len({len(t) for t in tables}) > 1):
            raise FormatError("one band takes up to four tables of one length")
        kind = {"u": "INT", "i": "SI", "f": "R", "c": "C"}[image.dtype.kind] if bits > 1 else "B"
        values = _blank(IMAGE, {
            "IM": "IM", "IID1": f"IMAGE{k}", "ISCLAS": "U", **meta, "NROWS": rows, "NCOLS": cols, "PVTYPE": kind, "IREP": meta.get("IREP", "RGB/LUT" if len(tables) == 3 else "RGB" if bands == 3 else "MONO" if bands == 1 else "MULTI"), "ICAT": meta.get("ICAT", "VIS"),
            "ABPP": meta.get("ABPP", bits), "PJUST": meta.get("PJUST", "R"), "ICORDS": meta.get("ICORDS", " "), "NICOM": 0, "IC": coded, **({"COMRAT": meta.get("COMRAT", "")} if compression else {}), "NBANDS": bands if bands < 10 else 0, "ISYNC": 0, "IMODE": mode,
            "NBPR": gc, "NBPC": gr, "NPPBH": bw, "NPPBV": bh, "NBPP": bits, "IDLVL": k + 1, "IALVL": 0, "ILOC": "0000000000", "IMAG": "1.0 ",
        })
        one = [{"IREPBAND": "RGB"[i] if bands == 3 else "M" if bands == 1 else "", "ISUBCAT": "", "IFC": "N", "IMFLT": "", "NLUTS": 0} for i in range(bands)]
        if tables:
            one[0] |= {"IREPBAND": "LU" if len(tables) == 3 else "M", "NLUTS": len(tables), "NELUT": len(tables[0]), "LUTS": [{"LUTD": bytes(t)} for t in tables]}
        values["BAND" if bands < 10 else "XBAND"] = one
        if bands >= 10:
            values["XBANDS"] = bands
        if "IGEOLO" in meta:
            values["IGEOLO"] = meta["IGEOLO"]
        fits, over = split_by_size(records(meta.get("records", b"")), TAGGED_LIMIT)
        tagged = b"".join(record(*r) for r in fits)
        if over:  # what the subheader can't hold goes into a data segment behind the given ones
            data = [*data, (b"".join(record(*r) for r in over), {"DESID": "TRE_OVERFLOW", "DESOFLW": "IXSHD", "DESITEM": k + 1})]
        values |= {"UDIDL": 0, "IXSHDL": len(tagged) + 3 if tagged else 0} | ({"IXSOFL": len(data) if over else 0, "IXSHD": tagged} if tagged else {})
        heads.append(("NUMI", write(IMAGE, values)))
        bodies.append(body)
    for body, meta in graphics:
        heads.append(("NUMS", write(GRAPHIC, _blank(GRAPHIC, {"SY": "SY", "SSCLAS": "U", "SFMT": "C", "SCOLOR": "C", **meta, "SXSHDL": 0}))))
        bodies.append(body)
    for text, meta in texts:
        heads.append(("NUMT", write(TEXT, _blank(TEXT, {"TE": "TE", "TSCLAS": "U", "TXTFMT": "U8S", **meta, "TXSHDL": 0}))))
        bodies.append(text.replace("\r\n", "\n").replace("\n", "\r\n").encode())
    for body, meta in data:
        heads.append(("NUMDES", write(DATA, _blank(DATA, {"DE": "DE", "DSCLAS": "U", **checked_data(meta), "DESSHL": 0}))))
        bodies.append(body)
    values = _blank(FILE, {"FHDR": magic[:4].decode(), "FVER": magic[4:].decode(), "CLEVEL": complexity([i.shape for i, _ in images]), "STYPE": "BF01", "FSCLAS": "U", **(header or {})})
    names = {c: (sub, body) for c, sub, body, _ in _KINDS}
    for count, (sub, body) in names.items():
        mine = [(h, b) for (c, h), b in zip(heads, bodies) if c == count]
        values[count] = len(mine)
        values[f"{count}_LENGTHS"] = [{sub: len(h), body: len(b)} for h, b in mine]
    values |= {"NUMX": 0, "UDHDL": 0, "XHDL": 0}
    length = len(write(FILE, values))
    values |= {"HL": length, "FL": length + sum(len(h) + len(b) for (_, h), b in zip(heads, bodies))}
    return write(FILE, values) + b"".join(h + b for (_, h), b in zip(heads, bodies))
