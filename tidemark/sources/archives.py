"""Archives of documents: a prelude that names the namespaces, then their blocks in turn, each namespace with a checksum.

An archive is read in order and in constant memory, so one archive is one task; many archives are read side by side.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The archive's first four bytes, the length that ends a block, and the reflected CRC-64 polynomial.
MAGIC = b"\x6d\xe2\x99\x81"
TERMINATOR = b"\xff\xff\xff\xff"
CRC64 = 0xC96C5795D7870F42

LONGEST = 64 << 20
LANES = 256


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        table = np.where(table & np.uint64(1), (table >> np.uint64(1)) ^ np.uint64(CRC64), table >> np.uint64(1))
    return table


_TABLE = _crc_table()


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
        if not vector:
            break
    return out


def _zeros(size: int) -> list[int]:
    """The linear map that `size` zero bytes apply to a checksum, by repeated squaring of that of one bit."""
    step = [CRC64, *[1 << k for k in range(63)]]
    out = [1 << k for k in range(64)]
    bits = 8 * size
    while bits:
        if bits & 1:
            out = [_times(step, row) for row in out]
        step = [_times(step, row) for row in step]
        bits >>= 1
    return out


def crc64(data: bytes, crc: int = 0) -> int:
    """The checksum of data that continue those of `crc`. Long data are cut into lanes that are summed up side by side;
    the sums are then joined, as the checksum is linear."""
    state = crc ^ 0xFFFFFFFFFFFFFFFF
    if len(data) < 16 * LANES:
        table = _TABLE.tolist()
        for b in data:
            state = table[(state ^ b) & 0xFF] ^ (state >> 8)
        return state ^ 0xFFFFFFFFFFFFFFFF
    width = -(-len(data) // LANES)
    lanes = np.frombuffer(data.rjust(width * LANES, b"\0"), np.uint8).reshape(LANES, width)  # leading zeros add nothing
    sums = np.zeros(LANES, np.uint64)
    for column in lanes.T:
        sums = _TABLE[((sums ^ column) & np.uint64(0xFF)).astype(np.intp)] ^ (sums >> np.uint64(8))
    shift = _zeros(width)
    total = 0
    for s in sums.tolist():
        total = _times(shift, total) ^ s
    return _times(_zeros(len(data)), state) ^ total ^ 0xFFFFFFFFFFFFFFFF


_SIZES = {0x01: 8, 0x07: 12, 0x08: 1, 0x09: 8, 0x0A: 0, 0x10: 4, 0x11: 8, 0x12: 8, 0x13: 16, 0x06: 0, 0xFF: 0, 0x7F: 0}


def document_fields(doc: bytes) -> dict[str, object]:
    """Texts, truths and whole numbers at the top of a document; other values are passed over as None."""
    found: dict[str, object] = {}
    at = 4
    while at < len(doc) - 1:
        kind = doc[at]
        end = doc.index(0, at + 1)
        name = doc[at + 1 : end].decode("utf-8", "replace")
        at = end + 1
        value: object = None
        if kind in (0x02, 0x0D, 0x0E):
            (size,) = struct.unpack_from("<i", doc, at)
            value = doc[at + 4 : at + 3 + size].decode("utf-8", "replace") if kind == 0x02 else None
            at += 4 + size
        elif kind in (0x03, 0x04, 0x0F):
            at += struct.unpack_from("<i", doc, at)[0]
        elif kind == 0x05:
            at += 5 + struct.unpack_from("<i", doc, at)[0]
        elif kind == 0x0B:
            at = doc.index(0, doc.index(0, at) + 1) + 1
        elif kind == 0x0C:
            at += 16 + struct.unpack_from("<i", doc, at)[0]
        elif kind in _SIZES:
            value = {0x08: lambda: bool(doc[at]), 0x10: lambda: struct.unpack_from("<i", doc, at)[0], 0x12: lambda: struct.unpack_from("<q", doc, at)[0]}.get(kind, lambda: None)()
            at += _SIZES[kind]
        else:
            raise ValueError(f"a field of unknown type {kind}")
        found[name] = value
    return found


def read_archive(read: Callable[[int], bytes]) -> Iterator[tuple[str, bool, int, int, bool, bool | None]]:
    """(namespace, view, documents, bytes, ended, sound) of every namespace of the prelude or the body; sound is whether
    the checksum holds, None where the archive gives none. What is cut or damaged is an error."""
    if read(4) != MAGIC:
        raise ValueError("not an archive of documents")

    def following(where: str) -> bytes | None:
        head = read(4)
        if head == TERMINATOR:
            return None
        if len(head) < 4:
            raise EOFError(f"the archive ends within {where}") if not head else ValueError(f"the archive ends within {where}")
        (size,) = struct.unpack("<i", head)
        if size < 5 or size > LONGEST:
            raise ValueError(f"a document of {size} bytes")
        body = read(size - 4)
        if len(body) < size - 4:
            raise ValueError("the archive ends inside a document")
        return head + body

    named = lambda f: f"{f.get('db') or ''}.{f.get('collection') or ''}"
    stats: dict[str, list] = {}  # view, documents, bytes, ended, sound, checksum so far
    try:
        if following("its header") is None:
            raise ValueError("the archive has no header")
        while (doc := following("its prelude")) is not None:
            f = document_fields(doc)
            stats[named(f)] = [f.get("type") == "view" or '"viewOn"' in str(f.get("metadata") or ""), 0, 0, False, None, None]
    except EOFError as e:
        raise ValueError(str(e)) from None
    while True:
        try:
            head = following("its body")
        except EOFError:
            break
        if head is None:
            continue
        f = document_fields(head)
        own = stats.setdefault(named(f), [False, 0, 0, False, None, None])
        if f.get("EOF"):
            own[3] = True
            if own[5] is not None:
                own[4] = (own[5] - (f.get("CRC") or 0)) % (1 << 64) == 0
            continue
        own[5] = own[5] or 0
        try:
            while (doc := following(named(f))) is not None:
                own[1] += 1
                own[2] += len(doc)
                own[5] = crc64(doc, own[5])
        except EOFError as e:
            raise ValueError(str(e)) from None
    for name, (view, documents, size, ended, sound, _) in stats.items():
        yield name, view, documents, size, ended, sound


def _element(name: str, value: object) -> bytes:
    key = name.encode() + b"\0"
    if isinstance(value, bool):
        return b"\x08" + key + bytes([value])
    if isinstance(value, int):
        return b"\x12" + key + struct.pack("<q", value)
    text = str(value).encode()
    return b"\x02" + key + struct.pack("<i", len(text) + 1) + text + b"\0"


def document(**fields: object) -> bytes:
    """A document of texts, truths and whole numbers."""
    body = b"".join(_element(k, v) for k, v in fields.items()) + b"\0"
    return struct.pack("<i", len(body) + 4) + body


def write_archive(collections: dict[str, list[bytes]], database: str, views: tuple[str, ...] = (), cut: tuple[str, ...] = (), block: int = 3) -> bytes:
    """An archive of collections whose blocks take turns; those in `cut` have no end."""
    out = [MAGIC, document(version="0.1", server_version="7.0", tool_version="1"), *[document(db=database, collection=c, metadata="{}") for c in collections], *[document(db=database, collection=v, type="view", metadata='{"viewOn":""}') for v in views], TERMINATOR]
    longest = max((len(d) for d in collections.values()), default=0)
    for start in range(0, longest, block):
        for name, docs in collections.items():
            if docs[start : start + block]:
                out += [document(db=database, collection=name, EOF=False, CRC=0), *docs[start : start + block], TERMINATOR]
    for name, docs in [*collections.items(), *[(v, []) for v in views]]:
        if name in cut:
            continue
        crc = crc64(b"".join(docs)) if docs else 0
        out += [document(db=database, collection=name, EOF=True, CRC=crc - (1 << 64) if crc >> 63 else crc), TERMINATOR]
    return b"".join(out)


def _namespaces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    for batch in batches:
        rows: list[tuple] = []
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            try:
                stream = io.BytesIO(content.as_py() or b"")
                rows += [(path.as_py(), *r, None) for r in read_archive(stream.read)]
            except (ValueError, struct.error) as e:
                rows.append((path.as_py(), None, None, None, None, None, None, str(e)))
        if rows:
            names = ["path", "namespace", "view", "documents", "bytes", "ended", "sound", "problem"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archive_namespaces(archives: DataFrame) -> DataFrame:
    """path, namespace, view, documents, bytes, ended, sound, problem of archives given as (path, content).

    A namespace whose end is missing was cut; sound is null where nothing was to be checked. A damaged archive, an empty
    or a null one gives one row with its problem.
    """
    return archives.select("path", "content").mapInArrow(_namespaces, "path string, namespace string, view boolean, documents bigint, bytes bigint, ended boolean, sound boolean, problem string")
