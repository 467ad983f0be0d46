"""File formats of neurons, landmarks, volumes, surfaces and registrations, over bytes."""

from __future__ import annotations

import bz2
import gzip
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np


class FormatError(ValueError):
    """A file that is not what its format says."""


def number(x: float) -> str:
    return "NA" if x is None or x != x else repr(float(x)) if float(x) != int(x) else str(int(x))


def lines_of(rows: list[list]) -> str:
    return "".join(" ".join(map(number, row)) + "\n" for row in rows)


# -------------------------------------------------------------- brace documents
def parse_braces(text: str) -> dict:
    """Nested ``key value, ..`` and ``key { .. }`` as a dictionary; numbers and quotes are read."""
    tokens = re.findall(r'"(?:[^"\\]|\\.)*"|[{},]|\n|[^\s{},"]+', re.sub(r"(?m)^\s*#.*$", "", text))
    at = 0

    def value(words: list[str]):
        plain = [w[1:-1] if w[0] == '"' else w for w in words]
        try:
            numbers = [float(w) for w in plain]
        except ValueError:
            return " ".join(plain)
        return numbers if len(numbers) != 1 else numbers[0]

    def block() -> dict:
        nonlocal at
        out: dict = {}
        words: list[str] = []

        def close():
            if words:
                key = words[0].strip('"')
                out[key] = value(words[1:]) if len(words) > 1 else True
                words.clear()

        while at < len(tokens):
            token = tokens[at]
            at += 1
            if token == "{":
                key = words.pop().strip('"') if words else ""
                close()
                out[key] = block()
            elif token == "}":
                close()
                return out
            elif token in (",", "\n"):
                # a brace may follow on the next line
                if token == "\n" and words and next((t for t in tokens[at:] if t != "\n"), "") == "{":
                    continue
                close()
            else:
                words.append(token)
        close()
        return out

    return block()


def write_braces(document: dict, depth: int = 0) -> str:
    out = ""
    for key, value in document.items():
        tab = "\t" * depth
        if isinstance(value, dict):
            out += f"{tab}{key} {{\n{write_braces(value, depth + 1)}{tab}}}\n"
        elif isinstance(value, str):
            out += f'{tab}{key} "{value}"\n'
        else:
            out += f"{tab}{key} {' '.join(map(number, value if isinstance(value, (list, tuple)) else [value]))}\n"
    return out


# ----------------------------------------------------------------- typed streams
def read_typed_stream(data: bytes) -> dict:
    text = data.decode("latin-1")
    if not text.startswith("! TYPEDSTREAM"):
        raise FormatError("not a typed stream")
    head, _, body = text.partition("\n")
    return {"version": head.split()[-1], **parse_braces(body)}


def write_typed_stream(document: dict, version: str = "2.4") -> bytes:
    return (f"! TYPEDSTREAM {version}\n\n" + write_braces({k: v for k, v in document.items() if k != "version"})).encode()


def flat(document: dict, path: str = "") -> list[tuple[str, list[float] | None, str | None]]:
    """Leaves of a document: path, numbers or text."""
    out = []
    for key, value in document.items():
        at = f"{path}/{key}" if path else key
        if isinstance(value, dict):
            out += flat(value, at)
        elif isinstance(value, str):
            out.append((at, None, value))
        else:
            out.append((at, [float(x) for x in (value if isinstance(value, list) else [value])], None))
    return out


# --------------------------------------------------------------------- Amiramesh
#: Element types by name, as numpy kinds.
MESH_TYPES = {"float": "f4", "double": "f8", "byte": "u1", "short": "i2", "ushort": "u2", "int": "i4"}
SECTION = re.compile(r"(?m)^\s*(\w+)\s*\{\s*(\w+)(?:\[(\d+)\])?\s+(\w+)\s*\}\s*=?\s*@(\d+)(?:\((\w+),(\d+)\))?\s*$")


def _run_lengths(data: bytes, size: int) -> bytes:
    """Byte runs: a count below 128 repeats the next byte, a greater one says how many follow as they are."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2] * n
            at += 2
        else:
            out += data[at + 1 : at + 1 + n - 128]
            at += n - 127
    return bytes(out)


def read_mesh(data: bytes, only_header: bool = False) -> dict:
    """``sizes``, ``parameters`` and ``sections`` (number, group, name, kind, values) of an Amiramesh file."""
    start = re.search(rb"(?m)^@1\b[^\n]*\n", data)
    head = data[: start.start() if start else len(data)].decode("latin-1")
    first = head.split("\n", 1)[0].lower()
    if not first.startswith("# amiramesh"):
        raise FormatError("not an Amiramesh file")
    head = re.sub(r"(?m)^\s*#.*$", "", head)
    sizes = {a or b: [int(x) for x in n.split()] for a, b, n in re.findall(r"(?m)^\s*(?:define\s+(\w+)|n(\w+))\s+([\d ]+?)\s*(?=$|Parameters)", head)}
    at = head.find("Parameters")
    parameters = parse_braces(head[at:]).get("Parameters", {}) if at >= 0 else {}
    text = "ascii" in first
    order = "<" if "little" in first else ">"
    sections = []
    for group, kind, width, name, no, how, length in SECTION.findall(head):
        n = int(np.prod(sizes.get(group) or sizes.get(group.removesuffix("Data") + "s", [0]), dtype=np.int64))
        sections.append({"number": int(no), "group": group, "name": name, "kind": kind, "width": int(width or 1), "n": n, "how": how, "length": int(length or 0)})
    if only_header:
        return {"sizes": sizes, "parameters": parameters, "sections": sections}
    for s in sections:
        mark = re.search(rb"(?m)^@%d\b[^\n]*\n" % s["number"], data[start.start() :]) if start else None
        count = s["n"] * s["width"]
        if mark is None or not count:
            values = np.zeros(0)
        elif text:
            rest = data[start.start() + mark.end() :]
            end = re.search(rb"(?m)^@\d", rest)
            words = rest[: end.start() if end else len(rest)].split()[:count]
            values = np.array([float("nan") if w in (b"NA", b"NaN") else float(w) for w in words])
        else:
            kind = np.dtype(MESH_TYPES[s["kind"]]).newbyteorder(order)
            raw = data[start.start() + mark.end() :]
            if s["how"] == "HxZip":
                raw = zlib.decompress(raw[: s["length"]])
            elif s["how"] == "HxByteRLE":
                raw = _run_lengths(raw[: s["length"]], count)
            values = np.frombuffer(raw[: count * kind.itemsize], dtype=kind).astype(float)
        if len(values) != count:
            raise FormatError(f"section {s['number']} holds {len(values)} of {count} values")
        s["values"] = values.reshape(-1, s["width"])
    return {"sizes": sizes, "parameters": parameters, "sections": sections}


def write_mesh(sizes: dict[str, list[int]], sections: list[dict], parameters: dict | None = None, how: str = "text", order: str = "big") -> bytes:
    """``sections`` have group, name, kind and values; ``how``: text, binary or hxzip."""
    first = {"text": "# AmiraMesh ASCII 1.0"}.get(how) or ("# AmiraMesh BINARY-LITTLE-ENDIAN 2.1" if order == "little" else "# AmiraMesh 3D BINARY 2.0")
    head = first + "\n\n" + "".join(f"define {k} {' '.join(map(str, v))}\n" for k, v in sizes.items())
    if parameters:
        head += "\nParameters {\n" + write_braces(parameters, 1) + "}\n"
    bodies = []
    for i, s in enumerate(sections, 1):
        values = np.asarray(s["values"], dtype=float).reshape(len(s["values"]), -1)
        width = f"[{values.shape[1]}]" if values.shape[1] > 1 else ""
        if how == "text":
            body = lines_of(values.tolist()).encode()
        else:
            body = values.astype(np.dtype(MESH_TYPES[s["kind"]]).newbyteorder("<" if order == "little" else ">")).tobytes()
        note = ""
        if how == "hxzip":
            body = zlib.compress(body)
            note = f"(HxZip,{len(body)})"
        head += f"\n{s['group']} {{ {s['kind']}{width} {s['name']} }} = @{i}{note}"
        bodies.append(b"@%d\n" % i + body + b"\n")
    return head.encode() + b"\n\n" + b"".join(bodies)


def kind_holding(values: np.ndarray, kind: str) -> str:
    """``kind``, or where it cannot hold these values as they are, the first of int and double that can."""
    held = lambda k: np.array_equal(np.asarray(values, dtype=float).astype(MESH_TYPES[k]).astype(float), values, equal_nan=True)
    with np.errstate(invalid="ignore", over="ignore"):
        return next((k for k in (kind, "int") if held(k)), "double")


def section(mesh: dict, name: str) -> np.ndarray | None:
    return next((s["values"] for s in mesh["sections"] if s["name"] == name), None)


def mesh_lineset(mesh: dict) -> tuple[np.ndarray, list[list[int]], np.ndarray | None]:
    """Places, lines of vertex numbers from 0 (closed by -1 in the file), and widths if any."""
    index = section(mesh, "LineIdx").ravel().astype(int).tolist()
    lines, line = [], []
    for i in index:
        if i < 0:
            lines.append(line)
            line = []
        else:
            line.append(i)
    places = section(mesh, "Coordinates") if section(mesh, "Coordinates") is not None else section(mesh, "Vertices")
    width = section(mesh, "Data")
    return places, lines + ([line] if line else []), None if width is None else width.ravel()


def mesh_skeleton(mesh: dict) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray | None]:
    """Places, directed edges of vertex numbers from 0, and radii of a skeleton graph."""
    count, listed = section(mesh, "NeighbourCount"), section(mesh, "NeighbourList")
    owner = np.repeat(np.arange(len(count)), count.ravel().astype(int))
    radii = section(mesh, "Radii")
    return section(mesh, "Coordinates"), list(zip(owner.tolist(), listed.ravel().astype(int).tolist())), None if radii is None else radii.ravel()


def rooted(n: int, edges: list[tuple[int, int]], origin: int = 0) -> list[int]:
    """Parent (from 1, roots -1) of points 1..n, every tree walked from its origin or smallest point."""
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    parent = [0] * n
    for root in [origin, *range(n)]:
        if root >= n or parent[root]:
            continue
        parent[root] = -1
        stack = [root]
        while stack:
            at = stack.pop()
            for other in near[at]:
                if not parent[other]:
                    parent[other] = at + 1
                    stack.append(other)
    return parent


# -------------------------------------------------------------------------- NRRD
#: NRRD type names by their standard name, and the numpy kind of each.
NRRD_TYPES = {
    "int8": ("i1", ("signed char", "int8", "int8_t")), "uint8": ("u1", ("uchar", "unsigned char", "uint8", "uint8_t")),
    "int16": ("i2", ("short", "short int", "signed short", "signed short int", "int16", "int16_t")), "uint16": ("u2", ("ushort", "unsigned short", "unsigned short int", "uint16", "uint16_t")),
    "int32": ("i4", ("int", "signed int", "int32", "int32_t")), "uint32": ("u4", ("uint", "unsigned int", "uint32", "uint32_t")),
    "int64": ("i8", ("longlong", "long long", "long long int", "signed long long", "signed long long int", "int64", "int64_t")),
    "uint64": ("u8", ("ulonglong", "unsigned long long", "unsigned long long int", "uint64", "uint64_t")), "float": ("f4", ("float",)), "double": ("f8", ("double",)),
}
#: NRRD field names, and those written with a space.
NRRD_FIELDS = (
    "space", "space dimension", "space units", "space origin", "space directions", "measurement frame", "dimension", "type", "block size", "blocksize", "encoding", "endian", "content", "min", "max", "old min", "oldmin",
    "old max", "oldmax", "data file", "datafile", "line skip", "lineskip", "byte skip", "byteskip", "number", "sizes", "spacings", "thicknesses", "axis mins", "axismins", "axis maxs", "axismaxs", "centers", "centerings",
    "labels", "units", "kinds", "sample units", "sampleunits",
)
SPACED_FIELDS = ("space dimension", "space units", "space origin", "space directions", "measurement frame")


def nrrd_type(name: str) -> str:
    found = next((k for k, (_, names) in NRRD_TYPES.items() if name.strip().lower() in names), None)
    if found is None:
        raise FormatError(f"unknown type {name}")
    return found


def nrrd_field(name: str, validate: bool = False) -> str:
    if validate and name not in NRRD_FIELDS:
        raise FormatError(f"unknown field {name}")
    return name if name in SPACED_FIELDS else name.replace(" ", "")


def read_nrrd_header(data: bytes) -> tuple[dict[str, str], int]:
    """Fields by standard name (key/value pairs as they are) and the header's length in bytes."""
    if not data.startswith(b"NRRD"):
        raise FormatError("not a NRRD file")
    end = re.search(rb"\r?\n\r?\n", data)
    size = end.end() if end else len(data)
    fields: dict[str, str] = {}
    for line in data[:size].decode("latin-1").splitlines()[1:]:
        if not line or line[0] == "#":
            continue
        pair = re.match(r"([^:]+):(=| ?)(.*)", line)
        if pair:
            fields[pair[1] if pair[2] == "=" else nrrd_field(pair[1])] = pair[3].strip()
        elif "datafile" in fields:
            fields["datafile"] += "\n" + line
    return fields, size


def nrrd_data_files(fields: dict[str, str]) -> list[str]:
    """Names of a detached header's data files: one, a list, or a numbered pattern."""
    told = fields.get("datafile", "")
    if told.startswith("LIST"):
        return [x for x in told.split("\n")[1:] if x.strip()]
    words = told.split()
    if len(words) >= 4 and "%" in words[0]:
        first, last, step = map(int, words[1:4])
        return [words[0] % i for i in range(first, last + (1 if step > 0 else -1), step)]
    return [told] if told else []


def nrrd_voxel(fields: dict[str, str]) -> list[float]:
    """Voxel size of each axis, from spacings or space directions."""
    if "spacings" in fields:
        return [float("nan") if x.lower() == "nan" else abs(float(x)) for x in fields["spacings"].split()]
    found = re.findall(r"\(([^)]*)\)|(none)", fields.get("space directions", ""))
    return [float("nan") if none else float(np.sqrt(sum(float(x) ** 2 for x in v.split(",")))) for v, none in found]


def nrrd_origin(fields: dict[str, str]) -> list[float]:
    n = int(fields["dimension"])
    if "space origin" in fields:
        return [float(x) for x in fields["space origin"].strip("()").split(",")]
    return [float(x) for x in fields["axismins"].split()] if "axismins" in fields else [0.0] * n


def nrrd_payload(fields: dict[str, str], raw: bytes) -> bytes:
    for _ in range(int(fields.get("lineskip", 0))):
        raw = raw[raw.index(b"\n") + 1 :]
    how = fields.get("encoding", "raw").lower()
    raw = gzip.decompress(raw) if how in ("gzip", "gz") else bz2.decompress(raw) if how in ("bzip2", "bz2") else raw
    skip = int(fields.get("byteskip", 0))
    return raw[skip:] if skip >= 0 else raw


def read_nrrd(data: bytes, detached: bytes | None = None) -> tuple[dict[str, str], np.ndarray]:
    """Fields and an array whose first axis is the file's fastest."""
    fields, size = read_nrrd_header(data)
    kind = np.dtype(NRRD_TYPES[nrrd_type(fields["type"])][0]).newbyteorder(">" if fields.get("endian") == "big" else "<")
    sizes = [int(x) for x in fields["sizes"].split()]
    raw = nrrd_payload(fields, data[size:] if detached is None else detached)
    count = int(np.prod(sizes))
    if fields.get("encoding", "raw").lower() in ("ascii", "text", "txt"):
        values = np.array(raw.split()[:count], dtype=float)
    else:
        values = np.frombuffer(raw[-count * kind.itemsize :] if int(fields.get("byteskip", 0)) < 0 else raw[: count * kind.itemsize], dtype=kind)
    if len(values) != count:
        raise FormatError(f"{len(values)} of {count} values")
    return fields, values.astype(kind.newbyteorder("=")).reshape(sizes, order="F")


def write_nrrd(values: np.ndarray, kind: str = "float", encoding: str = "raw", voxel: list[float] | None = None, origin: list[float] | None = None, more: dict[str, str] | None = None, endian: str = "little") -> bytes:
    kind = nrrd_type(kind)
    fields = {"type": kind, "encoding": encoding, "endian": endian, "dimension": str(values.ndim), "sizes": " ".join(map(str, values.shape))}
    if voxel:
        fields["spacings"] = " ".join(map(number, voxel))
    if origin:
        fields["axis mins"] = " ".join(map(number, origin))
    head = "NRRD0004\n" + "".join(f"{k}: {v}\n" for k, v in (fields | (more or {})).items()) + "\n"
    flat_values = np.asarray(values).ravel(order="F")
    if encoding in ("text", "ascii"):
        return head.encode() + "\n".join(map(number, flat_values.tolist())).encode() + b"\n"
    raw = flat_values.astype(np.dtype(NRRD_TYPES[kind][0]).newbyteorder(">" if endian == "big" else "<")).tobytes()
    return head.encode() + (gzip.compress(raw, mtime=0) if encoding == "gzip" else raw)


def edit_nrrd(data: bytes, new: dict[str, str], action: str = "addreplace") -> bytes:
    """Header fields added or replaced (``addonly``, ``replaceonly``); the data stay."""
    fields, size = read_nrrd_header(data)
    lines = data[:size].decode("latin-1").splitlines()
    while lines and not lines[-1]:
        lines.pop()
    for name, value in new.items():
        key = nrrd_field(name, validate=True)
        at = next((i for i, line in enumerate(lines[1:], 1) if ":" in line and nrrd_field(line.split(":", 1)[0]) == key), None)
        if at is None and action != "replaceonly":
            lines.append(f"{name}: {value}")
        elif at is not None and action != "addonly":
            lines[at] = f"{name}: {value}"
    return ("\n".join(lines) + "\n\n").encode("latin-1") + data[size:]


def detached_header(data: bytes, file: str) -> bytes:
    """A header of its own that points at the data inside ``file``."""
    fields, size = read_nrrd_header(data)
    lines = data[:size].decode("latin-1").rstrip("\r\n").splitlines()
    return ("\n".join([*lines, f"line skip: {len(lines) + 1}", f"datafile: {file}"]) + "\n\n").encode("latin-1")


def nrrd_checks(data: bytes) -> dict:
    """Integrity of the payload, its length against the header, and its CRC-32 (hexadecimal)."""
    fields, size = read_nrrd_header(data)
    kind = np.dtype(NRRD_TYPES[nrrd_type(fields["type"])][0])
    expected = int(np.prod([int(x) for x in fields["sizes"].split()])) * kind.itemsize
    try:
        raw = nrrd_payload(fields, data[size:])
    except (OSError, EOFError, zlib.error, ValueError):
        return {"intact": False, "expected": expected, "actual": None, "long_enough": False, "crc": None}
    return {"intact": True, "expected": expected, "actual": len(raw), "long_enough": len(raw) >= expected, "crc": f"{zlib.crc32(raw):08x}"}


def nrrd_histogram(fields: dict[str, str], counts: np.ndarray) -> dict[str, list[float]]:
    """Breaks (half a bin beyond the outer mid points), mid points, counts and density of a 1-D histogram."""
    n = len(counts)
    low = float(fields.get("axismins", fields.get("axis mins", "0")).split()[0])
    high = float(fields.get("axismaxs", fields.get("axis maxs", str(n - 1))).split()[0])
    step = (high - low) / (n - 1 if fields.get("centers", fields.get("centerings", "cell")).startswith("node") else n)
    first = low if "node" in fields.get("centers", fields.get("centerings", "")) else low + step / 2
    mids = [first + i * step for i in range(n)]
    total = float(counts.sum())
    return {"breaks": [m - step / 2 for m in mids] + [mids[-1] + step / 2], "mids": mids, "counts": counts.astype(float).tolist(), "density": [float(c) / total if total else 0.0 for c in counts]}


def mesh_nrrd_header(data: bytes, file: str) -> bytes:
    """A detached NRRD header for the lattice inside an Amiramesh file."""
    mesh = read_mesh(data, only_header=True)
    s = mesh["sections"][0]
    if s["how"]:
        raise FormatError("NRRD cannot read this encoding")
    first = data.split(b"\n", 1)[0].lower()
    skip = re.search(rb"(?m)^@1\b[^\n]*\n", data).end()
    kinds = {"byte": "uint8", "short": "int16", "ushort": "uint16", "int": "int32"}
    fields = {"encoding": "text" if b"ascii" in first else "raw", "type": kinds.get(s["kind"], s["kind"]), "endian": "little" if b"little" in first else "big", "byte skip": skip}
    sizes = mesh["sizes"]["Lattice"]
    fields |= {"dimension": len(sizes), "sizes": " ".join(map(str, sizes))}
    box = mesh["parameters"].get("BoundingBox")
    if box:
        fields |= {"axis mins": " ".join(map(number, box[::2])), "axis maxs": " ".join(map(number, box[1::2])), "spacings": " ".join(number((b - a) / max(1, n - 1)) for a, b, n in zip(box[::2], box[1::2], sizes))}
    return ("NRRD0004\n" + "".join(f"{k}: {v}\n" for k, v in fields.items()) + f"data file: {file}\n\n").encode()


def write_rectilinear(values: np.ndarray, axes: list[list[float]]) -> bytes:
    """A lattice whose axes have coordinates of their own."""
    parts = [{"group": "Lattice", "name": "ScalarField", "kind": "float", "values": values.ravel(order="F")}, {"group": "Coordinates", "name": "xyz", "kind": "float", "values": [x for axis in axes for x in axis]}]
    return write_mesh({"Lattice": list(values.shape), "Coordinates": [sum(values.shape)]}, parts, {"CoordType": "rectilinear"})


def read_rectilinear(data: bytes) -> tuple[np.ndarray, list[list[float]]]:
    mesh = read_mesh(data)
    sizes, flat_axes = mesh["sizes"]["Lattice"], section(mesh, "xyz").ravel().tolist()
    cuts = np.cumsum([0, *sizes])
    return section(mesh, "ScalarField").reshape(sizes, order="F"), [flat_axes[a:b] for a, b in zip(cuts, cuts[1:])]


def mesh_from_nrrd(data: bytes, kind: str, conversion: str = "scale") -> bytes:
    """A NRRD volume as a lattice of another type: values cast, or their range scaled to that of a whole-number type."""
    fields, values = read_nrrd(data)
    values = values.astype(float)
    if conversion == "scale" and kind not in ("float", "double"):
        top = {"byte": 255, "short": 32767, "ushort": 65535, "int": 2**31 - 1}[kind]
        low, high = float(values.min()), float(values.max())
        values = np.floor((values - low) / ((high - low) or 1.0) * top + 0.5)
    voxel, origin = nrrd_voxel(fields), nrrd_origin(fields)
    box = [x for o, v, n in zip(origin, voxel or [1.0] * values.ndim, values.shape) for x in (o, o + v * (n - 1))]
    return write_mesh({"Lattice": list(values.shape)}, [{"group": "Lattice", "name": "ScalarField", "kind": kind, "values": values.ravel(order="F")}], {"CoordType": "uniform", "BoundingBox": box}, "binary")


# ------------------------------------------------------------------- raw volumes
#: What a raw stack begins with, and the numpy kind of each element size.
RAW_MAGIC = b"raw_image_stack_by_hpeng"
RAW_KINDS = {1: "u1", 2: "u2", 4: "f4"}


def read_raw_stack(data: bytes) -> np.ndarray:
    if not data.startswith(RAW_MAGIC):
        raise FormatError("not a raw stack")
    order = {b"L": "<", b"B": ">"}.get(data[24:25])
    if order is None:
        raise FormatError("unknown byte order")
    (size,) = struct.unpack(order + "h", data[25:27])
    if size not in RAW_KINDS:
        raise FormatError("unknown element size")
    dims = struct.unpack(order + "4i", data[27:43])
    values = np.frombuffer(data[43:], dtype=np.dtype(RAW_KINDS[size]).newbyteorder(order), count=int(np.prod(dims)))
    return values.astype(float).reshape([d for d in dims if d > 1], order="F")


def write_raw_stack(values: np.ndarray, size: int = 4, little: bool = True) -> bytes:
    """Elements of ``size`` bytes, or of the next size that holds all values as they are."""
    values = np.asarray(values, dtype=float)
    with np.errstate(invalid="ignore", over="ignore"):
        size = next((n for n in RAW_KINDS if n >= size and np.array_equal(values.astype(RAW_KINDS[n]).astype(float), values, equal_nan=True)), None)
    if size is None:
        raise FormatError("a raw stack cannot hold these values")
    order = "<" if little else ">"
    dims = [*values.shape, 1, 1, 1, 1][:4]
    head = RAW_MAGIC + (b"L" if little else b"B") + struct.pack(order + "h4i", size, *dims)
    return head + values.ravel(order="F").astype(np.dtype(RAW_KINDS[size]).newbyteorder(order)).tobytes()


def write_analyze(values: np.ndarray, pixel: list[float]) -> tuple[bytes, bytes]:
    """Header and image of an Analyze 7.5 volume of floats."""
    head = bytearray(348)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 0.0, *pixel, *[0.0] * (7 - len(pixel)))
    return bytes(head), values.ravel(order="F").astype("<f4").tobytes()


def read_analyze(head: bytes, image: bytes) -> tuple[np.ndarray, list[float]]:
    """Values and pixel sizes of an Analyze volume of floats."""
    n = struct.unpack_from("<h", head, 40)[0]
    sizes, kind = struct.unpack_from(f"<{n}h", head, 42), struct.unpack_from("<h", head, 70)[0]
    if kind != 16:
        raise FormatError("only volumes of floats are read")
    return np.frombuffer(image, dtype="<f4").astype(float).reshape(sizes, order="F"), list(struct.unpack_from(f"<{n}f", head, 80))


def read_irtk_matrix(data: bytes, order: str = ">") -> np.ndarray:
    head, _, body = data.partition(b"\n")
    found = re.match(rb"irtkMatrix\s+(\d+)\s+x\s+(\d+)", head)
    if not found:
        raise FormatError("not a matrix file")
    rows, columns = int(found[1]), int(found[2])
    return np.frombuffer(body[: 8 * rows * columns], dtype=order + "f8").astype(float).reshape(rows, columns, order="F")


def write_irtk_matrix(m: np.ndarray, order: str = ">") -> bytes:
    return f"irtkMatrix {m.shape[0]} x {m.shape[1]}\n".encode() + m.ravel(order="F").astype(order + "f8").tobytes()


# ------------------------------------------------------------------ small tables
#: Fixed value: the number that one kind of look-up table begins with.
LUT_MAGIC = 1229147980


def read_lut(data: bytes) -> np.ndarray:
    """256 rows of red, green and blue from an NIH, binary or text look-up table."""
    if len(data) >= 4 and struct.unpack(">i", data[:4])[0] == LUT_MAGIC:
        return np.frombuffer(data[32 : 32 + 768], dtype=np.uint8).reshape(3, 256).T.astype(int)
    if len(data) in (768, 970):
        return np.frombuffer(data[-768:], dtype=np.uint8).reshape(3, 256).T.astype(int)
    rows = [line.split() for line in data.decode("latin-1").splitlines() if line.strip()]
    if rows and not re.fullmatch(r"[-\d.]+", rows[0][0]):
        rows = rows[1:]
    table = np.array(rows[:256], dtype=float).astype(int)
    if table.shape[1] not in (3, 4):
        raise FormatError("a look-up table has three columns, or four with an index")
    return table[:, -3:]


def write_lut(rgb: np.ndarray, low: float = 0, high: float = 255, text: bool = True) -> bytes:
    rgb = np.asarray(rgb, dtype=float)
    if rgb.min() < low or rgb.max() > high:
        raise ValueError("colours must lie within the range given")
    scaled = (rgb - low) / (high - low) * 255
    return "".join("\t".join(map(number, r)) + "\n" for r in scaled.tolist()).encode() if text else scaled.T.astype(np.uint8).tobytes()


def write_colormap(rgba: np.ndarray, low: float = 0, high: float = 255, alpha: float = 1.0) -> bytes:
    rgba = np.asarray(rgba, dtype=float)
    if rgba.shape[1] == 3:
        rgba = np.c_[rgba, np.full(len(rgba), alpha)]
    if rgba.min() < 0 or rgba.max() > 1:
        raise ValueError("colours must lie between 0 and 1")
    return write_mesh({"Lattice": [len(rgba)]}, [{"group": "Lattice", "name": "Data", "kind": "float", "values": rgba}], {"ContentType": "Colormap", "MinMax": [low, high]})


def read_hull_points(data: bytes) -> list[tuple[int, float, float, float]]:
    return [(int(float(w[0])), *map(float, w[1:4])) for w in (line.split() for line in data.decode().splitlines()[2:]) if len(w) >= 4]


# ----------------------------------------------------------- points and surfaces
def read_vtk(data: bytes) -> tuple[np.ndarray, list[list[int]]]:
    """Points and polygons of a legacy ASCII POLYDATA file."""
    lines = data.decode("latin-1").split("\n", 4)
    if len(lines) < 5 or not re.match(r"(?i)# vtk DataFile Version [23]", lines[0]) or "ASCII" not in lines[2].upper():
        raise FormatError("not an ASCII VTK file")
    if lines[3].upper().split() != ["DATASET", "POLYDATA"]:
        raise FormatError("only POLYDATA is read")
    head, _, body = lines[4].partition("\n")
    words = head.upper().split()
    if len(words) != 3 or words[0] != "POINTS":
        raise FormatError("no POINTS line")
    n = int(words[1])
    tokens = body.split()
    points = np.array(tokens[: 3 * n], dtype=float).reshape(n, 3)
    faces, rest = [], tokens[3 * n :]
    if rest[:1] == ["POLYGONS"]:
        at = 3
        for _ in range(int(rest[1])):
            size = int(rest[at])
            faces.append([int(x) for x in rest[at + 1 : at + 1 + size]])
            at += size + 1
    return points, faces


def read_places(data: bytes) -> np.ndarray:
    """Places of a run of lines ``x y z``, as vertices of several formats are written."""
    return np.array([b"nan" if w == b"NA" else w for w in data.split()], dtype=float).reshape(-1, 3)


def vtk_sections(kind: str = "float", faces: bool = False) -> list[Callable[[int], bytes]]:
    """What :func:`write_vtk` writes, section by section: a beginning for ``n`` points (and a third of them faces)."""
    whole = lambda n: write_vtk([], [] if faces else None, kind=kind).decode().replace("POINTS 0", f"POINTS {n}").replace("POINT_DATA 0", f"POINT_DATA {n}")
    if not faces:
        return [lambda n: whole(n).encode()]
    cut = lambda n: whole(n).replace("CELL_DATA 0", f"CELL_DATA {n // 3}").partition("POLYGONS 0 0\n")
    return [lambda n: cut(n)[0].encode(), lambda n: f"POLYGONS {n // 3} {n // 3 * 4}\n".encode(), lambda n: cut(n)[2].encode()]


def surface_sections(material: str) -> list[Callable[[int], bytes]]:
    """What :func:`write_surface` writes before vertices, before triangles and after them, for ``n`` vertices and a third of them faces."""
    cut = lambda n: write_surface([], [], material).decode().replace("Vertices 0\n", f"Vertices {n}\n").replace("Triangles 0\n", f"Triangles {n // 3}\n").partition("NBranchingPoints")
    return [lambda n: cut(n)[0].encode(), lambda n: "".join(cut(n)[1:])[:-2].encode(), lambda n: b"}\n"]


def landmark_sections() -> list[Callable[[int], bytes]]:
    """What :func:`write_landmark_sets` writes before and after one set of ``n`` markers."""
    one = write_landmark_sets([[(0.0, 0.0, 0.0)]]).partition(b"@1\n0 0 0\n")
    return [lambda n: one[0].replace(b"Markers 1\n", b"Markers %d\n" % n) + one[1][:3], lambda n: one[2]]


def write_vtk(points: list, faces: list[list[int]] | None = None, title: str = "points", kind: str = "float") -> bytes:
    out = f"# vtk DataFile Version 2.0\n{title}\nASCII\nDATASET POLYDATA\nPOINTS {len(points)} {kind}\n" + lines_of(points)
    if faces is not None:
        out += f"POLYGONS {len(faces)} {sum(len(f) + 1 for f in faces)}\n" + lines_of([[len(f), *f] for f in faces]) + f"\nCELL_DATA {len(faces)}\nPOINT_DATA {len(points)}\n"
    return out.encode()


def read_named_points(data: bytes) -> list[tuple[str, float, float, float]]:
    """Lines ``"name": [x, y, z]``."""
    return [(a, *map(float, b.split(","))) for a, b in re.findall(r'(?m)^\s*"?(.*?)"?:\s*\[([^\]]*)\]', data.decode())]


def read_landmark_sets(data: bytes) -> list[tuple[int, int, float, float, float]]:
    """Set, marker and place of every landmark of an Amiramesh landmark file."""
    found = [s["values"] for s in read_mesh(data)["sections"] if s["name"].startswith("Coordinates")]
    return [(i, j, *map(float, row)) for i, rows in enumerate(found, 1) for j, row in enumerate(rows, 1)]


def write_landmark_sets(sets: list[list]) -> bytes:
    names = ["Coordinates", *[f"Coordinates{i}" for i in range(2, len(sets) + 1)]]
    parts = [{"group": "Markers", "name": n, "kind": "float", "values": np.array(s, dtype=float)} for n, s in zip(names, sets)]
    return write_mesh({"Markers": [len(sets[0])]}, parts, {"ContentType": "LandmarkSet", "NumSets": len(sets)})


def write_cmtk_landmarks(points: list[tuple[str, float, float, float]]) -> bytes:
    return ("! TYPEDSTREAM 1.1\n\n" + "".join(f'landmark {{\n\tname "{n}"\n\tlocation {number(x)} {number(y)} {number(z)}\n}}\n' for n, x, y, z in points)).encode()


def read_cmtk_landmarks(data: bytes) -> list[tuple[str, float, float, float]]:
    text = data.decode("latin-1")
    return [(n, *map(float, p.split())) for n, p in re.findall(r'landmark\s*\{\s*name\s+"([^"]*)"\s+location\s+([^}]*?)\s*\}', text)]


def write_surface(points: list, faces: list[list[int]], material: str) -> bytes:
    """An ASCII surface of one material; faces count from 0."""
    head = f'# HyperSurface ASCII\nParameters {{\n\tMaterials {{\n\t\tExterior {{\n\t\t\tId 1\n\t\t}}\n\t\t{material} {{\n\t\t\tId 2,\n\t\t\tColor 0.83562 0.78 0.06\n\t\t}}\n\t}}\n\tBoundaryIds {{\n\t\tName "BoundaryConditions"\n\t}}\n}}\n'
    body = f"Vertices {len(points)}\n" + lines_of(points) + f"NBranchingPoints 0\nNVerticesOnCurves 0\nBoundaryCurves 0\nPatches 1\n{{\nInnerRegion {material}\nOuterRegion Exterior\nBoundaryID 0\nBranchingPoints 0\n\nTriangles {len(faces)}\n"
    return (head + body + lines_of([[i + 1 for i in f] for f in faces]) + "}\n").encode()


def read_surface(data: bytes) -> tuple[np.ndarray, list[tuple[str, str, list[int]]]]:
    """Vertices, and the inner region, outer region and corners (from 0) of every triangle."""
    text = data.decode("latin-1")
    if "HyperSurface" not in text.split("\n", 1)[0]:
        raise FormatError("not a surface file")
    n, body = re.search(r"(?m)^\s*Vertices\s+(\d+)\s*\n([\s\S]*)", text).groups()
    points = np.array(body.split()[: 3 * int(n)], dtype=float).reshape(-1, 3)
    out = []
    for inner, outer, count, rest in re.findall(r"InnerRegion\s+(\S+)\s+OuterRegion\s+(\S+)[^{}]*?Triangles\s+(\d+)\s*\n([^{}]*)", body):
        corners = np.array(rest.split()[: 3 * int(count)], dtype=int).reshape(-1, 3) - 1
        out += [(inner, outer, c) for c in corners.tolist()]
    return points, out


# ------------------------------------------------------------------------ neurons
def read_asc(data: bytes) -> dict:
    """Points, contours and markers of a Neurolucida text file.

    Points are ``(point_no, x, y, z, w, parent)`` of the one axon or dendrite tree:
    a round bracket on its own opens branches at the last point, a bar starts the
    next branch there, a closing bracket goes back.  Contours are ``(name, number,
    x, y, z)`` of quoted blocks of five points or more.
    """
    lines = [x.partition(";")[0].strip() for x in re.split(r"\r\n|\r|\n", data.decode("latin-1"))]
    lines = [x for x in lines if x]
    place = re.compile(r"[(>]?\s*\(?\s*((?:[-+\d.eE]+|ERR|NA)(?:\s+(?:[-+\d.eE]+|ERR|NA)){2,})\s*\)")
    read = lambda t: [float("nan") if w in ("ERR", "NA") else float(w) for w in t.split()]
    trees = [i for i, x in enumerate(lines) if "(Axon)" in x or "(Dendrite)" in x]
    points: list[tuple] = []
    if trees:
        if len(trees) > 1:
            raise FormatError("more than one tree")
        last, stack = -1, []
        for line in lines[trees[0] + 1 :]:
            if not line.strip("("):
                stack += [last] * len(line)
            elif not line.strip("|"):
                last = stack[-1]
            elif line.startswith(")"):
                if not stack:
                    break
                last = stack.pop()
            elif (found := place.match(line)) and not line.startswith(">"):
                values = [*read(found[1]), float("nan")][:4]
                points.append((len(points) + 1, *values, last))
                last = len(points)
    contours, markers, i, number_of = [], [], 0, {}
    while i < len(lines):
        opened = '"' in lines[i] and re.match(r'\(\s*"([^"]+)"', lines[i])
        if not opened:
            i += 1
            continue
        name, rows = opened[1], []
        i += 1
        while i < len(lines) and not re.match(r'\(\s*"|\)$', lines[i]):
            if found := place.match(lines[i]):
                rows.append([*read(found[1]), 0, 0, 0][:3])
            i += 1
        if len(rows) >= 5:
            number_of[name] = number_of.get(name, 0) + 1
            contours += [(name, number_of[name], *row) for row in rows if row[0] == row[0]]
        elif rows:
            markers += [(name, *row) for row in rows]
    return {"points": points, "contours": contours, "markers": markers}


def write_asc(points: list[tuple]) -> bytes:
    """``(point_no, x, y, z, w, parent)`` of one tree, with branch labels such as R-1-2."""
    below: dict[int, list[tuple]] = {}
    for p in points:
        below.setdefault(p[5], []).append(p)
    out = [";\tV3 text file", "(Sections)", "", "( (Color Blue)", "  (Axon)"]
    stack: list = [("open", below.get(-1, [None])[0], "R", 1)]
    while stack:
        kind, item, label, depth = stack.pop()
        tab = "  " * depth
        if kind == "line":
            out.append(tab + item)
            continue
        n, at = 0, item
        while at is not None:
            values = "  ".join(f"{v:.17g}" for v in at[1:5] if v is not None and v == v)
            out.append(f"{tab}({values})  ; {'Root' if label == 'R' and n == 0 else f'{label}, {n}'}")
            n += 1
            nxt = below.get(at[0], [])
            if len(nxt) == 1:
                at = nxt[0]
                continue
            if nxt:
                parts = [("line", "(", label, depth)]
                for i, child in enumerate(nxt, 1):
                    parts += [("open", child, f"{label}-{i}", depth + 1), ("line", "|" if i < len(nxt) else ")  ;  End of split", label, depth)]
                stack += parts[::-1]
            else:
                out.append(f"{tab} Normal")
            at = None
    return "\n".join([*out, ")  ;  End of tree", ""]).encode()


def read_abf(data: bytes) -> list[tuple]:
    """``(point_no, x, y, z, w, parent)`` of a B/C/T listing in which all forks are binary."""
    rows = [line.split() for line in data.decode().splitlines() if line.strip()]
    out, open_, last = [], [], -1
    for number_, (_, kind, x, y, z, w) in enumerate(rows, 1):
        out.append((number_, float(x), float(y), float(z), float(w) if w != "NA" else float("nan"), last))
        if kind == "B":
            open_.append(number_)
            last = number_
        elif kind == "T" and number_ > 1:
            last = open_.pop() if open_ else -1
        else:
            last = number_
    return out


def write_abf(points: list[tuple]) -> bytes:
    """Depth first, smaller children first, as the reader needs it; numbers from 0."""
    below: dict[int, list[tuple]] = {}
    for p in sorted(points):
        below.setdefault(p[5], []).append(p)
    out, stack, n = "", below.get(-1, [])[::-1], 0
    while stack:
        p = stack.pop()
        nxt = below.get(p[0], [])
        kind = "T" if not nxt or p[5] == -1 and len(nxt) == 1 else "B" if len(nxt) > 1 else "C"
        out += f"{n} {kind} " + " ".join(map(number, p[1:5])) + "\n"
        n += 1
        stack += nxt[::-1]
    return out.encode()


def write_pdb(points: list[tuple]) -> bytes:
    head = "HEADER\nTITLE\nCOMPND\nSOURCE\n"
    return (head + "".join(f"HETATM{i:5d}  {'ON'[(i - 1) % 2]}   MSE A 124    {p[1]:8.3f}{p[2]:8.3f}{p[3]:8.3f}\n" for i, p in enumerate(points, 1))).encode()


def read_traces(data: bytes) -> list[tuple]:
    """``(path, number, x, y, z, starts_on, start_index)`` of every point of a traces file in XML."""
    from xml.etree import ElementTree

    out = []
    for path in ElementTree.fromstring(data).iter("path"):
        on, index = path.get("startson"), path.get("startsindex")
        for i, p in enumerate(path.iter("point")):
            xyz = [float(p.get(a + "d") or p.get(a)) for a in "xyz"]
            out.append((int(path.get("id")), i, *xyz, int(on) if on is not None else None, int(index) if index is not None else None))
    return out


def joined_traces(rows: list[tuple]) -> list[tuple]:
    """``(point_no, x, y, z, parent)`` of all paths as one table, paths that start on others joined to them."""
    number_of = {(r[0], r[1]): i for i, r in enumerate(rows, 1)}
    out = []
    for r in rows:
        parent = number_of[r[0], r[1] - 1] if r[1] else number_of.get((r[5], r[6]), -1)
        out.append((number_of[r[0], r[1]], *r[2:5], parent))
    return out


def write_traces(paths: list[tuple[int, list, int | None, int | None]]) -> bytes:
    out = '<?xml version="1.0" encoding="UTF-8"?>\n<tracings>\n'
    for n, points, on, index in paths:
        start = "" if on is None else f' startson="{on}" startsindex="{index}"'
        out += f'  <path id="{n}"{start}>\n' + "".join(f'    <point x="0" y="0" z="0" xd="{x!r}" yd="{y!r}" zd="{z!r}"/>\n' for x, y, z in points) + "  </path>\n"
    return (out + "</tracings>\n").encode()


# -------------------------------------------------------------- registrations, notes
def read_warp(data: bytes) -> dict:
    """Grid, control points and affine part of a spline warp in a typed stream."""
    warp = read_typed_stream(data)["registration"]["spline_warp"]
    dims = [int(x) for x in warp["dims"]]
    at = np.array(warp["coefficients"], dtype=float).reshape(-1, 3)
    active = warp.get("active")
    return {"dims": dims, "domain": warp.get("domain"), "controls": at, "active": None if active is None else active, "affine": warp.get("affine_xform")}


def write_warp(dims: list[int], domain: list[float], controls: np.ndarray, active: list[int], params: np.ndarray) -> bytes:
    move, degrees, scale, shear, centre = np.asarray(params, dtype=float).reshape(5, 3).tolist()
    affine = {"xlate": move, "rotate": degrees, "scale": scale, "shear": shear, "center": centre}
    warp = {"affine_xform": affine, "absolute": "yes", "dims": dims, "domain": domain, "coefficients": np.asarray(controls).ravel().tolist(), "active": active}
    return write_typed_stream({"registration": {"reference_study": "reference", "floating_study": "floating", "spline_warp": warp}})


def registration_folder(name: str, document: dict) -> list[tuple[str, bytes]]:
    """The files of a registration's folder: the registration and the list of its studies."""
    inner = document["registration"]
    moving = inner.get("floating_study") or inner.get("model_study")
    studies = "! TYPEDSTREAM 2.4\n\n" + "".join(f'source {{\n\tstudyname "{x}"\n}}\n' for x in (inner["reference_study"], moving))
    return [(f"{name}/registration", write_typed_stream(document)), (f"{name}/studylist", studies.encode())]


def read_picture_header(data: bytes) -> dict:
    """Sizes, depth, name and notes of a confocal picture file (76-byte header, notes after the data)."""
    nx, ny, n = struct.unpack("<3h", data[:6])
    (byte,) = struct.unpack("<h", data[14:16])
    (magic,) = struct.unpack("<H", data[54:56])
    if magic != 12345:
        raise FormatError("not a picture file")
    at = 76 + nx * ny * n * (1 if byte else 2)
    notes = []
    while at + 96 <= len(data):
        notes.append(data[at + 16 : at + 96].split(b"\0")[0].decode("latin-1").strip())
        at += 96
    return {"nx": nx, "ny": ny, "n": n, "bytes": 1 if byte else 2, "name": data[18:50].split(b"\0")[0].decode("latin-1"), "notes": notes}


def write_transform_text(matrix: np.ndarray, transpose: bool = True, invert: bool = False) -> bytes:
    """A 4x4 matrix as sixteen numbers in a row."""
    m = np.linalg.inv(matrix) if invert else np.asarray(matrix, dtype=float)
    return (" ".join(map(number, (m.T if transpose else m).ravel().tolist())) + "\n").encode()


def read_transform_text(data: bytes, transpose: bool = True, invert: bool = False) -> np.ndarray:
    m = np.array(data.split()[-16:], dtype=float).reshape(4, 4)
    m = m.T if transpose else m
    return np.linalg.inv(m) if invert else m


# ------------------------------------------------------------------ tree tables
def read_swc(data: bytes) -> list[tuple]:
    """``(point_no, label, x, y, z, w, parent)``; the radius is doubled to a width."""
    rows = [line.split() for line in data.decode("latin-1").splitlines() if line.strip() and line.lstrip()[0] != "#"]
    wide = lambda r: float("nan") if r == "NA" else 2 * float(r)
    return [(int(n), int(kind), float(x), float(y), float(z), wide(r), int(parent)) for n, kind, x, y, z, r, parent in (row[:7] for row in rows)]


def write_swc(points: list[tuple]) -> bytes:
    head = "# PointNo Label X Y Z Radius Parent\n"
    return (head + "".join(f"{n} {kind} {number(x)} {number(y)} {number(z)} {number(w / 2)} {parent}\n" for n, kind, x, y, z, w, parent in points)).encode()


def neuron_reader(name: str, data: bytes):
    """Reader of a neuron file by its ending, or else by how it begins: ``(point_no, x, y, z, w, parent)``."""
    if name.endswith(".swc"):
        return lambda d: [(r[0], *r[2:6], r[6]) for r in read_swc(d)]
    if name.endswith(".abf"):
        return read_abf
    if name.endswith(".asc") or data[:1] == b";":
        return lambda d: read_asc(d)["points"]
    if data.lower().startswith(b"# amiramesh"):
        return mesh_neuron
    raise FormatError(f"no reader for {name}")


def mesh_neuron(data: bytes) -> list[tuple]:
    """Points of a line set or skeleton graph, every tree walked from its origin or smallest point."""
    mesh = read_mesh(data)
    if section(mesh, "LineIdx") is not None:
        places, lines, width = mesh_lineset(mesh)
        edges = [e for line in lines for e in zip(line, line[1:])]
        width = section(mesh, "Data0") if width is None else width
    else:
        places, edges, radii = mesh_skeleton(mesh)
        width = None if radii is None else 2 * radii
    origins = section(mesh, "Origins")
    parent = rooted(len(places), edges, int(origins.ravel()[0]) if origins is not None and origins.size else 0)
    widths = [float("nan")] * len(places) if width is None else np.asarray(width).ravel().tolist()
    return [(i + 1, *map(float, p), w, up) for i, (p, w, up) in enumerate(zip(places, widths, parent))]
