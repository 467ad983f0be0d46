"""Readers on files written by hand, as other programs write them: comments, blank lines, odd spacing, missing parts."""

import gzip
import struct
import zlib

import numpy as np
import pytest

from arborkit.sources import formats as f

SWC = b"""# ORIGINAL_SOURCE hand
#n T x y z R P

 1 1 10.5 20.25 -3 1.5 -1
2 3 11 21 -3.5 0.25 1
3 3 1.2e1 22 -4 NA 2
  4 3 11 22 -4 .5 2
"""

ASC = b""";\tV3 text file written for tests.\r\n(Sections)\r\n\r\n("LH"\r\n  (Color White)\r\n  (Closed)\r\n  (GUID "0")\r\n  ( 0 0 1 0.5)  ; 1\r\n  ( 2 0 1 0.5)  ; 2\r\n  ( 2 2 1 0.5)\r\n  ( ERR 2 1 0.5)\r\n  ( 0 2 1 0.5)\r\n)\r\n
("LHEntryPoint"\r\n  ( 7.5 8 9 0)\r\n)\r\n\r\n( (Color Blue)  ; [10,3]\r\n  (Axon)\r\n  (  1.0 2.0 3.0 0.97)  ; Root\r\n  (  2.0 2.0 3.0 0.81)  ; R, 1\r\n  (\r\n    (  3.0 3.0 3.0 0.5)  ; R-1, 1\r\n    (  4.0 4.0 3.0 0.5)  ; R-1, 2\r\n     Normal\r\n  |\r\n    (  3.0 1.0 3.0 0.4)  ; R-2, 1\r\n     High\r\n  )  ;  End of split\r\n)  ;  End of tree\r\n"""

SKELETON = b"""# AmiraMesh 3D ASCII 2.0

# CreationDate: by hand

nVertices 4
nEdges 6
define Origins 1

Parameters {
    ContentType "SkeletonGraph",
    Fitting {
        cVFact 0.1,
        stepSize 0.5
    }
}

Vertices { float[3] Coordinates } @1
Vertices { int NeighbourCount } @2
Vertices { float Radii } @3
Edges { int NeighbourList } @4
Origins { int Origins } @5

# Data section follows
@1
0 0 0
1 0 0
2 0 0
1 1 NA

@2
1
3
1
1

@3
0.5
0.25
0.25
0.125

@4
1
0
2
3
1
1

@5
2
"""

LINESET = b"""# AmiraMesh ASCII 1.0
define Lines 7
define Vertices 5
Parameters { ContentType "HxLineSet" }
Lines { int LineIdx } = @1
Vertices { float[3] Vertices } = @2
Vertices { float Data } = @3
@1
0
1
2
-1
3
4
-1
@2
0 0 0
1 0 0
1 1 0
9 9 9
9 9 8
@3
2
2
1
4
4
"""

NRRD = b"""NRRD0004
# Complete NRRD file format specification at: elsewhere
type: unsigned char
dimension: 3
space: left-posterior-superior
sizes: 2 3 2
space directions: (0.5,0,0) (0,0.5,0) (0,0,2)
kinds: domain domain domain
endian: little
encoding: raw
space origin: (1,-2,3.5)
key:=a value: with a colon

"""


def test_swc():
    rows = f.read_swc(SWC)
    assert [r[:5] + r[6:] for r in rows] == [(1, 1, 10.5, 20.25, -3.0, -1), (2, 3, 11.0, 21.0, -3.5, 1), (3, 3, 12.0, 22.0, -4.0, 2), (4, 3, 11.0, 22.0, -4.0, 2)]
    assert [r[5] for r in rows[:2]] == [3.0, 0.5] and np.isnan(rows[2][5]) and rows[3][5] == 1.0


def test_neurolucida():
    read = f.read_asc(ASC)
    assert [p[:4] + p[5:] for p in read["points"]] == [(1, 1.0, 2.0, 3.0, -1), (2, 2.0, 2.0, 3.0, 1), (3, 3.0, 3.0, 3.0, 2), (4, 4.0, 4.0, 3.0, 3), (5, 3.0, 1.0, 3.0, 2)]
    assert [p[4] for p in read["points"]] == [0.97, 0.81, 0.5, 0.5, 0.4]
    assert read["contours"] == [("LH", 1, 0.0, 0.0, 1.0), ("LH", 1, 2.0, 0.0, 1.0), ("LH", 1, 2.0, 2.0, 1.0), ("LH", 1, 0.0, 2.0, 1.0)]
    assert read["markers"] == [("LHEntryPoint", 7.5, 8.0, 9.0)]


def test_skeleton_graph():
    mesh = f.read_mesh(SKELETON)
    assert mesh["parameters"]["ContentType"] == "SkeletonGraph" and mesh["parameters"]["Fitting"]["stepSize"] == 0.5
    places, edges, radii = f.mesh_skeleton(mesh)
    assert edges == [(0, 1), (1, 0), (1, 2), (1, 3), (2, 1), (3, 1)] and radii.tolist() == [0.5, 0.25, 0.25, 0.125]
    assert np.isnan(places[3, 2]) and places[2].tolist() == [2.0, 0.0, 0.0]
    rows = f.mesh_neuron(SKELETON)
    assert [(r[0], r[5]) for r in rows] == [(1, 2), (2, 3), (3, -1), (4, 2)] and [r[4] for r in rows] == [1.0, 0.5, 0.5, 0.25]


def test_line_set():
    places, lines, width = f.mesh_lineset(f.read_mesh(LINESET))
    assert lines == [[0, 1, 2], [3, 4]] and places[3].tolist() == [9.0, 9.0, 9.0] and width.tolist() == [2.0, 2.0, 1.0, 4.0, 4.0]
    assert [(r[0], r[5]) for r in f.mesh_neuron(LINESET)] == [(1, -1), (2, 1), (3, 2), (4, -1), (5, 4)]


@pytest.mark.parametrize("first", [b"# AmiraMesh BINARY-LITTLE-ENDIAN 2.1", b"# AmiraMesh 3D BINARY 2.0", b"# Avizo"])
def test_binary_lattice(first):
    order = "<" if b"LITTLE" in first else ">"
    head = first + b"\n\ndefine Lattice 2 2 2\n\nParameters {\n    Content \"2x2x2 ushort, uniform coordinates\",\n    BoundingBox 0 1 0 1 0 4,\n    CoordType \"uniform\"\n}\n\nLattice { ushort Data } @1\n\n# Data section follows\n@1\n"
    data = head + struct.pack(order + "8H", *range(500, 508)) + b"\n"
    if first == b"# Avizo":
        with pytest.raises(f.FormatError):
            f.read_mesh(data)
        return
    mesh = f.read_mesh(data)
    assert mesh["sections"][0]["values"].ravel().tolist() == list(range(500, 508)) and mesh["parameters"]["BoundingBox"] == [0, 1, 0, 1, 0, 4]
    with pytest.raises(f.FormatError):
        f.read_mesh(data[:-5])


def test_run_lengths_and_zip():
    head = b"# AmiraMesh BINARY-LITTLE-ENDIAN 2.1\ndefine Lattice 5 2 1\nParameters { CoordType \"uniform\" }\nLattice { byte Labels } @1(%s,%d)\n@1\n"
    runs = bytes([4, 7, 131, 1, 2, 3, 3, 9])
    assert f.read_mesh(head % (b"HxByteRLE", len(runs)) + runs + b"\n")["sections"][0]["values"].ravel().tolist() == [7, 7, 7, 7, 1, 2, 3, 9, 9, 9]
    packed = zlib.compress(bytes(range(10)))
    assert f.read_mesh(head % (b"HxZip", len(packed)) + packed + b"\n")["sections"][0]["values"].ravel().tolist() == list(range(10))


def test_nrrd():
    fields, values = f.read_nrrd(NRRD + bytes(range(12)))
    assert values.shape == (2, 3, 2) and values[1, 2, 1] == 11 and values[1, 0, 0] == 1 and fields["key"] == "a value: with a colon"
    assert f.nrrd_voxel(fields) == [0.5, 0.5, 2.0] and f.nrrd_origin(fields) == [1.0, -2.0, 3.5]
    zipped = NRRD.replace(b"encoding: raw", b"encoding: gz") + gzip.compress(bytes(range(12)))
    assert np.array_equal(f.read_nrrd(zipped)[1], values) and f.nrrd_checks(zipped)["intact"] and not f.nrrd_checks(zipped[:-12])["intact"]
    detached = NRRD.rstrip() + b"\ndata file: x.raw\nbyte skip: 2\n\n"
    assert np.array_equal(f.read_nrrd(detached, b"##" + bytes(range(12)))[1], values)
    with pytest.raises(f.FormatError):
        f.read_nrrd_header(b"P5 something else")


def test_polygons():
    points, faces = f.read_vtk(b"# vtk DataFile Version 3.0\nhand made\nASCII\nDATASET POLYDATA\nPOINTS 4 float\n0 0 0 1 0 0\n1 1 0\n0 1 0\nPOLYGONS 2 7\n3 0 1 2\n2 2 3\n")
    assert points.tolist() == [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]] and faces == [[0, 1, 2], [2, 3]]
    with pytest.raises(f.FormatError):
        f.read_vtk(b"# vtk DataFile Version 3.0\nx\nBINARY\nDATASET POLYDATA\nPOINTS 0 float\n")


def test_traces():
    data = b"""<?xml version="1.0"?><!DOCTYPE tracings><tracings><samplespacing x="1" y="1" z="1"/>
<path id="0" swctype="0"><point x="1" y="2" z="3" xd="0.5" yd="1.0" zd="1.5"/><point x="2" y="2" z="3" xd="1.0" yd="1.0" zd="1.5"/></path>
<path id="3" startson="0" startsindex="1"><point x="2" y="3" z="3" xd="1.0" yd="1.5" zd="1.5"/></path></tracings>"""
    rows = f.read_traces(data)
    assert rows == [(0, 0, 0.5, 1.0, 1.5, None, None), (0, 1, 1.0, 1.0, 1.5, None, None), (3, 0, 1.0, 1.5, 1.5, 0, 1)]
    assert [(r[0], r[4]) for r in f.joined_traces(rows)] == [(1, -1), (2, 1), (3, 2)]


def test_typed_stream():
    data = b"""! TYPEDSTREAM 1.1

registration {
\treference_study "a/b.study"
\tfloating_study "c"
\taffine_xform {
\t\txlate 1 2.5 -3
\t\trotate 0 0 0
\t\tscale 1 1 1.1
\t\tshear 0 0 0
\t\tcenter 84 84 43.5
\t}
}
"""
    document = f.read_typed_stream(data)
    assert document["registration"]["reference_study"] == "a/b.study" and document["registration"]["affine_xform"]["xlate"] == [1, 2.5, -3]
    assert f.read_typed_stream(f.write_typed_stream(document))["registration"] == document["registration"]


def test_landmarks_and_named_points():
    data = b"# AmiraMesh 3D ASCII 2.0\ndefine Markers 2\nParameters {\n NumSets 2,\n ContentType \"LandmarkSet\"\n}\nMarkers { float[3] Coordinates } @1\nMarkers { float[3] Coordinates2 } @2\n@1\n1 2 3\n4 5 6\n\n@2\n1.5 2 3\n4 5.5 -6e0\n"
    assert f.read_landmark_sets(data) == [(1, 1, 1.0, 2.0, 3.0), (1, 2, 4.0, 5.0, 6.0), (2, 1, 1.5, 2.0, 3.0), (2, 2, 4.0, 5.5, -6.0)]
    assert f.read_named_points(b'"first point": [ 1.5, 2, -3 ]\nsecond: [4,5,6]\n') == [("first point", 1.5, 2.0, -3.0), ("second", 4.0, 5.0, 6.0)]
