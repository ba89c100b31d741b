"""Packaged sections by joins, against loops over their elements."""

import random

import pytest

from quirespark.operators import packages
from quirespark.sources import object_graph, sync_package
from quirespark.sources.cabinet import FormatError
from quirespark.sources.property_sets import GraphLimits
from tests import package_loop
from tests import section_writer as W
from tests.test_convert import PAGES, spaces


def package():
    return sync_package.read_package(W.packaged(spaces(False, **PAGES), [("blob", b"picture")], {(name, 23): "blob" for name in PAGES}))


def shuffled(found, rng):
    """The same elements with repeated, missing and turned maps, chains and groups."""
    found.cell_map = [c for c in rng.sample(found.cell_map, len(found.cell_map)) for _ in range(rng.randrange(1, 3))]
    revisions = list(found.revisions.items())
    for own, (revision, base, roots, groups) in revisions:
        if rng.random() < 0.4:  # a chain onto any revision, itself too
            base = rng.choice(revisions)[1][0]
        found.revisions[own] = (revision, base, roots, groups + rng.sample(groups, rng.randrange(2)) + [rng.choice(revisions)[1][3][0]] * (rng.random() < 0.3))
    found.revision_map = found.revision_map + [(rng.choice(found.revision_map)[0], rng.choice(found.revision_map)[1]) for _ in range(2)]
    for own, (declared, values) in list(found.groups.items()):
        if rng.random() < 0.3:
            found.groups[own] = (declared + declared[:3], values[: len(values) - rng.randrange(3)] + values[:2])


def changed(found, rng, what):
    own = rng.choice([g for g, (_, values) in found.groups.items() if any(v[0] for v in values)])
    declared, values = found.groups[own]
    at = rng.choice([k for k, v in enumerate(values) if v[0]])
    ids, cells, data, blob = values[at]
    if what == "count":
        values[at] = (ids[:-1], cells, data, blob)
    elif what == "more":
        values[at] = (ids + [ids[0]], cells, data, blob)
    elif what == "ordinal":
        values[at] = ([ids[0].rsplit(":", 1)[0] + ":250", *ids[1:]], cells, data, blob)
    elif what == "null":
        values[at] = ([sync_package.NIL, *ids[1:]], cells, data, blob)
    elif what == "type":
        k = rng.choice([k for k, d in enumerate(declared) if d[2] == sync_package.TYPE])
        values[k] = (*values[k][:2], b"abc", None)
    elif what == "stream":
        values[at] = (ids, cells, b"\x01", blob)
    elif what == "properties":
        values[at] = (ids, cells, data[:-1], blob)


def loop_rows(found, limits):
    try:
        graph = package_loop.graph_of(found, object_graph.Graph, object_graph.Revision, object_graph.Object, limits)
        return [{"section": None, "other": None, "context": None, "space": None, "number": None, "flag": None, "count": None, "data": None, "extension": None, "properties": None} | r for r in object_graph.graph_rows(graph)]
    except FormatError as e:
        return e.code


def test_joins_equal_loops(spark, monkeypatch):
    made, limits = {"plain": package()}, GraphLimits()
    for seed in range(8):
        made[f"turned {seed}"] = found = package()
        shuffled(found, random.Random(seed))
    for what in ("count", "more", "ordinal", "null", "type", "stream", "properties"):
        for seed in (1, 2):
            made[f"{what} {seed}"] = found = package()
            changed(found, random.Random(seed), what)
    made["two faults"] = found = package()
    changed(found, random.Random(3), "type")
    changed(found, random.Random(4), "count")
    rows = []
    for section, found in made.items():
        monkeypatch.setattr(sync_package, "read_package", lambda data, p=found: p)
        rows += [{"section": section} | r for r in sync_package.package_rows(b"")]
    columns = object_graph.ROWS.names
    parts = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], object_graph.SCHEMA).repartition(3)
    told = {k: v.collect() for k, v in packages.package_relations(parts, limits).items()}
    codes = {r.section: r.code for r in told["faults"]}
    for section, found in made.items():
        expected = loop_rows(found, limits)
        if isinstance(expected, str):
            assert codes.get(section) == expected, section
            assert not any(r.section == section for k, v in told.items() if k != "faults" for r in v)
            continue
        assert section not in codes, (section, codes)
        of = lambda part, e=expected: [r for r in e if r["part"] == part]
        own = lambda name, s=section: [r for r in told[name] if r.section == s]
        assert sorted((r.rev_ord, r.rev_id, r.dep_id, r.context_id, r.space_id, r.is_encrypted) for r in own("revisions")) == [(r["ord"], r["id"], r["other"], r["context"], r["space"], r["flag"]) for r in of("revision")], section
        assert sorted((r.rev_ord, r.assoc_ord, r.rev_id, r.space_id, r.role) for r in own("roles")) == sorted((r["count"], r["ord"], r["id"], r["space"], r["number"]) for r in of("role")), section
        assert sorted((r.rev_id, r.root_ord, r.role, r.object_id) for r in own("roots")) == sorted((r["id"], r["ord"], r["number"], r["other"]) for r in of("root")), section
        objects = sorted((r.obj_ord, r.object_id, r.rev_id, r.jcid, r.is_revision, r.ref_count, r.file_ref, r.file_ext) for r in own("objects"))
        assert objects == [(r["ord"], r["id"], r["other"], r["number"], r["flag"], r["count"], r["space"], r["extension"]) for r in of("object")], section
        properties = {r.obj_ord: None if r.properties is None else [p.asDict() for p in r.properties] for r in own("objects")}
        assert properties == {r["ord"]: r["properties"] for r in of("object")}, section
        assert sorted((r.key, bytes(r.payload)) for r in own("payloads")) == sorted((r["id"], r["data"]) for r in of("payload")), section
    assert len(set(codes.values())) >= 4


def test_object_limit(spark):
    data = W.packaged(spaces(False, a={}))
    graph = object_graph.relations(spark.createDataFrame([("s", data)], "section string, content binary"), limits=GraphLimits(objects=3))
    assert [r.code for r in graph.faults.collect()] == ["ONENOTE_OBJECT_LIMIT"] and graph.objects.count() == 0


@pytest.mark.parametrize("rows", [[("s", b"junk")], []])
def test_nothing_packaged(spark, rows):
    graph = object_graph.relations(spark.createDataFrame(rows, "section string, content binary"))
    assert graph.faults.count() == len(rows) and graph.revisions.count() == 0
