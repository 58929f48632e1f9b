"""Licence scans: ids, bodies and notices inside longer text."""

from quaestor.llm import licences

PROSE = "some words of prose that have nothing to do with it and go on for a good while "


def test_ids_bodies_and_embedded_notices(spark):
    ids = {k: f"x = 1\n# SPDX-License-Identifier: {k}\ny = 2" for k in licences.NAMES} | {"GPL-3.0": "SPDX-License-Identifier: GPL-3.0-or-later"}
    rows = [(k, t) for k, t in ids.items()] + [(k, PROSE * 3 + t.replace(". ", ".\n") + " " + PROSE * 3) for k, t in licences.TEXTS.items()]
    rows += [("MIT", PROSE + "released under the MIT License, " + PROSE), ("AGPL-3.0", PROSE + "licensed under the GNU Affero\nGeneral Public License, version 3 " + PROSE)]
    rows += [(None, PROSE * 5), (None, "SPDX-License-Identifier: Apache-1.1"), (None, PROSE + "released under the old bridge"), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licences.scanned(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [k for k, _ in rows]


def test_no_template_without_an_anchor():
    words = licences.anchors()
    for _, b, least in licences.templates():
        assert sum(not any(w in x for w in words) for x in b) < len(b) * least / (2 - least)
