import duckdb
import pytest
from license_texts import TEXTS, forms
from oddities import ROWS

from weblode.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
CASES = [
    ("Released under the MIT License.", "mitRef", "MIT", 0),
    ("Some words. Licensed under the Apache License, Version 2.0.\nMore words. Licensed under CC BY-NC 4.0. End.", "apacheRef,ccByNc", "Apache-2.0,CC-BY-NC-4.0", 0),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl3Ref", "GPL-3.0", 0),
    (BSD, "bsdGrant,bsdSource,bsdBinary", "BSD-2-Clause", 0),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsdSource", "", 1),
    ("ALL RIGHTS RESERVED. all rights reserved.", "allRights,allRights", "All-Rights-Reserved", 0),
    ("Nothing here.", "", "", 0),
    ("We released under the MIT license nothing at all.", "", "", 0),
]


@pytest.mark.parametrize("text, ids, names, left", CASES)
def test_cases(documents, text, ids, names, left):
    r = licenses.scan(documents((1, text))).first()
    assert (r.sentence_ids, r.licenses, r.n_unmatched) == (ids, names, left)


def test_same_as_sql(documents):
    rows = [*ROWS, *[(100 + i, c[0]) for i, c in enumerate(CASES)], (200, MIT)]
    rows += [(300 + i, t) for i, t in enumerate([f for _, text in TEXTS.values() for f in forms(text)])]
    rows += [(1000 + i, t) for i, t in enumerate(["\n \n\n", ": : ;\n:\n", "\n\n# MIT License.\n#\n", "a.b. c+ d++.\n...\n. x", "H S h s", "Licensed\n\nunder the MIT License", "MIT License: MIT License; MIT License"])]
    df = licenses.scan(documents(*rows))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    rel = con.execute(licenses.sql())
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in df.select(names).collect()), key=key) == sorted(rel.fetchall(), key=key)
    assert licenses.scan(documents((1, "x")).filter("false")).count() == 0


def test_identifiers_of_rules_are_known():
    assert {x for _, run in licenses.RULES for x in run} <= set(licenses.SENTENCES)
    texts = [t for ts in licenses.SENTENCES.values() for t in ts]
    assert len(texts) == len(set(texts))


def test_no_python_and_no_shuffle(documents):
    plan = licenses.scan(documents((1, "x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", TEXTS)
def test_texts_as_they_stand_in_files(documents, name):
    licence, text = TEXTS[name]
    got = licenses.scan(documents(*enumerate(forms(text)))).collect()
    assert [(r.doc_id, r.licenses, r.n_unmatched) for r in sorted(got)] == [(i, licence, 0) for i in range(len(got))]


def test_a_blank_line_ends_a_sentence(documents):
    r = licenses.scan(documents((1, "Licensed\n\nunder the MIT License"))).first()
    assert (r.n_sentences, r.sentence_ids, r.n_hints) == (2, "", 2)


def test_size_of_the_tables():
    assert len(licenses.known()) >= 60 and len(licenses.RULES) >= 40


def test_long_runs_of_marks(documents):
    """Marks without words, a million of them, are gone over once."""
    text = "MIT License" + "\n" * 300_000 + ": " * 300_000 + ". " * 200_000 + "\n#" * 200_000 + "\nMIT License"
    r = licenses.scan(documents((1, text))).first()
    assert (r.n_sentences, r.sentence_ids) == (2, "mitTitle,mitTitle")
