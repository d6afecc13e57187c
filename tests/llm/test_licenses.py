"""Licence scans: templates, running text and inheritance."""

from depscope.llm import licenses as L

MIT, APACHE, GPL = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."


def _scan(spark, rows):
    files = spark.createDataFrame([(p, t, "x") for p, t in rows], "path string, text string, license string")
    return {r.path: (r.license, r.effective, r.inherited_from) for r in L.scan(files).collect()}


def test_nearest_directory_wins(spark):
    rows = [
        ("a/LICENSE", MIT), ("a/b/COPYING.txt", GPL), ("a/x.py", "print(1)"), ("a/b/c/d/y.py", None), ("a/bb/z.py", ""), ("q.py", "no words"),
        ("a/b/own.py", "code here\n# " + APACHE + "\nmore code"), ("LICENSEE", "not a licence file"), ("a/c/LICENSE", "nothing known at all"), ("a/c/w.py", "x"),
    ] + [(f"noise/{i}.txt", f"some other text with the number {i} in it") for i in range(50)]
    got = _scan(spark, rows)
    assert got["a/x.py"] == (None, "MIT", "a") and got["a/b/c/d/y.py"] == (None, "GPL-3.0", "a/b") and got["a/bb/z.py"] == (None, "MIT", "a")
    assert got["a/b/own.py"] == ("Apache-2.0", "Apache-2.0", None) and got["q.py"] == (None, None, None)
    assert got["a/c/w.py"] == (None, "MIT", "a") and got["a/LICENSE"] == ("MIT", "MIT", None)


def test_every_template_finds_itself(spark):
    rows = [(f"{name}/{i}.txt", text) for name, texts in L.TEMPLATES.items() for i, text in enumerate(texts)] + [(f"noise/{i}", f"word{i} " * 30) for i in range(100)]
    got = _scan(spark, rows)
    for name, texts in L.TEMPLATES.items():
        for i, text in enumerate(texts):
            anchored = any(a in text.lower() for a in L.ANCHORS)
            assert got[f"{name}/{i}.txt"][0] == (name if anchored else None), (name, i)


def test_running_text_is_no_notice(spark):
    prose = "The committee gave its permission after a long debate about fishing in the lake and the license of the old mill, as was agreed by the members of the council"
    got = _scan(spark, [("a.txt", prose)] + [(f"n/{i}", f"words {i} and more") for i in range(60)])
    assert got["a.txt"][0] is None


def test_nulls_repeats_and_empty(spark):
    files = spark.createDataFrame([(None, MIT), (None, None), ("d/LICENSE", MIT), ("d/LICENSE", MIT), ("d/e", "x " * 50_000)], "path string, text string")
    got = sorted(((r.path or "", r.license or "", r.effective or "") for r in L.scan(files).collect()))
    assert len(got) == 5 and got.count(("d/LICENSE", "MIT", "MIT")) == 2 and ("d/e", "", "MIT") in got
    assert L.scan(files.limit(0)).count() == 0


def _wrapped(text, mark, width=70):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line = f"{line} {word}".strip()
    return "\n".join(f"{mark} {x}".rstrip() for x in [*lines, line])


def test_wrapped_headers_of_several_marks(spark):
    noise = [(f"noise/{i}", f"some other text with the number {i} in it") for i in range(300)]
    rows, expected = list(noise), {}
    for name, texts in L.TEMPLATES.items():
        for i, text in enumerate(texts):
            if not any(a in text.lower() for a in L.ANCHORS):
                continue
            for k, mark in enumerate(("#", "//", " *", "")):
                path = f"{name}/{i}-{k}.x"
                body = _wrapped(text, mark)
                rows.append((path, f"{body}\n{'import x' if mark else ''}\n\nx = 1\n"))
                expected[path] = name
    got = _scan(spark, rows)
    assert {p: got[p][0] for p in expected} == expected


def test_spdx_lines(spark):
    rows = [("a.c", "/* SPDX-License-Identifier: MIT */\nint x;"), ("b.c", "// SPDX-License-Identifier: GPL-3.0-or-later"), ("c.c", "# spdx-license-identifier: (apache-2.0 OR MIT)"),
            ("d.c", "// SPDX-License-Identifier: Unheard-Of"), ("e.c", None), ("f/LICENSE", "SPDX-License-Identifier: ISC\n"), ("f/g.c", "x")]
    got = _scan(spark, rows)
    assert [got[p][0] for p in ("a.c", "b.c", "c.c", "d.c", "e.c")] == ["MIT", "GPL-3.0", "Apache-2.0", None, None]
    assert got["f/g.c"] == (None, "ISC", "f")


def test_licence_files_of_any_length_and_given_ids(spark):
    long = MIT + "\n\n" + "\n\n".join(" ".join(f"w{i}x{j}" for j in range(40)) for i in range(60))
    docs = [(-5, long), (None, MIT), (None, MIT), (-4, "plain"), (2, "x"), (3, None)] + [(i, f"other words {i}") for i in range(10, 60)]
    frame = spark.createDataFrame([(i, t, "en2", "s") for i, t in docs], "doc_id long, text string, lang string, source string")
    got = L.scan(L.document_paths(frame), keep=["doc_id"]).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in docs), key=repr)
    by = {r.doc_id: r for r in got}
    assert by[-5].license == "MIT" and by[-5].path == "s/en2/part--1/LICENSE--5"
    assert (by[-4].effective, by[-4].inherited_from) == ("MIT", "s/en2/part--1") and by[None].license == "MIT" and by[2].effective is None


def test_ties_go_to_the_first_name(spark):
    rows = [("d/LICENSE-a", MIT), ("d/LICENSE-b", GPL), ("d/x", "code")] + [(f"n/{i}", f"text {i}") for i in range(80)]
    assert _scan(spark, rows)["d/x"] == (None, "GPL-3.0", "d")
