"""Import resolution stage by stage, and against a plain version."""

import random

from graphloom.operators import imports as I

SCHEMA = "file string, module string, name string, relative boolean, up int"


def plain(files, imports):
    """The four stages, one import after the other."""
    files = sorted({f for f in files if f is not None})
    out = set()
    for file, module, name, relative, up in imports:
        if file is None or name is None:
            continue
        module, up = module or "", up or 0
        folders = file.split("/")[:-1]
        found = None
        if relative:
            base = folders[: len(folders) - up] if up else folders
            base = base + [x for x in module.replace(".", "/").split("/") if x]
            found = next((p for e in (".py", "__init__.py") if (p := "/".join([*base, name + e])) in files), None)
            found = found and (found, 0.95)
        needle = module or name
        if not found:
            found = next(((p, 0.9) for e in ("", ".py") if (p := "/".join([*folders, needle + e])) in files), None)
        if not found and needle:
            found = next(((f, 0.85) for f in files if needle in f), None)
        if not found and name:
            stems = [(f.split("/")[-1].rsplit(".", 1)[0].lower(), f) for f in files]
            near = [(abs(len(name) - len(s)), f) for s, f in stems if s and (name.lower() in s or s in name.lower())]
            found = (min(near)[1], 0.3) if near else None
        if found:
            out.add((file, module, name, bool(relative), up, *found))
    return out


def resolved(spark, files, imports):
    got = I.resolved(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame(imports, SCHEMA))
    return {tuple(r) for r in got.select(*I.KEY, "target", "confidence").collect()}


def test_stages(spark):
    files = ["src/a/x.py", "src/b/y.py", "src/b/util__init__.py", "lib/deep/helper_tools.py", "top.py", "lib/deep/helper_tools.py", None, "src/a/README"]
    asks = [
        ("src/a/x.py", "b", "y", True, 1),  # a folder above, then down
        ("src/b/y.py", "", "util", True, 0),  # the package's own file
        ("src/a/x.py", "README", "z", False, 0),  # as it stands
        ("src/b/y.py", "y", "z", False, None),  # with .py
        ("top.py", None, "top", False, 0),  # a file without a folder
        ("src/a/x.py", "deep/helper", "z", False, 0),  # part of a path
        ("src/a/x.py", "no such", "My_Y_2", False, 0),  # a stem in the name
        ("src/a/x.py", "no such", "LPER_TOO", None, 0),  # a name in a stem
        ("src/a/x.py", "no such", "qqq", False, 0),  # nothing
        ("src/a/x.py", "b", "y", True, 1),  # again
        (None, "b", "y", True, 1),
        ("src/a/x.py", "b", None, True, 1),
    ]
    got = resolved(spark, files, asks)
    assert got == plain(files, asks) and len(got) == 8
    assert {r[-1] for r in got} == {0.95, 0.9, 0.85, 0.3}


def test_random(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abAB_") for _ in range(r.randint(1, n)))
    files = ["/".join([*(r.choice("pq") for _ in range(r.randint(0, 2))), word(5) + r.choice([".py", ".ts", ""])]) for _ in range(40)]
    asks = [(r.choice(files), r.choice([None, "", "p", word(6)]), word(8), r.random() < 0.3, r.randint(0, 1)) for _ in range(150)]
    assert resolved(spark, files, asks) == plain(files, asks)
    assert resolved(spark, [], asks) == set() and resolved(spark, files, asks[:0]) == set()
