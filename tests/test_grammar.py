"""Accepted and refused forms of versions and requirements."""

from driftwood.functions import scalars as fn


def test_versions(spark):
    want = {
        "1.0": "1.0", "v1.0": "1.0", "01.002": "1.2", "1!2.0": "1!2.0", "0!2": "2", "1.0a": "1.0a0", "1.0.ALPHA.1": "1.0a1", "1.0-beta-2": "1.0b2", "1.0c3": "1.0rc3", "1.0pre": "1.0rc0", "1.0-1": "1.0.post1", "1.0post": "1.0.post0",
        "1.0.r5": "1.0.post5", "1.0.dev": "1.0.dev0", "1.0a1.post2.dev3+Ubuntu-01": "1.0a1.post2.dev3+ubuntu.1", " 1.0 \n": "1.0", "1.0+abc.7": "1.0+abc.7",
        "1.0-final": "1.0.final", "v1_x": "1.x", "Release--7": "release.7", "1..0": "1.0", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "raw string")
    got = {r.raw: r.v for r in rows.select("raw", fn.version(rows.raw).alias("v")).collect()}
    assert got == want | {None: None}


def test_requirements(spark):
    want = {
        "Foo.Bar_baz": ("foo-bar-baz", "", "", "", "", False), "foo>=1,<2": ("foo", "", "", "<2,>=1", "", False), "foo [b, A] == 1.0 ; extra == 'x'": ("foo", "a,b", "", "==1.0", "extra == 'x'", True),
        "foo @ https://e.org/x.zip; os_name == 'nt'": ("foo", "", "https://e.org/x.zip", "", "os_name == 'nt'", False), "foo (~=1.2) # note": ("foo", "", "", "~=1.2", "", False),
        "# foo": None, "-e .": None, "git+https://e.org/foo": None, "https://e.org/x.zip": None, "foo =< 1": None, "": None, "foo bar": None,
    }
    rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "raw string")
    got = {r.raw: r.p and tuple(r.p) for r in rows.select("raw", fn.requirement_parts(rows.raw).alias("p")).collect()}
    assert got == want | {None: None}
