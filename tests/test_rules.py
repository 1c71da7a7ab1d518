"""Rules written by hand: fragments that exclude, roots by machine."""

from tallymark.operators import fleet
from tallymark.sources import rules


def test_exclusions(spark):
    docs = spark.createDataFrame([("a", '{"paths": ["Client", " ", "", 5, null, "a\\"b"]}'), ("b", '{"paths": ["cLIENT", ".x"]}'), ("c", "{broken"), ("d", "[1]"), ("e", '{"paths": "no list"}'), ("f", None)], "path string, content string")
    assert sorted(r.fragment for r in rules.exclusions(docs).collect()) == [".x", "Client", 'a"b']
    files = spark.createDataFrame([("/h/CLIENTS/1",), ("/h/b.X",), ('/h/A"B/c',), ("/h/fine",), (None,), ("/h/fine",)], "file string")
    assert sorted(str(r.file) for r in rules.scanned(files, "file", docs).collect()) == ["/h/fine", "/h/fine", "None"]
    assert rules.scanned(files, "file", docs.limit(0)).count() == 6 and rules.scanned(files.limit(0), "file", docs).count() == 0


def test_fragments_equal_every_pair(spark):
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abAB.") for _ in range(n))
    texts, needles = [word(rng.randint(0, 30)) for _ in range(150)], [word(rng.choice([0, 2, 3, 4, 5, 8, 12])) for _ in range(12)]
    got = fleet.without_fragments(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n")
    assert sorted(r.t for r in got.collect()) == sorted(t for t in texts if not any(n and n.lower() in t.lower() for n in needles))


def test_roots(spark):
    homes = spark.createDataFrame([("m", "/Home/a"), ("n", "/h"), ("o", "/o")], "machine string, home string")
    docs = spark.createDataFrame([("m", '{"extra_roots": [" /b ", "/home/A", "/B", 3, ""], "more": 1}'), ("n", "null")], "machine string, content string")
    got = [(r.machine, r.seq, r.root) for r in rules.effective_roots(homes, docs, ["/c", "/b"]).orderBy("machine", "seq").collect()]
    assert got == [("m", 0, "/Home/a"), ("m", 1, "/b"), ("m", 2, "/c"), ("n", 0, "/h"), ("n", 1, "/c"), ("n", 2, "/b"), ("o", 0, "/o"), ("o", 1, "/c"), ("o", 2, "/b")]
