"""Fixtures with results derived by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marginalia.functions import refs, taxa
from marginalia.operators import abbrev, dates, layout, markup, names, records, repair, tables, tokens, trees, votes
from marginalia.sources import files
from marginalia.streaming import requests


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


VOTES = [("p1", "v1.1", "u1"), ("p1", "v1.2", "u2"), ("p1", "v1.2", "u3"), ("p2", "v2.0", "u3"), ("p2", "v2.0", "u2")]


def test_votes_by_step(spark):
    done = []
    for k in range(1, 6):
        v = spark.createDataFrame([(1, p, x, u, i) for i, (p, x, u) in enumerate(VOTES[:k])], "request int, param string, value string, user string, ord int")
        agreed = votes.agreed(v, 2)
        done.append(votes.complete_requests(agreed).first().complete)
        if k == 4:
            assert [r.value for r in agreed.filter("param = 'p2'").collect()] == [None]
    assert done == [False, False, True, True, True]
    assert {r.param: r.value for r in agreed.collect()} == {"p1": "v1.2", "p2": "v2.0"}


@pytest.mark.parametrize(("f", "cases"), [
    (refs.year, {"1999": "1999", "0999": None, "99": None}),
    (refs.part, {"012": "12", "e7": "e7", "7-9": "7-9", "127-9": "127-129"}),
    (refs.pagination, {"123-7": "123-127", "xii": "12", "1-2-3": None}),
    (refs.doi, {"http://dx.doi.org/10.3897/abc.491.8553": "10.3897/abc.491.8553", "10.3897/abc.491.8553": "10.3897/abc.491.8553", "x": None}),
])
def test_sanitisers(spark, f, cases):
    for given, want in cases.items():
        assert value(spark, f(F.lit(given))) == want


def test_authority_and_name(spark):
    a = value(spark, taxa.split_authority(F.lit("(Clement, 1924)")))
    assert (a.basionym, a.combination) == ("(Clement, 1924)", None)
    p = value(spark, taxa.parse_authority(F.lit("(Clement, 1924)")))
    assert (p.name, p.year) == ("Clement", 1924)
    e = F.create_map(*map(F.lit, ("genus", "Drosophila", "subGenus", "Morrisia", "species", "melanogaster", "subSpecies", "minor")))
    assert value(spark, taxa.name_string(e)) == "Drosophila (Morrisia) melanogaster subsp. minor"
    assert value(spark, taxa.name_string(e, F.lit("Miller 2013"))).endswith("minor Miller 2013")


def test_grid_with_spans(spark):
    rows = [("head", 0, 0, 1, 1, "a"), ("head", 0, 1, 2, 1, "b"), ("head", 0, 2, 1, 1, "c"), ("body", 0, 0, 1, 2, "d"), ("body", 0, 1, 2, 2, "e"), ("body", 0, 2, 1, 1, "f"), ("body", 1, 0, 1, 1, "g"), ("body", 2, 0, 4, 3, "wide"), ("body", 3, 0, 1, 1, "h"), ("foot", 0, 0, 1, 1, "z")]
    cells = spark.createDataFrame([(1, s, r, o, w, h, t) for s, r, o, w, h, t in rows], "table_id long, sec string, r int, ord int, colspan int, rowspan int, text string")
    grid = {(r.r, r.c): r.text for r in tables.grid(cells.orderBy("text")).collect()}
    assert [[grid[r, c] for c in range(4)] for r in range(6)] == [["a", "b", "b", "c"], ["d", "e", "e", "f"], ["d", "e", "e", "g"], ["wide"] * 4, ["h", "", "", ""], ["z", "", "", ""]]


def test_dates(spark):
    docs = spark.createDataFrame([(1, "seen July 6th, 2010 there"), (2, "31-VIII-1996"), (3, "1.vii.2010"), (4, "5. Juli 2010"), (5, "30 February 2010")], "doc_id long, text string")
    got = {r.doc_id: r.value for r in dates.resolve(dates.dates(tokens.tokens(docs))).collect()}
    assert got == {1: "2010-07-06", 2: "1996-08-31", 3: "2010-07-01", 4: "2010-07-05"}
    r = spark.createDataFrame([(1, "July 1st - 5th, 2010")], "doc_id long, text string")
    found = dates.ranges(dates.parts(tokens.tokens(r), "d"), tokens.tokens(r)).first()
    assert (found.value, found.value_max) == ("01", "05")


def test_roman_numbers(spark):
    rows = spark.range(1, 4000).select("id", tokens.roman(F.col("id")).alias("r")).withColumn("v", tokens.roman_value(F.col("r")))
    assert rows.filter("v <> id OR v IS NULL").count() == 0
    assert value(spark, tokens.roman_value(F.lit("IIX"))) is None


def test_author_list(spark):
    docs = spark.createDataFrame([(1, "Doe J, van der Berg K & Smith AB (2011) Title. 34: 47-66"), (2, "no names here")], "doc_id long, text string")
    got = [(r.doc_id, r.value) for r in names.persons(tokens.tokens(docs), ("last initials",)).collect()]
    assert (1, "Doe J") in got and all(d == 1 for d, _ in got)


def test_rules(spark):
    cols = ["author", "year", "title", "journal", "publisher", "location", "volume_title", "volume", "issue", "pagination", "doi"]
    df = spark.createDataFrame([("Doe, J", "2020", "T", "The Journal", None, None, None, "8", "15", "8-15", None), (None, None, "T", None, None, None, None, None, None, None, None)], ", ".join(f"{c} string" for c in cols))
    assert [r.x for r in df.select(records.classify().alias("x")).collect()] == ["journal article", None]
    assert df.select(records.check(F.lit("nothing")).alias("x")).first().x == ["unknown type"]


def test_tree_repair(spark):
    rows = [("a", None, "kingdom", "A"), ("b", "a", "genus", "B"), ("c", "b", "family", "C"), ("d", "c", "species", "D")]
    df = spark.createDataFrame(rows, "id string, parent string, rank string, epithet string")
    assert {r.id: r.parent for r in trees.climb(df).collect()} == {"a": None, "b": "a", "c": "a", "d": "c"}
    assert {r.id: r.parent for r in trees.without(df, F.col("id") == "c").collect()} == {"a": None, "b": "a", "d": "b"}
    gone = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (6, None)], "id long, target long")
    ids = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 6, 7)], "id long")
    assert {r.id: r.target for r in trees.redirect(gone, ids).collect()} == {1: 3, 2: 3, 3: 3, 5: 5, 6: None, 7: 7}


def test_boxes(spark):
    b = layout.box(*map(F.lit, (1, 5, 2, 4)))
    assert value(spark, layout.to_text(b)) == "[1,5,2,4]" and value(spark, layout.from_text(F.lit("[1,5,2]"))) is None
    assert value(spark, layout.intersect(b, layout.moved(b, F.lit(4), F.lit(0)))) is None


def test_numberings(spark):
    assert value(spark, abbrev.combine(F.lit("1-3, 4, 9"))) == "1-4,9" and value(spark, abbrev.combine(F.lit("x"))) == ""
    assert value(spark, abbrev.parse_number(F.lit("zz"), F.lit("roman"))) == -1


def test_meta_and_tiles(spark):
    meta = '<archive><core><field index="2" term="http://x/rank"/><id index="0"/><field index="0" term="http://x/taxonID"/></core></archive>'
    assert files.field_map(meta) == [(0, "taxonID"), (2, "rank")]
    assert files.taxon_schema(files.field_map(meta)).names == ["taxonID", "_1", "rank"]
    line = spark.createDataFrame([("1f/AB\tgenus\tE\ta\t\tabies\t\tb;c\t",)], "value string")
    r = files.parse_data_tile(line).first()
    assert (r.id, r.col_id, r.extant, r.parent, r.valid, r.authority, r.children, r.synonyms) == (31, "AB", True, 10, None, None, [11, 12], [])


def test_folds():
    state: dict = {}
    log = [("q", 1, "add"), ("q", 2, "add"), ("q", 3, "take"), ("q", 4, "cancel"), ("q", 5, "take"), ("q", 6, "flush"), ("q", 7, "take")]
    assert [o for e in log for o in requests.queue_fold(state, e)] == [("q", 3, 1, "taken"), ("q", 4, 1, "requeued"), ("q", 5, 2, "taken"), ("q", 6, 1, "failed")]
    fold, state = requests.checkout_fold(120), {}
    log = [("k", 1, "checkout", 0), ("k", 2, "answer", 60), ("k", 3, "answer", 70), ("k", 4, "checkout", 80), ("k", 5, "answer", 300), ("k", 6, "checkout", 310), ("k", 7, "cancel", 320)]
    assert [o for e in log for o in fold(state, e)] == [("k", 2, "answered"), ("k", 3, "late"), ("k", 5, "timeout"), ("k", 5, "late"), ("k", 7, "cancelled")]
    state = {}
    log = [("d", 1, "a", 1), ("d", 2, "a", 1), ("d", 3, "a", -1), ("d", 4, "a", -1), ("d", 5, "b", -1)]
    assert [o for e in log for o in requests.count_fold(state, e)] == [("d", 1, "a", "added"), ("d", 4, "a", "removed")]


def test_page_numbers_are_repaired(spark):
    rows = [(1, p, v, s) for p, v, s in ((1, 11, 9), (2, 12, 9), (3, 77, 0), (4, 14, 9), (5, None, 0), (6, 16, 9))]
    df = spark.createDataFrame(rows, "doc long, page long, value long, score long")
    assert [r.value for r in layout.repair_numbers(df).orderBy("page").collect()] == [11, 12, 13, 14, 15, 16]


def test_paragraphs(spark):
    edges = [(110, 500), (100, 500), (100, 300), (110, 500), (100, 500), (100, 250)]
    df = spark.createDataFrame([(1, k, *e, 20 * k, 20 * k + 12) for k, e in enumerate(edges)], "page int, line int, bl int, br int, bt int, bb int")
    lines = df.select("page", "line", layout.box(*(F.col(c) for c in ("bl", "br", "bt", "bb"))).alias("box"))
    assert [r.para for r in layout.split_paragraphs(lines, ["page"], 100).orderBy("line").collect()] == [1, 1, 1, 2, 2, 2]


def test_abbreviations_with_a_repeated_key(spark):
    rows = [["Name", "No.", "No."], ["Abc one", "1", "7"], ["Abc two", "2", ""], ["Def", "", "3"]]
    cells = spark.createDataFrame([(1, r, c, t) for r, x in enumerate(rows) for c, t in enumerate(x)], "table_id int, r int, c int, text string")
    got = sorted((r.r, r.key, r.values) for r in tables.abbreviations(cells).select("r", "key", F.col("values")["No."].alias("values")).collect())
    assert got == [(1, "Abc", "1"), (2, "Abc", "2"), (3, "Def", "3")]


FLORA = "id string, parent string, valid string, rank string, epithet string, prefix string, name string, genus string, species string, below string"


def flora(spark, rows):
    return spark.createDataFrame([tuple(r.get(k) for k in ("id", "parent", "valid", "rank", "epithet", "prefix", "name", "genus", "species", "below")) for r in rows], FLORA)


def test_repair_of_parents(spark):
    rows = [
        dict(id="f", parent="k", rank="family", epithet="Formicidae"), dict(id="k", rank="kingdom", epithet="Animalia"), dict(id="o", parent="k", rank="order", epithet="Hymenoptera"),
        dict(id="sf", parent="o", rank="subFamily", epithet="Myrmicinae", name="Myrmicinae Lepeletier"), dict(id="fs", valid="f", rank="family", epithet="Myrmicidae"),
        dict(id="g", parent="f", rank="genus", epithet="Myrmica"), dict(id="gs", valid="g", rank="genus", epithet="Manica"),
        dict(id="sg", parent="f", rank="subGenus", epithet="Oreo", name="Manica (Oreo) Sm.", genus="Manica", below="Oreo"), dict(id="sx", parent="f", rank="subGenus", epithet="Aus", name="Nowhere (Aus)"),
        dict(id="s", parent="gone1", rank="species", epithet="rubra", prefix="Myrmica"), dict(id="ss", parent="s", rank="subSpecies", epithet="alpina", prefix="Myrmica rubra"),
        dict(id="nt", parent="g", rank="subSpecies", epithet="ruga", prefix="Myrmica ruga", genus="Myrmica", species="ruga", below="ruga"), dict(id="ch", parent="nt", rank="subSpecies", epithet="minor"),
        dict(id="inv", parent="s", rank="genus", epithet="Xus"), dict(id="lost", parent="nobody", rank="species", epithet="x"), dict(id="sy", parent="gs", rank="species", epithet="y"), dict(id="un", parent="g", rank="species", epithet="sp_incert"),
    ]
    removed = spark.createDataFrame([("gone1", "gone2"), ("gone2", "g"), ("loop", "loop")], "id string, target string")
    fit = repair.fitted(flora(spark, rows), removed)
    told = {r.id: (r.fit, r.parent, r.earmarked) for r in fit.collect()}
    assert told == {
        "k": ("root", None, False), "f": ("child", "k", False), "o": ("child", "k", False), "sf": ("orphan", None, False), "fs": ("root", None, False), "g": ("child", "f", False), "gs": ("root", None, False),
        "sg": ("orphan", None, False), "sx": ("orphan", None, False), "s": ("child", "g", False), "ss": ("child", "s", False), "nt": ("orphan", None, True), "ch": ("duplicate", "nt", False),
        "inv": ("inverted", "s", False), "lost": ("missing", None, False), "sy": ("synonym parent", "gs", False), "un": ("uncertain", "g", False),
    }
    held = repair.reattached(fit)
    by = {r.id: r for r in held.collect()}
    assert (by["sg"].parent, by["gs"].parent, by["gs"].valid) == ("gs", "f", None)  # a synonym becomes a genus again
    assert by["sx"].parent is None and by["nt"].parent == "g"
    assert by["sf"].parent is None  # the order has no family of that name beneath it
    up = {r.id: (r.rank, r.below, r.prefix) for r in repair.promoted(held).collect()}
    assert up["nt"] == ("species", None, "Myrmica") and up["ch"][0] == "subSpecies"
    plain = {r.id: r.prefix for r in repair.plain_prefixes(held).collect()}
    assert plain["s"] is None and plain["ss"] is None and plain["nt"] == "Myrmica ruga"


def test_split_and_rehung_species(spark):
    rows = [
        dict(id="g", rank="genus", epithet="Abies"), dict(id="sg", parent="g", rank="subGenus", epithet="Pseudo"), dict(id="a", parent="sg", rank="species", epithet="alba", prefix="Abies"), dict(id="b", valid="a", rank="species", epithet="pecta"),
        dict(id="v", parent="g", rank="species", epithet="alba var. nana", prefix="Abies"), dict(id="w", parent="g", rank="species", epithet="pecta minor", prefix="Abies"), dict(id="n", parent="g", rank="species", epithet="no such", prefix="Abies"),
        dict(id="r", parent="g", rank="variety", epithet="tenuis", prefix="Abies alba"),
    ]
    got = {r.id: (r.parent, r.valid, r.rank, r.epithet, r.prefix) for r in repair.split_species(flora(spark, rows)).collect()}
    assert got["v"] == ("a", None, "variety", "nana", "Abies alba") and got["w"] == ("b", None, "subSpecies", "minor", "Abies pecta") and got["n"] == ("g", None, "species", "no such", "Abies")
    assert got["a"][0] == "g" and got["b"][:2] == ("g", None)
    assert {r.id: r.parent for r in repair.rehung(flora(spark, rows)).collect()}["r"] == "a"


def test_ancestry_of_long_chains_and_cycles(spark):
    rows = [(k, k - 1 if k else None) for k in range(150)] + [(500, 501), (501, 502), (502, 500), (600, 600)]
    tree = trees.closure(spark.createDataFrame(rows, "id long, parent long"))
    dist = {(r.desc, r.anc): r.dist for r in tree.collect()}
    assert dist[149, 0] == 149 and dist[500, 500] == 0 and dist[500, 502] == 2 and (600, 600) in dist and len(dist) == 150 * 151 // 2 + 9 + 1


def test_patterns_go_on_until_nothing_changes(spark):
    from marginalia.functions import values

    v = lambda text, patterns: value(spark, values.normalise(F.lit("k"), "f", F.lit(text), {}, {}, [], patterns))
    assert v("aaaaaaaab", [("aa", "$_a_$")]) == "ab"  # seven changes
    assert v("x", [("x", "y"), ("y", "x")]) in ("x", "y")  # a loop ends
    with pytest.raises(Exception, match="without end"):
        v("x", [("x", "$_xx_$")])
    assert value(spark, values.normal_spaces(F.lit("a ´ b ( c )"))) == "a  b (c)"


GENERIC = """<bibRef editor="E, F &amp; G, H"><author affiliation="Bern">Doe, J.</author><author repeatedAuthors="Roe, K. &amp; Poe, L."/><title>On &lt;x&gt;
 y</title><pageData>12-19</pageData><part>3</part><part type="issue">4</part><journalOrPublisher>Zoo: Press</journalOrPublisher><ID type="DOI">10.1/x</ID><ID>no</ID></bibRef>"""


def test_records_in_and_out_of_markup(spark):
    given = spark.createDataFrame([(1, GENERIC), (2, '<bibRef author="A, B &amp; C, D" title="T" type="book" journalOrPublisher="Press, Berlin"/>'), (3, "<bad"), (4, None)], "id int, xml string")
    rows = markup.from_generic(given, "xml")
    old = F.create_map(*map(F.lit, ("bib-old", "1", "own", "2")))
    rows = markup.from_attributes(rows.withColumn("m", markup.to_attributes(F.col("record"), "bib-", old)), "m", "bib-", "back")
    got = {r.id: r for r in markup.from_mods(rows.withColumn("mods", markup.to_mods(F.col("record"))), "mods", "again").collect()}
    one = got[1].record
    assert [(a.name, a.details) for a in one.authors] == [("Doe, J.", {"affiliation": "Bern"}), ("Roe, K.", {}), ("Poe, L.", {})]
    assert one.fields == {"title": "On <x> y", "journal": "Zoo: Press", "pagination": "12-19", "volume": "3", "issue": "4"}
    assert (one.editors, one.ids, one.type) == (["E, F", "G, H"], {"DOI": "10.1/x"}, None)
    assert got[2].record.fields == {"title": "T", "publisher": "Press", "location": "Berlin"}
    assert got[1].m["bib-author-affiliation"] == "Bern &&&  &&& "
    for r in got.values():
        assert r.back == r.record == r.again
        assert r.m["own"] == "2" and "bib-old" not in r.m
    assert got[3].record.authors == [] and got[4].record.fields == {}


def test_mods_of_other_tools(spark):
    xml = """<mods xmlns="http://www.loc.gov/mods/v3"><titleInfo><title>A title</title></titleInfo><name><role><roleTerm type="text">Author</roleTerm></role><namePart>Doe, J.</namePart><nameIdentifier type="ORCID">0-1</nameIdentifier></name>
    <classification>Journal Article</classification><relatedItem type="host"><titleInfo><title>Zoo</title></titleInfo><part><detail type="volume"><number>7</number></detail><detail type="title"><title>Papers</title></detail><extent unit="page"><start>5</start><end>5</end></extent><date>1999</date></part></relatedItem></mods>"""
    r = markup.from_mods(spark.createDataFrame([(xml,)], "xml string"), "xml").first().record
    assert r.fields == {"title": "A title", "journal": "Zoo", "volume": "7", "volumeTitle": "Papers", "pagination": "5", "year": "1999"}
    assert [(a.name, a.details) for a in r.authors] == [("Doe, J.", {"ORCID": "0-1"})] and r.type == "journal article"


def test_names_in_and_out_of_markup(spark):
    e = F.create_map(*map(F.lit, ("genus", "Poa", "section", "Ochlopoa", "species", "annua", "form", "a & b")))
    for simple in (False, True):
        n = value(spark, taxa.from_dwc(taxa.to_dwc(e, F.lit("(L.) Doe"), simple)))
        assert (n.epithets, n.authority) == ({"genus": "Poa", "section": "Ochlopoa", "species": "annua", "form": "a & b"}, "(L.) Doe")
    assert value(spark, taxa.from_dwc(F.lit("<x><y>1</y></x>"))).epithets == {}


def test_cuts_and_clusters_by_path(spark):
    rows = [("k", None, "kingdom", "Kin"), ("p1", "k", "phylum", "One"), ("p2", "k", "phylum", "Two"), ("f1", "p1", "family", "Fa"), ("f2", "k", "family", "Fb"), *((f"s{i}", "f1", "species", "s") for i in range(6)), *((f"t{i}", "p2", "species", "t") for i in range(5))]
    t = spark.createDataFrame(rows, "id string, parent string, rank string, epithet string")
    c = trees.closure(t)
    paths = {r.id: r.path for r in trees.kingdom_paths(c, t).collect()}
    assert paths == {"k": "Kin.Zzz", "p1": "Kin.One.Zzz", "p2": "Kin.Two.Zzz", "f1": "Kin.One.<class>.<order>.Fa.Zzz", "f2": "Kin.<phylum>.<class>.<order>.Fb.Zzz"}
    sizes = {r.id: r.size for r in trees.size_report(c, t, 7).collect()}
    assert sizes == {"k": 16, "p1": 8, "p2": 6, "f2": 1, "f1": 7}
    assert set(r.id for r in trees.size_report(c, t, 17).collect()) == {"k"}
    heavy = t.filter("id not like 't%'")
    assert set(r.id for r in trees.size_report(trees.closure(heavy), heavy, 9).collect()) == {"k"}
    clusters = spark.createDataFrame([("Kin.Zzz", "A"), ("Kin.One.Zzz", "B")], "path string, cluster string")
    got = {r.id: r.cluster for r in trees.assign_cluster_by_path(c, t, clusters).collect()}
    assert (got["k"], got["f1"], got["s0"], got["t0"]) == ("A", "B", "B", "A")
