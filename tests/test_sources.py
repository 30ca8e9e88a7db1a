import bz2
import sqlite3

from textloom.operators import mentions, trees
from textloom.plans import pipeline
from textloom.sources import dump, files, sqlite
from textloom.streaming import resume

PAGE = "<page>\n<title>{}</title>\n<ns>0</ns>\n<id>{}</id>\n<revision>\n<id>9</id>\n<text xml:space=\"preserve\">{}</text>\n</revision>\n</page>\n"


def write_dump(path):
    pages = [("Lyon", 1, "Ville.\nMarie habite [[Lyon]]. Paul aime Rome beaucoup."), ("Catégorie:X", 2, "a\nb"), ("Renvoi", 3, "#REDIRECT [[Lyon]]\nx"), ("Nice", 4, "Ville.\nAnne voit Rome. [[Catégorie:Ville]]")]
    path.write_bytes(bz2.compress(("<mediawiki>\n" + "".join(PAGE.format(*p) for p in pages) + "</mediawiki>").encode()))
    return str(path)


def test_dump_and_pipeline(spark, tmp_path):
    path = write_dump(tmp_path / "pages.xml.bz2")
    kept = dump.articles(dump.accepted(dump.read_pages(spark, path)), "http://w/", "fr")
    assert sorted((r.title, r.url, r.cats) for r in kept.collect()) == [("Lyon", "http://w/Lyon", []), ("Nice", "http://w/Nice", ["Ville"])]
    assert [(r.source, r.target_surface_form) for r in dump.link_edges(kept, "http://w/").collect() if r.source == "Lyon"] == [("Lyon", "Lyon")]
    links = spark.createDataFrame([("Marie", "kb/Q1"), ("Lyon", "kb/Q2"), ("Paul", "kb/Q3"), ("Rome", "kb/Q4"), ("Anne", "kb/Q5")], "lemma string, item string")
    triples = spark.createDataFrame([("kb/Q1", "kb/P1", "kb/Q2")], "s string, p string, o string")
    names = spark.createDataFrame([("kb/P1", "habite")], "p string, name string")

    def provider(sents):
        found = mentions.capitalised(sents, "id_article", "pos")
        return found.selectExpr("id_article", "pos", "start", "`end`", "surface_form", "regexp_replace(surface_form, '[.]', '') AS wiki_id", "'' AS entity_type")

    for _ in range(2):  # the second run finds nothing to do
        out = pipeline.build(spark, path, str(tmp_path / "out"), provider, links, triples, names, 10, "http://w/")
        rows = sorted((r.surface_form1, r.surface_form2, r.relation_name or "") for r in out.collect())
        assert ("Marie", "Lyon", "habite") in rows and ("Anne", "Rome", "") in rows and len(rows) == len(set(rows))
    # " Marie habite Lyon." is parsed as Marie <- habite -> Lyon
    said = spark.read.parquet(str(tmp_path / "out/sentences")).where("sentence LIKE '%Marie habite%'").first()
    parse = [(1, "Marie", "marie", "PROPN", 2, "nsubj"), (2, "habite", "habiter", "VERB", 0, "ROOT"), (3, "Lyon.", "lyon", "PROPN", 2, "dobj"), (4, "Lyon", "lyon", "PROPN", 2, "dobj")]
    tokens = spark.createDataFrame([(said.id_article, said.pos, *t) for t in parse], "id_article string, sentence_no long, idx long, word string, lemma string, pos string, head long, rel string")
    made = pipeline.features(spark, str(tmp_path / "out"), tokens)
    xu, ours = ({(r.entity1, r.entity2): r for r in made[k].collect()} for k in ("xu", "ours"))
    pair = next(p for p in xu if p[0] == "Marie")
    assert xu.keys() == ours.keys() and len(xu) == len(rows) and made["ours"].columns == [*trees.OURS]
    assert (ours[pair].shortest_dependency_path_w, ours[pair].shortest_dependency_path_p, ours[pair].shortest_dependency_path_t) == (("habiter", "ROOT", "VERB") if pair[1] == "Lyon" else (None, None, None))
    assert (xu[pair].are_related, xu[pair].relation) == (1, "kb/P1") and xu[pair].word_path1 == ("Marie/habite" if pair[1] == "Lyon" else None)
    assert set(pipeline.features(spark, str(tmp_path / "out"), tokens, "xu", made["ours"].limit(1))) == {"xu"} and pipeline.features(spark, str(tmp_path / "out"), tokens, "xu", made["ours"].limit(1))["xu"].count() == 1


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE entities (surface_form TEXT, start INTEGER)")
        con.executemany("INSERT INTO entities VALUES (?, ?)", [(f"e{i}", i) for i in range(100)])
    df = sqlite.read_table(spark, path, "entities", 4)
    assert df.columns == ["rowid", "surface_form", "start"] and df.count() == 100 and df.selectExpr("sum(start)").first()[0] == 4950
    more = df.select("surface_form", "start").repartition(3)
    sqlite.append_table(more, path, "entities", batch=7)
    assert sqlite.read_table(spark, path, "entities").selectExpr("count(*)", "count(DISTINCT start)", "sum(start)").first() == (200, 100, 9900)
    sqlite.append_table(spark.createDataFrame([(1, 0.5, None)], "a long, b double, c string"), path, "other")
    assert [tuple(r) for r in sqlite.read_table(spark, path, "other").collect()] == [(1, 1, 0.5, None)] and sorted(p.name for p in tmp_path.iterdir()) == ["x.db"]


def test_files(spark, tmp_path):
    row = (1, 2, "a", 'b "q"', "lieu", None, "x", "y", "z", "line\ntwo", 7, None)
    files.write_features(spark.createDataFrame([row], files.FEATURES_OURS), str(tmp_path / "f"))
    got = files.read_features(spark, str(tmp_path / "f")).first()
    assert got.entity2 == 'b "q"' and got.original_sentence == "line\ntwo" and got.relation == "" and got.ent2type == ""
    files.write_ids(spark.createDataFrame([(3,), (1,)], "id long"), str(tmp_path / "ids"))
    assert sorted(r[0] for r in files.read_ids(spark, str(tmp_path / "ids")).collect()) == [1, 3]
    (tmp_path / "vectors.txt").write_text("2 3\nle 0.5 1 -2\nété 1 2 3\n")
    assert {r.word: r.vec for r in files.read_vectors(spark, str(tmp_path / "vectors.txt")).collect()} == {"le": [0.5, 1, -2], "été": [1, 2, 3]}


def test_widened(spark):
    old = spark.createDataFrame([(1, "a", 2)], "id int, x string, more int")
    got = files.widened(old, "id long, relation_id string, x string")
    assert got.dtypes == [("id", "bigint"), ("relation_id", "string"), ("x", "string"), ("more", "int")] and tuple(got.first()) == (1, None, "a", 2)


def test_stage(spark, tmp_path):
    """Keys of which nothing comes are not asked for again."""
    rows, asked = spark.range(6).withColumnRenamed("id", "k"), []

    def odd(df):
        asked.append(sorted(r.k for r in df.collect()))
        return df.where("k % 2 = 1")

    for n in (4, 4, 6):
        assert resume.stage(rows.where(f"k < {n}"), str(tmp_path / "t"), "k", odd).count() == n // 2
    assert asked == [[0, 1, 2, 3], [], [4, 5]]


def test_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(5)
    for n in (5, 10):
        rows.write.mode("append").parquet(source)
        resume.stream(spark, source, rows.schema, target, str(tmp_path / "check"), lambda df: df)
        assert spark.read.parquet(target).count() == n
