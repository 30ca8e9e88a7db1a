"""Small cases with results worked out by hand."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from textloom.functions import chain, sentences, wikitext
from textloom.operators import encode, evaluate, graph, kb, mentions, pairs, properties, sampling, splits, trees
from textloom.operators.running import running_total
from textloom.plans.table_queries import FOX, dep_tree_rows, graph_centrality, graph_edges


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


def test_sentences(spark):
    cases = {
        "M. Dr. Smith va à Paris. Il dort!": [("M.", 0, 2), (" Dr.", 2, 6), (" Smith va à Paris.", 6, 24), (" Il dort!", 24, 33), ("", 0, 0)],
        "Version 1.2.3 sortie.": [("Version 1.2.3 sortie.", 0, 21), ("", 0, 0)],
        "Fin...": [("Fin.", 0, 4), (".", 3, 4), (".", 3, 4), ("", 0, 0)],
        "chez P.C.L. Au cours de": [("chez P.C.L.", 0, 11), (" Au cours de", 11, 23)],
        "voir example.com ici": [("voir example.com ici", 0, 20)],
        "U.S.A. est": [("U.S.A. est", 0, 10)],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    rows = sentences.sentences(df).orderBy("doc_id", "pos").collect()
    for i, want in enumerate(cases.values()):
        assert [(r.sentence, r.start, r.end) for r in rows if r.doc_id == i] == want


def test_wikitext(spark):
    cases = {"{{s-|XX}}": "XXe siècle", "{{unité|5|km}}": "5 km", "{{lang|en|foo}}": "foo", "[[Page]]": "Page", "[[Page|label]]": "label", "{{s2-|XX|e|XXI}}": "XXe-XXIe siècles"}
    for text, want in cases.items():
        assert one(spark, text, wikitext.clean) == want
    assert one(spark, "== Histoire ==", lambda c: chain.run(c, wikitext.HEADINGS)) == "\n Histoire.\r\n"
    assert one(spark, "* [http://a b] y", lambda c: chain.run(c, wikitext.BULLETS)) == ""
    assert one(spark, "* [[A]] x", lambda c: chain.run(c, wikitext.BULLETS)) == "* [[A]] x"


def test_annotations(spark):
    got = one(spark, "Le [[Rhône|fleuve]] et [[Lyon]].", wikitext.annotations)
    assert [(a.uri, a.surface_form, a.offset) for a in got] == [("Rhône", "fleuve", 3), ("Lyon", "Lyon", 13)]


def test_titles(spark):
    for title, want in {"Catégorie:X": True, "1984 en musique": True, "12 Monkeys": False, "Chronologie de la France": True, "Liste d'abréviations": True, "Paris": False}.items():
        assert one(spark, title, wikitext.rejected) is want
    assert one(spark, "émile (x)", lambda c: wikitext.url(c, "w/")) == "w/Émile_(x)"
    assert one(spark, "émile (x)", lambda c: wikitext.url(c, "w/", quote=True)) == "w/%C3%A9mile_(x)"


def test_capital(spark):
    """Every letter becomes one letter, as DuckDB has it."""
    letters = [chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000]
    got = spark.createDataFrame([(c,) for c in letters], "c string").select("c", wikitext.capital(F.col("c")).alias("u")).collect()
    want = dict(duckdb.sql("SELECT chr(i::INT) AS c, upper(chr(i::INT)) FROM range(1, 69632) t(i) WHERE i NOT BETWEEN 55296 AND 57343").fetchall())
    assert {r.c: r.u for r in got if r.u != want[r.c]} == {}
    assert one(spark, "ßa", lambda c: wikitext.url(c, "")) == "ẞa"


def test_mentions(spark):
    df = spark.createDataFrame([("Paris,", 6), ("U.S.", 4), ("etc..", 5), ("1.5", 3)], "s string, e long")
    surface, end = mentions.normalised(F.col("s"), F.col("e"))
    assert [tuple(r) for r in df.select(surface, end).collect()] == [("Paris", 5), ("U.S.", 4), ("etc", 4), ("1.5", 3)]
    assert one(spark, "Antoine de Saint-Exupéry", mentions.tokens) == ["Antoine", "de", "Saint", "Exupéry"]
    reply = '{"annotations":[{"start":0,"end":5,"entiteForme":"Paris","wikiId":"Paris","scoreWiki":0.9,"entiteType":"lieu"},{"start":9,"end":11,"entiteForme":"Il","wikiId":"Il","scoreWiki":0.6}]}'
    got = mentions.from_reply(spark.createDataFrame([(1, reply)], "k long, r string"), "r", "k").collect()
    assert [(r.wiki_id, r.entity_type) for r in got] == [("Paris", "lieu"), ("", "")]
    text = "Jeanne d'Arc et Saint-Denis ici"
    rows = [(1, text, 0, 8, "personne"), (1, text, 9, 12, "lieu"), (1, text, 16, 21, "a"), (1, text, 22, 27, "b")]
    m = mentions.merged(spark.createDataFrame(rows, "k long, text string, start long, end long, entity_type string"), "text", "k").orderBy("start").collect()
    assert [(r.surface_form, r.entity_type) for r in m] == [("Jeanne d'Arc", "lieu"), ("Saint-Denis", "b")]


def test_table_function(spark):
    df = spark.createDataFrame([(1, "Anne et Paul"), (2, "rien"), (3, None)], "k long, sentence string")

    def find(text):
        import re

        return [(m.start(), m.end(), m.group(), "", "personne") for m in re.finditer("[A-Z][a-z]+", text)]

    got = mentions.provided(df, find, "k")
    assert sorted((r.k, r.start, r.surface_form) for r in got.collect()) == [(1, 0, "Anne"), (1, 8, "Paul")]


def test_tagged(spark):
    reply = '{"tokens":[{"word":"Anne","lemma":"Anne","pos":"PROPN","ner":"PERSON"},{"word":"dort","lemma":"dormir","pos":"VERB"}]}'
    df = spark.createDataFrame([(1, reply)], "k long, r string")
    assert [tuple(r) for r in graph.tagged(df, "r", "k").collect()] == [(1, 1, "Anne", "PROPN"), (1, 2, "dort", "VERB")]
    assert [r.tag for r in graph.tagged(df, "r", "k", tag="ner").collect()] == ["PERSON", None]


def test_pairs(spark):
    df = spark.createDataFrame([(1, s, s + 3, n) for s, n in ((0, "a"), (10, "b"), (20, "c"), (30, "d"))], "k long, start long, end long, name string")
    found = pairs.near(df, ["k"], ["end"], ["start", "name"])
    assert {(r.name1, r.name2) for r in found.collect()} == {("d", "c"), ("c", "b"), ("b", "a"), ("d", "b"), ("c", "a"), ("d", "a")}
    assert all(r.start1 < r.start2 for r in pairs.oriented(found, ["start", "name"]).collect())


def test_sampling(spark):
    rows = [(i, "lieu", "personne", "r" if n else None) for i, n in enumerate([1] * 10 + [0] * 12)]
    rows += [(100 + i, a, b, "r") for i, (a, b) in enumerate([("date", "lieu"), ("personne", "lieu"), ("personne", "lieu"), ("lieu", "lieu"), ("lieu", "lieu"), ("lieu", "lieu")])]
    got = sampling.capped(spark.createDataFrame(rows, "id long, ent1type string, ent2type string, relation string"), mentions.ENTITY_TYPES, ["id"]).collect()
    kept = [(r.ent1type, r.relation) for r in got]
    assert kept.count(("lieu", "r")) == 8 and kept.count(("lieu", None)) == 8 and kept.count(("date", "r")) == 1 and len(kept) == 17
    rel = spark.createDataFrame([("A",)] + [("B",)] * 2 + [("C",)] * 3, "relation string")
    assert {r[0] for r in sampling.rare(rel, "relation").collect()} == {"A", "B"}


def test_crosstab_other(spark):
    df = spark.createDataFrame([("fr", "a"), ("fr", "zz"), ("fr", None), ("fr", ""), (None, "a")], "lang string, source string")
    got = sampling.crosstab(df, "lang", "source", ["a", "other"]).collect()
    assert sorted(map(tuple, got)) == [("fr", 1, 3), ("other", 1, 0)]


def test_split(spark):
    df = spark.createDataFrame([(i, int(i >= 5), f"e{i}", f"s{i}") for i in range(8)], "id long, y int, e string, s string")
    got = [(r.y, r.part) for r in splits.stratified_half(df, "id", "y", ["e", "s"]).collect()]
    assert [got.count(x) for x in ((0, "train"), (1, "train"), (0, "test"), (1, "test"))] == [2, 1, 3, 2]


def test_roc(spark):
    curve = evaluate.roc(spark.createDataFrame([(0.9, 1), (0.8, 0), (0.4, 1), (0.1, 0)], "score double, truth long"))
    assert sorted((r.fpr, r.tpr) for r in curve.collect()) == [(0, 0), (0, 0.5), (0.5, 0.5), (0.5, 1), (1, 1)]
    assert evaluate.auc(spark.createDataFrame([(0.9, 1), (0.8, 0), (0.4, 1), (0.1, 0)], "score double, truth long")).first().auc == 0.75
    assert tuple(evaluate.cut(curve).first()) == (0.9, 0.5)


def test_encoding(spark):
    for tag, want in {"conj:et": "conj", "acl:relcl": "acl:relcl", "nmod:poss": "nmod:poss"}.items():
        assert one(spark, tag, encode.tag) == want
    long = spark.range(1).select(F.sequence(F.lit(1), F.lit(32)).cast("array<long>").alias("a"))
    assert long.select(encode.pad_last(F.col("a"))).first()[0] == list(range(3, 33))
    assert long.select(encode.pad_first(F.slice("a", 1, 2))).first()[0] == [1, 2] + [0] * 28


def test_tree(spark):
    rows = dep_tree_rows(spark, "")
    assert [(r.word, r.pos, r.head, r.rel) for r in rows.orderBy("idx").collect()] == FOX
    packed = trees.trees(rows, "sentence_id").withColumn("entity1", F.lit("The quick fox")).withColumn("entity2", F.lit("lazy dog"))
    got = trees.branches(trees.located(packed, "entity1", "entity2"), "at1", "at2").first()
    assert (got.at1, got.at2, got.lca, got.word_path1, got.word_path2) == (4, 9, 5, "fox/jumps", "dog/jumps")
    assert (got.dep_path1, got.dep_path2, got.pos_path1, got.pos_path2) == ("nsubj/ROOT", "nmod/ROOT", "NN/VBZ", "NN/VBZ")
    missing = packed.withColumn("entity2", F.lit("Apollo 11"))
    got = trees.branches(trees.located(missing, "entity1", "entity2"), "at1", "at2").first()
    assert got.at2 is None and got.word_path1 is None and got.pos_path2 is None
    assert one(spark, "Côtes-d'Armor", trees.last_token) == "Armor" and one(spark, "Apollo 11", trees.last_token) is None


def test_deep_tree(spark):
    heads = {1: 0} | {i: i - 1 for i in range(2, 72)} | {72: 1} | {i: i - 1 for i in range(73, 142)} | {200: 201, 201: 200}
    tokens = spark.createDataFrame([(1, i, h, f"w{i}") for i, h in heads.items()], "k long, idx long, head long, word string")
    at = lambda a, b: trees.branches(trees.trees(tokens, "k").withColumn("a", F.lit(a).cast("long")).withColumn("b", F.lit(b).cast("long")), "a", "b").first()
    got = at(71, 141)
    assert (got.lca, got.word_path1.count("/"), got.word_path2.count("/")) == (1, 70, 70) and got.word_path2.startswith("w141/w140/")
    assert (at(200, 201).lca, at(200, 201).word_path1, at(200, 5).lca, at(999, 5).word_path2) == (200, "w200", None, None)


def test_shortest_path(spark):
    e = graph.edges(spark.createDataFrame([(1, 1, 2), (1, 2, 0), (1, 3, 2)], "k long, idx long, head long"), "k")
    ask = F.expr("array(named_struct('pair', 'x', 'a', 1L, 'b', 3L), named_struct('pair', 'y', 'a', 1L, 'b', 9L))")
    packed = e.groupBy("k").agg(F.collect_list(F.struct("u", "v", "weight")).alias("edges")).select("k", "edges", ask.alias("asks"))
    assert [tuple(r) for r in graph.shortest_paths(packed, "k").collect()] == [(1, "x", "2", 0.4, [2]), (1, "y", None, None, None)]


def test_lightest_path():
    """Against all simple paths of random graphs: the least (weight, length, nodes)."""
    r = random.Random(4)
    for _ in range(60):
        near = graph._graph(*zip(*[(r.randint(1, 7), r.randint(8, 12), 1.0)] + [(a, b, r.choice((0.2, 0.4, 1.0))) for a in range(1, 8) for b in range(a + 1, 8) if r.random() < 0.5]))

        def ways(at, end, done, near=near):
            if at == end:
                yield [end]
            for v in near[at]:
                if v not in done and at != end:
                    yield from ([at, *w] for w in ways(v, end, done | {v}))

        for a in range(1, 8):
            for b in range(1, 8):
                if a != b and a in near and b in near:
                    all_ways = [(round(sum(near[x][y] for x, y in zip(w, w[1:])), 9), len(w), w) for w in ways(a, b, {a})]
                    assert graph._lightest(near, a, b) == (min(all_ways)[2] if all_ways else None)


def test_centralities(monkeypatch):
    """Against all simple paths, and the eigenvectors of the adjacency."""
    r = random.Random(9)
    for case in range(25):
        monkeypatch.setattr(graph, "CELLS", 8 if case % 2 else 1 << 20)
        links = [(a, b, r.choice((0.2, 1.0))) for a in range(1, 8) for b in range(a + 1, 8) if r.random() < 0.45] or [(1, 2, 0.2)]
        near = graph._graph(*zip(*links))
        names, n = sorted(near), len(near)

        def ways(at, end, done, near=near):
            if at == end:
                yield [end]
            for v in near[at]:
                if v not in done and at != end:
                    yield from ([at, *w] for w in ways(v, end, done | {v}))

        want = dict.fromkeys(names, 0.0)
        for a in names:
            for b in names:
                found = [(round(sum(near[x][y] for x, y in zip(w, w[1:])), 9), w) for w in ways(a, b, {a})] if a != b else []
                best = [w for cost, w in found if cost == min(found)[0]]
                for w in best:
                    for x in w[1:-1]:
                        want[x] += 1 / len(best) / (max(1, (n - 1) * (n - 2)) if n > 2 else 1)
        nodes, *arcs = graph._arcs(*zip(*links))
        assert nodes.tolist() == names and np.allclose(graph._betweenness(*arcs), [want[x] for x in names], atol=2e-6)
        adjacent = np.array([[float(b in near[a]) for b in names] for a in names]) + np.eye(n)
        v = np.linalg.matrix_power(adjacent, 200) @ np.ones(n)
        assert np.allclose(graph._eigenvector(*arcs[:2]), v / np.linalg.norm(v), atol=2e-6)


def test_centrality_of_documents(spark, tmp_path):
    rows = [(1, "a b c d e. f g h!"), (2, " ".join(f"w{i}" for i in range(120)) + ".")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "x y z.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.sid, r.node) for r in graph_centrality(spark, str(tmp_path)).collect()}
    want = {(r.sid, n) for r in graph_edges(spark, str(tmp_path)).collect() for n in (r.u, r.v)}
    assert got == want and len({n for s, n in got if s >> 31 == 2}) == 120


def test_sentence_rules(spark):
    cases = {
        "": [""], "A": ["A"], "Mr. Paul? Non": ["Mr.", " Paul?", " Non"], "Mr. paul vint": ["Mr. paul vint"], "un Ph.D. ici": ["un Ph.D. ici"], "A.B.C. x": ["A.B.C. x"],
        "St.E. x": ["St.E.", " x"], "Acme Inc. a dit 3.14. ok": ["Acme Inc. a dit 3.14.", " ok"], "x. y <stop> <prd> z.": ["x.", " y <stop> <prd> z.", ""], "Fini. ": ["Fini.", " "],
    }
    for text, want in cases.items():
        assert one(spark, text, sentences.pieces) == want
    assert one(spark, None, sentences.pieces) is None


def test_running_total(spark):
    rows = [(i % 7, i, i * i % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(5)
    got = {r.b: (r.upto, r.until, r.nth) for r in running_total(running_total(running_total(df, ["a", "b"], "v", "upto"), ["a", "b"], "v", "until", before=True), ["a", "b"], None, "nth").collect()}
    total = 0
    for n, (_, b, v) in enumerate(sorted(rows)):
        assert got[b] == (total + v, total, n + 1)
        total += v
    assert running_total(df.limit(0), ["a"], "v", "t").count() == 0


def test_kept_templates(spark):
    assert one(spark, "a {{citation|" + "|".join("bcdefghijklm") + "}} z {{unité|5}}{{nobr}}", lambda c: chain.run(c, wikitext.KEPT)) == "a " + " ".join("bcdefghijklm") + " z 5"
    for text, want in {"{{sp-|XII|e|et|XIII|e|s}}": "XIIe-XIIIe siècles", "{{-s-|IV}}": "IVe siècle", "{{Album|a={{date|1}} b}}x": "x", "{{Infobox V\n|n={{a|b}}\n}}x": "x", "{| a\n{| b |}\n|}x": "x", "[[Fichier:a|b [[c]] d]]x": "x", "[[a|b|c]]": "b|c", "<b class='x'>g</b><br/>": "g"}.items():
        assert one(spark, text, wikitext.clean) == want


def test_find(spark):
    tokens = spark.createDataFrame([(1, i + 1, w) for i, w in enumerate("le le roi de de France le roi".split())], "k long, idx long, word string")
    packed = graph.blanked(tokens, "k").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]).alias("w"))
    at = lambda *part: [tuple(x) for x in packed.select(graph.find(F.col("w"), F.array(*map(F.lit, part)))).first()[0]]
    assert at("le", "roi") == [(1, 3), (7, 8)] and at("roi", "de", "France") == [(3, 6)] and at("France") == [(6, 6)] and at("x") == []


def test_contraction(spark):
    tokens = spark.createDataFrame([(1, 1, "Jeanne", 4), (1, 2, "d", 1), (1, 3, "Arc", 1), (1, 4, "vit", 0), (1, 5, "vit", 4), (1, 6, ".", 4)], "k long, idx long, word string, head long")
    spans = spark.createDataFrame([(1, 1, 3)], "k long, first long, last long")
    nodes = graph.contracted(tokens, spans, "k")
    assert [r.node for r in nodes.orderBy("idx").collect()] == [1, 1, 1, 4, 4, 6]
    assert sorted((r.u, r.v, r.weight) for r in graph.contracted_edges(nodes, "k").collect()) == [(1, 4, 0.2), (4, 6, 0.2)]
    rows = tokens.withColumn("rel", F.when(F.col("word") == "d", "punct").otherwise("dep")).withColumn("head", F.when(F.col("idx") == 3, 2).otherwise(F.col("head")))
    assert [(r.idx, r.head) for r in graph.without_signs(rows, "k").orderBy("idx").collect()] == [(1, 4), (3, 1), (4, 0), (5, 4), (6, 4)]
    graphs = graph.contracted_edges(nodes, "k").groupBy("k").agg(F.collect_list(F.struct("u", "v", "weight")).alias("edges"))
    ask = spark.createDataFrame([("p", 1, 1, 6), ("q", 1, 1, None), ("r", 2, 1, 6)], "id_entities_pair string, k long, a long, b long")
    got = {r.id_entities_pair: (r.lemma, r.dep) for r in graph.paths(ask, graphs, trees.trees(tokens.withColumn("lemma", F.upper("word")).withColumn("rel", F.lit("r")), "k"), "k").collect()}
    assert got == {"p": ("VIT", "r"), "q": (None, None), "r": (None, None)}


def test_encoders(spark):
    vocab = encode.vocabulary(spark.createDataFrame([("b/a",), ("c",)], "p string"), "p")
    assert {r.word: r.code for r in vocab.collect()} == {"UKNWN": 1, "a": 2, "b": 3, "c": 4}
    met = spark.createDataFrame([(1, "c/x/a"), (2, ""), (3, None)], "k long, p string")
    assert {r.k: r.codes for r in encode.encoded(met, "k", "p", vocab).collect()} == {1: [4, 1, 2], 2: [], 3: []}
    v = spark.range(1).select(encode.step_vector(F.lit(None).cast("array<double>"), F.lit("nsubj"), F.lit("none"))).first()[0]
    assert len(v) == 153 and [i for i, x in enumerate(v) if x] == [103]
    assert one(spark, "a-b-,c", lambda c: graph.kept_split(F.split(c, ","), "-")) == ["a-", "b-", "", "c"]
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, x string")
    yes, no = evaluate.routed(rows, spark.createDataFrame([(1, "P17"), (2, "None")], "k long, predicted string"), "k")
    assert [r.k for r in yes.collect()] == [1] and [r.k for r in no.collect()] == [2]
    scores = F.array(F.lit(0.1), F.lit(0.9), F.lit(0.9))
    assert spark.range(1).select(evaluate.decoded(scores, properties.classes())).first()[0] == properties.classes()[1] and len(properties.classes()) == 180


def test_kb(spark):
    reply = '{"results":{"bindings":[{"item":{"value":"http://kb/Q1"},"lemma":{"value":"a"}},{"lemma":{"value":"b"}}]}}'
    assert [tuple(r) for r in one(spark, reply, lambda c: kb.decode(c, "item", "lemma"))] == [("http://kb/Q1", "a"), (None, "b")]
