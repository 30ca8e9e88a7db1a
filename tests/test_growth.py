"""Steps that large tables go through: no row moves that need not, and the same results as plainer forms."""

import random
import re

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from textloom.operators import graph, mentions, trees
from textloom.plans import base


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sentences_in_one_pass(spark, tmp_path):
    """Random texts of what the rules look at, against the SQL; no expression goes from atom to atom."""
    r = random.Random(3)
    parts = ["Mr", "St", "Ph", "D", "Ph.D.", "A.", "B.", "a.", "com", "me", " Inc", "Jr", " Jr", "3", ".", ".", " ", "\n", "A", "b", "é", "?", "!", "Dr", " Z", "…"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    query = lambda s, d: base.found_sentences(s, d).select("doc_id", "pos", "sentence")
    assert compare.differences(spark, query, f"WITH {base.SENTENCES} SELECT doc_id, pos, sentence FROM sents", str(tmp_path)) == ""
    assert "lambda" not in plan(query(spark, str(tmp_path)))


def test_mentions_found_as_a_whole(spark):
    """Capitalised tokens by regular expressions, against a loop over all tokens."""
    r = random.Random(4)
    rows = [(i, "".join(r.choice(["A", "b", " ", " ", "\nC", "Éa", "Z\n", "😀", "x B1", "."]) for _ in range(r.randint(0, 14)))) for i in range(2000)] + [(-1, None)]

    def want(text):
        at = 0
        for t in (text or "").split(" "):
            if "A" <= t[:1] <= "Z":
                yield at, at + len(t), t
            at += len(t) + 1

    got = mentions.capitalised(spark.createDataFrame(rows, "k long, sentence string"), "k")
    assert sorted(tuple(x) for x in got.collect()) == sorted((k, *w) for k, t in rows for w in want(t))
    assert not re.search(r"split\([^,()]*, +, -1\)", plan(got))


@pytest.mark.parametrize("name", ["graph_centrality", "graph_contracted", "graph_degree", "graph_directed_degree", "graph_edges", "graph_unsigned", "lca_paths", "sdp_path", "span_find"])
def test_nothing_moves(spark, tmp_path, name):
    """What is made of a sentence is made where the sentence is."""
    spark.createDataFrame([(1, "Un Roi de France vit. Il dort.")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    conf = spark.conf.get("textloom.text.partitions")
    spark.conf.unset("textloom.text.partitions")
    try:
        found = plan(__spark_entry__.queries()[name](spark, str(tmp_path)))
    finally:
        spark.conf.set("textloom.text.partitions", conf)
    assert "Exchange" not in found


def graphs_of(r):
    """Random sentences with gaps in their numbers, several governors, heads that are not there, and loops."""
    for k in range(60):
        ids = sorted(r.sample(range(1, 1 << r.choice((4, 40))), r.randint(1, 6)))
        yield from ((k % 7, f"s{k}", i, r.choice([0, i, r.choice(ids), 3])) for i in ids for _ in range(r.choice((1, 1, 2))))


def test_edges_of_sentences(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 7)
    rows = list(graphs_of(random.Random(8)))
    tokens, want, arcs = spark.createDataFrame(rows, "a int, b string, idx long, head long").repartition(3), {}, set()
    for k in {x[:2] for x in rows}:
        ids = sorted({x[2] for x in rows if x[:2] == k})
        for w, p in [(0.2, (x[3], x[2])) for x in rows if x[:2] == k and x[3] > 0] + [(1.0, p) for p in zip(ids, ids[1:])]:
            if p[0] != p[1]:
                want.setdefault((*k, min(p), max(p)), w)
                arcs.add((*k, *p))
    assert sorted(map(tuple, graph.edges(tokens, "a", "b").collect())) == sorted((*k, w) for k, w in want.items())
    nodes = {k[:2] + (k[i],) for k in want for i in (2, 3)}
    near = lambda s: sorted((*n, sum(x[:2] == n[:2] and n[2] in x[2:] for x in s), round(sum(x[:2] == n[:2] and n[2] in x[2:] for x in s) / (sum(m[:2] == n[:2] for m in nodes) - 1), 6)) for n in nodes)
    assert sorted(map(tuple, graph.degrees_of(graph.packed(tokens, "a", "b"), "a", "b").collect())) == near(set(want))
    got = graph.directed_degrees(tokens, "a", "b").collect()
    assert {(r.a, r.b, r.node): (r.in_degree, r.out_degree) for r in got} == {n: tuple(sum(x[:2] == n[:2] and x[i] == n[2] for x in arcs) for i in (3, 2)) for n in nodes}


def test_nodes_and_signs_of_sentences(spark):
    """Packed sentences against the forms that join token rows; spans overlap and reach beyond the sentence."""
    r = random.Random(11)
    rows = [(f"s{k}", i, r.choice("aab"), r.choice([0, 1, 3, i]), r.choice(["punct", "dep"])) for k in range(50) for i in sorted(r.sample(range(1, 9), r.randint(1, 7)))]
    spans = [(f"s{k}", a, a + r.randint(0, 3)) for k in range(0, 60, 2) for a in r.sample(range(0, 9), r.randint(1, 3))]
    tokens = spark.createDataFrame(rows, "k string, idx long, word string, head long, rel string")
    found = spark.createDataFrame(spans, "k string, first long, last long")
    packed = graph.packed(tokens.drop("rel"), "k").join(found.groupBy("k").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "k", "left")
    nodes = graph.contracted(tokens, found, "k")
    got = {x.k: list(zip(x.ids, x.nodes)) for x in graph.with_nodes(packed).collect()}
    assert got == {k: sorted((x.idx, x.node) for x in nodes.collect() if x.k == k) for k in got}
    want = {(x.k, x.u, x.v): x.weight for x in graph.contracted_edges(nodes, "k").collect()}
    assert want and {(x.k, x.u, x.v): x.weight for x in graph.contracted_edges_of(packed, "k").collect()} == want
    rels = tokens.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("idx", "head", "word", "rel"))).alias("p"))
    trees = rels.select("k", F.col("p.idx").alias("ids"), F.col("p.head").alias("heads"), F.col("p.word").alias("words"), F.col("p.rel").alias("rels"))
    assert sorted(map(tuple, graph.without_signs_of(trees, "k").collect())) == sorted((x.k, x.idx, x.head) for x in graph.without_signs(tokens, "k").collect())


def test_batches_of_graphs(spark, monkeypatch):
    """Centralities and lightest paths of many sentences at once, against one graph at a time; shapes repeat, and weights may be no multiples of a billionth."""
    monkeypatch.setattr(graph, "CELLS", 40)
    r = random.Random(12)
    for weights in ((0.2, 1.0), (0.2, 0.3, 1 / 3)):
        edges = [[(u, v, r.choice(weights)) for u in range(1, 7) for v in range(u + 1, 7) if r.random() < 0.4] for _ in range(30)]
        edges += [[(u * 5, v * 5, w) for u, v, w in e] for e in edges[:15]]
        asks = [[(f"{k}-{i}", r.choice([None, 1, 2, 3, 5]), r.choice([1, 4, 5, 6, 9])) for i in range(r.randint(0, 4))] for k in range(len(edges))]
        rows = spark.createDataFrame(list(zip(range(len(edges)), edges, asks)), "k long, edges array<struct<u: long, v: long, weight: double>>, asks array<struct<pair: string, a: long, b: long>>").coalesce(1)
        got = {(x.k, x.node): (x.betweenness, x.eigenvector) for x in graph.centralities(rows, "k").collect()}
        want = {}
        for k, e in enumerate(edges):
            if e:
                nodes, *arcs = graph._arcs(*zip(*e))
                want |= {(k, n): x for n, *x in zip(nodes.tolist(), graph._betweenness(*arcs).tolist(), graph._eigenvector(*arcs[:2]).tolist())}
        assert got.keys() == want.keys() and all(abs(got[n][i] - want[n][i]) < 2e-6 for n in want for i in (0, 1))
        ways = {}
        for e, some in zip(edges, asks):
            near = graph._graph(*zip(*e)) if e else {}
            for pair, a, b in some:
                p = graph._lightest(near, a, b) if a in near and b in near else None
                ways[pair] = (p[1:-1], round(sum(near[x][y] for x, y in zip(p, p[1:])), 6)) if p else (None, None)
        assert {x.pair: (x.nodes, x.cost) for x in graph.shortest_paths(rows, "k").collect()} == ways


def test_depth(spark):
    """Climbs that know where to end, against those that don't: trees, rings, gaps and heads that are not there."""
    r = random.Random(13)
    rows = [(k, i, r.choice([0, i // 2, r.randint(0, 9)]), f"w{i}") for k in range(60) for i in sorted(r.sample(range(1, 9), r.randint(2, 8)))]
    packed = trees.trees(spark.createDataFrame(rows, "k long, idx long, head long, word string"), "k").withColumn("a", F.element_at("ids", 1)).withColumn("b", F.element_at("ids", -1))
    deep = graph.with_depth(packed)
    assert sorted(map(tuple, trees.branches(deep, "a", "b").drop("depth").collect())) == sorted(map(tuple, trees.branches(packed, "a", "b").collect()))
    chain = spark.createDataFrame([(1, list(range(1, 301)), [max(0, 1 << (i.bit_length() - 1) if i & (i - 1) else i // 2) for i in range(1, 301)])], "k long, ids array<long>, heads array<long>")
    assert graph.with_depth(chain).first().depth == 9


@pytest.mark.parametrize("name", ["features_xu", "features_ours"])
def test_a_sentence_moves_once(spark, tmp_path, name):
    """Mentions and sentences are dealt by sentence; neither tokens, edges, paths nor feature rows are."""
    spark.createDataFrame([(1, "Un Roi de France vit. Il Dort.")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "roi de france")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan(__spark_entry__.queries()[name](spark, str(tmp_path))))
    dealt = [re.sub(r"#\d+L?", "", x) for x in dealt]
    assert set(dealt) - {"lemma, 4"} == {"doc_id, pos, 4"} and len(dealt) < 4  # and the links, by lemma
